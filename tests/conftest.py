import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spikelens.session import build  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build("tests", "local[4]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spikelens-test-")})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of one column expression."""
    return lambda column: spark.range(1).select(column.alias("v")).first()[0]


def events(spark, rows):
    """Event rows from dicts; whatever is left out gets a plain value."""
    base = dict(event_id=0, day="2024-01-10", country="USA", quad_class=3, root_code="10", goldstein=0.0, avg_tone=0.0,
                num_mentions=1, num_sources=1, actor1="A", actor2="B", actor1_cc="C1", actor2_cc="C2", location="X",
                source_url=None, has_missing_actor=False)
    schema = ("event_id bigint, day string, country string, quad_class int, root_code string, goldstein double, "
              "avg_tone double, num_mentions bigint, num_sources bigint, actor1 string, actor2 string, actor1_cc string, "
              "actor2_cc string, location string, source_url string, has_missing_actor boolean")
    data = [tuple({**base, **r}[f] for f in base) for r in rows]
    from pyspark.sql import functions as F

    from spikelens.operators.clean import enrich

    df = spark.createDataFrame(data, schema).withColumn("day", F.col("day").cast("date")).withColumn(
        "event_date", F.col("day"))
    return enrich(df)
