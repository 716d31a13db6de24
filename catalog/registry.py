"""Registration of queries and of the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, floats: str = "", dates: str = "", places: int = 6):
    """Register a query. ``floats`` are rounded to ``places`` and ``dates`` become text,
    in the query and in its SQL alike, so that both compare as plain values."""
    floats, dates = floats.split(), dates.split()

    def register(fn):
        def run(spark, sf_dir):
            df = fn(spark, sf_dir)
            scale = F.lit(10.0 ** places)
            new = {c: F.rint(F.col(c) * scale) / scale for c in floats}
            new = {c: F.when(v == 0, 0.0).otherwise(v) for c, v in new.items()}
            new.update({c: F.col(c).cast("string") for c in dates})
            return df.withColumns(new) if new else df

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            changes = [f"(case when {r6(c, places)} = 0 then 0e0 else {r6(c, places)} end) as {c}" for c in floats]
            changes += [f"cast({c} as varchar) as {c}" for c in dates]
            replace = f" replace ({', '.join(changes)})" if changes else ""
            ORACLE[name] = f"select *{replace} from ({sql}) result" if replace else sql
        return run

    return register


def r6(expr: str, places: int = 6) -> str:
    return f"(round_even(({expr}) * 1e{places}, 0) / 1e{places})"
