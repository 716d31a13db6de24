"""Headerless tab-separated daily exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dist import pin
from ..schemas import KEPT_COLUMNS, NULL_TOKENS, RAW_COLUMNS

# Any-case ".csv"; names starting with a dot are already skipped by Spark.
FILE_GLOB = "*.[cC][sS][vV]"


def parse_lines(lines: DataFrame, columns=KEPT_COLUMNS) -> DataFrame:
    """Text lines to string columns.

    Short lines are padded with nulls and lines with too many fields are skipped.
    Quotes are plain characters. Done on text rather than with the CSV reader,
    whose malformed-row check depends on which columns the query happens to use.
    """
    fields = F.split(F.col("value"), "\t", -1)
    width = len(RAW_COLUMNS)

    def field(name: str) -> Column:
        text = F.get(F.col("_fields"), RAW_COLUMNS.index(name))
        return F.when(~text.isin(*NULL_TOKENS), text).alias(name)

    extra = [c for c in lines.columns if c != "value"]
    split = pin(lines.where(F.col("value") != "").select(fields.alias("_fields"), *extra))
    return pin(split.where(F.size("_fields") <= width).select(*[field(c) for c in columns], *extra))


def read_export(
    spark: SparkSession, path: str, country_codes=None, columns=KEPT_COLUMNS, with_position: bool = False
) -> DataFrame:
    """One export file, or every export file in a folder, as kept string columns.

    ``with_position`` adds ``file_name`` and ``line_no``, an order that follows the
    files by name and the lines inside each, for "first row wins" deduplication.
    """
    lines = spark.read.option("pathGlobFilter", FILE_GLOB).text(path)
    if with_position:
        lines = lines.select(
            "value",
            F.col("_metadata.file_name").alias("file_name"),
            F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line_no"),
        )
    rows = parse_lines(lines, columns)
    if country_codes:
        rows = rows.where(F.col("ActionGeo_CountryCode").isin(*sorted(country_codes)))
    return rows


def read_folder(spark: SparkSession, folder: str, country_codes=None, **kwargs) -> DataFrame:
    """Every export in ``folder``; an error when there is none."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", FILE_GLOB).load(folder).select("path")
    if names.isEmpty():
        raise FileNotFoundError(f"no export files in {folder}")
    return read_export(spark, folder, country_codes, **kwargs)


def missing_days(spark: SparkSession, observed: DataFrame, start: str, end: str, column: str = "day") -> DataFrame:
    """Days of the calendar ``start``..``end`` with no row in ``observed``."""
    calendar = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")
    )
    return calendar.join(observed.select(F.col(column).alias("day")).distinct(), "day", "left_anti")


def new_files(landed: DataFrame, loaded: DataFrame, column: str = "file_name") -> DataFrame:
    """Landed files that have not been loaded yet."""
    return landed.join(loaded.select(column).distinct(), column, "left_anti")
