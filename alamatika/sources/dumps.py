"""Gazetteer dump scans (S1, S2): one ``('key','value')`` tuple per line of SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ('...','...') with '' as the escaped quote; the first tuple of a line is taken.
_TUPLE = r"\('([^']*(?:''[^']*)*)',\s*'([^']*(?:''[^']*)*)'\)"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text dump with their position: (line_pos, value).

    A big dump is split over tasks; file, block offset and the running number inside
    the task order the lines without a shuffle.
    """
    return spark.read.text(path).select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line_pos"),
        "value",
    )


def _field(n: int) -> Column:
    return F.replace(F.regexp_extract("value", _TUPLE, n), F.lit("''"), F.lit("'"))


def level_of(kode: Column) -> Column:
    """Level id of a code: number of dots + 2."""
    return (F.size(F.split(kode, r"\.")) + 1).cast("int")


def parse_regions(lines: DataFrame) -> DataFrame:
    """(line_pos, kode, name, level_id) of every line that holds a tuple."""
    return lines.where(F.col("value").rlike(_TUPLE)).select(
        "line_pos", _field(1).alias("kode"), _field(2).alias("name")
    ).withColumn("level_id", level_of(F.col("kode")))


def parse_postal_codes(lines: DataFrame) -> DataFrame:
    """(kode, postal_code), empty codes dropped, the last line of a kode wins."""
    return (
        lines.where(F.col("value").rlike(_TUPLE))
        .select("line_pos", _field(1).alias("kode"), _field(2).alias("postal_code"))
        .where(F.col("postal_code") != "")
        .groupBy("kode")
        .agg(F.max_by("postal_code", "line_pos").alias("postal_code"))
    )


def read_region_dump(spark: SparkSession, path: str) -> DataFrame:
    return parse_regions(read_lines(spark, path))


def read_postal_dump(spark: SparkSession, path: str) -> DataFrame:
    return parse_postal_codes(read_lines(spark, path))
