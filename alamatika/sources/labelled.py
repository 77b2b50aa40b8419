"""Labelled address files (S3) and accuracy results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alamatika.functions import text as T

_COLUMNS = (
    "source", "serp", "raw_address",
    "actual_province", "actual_city", "actual_district", "actual_subdistrict",
)


def header_of(spark: SparkSession, path: str) -> str:
    """The header line: the first that is not blank."""
    header = spark.read.text(path).where(F.trim("value") != "").first()
    return "" if header is None else header["value"]


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """S3: quoted CSV, line breaks inside quotes, '""' escapes.

    Blank lines and rows of fewer than three columns are skipped, text is trimmed, missing
    labels are ''. An empty third column is kept, quoted or not. Line breaks inside quotes
    bind each file to one task, so large label sets should come as many files.
    """
    header = header_of(spark, path)
    sep = ";" if ";" in header else ","
    short = "_short"  # the text of a record with fewer (or more) columns than the schema
    rows = (
        spark.read.schema(", ".join(f"{c} string" for c in (*_COLUMNS, short)))
        .option("header", True)
        .option("enforceSchema", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "\u0000")
        .option("emptyValue", "")
        .option("columnNameOfCorruptRecord", short)
        .option("sep", sep)
        .csv(path)
    )
    # An empty cell and a missing one are both null here; the record's text tells them apart.
    bare = F.regexp_replace(short, '"(?:[^"]|"")*+"', "")
    separators = F.char_length(bare) - F.char_length(F.replace(bare, F.lit(sep), F.lit("")))
    there = F.col("raw_address").isNotNull() | F.col(short).isNull() | (separators >= 2)
    # Behind a line of blanks the header comes as a row.
    names = F.from_csv(F.lit(header), ", ".join(f"{c} string" for c in _COLUMNS), {"sep": sep})
    is_header = F.struct(*_COLUMNS).eqNullSafe(names)
    return rows.where(there & ~is_header).select(
        *[T.trimmed(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in _COLUMNS[2:]]
    )


def replay_text(raw_address: str = "raw_address"):
    """B1: real line breaks become blanks before an address is validated."""
    return F.replace(F.col(raw_address), F.lit("\n"), F.lit(" "))


def write_accuracy(records: DataFrame, path: str, run_id: str) -> None:
    """JSON records of one run under its own partition; a re-run replaces it.

    Compressed, as records repeat field names and regions in each of their candidates.
    """
    records.write.mode("overwrite").option("ignoreNullFields", False).option("compression", "gzip").json(
        f"{path}/run_id={run_id}"
    )
