"""Joins with dimension tables whose size is checked before they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Serialized size up to which a dimension table is sent to every executor.
MAX_BROADCAST_BYTES = 256 << 20
_ROW_OVERHEAD = 64


def measured_bytes(df: DataFrame) -> int:
    """Rough in-memory size of a table from one distributed aggregate (one row back)."""
    width = F.lit(_ROW_OVERHEAD)
    for name, kind in df.dtypes:
        if kind == "string":
            width = width + F.coalesce(F.octet_length(name), F.lit(0)) + 8
        elif kind.startswith(("array", "struct", "map")):
            width = width + F.coalesce(F.octet_length(F.to_json(name)), F.lit(0))
        else:
            width = width + 8
    return df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("n")).first()["n"]


def broadcast_if_small(df: DataFrame, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only for a table measured within ``limit``.

    A bigger table is left without a hint: Spark then joins by shuffle and adaptive
    execution splits the hot keys.
    """
    return F.broadcast(df) if measured_bytes(df) <= limit else df


COPIES = 16  # of a dimension row in a lookup by shuffle


def lookup_left(
    rows: DataFrame, key: str, dimension: DataFrame, dimension_key: str, small: bool
) -> DataFrame:
    """Left join of a dimension with unique keys on a nullable id; its key is dropped.

    ``small``: the dimension is measured within the broadcast bound. Otherwise each of its
    rows comes ``COPIES`` times and rows choose one by their hash, so a popular id is dealt
    to several tasks; rows without an id get a number of their own and are spread over all.
    Rows need address_id and cand_id.
    """
    if small:
        return rows.join(
            F.broadcast(dimension), F.col(key) == F.col(dimension_key), "left"
        ).drop(dimension_key)
    own = F.xxhash64("address_id", "cand_id")
    salt = F.when(F.col(key).isNull(), own).otherwise(F.pmod(own, F.lit(COPIES)))
    copies = dimension.withColumn(
        "_copy", F.explode(F.expr(f"sequence(0L, {COPIES - 1}L)"))
    )
    same = (F.col(key) == F.col(dimension_key)) & (F.col("_salt") == F.col("_copy"))
    return rows.withColumn("_salt", salt).join(copies, same, "left").drop(
        "_salt", "_copy", dimension_key
    )
