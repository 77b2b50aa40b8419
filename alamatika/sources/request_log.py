"""Request log (S11): one row per validated address with the response as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_CODEC = "zstd"  # responses as JSON repeat names of fields and regions


def log_rows(responses: DataFrame, created_at: Column | None = None) -> DataFrame:
    """S11 rows. ``normalized_address`` holds the formatted address, as ever."""
    place = "location"
    return responses.select(
        F.sha2(F.concat_ws(":", F.lit("request"), "address_id"), 256).alias("id"),
        "address_id",
        "raw_input",
        F.col("formatted_address").alias("normalized_address"),
        "confidence",
        *[f"{place}.{c}" for c in ("postal_code", "sub_district", "district", "city", "province")],
        F.col("metadata.location_version").alias("location_version"),
        F.to_json(
            F.struct(*responses.columns), {"ignoreNullFields": "false"}
        ).alias("output_json"),
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
    )


def append_log(responses: DataFrame, path: str) -> None:
    """Append to a Parquet table, one folder per day of the request."""
    log_rows(responses).withColumn("day", F.to_date("created_at")).write.mode(
        "append"
    ).partitionBy("day").option("compression", LOG_CODEC).parquet(path)
