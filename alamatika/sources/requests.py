"""Address requests (S4, T1, R11): read, check, route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alamatika.functions import constants as K
from alamatika.functions import text as T
from alamatika.operators.bounded import broadcast_if_small
from alamatika.operators.gazetteer import latest_sources

FIELDS = ("address_id", "address", "source_code")
MALFORMED = "invalid request body"
UNKNOWN_SOURCE = "unknown location source"


def read_requests(
    spark: SparkSession, path: str, stream: bool = False, files_per_batch: int | None = None
) -> DataFrame:
    """JSON lines {address, source_code, address_id}, batch or stream.

    A line that is no request keeps its text in ``_corrupt_record``; see ``parse_requests``.
    """
    reader = spark.readStream if stream else spark.read
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return parse_requests(reader.text(path).where(F.trim("value") != ""))


def parse_requests(lines: DataFrame, column: str = "value") -> DataFrame:
    """S4 on a column of JSON text, as message queues deliver it.

    A request is one object whose fields are texts or null; field names match without
    regard to case, the exact one first. Anything else (numbers, lists, broken text) is
    kept in ``_corrupt_record``.
    """
    body = F.from_json(F.col(column), "map<string,variant>", {"mode": "PERMISSIVE"})
    rest = [c for c in lines.columns if c not in (column, *FIELDS)]
    given = F.col("address_id").cast("string") if "address_id" in lines.columns else F.lit(None)
    rows = lines.select(
        *rest, F.col(column).alias("_line"), given.cast("string").alias("_given"), body.alias("_body")
    )

    def named(field: str) -> Column:
        """The field's value: the exact name, else the last that differs only by case."""
        like = F.map_values(F.map_filter("_body", lambda k, _: F.lower(k) == field))
        return F.coalesce(F.try_element_at(F.col("_body"), F.lit(field)), F.get(like, F.size(like) - 1))

    rows = rows.select("*", *[named(f).alias(f"_v_{f}") for f in FIELDS])
    good = F.col("_body").isNotNull() & F.ltrim("_line").startswith("{")
    for f in FIELDS:
        value = F.col(f"_v_{f}")
        good = good & (value.isNull() | F.schema_of_variant(value).isin("STRING", "VOID"))
    good = F.coalesce(good, F.lit(False))
    text = {f: F.when(good, F.try_variant_get(F.col(f"_v_{f}"), "$", "string")) for f in FIELDS}
    return rows.select(
        *rest,
        F.coalesce(text["address_id"], F.col("_given")).alias("address_id"),
        text["address"].alias("address"), text["source_code"].alias("source_code"),
        F.when(~good & F.col("_line").isNotNull(), F.col("_line")).alias("_corrupt_record"),
    )


def with_address_ids(requests: DataFrame, prefix: str = "row-") -> DataFrame:
    """Give requests without ids a unique one per row of a scan.

    The id is the prefix and the row's place in its task; a prefix of the run or batch
    keeps ids of several runs apart.
    """
    made = F.concat(F.lit(prefix), F.monotonically_increasing_id().cast("string"))
    given = F.col("address_id") if "address_id" in requests.columns else F.lit(None)
    return requests.withColumn("address_id", F.coalesce(given.cast("string"), made))


def registry_of(sources: DataFrame) -> DataFrame:
    """G11 as a join side: the newest version of each code, broadcast if measured small.

    Requests share few sources, so joining them by shuffle would pile them up.
    """
    return broadcast_if_small(
        latest_sources(sources).select(
            F.col("code").alias("source_code"),
            F.col("id").alias("source_id"),
            F.col("version").alias("source_version"),
        )
    )


def route(
    requests: DataFrame,
    registry: DataFrame,
    default_source: str = K.DEFAULT_SOURCE,
    max_bytes: int = K.MAX_ADDRESS_BYTES,
) -> DataFrame:
    """Adds source_id, source_version, http_status and reject_reason (null = accepted).

    Bad bodies and addresses are 400, an unknown source is 500; an empty source code
    means the default source. ``registry`` comes from ``registry_of``.
    """
    code = F.coalesce(F.nullif("source_code", F.lit("")), F.lit(default_source))
    rows = requests.withColumn("source_code", code).join(registry, "source_code", "left")
    bad = T.request_error(F.col("address"), max_bytes)
    if "_corrupt_record" in requests.columns:
        bad = F.when(F.col("_corrupt_record").isNotNull(), F.lit(MALFORMED)).otherwise(bad)
    return rows.withColumn(
        "reject_reason",
        F.coalesce(bad, F.when(F.col("source_id").isNull(), F.lit(UNKNOWN_SOURCE))),
    ).withColumn(
        "http_status",
        F.when(F.col("reject_reason").isNull(), 200)
        .when(F.col("reject_reason") == UNKNOWN_SOURCE, 500)
        .otherwise(400),
    )


def accepted(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("reject_reason").isNull())


def rejected(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("reject_reason").isNotNull())
