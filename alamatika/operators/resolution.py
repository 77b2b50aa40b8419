"""Ranking, fallback and response operators (R1..R9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from alamatika.functions import constants as K
from alamatika.functions import scoring as S
from alamatika.functions import text as T
from alamatika.operators.candidates import SLOTS

LOCATION_TYPE = (
    "struct<postal_code:string,sub_district:string,district:string,city:string,province:string>"
)


def _order() -> WindowSpec:
    return W.partitionBy("address_id").orderBy(
        F.col("confidence").desc(),
        F.col("levels").desc(),
        F.size("conflicts"),
        F.col("kode"),
        F.col("cand_id"),
    )


def _levels(evaluated: DataFrame) -> DataFrame:
    return evaluated.withColumn("levels", S.filled_levels(*[F.col(s) for s in SLOTS]))


def rank(evaluated: DataFrame) -> DataFrame:
    """Adds ``rank`` and, for R2, ``next_confidence``.

    Order: confidence, filled levels (both descending), conflicts, then kode and id so
    that ties are the same on every run.
    """
    w = _order()
    return (
        _levels(evaluated)
        .withColumn("rank", F.row_number().over(w))
        .withColumn("next_confidence", F.lead("confidence").over(w))
    )


def top_two(evaluated: DataFrame) -> DataFrame:
    """R1 for R2 alone: the first two candidates of each address, as ``rank`` has them.

    Tasks drop the others before any exchange (a window group limit); the second is looked
    up among the two that are left.
    """
    w = _order()
    first = _levels(evaluated).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 2)
    return first.withColumn("next_confidence", F.lead("confidence").over(w))


def winners(ranked: DataFrame) -> DataFrame:
    """R2: the top candidate of each address with its final status."""
    return ranked.where(F.col("rank") == 1).withColumn(
        "status", S.ambiguous(F.col("status"), F.col("confidence"), F.col("next_confidence"))
    )


def with_status(addresses: DataFrame, winners_: DataFrame) -> DataFrame:
    """R2 for all addresses: those without a candidate are UNKNOWN with confidence 0."""
    return addresses.join(
        winners_.select("address_id", "status", "confidence"), "address_id", "left"
    ).select(
        *addresses.columns,
        F.coalesce("status", F.lit(K.UNKNOWN)).alias("status"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def location(
    postal: Column, own_postal: Column, sub_district: Column, district: Column,
    city: Column, province: Column,
) -> Column:
    """Location struct; the postal slot wins over the subdistrict's own code."""
    return F.struct(
        F.coalesce(postal, own_postal, F.lit("")).alias("postal_code"),
        text_or_empty(sub_district).alias("sub_district"),
        text_or_empty(district).alias("district"),
        text_or_empty(city).alias("city"),
        text_or_empty(province).alias("province"),
    )


def fill_postal(place: Column, input_code: Column) -> tuple[Column, Column]:
    """(location, applied): copy the input code when neither code nor subdistrict is known."""
    applied = (
        (input_code != "") & (place["postal_code"] == "") & (place["sub_district"] == "")
    )
    filled = F.when(applied, place.withField("postal_code", input_code)).otherwise(place)
    return filled, applied


def append_reason(reasons: Column, applied: Column, reason: str) -> Column:
    """Add a postal reason when its rule was applied."""
    return F.when(applied, F.concat(reasons, F.array(F.lit(reason)))).otherwise(reasons)


def format_place(place: Column) -> Column:
    """T14 on a location struct."""
    return T.format_location(
        place["sub_district"], place["district"], place["city"], place["province"],
        place["postal_code"],
    )
