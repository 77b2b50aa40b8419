"""Accuracy operators (B1..B3): predicted against labelled region names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alamatika.functions import text as T

LEVELS = ("province", "city", "district", "subdistrict")


def compare(labels: DataFrame, responses: DataFrame) -> DataFrame:
    """B1 + B2: one row per label with four flags.

    ``labels``: address_id, raw_address and actual_<level>; ``responses`` as validated.
    A label without a response keeps a null result and all flags false.
    """
    predicted = responses.select(
        "address_id", F.struct(*[c for c in responses.columns if c != "address_id"]).alias("quality")
    )
    return flagged(labels.join(predicted, "address_id", "left"))


def flagged(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """B1 on labels that have their result, ``quality``, beside them (null: none)."""
    guess = {
        "province": "province", "city": "city", "district": "district",
        "subdistrict": "sub_district",
    }
    flags = [
        (
            F.col("quality").isNotNull()
            & T.same_text(F.col(f"quality.location.{guess[level]}"), F.col(f"actual_{level}"))
        ).alias(f"same_{level}")
        for level in LEVELS
    ]
    return rows.select(
        "address_id",
        "raw_address",
        "quality",
        *[T.trimmed(F.col(f"actual_{level}")).alias(f"actual_{level}") for level in LEVELS],
        *flags,
        *keep,
    )


def outcome_counts(compared: DataFrame) -> DataFrame:
    """How many labels got a response and how many did not."""
    return compared.agg(
        F.count_if(F.col("quality").isNotNull()).alias("succeeded"),
        F.count_if(F.col("quality").isNull()).alias("failed"),
    )


Z = 1.96  # of the normal distribution: 95 of 100 intervals hold the true share


def _interval(correct: Column, labels: Column) -> tuple[Column, Column]:
    """Wilson's bounds of a share; they stay inside 0 and 1 for few labels too."""
    share, z2 = correct.cast("double") / labels, F.lit(Z * Z)
    centre = (share + z2 / (2 * labels)) / (1 + z2 / labels)
    half = F.lit(Z) * F.sqrt((share * (1 - share) + z2 / (4 * labels)) / labels) / (1 + z2 / labels)
    low = F.when(correct == 0, F.lit(0.0)).otherwise(centre - half)
    return low, F.when(correct == labels, F.lit(1.0)).otherwise(centre + half)


def rollup(compared: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Accuracy of compared labels for every combination of the columns ``by``, each of
    them and all of them left open ('*'), and for each level and all levels.

    ``labels`` counted, ``answered`` with a response, ``correct``, their share and its
    interval; an empty table gives no rows. One aggregate over grouping sets, combined before
    its shuffle: levels are columns until then, so a label is expanded once per set only.
    """
    sums = [F.count_if(F.col(f"same_{level}")).alias(f"_{level}") for level in LEVELS]
    totals = compared.cube(*by).agg(
        *[F.grouping(c).alias(f"_all_{c}") for c in by],
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("quality").isNotNull()).alias("_ok"), *sums,
    ).where(F.col("_n") > 0)
    several = F.lit(len(LEVELS))

    def line(level: str, correct: Column, times: Column) -> Column:
        return F.struct(
            F.lit(level).alias("level"), (F.col("_n") * times).alias("labels"),
            (F.col("_ok") * times).alias("answered"), correct.alias("correct"),
        )

    every = F.col(f"_{LEVELS[0]}")
    for level in LEVELS[1:]:
        every = every + F.col(f"_{level}")
    lines = [line(level, F.col(f"_{level}"), F.lit(1)) for level in LEVELS] + [line("*", every, several)]
    shown = [F.when(F.col(f"_all_{c}") == 1, F.lit("*")).otherwise(F.col(c).cast("string")).alias(c) for c in by]
    rows = totals.select(*shown, F.inline(F.array(*lines)))
    low, high = _interval(F.col("correct"), F.col("labels"))
    return rows.select(
        "*", F.round(F.col("correct").cast("double") / F.col("labels"), 4).alias("accuracy"),
        F.round(low, 4).alias("low"), F.round(high, 4).alias("high"),
    )


def nested(compared: DataFrame, source: str) -> DataFrame:
    """S12 record shape: source, raw_address, quality, comparison."""
    return compared.select(
        F.lit(source).alias("source"),
        "raw_address",
        "quality",
        F.struct(
            *[f"actual_{level}" for level in LEVELS], *[f"same_{level}" for level in LEVELS]
        ).alias("comparison"),
    )
