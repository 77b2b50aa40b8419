"""Accuracy replay: validate labelled addresses and compare, as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alamatika.operators import accuracy as A
from alamatika.plans.gazetteer import Gazetteer
from alamatika.plans.validate import RESPONSE, answer
from alamatika.sources import labelled
from alamatika.sources.requests import with_address_ids


def replay(
    labels: DataFrame, gazetteer: Gazetteer, source_code: str = "", keep: tuple[str, ...] = ()
) -> DataFrame:
    """B1 + B2 for every label; ``keep`` names further columns of it that come back.

    Labels travel through the validator beside their text, so they are read once and
    nothing is joined back. Labels that are refused have no result; those that repeat in
    full have a row each. Labels without an address_id get one.
    """
    if "address_id" not in labels.columns:
        labels = with_address_ids(labels)
    code = F.col("source_code") if "source_code" in labels.columns else F.lit(source_code)
    known = ["raw_address", *[f"actual_{level}" for level in A.LEVELS], *keep]
    requests = labels.select(
        "address_id", labelled.replay_text().alias("address"), code.alias("source_code"),
        F.struct("address_id", *known).alias("label"),
    )
    rows = answer(requests, gazetteer, keep=("label",), refused=True)
    # Equal labels were one request: each has its row again.
    rows = rows.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    quality = F.when(~F.col("refused"), F.struct(*[c for c in RESPONSE if c != "address_id"]))
    rows = rows.select("kept.label.*", quality.alias("quality"))
    return A.flagged(rows, keep)
