"""Corpus pipeline: documents in, encoded training text out, one written table per stage.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns
the columns of ``documents``; the last one returns piece ids and the text they decode to.
Texts that change get a new ``n_chars``; further columns pass through untouched, but a column
``ids`` is replaced by the piece ids of the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alamatika.llm import decontaminate, pieces, pii, simhash, toxicity
from alamatika.llm.queries import labels, table
from alamatika.plans.gazetteer import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _requests(docs: DataFrame) -> DataFrame:
    """Documents as requests whose id carries all other columns along."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest).alias("address_id"), F.col("text").alias("raw_input"))


def _documents(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests as documents with the columns of ``docs``."""
    return requests.select(*[
        F.col("raw_input").alias("text") if c == "text" else F.col(f"address_id.`{c}`").alias(c)
        for c in docs.columns
    ])


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn(
        "n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind))
    ).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    requests = docs.select(F.col("doc_id").alias("address_id"), F.col("text").alias("raw_input"))
    model = toxicity.train(requests, labels(spark, sf_dir, 3, 1))
    return toxicity.drop_toxic(docs, model, "text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_copies(docs, "doc_id", "text")


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tests = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("label_id"), F.col("text").alias("address_raw")
    )
    return _counted(decontaminate.remove_leaks(docs, tests, "text"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.find_entities(_requests(docs))
    # A null text has no spans and stays null.
    masked = F.when(F.size("spans") > 0, pii.masked(F.col("raw_input"), F.col("spans")))
    return _counted(_documents(docs, found.select(
        "address_id", F.coalesce(masked, F.col("raw_input")).alias("raw_input")
    )))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    back = pieces.decode_requests(pieces.encode_requests(_requests(docs)))
    return back.select(
        *[F.col(f"address_id.`{c}`").alias(c) for c in docs.columns if c not in ("text", "ids")],
        "ids", F.col("raw_input").alias("text"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", remove_benchmark),
    ("personal_data", mask_personal_data),
    ("sentencepiece", encode_pieces),
]
ORACLE_SQL = None  # a trained model, fuzzy links and a bootstrap are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
