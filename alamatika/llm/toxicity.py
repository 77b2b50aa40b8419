"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic requests are the positives. The unlabelled texts are a sample of all requests,
drawn by a hash of the id, with or without a label row: no label is looked at, so it holds
toxic texts at their own rate. The risk of a linear classifier g with class prior p is

    R = p * E_pos[l(g)] + max(0, E_unl[l(-g)] - p * E_pos[l(-g)])

with the logistic loss l: the mean over unlabelled texts, corrected by what the positives
among them add. Where the corrected part falls below zero its gradient is reversed, so the
model cannot pay for a good fit with a negative risk. The prior is the share of toxic among the
ids with a known label, taken as that of all requests; labels that were not dealt out evenly
need a ``prior`` of their own, and where no label is 0 it is ``PRIOR``.

Features are words that occur in a text at all (lower-case, whole texts), chosen by Spark
from document counts of the training rows: those that positives hold more often than
unlabelled texts, by a signed deviance. A numpy model is trained on the driver from rows
already reduced to their features. The size of the model is stated by parameters of ``train``:
``max_training`` rows of each kind, a vocabulary of the ``max_features`` words of greatest
deviance among those in at least ``min_texts`` positives. The vocabulary is what keeps some
hundred positives from being learnt by heart (see README for what more words do).

Cases: a null or blank text has no word and gets the score of the bias alone; null labels
are no labels; rows without an id are not learnt from; labels are matched by id, repeated label rows count as toxic if one
is; without any positive every score is 0; repeated rows are scored one by one; an empty
table stays empty; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alamatika.llm.batches import text_slices, tidy

MAX_TRAINING = 10_000  # rows of each kind a model is trained on, chosen by a hash of the id
MAX_FEATURES = 2_000  # words of the vocabulary
PRIOR = 0.1  # share of toxic requests where labels cannot tell it
MIN_TEXTS = 3  # positives that must hold a word
STEPS = 400
RATE = 0.3
DECAY = 1e-4
TOXIC_FROM = 0.7
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        weight = self.weights.get
        z = self.bias + sum(weight(w, 0.0) for w in words_of(text))
        return float(1 / (1 + np.exp(-z)))


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _word_sets(requests: DataFrame) -> DataFrame:
    """(address_id, words): distinct words of each text."""
    id_type = requests.schema["address_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(parts, 1):
            words = [sorted(words_of(t.as_py())) for t in part.column("raw_input")]
            yield pa.RecordBatch.from_arrays(
                [part.column("address_id"), pa.array(words, pa.list_(pa.string()))],
                ["address_id", "words"],
            )

    return requests.select("address_id", "raw_input").mapInArrow(
        tidy(run), f"address_id {id_type}, words array<string>"
    )


def _numbered(sets: DataFrame, names: list[str]) -> list[tuple[int, np.ndarray]]:
    """(positive, numbers of the named words that occur) of each row."""
    number = {w: k for k, w in enumerate(names)}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [
                np.array([number[w] for w in words if w in number], dtype="<i4").tobytes()
                for words in part.column("words").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column("positive"), pa.array(found, pa.binary())], ["positive", "found"]
            )

    rows = sets.mapInArrow(tidy(run), "positive int, found binary").toLocalIterator()
    return [(r["positive"], np.frombuffer(r["found"], "<i4")) for r in rows]


def _bounded(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, the first by a hash of their id."""
    return rows.orderBy(F.xxhash64("address_id"), "address_id").limit(most)


def class_prior(labels: DataFrame) -> float:
    """Share of toxic among the ids with a known label; ``PRIOR`` if none is known to be not."""
    known = labels.where("toxic IS NOT NULL").groupBy("address_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    return share if share is not None and share < 1 else PRIOR


def train(
    requests: DataFrame,
    labels: DataFrame,
    prior: float | None = None,
    *,
    max_training: int = MAX_TRAINING,
    max_features: int = MAX_FEATURES,
    min_texts: int = MIN_TEXTS,
) -> Model:
    """Model from requests (address_id, raw_input) and labels (address_id, toxic).

    The training set is bounded: up to ``max_training`` labelled-toxic ids, and as many of all
    ids as the unlabelled sample, confirmed ones at the rate at which they come.
    """
    positive = labels.where(F.col("toxic").cast("int") == 1).select("address_id").distinct()
    ids = requests.where("address_id IS NOT NULL").select("address_id").distinct()
    chosen = _bounded(positive, max_training).withColumn("positive", F.lit(1)).unionByName(
        _bounded(ids, max_training).withColumn("positive", F.lit(0))
    )
    # The chosen ids are bounded, so texts need not be shuffled to meet them.
    rows = requests.select("address_id", "raw_input").join(F.broadcast(chosen), "address_id")
    sets = _word_sets(rows.select(F.struct("address_id", "positive").alias("address_id"), "raw_input"))
    sets = sets.select("address_id.positive", "words").persist()
    try:
        return _train(sets, class_prior(labels) if prior is None else prior, max_features, min_texts)
    finally:
        sets.unpersist()


def _train(sets: DataFrame, prior: float, max_features: int, min_texts: int) -> Model:
    totals = {r["positive"]: r["n"] for r in sets.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    n_pos, n_unl = totals.get(1, 0), totals.get(0, 0)
    if not n_pos:
        return Model({}, -np.inf)
    counts = sets.select("positive", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("positive").alias("pos"), F.sum(1 - F.col("positive")).alias("n")
    ).where(F.col("pos") >= min(min_texts, n_pos))
    rate = (F.col("pos") + 0.5) / F.lit(n_pos + 1.0)
    base = (F.col("n") + 0.5) / F.lit(n_unl + 1.0)
    chosen = counts.select(
        "word", (F.col("pos") * F.log(rate / base)).alias("gain"), F.log(rate / base).alias("lift")
    ).where("lift > 0").orderBy(F.desc("gain"), "word").limit(max_features)
    names = [r["word"] for r in chosen.collect()]
    rows = _numbered(sets, names)
    rows.sort(key=lambda r: (r[0], r[1].tobytes()))  # one order, however Spark dealt the rows
    weights, bias = fit([x for p, x in rows if p], [x for p, x in rows if not p], len(names), prior)
    return Model({w: float(x) for w, x in zip(names, weights) if x}, float(bias))


def fit(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], width: int, prior: float
) -> tuple[np.ndarray, float]:
    """Weights and bias that lower the non-negative risk, by Adam over whole batches.

    Rows are arrays of the features they have; ``width`` is the number of features.
    """
    theta = np.zeros(width + 1)
    theta[-1] = np.log(prior / (1 - prior)) if prior < 1 else 5.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)

    def sparse(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        return np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int64), owner, len(rows)

    positive, unlabelled = sparse(positive), sparse(unlabelled)

    def part(rows: tuple[np.ndarray, np.ndarray, int], sign: float) -> tuple[float, np.ndarray]:
        """Mean loss for a wanted sign, and its gradient."""
        features, owner, n = rows
        z = sign * (np.bincount(owner, theta[features], minlength=n) + theta[-1])
        slope = -sign / (1 + np.exp(np.clip(z, -60, 60)))
        down = np.bincount(features, slope[owner], minlength=width)
        return float(np.logaddexp(0, -z).mean()), np.append(down, slope.sum()) / n

    for step in range(1, STEPS + 1):
        _, up = part(positive, 1.0)
        pos_as_neg, back = part(positive, -1.0)
        unl_as_neg, down = part(unlabelled, -1.0)
        rest = unl_as_neg - prior * pos_as_neg
        gradient = prior * back - down if rest < 0 else prior * up + down - prior * back
        gradient = gradient + DECAY * np.append(theta[:-1], 0)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def score_requests(requests: DataFrame, model: Model) -> DataFrame:
    """(address_id, score): probability of toxic for every whole text."""
    id_type = requests.schema["address_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            scores = [model.score(t.as_py()) for t in part.column("raw_input")]
            yield pa.RecordBatch.from_arrays(
                [part.column("address_id"), pa.array(scores, pa.float64())], ["address_id", "score"]
            )

    return requests.select("address_id", "raw_input").mapInArrow(tidy(run), f"address_id {id_type}, score double")


def drop_toxic(rows: DataFrame, model: Model, text_column: str = "raw_input") -> DataFrame:
    """The rows, with all their columns, whose text scores below ``TOXIC_FROM``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(part.schema.get_field_index(text_column))
            yield part.filter(pa.array([model.score(t.as_py()) < TOXIC_FROM for t in texts], pa.bool_()))

    return rows.mapInArrow(tidy(run), rows.schema)
