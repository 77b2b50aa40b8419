"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Words and runs of signs, in their own case, are hashed one by one and in pairs into
``BUCKETS`` buckets. The model learns by FTRL-proximal updates, one whole text at a time, on
the driver, from at most ``MAX_TRAINING`` labelled rows (a written table of bucket numbers,
streamed through the driver in one order in every epoch); a text's score is the sparse dot
product of its bucket shares with the weights.

Cases: a null or blank text has no n-gram and gets the score of the bias alone; null
labels are left out; repeated label rows count once, as the greater; without labels every
score is 0.5; repeated rows are scored one by one; an empty table stays empty; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alamatika.plans.gazetteer import written

BUCKETS = 1 << 18
MAX_TRAINING = 8_000  # labelled rows, chosen by a hash of the id
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-3, 1e-3
GOOD_FROM = 0.3
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+")


def shares(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and weights of a text: damped counts, scaled to length one."""
    tokens = _TOKEN.findall(text or "")
    if not tokens:
        return np.empty(0, np.int64), np.empty(0, np.float64)
    single = np.fromiter((crc32(t.encode("utf-8", "surrogatepass")) for t in tokens), dtype=np.uint64, count=len(tokens))
    pairs = single[:-1] * np.uint64(0x9E3779B97F4A7C15) + single[1:]
    grams = np.concatenate([single, pairs ^ (pairs >> np.uint64(29))]) % np.uint64(BUCKETS)
    buckets, counts = np.unique(grams.astype(np.int64), return_counts=True)
    weights = 1 + np.log(counts)
    return buckets, weights / np.sqrt((weights**2).sum())


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        buckets, weights = shares(text)
        z = self.bias + float(self.weights[buckets] @ weights)
        return float(1 / (1 + np.exp(-z)))


def train(requests: DataFrame, labels: DataFrame) -> Model:
    """Model from requests (address_id, raw_input) and labels (address_id, quality)."""
    marked = labels.where("quality IS NOT NULL").groupBy("address_id").agg(
        F.max(F.col("quality").cast("int")).alias("good")
    )
    chosen = marked.orderBy(F.xxhash64("address_id"), "address_id").limit(MAX_TRAINING)
    # The chosen ids are bounded, so texts need not be shuffled to meet them.
    rows = requests.select("address_id", "raw_input").join(F.broadcast(chosen), "address_id").select("good", "raw_input")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for good, text in zip(part.column("good").to_pylist(), part.column("raw_input")):
                buckets, weights = shares(text.as_py())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([good], pa.int32()),
                        pa.array([buckets.astype("<i4").tobytes()], pa.binary()),
                        pa.array([weights.astype("<f4").tobytes()], pa.binary()),
                    ],
                    ["good", "buckets", "weights"],
                )

    shaped = written(rows.mapInArrow(run, "good int, buckets binary, weights binary"), "shares")
    of_kind = {r["good"]: r["count"] for r in shaped.groupBy("good").count().collect()}
    # Both kinds weigh the same in all.
    cost = {good: sum(of_kind.values()) / (2 * n) for good, n in of_kind.items()}
    # One order, however Spark dealt the rows; the driver holds one partition at a time.
    ordered = shaped.orderBy(F.crc32("buckets"), "good", F.crc32("weights"))
    learner = Ftrl()
    for _ in range(EPOCHS):
        for r in ordered.toLocalIterator():
            buckets, weights = np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["weights"], "<f4")
            learner.learn(r["good"], buckets, weights, cost[r["good"]])
    return learner.model()


class Ftrl:
    """FTRL-proximal state: sums of gradients ``z`` and of their squares ``n`` per weight."""

    def __init__(self) -> None:
        self.z = np.zeros(BUCKETS + 1)  # the last one is the bias
        self.n = np.zeros(BUCKETS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.where(np.abs(z) <= L1, 0.0, np.sign(z) * L1 - z)
        return shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, good: int, buckets: np.ndarray, values: np.ndarray, cost: float) -> None:
        at = np.append(buckets, BUCKETS)
        x = np.append(values, 1.0)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = cost * (p - good) * x
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - step * w
        self.n[at] += g * g

    def model(self) -> Model:
        w = self.weights(np.arange(BUCKETS + 1))
        return Model(w[:-1], float(w[-1]))


def score_requests(requests: DataFrame, model: Model) -> DataFrame:
    """(address_id, score): probability of good quality for every whole text."""
    id_type = requests.schema["address_id"].dataType.simpleString()
    kept = requests.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            scores = [kept.value.score(t.as_py()) for t in part.column("raw_input")]
            yield pa.RecordBatch.from_arrays(
                [part.column("address_id"), pa.array(scores, pa.float64())], ["address_id", "score"]
            )

    return requests.select("address_id", "raw_input").mapInArrow(run, f"address_id {id_type}, score double")
