"""Shards of address requests in random order, by a two-pass external shuffle.

Pass one scatters requests (address_id, raw_input) uniformly into buckets that fit in a
task's memory, by a seeded hash of the whole row. Pass two brings each bucket into a fixed
order, shuffles it by Fisher and Yates with draws from the seed and the bucket's number,
and writes it. The buckets one after another are the shuffled table; it is cut into shards
of equal row counts (they differ by one at most), and each shard is written as a folder.

Skew: copies of a text have different ids and are scattered like all rows. Rows that
repeat in full are told apart by their run number within a task, so they are spread too.
Everything a lost task makes again is the same again: places depend on the rows, not on
the order in which they arrive. Same seed and rows, same shards (of rows that repeat in
full, copies beyond the first of a task may change places with the file layout).

Cost: one exchange of the texts and two writes, as bucket sizes must be known before the
first row can be given its shard. Buckets are ``bucket_bytes`` on average: raise it with
the memory of a task, since each bucket is one shuffle partition.

Cases: null ids and texts stay as they are and have their places; long texts make their
bucket larger by themselves only; fewer rows than shards leave shards empty; an empty table
gives an empty table; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from alamatika.llm.batches import text_slices
from alamatika.plans.gazetteer import new_folder, written

BUCKET_BYTES = 64 << 20
ROW_BYTES = 16  # of a row besides its text
GROUP = 1024  # buckets whose offsets are summed together
MOST_OFFSETS = 1_000_000  # buckets up to which their offsets are broadcast (some 40 MB)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the row hash in column 0, sorted, by a place; repeats get places of their own."""
    task = np.uint64(TaskContext.get().partitionId() + 1)
    last, run = None, 0
    for part in parts:
        if not part.num_rows:
            continue
        keys = part.column(0).to_numpy().astype(np.int64).view(np.uint64)
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        new[0] = last is None or keys[0] != last
        # A run that began in the batch before goes on counting.
        begun = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0 if new[0] else -run))
        number = (np.arange(len(keys)) - begun).astype(np.uint64)
        salt = np.where(number > 0, _mix(number * np.uint64(0x9E3779B97F4A7C15) + task), np.uint64(0))
        last, run = keys[-1], int(number[-1]) + 1
        place = pa.array(_mix(keys ^ salt).view(np.int64))
        yield pa.RecordBatch.from_arrays([place, *part.columns[1:]], schema=part.schema)


def fisher_yates(count: int, seed: int, bucket: int) -> np.ndarray:
    """A random order of 0..count-1, fixed by seed and bucket."""
    order = np.arange(count)
    draws = np.random.Generator(np.random.PCG64([seed, bucket])).random(count)
    for left in range(count - 1, 0, -1):
        other = int(draws[left] * (left + 1))
        order[left], order[other] = order[other], order[left]
    return order


def _shuffled(seed: int):
    """Batches sorted by (bucket, place) to shuffled buckets; ``place`` becomes the new place."""

    def shuffle(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        order = fisher_yates(table.num_rows, seed, table.column(0)[0].as_py())
        table = table.set_column(1, "place", pa.array(np.arange(table.num_rows)))
        for column in (2, 3):
            table = table.set_column(column, table.schema[column].name, table.column(column).take(pa.array(order)))
        yield from text_slices(iter(table.to_batches()), 3)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for part in parts:
            begin, buckets = 0, part.column(0).to_numpy()
            while begin < part.num_rows:
                end = int(np.searchsorted(buckets, buckets[begin], side="right"))
                if held and held[0].column(0)[0].as_py() != buckets[begin]:
                    yield from shuffle(held)
                    held = []
                held.append(part.slice(begin, end - begin))
                begin = end
        if held:
            yield from shuffle(held)

    return run


def count_buckets(requests: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets of ``bucket_bytes`` on average."""
    size = F.sum(F.coalesce(F.octet_length("raw_input"), F.lit(0)).cast("long") + ROW_BYTES)
    total = requests.agg(F.coalesce(size, F.lit(0)).alias("n")).first()["n"]
    return max(1, -(-total // bucket_bytes))


def shuffle_buckets(requests: DataFrame, seed: int, buckets: int) -> DataFrame:
    """Both passes: (bucket, place, address_id, raw_input), shuffled inside each bucket."""
    rows = requests.select(
        F.xxhash64(F.lit(seed), F.col("address_id"), F.col("raw_input")).alias("place"),
        "address_id", "raw_input",
    )
    placed = rows.sortWithinPartitions("place").mapInArrow(_places, rows.schema)
    scattered = placed.select(
        F.pmod(F.shiftrightunsigned("place", 1), F.lit(buckets)).cast("int").alias("bucket"), "*"
    ).repartitionById(buckets, F.col("bucket"))
    ordered = scattered.sortWithinPartitions("bucket", "place", "address_id", "raw_input")
    return ordered.mapInArrow(_shuffled(seed), ordered.schema)


def shard_requests(
    requests: DataFrame, shards: int, seed: int = 1, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Shuffled shards, written to a new folder of the shared one with a sub-folder for each
    ``shard``: (address_id, raw_input, shard from 0, slot from 0 without gaps).
    """
    spark = requests.sparkSession
    buckets = count_buckets(requests, bucket_bytes)
    shuffled = written(shuffle_buckets(requests, seed, buckets), "buckets")
    counts = shuffled.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "*", F.expr(f"bucket div {GROUP}").alias("part")
    )
    before = W.rowsBetween(W.unboundedPreceding, -1)
    parts = counts.groupBy("part").agg(F.sum("n").alias("m")).select(
        "part", F.coalesce(F.sum("m").over(before.orderBy("part")), F.lit(0)).alias("ahead"))
    own = F.coalesce(F.sum("n").over(before.partitionBy("part").orderBy("bucket")), F.lit(0))
    offsets = counts.select("bucket", "part", own.alias("own")).join(parts, "part").select(
        "bucket", (F.col("own") + F.col("ahead")).alias("offset"))
    if buckets <= MOST_OFFSETS:  # one row a bucket, so the texts need no second exchange
        offsets = F.broadcast(offsets)
    rows = shuffled.count()
    low, more = divmod(rows, shards)  # the first ``more`` shards hold one row more
    at, long_ = F.col("at"), more * (low + 1)
    shard = F.when(at < long_, F.expr(f"at div {low + 1}")).otherwise(
        F.expr(f"{more} + (at - {long_}) div {max(low, 1)}"))
    start = F.least(F.col("shard"), F.lit(more)) + F.col("shard").cast("long") * low
    placed = (
        shuffled.join(offsets, "bucket")
        .select("address_id", "raw_input", (F.col("offset") + F.col("place")).alias("at"))
        .select("*", shard.cast("int").alias("shard"))
        .select("address_id", "raw_input", (at - start).alias("slot"), "shard")
    )
    folder = f"{new_folder(spark)}/shards"
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    return spark.read.schema(placed.schema).parquet(folder)
