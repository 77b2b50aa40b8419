"""Near-duplicate requests by SimHash, linked through one-wildcard segment variants.

Two 64-bit fingerprints within three bits agree in one of their two 32-bit segments up to
one bit. Every segment is therefore indexed once as it is and 32 times with one bit left
out; fingerprints that share such a key are joined on equality and verified. A pair that
differs in the wildcard bit meets under that wildcard, an equal segment under its plain
key, so each pair meets once or twice instead of 32 times.

Only distinct fingerprints are indexed: copies of a text are one row of the index, however
many there are. Keys of two fingerprints are verified as a pair by Spark expressions. Keys
of more are verified block by block inside one task and leave a spanning forest of their
links, never all pairs. A key of more than ``MAX_GROUP`` fingerprints is first cut by
further segments of the bits that are still free, again so that a link within three bits
must share one; each cut shares more bits, so groups end below the bound by themselves and
no link is lost.

Cases: a null or blank text has fingerprint zero and is linked like any other; a null id
is never a component's name unless nothing else is in it; repeated rows each get a row;
an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alamatika.llm.batches import text_slices, tidy
from alamatika.operators.bounded import broadcast_if_small
from alamatika.plans.gazetteer import written

SEED = 42
SHINGLE = 3
MAX_BITS = 3
MAX_GROUP = 4096  # distinct fingerprints verified together in one task
SMALL_KEYS = 16 << 20  # measured bytes up to which shared keys are broadcast
TASK_ROWS = 1 << 15  # distinct fingerprints keyed in one task
LANE_ROWS = 255  # hashes added up in eight-bit lanes before they are widened

_BYTE_LANES = np.unpackbits(
    np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little"
).view(np.uint64).ravel()
_BIT_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def shingle_hashes(text: str | None) -> list[int]:
    """XXH64 of each word shingle of a text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    if len(words) < SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    digest = xxhash.xxh64_intdigest
    return [digest(s, SEED) for s in map(b" ".join, zip(words, words[1:], words[2:]))]


def fingerprints(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Majority bits of consecutive runs of hashes; an empty run gives zero.

    Bits are counted eight at a time: a table spreads each byte over eight lanes of a
    64-bit word, and at most ``LANE_ROWS`` words are added before the lanes are widened.
    """
    out = np.zeros(len(lengths), dtype=np.uint64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    sizes = lengths[full]
    blocks = -(-sizes // LANE_ROWS)
    owner = np.repeat(np.arange(len(full)), blocks)
    first_block = np.cumsum(blocks) - blocks
    begins = np.cumsum(sizes) - sizes
    at = np.repeat(begins, blocks) + LANE_ROWS * (np.arange(len(owner)) - np.repeat(first_block, blocks))
    octets = np.ascontiguousarray(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    counts = np.empty((len(full), 64), dtype=np.int64)
    for k in range(8):
        lanes = np.add.reduceat(_BYTE_LANES[octets[:, k]], at)
        wide = np.ascontiguousarray(lanes, dtype="<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts[:, 8 * k : 8 * k + 8] = np.add.reduceat(wide, first_block, axis=0)
    out[full] = ((2 * counts > sizes[:, None]) * _BIT_WEIGHTS).sum(axis=1, dtype=np.uint64)
    return out


def fingerprint_requests(requests: DataFrame) -> DataFrame:
    """(address_id, fp): the fingerprint of every whole text as a signed long."""
    id_type = requests.schema["address_id"].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(parts, 1):
            found = [
                np.array(shingle_hashes(text.as_py()), dtype=np.uint64)
                for text in part.column("raw_input")
            ]
            lengths = np.array([len(own) for own in found], dtype=np.int64)
            fp = fingerprints(np.concatenate([*found, np.empty(0, np.uint64)]), lengths)
            yield pa.RecordBatch.from_arrays(
                [part.column("address_id"), pa.array(fp.view(np.int64))], ["address_id", "fp"]
            )

    return requests.select("address_id", "raw_input").mapInArrow(
        tidy(batches), f"address_id {id_type}, fp bigint"
    )


def bits_between(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _variants() -> Column:
    """Keys of a fingerprint: (slot, value, side). Slots 0 and 33 are whole segments, the
    others leave out one bit; ``side`` is that bit.
    """
    keys = []
    for segment in (0, 1):
        value = F.col("fp") if segment == 0 else F.shiftrightunsigned("fp", 32)
        value = value.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
        base = 33 * segment
        keys.append(F.struct(F.lit(base).alias("slot"), value.alias("value"), F.lit(-1).alias("side")))
        for bit in range(32):
            keys.append(F.struct(
                F.lit(base + 1 + bit).alias("slot"),
                value.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit)).cast("long")).alias("value"),
                F.shiftright(value, bit).bitwiseAND(F.lit(1).cast("long")).cast("int").alias("side"),
            ))
    return F.array(*keys)


def _forest(fp: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of a group of at most ``MAX_GROUP``: each member is compared with
    those not reached yet. Sides mark a wildcard key, where only pairs across are wanted.
    """
    rest = np.arange(len(fp))
    left, right = [], []
    while len(rest):
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            close = np.bitwise_count(fp[rest] ^ fp[at]) <= MAX_BITS
            if side[at] >= 0:
                close &= side[rest] != side[at]
            found, rest = rest[close], rest[~close]
            left.append(np.full(len(found), at))
            right.append(found)
            reached += found.tolist()
    left, right = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (left, right))
    return fp[left], fp[right]


def _group_links(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in groups:
        members = batch.column("members")
        fields = members.flatten()
        fp = fields.field("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        side = fields.field("side").to_numpy(zero_copy_only=False)
        ends = np.cumsum(members.value_lengths().to_numpy(zero_copy_only=False))
        found = [_forest(*x) for x in zip(np.split(fp, ends[:-1]), np.split(side, ends[:-1]))] if len(ends) else []
        a, b = (np.concatenate([x[k] for x in found] + [np.empty(0, np.uint64)]) for k in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(a.view(np.int64), b.view(np.int64))),
             pa.array(np.maximum(a.view(np.int64), b.view(np.int64)))], ["a", "b"],
        )


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp`` that connect exactly what pairs
    within ``MAX_BITS`` bits connect.
    """
    # Dealt out by number first: each row becomes 66.
    tasks = max(1, -(-prints.count() // TASK_ROWS))
    prints = prints.repartition(tasks, "fp")
    keyed = prints.select("fp", F.explode(_variants()).alias("k")).select(
        "fp", F.struct("k.slot", "k.value").alias("key"), "k.side"
    )
    found = []
    for depth in range(6):
        sizes = keyed.groupBy("key").agg(
            F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"),
            F.min("side").alias("low"), F.max("side").alias("high"),
        ).where("n > 1 AND (low < 0 OR low < high)")
        sizes = written(sizes, "keys")
        found.append(
            sizes.where("n = 2").select("a", "b").where(bits_between(F.col("a"), F.col("b")) <= MAX_BITS)
        )
        wide = sizes.where("n > 2")
        largest = wide.agg(F.max("n")).first()[0]
        if largest is None:
            break
        members = keyed.join(broadcast_if_small(wide.select("key", "n"), SMALL_KEYS), "key")
        grouped = members.where(F.col("n") <= MAX_GROUP).groupBy("key").agg(
            F.collect_list(F.struct("fp", "side")).alias("members")
        )
        found.append(grouped.select("members").mapInArrow(tidy(_group_links), "a bigint, b bigint"))
        if largest <= MAX_GROUP:
            break
        keyed = written(_cut(members.where(F.col("n") > MAX_GROUP), depth), "wide")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _cut(members: DataFrame, depth: int) -> DataFrame:
    """Key the members of too wide groups by one of four pieces of their free bits.

    Three differing bits cannot touch all four pieces, so linked members share one. The
    free bits are the other segment less the pieces that former cuts have fixed; those are
    listed in the key.
    """
    fixed = F.col("key.fixed") if depth else F.array().cast("array<int>")
    segment = (F.col("key.slot") < 33).cast("int")  # the other segment's number
    free = F.filter(
        F.sequence(F.lit(0), F.lit(31)), lambda b: ~F.array_contains(fixed, b)
    )
    other = F.shiftrightunsigned("fp", 32)
    half = F.when(segment == 1, other).otherwise(F.col("fp"))
    pieces = F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda p: F.filter(free, lambda b, i: i % 4 == p),
    )
    cut = members.select("fp", "side", "key", half.alias("half"), F.explode(pieces).alias("piece"))
    value = F.aggregate(
        "piece", F.lit(0).cast("long"),
        lambda v, b: v * 2 + F.call_function("getbit", F.col("half"), b).cast("long"),
    )
    return cut.select(
        "fp",
        F.struct(
            F.col("key.slot").alias("slot"),
            F.xxhash64("key", "piece", value).alias("value"),
            F.array_sort(F.concat(
                F.col("key.fixed") if depth else F.array().cast("array<int>"), "piece"
            )).alias("fixed"),
        ).alias("key"),
        "side",
    )


def components(edges: DataFrame, smallest: DataFrame) -> DataFrame:
    """(fp, component_id) for fingerprints that have links.

    ``smallest`` holds (fp, first_id). Every round hooks each node to the smallest
    neighbour below it, shortens the chains twice and contracts the edges; a component of
    n nodes is done after about log n rounds, also if it is one long chain. Rounds are cut
    by written tables.
    """
    edges = written(edges, "edges")
    nodes = edges.select(F.col("a").alias("fp")).union(edges.select("b")).distinct()
    tree = written(nodes.select("fp", F.col("fp").alias("root")), "roots")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        up = both.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("up"))
        up = written(up.select("root", F.least("root", "up").alias("up")), "up")
        for _ in range(2):
            next_up = up.select(F.col("root").alias("up"), F.col("up").alias("above"))
            up = written(
                up.join(next_up, "up", "left").select(
                    "root", F.coalesce("above", "up").alias("up")
                ), "up",
            )
        tree = written(
            tree.join(up, "root", "left").select("fp", F.coalesce("up", "root").alias("root")), "roots"
        )
        a = up.select(F.col("root").alias("a"), F.col("up").alias("to_a"))
        b = up.select(F.col("root").alias("b"), F.col("up").alias("to_b"))
        edges = written(
            edges.join(a, "a").join(b, "b").where("to_a <> to_b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
            .distinct(), "edges",
        )
    names = tree.join(smallest, "fp").groupBy("root").agg(F.min("first_id").alias("component_id"))
    return tree.join(names, "root").select("fp", "component_id")


def near_duplicates(requests: DataFrame) -> DataFrame:
    """(address_id, fingerprint, component_id) for every request; see the module."""
    prints = written(fingerprint_requests(requests), "prints")
    smallest = written(
        prints.groupBy("fp").agg(F.min("address_id").alias("first_id")), "smallest"
    )
    linked = components(links(smallest.select("fp")), smallest)
    named = written(
        smallest.join(linked, "fp", "left").select(
            "fp", F.coalesce("component_id", "first_id").alias("component_id")
        ), "named",
    )
    return prints.join(named, "fp", "left").select(
        "address_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_copies(rows: DataFrame, id_column: str = "address_id", text_column: str = "raw_input") -> DataFrame:
    """The rows, with all their columns, that stand for their component: one row each.

    A row is told by its id and its text, so texts that share an id (or have none) are
    decided one by one. The row of the smallest id stays (an id before none, then by the
    text's hash); of rows that repeat in id and text, one.
    """
    number, copy = F.col(id_column), F.xxhash64(F.col(text_column)).alias("copy")
    named = near_duplicates(rows.select(
        F.struct(number.isNull().alias("no_id"), number.alias("id"), copy).alias("address_id"),
        F.col(text_column).alias("raw_input"),
    ))
    met = written(
        named.groupBy("address_id").agg(F.count("*").alias("n"), F.min("component_id").alias("first")), "met"
    )

    def only(keys: DataFrame, kind: str, of: DataFrame) -> DataFrame:
        keys = keys.select(F.col("address_id.id").alias("_id"), F.col("address_id.copy").alias("_copy"))
        same = of[id_column].eqNullSafe(F.col("_id")) & (F.xxhash64(of[text_column]) == F.col("_copy"))
        return of.join(keys, same, kind)

    kept = only(met.where("address_id <> first"), "left_anti", rows)
    repeated = met.where("n > 1 AND address_id = first")
    if repeated.isEmpty():
        return kept
    # Rows that repeat in full are few keys: only they are dealt out to be told apart.
    again = only(repeated, "left_semi", kept).withColumn("_copy_of", F.xxhash64(text_column))
    once = again.dropDuplicates([id_column, "_copy_of"]).drop("_copy_of")
    return only(repeated, "left_anti", kept).unionByName(once)
