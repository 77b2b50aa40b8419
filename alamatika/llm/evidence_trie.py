"""Prefix trie of the evidence of addresses, built by halving the depth.

An address is the sequence of its evidence (``operators.matching.evidence``: address_id,
ev_pos, type, value); addresses that begin with the same evidence share a node. The trie
shows which leading parts are written again and again (a street, a housing estate) and how
many characters one copy of each would save.

Method: positions 0 (the root) to the deepest one are padded to a power of two and halved
again and again. Digests of blocks of evidence are built from the halves upward. Then, from
the whole downward, the prefix above each cut is named by the name of what stands above its
block and the digest of the block's upper half; the upper tries and all lower forests of
one height are one table, so they are worked on at the same time. With every prefix named,
nodes are counted, and the totals of the lower forests are grafted on the nodes of the
upper trie above them, smallest blocks first. A depth of d takes log2(d) rounds, and each
row takes part in one join or aggregate a round.

Skew: names are digests, made without meeting other addresses, so a common beginning costs
no join; counts are combined before their shuffle. A node's parent is looked up among its
nodes; parents of many children are few by count and are broadcast (at most ``HEAVY``
rows), the rest is shuffled. An address of very many rows is spread by (address, block).

Cases: null types and values are empty; null positions come first; equal positions are
ordered by type, then value, and repeated rows stay separate steps. Addresses without
evidence end at the root. Rows with a null address_id belong to no address and are left
out. Repeated addresses count once. No addresses: no nodes. Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alamatika.plans.gazetteer import written

HEAVY = 50_000  # at most so many parents have more than 1/HEAVY of all nodes as children
ROOT = b"root"


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


@dataclass(frozen=True)
class Trie:
    """``nodes``: address_id (the smallest member), depth, parent_address_id, n_addresses,
    n_children, n_leaves, saved_chars, name. ``ends``: (name, address_id) of every address,
    the node its whole evidence leads to.
    """

    nodes: DataFrame
    ends: DataFrame


def _steps(evidence: DataFrame, addresses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols (address_id, block, digest, chars) from position 0, and lengths (address_id, last)."""
    rows = evidence.where(F.col("address_id").isNotNull()).select(
        "address_id", "ev_pos",
        F.coalesce("type", F.lit("")).alias("type"), F.coalesce("value", F.lit("")).alias("value"),
    )
    order = W.partitionBy("address_id").orderBy(F.col("ev_pos").asc_nulls_first(), "type", "value")
    # The length of the type tells where it ends.
    digest = _digest(F.char_length("type").cast("string"), F.lit(":"), F.col("type"), F.col("value"))
    steps = rows.select(
        "address_id", F.row_number().over(order).alias("block"), digest.alias("digest"),
        F.char_length("value").cast("long").alias("chars"),
    )
    known = addresses.select("address_id").where(F.col("address_id").isNotNull())
    roots = known.unionByName(rows.select("address_id")).distinct().select(
        "address_id", F.lit(0).alias("block"), F.lit(ROOT).alias("digest"),
        F.lit(0).cast("long").alias("chars"),
    )
    symbols = written(roots.unionByName(steps), "steps")
    return symbols, symbols.groupBy("address_id").agg(F.max("block").alias("last"))


def _block_digests(symbols: DataFrame, deepest: int) -> dict[int, DataFrame]:
    """Digests of the complete blocks of 1, 2, 4, ... steps, each made from its two halves."""
    blocks = {1: symbols.select("address_id", "block", "digest")}
    size = 2
    while size <= deepest:
        upper = F.max(F.when(F.col("block") % 2 == 0, F.col("digest")))
        lower = F.max(F.when(F.col("block") % 2 == 1, F.col("digest")))
        pairs = blocks[size // 2].groupBy(
            "address_id", F.expr("block div 2").cast("int").alias("block")
        ).agg(upper.alias("upper"), lower.alias("lower")).where(F.col("lower").isNotNull())
        blocks[size] = written(
            pairs.select("address_id", "block", _digest("upper", "lower").alias("digest")), f"blocks{size}"
        )
        size *= 2
    return blocks


def _named(symbols: DataFrame, lengths: DataFrame, deepest: int) -> DataFrame:
    """(address_id, depth, name, chars): the name of every prefix of every address."""
    blocks = _block_digests(symbols, deepest)
    size = 1
    while size <= deepest:
        size *= 2
    above = lengths.select("address_id", F.lit(0).alias("block"), F.lit(ROOT).alias("above"), "last")
    while size > 1:
        size //= 2
        # The upper half keeps the name above; the lower forest hangs under the cut prefix.
        upper = blocks[size].where(F.col("block") % 2 == 0).select(
            "address_id", F.expr("block div 2").cast("int").alias("block"), "digest"
        ) if size in blocks else None
        first = (F.col("block") * 2).alias("block")
        below = (F.col("block") * 2 + 1)
        halves = [above.select("address_id", first, "above", "last")]
        if upper is not None:
            cut = above.where(F.col("last") >= below * size).join(upper, ["address_id", "block"])
            halves.append(cut.select(
                "address_id", below.alias("block"), _digest("above", "digest").alias("above"), "last"
            ))
        above = halves[0] if len(halves) == 1 else written(halves[0].unionByName(halves[1]), f"names{size}")
    return above.join(symbols, ["address_id", "block"]).select(
        "address_id", F.col("block").alias("depth"), _digest("above", "digest").alias("name"), "chars",
        (F.col("block") == F.col("last")).alias("ends"),
    )


def _nodes(path: DataFrame) -> DataFrame:
    """Distinct prefixes with their members, parent and children, and their own totals."""
    met = path.groupBy("name", "depth").agg(
        F.min("address_id").alias("address_id"), F.count(F.lit(1)).alias("n_addresses"),
        F.max("chars").alias("chars"),
    )
    up = path.select("address_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    nodes = written(met.join(up, ["address_id", "depth"], "left"), "prefixes")
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("name")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    return nodes.join(children, "name", "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0).cast("long"))
    ).withColumns({
        "n_leaves": (F.col("n_children") == 0).cast("long"),
        "saved_chars": (F.col("n_addresses") - 1) * F.col("chars"),
    })


TOTALS = ("n_leaves", "saved_chars")


def _graft(nodes: DataFrame, path: DataFrame, deepest: int) -> DataFrame:
    """Add the totals of the lower forests to the nodes above them, block size by block size."""
    half = 1
    while half <= deepest:
        # Roots of lower forests, summed under their cut node; any member leads to its ancestors.
        cut = nodes.where(F.col("depth") % (2 * half) == half).groupBy("parent").agg(
            F.min("address_id").alias("address_id"), F.min("depth").alias("below"),
            *[F.sum(t).alias(t) for t in TOTALS],
        )
        spread = cut.select(
            "address_id", *TOTALS,
            F.explode(F.sequence(F.col("below") - half, F.col("below") - 1)).alias("depth"),
        )
        gained = spread.join(path.select("address_id", "depth", "name"), ["address_id", "depth"]).groupBy(
            "name"
        ).agg(*[F.sum(t).alias(f"more_{t}") for t in TOTALS])
        nodes = nodes.join(gained, "name", "left").withColumns(
            {t: F.col(t) + F.coalesce(f"more_{t}", F.lit(0).cast("long")) for t in TOTALS}
        ).select(*nodes.columns)
        nodes = written(nodes, f"grafted{half}")
        half *= 2
    return nodes


def _with_parents(nodes: DataFrame, heavy: int) -> DataFrame:
    """The parent's smallest member, by a broadcast of the few parents of very many children."""
    total = nodes.count()
    many = total // heavy + 1000  # fewer than ``heavy`` nodes have more children than that
    upper = nodes.where(F.col("n_children") > 0).select(
        F.col("name").alias("parent"), F.col("address_id").alias("parent_address_id"), "n_children"
    )
    big = F.broadcast(upper.where(F.col("n_children") > many).select(
        "parent", F.col("parent_address_id").alias("_big")
    ))
    small = upper.where(F.col("n_children") <= many).drop("n_children")
    rows = nodes.join(big, "parent", "left")
    # What is answered, or has no parent, goes around the shuffle.
    open_ = F.col("_big").isNull() & F.col("parent").isNotNull()
    done = rows.where(~open_).withColumn("parent_address_id", F.col("_big"))
    asked = rows.where(open_).join(small, "parent")
    return done.unionByName(asked.select(*done.columns)).drop("_big")


def build_trie(evidence: DataFrame, addresses: DataFrame, heavy: int = HEAVY) -> Trie:
    """The prefix trie of the evidence of ``addresses`` (address_id) and of all addresses
    that ``evidence`` names.
    """
    symbols, lengths = _steps(evidence, addresses)
    deepest = lengths.agg(F.coalesce(F.max("last"), F.lit(0)).alias("n")).first()["n"]
    path = written(_named(symbols, lengths, deepest), "paths")
    nodes = _with_parents(_graft(written(_nodes(path), "nodes"), path, deepest), heavy)
    return Trie(
        nodes.select(
            "address_id", "depth", "parent_address_id", "n_addresses", "n_children", *TOTALS, "name"
        ),
        path.where("ends").select("name", "address_id"),
    )
