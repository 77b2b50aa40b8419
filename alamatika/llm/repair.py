"""Repair of the structure of conversations by the cheapest edits, with block tables.

The project has no dialogue records, so the operator is general: turns are rows
(conv_id, turn, role, text). A repaired conversation is empty or holds at most one leading
system turn and then pairs of user and assistant turns.

Edits and costs: Keep (0), Rerole to user or assistant (3), Delete (4; the only edit of a
blank or repeated row), Insert an empty user or assistant turn anywhere (3). A truncated
row that is not deleted costs 3 more. Of equally cheap repairs the one whose edit letters
(D, I, K, R) come first in ASCII order is taken.

Method (Four Russians): the cheapest cost to finish, from each of four states (nothing yet,
after system, after user, after assistant), is a vector; less its minimum it is one of a
small fixed set, since any state reaches what another can within a bounded cost. For every
such vector and every block of ``BLOCK`` symbols the vector before the block is computed
once. A conversation is read from its end, block by block, by lookup; then each block is
expanded backward from the vector behind it, and the edits are chosen from the front:
the first letter in order that still reaches the least cost is always right, so ties are
decided exactly.

Cases: null roles and texts count as one space; a null conv_id is a conversation of its
own; null turns come first, equal turns are ordered by role, then text; repeated rows are
duplicates. Rows are streamed in order; a task holds one byte and one vector number a
block for the conversation it reads, never its texts. An empty table gives empty results;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from alamatika.plans.gazetteer import written

SPACES = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
LEGAL_PAIRS = ("su", "ua", "au")
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
BLOCK = 4
SYMBOLS = 10  # 0: must go; 1..8: initial (s, u, a, other) and whether truncated; 9: padding
PAD = 9

# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
NEXT = (2, 2, 3, 2)  # where a new user or assistant turn leads from each state
KEPT = ((1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1), (-1, -1, -1, -1))  # by initial, state
ROLES = {2: "user", 3: "assistant"}


def mark_faults(turns: DataFrame) -> DataFrame:
    """Adds ``pos`` (order in the conversation from 1), ``fault`` (blank, duplicate, truncated
    or null: the first that holds) and ``illegal`` (the step from the row before is not
    allowed); null roles and texts become one space.
    """
    rows = turns.select(
        "conv_id", "turn",
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    in_order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.lag(initial).over(in_order), initial)
    rows = rows.select(
        "*", F.row_number().over(in_order).alias("pos"),
        F.coalesce(~pair.isin(*LEGAL_PAIRS), F.lit(False)).alias("illegal"),
    )
    same = W.partitionBy("conv_id", "role", "text").orderBy("pos")
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = (
        F.when(body == "", F.lit("blank"))
        .when(F.row_number().over(same) > 1, F.lit("duplicate"))
        .when(~F.right(body, F.lit(1)).isin(*ENDS), F.lit("truncated"))
    )
    return rows.select("*", fault.alias("fault"))


def _symbol() -> Column:
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    cut = F.when(F.col("fault") == "truncated", 1).otherwise(0)
    return F.when(F.col("fault").isin("blank", "duplicate"), 0).otherwise(1 + 2 * kind + cut)


def _closed(cost: np.ndarray) -> np.ndarray:
    """Inserting before the rest: at most three turns lead anywhere they can."""
    for _ in range(3):
        cost = np.minimum(cost, INSERT + cost[list(NEXT)])
    return cost


def _before(cost: np.ndarray, symbol: int) -> np.ndarray:
    """Cheapest costs before a row, from those after it."""
    out = cost + DELETE
    if symbol:
        kind, cut = divmod(symbol - 1, 2)
        extra = TRUNCATED * cut
        for state in range(4):
            out[state] = min(out[state], REROLE + extra + cost[NEXT[state]])
            if KEPT[kind][state] >= 0:
                out[state] = min(out[state], extra + cost[KEPT[kind][state]])
    return _closed(out)


class Tables:
    """Normalised vectors, what each symbol and each block makes of them, and the moves."""

    def __init__(self, block: int = BLOCK):
        far = 99
        end = _closed(np.array([0, far, far, 0]))
        self.last = 0
        vectors, number = [end - end.min()], {tuple(end - end.min()): 0}
        to, gain = [], []
        for vector in vectors:  # grows while new vectors are found
            row, more = [], []
            for symbol in range(PAD):
                cost = _before(vector, symbol)
                key = tuple(cost - cost.min())
                if key not in number:
                    number[key] = len(vectors)
                    vectors.append(cost - cost.min())
                row.append(number[key])
                more.append(int(cost.min()))
            to.append(row + [number[tuple(vector)]])
            gain.append(more + [0])
        self.vectors = np.array(vectors)
        self.to, self.gain = np.array(to, np.int32), np.array(gain, np.int32)
        # A block's rightmost symbol acts first.
        self.block = block
        digits = np.indices((SYMBOLS,) * block).reshape(block, -1)
        self.block_to = np.repeat(np.arange(len(vectors), dtype=np.int32)[:, None], SYMBOLS**block, 1)
        self.block_gain = np.zeros_like(self.block_to)
        for place in reversed(range(block)):
            self.block_gain += self.gain[self.block_to, digits[place]]
            self.block_to = self.to[self.block_to, digits[place]]
        self.weights = SYMBOLS ** np.arange(block)[::-1]
        self.moves = {
            (v, s, q): self._move(v, s, q)
            for v in range(len(vectors)) for s in range(PAD) for q in range(4)
        }

    def _move(self, after: int, symbol: int, state: int) -> tuple[tuple, int]:
        """Edits from a state up to and with the row, and the state behind it."""
        right = self.vectors[after]
        left = self.vectors[self.to[after, symbol]] + self.gain[after, symbol]
        edits = []
        while True:
            least = left[state]
            if DELETE + right[state] == least:
                return tuple(edits + [("D", None, DELETE)]), state
            if INSERT + left[NEXT[state]] == least:
                state = NEXT[state]
                edits.append(("I", ROLES[state], INSERT))
                continue
            kind, cut = divmod(symbol - 1, 2)
            extra = TRUNCATED * cut
            if KEPT[kind][state] >= 0 and extra + right[KEPT[kind][state]] == least:
                return tuple(edits + [("K", None, extra)]), KEPT[kind][state]
            state = NEXT[state]
            return tuple(edits + [("R", ROLES[state], REROLE + extra)]), state

    def least_cost(self, symbols: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """(least cost, padded symbols, number of the vector behind each block)."""
        padded = np.full(-(-len(symbols) // self.block) * self.block, PAD, np.uint8)
        padded[len(padded) - len(symbols) :] = symbols
        codes = padded.reshape(-1, self.block).astype(np.int64) @ self.weights
        behind = np.empty(len(codes), np.int32)
        vector, cost = self.last, 0
        for i in range(len(codes) - 1, -1, -1):
            behind[i] = vector
            cost += int(self.block_gain[vector, codes[i]])
            vector = self.block_to[vector, codes[i]]
        return cost + int(self.vectors[vector][0]), padded, behind

    def edits(self, symbols: np.ndarray) -> Iterator[tuple]:
        """(letter, row from 1 or None, new role or None, cost) of the chosen repair, in order."""
        _, padded, behind = self.least_cost(symbols)
        row, state = 0, 0
        for i, vector in enumerate(behind):
            block = padded[i * self.block : (i + 1) * self.block]
            after = [int(vector)]  # expanded from the right end of the block
            for symbol in block[:0:-1]:
                after.append(int(self.to[after[-1], symbol]))
            for symbol, v in zip(block, reversed(after)):
                if symbol == PAD:
                    continue
                row += 1
                done, state = self.moves[v, int(symbol), state]
                for letter, role, cost in done:
                    yield letter, None if letter == "I" else row, role, cost
        while state in (1, 2):
            state = NEXT[state]
            yield "I", None, ROLES[state], INSERT


@lru_cache(1)
def tables() -> Tables:
    return Tables()


EDITS = "step bigint, edit string, pos int, new_role string, cost bigint"


def plan_edits(marked: DataFrame) -> DataFrame:
    """The cheapest edits of every conversation, one row each: ``conv_id, step`` (from 1),
    ``edit`` (D, I, K, R), ``pos`` of the row it acts on (null: inserted), ``new_role``, ``cost``.
    """
    rows = marked.select("conv_id", "pos", _symbol().cast("tinyint").alias("symbol"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {EDITS}"
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def repair(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tables()

        def conversations() -> Iterator[tuple]:
            key, held = None, bytearray()
            for part in parts:
                symbols = part.column(2).to_numpy().astype(np.uint8)
                ids = part.column(0).to_pylist()
                begin = 0
                for end in range(1, len(ids) + 1):
                    if end < len(ids) and ids[end] == ids[begin]:
                        continue
                    if held and ids[begin] != key:
                        yield key, held
                        held = bytearray()
                    key = ids[begin]
                    held += symbols[begin:end].tobytes()
                    begin = end
            if held:
                yield key, held

        def batch(held: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*held), arrow.types)], schema=arrow
            )

        out: list = []
        for key, held in conversations():
            for step, edit in enumerate(known.edits(np.frombuffer(held, np.uint8)), 1):
                out.append((key, step, *edit))
                if len(out) >= 8192:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(repair, schema)


def apply_edits(marked: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, step, role, text), inserted texts empty."""
    new = edits.where(F.col("edit") == "I").select(
        "conv_id", "step", F.col("new_role").alias("role"), F.lit("").alias("text")
    )
    left = edits.where(F.col("edit").isin("K", "R")).select(
        F.col("conv_id").alias("_conv"), "step", F.col("pos").alias("_pos"), "new_role"
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("pos") == F.col("_pos"))
    kept = left.join(marked.select("conv_id", "pos", "role", "text"), same).select(
        "conv_id", "step", F.coalesce("new_role", "role").alias("role"), "text"
    )
    return kept.unionByName(new)


def count_faults(marked: DataFrame) -> DataFrame:
    """Per conversation: rows by first fault, illegal steps, and gaps in its turn numbers."""
    turns = marked.groupBy("conv_id", "turn").agg(
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.count_if("illegal").alias("illegal"),
    )
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return turns.groupBy("conv_id").agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated", "illegal")],
    )


def repair_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(marked rows, edits, repaired rows); the first two are written once, as each is
    read more than once.
    """
    marked = written(mark_faults(turns), "marked")
    edits = written(plan_edits(marked), "edits")
    return marked, edits, apply_edits(marked, edits)
