"""Texts of one key joined in order and hashed, without holding a key's rows anywhere.

Rows are dealt by ranges of (key, order), so a key of many rows is spread over tasks; each
task joins its stretch into pieces of bounded size. Only the pieces meet by key, sorted,
and are fed to the hash one after another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

PIECE_CHARS = 1 << 18  # a piece ends with the row that reaches this
BATCH_ROWS = 4096


def _runs(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, order, text) of sorted batches, one by one."""
    for part in parts:
        yield from zip(*(column.to_pylist() for column in part.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if len(held) >= BATCH_ROWS or size >= PIECE_CHARS:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema
            )
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema
        )


def _pieces(rows: Iterator[tuple], sep: str) -> Iterator[tuple]:
    key, first, held, size = None, None, [], 0
    for k, order, text in rows:
        if held and (k != key or size >= PIECE_CHARS):
            yield key, first, sep.join(held)
            held, size = [], 0
        if not held:
            key, first = k, order
        held.append(text)
        size += len(text) + len(sep)
    if held:
        yield key, first, sep.join(held)


def _digests(rows: Iterator[tuple], sep: str) -> Iterator[tuple]:
    key, digest = None, None
    for k, _, text in rows:
        if digest is None or k != key:
            if digest is not None:
                yield key, digest.hexdigest()
            key, digest = k, hashlib.sha256()
        else:
            digest.update(sep.encode())
        digest.update(text.encode())
    if digest is not None:
        yield key, digest.hexdigest()


def _texts(rows: Iterator[tuple], sep: str) -> Iterator[tuple]:
    key, held = None, []
    for k, _, text in rows:
        if held and k != key:
            yield key, sep.join(held)
            held = []
        key = k
        held.append(text)
    if held:
        yield key, sep.join(held)


def _joined(rows: DataFrame, key: str, order: str, text: str, sep: str, last, out: str) -> DataFrame:
    rows = rows.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(text).alias("text"))
    pieces_schema = to_arrow_schema(rows.schema)
    out_type = f"`{key}` {rows.schema['key'].dataType.simpleString()}, `{out}` string"
    out_schema = pa.schema([(key, pieces_schema.types[0]), (out, pa.string())])

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_pieces(_runs(parts), sep), pieces_schema)

    def finish(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(last(_runs(parts), sep), out_schema)

    pieces = rows.repartitionByRange("key", "order").sortWithinPartitions("key", "order").mapInArrow(
        cut, rows.schema
    )
    return pieces.repartition("key").sortWithinPartitions("key", "order").mapInArrow(finish, out_type)


def ordered_sha256(rows: DataFrame, key: str, order: str, text: str, sep: str = ",") -> DataFrame:
    """(key, ``sha256``): hash of the texts of each key, joined by ``sep`` in ``order``.

    Texts must not be null; equal orders of one key must have equal texts. A null key is a
    key. Keys without rows are not in the result.
    """
    return _joined(rows, key, order, text, sep, _digests, "sha256")


def ordered_text(rows: DataFrame, key: str, order: str, text: str, sep: str = "") -> DataFrame:
    """(key, ``joined``): the texts themselves, where one row is to hold them."""
    return _joined(rows, key, order, text, sep, _texts, "joined")


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def sha256_or_empty(column: str = "sha256"):
    return F.coalesce(F.col(column), F.lit(EMPTY_SHA256))
