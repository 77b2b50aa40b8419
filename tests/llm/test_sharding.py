"""Shards by a two-pass shuffle: nothing lost, counts even, order random, layout without effect."""

import zlib
from collections import Counter

import numpy as np

from alamatika.llm import queries as Q
from alamatika.llm import sharding as S


def rows_of(df):
    return [(r["address_id"], r["raw_input"], r["shard"], r["slot"]) for r in df.collect()]


def test_even_whole_and_repeatable(spark):
    rows = [(i, f"text {i % 7} " * (i % 50), i) for i in range(5000)]
    rows += [(9, "same", 0)] * 3000 + [(None, None, 0), (10_001, "", 0), (10_002, "long " * 200_000, 0), (3, "other", 0)]
    df = spark.createDataFrame(rows, "address_id long, raw_input string, slot int").repartition(6, "address_id")
    got = rows_of(S.shard_requests(df, 40, seed=7, bucket_bytes=50_000))
    assert Counter(r[:2] for r in got) == Counter(r[:2] for r in rows)
    per = {}
    for r in got:
        per.setdefault(r[2], []).append(r[3])
    assert set(per) == set(range(40))
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    # The rows that repeat in full are in all shards, like any others.
    same = Counter(r[2] for r in got if r[1] == "same")
    assert len(same) == 40 and max(same.values()) < 4 * 3000 / 40
    order = [r[0] for r in sorted(got, key=lambda r: (r[2], r[3])) if r[0] is not None and r[1] != "same"]
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.06
    once = df.dropDuplicates(["address_id", "raw_input"])
    a = S.shard_requests(once.repartition(3), 8, seed=1, bucket_bytes=50_000)
    b = S.shard_requests(once.coalesce(1), 8, seed=1, bucket_bytes=50_000)
    c = S.shard_requests(once, 8, seed=2, bucket_bytes=50_000)
    assert sorted(map(repr, rows_of(a))) == sorted(map(repr, rows_of(b))) != sorted(map(repr, rows_of(c)))


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "address_id long, raw_input string")
    got = rows_of(S.shard_requests(df, 5))
    assert len(got) == 2 and {r[2] for r in got} == {0, 1} and {r[3] for r in got} == {0}
    assert S.shard_requests(df.limit(0), 5).count() == 0


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(S.fisher_yates(3, seed, 0)) for seed in range(6000))
    assert len(seen) == 6 and all(800 < n < 1200 for n in seen.values())
    assert sorted(S.fisher_yates(1000, 1, 2)) == list(range(1000))
    assert list(S.fisher_yates(50, 1, 2)) == list(S.fisher_yates(50, 1, 2)) != list(S.fisher_yates(50, 1, 3))


def test_query(spark):
    d = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in Q.QUERIES["op13_sharding"](spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert set(got) == {r["doc_id"] for r in docs}
    for r in docs:
        data = (r["text"] or "").encode()
        g = got[r["doc_id"]]
        assert (g["size"], g["text_crc32"], g["law"], g["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "rows", None)
    counts = Counter(r["shard"] for r in got.values())
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
