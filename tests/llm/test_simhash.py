"""SimHash: fingerprints and components against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from alamatika.llm import simhash as S


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) > 2 else [words][: len(words)]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: list of (id, fingerprint)."""
    names = sorted(set(f for _, f in prints))
    root = {f: f for f in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if bin(a ^ b).count("1") <= 3:
                root[find(a)] = find(b)
    first = defaultdict(list)
    for i, f in prints:
        first[find(f)].append(i)
    return {i: min(first[find(f)]) for i, f in prints}


def test_fingerprints_and_components(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["jalan", "gang", "merdeka", "Braga", "bandung", "10", "ü"]) + str(rng.randrange(60))
    base = [" ".join(word() for _ in range(rng.choice([1, 2, 3, 40, 300]))) for _ in range(40)]
    texts = [None, "", " \t\n", " ", "x " * 5000]
    for t in base:
        texts.append(t)
        for _ in range(4):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append("\n ".join(w))
    texts += texts[10:30]
    rows = list(enumerate(texts, start=100))
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "address_id long, raw_input string, fp string")
    got = {r["address_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in S.near_duplicates(df).collect()}
    want = {i: plain_fingerprint(t) for i, t in rows}
    assert {i: f for i, (f, _) in got.items()} == want
    assert {i: c for i, (_, c) in got.items()} == plain_components(list(want.items()))


@pytest.mark.parametrize("bound", [4096, 3])
def test_links_lose_nothing_in_dense_balls_and_chains(spark, monkeypatch, bound):
    """Random points at up to three bits of one centre, and a chain in steps of three bits;
    with a tiny bound every wide key is cut again.
    """
    monkeypatch.setattr(S, "MAX_GROUP", bound)
    rng = random.Random(bound)
    centre = rng.getrandbits(64)
    prints = {centre}
    for _ in range(60):
        x = centre
        for b in rng.sample(range(64), rng.randint(1, 3)):
            x ^= 1 << b
        prints.add(x)
    x = rng.getrandbits(64)
    for k in range(21):
        prints.add(x)
        for b in (3 * k, 3 * k + 1, 3 * k + 2):
            x ^= 1 << b
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    ids = dict(zip(signed, range(len(signed))))
    df = spark.createDataFrame([(p, i) for p, i in ids.items()], "fp long, first_id long")
    got = {r["fp"]: r["component_id"] for r in S.components(S.links(df.select("fp")), df).collect()}
    want = plain_components([(i, p % (1 << 64)) for p, i in ids.items()])
    assert all(got.get(p, i) == want[i] for p, i in ids.items())


def test_empty_nulls_and_repeats(spark):
    df = spark.createDataFrame([], "address_id long, raw_input string, component_id int")
    assert S.near_duplicates(df).count() == 0
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, None), (3, "")]
    got = S.near_duplicates(spark.createDataFrame(rows, "address_id long, raw_input string")).collect()
    assert sorted((r["address_id"] or 0, r["component_id"]) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 2), (3, 2)]


def test_no_text_is_lost_where_ids_repeat(spark):
    """One row stays of each component, told by id and text; checked against plain pairs."""
    rng = random.Random(12)
    base = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(80)) for _ in range(12)]
    rows = [(1, "A A A A", 0), (5, "A A A A", 1), (5, "B is another text", 2)]
    rows += [(rng.choice([None, *range(20)]), rng.choice([*base, None, ""]), n) for n in range(3, 120)]
    rows += [(7, base[0], n) for n in range(200, 260)] + [(None, base[1], 300), (None, base[1], 301)]
    df = spark.createDataFrame(rows, "address_id long, raw_input string, copy int").repartition(4)
    kept = S.drop_copies(df).collect()

    def fp(text):
        hashes = np.array(S.shingle_hashes(text), dtype=np.uint64)
        return int(S.fingerprints(hashes, np.array([len(hashes)]))[0])

    texts = list({t for _, t, _ in rows})
    group = {t: {t} for t in texts}
    for a in texts:
        for b in texts:
            if (fp(a) ^ fp(b)).bit_count() <= S.MAX_BITS and group[a] is not group[b]:
                group[a] |= group[b]
                for t in group[a]:
                    group[t] = group[a]
    components = {id(g): g for g in group.values()}.values()
    assert len(kept) == len(components)
    for members in components:
        (row,) = [r for r in kept if r["raw_input"] in members]
        ids = [i for i, t, _ in rows if t in members and i is not None]
        assert row["address_id"] == (min(ids) if ids else None)
        assert tuple(row) in {tuple(r) for r in rows}
    assert {"A A A A", "B is another text"} <= {r["raw_input"] for r in kept}
    assert S.drop_copies(df.limit(0)).count() == 0
