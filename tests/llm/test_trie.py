"""Evidence trie against all prefixes, with odd rows and common beginnings; ordered hashes."""

import hashlib
import random

from alamatika.llm import evidence_trie as T
from alamatika.llm import ordered as O

KIND = "address_id string, ev_pos int, type string, value string, name string, depth int"


def reference(rows, addresses):
    paths = {a: [] for a in addresses if a is not None}
    for a, pos, kind, value, *_ in rows:
        if a is not None:
            paths.setdefault(a, []).append((pos is not None, pos or 0, kind or "", value or ""))
    paths = {a: tuple((k, v) for _, _, k, v in sorted(p)) for a, p in paths.items()}
    nodes = {}
    for a, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(a)
    children = {}
    for node in nodes:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def totals(node):
        own = (len(nodes[node]) - 1) * (len(node[-1][1]) if node else 0)
        if node not in children:
            return 1, own
        below = [totals(c) for c in children[node]]
        return sum(b[0] for b in below), own + sum(b[1] for b in below)

    return {
        (min(m), len(node)): (
            min(nodes[node[:-1]]) if node else None, len(m), len(children.get(node, [])), *totals(node),
            ",".join(sorted(a for a in m if paths[a] == node)),
        )
        for node, m in nodes.items()
    }


def check(spark, rows, addresses, heavy=T.HEAVY):
    df = spark.createDataFrame(rows, KIND).repartition(4)
    known = spark.createDataFrame([(a, 1) for a in addresses], "address_id string, depth int")
    trie = T.build_trie(df, known, heavy)
    ends = {}
    for r in trie.ends.collect():
        ends.setdefault(bytes(r["name"]), []).append(r["address_id"])
    got = {
        (r["address_id"], r["depth"]): (
            r["parent_address_id"], r["n_addresses"], r["n_children"], r["n_leaves"], r["saved_chars"],
            ",".join(sorted(ends.get(bytes(r["name"]), []))),
        )
        for r in trie.nodes.collect()
    }
    want = reference(rows, addresses)
    assert len(trie.nodes.collect()) == len(want)
    assert got == want
    return trie


def test_prefixes(spark):
    rng = random.Random(3)
    rows, addresses = [], ["none", "none", None]
    for n in range(120):
        depth = rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 17])
        for pos in range(depth):
            value = "common" if pos < 2 and n % 3 else rng.choice(["jl", "melati", "", None, "é😀"])
            rows.append((f"a{n}", pos, rng.choice(["place_name", None]) if pos > 1 else "place_name", value, "x", 1))
        addresses.append(f"a{n}")
    rows += [("ties", 1, "b", "1", "x", 1), ("ties", 1, "a", "2", "x", 1), ("ties", None, "z", "3", "x", 1),
             ("ties", 1, "a", "2", "x", 1), (None, 1, "a", "lost", "x", 1), ("only", 0, "place_name", "y" * 300_000, "x", 1),
             # where the type ends decides
             ("t1", 0, "ab", "c", "x", 1), ("t2", 0, "a", "bc", "x", 1)]
    trie = check(spark, rows, addresses)
    done = O.ordered_sha256(trie.ends, "name", "address_id", "address_id").collect()
    ends = {}
    for r in trie.ends.collect():
        ends.setdefault(bytes(r["name"]), []).append(r["address_id"])
    assert {bytes(r["name"]): r["sha256"] for r in done} == {
        k: hashlib.sha256(",".join(sorted(v)).encode()).hexdigest() for k, v in ends.items()
    }


def test_parents_of_many_children_and_empty_tables(spark):
    rows = [(f"a{n:05d}", p, "t", ["same", str(n)][p], "x", 1) for n in range(3000) for p in range(2)]
    check(spark, rows, [], heavy=50_000)
    check(spark, [], ["b", "a"])
    check(spark, [], [])
    check(spark, [(None, 1, "a", "b", "x", 1)], [None])


def test_ordered_pieces(spark, monkeypatch):
    monkeypatch.setattr(O, "PIECE_CHARS", 50)
    rows = [(k, i, f"{k}-{i}\n") for k in (1, 2, None) for i in range(700 if k == 1 else 3)] + [(4, 0, "")]
    df = spark.createDataFrame(rows, "k long, o long, t string").repartition(7)
    want = {}
    for k, _, t in rows:
        want[k] = want.get(k, []) + [t]
    got = {r["k"]: r["sha256"] for r in O.ordered_sha256(df, "k", "o", "t", ";").collect()}
    assert got == {k: hashlib.sha256(";".join(v).encode()).hexdigest() for k, v in want.items()}
    assert {r["k"]: r["joined"] for r in O.ordered_text(df, "k", "o", "t").collect()} == {k: "".join(v) for k, v in want.items()}
    assert O.ordered_sha256(df.limit(0), "k", "o", "t").count() == 0
