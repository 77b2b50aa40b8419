"""FM-index search against plain search."""

import pickle
import random
import tracemalloc

import numpy as np
import pytest

from alamatika.llm import decontaminate as D


def test_suffix_array_and_index():
    rng = random.Random(1)
    for n in (1, 2, 50, 400):
        for alphabet in (1, 2, 40):
            s = [rng.randint(1, alphabet) for _ in range(n)] + [0]
            if n == 400:
                s[200:200] = s[:150] + [0]
            a = np.array(s, dtype=np.int64)
            assert D.suffix_array(a).tolist() == sorted(range(len(s)), key=lambda k: s[k:])
            index = D.FMIndex(a)
            for width in (1, 2, 3):
                rows = np.array([[rng.randint(1, alphabet + 1) for _ in range(width)] for _ in range(30)])
                low, high = index.search(rows)
                for row, lo, hi in zip(rows.tolist(), low, high):
                    want = [k for k in range(len(s)) if s[k : k + width] == row]
                    assert sorted(index.locate(np.arange(lo, hi)).tolist()) == want


def plain(texts, labels):
    words = [[w.decode() for w in D.words_of(t)] for t in texts]
    out = []
    for own in words:
        hit, items = set(), set()
        for label, text in labels:
            w = [x.decode() for x in D.words_of(text)]
            width = min(10, len(w))
            for k in range(len(w) - width + 1 if width else 0):
                for at in range(len(own) - width + 1):
                    if own[at : at + width] == w[k : k + width]:
                        hit |= set(range(at, at + width))
                        items.add(str(label))
        out.append((len(own), hit, sorted(items)))
    return out


def cases():
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("Jl gg No Braga 7 é ß kota rt rw".split()) for _ in range(n))
    labels = [(k, text(rng.choice([1, 3, 12, 30])) + " u" * (k % 3)) for k in range(12)]
    labels += [(50, None), (51, ""), (52, ".,"), (None, "only here"), (53, labels[2][1]), (2, labels[2][1])]
    texts = [None, "", " - ", text(9)]
    for _, t in labels[:12]:
        texts += [f"{text(5)}. {t.upper()}, {t}!{text(3)}", t, text(40)]
    return texts + texts[4:9] + ["only-here"], labels


def test_phrases_are_those_of_a_plain_dict():
    rng = random.Random(3)
    word = lambda: rng.choice("aa bb cc dd".split())
    labels = [(str(k % 40), " ".join(word() for _ in range(rng.choice([0, 1, 2, 5, 9, 10, 11, 25])))) for k in range(120)]
    labels += [labels[7], ("x", None), ("y", " ".join(["aa"] * 40))]
    want = {}
    for label, text in labels:
        words = D.words_of(text)
        width = min(10, len(words))
        for k in range(len(words) - width + 1 if width else 0):
            want.setdefault(tuple(words[k : k + width]), set()).add(label)
    phrases = D.Phrases(labels)
    word_of = {n: w for w, n in phrases.symbols.items()}
    got = {}
    for width in phrases.by_width:
        rows, numbers = phrases.within(width, np.ones(len(word_of) + 1, dtype=bool))
        for row, n in zip(rows.tolist(), numbers.tolist()):
            owners = phrases.owners[phrases.owned[n] : phrases.owned[n + 1]].tolist()
            assert got.setdefault(tuple(word_of[x] for x in row), owners) is owners  # each phrase once
    assert {k: {phrases.labels[x] for x in v} for k, v in got.items()} == want
    assert all(len(v) == len(set(v)) for v in got.values())
    no_d = np.array([False] + [word_of[k] != b"dd" for k in range(1, len(word_of) + 1)])
    assert sum(len(phrases.within(w, no_d)[1]) for w in phrases.by_width) == sum(b"dd" not in k for k in want)
    assert D.Phrases([]).shortest == D.Phrases([("a", None)]).shortest == 0


def test_a_block_of_labels_is_small():
    rng = random.Random(4)
    text = lambda: " ".join(f"{rng.getrandbits(18):x}" for _ in range(200))
    labels = [(str(k), text()) for k in range(D.BLOCK_BYTES // 1200)]
    assert sum(len(t) for _, t in labels) > D.BLOCK_BYTES * 0.8
    tracemalloc.start()
    phrases = D.Phrases(labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pickle.dumps(phrases)) < 20 << 20 and peak < 300 << 20


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_against_plain_search(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    monkeypatch.setattr(D, "SHARD_WORDS", 60)
    texts, labels = cases()
    want = plain(texts, [("" if x is None else x, t) for x, t in labels])
    requests = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "address_id long, raw_input string, spans string")
    table = spark.createDataFrame(labels, "label_id long, address_raw string")
    got = {r["address_id"]: r for r in D.find_leaks(requests, table).collect()}
    assert len(got) == len(texts)
    for k, (n, hit, items) in enumerate(want):
        spans = got[k]["spans"]
        covered = [p for s in spans for p in range(s["begin"], s["end"])]
        assert (got[k]["n_words"], covered, got[k]["label_ids"]) == (n, sorted(hit), items), k
        assert got[k]["n_hit"] == len(hit)
        assert all(a["end"] < b["begin"] for a, b in zip(spans, spans[1:]))


def test_empty_tables(spark):
    requests = spark.createDataFrame([(None, "a b"), (1, None)], "address_id long, raw_input string")
    labels = spark.createDataFrame([], "label_id long, address_raw string")
    assert [r["n_hit"] for r in D.find_leaks(requests, labels).collect()] == [0, 0]
    assert D.find_leaks(requests.limit(0), labels).count() == 0


@pytest.mark.parametrize("block", [1000])
def test_removal_in_blocks_equals_one_block(spark, monkeypatch, block):
    texts, labels = cases()
    run = "a b c d e f g h i j k l m n o p".split()
    # Items that share words, and one that the cut of another brings together.
    labels += [(60, " ".join(run[:12])), (61, " ".join(run[4:])), (62, "left right"), (63, "right left")]
    texts += ["x " + " ".join(run) + " y", f"left {' '.join(run)} right", "q left left right right q", " ".join(run)]
    rows = spark.createDataFrame([(t, k) for k, t in enumerate(texts)], "text string, `row` long")
    table = spark.createDataFrame(labels, "label_id long, address_raw string")
    got = lambda: sorted(map(tuple, D.remove_leaks(rows, table, "text").collect()), key=lambda r: r[1])
    want = got()
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    assert got() == want
    assert D.remove_leaks(rows.limit(0), table, "text").count() == 0
