"""Phrase matching on the mini dictionary, with a brute-force check."""

import pytest
from pyspark.sql import functions as F

from alamatika.operators import matching as M

ENTITIES = [
    ("mawar lor", 71, "DISTRICT"), ("mawar kulon", 72, "DISTRICT"), ("mawar", 310, "SUBDISTRICT"),
    ("tirta", 15, "CITY"), ("tirta asih", 73, "DISTRICT"), ("pulau nila", 16, "CITY"),
    ("pulau nila besar", 17, "CITY"), ("tanah hulu selatan", 1, "PROVINCE"), ("selatan", 18, "CITY"),
    ("kembar", 74, "DISTRICT"), ("kembar", 311, "SUBDISTRICT"),
]
CASES = [
    (1, "tirta", {"tirta": {15}}),
    (2, "tirta", {}),
    (1, "", {}),
    (1, "mawar lor", {"mawar": {71}, "lor": {71}}),
    (1, "lor mawar", {"mawar": {310}}),
    (1, "mawar kulon di tirta", {"mawar": {72}, "kulon": {72}, "tirta": {15}}),
    (1, "pulau nila besar", {"pulau": {17}, "nila": {17}, "besar": {17}}),
    (1, "pulau nila dan besar", {"pulau": {16}, "nila": {16}}),
    (1, "tanah hulu selatan", {"tanah": {1}, "hulu": {1}, "selatan": {1}}),
    (1, "selatan tanah hulu", {"selatan": {18}}),
    (1, "kembar", {"kembar": {74, 311}}),
    (1, "mawar kulon mawar lor", {"mawar": {71, 72}, "kulon": {72}, "lor": {71}}),
    (1, "tirta gg asih", {"tirta": {15}}),
    (1, "tirta asih tirta", {"tirta": {15, 73}, "asih": {73}}),
]


def phrases(spark, entities=ENTITIES):
    return spark.createDataFrame(
        [(1, p, i, lv, str(i), p.title(), "") for p, i, lv in entities],
        "source_id long, phrase string, entity_id long, level string, kode string, name string, postal_code string",
    )


def matched(spark, texts, entities=ENTITIES):
    addresses = spark.createDataFrame(
        [(str(i), s, t) for i, (s, t) in enumerate(texts)],
        "address_id string, source_id long, normalized string",
    )
    dictionary = phrases(spark, entities)
    longest = max(len(p.split()) for p, _, _ in entities)
    out = {str(i): {} for i in range(len(texts))}
    for r in M.match_phrases(addresses, dictionary, longest).collect():
        out[r.address_id].setdefault(r.word, set()).add(r.entity_id)
    return [out[str(i)] for i in range(len(texts))]


def test_phrase_cases(spark):
    assert matched(spark, [(s, t) for s, t, _ in CASES]) == [want for _, _, want in CASES]


def test_without_the_longer_phrase(spark):
    few = [e for e in ENTITIES if e[1] != 17]
    assert matched(spark, [(1, "pulau nila besar")], few) == [{"pulau": {16}, "nila": {16}}]


def brute_force(text, names):
    words, at, out = text.split(), 0, {}
    while at < len(words):
        ends = [e for e in range(len(words), at, -1) if " ".join(words[at:e]) in names]
        if not ends:
            at += 1
            continue
        for w in words[at:ends[0]]:
            out.setdefault(w, set()).update(names[" ".join(words[at:ends[0]])])
        at = ends[0]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    import random

    rnd = random.Random(seed)
    names, entities = {}, []
    for i in range(60):
        p = " ".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 4)))
        names.setdefault(p, set()).add(i)
        entities.append((p, i, "CITY"))
    texts = [" ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(0, 14))) for _ in range(200)]
    assert matched(spark, [(1, t) for t in texts], entities) == [brute_force(t, names) for t in texts]


def test_resolution_keeps_unresolved(spark):
    addresses = spark.createDataFrame(
        [("a", 1, "jl citarum x 40115")], "address_id string, source_id long, normalized string")
    dictionary = spark.createDataFrame(
        [(1, "citarum", 7, "SUBDISTRICT", "k", "Citarum", "40115"),
         (1, "lain", 8, "SUBDISTRICT", "m", "Lain", "40115"),
         (2, "citarum", 9, "SUBDISTRICT", "n", "Citarum", "40115")],
        phrases(spark).schema)
    ev = M.evidence(addresses)
    out = M.resolve_evidence(ev, M.match_phrases(addresses, dictionary, 1), dictionary)
    got = {(r.ev_pos, r.type, r.value, r.entity_id) for r in out.collect()}
    assert got == {
        (0, "postal_code", "40115", 7), (0, "postal_code", "40115", 8),
        (1, "place_name", "citarum", 7), (2, "place_name", "x", None)}


def test_spans_are_bounded(spark):
    row = spark.range(1).select(
        M.spans(F.split(F.lit("a b c"), " "), 2).alias("s"), M.spans(F.array().cast("array<string>"), 2).alias("e")
    ).first()
    assert [(s.start, s.end, s.phrase) for s in row.s] == [
        (0, 1, "a"), (1, 2, "b"), (2, 3, "c"), (0, 2, "a b"), (1, 3, "b c")]
    assert row.e == []
