"""Personal data: base spans against plain regular expressions; discovery against a plain
bootstrap; masking."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from alamatika.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain(text):
    spans = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            spans.append((kind, m.start(), m.end()))
    return spans


def test_base_spans_equal_plain_matching(spark):
    rng = random.Random(9)
    bits = ["a@b.c", "x.y%@z", "@", ".", "..", "-", " ", "\n", "é", "😀", "+6", "+62 (21) 555-0", "1.2.3", "255.", "256.",
            "4111 1111 1111 1111", "0", "00", "99", "jl", "_", "(", "4242-4242-4242-4242", "\t"]
    texts = [None, "", "a@b.c%d@e.f_g@h.i", "1.2.3.4.5.6.7.8", "4111111111111111 4111111111111111", "0" * 16, "1" * 50000,
             "a" * 30000 + "@", "x@y" + ".z" * 20000, "+1" + " 2" * 20000, "000.0255.1.1"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(600)]
    df = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "address_id long, raw_input string, spans string")
    got = pii.base_entities(df).select("address_id", pii.base_spans().alias("spans")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert [tuple(s) for s in r["spans"]] == plain(texts[r["address_id"]]), texts[r["address_id"]]


def test_contexts_discover_unseen_identifiers(spark):
    rng = random.Random(1)
    phone = lambda: f"+62 812 {rng.randrange(10**3):03d} {rng.randrange(10**4):04d}"
    texts = [f"rumah {k} telp: {phone()} bandung" for k in range(12)]
    texts += ["hubungi telp: 0812777666 ya", "wa 0812777666 saja", "kode 0812000111 biasa", None, ""]
    texts += [f"no wa {phone()}" for _ in range(9)]
    texts += ["cuma wa 085500001 x", "a lain 085500002"]
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:2], "address_id long, raw_input string")
    found = pii.find_entities(df)
    got = {r["address_id"]: [tuple(s) for s in r["spans"]] for r in found.collect()}
    assert found.count() == len(rows) + 2
    assert got[12] == [("phone", 14, 24)]
    assert got[13] == [("phone", 3, 13)] and got[14] == [] and got[15] == [] == got[16]
    assert got[26] == [("phone", 8, 17)] and got[27] == []
    for k in range(12):
        assert got[k] == plain(texts[k])
    hidden = {r["address_id"]: r["t"] for r in found.select("address_id", pii.masked(F.col("raw_input"), F.col("spans")).alias("t")).collect()}
    assert hidden[12] == "hubungi telp: [PHONE] ya" and hidden[14] == texts[14] and hidden[16] == ""


def contexts(text, start, end):
    """Patterns of a place: whole words within reach, on either side."""
    before = ("\n" + text)[: start + 1][-pii.CONTEXT :]
    after = (text + "\n")[end:][: pii.CONTEXT]
    words = re.findall(r"(?<=\s)\S+(?=\s*)", before.lower())
    right = re.match(r"\s*(\S+)\s", after.lower())
    out = [f"{words[-1]} _"] if words else []
    out += [f"{words[-2]} {words[-1]} _"] if len(words) > 1 else []
    return out + ([f"_ {right[1]}"] if right else [])


def bootstrap(texts):
    """Spans of every text, by rounds over plain dictionaries."""
    found, candidates, edges = [], [], set()
    for text in (t or "" for t in texts):
        base = plain(text)
        found.append(base)
        for kind, start, end in base:
            edges |= {(p, text[start:end], kind) for p in contexts(text, start, end)}
        mine = []
        for m in re.finditer(r"(?<!\S)[^\s0-9@]*[0-9@]\S*", text):
            if len(re.findall("[0-9]", m.group())) < pii.MIN_DIGITS and "@" not in m.group():
                continue
            if any(s < m.end() and m.start() < e for _, s, e in base):
                continue
            mine.append((m.start(), m.end(), contexts(text, *m.span())))
            edges |= {(p, m.group(), None) for p in mine[-1][2]}
        candidates.append(mine)
    accepted = {}
    while True:
        new = {}
        for p, value, kind in edges:
            if kind is None and p in accepted:
                new[value] = min(new.get(value, accepted[p]), accepted[p], key=pii.KINDS.index)
        counts = defaultdict(lambda: defaultdict(int))
        for p, value, kind in edges:
            counts[p][kind or new.get(value)] += 1
        fresh = {}
        for p, by_kind in counts.items():
            n, _, kind = max((by_kind[k], -pii.KINDS.index(k), k) for k in pii.KINDS)
            if p not in accepted and n >= pii.MIN_SEEDS and n / sum(by_kind.values()) >= pii.MIN_CONFIDENCE:
                fresh[p] = kind
        if not fresh:
            break
        accepted |= fresh
    for spans, mine in zip(found, candidates):
        for start, end, patterns in mine:
            kinds = [accepted[p] for p in patterns if p in accepted]
            if kinds:
                spans.append((min(kinds, key=pii.KINDS.index), start, end))
        spans.sort(key=lambda s: (pii.KINDS.index(s[0]), s[1]))
    return found, accepted


@pytest.mark.parametrize("in_plan", [5_000, 0])
def test_discovery_equals_a_plain_bootstrap(spark, monkeypatch, in_plan):
    """Chains of rounds, words with digits, places at the ends, words beyond the window."""
    monkeypatch.setattr(pii, "PLAN_PATTERNS", in_plan)
    rng = random.Random(4)
    phone = lambda: f"+62 81{rng.randrange(10)} {rng.randrange(10**4):04d} {rng.randrange(10**4):04d}"
    number = lambda: f"08{rng.randrange(10**8):08d}"
    words = ["hp2:", "telp", "surel", "kirim ke", "x" * 200, "nik", "Ke", "di", "(wa)", "😀"]
    texts = [None, "", "0812777666", "hp1: 0812777666", f"{'x' * 200} 0812777666", "telp\t0812777666\u00a0z"]
    for k in range(16):
        shared = number()
        texts += [f"hp1: {phone()} ya" for _ in range(6)] + [f"HP1: {shared}", f"kode lama {shared}"]
        texts += [f"kode lama {number()} habis"] * (k < 3)
        texts += [f"surel u{k}@contoh.id ok", f"kirim surel orang{k}@", f"{phone()} lagi {number()} lagi"]
    texts += [" ".join(rng.choice([rng.choice(words), phone(), number(), "a@b.c", "1.2.3.4"]) for _ in range(rng.randint(1, 9)))
              for _ in range(150)]
    texts += texts[:9]
    df = spark.createDataFrame(list(enumerate(texts)), "address_id long, raw_input string").repartition(5)
    want, accepted = bootstrap(texts)
    got = {r["address_id"]: [tuple(s) for s in r["spans"]] for r in pii.find_entities(df).collect()}
    assert got == dict(enumerate(want))
    patterns = pii.score_patterns(pii.pattern_graph(pii.base_entities(df))).collect()
    assert {r["pattern"]: r["kind"] for r in patterns} == accepted
    # The second round reaches what the first made known; a context word may hold digits.
    assert accepted["hp1: _"] == "phone" and accepted["kode lama _"] == "phone"
    assert got[3] == [("phone", 5, 15)] and not any(s[0] == "phone" for s in got[2] + got[4])


def test_empty(spark):
    df = spark.createDataFrame([], "address_id long, raw_input string, kind string")
    assert pii.find_entities(df).count() == 0
