"""Conversation repair: block tables against all edit sequences, odd rows against a plain version."""

import itertools
import random
from functools import lru_cache

import numpy as np

from alamatika.llm import repair as R

INITIALS = "sua-"


def plain(symbols):
    """(cost, audit) by trying every edit; insertions are bounded, as more never pay."""
    n = len(symbols)

    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "")] if i == n and state in (0, 3) else []
        if inserted < 3:
            c, a = best(i, R.NEXT[state], inserted + 1)
            found.append((c + 3, "I" + a))
        if i < n:
            c, a = best(i + 1, state, 0)
            found.append((c + 4, "D" + a))
            if symbols[i]:
                kind, cut = divmod(symbols[i] - 1, 2)
                c, a = best(i + 1, R.NEXT[state], 0)
                found.append((c + 3 + 3 * cut, "R" + a))
                legal = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
                to = legal.get((INITIALS[kind], state))
                if to is not None:
                    c, a = best(i + 1, to, 0)
                    found.append((c + 3 * cut, "K" + a))
        return min(found) if found else (10**6, "")

    return best(0, 0, 0)


def test_tables_equal_all_edits():
    for block in (1, 2, 3, 4):
        tables = R.Tables(block)
        assert len(tables.vectors) < 100  # a small fixed set
        rng = random.Random(block)
        cases = [list(c) for n in range(3) for c in itertools.product(range(9), repeat=n)]
        cases += [[rng.randrange(9) for _ in range(rng.randrange(3, 14))] for _ in range(400)]
        for case in cases:
            symbols = np.array(case, np.uint8)
            edits = list(tables.edits(symbols))
            want = plain(tuple(case))
            assert (sum(e[3] for e in edits), "".join(e[0] for e in edits)) == want, case
            assert tables.least_cost(symbols)[0] == want[0]
            assert [e[1] for e in edits if e[1]] == list(range(1, len(case) + 1))


def reference(rows):
    """Per conversation: counts, audit and repaired turns of (turn, role, text) rows."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, symbols = set(), []
    counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    for i, (_, role, text) in enumerate(rows):
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = (
            "blank" if not body else "duplicate" if (role, text) in seen
            else "truncated" if body[-1] not in ".!?" else None
        )
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        if i and rows[i - 1][1][:1] + role[:1] not in ("su", "ua", "au"):
            counts["illegal"] += 1
        kind = "sua".find(role[:1]) if role[:1] else -1
        kind = 3 if kind < 0 else kind
        symbols.append(0 if fault in ("blank", "duplicate") else 1 + 2 * kind + (fault == "truncated"))
    cost, audit = plain(tuple(symbols))
    out, at = [], 0
    for letter in audit:
        row = None if letter == "I" else rows[at]
        at += letter != "I"
        if letter == "K":
            out.append(row[1:])
        elif letter != "D":
            last = out[-1][0][:1] if out else "s"
            out.append(("assistant" if last == "u" else "user", row[2] if row else ""))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return counts | {"gaps": gaps}, cost, audit, out


def test_conversations(spark):
    rng = random.Random(5)
    roles = ["system", "user", "assistant", "tool", "", None, "User", "umpire"]
    texts = ["Yes.", "no", "", " \t\n", None, "Sure! ", "é?", "cut,", "x" * 100_000 + ".", "a.b"]
    rows = [
        (conv if conv else None, rng.choice([None, 0, 1, 2, 5, 9, turn]), rng.choice(roles), rng.choice(texts), turn, "x")
        for conv in range(60) for turn in range(rng.randrange(1, 12))
    ]
    rows += [(99, 1, "user", "Same.", 0, "x")] * 50  # one row repeated
    df = spark.createDataFrame(
        rows, "conv_id long, turn int, role string, text string, step int, fault string"
    ).repartition(5)
    marked, edits, repaired = R.repair_conversations(df)
    got_edits, got_rows, got_counts = {}, {}, {}
    for r in sorted(edits.collect(), key=lambda r: r["step"]):
        got_edits.setdefault(r["conv_id"], []).append((r["edit"], r["cost"]))
    for r in sorted(repaired.collect(), key=lambda r: r["step"]):
        got_rows.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for r in R.count_faults(marked).collect():
        got_counts[r["conv_id"]] = r.asDict()
    want = {}
    for conv, turn, role, text, *_ in rows:
        want.setdefault(conv, []).append((turn, role, text))
    assert set(want) == set(got_counts)
    for conv, own in want.items():
        counts, cost, audit, out = reference(own)
        assert {k: got_counts[conv][k] for k in counts} == counts, conv
        assert "".join(e for e, _ in got_edits[conv]) == audit
        assert sum(c for _, c in got_edits[conv]) == cost
        assert got_rows.get(conv, []) == out
    empty = R.repair_conversations(df.limit(0))
    assert all(t.count() == 0 for t in empty)
