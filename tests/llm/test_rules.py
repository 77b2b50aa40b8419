"""Quality rules against a plain count."""

import random
import re

from alamatika.llm import rules as R

BLANK = "[\x20\x09-\x0d]"


def plain(text):
    text = text or ""
    words = [w for w in re.split(f"{BLANK}+", text) if w]
    lines = [x for x in text.split("\n") if re.sub(BLANK, "", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    n = len(words)
    base = n < 50 or 100 * len(hit) > 50 * n
    m = {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall("[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "n_lines": len(lines),
        "n_stop_words": sum(w in R.STOP_WORDS for w in words),
        "n_bullet_lines": sum(bool(re.match(r"[ \t]*[-*•]", x)) for x in lines),
        "n_cut_lines": sum(bool(re.search(r"(\.\.\.|…)[ \t\r]*$", x)) for x in lines),
    }
    failed = [
        r.name for r in R.THRESHOLDS
        if (r.low is not None and 1000 * m[r.part] < r.low * m[r.whole])
        or (r.high is not None and 1000 * m[r.part] > r.high * m[r.whole])
    ]
    return m | {"base_failed": base, "failed_rules": ",".join(failed), "kept": not base and not failed}


def test_against_plain(spark):
    rng = random.Random(8)
    words = ["the", "of", "jalan", "é", "😀x", "***", "a|b", "merdeka", "Bandung.", "10", "di"]
    gaps = [" ", " ", " ", "\n", "\t", "  ", "\n- ", " ", "...\n", "\r\n", "\x0b", "\x1c"]
    texts = [None, "", " \n\t ", "a b c", "a a a a", "x " * 60, "- a\n- a\n- b\n…\n", "\n" * 50, "the of " * 9000]
    texts += ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(1, 120))) for _ in range(150)]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(None, "x", 1), (3, "a b c", 1)]
    df = spark.createDataFrame(rows, "address_id long, raw_input string, n_words int")
    got = [r.asDict() for r in R.apply_rules(df).collect()]
    assert len(got) == len(rows)
    for r in got:
        key = r.pop("address_id")
        text = "x" if key is None else texts[key]
        if text and len(text) > 50_000:
            assert (r["n_words"], r["n_repeat_words"], r["kept"]) == (18_000, 18_000, False)
            continue
        assert r == plain(text), text
    assert R.apply_rules(df.limit(0)).count() == 0
