"""Quality rules over raw request texts, as one projection without user functions.

A table of thresholds is compiled into a single Spark projection of length, symbol,
stop-word and line ratios. Ratios are compared as whole numbers (per mille of the
denominator), so no verdict hangs on floating point.

Cases: a null or blank text has no words and fails; a null id stays null; rows with equal
ids or texts are judged one by one; an empty table gives an empty table. Other columns of
the input are ignored, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What separates words, what counts as a symbol, common words of the texts.
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
STOP_WORDS = tuple(
    # Indonesian, English, French, German, Spanish
    "di ke dari yang dan untuk pada dengan itu ini "
    "the of and to in is that for it as was with be by on are this or from an at a he "
    "de la le et les des en un une du que qui dans pour par sur au est pas "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine "
    "el y los del se las por para con no su al lo".split()
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """``low <= 1000 * part / whole <= high``; a side left out is not tested."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None


THRESHOLDS = (
    Rule("word_length", "word_chars", "n_words", 2_000, 14_000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("stop_words", "n_stop_words", "n_words", 60, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 500),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 900),
    Rule("cut_lines", "n_cut_lines", "n_lines", None, 300),
)


def rule_failed(rule: Rule) -> Column:
    """True if the ratio is outside its bounds (nothing to divide: never)."""
    part, whole = F.col(rule.part) * 1000, F.col(rule.whole)
    failed = F.lit(False)
    if rule.low is not None:
        failed = failed | (part < whole * rule.low)
    if rule.high is not None:
        failed = failed | (part > whole * rule.high)
    return failed


def words_of(text: Column) -> Column:
    """Words between blanks; none for a null or blank text."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACE)
    )


def _n(c: Column) -> Column:
    return c.cast("long")


def text_metrics(requests: DataFrame) -> DataFrame:
    """Counts behind the rules: one row per request (address_id, raw_input).

    ``n_repeat_words`` counts words inside any three-word window that occurs at least
    twice. Windows are sorted by hash with their position, so equal ones are neighbours
    and the work per text is n log n, also where every window repeats.
    """
    text = F.coalesce(F.col("raw_input"), F.lit(""))
    split = requests.select(
        "address_id", text.alias("text"), words_of(text).alias("words"),
        F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "").alias("lines"),
    )
    starts = F.sequence(F.lit(0), F.size("words") - 3)
    word = lambda i: F.get("words", i)
    hashed = split.select(
        "address_id", "text", "words", "lines",
        F.when(
            F.size("words") > 3,
            F.transform(starts, lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))),
        ).alias("windows"),
    )
    # Sorted only where a window occurs twice.
    placed = hashed.select(
        "address_id", "text", "words", "lines",
        F.when(
            F.size("windows") > F.size(F.array_distinct("windows")),
            F.array_sort(
                F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at")))
            ),
        ).alias("sorted"),
    )
    near = lambda k: F.get("sorted", k)["h"]
    repeated = F.transform(
        F.filter(
            F.transform(
                "sorted",
                lambda s, k: F.struct(
                    s["at"].alias("at"),
                    (F.coalesce(near(k - 1) == s["h"], F.lit(False))
                     | F.coalesce(near(k + 1) == s["h"], F.lit(False))).alias("twice"),
                ),
            ),
            lambda s: s["twice"],
        ),
        lambda s: s["at"],
    )
    covered = placed.select(
        "address_id", "text", "words", "lines", F.array_sort(repeated).alias("at")
    )
    gap = lambda at, k: F.coalesce(F.get("at", k + 1) - at, F.lit(3))
    return covered.select(
        "address_id",
        _n(F.size("words")).alias("n_words"),
        _n(F.char_length(F.array_join("words", ""))).alias("word_chars"),
        _n(F.regexp_count("text", F.lit(SYMBOLS))).alias("n_symbols"),
        _n(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.coalesce(
            F.aggregate(
                F.transform("at", lambda at, k: F.least(F.lit(3), gap(at, k))),
                F.lit(0), lambda total, n: total + n,
            ).cast("long"),
            F.lit(0).cast("long"),
        ).alias("n_repeat_words"),
        _n(F.size("lines")).alias("n_lines"),
        _n(F.size(F.filter("words", lambda w: w.isin(*STOP_WORDS)))).alias("n_stop_words"),
        _n(F.size(F.filter("lines", lambda x: x.rlike(r"^[ \t]*[-*•]")))).alias("n_bullet_lines"),
        _n(F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)[ \t\r]*$")))).alias("n_cut_lines"),
    )


def apply_rules(requests: DataFrame, thresholds: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """Metrics, ``base_failed``, the names of failed rules and ``kept`` per request."""
    metrics = text_metrics(requests)
    base = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )
    failed = F.array_compact(
        F.array(*[F.when(rule_failed(r), F.lit(r.name)) for r in thresholds])
    )
    return metrics.select(
        "*", base.alias("base_failed"), F.array_join(failed, ",").alias("failed_rules"),
        (~base & (F.size(failed) == 0)).alias("kept"),
    )
