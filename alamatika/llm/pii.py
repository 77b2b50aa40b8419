"""Personal data in request texts: fixed patterns, then bootstrapped contexts.

Base entities (e-mail, IP, card, phone) are matched by regular expressions, leftmost and
without overlap per kind. They are the seeds of a bootstrap. An entity induces lexical
patterns: the word before it, the two words before it, the word after it. Patterns and
instances (identifier-like words: at least four digits or an @) form a graph that Spark
scores in rounds. A pattern's confidence for a kind is the share of its different instances
known to be of that kind; patterns with at least ``MIN_SEEDS`` of them and
``MIN_CONFIDENCE`` are accepted, their other instances become known, and these induce
patterns in the next round. Accepted patterns and known instances stay so, and the bootstrap
ends with the first round that accepts none. Instances of accepted patterns that overlap no
base entity are reported with the pattern's kind.

Words are read from the text around a match, whatever they hold, but only where they stand
complete within ``CONTEXT`` characters of it: a longer word is no context.

Built-in expressions only. Counting is per distinct instance and combined before it is
shuffled, so a word before a third of all numbers is one row per task. Up to
``PLAN_PATTERNS`` accepted patterns are handed to the rows as literals; more are joined, and
their spans go back to the rows by a lookup that spreads copies of a text.

Cases: a null text is empty and has no spans; repeated rows and ids are rows of their own
(copies of a text count once in the graph); an empty table stays empty; further columns are
ignored. A pattern that ties between kinds takes the first in the order of ``KINDS``, as does
an instance of patterns of several kinds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alamatika.operators.bounded import COPIES
from alamatika.plans.gazetteer import written

# Kinds in their order, and what each looks like. Quantifiers are possessive and
# matches begin at the start of a run (or where the last match ended), which finds the same
# spans as the plain patterns but never goes back over a long run.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP_VALID = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
CANDIDATE = r"(?<!\S)(?=\S*+)[^\s0-9@]*+[0-9@]\S*+"
MIN_DIGITS = 4
MIN_SEEDS = 8
MIN_CONFIDENCE = 0.8
CONTEXT = 160  # characters on either side of an entity that are searched for whole words
PLAN_PATTERNS = 5_000  # accepted patterns that rows are compared with as literals
SPAN = "array<struct<start:int,end:int,value:string,patterns:array<string>>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right doubled; the digit sum must end in 0."""

    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, -k, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(k % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str) -> Callable[[Column], Column]:
    if kind == "ip":
        return lambda m: m.rlike(IP_VALID)
    if kind == "card":
        return lambda m: F.char_length(_digits(m)).between(13, 19) & _luhn(_digits(m))
    if kind == "phone":
        return lambda m: F.char_length(_digits(m)).between(9, 15)
    return lambda m: F.lit(True)


def _patterns(before: Column, after: Column) -> Column:
    """Lexical patterns of a place, given the text on either side: ``w _``, ``v w _``, ``_ w``.

    A word that begins or ends at the edge of what is given may be cut and does not count.
    """
    one = F.lower(F.regexp_extract(before, r"(?<=\s)(\S++)\s*+$", 1))
    two = F.lower(F.regexp_extract(before, r"(?<=\s)(\S++)\s++\S++\s*+$", 1))
    right = F.lower(F.regexp_extract(after, r"^\s*+(\S++)(?=\s)", 1))
    return F.filter(
        F.array(
            F.when(one != "", F.concat(one, F.lit(" _"))),
            F.when(two != "", F.concat_ws(" ", two, one, F.lit("_"))),
            F.when(right != "", F.concat(F.lit("_ "), right)),
        ),
        lambda p: p.isNotNull(),
    )


def find(text: Column, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """Valid matches as (start, end, value, patterns), in code points.

    The pieces between matches give their places; one fold from the right hands each match
    the text after it, one from the left adds up lengths and hands on the text before.
    """
    pairs = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, m: F.struct(
            F.char_length(gap).alias("gap"), F.left(gap, F.lit(CONTEXT)).alias("first"),
            F.right(gap, F.lit(CONTEXT)).alias("last"), m.alias("m"),
        ),
    )

    def ahead(done: Column, p: Column) -> Column:
        piece = F.concat(p["first"], F.left(F.coalesce(p["m"], F.lit("")), F.lit(CONTEXT)), done["head"])
        return F.struct(
            F.when(p["gap"] > CONTEXT, p["first"]).otherwise(F.left(piece, F.lit(CONTEXT))).alias("head"),
            F.concat(done["heads"], F.array(done["head"])).alias("heads"),
        )

    # The ends of a text end a word.
    right = F.struct(F.lit("\n").alias("head"), F.array().cast("array<string>").alias("heads"))

    def step(done: Column, both: Column) -> Column:
        p = both["p"]
        start = done["at"] + p["gap"]
        end = start + F.coalesce(F.char_length(p["m"]), F.lit(0))
        before = F.right(F.concat(done["tail"], p["last"]), F.lit(CONTEXT))
        span = F.struct(
            start.alias("start"), end.alias("end"), p["m"].alias("value"),
            _patterns(before, both["head"]).alias("patterns"),
        )
        return F.struct(
            end.alias("at"),
            F.right(F.concat(before, F.right(F.coalesce(p["m"], F.lit("")), F.lit(CONTEXT))), F.lit(CONTEXT)).alias("tail"),
            F.when(p["m"].isNotNull() & valid(p["m"]), F.concat(done["spans"], F.array(span)))
            .otherwise(done["spans"]).alias("spans"),
        )

    left = F.struct(F.lit(0).alias("at"), F.lit("\n").alias("tail"), F.array().cast(SPAN).alias("spans"))

    def spans(pairs: Column) -> Column:
        heads = F.aggregate(F.reverse(pairs), right, ahead, lambda done: F.reverse(done["heads"]))
        both = F.zip_with(pairs, heads, lambda p, head: F.struct(p.alias("p"), head.alias("head")))
        return F.aggregate(both, left, step, lambda done: done["spans"])

    # Bound as a variable, the pieces are cut once though both folds read them.
    return F.get(F.transform(F.array(pairs), spans), F.lit(0))


def _guarded(text: Column, sign: str, spans: Column) -> Column:
    """Nothing is searched in texts without the sign that every match needs."""
    return F.when(text.rlike(sign), spans).otherwise(F.array().cast(SPAN))


def base_entities(requests: DataFrame) -> DataFrame:
    """Requests with one column of valid spans per kind, the identifier-like words outside
    them (``candidates``) and the text's key.
    """
    text = F.coalesce("raw_input", F.lit(""))
    rows = requests.select("address_id", text.alias("raw_input"))
    found = rows.select(
        "*",
        *[
            _guarded(F.col("raw_input"), {"email": "@", "phone": r"\+[0-9]"}.get(kind, "[0-9]"),
                     find(F.col("raw_input"), PATTERNS[kind], _valid(kind))).alias(kind)
            for kind in KINDS
        ],
        _guarded(
            F.col("raw_input"), "[0-9@]",
            find(F.col("raw_input"), CANDIDATE,
                 lambda m: (F.char_length(_digits(m)) >= MIN_DIGITS) | m.contains("@")),
        ).alias("words"),
        F.md5(F.encode(F.col("raw_input"), "UTF-8")).alias("text_key"),
    )
    known = F.concat(*KINDS)
    outside = F.filter(
        "words", lambda w: ~F.exists(known, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"]))
    )
    return found.select("address_id", "raw_input", "text_key", *KINDS, outside.alias("candidates"))


def _instances(column: str, kind: Column) -> Column:
    return F.transform(column, lambda s: F.struct(
        s["patterns"].alias("patterns"), s["value"].alias("value"), kind.alias("kind")
    ))


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int") - 1


def pattern_graph(entities: DataFrame) -> DataFrame:
    """Edges (pattern, value, kind) of all texts, each once; kind is null for candidates."""
    both = F.concat(
        *[_instances(kind, F.lit(kind)) for kind in KINDS],
        _instances("candidates", F.lit(None).cast("string")),
    )
    # Not a plain explode: Spark would filter on its size first and so match every text twice.
    edges = entities.select(F.explode_outer(both).alias("e")).where("e IS NOT NULL").select(
        F.explode("e.patterns").alias("pattern"), "e.value", "e.kind"
    )
    return edges.distinct()


def score_patterns(graph: DataFrame) -> DataFrame:
    """Accepted patterns (pattern, kind, confidence) once no round accepts another; the
    confidence is that of the round which accepted it.
    """
    graph = written(graph, "graph")
    accepted = None
    while True:
        if accepted is None:
            known = graph
        else:
            # What accepted patterns stand beside is known from now on, wherever it stands.
            kinds = graph.where("kind IS NULL").join(
                accepted.select("pattern", F.col("kind").alias("new")), "pattern"
            ).groupBy("value").agg(F.min_by("new", _rank(F.col("new"))).alias("new"))
            known = graph.join(kinds, "value", "left").select(
                "pattern", "value", F.coalesce("kind", "new").alias("kind")
            )
        counts = known.groupBy("pattern", "kind").agg(F.count("*").alias("n"))
        scored = counts.groupBy("pattern").agg(
            F.sum("n").alias("total"),
            F.max(F.when(F.col("kind").isNotNull(), F.struct(
                F.col("n"), (-_rank(F.col("kind"))).alias("first"), F.col("kind")
            ))).alias("best"),
        ).where(F.col("best.n") >= MIN_SEEDS)
        confidence = F.col("best.n") / F.col("total")
        now = scored.where(confidence >= MIN_CONFIDENCE).select(
            "pattern", F.col("best.kind").alias("kind"), confidence.alias("confidence")
        )
        if accepted is not None:
            now = accepted.unionByName(now.join(accepted, "pattern", "left_anti"))
        now = written(now, "patterns")
        before = 0 if accepted is None else accepted.count()
        accepted = now
        if now.count() == before:
            return accepted


def _discovered(entities: DataFrame, patterns: DataFrame) -> DataFrame:
    """Entities with ``more``: the candidates beside accepted patterns, as (rank, start, end)."""
    few = patterns.select("pattern", "kind").limit(PLAN_PATTERNS + 1).collect()
    if len(few) <= PLAN_PATTERNS:
        mine = [[r["pattern"] for r in few if r["kind"] == kind] for kind in KINDS]

        def rank(c: Column) -> Column:
            beside = lambda words: F.exists(c["patterns"], lambda p: p.isin(words))
            return F.coalesce(*[
                F.when(beside(words), F.lit(k)) for k, words in enumerate(mine) if words
            ], F.lit(None).cast("int"))

        ranked = F.transform("candidates", lambda c: F.struct(
            rank(c).alias("rank"), c["start"].alias("start"), c["end"].alias("end")
        ))
        return entities.withColumn("more", F.filter(ranked, lambda c: c["rank"].isNotNull()))
    found = entities.where(F.size("candidates") > 0).select("text_key", F.explode("candidates").alias("c")).select(
        "text_key", "c.start", "c.end", F.explode("c.patterns").alias("pattern")
    ).join(patterns.select("pattern", "kind"), "pattern").groupBy("text_key", "start", "end").agg(
        F.min(_rank(F.col("kind"))).alias("rank")
    ).groupBy("text_key").agg(F.collect_list(F.struct("rank", "start", "end")).alias("more"))
    # Every text found comes in COPIES copies and rows take one of them, whichever it is.
    found = written(found, "found").select(
        F.col("text_key").alias("found_key"), F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy"),
        F.col("more").alias("spans_found"),
    )
    none = F.array().cast("array<struct<rank:int,start:int,end:int>>")
    dealt = entities.withColumn("turn", (F.monotonically_increasing_id() % COPIES).cast("int"))
    same = (F.col("text_key") == F.col("found_key")) & (F.col("turn") == F.col("copy"))
    return dealt.join(found, same, "left").withColumn("more", F.coalesce("spans_found", none))


def find_entities(requests: DataFrame) -> DataFrame:
    """(address_id, raw_input, one column of base spans per kind, spans): ``spans`` are all
    base and discovered entities as (kind, start, end), by kind in order, then start.
    """
    entities = base_entities(requests)
    patterns = score_patterns(pattern_graph(entities))
    ranked = lambda kind, spans: F.transform(spans, lambda s: F.struct(
        F.lit(KINDS.index(kind)).alias("rank"), s["start"].alias("start"), s["end"].alias("end")
    ))
    spans = F.array_sort(F.concat(*[ranked(k, F.col(k)) for k in KINDS], F.col("more")))
    return _discovered(entities, patterns).select(
        "address_id", "raw_input", *KINDS,
        F.transform(spans, lambda s: F.struct(
            F.get(F.array(*map(F.lit, KINDS)), s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")
        )).alias("spans"),
    )


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def base_spans() -> Column:
    """Base entities of all kinds as (kind, start, end)."""

    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")
        ))

    return F.concat(*map(named, KINDS))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind, as in ``[EMAIL]``; overlapping spans
    are one, under the name of the first.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(done: Column, s: Column) -> Column:
        fresh = s["start"] >= done["at"]
        return F.struct(
            F.greatest(done["at"], s["end"]).alias("at"),
            F.when(
                fresh,
                F.concat(done["parts"], F.array(
                    F.substring(text, done["at"] + 1, s["start"] - done["at"]),
                    F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")),
                )),
            ).otherwise(done["parts"]).alias("parts"),
        )

    whole = F.aggregate(
        ordered, start, step,
        lambda done: F.concat(F.array_join(done["parts"], ""), F.substring(text, done["at"] + 1, F.lit(1 << 30))),
    )
    return F.when(F.size(spans) > 0, whole).otherwise(text)
