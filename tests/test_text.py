"""Normaliser pairs, request checks, evidence and formatting."""

import pytest
from pyspark.sql import functions as F

from alamatika.functions import constants as K
from alamatika.functions import text as T

PAIRS = [
    ("Kel. Mawar Lor", "mawar lor"), ("kab. TIRTA", "tirta"), ("Prov. Tanah Hulu", "tanah hulu"),
    ("  Kec \t Nila  ", "nila"), ("Nila, Tirta;Hulu", "nila tirtahulu"), ("", ""), ("NO. 7A", "no a"),
    ("RT.1/RW.2", "rtrw"), ("__nila__", "nila"), ("Tirta 90210", "tirta 90210"), ("90210", "90210"),
    ("gg 9021", "gg"), ("gg_nila_9", "ggnila"), ("Nila,\\nTirta", "nila tirta"),
    # further cases
    ("é40115", "40115"), ("Kota, Bandung", "kota bandung"), ("no.12345,x", "nox 12345"),
    ("40115 40116", "40115 40116"), ("a kota b", "a b"), ("kota kota kab. x", "x"),
    ("a kota b\x0bc\x85d", "a b c d"), ("Kel.Braga", "kelbraga"),
    ("123456 x", "x"), ("- / -", ""), ("kota", ""), ("Kota 40115", "40115"),
]


def test_normalize(spark):
    rows = spark.createDataFrame(
        [(i, a) for i, (a, _) in enumerate(PAIRS)], "i int, a string"
    ).select("i", T.normalize(F.col("a")).alias("n"))
    got = {r.i: r.n for r in rows.collect()}
    assert {i: got[i] for i in got} == {i: b for i, (_, b) in enumerate(PAIRS)}


def test_normalized_texts_are_clean(spark):
    """Property: lower case, no admin token left, idempotent on code-free text."""
    words = ["Kota", "kab.", "Bandung", "x1", "40115", "RT.05", "é", " ", "Kec.", "prov", "jl"]
    rows = spark.range(2000).select(
        F.array_join(
            F.transform(
                F.sequence(F.lit(1), (F.col("id") % 9 + 1).cast("int")),
                lambda i: F.element_at(
                    F.array(*[F.lit(w) for w in words]),
                    (F.abs(F.xxhash64("id", i)) % len(words) + 1).cast("int"),
                ),
            ),
            " ",
        ).alias("a")
    ).select(T.normalize(F.col("a")).alias("n"))
    tokens = T.words_of(F.col("n"))
    bad = rows.where(
        (F.col("n") != F.lower("n"))
        | F.exists(tokens, lambda w: w.isin(*K.ADMIN_TOKENS))
        | F.col("n").rlike("  |^ | $")
    )
    assert bad.count() == 0


def test_strip_html(spark):
    cases = {
        "<script>alert('x')</script>Jl. <b>Braga</b>": "Jl. Braga",
        "a<style>p{}</style>b<!-- c > d -->e": "abe",
        "Jl. Sudirman A &amp; B": "Jl. Sudirman A &amp; B",
        "5 < 6 > 4": "5 < 6 > 4",
        "x<SCRIPT src=1>y": "x",
    }
    df = spark.createDataFrame([(k,) for k in cases], "a string")
    for r in df.select("a", T.strip_html(F.col("a")).alias("s")).collect():
        assert r.s == cases[r.a]


def test_request_error(spark):
    df = spark.createDataFrame([("",), (" ",), ("é" * 500,), ("é" * 501,), (None,)], "a string")
    got = [r[0] for r in df.select(T.request_error(F.col("a"))).collect()]
    too_long = "address exceeds maximum length of 1000 characters"
    assert got == ["address is required", None, None, too_long, "address is required"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("jl gatot subroto no bandung 40115 40116",
         [("postal_code", "40115"), ("place_name", "gatot"), ("place_name", "subroto"),
          ("place_name", "no"), ("place_name", "bandung")]),
        ("gang jl a a b a", [("place_name", "a"), ("place_name", "b")]),
        ("", []),
    ],
)
def test_evidence(spark, text, want):
    df = spark.createDataFrame([(text,)], "n string").select(
        T.extract_evidence(F.col("n")).alias("e"), T.evidence_values(F.col("n")).alias("v")
    )
    row = df.first()
    assert [(e.type, e.value) for e in row.e] == want
    assert row.v == [v for _, v in want]


def test_first_code_and_format_and_same(spark):
    df = spark.createDataFrame([("a 40115, 40116", "", "B", None, "D", "1")], "a string, s string, d string, c string, p string, z string")
    c = [F.col(x) for x in "sdcpz"]
    r = df.select(
        T.first_postal_code(F.col("a")).alias("x"),
        T.format_location(*c).alias("f"),
        T.same_text(F.lit(" Kota X"), F.lit("kota x ")).alias("eq"),
        T.same_text(F.lit(None).cast("string"), F.lit("")).alias("eq2"),
    ).first()
    assert (r.x, r.f, r.eq, r.eq2) == ("40115", "B, D 1", True, True)


def test_normalize_equals_its_steps(spark):
    """T9 fuses T5 and T7; taken one by one they give the same text."""
    def by_steps(c):
        folded = T.fold_words(T.unescape_newlines(c))
        kept = T.squeeze(T.letters_only(T.squeeze(T.drop_admin_tokens(folded))))
        return F.trim(F.concat_ws(" ", kept, F.array_join(T.postal_codes(folded), " ")))

    texts = [a for a, _ in PAIRS] + ["Kota kota Nila kab. 90210 90211", "kec.kec kec", "A\\nkota\\nB 12345 x"]
    rows = spark.createDataFrame([(t,) for t in texts], "a string").select(
        "a", T.normalize(F.col("a")).alias("n"), by_steps(F.col("a")).alias("m"))
    for r in rows.collect():
        assert r.n == r.m, r.a
