"""End-to-end goldens on the small gazetteer, broadcast and shuffle plans."""

import mini
import pytest
from pyspark.sql import functions as F

from alamatika.operators.resolution import rank
from alamatika.plans import validate as V


@pytest.fixture(scope="module")
def gaz(spark):
    return mini.gazetteer(spark)


def check(spark, gaz):
    requests = mini.requests(spark)
    responses = {r.address_id: r for r in V.validate(requests, gaz).collect()}
    texts = V.prepare(requests, gaz.registry)
    gathered = V.gather(
        V.score_candidates(V.expand_candidates(V.choose_phrases(texts, gaz), gaz))
    )
    ranked = {
        r.address_id: [(-c.o.minus_confidence, c.o.kode) for c in r.ranked]
        for r in gathered.collect()
    }
    for i, (_, normal, status, want, unused) in enumerate(mini.GOLDENS, 1):
        got = responses[str(i)]
        assert (got.normalized_input, got.status) == (normal, status), i
        assert ranked[str(i)] == want, i
        assert got.confidence == (want[0][0] if want else 0.0), i
        assert " ".join(got.assessment.ambiguous) == unused, i
    return responses


def test_goldens(spark, gaz):
    got = check(spark, gaz)
    assert gaz.small == {"phrases", "lexicon", "guesses", "hierarchy"}
    seven = got["7"]
    assert seven.formatted_address == "Citarum, Bandung Wetan, Kota Bandung, Jawa Barat 40115"
    assert seven.resolution.strategy == ["postal_code_inferred"]
    assert seven.assessment.conflicts is None and seven.assessment.matched == []
    ten = got["10"]
    assert ten.location.postal_code == "10110" and ten.location.province == ""
    assert ten.resolution.strategy[-1] == "postal_code_lookup"
    assert ten.resolution.candidates == []
    three = got["3"]  # the winner shows the lookup among the candidates too
    assert three.resolution.candidates[0].reasons[-1] == "postal_code_lookup"
    assert [c.location.city for c in three.resolution.candidates] == ["Kota Bandung"]
    four = got["4"]
    assert four.resolution.candidates[0].reasons == [
        "exact_match", "match_city", "match_subdistrict", "match_postal_code_exact"]


def test_goldens_by_shuffle_join(spark):
    """A gazetteer above the broadcast bound gives the same result without broadcasts."""
    gaz = mini.gazetteer(spark, max_broadcast_bytes=0)
    assert not gaz.small
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check(spark, gaz)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_exchange(spark, gaz):
    """Apart from the small registry and dictionary sides there is one exchange."""
    plan = V.validate(mini.requests(spark), gaz)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(address_id") == 1


def test_repeated_and_shared_ids(spark, gaz):
    """A retry is answered once; one id with several texts gets an answer for each."""
    rows = mini.requests(spark).withColumn("address_id", F.lit("same"))
    got = V.validate(rows.unionByName(rows), gaz).collect()
    single = {r.raw_input: r for r in V.validate(mini.requests(spark), gaz).collect()}
    assert sorted(r.raw_input for r in got) == sorted(single)
    for r in got:
        assert (r.status, r.confidence, r.location) == tuple(single[r.raw_input][c] for c in ("status", "confidence", "location"))


def test_unknown_source_and_rejects(spark, gaz):
    from alamatika.sources import requests as Q

    rows = spark.createDataFrame(
        [("a", "Bandung", "x"), ("b", "", ""), ("c", "y" * 1001, ""), ("d", "Bandung", "kemendagri")],
        "address_id string, address string, source_code string",
    )
    assert [r.address_id for r in V.validate(rows, gaz).collect()] == ["d"]
    routed = {r.address_id: (r.http_status, r.reject_reason) for r in Q.route(rows, gaz.registry).collect()}
    assert routed == {
        "a": (500, "unknown location source"),
        "b": (400, "address is required"),
        "c": (400, "address exceeds maximum length of 1000 characters"),
        "d": (200, None),
    }


def test_hot_text_and_copies(spark, gaz):
    """Copies of one address stay apart and all get the same answer."""
    rows = spark.range(3000).select(
        F.col("id").cast("string").alias("address_id"),
        F.when(F.col("id") % 3 == 0, F.lit(mini.GOLDENS[5][0])).otherwise(
            F.concat(F.lit("Jl. X "), F.col("id").cast("string"))).alias("address"),
        F.lit("").alias("source_code"),
    )
    out = V.validate(rows, gaz)
    counts = {r.status: r["count"] for r in out.groupBy("status").count().collect()}
    assert counts == {"AMBIGUOUS": 1000, "UNKNOWN": 2000}


def test_rank_ties_are_stable(spark):
    rows = spark.createDataFrame(
        [("a", "c2", "2", 0.37, 1, 2), ("a", "c1", "1", 0.37, 1, 2), ("a", "c3", "0", 0.37, None, 2)],
        "address_id string, cand_id string, kode string, confidence double, province_id int, city_id int",
    )
    for c in ("district_id", "subdistrict_id"):
        rows = rows.withColumn(c, F.lit(None).cast("int"))
    rows = rows.withColumn("conflicts", F.array().cast("array<string>"))
    got = {r.cand_id: r["rank"] for r in rank(rows).collect()}
    assert got == {"c1": 1, "c2": 2, "c3": 3}
