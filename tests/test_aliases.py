"""Other names of regions (X2): dictionary, one plan, candidates; labels that travel along (B1); roll-up."""

import mini
import pytest
from pyspark.sql import functions as F

from alamatika.functions import constants as K
from alamatika.operators import accuracy as A
from alamatika.operators import candidates as C
from alamatika.operators import gazetteer as G
from alamatika.operators import matching as M
from alamatika.plans import accuracy as PA
from alamatika.plans import validate as V
from alamatika.plans.gazetteer import Gazetteer

ID = {kode: i + 1 for i, (kode, *_) in enumerate(mini.ROWS)}
ALIASES = [
    (ID["31"], "Batavia", None), (ID["31"], "BATAVIA.", None), (ID["31"], "Prov. DKI Jakarta", None),
    (ID["32.71"], "Buitenzorg", None), (ID["32.01"], "Buitenzorg", None),  # shared by two
    (ID["32.73"], "Kota Kembang", None), (ID["32.73"], "Paris van Java", None),
    (ID["32"], "Pasundan", "2025-01-01"), (ID["32"], None, None), (ID["32"], "", None), (ID["32"], "77", None),
    (ID["32.73.19.1001"], "Jl. Braga Permai", None), (ID["32.73.09.1001"], "Jalan Gang", None),
    (9999, "Nowhere", None), (None, "Nobody", None),
]


@pytest.fixture(scope="module")
def aliases(spark):
    return spark.createDataFrame(ALIASES, "location_id long, alias string, gone string").select(
        "location_id", "alias", F.col("gone").cast("timestamp").alias("deleted_at"), F.lit(1).alias("phrase"))


@pytest.fixture(scope="module")
def gaz(spark, aliases):
    return Gazetteer.build(mini.sources(spark), mini.regions(spark), aliases=aliases)


def test_dictionary(spark, aliases):
    regions = mini.regions(spark)
    got = {(r["entity_id"], r["phrase"]) for r in G.alias_index(aliases, regions).collect()}
    assert got == {
        (ID["31"], "batavia"), (ID["32.71"], "buitenzorg"), (ID["32.01"], "buitenzorg"), (ID["32.73"], "kembang"),
        (ID["32.73"], "paris van java"), (ID["32.73.19.1001"], "jl braga permai"), (ID["32.73.09.1001"], "jalan gang")}
    gone = regions.withColumn("deleted_at", F.when(F.col("id") == ID["31"], F.current_timestamp()))
    assert "batavia" not in {r["phrase"] for r in G.named_phrases(gone, aliases).collect()}
    # a region without a word of its own is found by its alias only
    bare = regions.withColumn("norm_name", F.when(F.col("id") == ID["31"], "").otherwise(F.col("norm_name")))
    rows = G.lexicon(bare, G.flatten_hierarchy(bare), aliases).where(F.col("entity_id") == ID["31"]).collect()
    assert sorted((r["phrase"], r["origin"], r["place_words"]) for r in rows) == [
        ("batavia", K.BY_ALIAS, 1), ("dki jakarta", K.BY_ALIAS, 2)]


def answers(spark, gaz, *texts):
    rows = spark.createDataFrame([(str(i), t, "") for i, t in enumerate(texts)], "address_id string, address string, source_code string")
    return [r for r in sorted(V.validate(rows, gaz).collect(), key=lambda r: int(r["address_id"]))]


def found(row):
    return [(c["matched_name"], c["strategies"][2:], c["score"]) for c in row["resolution"]["candidates"]]


def test_found_by_alias(spark, gaz):
    own, alias, both, shared, deleted = answers(
        spark, gaz, "DKI Jakarta", "Batavia", "Batavia DKI Jakarta", "Buitenzorg", "Pasundan")
    assert found(alias) == [("batavia", ["alias"], 0.25)]
    assert alias["formatted_address"] == own["formatted_address"] == "DKI Jakarta"
    # the level scores once; more words of one region are the repeated evidence that they are
    assert found(own) == [("dki jakarta", [], 0.45)] and found(both) == [("dki jakarta", [], 0.45)]
    assert both["assessment"]["ambiguous"] == []
    # two cities share it; one has no province here and is ranked but not listed
    assert [c[0] for c in found(shared)] == ["buitenzorg"]
    assert deleted["status"] == K.UNKNOWN


def test_parents_confirmed_by_alias(spark, gaz):
    plain, alias = answers(spark, gaz, "Citarum, Bandung Wetan, Jawa Barat", "Citarum, Bandung Wetan, Kota Kembang, Jawa Barat")
    assert "match_city" not in plain["resolution"]["strategy"] and "match_city" in alias["resolution"]["strategy"]
    # an alias without a place word is found and is evidence for nothing
    (road,) = answers(spark, gaz, "Jalan Gang")
    assert road["resolution"]["candidates"] == []


def test_same_by_shuffle_and_by_steps(spark, gaz, aliases):
    texts = ["Batavia", "Batavia DKI Jakarta", "Buitenzorg Jawa Barat", "Paris van Java Kota Kembang", "Bogor Buitenzorg",
             "Jl. Braga Permai 40111", "Bandung Kota Kembang Pasundan"]
    rows = spark.createDataFrame([(str(i), t, "") for i, t in enumerate(texts)], "address_id string, address string, source_code string")
    shuffled = Gazetteer.build(mini.sources(spark), mini.regions(spark), aliases=aliases, max_broadcast_bytes=0)
    key = lambda r: r["address_id"]
    whole = sorted(V.validate(rows, gaz).collect(), key=key)
    assert whole == sorted(V.validate(rows, shuffled).collect(), key=key)
    phrases = G.named_phrases(mini.regions(spark), aliases)
    prepared = V.prepare(rows, gaz.registry)
    words = M.match_phrases(prepared, phrases, gaz.max_words)
    cands = C.discover(C.roots(M.resolve_evidence(M.evidence(prepared), words, phrases))).collect()
    steps = {(c["address_id"], c["cand_id"]): (c["matched_name"], c["strategies"]) for c in cands}
    listed = {(r["address_id"], c["uuid"]): (c["matched_name"], c["strategies"]) for r in whole for c in r["resolution"]["candidates"]}
    assert {k: steps[k] for k in listed} == listed and len(listed) >= 8
    plan = V.validate(rows, gaz)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(address_id") == 1


def test_labels_travel_along(spark, gaz):
    labels = [
        ("a", "Citarum Kota Bandung", "", "Kota Bandung", "", "Citarum", 1),
        ("a", "Citarum Kota Bandung", "", "Kota Bandung", "", "Citarum", 1),  # repeats in full
        ("a", "Citarum Kota Bandung", "", "Kota Bogor", "", "Citarum", 1),  # other truth
        ("b", "", "Jawa Barat", "", "", "", 2), (None, None, None, None, None, None, 3),
        ("c", "x" * 2000, "", "", "", "", 4)]
    df = spark.createDataFrame(labels, "address_id string, raw_address string, actual_province string, actual_city string, "
                                       "actual_district string, actual_subdistrict string, status int")
    got = PA.replay(df, gaz, keep=("status",)).collect()
    rows = sorted((r["address_id"] or "", r["status"], r["same_city"], r["quality"] is None) for r in got)
    assert rows == [("", 3, False, True), ("a", 1, False, False), ("a", 1, True, False), ("a", 1, True, False),
                    ("b", 2, False, True), ("c", 4, False, True)]
    plan = PA.replay(df, gaz)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(address_id") == 1


def test_rollup(spark):
    rows = [("s", "p", 1, True, False, False, True), ("s", "p", 1, True, True, False, False), ("s", None, None, False, False, False, False),
            ("t", "p", 1, True, True, True, True)]
    df = spark.createDataFrame(rows, "source string, province string, quality int, same_province boolean, same_city boolean, "
                                     "same_district boolean, same_subdistrict boolean")
    got = {(r["source"], r["province"], r["level"]): r for r in A.rollup(df, ("source", "province")).collect()}
    whole = got["*", "*", "*"]
    assert (whole["labels"], whole["answered"], whole["correct"], whole["accuracy"]) == (16, 12, 8, 0.5)
    city = got["*", "p", "city"]
    assert (city["labels"], city["correct"]) == (3, 2)
    # Wilson's interval of 2 in 3, from tables
    assert (city["low"], city["high"]) == (0.2077, 0.9385)
    assert got["s", None, "city"]["low"] == 0.0 and got["t", "*", "*"]["high"] == 1.0
    assert len(got) == 5 * (3 + 2 + 3)
    assert A.rollup(df.limit(0), ("source", "province")).count() == 0
    plan = A.rollup(df, ("source", "province"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") == 2
