"""Step operators on one partitioning: exchanges, limits and balanced tasks of their plans."""

import mini
import pytest
from pyspark.sql import functions as F

from alamatika.bindings import queries as Q
from alamatika.operators import candidates as C
from alamatika.operators import evaluation as E
from alamatika.operators import matching as M
from alamatika.operators import gazetteer as G
from alamatika.operators import resolution as R
from alamatika.plans import validate as V
from alamatika.sources.regions import parent_maps

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["phrase_longest", "phrase_greedy", "resolve_evidence", "conclude", "evaluate_candidates", "rank"])
def test_one_exchange_of_addresses(spark, name):
    plan = plan_of(Q.QUERIES[name](spark, SF))
    # others are of the dictionary, the registry and the parent maps
    assert plan.count("Exchange hashpartitioning(address_id") == 1
    assert plan.count("orders.parquet") == 1


def test_window_group_limit(spark):
    assert "WindowGroupLimit" in plan_of(Q.QUERIES["ambiguity"](spark, SF))


@pytest.fixture(scope="module")
def gaz(spark):
    return mini.gazetteer(spark)


def test_fused_steps_equal_single_ones(spark, gaz):
    texts = V.prepare(mini.requests(spark), gaz.registry)
    phrases = G.phrase_dict(gaz.regions)
    words = M.match_phrases(texts, phrases, gaz.max_words)
    single = M.resolve_evidence(M.evidence(texts), words, phrases)
    chosen = V.choose_phrases(V.prepare(V.dealt(mini.requests(spark), gaz), gaz.registry), gaz)
    fused = M.resolve_chosen(chosen, M.tagged_entities(phrases))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, single.collect())) == sorted(map(key, fused.select(*single.columns).collect()))
    old = C.conclude(
        C.enrich(C.discover(C.roots(single)), parent_maps(gaz.hierarchy), gaz.regions, True), single)
    new = C.conclude_rows(V.expand_candidates(chosen, gaz, with_evidence=True))
    columns = sorted(set(old.columns) & set(new.columns))
    assert set(old.columns) <= set(new.columns) | {"cand_key"}
    assert sorted(map(key, old.select(*columns).collect())) == sorted(map(key, new.select(*columns).collect()))
    maps = parent_maps(gaz.hierarchy)
    judged = E.evaluate(new, maps, True)
    ranked = R.winners(R.rank(judged)).select("address_id", "cand_id", "status", "confidence", "next_confidence")
    limited = R.winners(R.top_two(judged)).select(*ranked.columns)
    assert sorted(map(key, ranked.collect())) == sorted(map(key, limited.collect()))


def test_lookups_by_shuffle_are_balanced(spark):
    """A third of the rows without an id, a third in one popular city, no broadcast."""
    n = 24_000
    kind = F.col("id") % 3
    rows = spark.range(n).select(
        F.col("id").cast("string").alias("address_id"), F.lit("c").alias("cand_id"),
        F.lit(None).cast("long").alias("province_id"),
        F.when(kind == 1, F.lit(7)).when(kind == 2, F.col("id") % 500).cast("long").alias("city_id"),
        F.lit(None).cast("long").alias("district_id"), F.lit(None).cast("long").alias("subdistrict_id"),
        F.lit(None).cast("long").alias("postal_id"), F.lit(None).cast("string").alias("postal_code"),
        F.lit(None).cast("string").alias("own_postal"))
    pairs = {
        child: spark.range(500).select(F.col("id").alias(child), (F.col("id") % 30 + 1).alias(parent))
        for child, parent in (("city_id", "province_id"), ("district_id", "city_id"), ("subdistrict_id", "district_id"))}
    regions = spark.range(1, 31).select(
        "id", F.lit(2).alias("level_id"), F.lit(None).cast("timestamp").alias("deleted_at"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        enriched = C.enrich(rows, pairs, regions)
        judged = E.hierarchy_conflict(rows.withColumn("province_id", F.lit(2).cast("long")), pairs)
        for out in (enriched, judged):
            assert "BroadcastHashJoin" not in plan_of(out)
            sizes = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
            assert sum(sizes) == n and len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
        assert {(r["city_id"], r["province_id"]) for r in enriched.collect()} == {
            (None, None), *((c, c % 30 + 1) for c in range(500) if any(i % 3 == 2 and i % 500 == c for i in range(1500))), (7, 8)}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
