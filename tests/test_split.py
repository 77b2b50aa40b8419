"""A large lexicon in two parts gives what the whole one gives, in few and narrow exchanges."""

import mini
import pytest
from pyspark.sql import functions as F
from test_aliases import aliases  # noqa: F401
from test_validate import check

from alamatika.bindings import queries as Q
from alamatika.operators import candidates as C
from alamatika.operators import evaluation as E
from alamatika.operators import gazetteer as G
from alamatika.operators import matching as M
from alamatika.plans import validate as V
from alamatika.plans.gazetteer import Gazetteer
from alamatika.sources import labelled
from alamatika.sources.regions import parent_maps
from alamatika.sources.request_log import append_log


def odd_requests(spark):
    """The goldens and some more: repeats, a name twice, a key like a chain's, aliases."""
    more = [
        (":10", "Citarum citarum, Kec. Bandung Wetan", ""), (":10", "", ""), ("x", "Lepas, Bandung", ""),
        ("x", "Ciomas Ciomas 16610", ""), ("y", "Kel. Braga Permai Jl. Braga Permai, Paris van Java", ""),
        ("z", "Kembang, Buitenzorg, Batavia, Jalan Gang Citarum", "kemendagri"), ("q", "Citarum", "bps"),
    ]
    rows = mini.requests(spark)
    return rows.unionByName(rows.limit(3)).unionByName(spark.createDataFrame(more, rows.schema))


def regions(spark):
    """With a subdistrict whose district is missing."""
    lone = spark.createDataFrame(
        [(99, 1, "32.99.01.1001", "Lepas", "40999")], "id long, source_id long, kode string, name string, postal_code string"
    ).withColumns({"level_id": F.lit(5), "norm_name": F.lit("lepas"), "deleted_at": F.lit(None).cast("timestamp")})
    return mini.regions(spark).unionByName(lone)


def built(spark, other, **kw):
    return Gazetteer.build(mini.sources(spark), regions(spark), aliases=other, **kw)


def texts(df):
    return sorted(r["t"] for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("t")).collect())


def test_goldens(spark):
    gaz = mini.gazetteer(spark, max_lexicon_bytes=0)
    assert gaz.split is not None and mini.gazetteer(spark).split is None
    check(spark, gaz)


@pytest.mark.parametrize("named", [False, True])
def test_same_answers(spark, aliases, named):  # noqa: F811
    other = aliases if named else None
    whole, split = built(spark, other), built(spark, other, max_lexicon_bytes=0)
    rows = odd_requests(spark)
    assert texts(V.validate(rows, whole)) == texts(V.validate(rows, split))

    def concluded(gaz):
        chosen = V.choose_phrases(V.prepare(rows, gaz.registry), gaz)
        done = C.conclude_rows(V.expand_candidates(chosen, gaz, with_evidence=True))
        return done.withColumn("evidence", F.sort_array("evidence"))

    assert texts(concluded(whole)) == texts(concluded(split))


def test_sieve_lets_every_name_through(spark):
    names = spark.range(5000).select(
        (F.col("id") % 3).alias("source_id"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("phrase"))
    n = G.sieve_words(5000)
    table = G.sieve(names, n)
    other = names.withColumn("phrase", F.concat(F.lit("x"), "phrase"))

    def passed(df):
        hit = df.withColumns({"word": G.sieve_word(n), "mask": G.sieve_mask()}).join(table, "word")
        return hit.where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).count()

    assert passed(names) == 5000 and passed(other) < 150


def test_candidates_are_not_exchanged(spark):
    """Addresses are dealt, narrow rows ask for names, and all meet before candidates are made."""
    gaz = built(spark, None, max_lexicon_bytes=0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = V.validate(mini.requests(spark), gaz)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(address_id") == 2
    keyed = [line for line in plan.split("\n") if "Exchange hashpartitioning(source_id" in line]
    assert len(keyed) == 2 and all("ask#" in line for line in keyed)


def test_candidates_of_aliases(spark, aliases):  # noqa: F811
    """The step for large tables finds what the single steps find."""
    gaz = built(spark, aliases)
    rows = odd_requests(spark).where("address_id NOT IN (':10', 'x')").distinct()  # single steps go by id
    texts_ = V.prepare(rows, gaz.registry)
    phrases = G.named_phrases(gaz.regions, aliases)
    words = M.match_phrases(texts_, phrases, gaz.max_words)
    single = C.discover(C.roots(M.resolve_evidence(M.evidence(texts_), words, phrases)))
    columns = ("address_id", "cand_id", "origin_level", "strategies", "matched_name")
    for way in (gaz, built(spark, aliases, max_lexicon_bytes=0)):
        done = C.conclude_rows(V.expand_candidates(V.choose_phrases(texts_, way), way, with_evidence=True))
        assert texts(done.select(*columns)) == texts(single.select(*columns))


def test_accuracy_records_are_compressed(spark, tmp_path):
    """Records repeat the same regions over and over, so plain JSON filled the disk."""
    rows = spark.range(2000).select("id", F.lit("Kota Bandung").alias("city"), F.lit(None).cast("string").alias("none"))
    labelled.write_accuracy(rows, str(tmp_path / "acc"), "r1")
    files = [f for f in (tmp_path / "acc" / "run_id=r1").iterdir() if f.name.startswith("part-")]
    assert files and sum(f.stat().st_size for f in files) < 40_000
    back = spark.read.schema("id long, city string, none string, run_id string").json(str(tmp_path / "acc"))
    assert texts(back.drop("run_id")) == texts(rows) and back.where("run_id = 'r1'").count() == 2000


def test_log_is_compressed(spark, tmp_path):
    append_log(V.validate(mini.requests(spark), mini.gazetteer(spark)), str(tmp_path / "log"))
    assert list((tmp_path / "log").glob("day=*/*.zstd.parquet"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == len(mini.GOLDENS)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_resolved_evidence(spark):
    """M7, M9 and C1..C11 from a split lexicon are those from a whole one."""
    gaz = built(spark, None, max_lexicon_bytes=0)
    phrases = G.phrase_dict(gaz.regions)
    rows = V.prepare(odd_requests(spark), gaz.registry)
    chosen = V.choose_phrases(rows, gaz)
    whole = M.resolve_chosen(V.choose_phrases(rows, built(spark, None)), M.tagged_entities(phrases))
    split = M.resolve_split(chosen, phrases, 3)
    places = M.resolve_places(chosen, phrases)
    assert texts(split.select(*whole.columns)) == texts(whole)
    assert texts(places.select(*whole.columns)) == texts(whole.where("type = 'place_name'"))
    maps = parent_maps(gaz.hierarchy)
    new = C.enrich(C.discover(C.roots(places)), maps, gaz.regions, True)
    old = C.enrich(C.discover(C.roots(whole)), maps, gaz.regions, True)
    assert new.columns == old.columns and texts(new) == texts(old)


def test_roots_are_not_exchanged(spark):
    gaz = built(spark, None, max_lexicon_bytes=0)
    phrases = G.phrase_dict(gaz.regions)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts_ = V.prepare(V.dealt(mini.requests(spark), gaz), gaz.registry)
        places = M.resolve_places(V.choose_phrases(texts_, gaz), phrases)
        done = C.enrich(C.discover(C.roots(places)), parent_maps(gaz.hierarchy), gaz.regions, True)
        assert plan_of(done).count("Exchange hashpartitioning(address_id") == 2  # texts, then texts with their names
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_postal_lookup_keeps_its_tasks(spark):
    """Few codes of many regions: rows grow in every task, none is merged away, none gets most."""
    phrases = spark.range(3000).select(
        F.lit(1).cast("long").alias("source_id"), F.lit("p").alias("phrase"), F.col("id").alias("entity_id"),
        F.lit("SUBDISTRICT").alias("level"), F.lit("k").alias("kode"), F.lit("n").alias("name"),
        F.when(F.col("id") % 3 == 0, F.lit("40000")).otherwise((F.col("id") % 30 + 40000).cast("string")).alias("postal_code"))
    asked = spark.range(600).select(
        F.col("id").cast("string").alias("address_id"), F.lit(1).cast("long").alias("source_id"), F.lit(0).alias("ev_pos"),
        F.lit("postal_code").alias("type"), F.when(F.col("id") % 2 == 0, F.lit("40000")).otherwise(
            (F.col("id") % 30 + 40000).cast("string")).alias("value"))
    done = M.resolve_postal(asked, phrases, 24)
    sizes = [r["count"] for r in done.groupBy(F.spark_partition_id()).count().collect()]
    want = M.resolve_postal(asked, phrases)
    assert done.columns == want.columns and texts(done) == texts(want)
    assert len(sizes) > 8 and max(sizes) < sum(sizes) / 2


def test_chains_of_candidates_have_no_broken_link(spark):
    """E1 by lookup finds nothing in candidates whose chains came from the same parent maps."""
    gaz = built(spark, None)
    chosen = V.choose_phrases(V.prepare(odd_requests(spark), gaz.registry), gaz)
    done = C.conclude_rows(V.expand_candidates(chosen, gaz, with_evidence=True))
    assert texts(E.evaluate(done, None)) == texts(E.evaluate(done, parent_maps(gaz.hierarchy), True))
    assert done.where("district_id IS NOT NULL AND subdistrict_id IS NOT NULL").count() > 0
    # ... so the registered queries do not look candidates up, which exchanged them above the broadcast bound
    plan = plan_of(Q.QUERIES["rank"](spark, "/root/testdata/sf0.001"))
    assert "_up_city_id" not in plan and "max(province_id" not in plan


def test_evidence_is_found_by_the_words_of_names(spark):
    """candidates do not walk the evidence of their text for each of their levels."""
    plan = Q.QUERIES["match_evidence"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(all_evidence" not in plan


def exchanged(plan, key):
    """Per exchange on the key the line of the plan below it, which lists its columns."""
    lines = plan.split("\n")
    return [lines[i + 1] for i, line in enumerate(lines) if f"Exchange hashpartitioning({key}" in line]


@pytest.mark.parametrize("named", [False, True])
def test_texts_are_dealt_once(spark, aliases, named):  # noqa: F811
    """Alias queries filled the disk: texts and names above went along to the lookup by name."""
    gaz = built(spark, aliases if named else None, max_lexicon_bytes=0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(V.validate(mini.requests(spark), gaz))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    asked = exchanged(plan, "source_id")
    assert len(asked) == 2 and not any(c in line for line in asked for c in ("payload", "normalized", "alias_of"))
    assert sorted("raw_input" in line for line in exchanged(plan, "address_id")) == [False, True]


def test_names_of_both_parts(spark, aliases):  # noqa: F811
    """A span that is found above and below counts once, also in repeats and without an id."""
    rows = spark.createDataFrame(
        [("a", "Ciomas, Bogor", ""), ("a", "Ciomas, Bogor", ""), (None, "Kec. Ciomas Kel. Ciomas 16610", ""),
         (None, "Ciomas", ""), ("b", "Ciomas", "bps"), ("c", "Nusantara", ""), ("d", None, "")], mini.requests(spark).schema)
    for other in (None, aliases):
        whole, split = built(spark, other), built(spark, other, max_lexicon_bytes=0)
        got = [V.answer(rows, gaz, refused=True) for gaz in (whole, split)]
        assert texts(got[0]) == texts(got[1]) and got[1].where("times = 2").count() == 1


def test_codes_do_not_choose_phrases(spark):
    """postal evidence is read from the texts; the choice of phrases is planned once, not twice."""
    gaz = built(spark, None, max_lexicon_bytes=0)
    phrases = G.phrase_dict(gaz.regions)
    rows = V.told_apart(V.prepare(odd_requests(spark), gaz.registry))
    chosen = V.choose_phrases(rows, gaz)
    got, want = M.resolve_split(chosen, phrases, 3, rows), M.resolve_split(chosen, phrases, 3)
    assert got.columns == want.columns and texts(got) == texts(want)
    assert got.where("type = 'postal_code'").count() > 5
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [plan_of(M.resolve_split(chosen, phrases, 3, *given)) for given in ((rows,), ())]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [sum("ask#" in line for line in exchanged(plan, "source_id")) for plan in plans] == [2, 4]


def test_alias_candidates_look_up_narrow_rows(spark, aliases, monkeypatch):  # noqa: F811
    """the registered query exchanges texts by address alone, in as many tasks as asked for."""
    gaz = built(spark, aliases, max_lexicon_bytes=0)
    monkeypatch.setattr(Q.B, "gazetteer_with_aliases", lambda *_: gaz)
    monkeypatch.setattr(V, "ADDRESSES_A_TASK", 60)
    tasks = V.tasks_for(Q.B.alias_requests(spark, "/root/testdata/sf0.001"), gaz)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(Q.QUERIES["alias_candidates"](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    asked = [line for line in exchanged(plan, "source_id") if "ask#" in line]
    assert len(asked) == 2 and not any("payload" in line or "raw_input" in line for line in asked)
    dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning(address_id" in line]
    assert len(dealt) == 2 and tasks > 8 and all(f", {tasks})" in line for line in dealt)
