"""Sources, seeding, sinks, accuracy replay and the stream."""

import json

import mini
import pytest
from pyspark.sql import functions as F

from alamatika.operators import gazetteer as G
from alamatika.plans import accuracy as PA
from alamatika.plans import gazetteer as PG
from alamatika.plans import validate as V
from alamatika.sources import dumps, labelled
from alamatika.sources import requests as Q
from alamatika.sources.request_log import append_log
from alamatika.streaming import validator

REGIONS = """-- dump
INSERT INTO t VALUES
('32','Jawa Barat'),
('32.73','Kota Bandung'),('99','ignored'),
('32.73.09','Bandung  Wetan'),
('32.73.09.1001','Ma''rang'),
('32.73.09.1001','late copy'),
('33.01.01.2001','Orphan');
"""
CODES = """('32.73.09.1001','40115'),
('32.73.09.1001', '40116'),
('32.73.09.1001',''),
('77','12345'),
"""


def empty(spark, schema):
    return spark.createDataFrame([], schema)


SOURCE_SCHEMA = (
    "id long, code string, version string, name string, code_date string, desc string, deleted_at timestamp")
REGION_SCHEMA = (
    "id long, source_id long, kode string, name string, norm_name string, level_id int, "
    "postal_code string, deleted_at timestamp")


def seed(spark, tmp_path, sources, regions, version="2025"):
    (tmp_path / "r.sql").write_text(REGIONS)
    (tmp_path / "c.sql").write_text(CODES)
    return PG.seed_from_dumps(
        str(tmp_path / "r.sql"), str(tmp_path / "c.sql"), sources, regions,
        code="kemendagri", version=version, name="n")


def test_seed_and_reseed(spark, tmp_path):
    sources, new = seed(spark, tmp_path, empty(spark, SOURCE_SCHEMA), empty(spark, REGION_SCHEMA))
    path = str(tmp_path / "regions")
    PG.save_regions(new, path)
    regions = spark.read.parquet(path).select(*G.REGION_COLUMNS)
    got = {r.kode: (r.name, r.norm_name, r.level_id, r.postal_code) for r in regions.collect()}
    assert got == {
        "32": ("Jawa Barat", "jawa barat", 2, None),
        "32.73": ("Kota Bandung", "bandung", 3, None),
        "32.73.09": ("Bandung  Wetan", "bandung wetan", 4, None),
        "32.73.09.1001": ("Ma'rang", "marang", 5, "40116"),
        "33.01.01.2001": ("Orphan", "orphan", 5, None),
    }
    assert sources.count() == 1
    assert regions.select("id").distinct().count() == 5
    # seeding again adds nothing; a new version is a new source with all rows
    again, none = seed(spark, tmp_path, sources, regions)
    assert again.count() == 1 and none.count() == 0
    both, more = seed(spark, tmp_path, sources, regions, version="2026")
    assert both.count() == 2 and more.count() == 5
    latest = G.latest_sources(both).first()
    assert latest.version == "2026" and latest.id > sources.first().id
    assert {r.source_id for r in more.select("source_id").distinct().collect()} == {latest.id}
    hierarchy = G.flatten_hierarchy(regions)
    assert hierarchy.count() == 1
    rejects = G.hierarchy_rejects(regions).collect()
    assert [(r.kode, r.reason) for r in rejects] == [("33.01.01.2001", "parent province not found")]


def test_reload_replaces_one_source_only(spark, tmp_path):
    path = str(tmp_path / "regions")
    rows = mini.regions(spark).select(*G.REGION_COLUMNS)
    PG.save_regions(rows, path)
    PG.save_regions(rows.where("level_id = 2").withColumn("source_id", F.lit(2).cast("long")), path)
    PG.save_regions(rows.where("level_id = 2"), path, mode="overwrite")
    got = {r.source_id: r["count"] for r in spark.read.parquet(path).groupBy("source_id").count().collect()}
    assert got == {1: 4, 2: 4}


def test_dump_levels(spark):
    lines = spark.createDataFrame([(1, "x ('11.01.01.2001','Desa') y"), (2, "no tuple"), (3, "('11', 'A')")],
                                  "line_pos int, value string")
    assert {(r.kode, r.name, r.level_id) for r in dumps.parse_regions(lines).collect()} == {
        ("11.01.01.2001", "Desa", 5), ("11", "A", 2)}


CSV = '''Source,SERP,Address Raw,Province,City,District,Subdistrict
S,u,"Gg. Kenari 12 BANDUNG",Jawa Barat,Kota Bandung,Lengkong,Lingkar Selatan

S,u,"Gg. Melati 9,
Kel. Braga ""x"", Kota Bandung", jawa barat ,KOTA BANDUNG,Sumur Bandung,Braga
S,u
S,u,Gg. Asri 5 bandung 40115,Jawa Barat,Kota Bandung,,
'''


@pytest.mark.parametrize("sep", [",", ";"])
def test_labelled_and_replay(spark, tmp_path, sep):
    text = CSV if sep == "," else CSV.replace(",", ";")
    path = tmp_path / "cases.csv"
    path.write_text(text)
    rows = labelled.read_labelled(spark, str(path))
    got = rows.collect()
    assert len(got) == 3
    assert got[1].raw_address.startswith(f"Gg. Melati 9{sep}\nKel. Braga \"x\"")
    assert (got[1].actual_province, got[2].actual_district) == ("jawa barat", "")
    if sep == ";":
        return
    done = PA.replay(rows, mini.gazetteer(spark)).collect()
    flags = {r.raw_address[:10]: (r.same_province, r.same_city, r.same_district, r.same_subdistrict) for r in done}
    assert flags["Gg. Kenari"] == (True, True, False, False)
    assert flags["Gg. Melati"] == (True, True, True, True)
    assert flags["Gg. Asri 5"] == (True, True, True, True)


@pytest.mark.parametrize("sep", [",", ";"])
def test_empty_and_short_rows(spark, tmp_path, sep):
    lines = [
        "", "   ", "Source,SERP,Address Raw,Province,City,District,Subdistrict", "S,u,,Jawa Barat,,,",
        'S,u,"",Riau,,,', "S,u", "", '"S,x",u', "S,u,", "S,u,Riau,,", 'S,u,"a ""b"", c",p,c,d,s,extra',
    ]
    text = "\n".join(x.replace(",", sep) for x in lines) + "\n"
    (tmp_path / "x.csv").write_text(text)
    got = [(r.raw_address, r.actual_province) for r in labelled.read_labelled(spark, str(tmp_path / "x.csv")).collect()]
    want = [("", "Jawa Barat"), ("", "Riau"), ("", ""), ("Riau", ""), (f'a "b"{sep} c', "p")]
    assert sorted(got) == sorted(want)


def test_accuracy_failures_and_file(spark, tmp_path):
    from alamatika.operators import accuracy as A

    labels = spark.createDataFrame(
        [("1", "Kepulauan Riau", "Riau", "", "", ""), ("2", "", "", "", "", "")],
        "address_id string, raw_address string, actual_province string, actual_city string, "
        "actual_district string, actual_subdistrict string")
    done = PA.replay(labels, mini.gazetteer(spark))
    got = {r.address_id: r for r in done.collect()}
    assert got["1"].same_province and got["1"].same_city
    assert got["2"].quality is None and not got["2"].same_city
    counts = A.outcome_counts(done).first()
    assert (counts.succeeded, counts.failed) == (1, 1)
    labelled.write_accuracy(A.nested(done, "kemendagri"), str(tmp_path / "acc"), "r1")
    labelled.write_accuracy(A.nested(done, "kemendagri"), str(tmp_path / "acc"), "r1")
    back = spark.read.json(str(tmp_path / "acc"))
    assert back.count() == 2 and "run_id" in back.columns


def test_request_log(spark, tmp_path):
    gaz = mini.gazetteer(spark)
    append_log(V.validate(mini.requests(spark), gaz), str(tmp_path / "log"))
    append_log(V.validate(mini.requests(spark).limit(1), gaz), str(tmp_path / "log"))
    rows = spark.read.parquet(str(tmp_path / "log"))
    assert rows.count() == 13
    seven = rows.where("address_id = '7'").first()
    body = json.loads(seven.output_json)
    assert body["assessment"]["conflicts"] is None
    assert body["resolution"]["strategy"] == ["postal_code_inferred"]
    assert seven.normalized_address == body["formatted_address"]


def test_json_requests(spark, tmp_path):
    (tmp_path / "in.json").write_text(
        '{"address": "Bandung", "source_code": "kemendagri"}\n{"address": "Riau"}\nnot json\n{"address": ""}\n')
    rows = Q.with_address_ids(Q.read_requests(spark, str(tmp_path / "in.json")))
    gaz = mini.gazetteer(spark)
    routed = Q.route(rows, gaz.registry)
    got = sorted((r.http_status, r.reject_reason or "") for r in routed.collect())
    assert got == [(200, ""), (200, ""), (400, "address is required"), (400, "invalid request body")]
    assert {r.raw_input for r in V.validate(rows, gaz).collect()} == {"Bandung", "Riau"}


def test_strict_request_bodies(spark):
    bodies = {
        '{"Address": "Riau", "SOURCE_CODE": "x"}': ("Riau", "x"), '{"ADDRESS": "a", "address": "b"}': ("b", None),
        '{"address": null}': (None, None), "{}": (None, None), '{"address": "", "n": 5, "o": {}}': ("", None),
        '{"address": 5}': None, '{"address": {"a": 1}}': None, '{"address": ["x"]}': None, '[{"address": "a"}]': None,
        '[{"address": "a"}, {"address": "b"}]': None, '"text"': None, "7": None, "nothing": None, '{"address": "x"': None,
        '{"address": "a", "source_code": true}': None,
    }
    lines = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, value string")
    got = {r.k: r for r in Q.parse_requests(lines).collect()}
    for k, (body, want) in enumerate(bodies.items()):
        bad = got[k]._corrupt_record
        assert (bad, None if bad else (got[k].address, got[k].source_code)) == ((None, want) if want else (body, None)), body


def test_repeated_requests_in_a_batch(spark, tmp_path):
    gaz = mini.gazetteer(spark)
    rows = [("1", "Riau", ""), ("1", "Riau", ""), ("1", "Bandung", ""), ("2", "", ""), ("2", "", "")]
    batch = spark.createDataFrame(rows, "address_id string, address string, source_code string")
    validator.process_batch(batch, 0, gaz, str(tmp_path / "log"), str(tmp_path / "bad"))
    got = sorted((r.address_id, r.raw_input) for r in spark.read.parquet(str(tmp_path / "log")).collect())
    assert got == [("1", "Bandung"), ("1", "Riau")]
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 2


def test_no_seeding_into_a_deleted_source(spark, tmp_path):
    sources, regions = seed(spark, tmp_path, empty(spark, SOURCE_SCHEMA), empty(spark, REGION_SCHEMA))
    deleted = sources.withColumn("deleted_at", F.current_timestamp())
    with pytest.raises(Exception, match="source is deleted"):
        again, rows = seed(spark, tmp_path, deleted, regions.limit(0))
        rows.collect()


def test_ids_of_batches_stay_apart(spark):
    rows = spark.createDataFrame([("Riau",), ("Bandung",)], "address string")
    first, second = (
        {r.address_id for r in Q.with_address_ids(rows, f"batch-{b}-row-").collect()} for b in (0, 1)
    )
    assert len(first | second) == 4


def test_stream(spark, tmp_path):
    gaz = mini.gazetteer(spark)
    inbox, log, bad = (str(tmp_path / n) for n in ("in", "log", "bad"))
    mini.requests(spark).coalesce(1).write.json(inbox)
    spark.createDataFrame([("x", "", ""), ("y", "Riau", "nowhere")],
                          "address_id string, address string, source_code string").coalesce(1).write.mode(
        "append").json(inbox)
    stream = Q.read_requests(spark, inbox, stream=True)
    q = validator.start(stream, gaz, log, bad, str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination(120)
    rows = spark.read.parquet(log)
    assert rows.count() == len(mini.GOLDENS)
    assert rows.where("address_id = '4'").first().confidence == 0.72
    assert {r.address_id for r in spark.read.parquet(bad).collect()} == {"x", "y"}
    # a replayed batch replaces its own folder
    batch = Q.read_requests(spark, inbox)
    validator.process_batch(batch, 0, gaz, log, bad)
    assert spark.read.parquet(log).count() == len(mini.GOLDENS)
