"""Scores, conflicts, status and reasons with exact doubles."""


from alamatika.operators import evaluation as E

EV = "array<struct<type:string,value:string,entity_id:bigint,level:string,name:string>>"
SCHEMA = (
    "address_id string, cand_id int, province_id long, city_id long, district_id long, "
    f"subdistrict_id long, postal_id long, postal_code string, evidence {EV}, "
    "all_evidence array<struct<type:string,value:string>>"
)


def ev(entity=None, level=None, value="w", type_="place_name", name=None):
    return (type_, value, entity, level, name)


def postal(value):
    return ev(value=value, type_="postal_code")


def evaluated(spark, cases, parents=None):
    """cases: (p, c, d, s, postal_id, postal_code, evidence[, all_evidence])"""
    rows = [
        ("a", i, *[x or None for x in c[:4]], c[4] or None, c[5], c[6], c[7] if len(c) > 7 else [])
        for i, c in enumerate(cases)
    ]
    out = E.evaluate(spark.createDataFrame(rows, SCHEMA), parents)
    got = {r.cand_id: r for r in out.collect()}
    return [got[i] for i in range(len(cases))]


def hierarchy(spark):
    def pair(child, parent, rows):
        return spark.createDataFrame(rows, f"{child} long, {parent} long")

    return {
        "city_id": pair("city_id", "province_id", [(2, 1)]),
        "district_id": pair("district_id", "city_id", [(3, 2)]),
        "subdistrict_id": pair("subdistrict_id", "district_id", [(4, 3)]),
    }


def test_hierarchy(spark):
    got = evaluated(spark, [
        (1, 2, 3, 4, 0, None, []), (9, 2, 3, 4, 0, None, []), (1, 2, 9, 4, 0, None, []),
        (1, 2, 3, 9, 0, None, []), (0, 0, 0, 0, 0, None, []), (1, 0, 0, 0, 0, None, []),
        (9, 2, 9, 9, 0, None, [])], hierarchy(spark))
    assert [len(r.conflicts) for r in got] == [0, 1, 1, 1, 0, 0, 1]
    assert got[1].conflicts[0].message == "city does not belong to province"
    assert got[2].conflicts[0].message == "district does not belong to city"
    assert got[3].conflicts[0].message == "sub-district does not belong to district"
    assert got[6].conflicts[0].message == "city does not belong to province"


def test_components(spark):
    got = evaluated(spark, [(1, 2, 3, 4, 4, "40115", []), (1, 0, 3, 0, 0, None, []),
                            (0, 0, 0, 0, 0, None, [])])
    assert got[0].matched == ["province", "city", "district", "sub_district", "postal_code"]
    assert got[0].missing == []
    assert (got[1].matched, got[1].missing) == (["province", "district"], ["city", "sub_district"])
    assert (got[2].matched, got[2].missing) == ([], ["province", "city", "district", "sub_district"])


def test_conflicts(spark):
    got = evaluated(spark, [
        (1, 2, 3, 4, 4, None, []), (0, 2, 1, 0, 0, None, []), (1, 2, 0, 0, 0, None, []),
        (1, 2, 0, 0, 0, None, [ev(2, "CITY", name="A"), ev(99, "CITY", name="B"), ev(99, "CITY", name="B")]),
        (1, 2, 0, 0, 0, None, [ev(99, "PROVINCE", name="Q"), ev(99, "PROVINCE", name="Q")]),
        (1, 2, 3, 4, 5, "1", [])])
    assert [[c.type for c in r.conflicts] for r in got] == [
        [], ["orphan_city"], [], ["multiple_city"], ["duplicate_level"] * 2, ["postal_code_mismatch"]]
    assert got[3].conflicts[0].message == "multiple city candidates: B"
    assert got[4].conflicts[0].message == "duplicate PROVINCE: Q"


def test_scores(spark):
    got = evaluated(spark, [
        (1, 2, 0, 0, 3, None, [ev(1)]), (0, 0, 0, 0, 0, None, [ev(1)]), (0, 2, 0, 0, 0, None, []),
        (0, 0, 0, 0, 3, None, []), (1, 0, 0, 0, 0, None, []), (0, 0, 0, 0, 0, None, []),
        (0, 2, 0, 0, 0, None, [ev(1)]), (1, 0, 0, 0, 0, None, [ev(1)]),
        (1, 123, 0, 0, 0, None, [ev(123, "CITY"), ev(123, "CITY")]),
        (1, 123, 0, 0, 0, None, [ev(1, "PROVINCE"), ev(1, "PROVINCE")])])
    assert [r.confidence for r in got] == [0.30, 0.10, 0.15, 0.05, 0.0, 0.0, 0.25, 0.10, 0.52, 0.60]
    broken = evaluated(spark, [(1, 9, 0, 0, 0, None, [])], hierarchy(spark))
    assert broken[0].confidence == 0.0


def test_bonus(spark):
    p, c, d, s = (1, "PROVINCE"), (123, "CITY"), (789, "DISTRICT"), (456, "SUBDISTRICT")
    lists = [[c], [c, c], [c, c, c], [p, p, c, c], [d, d], [s, s], [p, c, d, p, c, d],
             [c, (456, "CITY")], [(None, None), (None, None)], [p, c, p]]
    got = evaluated(spark, [(0, 0, 0, 0, 0, None, [ev(*e) for e in x]) for x in lists])
    assert [r.multi_bonus for r in got] == [0, 0.15, 0.15, 0.35, 0.10, 0.05, 0.40, 0, 0, 0.20]


def test_postal_prefix(spark):
    lists = [[], [ev(value="bandung")], [postal("40115")], [postal("40112")], [postal("40199")],
             [postal("50115")], [postal("40")], [ev(value="bandung"), postal("40115")],
             [postal("40999")], [postal("50000"), postal("40112"), postal("40115")]]
    got = evaluated(spark, [(0, 0, 0, 4, 4, "40115", x) for x in lists])
    assert [r.postal_prefix for r in got] == [0, 0, 0.20, 0.10, 0.07, 0, 0, 0.20, 0, 0.10]
    assert [r.reasons for r in got][2:5] == [
        ["match_postal_code_exact"], ["match_postal_code_prefix4"], ["match_postal_code_prefix3"]]
    none = evaluated(spark, [(0, 0, 0, 4, 0, None, [postal("40115")])])
    assert none[0].postal_prefix == 0 and none[0].reasons == []


def test_status(spark):
    got = evaluated(spark, [
        (1, 2, 3, 0, 0, None, []), (0, 2, 3, 0, 0, None, [ev(9, "DISTRICT")]),
        (0, 0, 0, 0, 0, None, []), (1, 0, 0, 0, 0, None, []), (0, 0, 0, 4, 0, None, []),
        (0, 2, 0, 0, 0, None, [])])
    assert [r.status for r in got] == [
        "VALID", "CONFLICT", "UNKNOWN", "INCOMPLETE", "INCOMPLETE", "INCOMPLETE"]


def test_full_chain_and_unused(spark):
    words = [("place_name", "bandung"), ("place_name", "citarum")]
    got = evaluated(
        spark, [(1, 2, 3, 4, 0, None, [ev(2, "CITY", "bandung")], words)], hierarchy(spark))[0]
    assert (got.status, got.confidence) == ("VALID", 0.37)
    assert [u.value for u in got.unused] == ["citarum"]
    assert got.reasons == ["exact_match", "match_city"]


def test_row_local_without_parent_maps(spark):
    """Checking structured addresses needs no exchange."""
    df = E.evaluate(spark.createDataFrame([], SCHEMA), None)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.schema["conflicts"].dataType.simpleString() == "array<struct<type:string,message:string>>"


def test_reasons_order(spark):
    got = evaluated(spark, [
        (1, 2, 3, 4, 4, "40115", [postal("40115"), ev(4, "SUBDISTRICT"), ev(3, "DISTRICT"),
                                  ev(2, "CITY"), ev(1, "PROVINCE")])])[0]
    assert got.reasons == ["exact_match", "match_province", "match_city", "match_district",
                           "match_subdistrict", "match_postal_code_exact"]
    assert got.confidence == 0.90


def test_null_lists_count_as_empty(spark):
    rows = [("a", 0, None, 2, 3, None, None, None, None, [("place_name", "w")]),
            ("a", 1, None, 2, 3, None, None, None, [], [("place_name", "w")]),
            ("a", 2, 1, 2, 3, None, None, None, None, None)]
    none, empty, plain = E.evaluate(spark.createDataFrame(rows, SCHEMA), None).orderBy("cand_id").collect()
    assert [c.type for c in none.conflicts] == ["orphan_city"]
    assert (none.status, none.confidence, [u.value for u in none.unused]) == ("CONFLICT", 0.15, ["w"])
    assert [none[c] for c in ("conflicts", "status", "confidence", "unused", "reasons")] == [
        empty[c] for c in ("conflicts", "status", "confidence", "unused", "reasons")]
    assert (plain.conflicts, plain.status, plain.unused) == ([], "VALID", [])


def test_a_city_under_two_names_is_one_conflict(spark):
    evidence = [ev(8, "CITY", name="Tirta"), ev(8, "CITY", name="tirta"), ev(9, "CITY", name="Nila")]
    (got,) = evaluated(spark, [(1, 2, 0, 0, 0, None, evidence)])
    assert [c.message.split(": ")[1] for c in got.conflicts] == ["Tirta", "Nila"]
