"""Gazetteer and addresses derived by Spark from the analytic test tables.

Names hold digits that normalising deletes, so keys are spelled with letters. Regions and
nations become provinces and cities, market segments of a nation its districts, customers
its subdistricts; an order is an address of its customer in one of seven styles. A second
source holds provinces and cities only. Ids and codes are row-local formulas, so nothing
is numbered over a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alamatika.functions import text as T
from alamatika.operators.gazetteer import REGION_COLUMNS
from alamatika.plans.gazetteer import Gazetteer

SECOND_SOURCE = 1_000_000_000_000  # id offset of the second source's regions
NO_TIME = "cast(null as timestamp)"
DELETED = "timestamp '2025-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letters(key: Column) -> Column:
    """A number as nine letters: 12 -> 'aaaaaaabc'."""
    return F.translate(F.lpad(key.cast("string"), 9, "0"), "0123456789", "abcdefghij")


def _segment_code(segment: Column) -> Column:
    return F.ascii(segment) - 55


def _pad(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _region(id_: Column, kode: Column, name: Column, level: int, postal=None, deleted=None):
    return [
        id_.cast("long").alias("id"),
        kode.alias("kode"),
        name.alias("name"),
        F.lit(level).alias("level_id"),
        (F.lit(None).cast("string") if postal is None else postal).alias("postal_code"),
        (F.expr(NO_TIME) if deleted is None else deleted).alias("deleted_at"),
    ]


def _province_kode(regionkey: Column) -> Column:
    return _pad(regionkey + 11, 2)


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        "n_nationkey",
        F.concat_ws(".", _province_kode(F.col("n_regionkey")), _pad(F.col("n_nationkey"), 2)).alias("city_kode"),
        F.concat_ws(".", _province_kode(F.col("n_regionkey")), _pad(F.col("n_nationkey") + 50, 2)).alias("twin_kode"),
    )


def postal_of(custkey: Column, modulus: int = 3000) -> Column:
    return _pad(F.lit(10000) + custkey % modulus, 5)


def regions(spark: SparkSession, sf_dir: str, postal_modulus: int = 3000) -> DataFrame:
    """The derived regions of both sources."""
    provinces = table(spark, sf_dir, "region").select(
        *_region(
            F.col("r_regionkey") + 1,
            _province_kode(F.col("r_regionkey")),
            F.concat(F.lit("Prov. "), F.col("r_name")),
            2,
        )
    )
    nations = _nations(spark, sf_dir)
    n = F.col("n_nationkey")
    gone = F.when(n == 13, F.expr(DELETED))
    cities = nations.select(
        *_region(n * 2 + 100, F.col("city_kode"), F.concat(F.lit("Kota Nation "), letters(n)), 3,
                 deleted=gone)
    )
    twins = nations.where(n % 5 == 0).select(
        *_region(n * 2 + 101, F.col("twin_kode"),
                 F.concat(F.lit("Kabupaten Nation "), letters(n)), 3)
    )
    seg = _segment_code(F.col("c_mktsegment"))
    district_kode = F.concat_ws(".", F.col("city_kode"), _pad(seg, 2))
    customers = (
        table(spark, sf_dir, "customer")
        .select("c_custkey", "c_nationkey", "c_mktsegment")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    districts = (
        customers.select("c_nationkey", "city_kode", "c_mktsegment")
        .distinct()
        .select(
            *_region(
                F.col("c_nationkey") * 100 + seg + 1000,
                district_kode,
                F.concat(F.lit("Kec. "), F.col("c_mktsegment")),
                4,
                deleted=F.when((F.col("c_nationkey") * 7 + seg) % 11 == 0, F.expr(DELETED)),
            )
        )
    )
    k = F.col("c_custkey")
    subdistricts = customers.select(
        *_region(
            k + 1_000_000,
            F.concat_ws(".", district_kode, _pad(k, 9)),
            F.concat(F.lit("Kel. "), letters(k)),
            5,
            postal=postal_of(k, postal_modulus),
        )
    )
    first = F.lit(1).cast("long").alias("source_id")
    upper = provinces.unionByName(cities).unionByName(twins)
    one = upper.unionByName(districts).unionByName(subdistricts).select("*", first)
    two = upper.select(
        (F.col("id") + SECOND_SOURCE).alias("id"),
        *[c for c in upper.columns if c != "id"],
        F.lit(2).cast("long").alias("source_id"),
    )
    return (
        one.unionByName(two)
        .withColumn("norm_name", T.normalize(F.col("name")))
        .select(*REGION_COLUMNS)
    )


def sources(spark: SparkSession) -> DataFrame:
    """The two sources of the derived gazetteer."""
    rows = [(1, "kemendagri", "2025"), (2, "bps", "2024")]
    return spark.createDataFrame(rows, "id long, code string, version string").withColumn(
        "deleted_at", F.expr(NO_TIME)
    )


_BUILT: dict[tuple, Gazetteer] = {}


def gazetteer(spark: SparkSession, sf_dir: str, postal_modulus: int = 3000) -> Gazetteer:
    """The derived gazetteer, seeded once per application like any gazetteer."""
    key = (spark.sparkContext.applicationId, sf_dir, postal_modulus)
    if key not in _BUILT:
        _BUILT[key] = Gazetteer.build(sources(spark), regions(spark, sf_dir, postal_modulus))
    return _BUILT[key]


def orders_with_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the true region names of their customer."""
    nations = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "r_name")
    )
    customers = (
        table(spark, sf_dir, "customer")
        .select("c_custkey", "c_nationkey", "c_mktsegment")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
    )


def requests(spark: SparkSession, sf_dir: str, postal_modulus: int = 3000) -> DataFrame:
    """One address request per order: (address_id, address, source_code)."""
    rows = orders_with_places(spark, sf_dir)
    o, c = F.col("o_orderkey"), F.col("c_custkey")
    order, sub, city = o.cast("string"), letters(c), letters(F.col("n_nationkey"))
    seg, prov, code = F.col("c_mktsegment"), F.col("r_name"), postal_of(c, postal_modulus)
    wrong = _pad(F.lit(10007) + c % postal_modulus, 5)
    lit = F.lit
    style = o % 7
    address = (
        F.when(style == 0, F.concat(
            lit("Jl. Melati No."), order, lit(", Kel. "), sub, lit(", Kec. "), seg,
            lit(", Kota Nation "), city, lit(", Prov. "), prov, lit(" "), code))
        .when(style == 1, F.concat(
            lit("Gang Mawar "), order, lit("\\nKel. "), sub, lit("\\nKec. "), seg,
            lit(" Kec. "), seg, lit("\\nKabupaten Nation "), city))
        .when(style == 2, F.concat(
            lit("JL. KENANGA NO."), order, lit(" "), F.upper(sub), lit(", "), seg, lit(" "),
            wrong))
        .when(style == 3, F.concat(
            lit("Jalan Anggrek RT.005 RW.002\tNation "), city, lit("  Kota")))
        .when(style == 4, F.concat(lit("Gedung Sate Lt. 3 "), code))
        .when((style == 5) & (F.col("o_orderstatus") == "F"), lit(""))
        .when(style == 5, lit("tanpa lokasi"))
        .otherwise(F.concat(
            lit("<script>alert('x')</script><b>Kel. "), sub, lit("</b> &amp; Kec. "), seg,
            lit(", Prov. "), prov, lit(" "), code))
    )
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    source = (
        F.when(p == "2-HIGH", lit("bps"))
        .when(p == "5-LOW", lit(""))
        .when((s == "P") & (p == "3-MEDIUM"), lit("tidak-ada"))
        .otherwise(lit("kemendagri"))
    )
    return rows.select(
        order.alias("address_id"), address.alias("address"), source.alias("source_code")
    )


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other names of the derived regions (X2): (location_id, alias, deleted_at).

    Some are deleted, some repeat another in other letters, some repeat the own name or
    hold no word, and twin cities share theirs.
    """
    nation = table(spark, sf_dir, "nation")
    n, name, lit = F.col("n_nationkey"), F.col("n_name"), F.lit

    def rows(df: DataFrame, location: Column, alias: Column, gone: Column | None = None) -> DataFrame:
        deleted = F.expr(NO_TIME) if gone is None else F.when(gone, F.expr(DELETED))
        return df.select(
            location.cast("long").alias("location_id"), alias.alias("alias"), deleted.alias("deleted_at")
        )

    region = table(spark, sf_dir, "region")
    customer = table(spark, sf_dir, "customer")
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    parts = [
        rows(nation, n * 2 + 100, name, n % 7 == 3),
        rows(nation.where(n % 5 == 0), n * 2 + 101, name),
        rows(nation.where(n % 3 == 0), n * 2 + 100, F.concat(F.lower(name), lit("."))),
        rows(nation.where(n % 2 == 0), n * 2 + 100 + SECOND_SOURCE, name),
        rows(nation, n * 2 + 100, F.concat(lit("Kota Nation "), letters(n))),
        rows(region, F.col("r_regionkey") + 1, F.concat(lit("Wilayah "), F.col("r_name"))),
        rows(region, F.col("r_regionkey") + 1, lit("123")),
        rows(customer.select("c_nationkey", "c_mktsegment").distinct(),
             F.col("c_nationkey") * 100 + _segment_code(seg) + 1000, F.concat(lit("Sektor "), seg)),
        rows(customer.where(k % 4 == 0), k + 1_000_000, F.concat(lit("Kp. "), letters(k)), k % 12 == 0),
        rows(customer.where(k % 8 == 0), k + 1_000_000, F.concat(lit("Dusun "), letters(k))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_NAMED: dict[tuple, Gazetteer] = {}


def gazetteer_with_aliases(spark: SparkSession, sf_dir: str) -> Gazetteer:
    """The derived gazetteer with aliases, seeded once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _NAMED:
        _NAMED[key] = Gazetteer.build(
            sources(spark), regions(spark, sf_dir), aliases=aliases(spark, sf_dir)
        )
    return _NAMED[key]


def alias_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per order whose text uses other names of its places."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_n"), "n_name")
    rows = orders_with_places(spark, sf_dir).join(nations, F.col("n_nationkey") == F.col("_n"))
    o, lit = F.col("o_orderkey"), F.lit
    order, sub = o.cast("string"), letters(F.col("c_custkey"))
    nation, city = F.col("n_name"), letters(F.col("n_nationkey"))
    seg, prov, code = F.col("c_mktsegment"), F.col("r_name"), postal_of(F.col("c_custkey"))
    style = o % 6
    address = (
        F.when(style == 0, F.concat(
            lit("Jl. Melati No."), order, lit(", Kp. "), sub, lit(", "), nation, lit(", Prov. "), prov,
            lit(" "), code))
        .when(style == 1, F.concat(nation, lit(" Wilayah "), prov))
        .when(style == 2, F.concat(
            lit("Kel. "), sub, lit(", Dusun "), sub, lit(", Kp. "), sub, lit(", Sektor "), seg))
        .when(style == 3, F.concat(lit("Sektor "), seg, lit(", Nation "), city, lit(", "), nation))
        .when(style == 4, nation)
        .otherwise(F.concat(lit("Dusun "), sub, lit(", Kec. "), seg, lit(", Prov. "), prov))
    )
    source = F.when(F.col("o_orderpriority") == "2-HIGH", lit("bps")).otherwise(lit("kemendagri"))
    return rows.select(
        order.alias("address_id"), address.alias("address"), source.alias("source_code")
    )
