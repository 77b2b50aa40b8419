"""The small gazetteer of the end-to-end goldens (invented codes)."""

from pyspark.sql import functions as F

from alamatika.functions import text as T
from alamatika.plans.gazetteer import Gazetteer
from alamatika.sources.dumps import level_of

ROWS = [
    ("14", "Riau", None),
    ("21", "Kepulauan Riau", None),
    ("31", "DKI Jakarta", None),
    ("32", "Jawa Barat", None),
    ("31.71", "Kota Administrasi Jakarta Pusat", None),
    ("32.01", "Kabupaten Bogor", None),
    ("32.71", "Kota Bogor", None),
    ("32.04", "Kabupaten Bandung", None),
    ("32.73", "Kota Bandung", None),
    ("32.73.09", "Bandung Wetan", None),
    ("32.73.19", "Sumur Bandung", None),
    ("32.73.06", "Lengkong", None),
    ("32.01.29", "Ciomas", None),
    ("32.73.09.1001", "Citarum", "40115"),
    ("32.73.09.1002", "Tamansari", "40116"),
    ("32.73.09.1003", "Cihapit", "40114"),
    ("32.73.19.1001", "Braga", "40111"),
    ("32.73.19.1004", "Babakan Ciamis", "40117"),
    ("32.73.06.1004", "Lingkar Selatan", "40263"),
    ("32.01.29.2001", "Ciomas", "16610"),
    ("32.01.29.2002", "Pagelaran", "16610"),
]


def regions(spark):
    rows = [(i + 1, 1, *r) for i, r in enumerate(ROWS)]
    return (
        spark.createDataFrame(
            rows, "id long, source_id long, kode string, name string, postal_code string"
        )
        .withColumn("level_id", level_of(F.col("kode")))
        .withColumn("norm_name", T.normalize(F.col("name")))
        .withColumn("deleted_at", F.lit(None).cast("timestamp"))
    )


def sources(spark):
    return spark.createDataFrame(
        [(1, "kemendagri", "2025", None)],
        "id long, code string, version string, deleted_at timestamp",
    )


def gazetteer(spark, **kw):
    return Gazetteer.build(sources(spark), regions(spark), **kw)


# address, normalized, status, ranked (score, kode), unused, strategy
GOLDENS = [
    ("Gg. Kenari 12 BANDUNG", "gg kenari bandung", "INCOMPLETE",
     [(0.37, "32.73"), (0.37, "32.04")], "kenari"),
    ("Gg. Melati, RW.03, Kel. Braga, Kec. Sumur Bandung, Kota Bandung",
     "gg melati rw braga sumur bandung bandung", "AMBIGUOUS",
     [(0.65, "32.73.19.1001"), (0.55, "32.73.19"), (0.37, "32.73"), (0.37, "32.04")], "melati rw"),
    ("Gg. Asri 5 bandung 40115", "gg asri bandung 40115", "INCOMPLETE",
     [(0.37, "32.73"), (0.37, "32.04")], "40115 asri"),
    ("Gg. Teratai Citarum bandung 40115", "gg teratai citarum bandung 40115", "VALID",
     [(0.72, "32.73.09.1001"), (0.37, "32.73"), (0.37, "32.04")], "teratai"),
    ("Gg. Dahlia Bogor", "gg dahlia bogor", "INCOMPLETE",
     [(0.37, "32.01"), (0.37, "32.71")], "dahlia"),
    ("Ciomas, Bogor, Jawa Barat", "ciomas bogor jawa barat", "AMBIGUOUS",
     [(0.90, "32.01.29.2001"), (0.80, "32.01.29"), (0.72, "32.01"), (0.45, "32"), (0.37, "32.71")],
     ""),
    ("Gedung Sate 40115", "gedung sate 40115", "UNKNOWN", [], ""),
    ("Kepulauan Riau", "riau", "INCOMPLETE", [(0.25, "14"), (0.25, "21")], ""),
    ("Gg. Nuri 3, Citarum, 40191", "gg nuri citarum 40191", "VALID",
     [(0.35, "32.73.09.1001")], "40191 nuri"),
    ("Gg. Nuri, Jakarta Pusat 10110", "gg nuri jakarta pusat 10110", "INCOMPLETE",
     [(0.52, "31.71")], "10110 nuri"),
    ("tanpa lokasi", "tanpa lokasi", "UNKNOWN", [], ""),
    ("Jl. Citarum 40115, Bandung Wetan, Kota Bandung, Jawa Barat",
     "jl citarum bandung wetan bandung jawa barat 40115", "AMBIGUOUS",
     [(1.0, "32.73.09.1001"), (0.90, "32.73.09"), (0.72, "32.73"), (0.45, "32"), (0.37, "32.04")],
     ""),
]


def requests(spark):
    return spark.createDataFrame(
        [(str(i + 1), g[0], "") for i, g in enumerate(GOLDENS)],
        "address_id string, address string, source_code string",
    )
