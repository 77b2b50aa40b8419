"""Headline timings: one JSON line.

``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]``. Every query
runs over whole tables into a sink that drops the rows; ``queries`` holds the second run,
``cold`` the first one in the fresh session. ``gazetteer_build`` is the seeding job, which
the other queries need once.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from alamatika.bindings import queries as Q  # noqa: E402
from alamatika.bindings import tables as B  # noqa: E402
from alamatika.plans.gazetteer import Gazetteer  # noqa: E402

HEADLINE = (
    "validate", "accuracy_flags", "normalize_text", "sanitize_html", "evidence",
    "phrase_greedy", "conflicts", "confidence", "hierarchy_flatten", "postal_infer",
    "rank", "evaluate_candidates", "conclude", "resolve_evidence", "lexicon", "ambiguity",
    "accuracy_rollup", "alias_validate",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("alamatika-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(job) -> float:
        start = time.time()
        job()
        return round(time.time() - start, 3)

    def build() -> None:
        Gazetteer.build(B.sources(spark), B.regions(spark, sf_dir))

    def run(name: str) -> None:
        Q.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    cold, warm = {"gazetteer_build": timed(build)}, {"gazetteer_build": timed(build)}
    B.gazetteer(spark, sf_dir)
    for name in HEADLINE:
        cold[name] = timed(lambda: run(name))
        warm[name] = timed(lambda: run(name))
    addresses = B.requests(spark, sf_dir).count()
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "addresses": addresses,
        "addresses_per_sec": round(addresses / warm["validate"], 1),
        "cpus": int(cpus),
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
