"""The pipeline: effect of each stage, odd rows, columns that pass through."""

import corpus_pipeline as P
from pyspark.sql import functions as F

from alamatika.llm import simhash
from alamatika.llm.queries import table

SF = "/root/testdata/sf0.001"


def test_stages_on_odd_rows(spark):
    docs = table(spark, SF, "documents")
    item = table(spark, SF, "benchmark").first()["text"]
    text = docs.where("n_chars > 600").first()["text"]
    extra = [
        (9001, text + " one more word here", "en", "s", 1), (9001, text + " one more word here", "en", "s", 1),
        (9002, f"Before it. {item} After it a@b.example.com", "en", "s", 1), (9003, item, "en", "s", 1),
        (9004, None, None, None, None), (9005, "", "en", "s", 0), (None, "no id at all", "en", "s", 12),
    ]
    more = spark.createDataFrame(extra, docs.schema)
    docs = docs.unionByName(more).withColumn("ids", F.lit("clash")).withColumn("address_id", F.lit(1))
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = P.written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
    left = {r["doc_id"]: r for r in docs.collect()}
    assert sum(k == 9001 for k in [r["doc_id"] for r in docs.collect()]) <= 1
    assert left[9002]["text"].startswith("Before it. ") and "[EMAIL]" in left[9002]["text"]
    assert item not in left[9002]["text"] and left[9002]["n_chars"] == len(left[9002]["text"])
    assert 9003 not in left and left[None]["text"] == "no id at all"
    last = P.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()
    assert {r["doc_id"]: r["text"] for r in last.select("doc_id", "text").collect()} == {k: r["text"] for k, r in left.items()}
    named = simhash.near_duplicates(docs.select(F.col("doc_id").alias("address_id"), F.col("text").alias("raw_input")))
    assert named.count() == docs.count()


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in P.STAGES:
        docs = P.written(stage(spark, docs, SF), "empty")
    assert docs.count() == 0
