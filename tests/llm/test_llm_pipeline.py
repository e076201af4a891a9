import gc

import corpus_pipeline
from equireach.llm import common, decontaminate, exact_dedup, language, ngram_join

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("found_id", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash"))
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == [*spark.read.parquet(f"{SF}/documents.parquet").columns, "found_id"]
        assert docs.count() <= n, name
        n = docs.count()
    assert language.of_documents(docs).where("NOT accepted").count() <= 1
    assert exact_dedup.groups(docs).where("NOT kept").count() == 0 and ngram_join.link(docs).where("doc_id <> component_id").count() == 0
    assert decontaminate.find(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and set(out.columns) >= {"doc_id", "sequence_id", "offset"}


def test_empty_documents(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_written_tables_free_the_drivers_memory(spark, monkeypatch):
    jvm = spark.sparkContext._jvm
    thing = jvm.java.util.ArrayList()
    jvm.java.lang.System.gc()  # from now on only a full collection takes it
    left = jvm.java.lang.ref.WeakReference(thing)
    del thing
    gc.collect()
    monkeypatch.setitem(common._trimmed, "at", float("-inf"))
    out = common.Scratch(spark, "trim").table(spark.range(3), "rows")
    assert left.get() is None and out.count() == 3
