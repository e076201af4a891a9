import pytest

from equireach.streaming import running_means


def test_running_means_of_a_stream(spark, tmp_path):
    rows = [("a", "1", 1.0), ("a", "3", 3.0), ("a", "bad", 9.0), ("b", "5", 0.0), ("b", "7", 2.0)]
    spark.createDataFrame(rows, "k string, acc string, pop double").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, acc string, pop double").parquet(str(tmp_path / "in"))
    run = running_means(stream, "acc", "pop", ["k"]).writeStream.outputMode("complete").format("memory").queryName("means").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert run.awaitTermination(100)
    got = {r["k"]: (r["grid_num"], r["pop_num"], r["pop_mean"]) for r in spark.table("means").collect()}
    assert got == {"a": (2, 4.0, pytest.approx(2.5)), "b": (1, 2.0, 7.0)}
