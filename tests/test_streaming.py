from pyspark.sql import functions as F

from quadlake.streaming import changes


def test_index_follows_the_feed(spark, tmp_path):
    feed, target, check = (str(tmp_path / n) for n in ("feed", "index", "checkpoint"))
    derive = lambda b: b.groupBy("k").agg(F.max_by("v", "at").alias("v"), F.max("at").alias("at"))

    def run():
        changes.update_index(changes.stream(spark, feed), target, check, derive, key=["k"], version="at").awaitTermination()
        return {(r["k"], r["v"]) for r in changes.current(spark, target, ["k"], "at").collect()}

    spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], "k string, v string, at int").write.parquet(feed)
    assert run() == {("a", "1"), ("b", "1")}
    spark.createDataFrame([("a", "2", 2)], "k string, v string, at int").write.mode("append").parquet(feed)
    assert run() == {("a", "2"), ("b", "1")}
