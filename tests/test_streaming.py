from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.plans import registry
from broadsheet.streaming import limits


def stream(spark, sf_dir, tmp_path):
    """The events table as a stream of several files in order of time, with zoned timestamps."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    to = str(tmp_path / "events")
    events.repartitionByRange(3, "ts").write.parquet(to)
    return spark.readStream.schema(events.schema).parquet(to)


def ran(spark, df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted(tuple(r) for r in spark.table(name).collect())


def test_rate_buckets_match_the_batch_query(spark, sf_dir, tmp_path):
    got = ran(spark, limits.rate_buckets(stream(spark, sf_dir, tmp_path), "6 hours", 10, "60 days"), "buckets", "complete")
    want = registry.queries()["t2_rate_limit"](spark, sf_dir).select("reader", "bucket", "allowed", "refused")
    assert got == sorted(tuple(r) for r in want.collect())


def test_exposures_match_the_batch_query(spark, sf_dir, tmp_path):
    events = stream(spark, sf_dir, tmp_path).where("event_type in ('view', 'click')")
    n_stories = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.max("doc_id")).first()[0] // 5 + 1
    got = ran(spark, limits.first_exposures(events, F.col("event_id") * 7919 % n_stories, "60 days"), "exposures", "append")
    want = registry.queries()["t3_exposures"](spark, sf_dir).select("reader", "story", "day")
    assert got == sorted(tuple(r) for r in want.collect())


def test_future_events_are_refused(spark):
    rows = spark.createDataFrame([(1, 1000), (2, 1301), (3, 1300), (4, None)], "id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.id for r in limits.not_future(rows, 1000).collect()) == [1, 3, 4]
