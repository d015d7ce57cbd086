"""Queries of what depends on a reader: recency, affinity, reading bonus, novelty, rank, limits and exposures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring
from ..sources.views import AS_OF, DAY, actions, items, sources, with_views


def k5_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).join(sources(spark, sf_dir), "source")
    kind = scoring.chosen(F.col("entity"), {"lab": "research", "project": "release", "author": "analysis"}, "news")
    return i.select("item", F.round(scoring.recency(F.col("published"), kind, AS_OF), 6).alias("daily"), F.round(scoring.recency(F.col("published"), kind, AS_OF, weekly=True), 6).alias("weekly"))


K5 = with_views(
    f"""+, h as (select item, ({AS_OF} - published) / 3600.0 as h, case entity when 'lab' then 96 when 'author' then 96 when 'project' then 48 else 30 end as half from items join sources using (source))
select item, round(case when h / half >= 100 then 0 else 100 * power(0.5, greatest(h / half, 0)) end, 6) as daily, round(case when h / 168 >= 100 then 0 else 100 * power(0.5, greatest(h / 168, 0)) end, 6) as weekly from h""",
    "items", "sources",
)


def t2_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of each reader in buckets of six hours, and those beyond the limit of ten."""
    a = actions(spark, sf_dir).groupBy("reader", (F.floor(F.col("moment") / 21_600) * 21_600).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    return a.select("reader", "bucket", F.least("n", F.lit(10)).cast("long").alias("allowed"), F.greatest(F.col("n") - 10, F.lit(0)).cast("long").alias("refused"))


T2 = with_views("select reader, moment // 21600 * 21600 as bucket, least(count(*), 10) as allowed, greatest(count(*) - 10, 0) as refused from actions group by all", "actions")


def t3_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sight of each story by each reader on each local day."""
    a = actions(spark, sf_dir).where("action in ('seen', 'opened')").withColumn("day", F.floor((F.col("moment") + 28_800) / DAY).cast("long"))
    return a.groupBy("reader", "story", "day").agg(F.min_by("action_id", F.struct("moment", "action_id")).alias("action_id"))


T3 = with_views("select reader, story, (moment + 28800) // 86400 as day, arg_min(action_id, (moment, action_id)) as action_id from actions where action in ('seen', 'opened') group by all", "actions")


def g17_rolling_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of each reader in the last day, and when the oldest of those beyond a budget of two frees a place."""
    from pyspark.sql.window import Window

    a = actions(spark, sf_dir).where((F.col("moment") <= AS_OF) & (F.col("moment") > AS_OF - DAY))
    w = Window.partitionBy("reader")
    a = a.withColumn("used", F.count("*").over(w)).withColumn("nth", F.row_number().over(w.orderBy("moment", "action_id")))
    return a.groupBy("reader", "used").agg(F.max(F.when((F.col("used") >= 2) & (F.col("nth") == F.col("used") - 1), F.col("moment") + DAY)).alias("free_at"))


G17 = with_views(
    f"""+, u as (select reader, moment, count(*) over (partition by reader) as used, row_number() over (partition by reader order by moment, action_id) as nth from actions where moment <= {AS_OF} and moment > {AS_OF - DAY})
select reader, used, max(moment + {DAY}) filter (where used >= 2 and nth = used - 1) as free_at from u group by all""",
    "actions",
)

ALL = [(k5_recency, K5), (t2_rate_limit, T2), (t3_exposures, T3), (g17_rolling_use, G17)]
