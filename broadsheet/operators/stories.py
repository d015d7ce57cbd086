"""Articles judged one by one, and stories made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy as P
from . import scoring

#: Characters of a text, and of a story's texts together, that the facets of a story see.
SEEN, MATERIAL = 6000, 12000


def with_policy(articles: DataFrame) -> DataFrame:
    """``articles`` with kind, value, eligible, n_chars."""
    c = {n: F.col(n) for n in ("title", "url", "type", "body", "flair", "categories", "entity")}
    out = articles.withColumn("_policy", P.article_policy(c["title"], c["url"], c["type"], c["body"], c["flair"], c["categories"], c["entity"]))
    return out.select(*articles.columns, "_policy.*")


def assessed(articles: DataFrame) -> DataFrame:
    """``with_policy`` with role, significance and selectable."""
    a = with_policy(articles)
    s = P.title_signals(F.col("title"))
    score = scoring.significance(F.col("entity"), F.col("kind"), *[s[n] for n in ("launch", "flagship", "people", "major", "minor")])
    more = F.when(P.critical_disclosure(F.col("title"), F.col("kind"), F.col("entity")), 25).otherwise(0)
    short = F.coalesce(F.col("entity") == "community", F.lit(False)) & (F.length(F.substring(F.coalesce("body", F.lit("")), 1, 6000)) < 180)
    return a.withColumns({"role": scoring.role(F.col("entity")), "significance": F.least(F.lit(100), score + more), "selectable": ~F.col("kind").isin("metadata", "question", "promotion") & ~short})


def features(articles: DataFrame, key: str = "story") -> DataFrame:
    """One row a story: the best article's kind and value, significance raised by further publishers, facets of the newest material.

    One aggregation on the key. A story's material is gathered newest first, each text cut to what the facets can see of it; texts
    beyond the first 12,000 characters of material are dropped before they are gathered, however many a story has.
    """
    text = F.concat(F.col("url"), F.lit(" "), F.coalesce(F.substring("body", 1, SEEN), F.lit("")))
    a = assessed(articles).withColumn("seen", text).drop("body", "summary")
    before = F.sum(F.length("seen") + 1).over(Window.partitionBy(key).orderBy(F.desc("published"), F.desc("item")).rowsBetween(Window.unboundedPreceding, -1))
    a = a.withColumn("seen", F.when(F.coalesce(before, F.lit(0)) < MATERIAL, F.col("seen")))
    newest = F.array_sort(F.collect_list(F.when(F.col("seen").isNotNull(), F.struct((-F.col("published")).alias("p"), (-F.col("item")).alias("i"), F.col("seen").alias("t")))))
    first = lambda by: F.struct(by, -F.col("published"), -F.col("item"))
    points = scoring.chosen(F.col("tier"), {"T1": 85, "T1.5": 70}, 55) + F.when(F.col("official"), scoring.OFFICIAL_POINTS).otherwise(0)
    publishers = F.greatest(F.count_distinct("domain") - 1, F.lit(0))
    g = a.groupBy(key).agg(
        F.min("published").alias("freshness"), F.max_by("kind", first(F.col("value"))).alias("kind"), F.max("value").alias("value"), F.max_by("role", first(F.col("significance"))).alias("role"), F.max("significance").alias("significance"),
        F.bool_or("selectable").alias("selectable"), F.max(F.when(F.col("selectable"), F.col("value"))).alias("selectable_value"), publishers.alias("further"), F.max("title").alias("title"), F.max("type").alias("type"), F.max("lang").alias("topic"),
        F.substring(F.array_join(F.transform(newest, lambda x: x["t"]), " "), 1, MATERIAL).alias("material"), F.array_sort(F.collect_set("domain")).alias("publishers"), F.bool_and(F.coalesce(F.col("entity") == "community", F.lit(False))).alias("is_community"),
        F.bool_or(F.col("lifecycle") == "stable").alias("confirmed"), F.max(points).alias("quality"),
        F.bool_and(F.coalesce(F.col("tier").isin("T1", "T1.5"), F.lit(False))).alias("first_rate"),
    )
    g = g.withColumns({"importance": F.least(F.lit(100), F.col("significance") + 10 * F.least(F.lit(3), "further")), "coverage": F.least(F.lit(100), F.col("further") * 25), "facets": P.facets("title", "material", "type", "topic")})
    brief = F.col("selectable") & ((F.col("importance") >= 60) | ((F.col("importance") >= 45) & (F.coalesce("selectable_value", F.lit(0)) >= 60)))
    return g.withColumn("brief", brief).drop("material")


def worth_catching_up(significance: Column, value: Column) -> Column:
    """Significant and of value; a story from before significance was kept needs a little less value."""
    return F.when(significance.isNull(), value >= 68).otherwise((significance >= 60) & (value >= 70))
