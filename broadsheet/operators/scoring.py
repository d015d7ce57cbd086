"""Transparent scores: evidence, significance, recency, affinity, novelty and rank. Column expressions and joins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import decay
from ..sources.views import DAY, HOUR

# Points of a source's tier, and of a publisher's role by kind of article.
TIER_POINTS, OTHER_TIER, OFFICIAL_POINTS = {"T1": 85, "T1.5": 70, "T2": 55}, 40, 10
ROLE_OF = {"company": "first_party", "lab": "first_party", "project": "project", "publication": "editorial", "author": "editorial", "organization": "editorial", "podcast": "podcast", "index": "index", "community": "community"}
ROLE_POINTS = {
    "first_party": {"release": 70, "research": 72, "analysis": 65, "news": 60, "": 50},
    "project": {"release": 45, "research": 55, "analysis": 55, "news": 50, "tutorial": 45, "": 40},
    "editorial": {"release": 55, "research": 60, "analysis": 65, "news": 55, "": 50},
    "podcast": {"research": 55, "analysis": 55, "news": 50, "discussion": 50, "": 45},
    "index": {"research": 35, "": 30},
    "community": {"research": 45, "analysis": 45, "discussion": 42, "": 40},
    "unknown": {"release": 45, "research": 50, "analysis": 50, "news": 45, "": 40},
}
#: Half-lives of recency in hours by kind; all others, and weekly editions.
HALF_LIVES, OTHER_HALF_LIFE, WEEKLY_HALF_LIFE = {"research": 96, "analysis": 96, "tutorial": 96, "release": 48}, 30, 168
RANK_WEIGHTS = {"significance": 0.35, "value": 0.20, "interest": 0.15, "recency": 0.15, "quality": 0.10, "affinity": 0.05}


def chosen(of: Column, table: dict, other) -> Column:
    """The table's value for ``of``, else ``other``."""
    out = None
    for k, v in table.items():
        out = F.when(of == k, v) if out is None else out.when(of == k, v)
    return (F.when(F.lit(False), other) if out is None else out).otherwise(other)


def evidence_score(evidence: DataFrame, as_of: int, key: str = "story") -> DataFrame:
    """``key``, quality, corroboration, freshness, score of each story.

    ``evidence`` has tier, official, domain, published. One aggregation on the key, combined before its shuffle.
    """
    points = chosen(F.col("tier"), TIER_POINTS, OTHER_TIER) + F.when(F.col("official"), OFFICIAL_POINTS).otherwise(0)
    sums = evidence.groupBy(key).agg(
        F.max(points).alias("quality"), F.count_distinct("domain").alias("domains"), F.max(F.when(F.col("published") <= as_of + 300, F.col("published"))).alias("latest"), F.count("*").alias("n_evidence"),
    )
    freshness = F.coalesce(100 * F.pow(F.lit(2.0), -F.greatest(F.lit(as_of) - F.col("latest"), F.lit(0)) / F.lit(48.0 * HOUR)), F.lit(0.0))
    out = sums.select(key, "n_evidence", F.col("quality").cast("double").alias("quality"), F.least(F.lit(100), 25 * F.greatest(F.col("domains") - 1, F.lit(0))).cast("double").alias("corroboration"), freshness.alias("freshness"), "latest")
    return out.withColumn("score", F.floor((0.45 * F.col("quality") + 0.20 * F.col("corroboration") + 0.35 * F.col("freshness")) * 10 + 0.5) / 10)


def role(entity: Column) -> Column:
    return chosen(entity, ROLE_OF, "unknown")


def base_significance(entity: Column, kind: Column) -> Column:
    """Points of a publisher's role for a kind of article, before adjustments."""
    out = None
    for name, points in ROLE_POINTS.items():
        own = chosen(kind, {k: v for k, v in points.items() if k}, points[""])
        out = F.when(role(entity) == name, own) if out is None else out.when(role(entity) == name, own)
    return out


def significance(entity: Column, kind: Column, launch: Column, flagship: Column, people: Column, major: Column, minor_step: Column) -> Column:
    """Base points with adjustments for launches, named model versions, people and version grades, within 0 to 100."""
    r = role(entity)
    launched = F.when((r == "first_party") & launch, chosen(kind, {"release": 20, "news": 15, "research": 5}, 0)).when(r.isin("editorial", "unknown") & launch & flagship & kind.isin("news", "release"), 5).otherwise(0)
    grade = F.when((kind != "release") | (r == "first_party"), 0).when(minor_step, -15).when(major, 10).otherwise(0)
    total = base_significance(entity, kind) + launched + F.when(flagship & ~r.isin("community", "index"), 5).otherwise(0) + F.when(people, -10).otherwise(0) + grade
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def recency(at: Column, kind: Column, as_of: int, weekly: bool = False) -> Column:
    """100 halved per half-life since ``at``; 0 without a date."""
    half = F.lit(WEEKLY_HALF_LIFE) if weekly else chosen(kind, HALF_LIVES, OTHER_HALF_LIFE)
    return F.coalesce(100 * decay((F.lit(as_of) - at) / HOUR / half), F.lit(0.0))


def novelty_penalty(opened: Column, seen: Column, changed: Column, as_of: int) -> Column:
    """What a story costs that the reader has opened or seen in its present form."""
    return F.when(changed, 0.0).when(opened.isNotNull(), 6 * decay((F.lit(as_of) - opened) / (48.0 * HOUR))).when(seen.isNotNull(), 3 * decay((F.lit(as_of) - seen) / (24.0 * HOUR))).otherwise(0.0)


def rank(columns: dict[str, Column], penalty: Column, dismissed: Column) -> Column:
    total = None
    for name, weight in RANK_WEIGHTS.items():
        part = columns[name] * weight
        total = part if total is None else total + part
    return total - penalty - F.when(dismissed, 200).otherwise(0)


def popularity(publishers: Column, first: Column, as_of: int) -> Column:
    return F.least(F.lit(3), publishers - 1) * F.pow(F.lit(2.0), -(F.lit(as_of) - first) / F.lit(float(DAY)))
