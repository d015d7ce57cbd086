"""What a reader's own history makes of stories: interest, affinity and rank.

``requested`` has a row for each reader and story that is to be judged: the reader's state (seen, opened, saved, dismissed,
reason) and the story's features (facets, publishers, kind, freshness, importance, value, quality).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.policy import OTHER, PAPER, PODCAST
from ..functions.text import decay, topic_alias
from ..sources.views import DAY
from . import scoring


def _preferences(profiles: DataFrame) -> DataFrame:
    """reader, weights (of enabled labels), barred (labels switched off or of no weight): a reader's few rows as one."""
    single = profiles.groupBy("reader", "label", "enabled").agg(F.max("weight").alias("weight"))  # a label may stand twice
    entries = F.collect_list(F.when(F.col("enabled"), F.struct("label", "weight")))
    return single.groupBy("reader").agg(F.map_from_entries(entries).alias("weights"), F.collect_set(F.when(~F.col("enabled") | (F.col("weight") == 0), F.col("label"))).alias("barred"))


def with_interest(requested: DataFrame, profiles: DataFrame) -> DataFrame:
    """``requested`` with interest, the greatest weight of a label among the facets, 35 if there is none, and ``barred``."""
    r = requested.join(_preferences(profiles), "reader", "left")
    weights = F.array_compact(F.transform("facets", lambda f: F.try_element_at("weights", f)))
    return r.withColumn("interest", F.coalesce(F.array_max(weights), F.lit(35))).withColumn("barred", F.coalesce("barred", F.array().cast("array<string>"))).drop("weights")


def relevance(requested: DataFrame, profiles: DataFrame) -> DataFrame:
    """``requested`` (reader, story, facets, topic) with relevance: the greatest weight of an enabled label that a facet or the topic is another name of, else 0."""
    name = lambda label: F.lower(topic_alias(label))
    wanted = profiles.where("enabled").groupBy("reader", name(F.col("label")).alias("label")).agg(F.max("weight").alias("weight"))
    wanted = wanted.groupBy("reader").agg(F.map_from_entries(F.collect_list(F.struct("label", "weight"))).alias("weights"))
    weights = F.transform(F.concat("facets", F.array("topic")), lambda f: F.try_element_at("weights", F.coalesce(name(f), F.lit(""))))
    return requested.join(wanted, "reader", "left").withColumn("relevance", F.coalesce(F.array_max(weights), F.lit(0))).drop("weights")


def affinity(requested: DataFrame, profiles: DataFrame, as_of: int) -> DataFrame:
    """``requested`` with interest, affinity and bonus.

    Feedback is first summed by what it is judged by (a reader's set of facets and kind, or set of publishers), so that sets
    meet sets and not stories stories; a story's own feedback is subtracted. Sums are in whole multiples of the
    decayed points; the subtraction is exact but for rounding, so counts, not sums, tell whether anything is left.
    """
    # dealt by reader once: what is summed by a reader and something else needs no shuffle of its own; features are dear
    r = with_reading(with_interest(requested, profiles), as_of).persist(StorageLevel.DISK_ONLY)
    negative = F.col("dismissed").isNotNull()
    weight = decay((F.lit(as_of) - F.coalesce("dismissed", "saved")) / (30.0 * DAY))
    said = r.where(F.col("saved").isNotNull() | negative).select(
        "reader", "story", "facets", "publishers", "kind", weight.alias("weight"), F.when(~negative, "kept").when(F.col("reason") == "topic", "topic").when(F.col("reason") == "source", "source").when(F.col("reason").isNull(), "plain").alias("why"),
    ).where("why is not null")
    by_facets = said.where("why <> 'source'").groupBy("reader", "why", "facets", F.when(F.col("why") == "plain", F.col("kind")).alias("of_kind")).agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    by_publishers = said.where("why = 'source'").groupBy("reader", F.col("publishers").alias("theirs")).agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    points = scoring.chosen(F.col("why"), {"kept": 8.0, "topic": -12.0, "plain": -2.0}, 0.0)
    sets = r.select("reader", F.col("facets").alias("mine"), "kind").distinct().join(by_facets, "reader")
    sets = sets.where(F.arrays_overlap("mine", "facets") & (F.col("of_kind").isNull() | (F.col("of_kind") == F.col("kind"))))
    sets = sets.groupBy("reader", "mine", "kind").agg(F.sum(points * F.col("weight")).alias("points"), F.sum("n").alias("n"), F.sum(F.when(F.col("why") == "kept", 0).otherwise(F.col("n"))).alias("against"))
    shops = r.select("reader", "publishers").distinct().join(by_publishers, "reader").where(F.arrays_overlap("publishers", "theirs"))
    shops = shops.groupBy("reader", "publishers").agg(F.sum(-10.0 * F.col("weight")).alias("shop_points"), F.sum("n").alias("shop_n"))
    out = with_bonus(r).join(sets.withColumnRenamed("mine", "facets"), ["reader", "facets", "kind"], "left").join(shops, ["reader", "publishers"], "left")
    # a story's own feedback always overlaps with itself
    state = F.when(F.col("saved").isNotNull(), 8.0).when(negative & (F.col("reason") == "topic"), -12.0).when(negative & (F.col("reason") == "source"), -10.0).when(negative & F.col("reason").isNull(), -2.0)
    n = F.coalesce("n", F.lit(0)) + F.coalesce("shop_n", F.lit(0)) - F.when(state.isNotNull(), 1).otherwise(0)
    total = F.when(n > 0, F.coalesce("points", F.lit(0.0)) + F.coalesce("shop_points", F.lit(0.0)) - F.coalesce(state * weight, F.lit(0.0))).otherwise(0.0)
    against = (F.coalesce("against", F.lit(0)) + F.coalesce("shop_n", F.lit(0))) > 0
    out = out.withColumn("bonus", F.when(against, 0.0).otherwise(F.coalesce("bonus", F.lit(0.0))))
    return out.withColumn("affinity", 50 + F.least(F.lit(40.0), F.greatest(F.lit(-40.0), total + F.col("bonus")))).drop("points", "n", "against", "shop_points", "shop_n", "own")


def with_reading(r: DataFrame, as_of: int) -> DataFrame:
    """``r`` with own, the strength of a story that is one of the reader's 150 latest read in 30 days, else null.

    A bookmark or a dismissal is the stronger signal, so such a story is no reading.
    """
    read = F.coalesce(F.col("saved").isNull() & F.col("dismissed").isNull() & (F.col("opened") > as_of - 30 * DAY), F.lit(False))
    nth = F.row_number().over(Window.partitionBy("reader").orderBy(F.desc(read), F.desc("opened"), "story"))
    return r.withColumn("nth", nth).withColumn("own", F.when(read & (F.col("nth") <= 150), 2 * decay((F.lit(as_of) - F.col("opened")) / (14.0 * DAY)))).drop("nth")


def with_bonus(r: DataFrame) -> DataFrame:
    """``r`` (with own) with bonus: strength of a story's best facet among the reader's readings.

    A facet counts if two stories other than the judged one support it, unless it is one of form or the reader switched it off. A reader's
    sums are a map with an entry for each facet there is, a handful, so stories are judged where they stand.
    """
    total = r.where(F.col("own").isNotNull()).select("reader", "own", F.explode("facets").alias("facet")).groupBy("reader", "facet").agg(F.count("*").alias("support"), F.sum("own").alias("strength"))
    sums = total.groupBy("reader").agg(F.map_from_entries(F.collect_list(F.struct("facet", F.struct("support", "strength")))).alias("read"))
    others = F.when(F.col("own").isNull(), 0).otherwise(1)

    def worth(facet: Column) -> Column:
        of = F.try_element_at("read", facet)
        return F.when(of["support"] - others >= 2, F.least(F.lit(20.0), of["strength"] - F.coalesce("own", F.lit(0.0))))

    wanted = F.array_except("facets", F.array_union("barred", F.array(*[F.lit(x) for x in (PAPER, PODCAST, OTHER)])))
    return r.join(sums, "reader", "left").withColumn("bonus", F.array_max(F.transform(wanted, worth))).drop("read")


def ranked(requested: DataFrame, profiles: DataFrame, as_of: int) -> DataFrame:
    """``affinity`` with rank."""
    a = affinity(requested, profiles, as_of)
    parts = {"significance": F.col("importance"), "value": F.col("value"), "interest": F.col("interest"), "recency": scoring.recency(F.col("freshness"), F.col("kind"), as_of), "quality": F.col("quality"), "affinity": F.col("affinity")}
    penalty = scoring.novelty_penalty(F.col("opened"), F.col("seen"), F.lit(False), as_of)
    return a.withColumn("rank", scoring.rank(parts, penalty, F.col("dismissed").isNotNull()))
