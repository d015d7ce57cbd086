"""Near-duplicate titles: a set-similarity join with prefix filter, within periods of time and by exact number tokens.

Two titles of 55 characters at least are near-duplicates if their number tokens and those of their addresses are equal, they have eight tokens in
common and a Jaccard similarity of 0.88 of their token sets. Sets this similar share a token among the rarest few of each
(the prefix), so titles meet under those alone, never all against all. Equal titles are one class with many reports: classes
are compared, and a report finds the report it belongs to by a window over time, so a title that very many
reports carry costs as many rows as it has reports. A window covers two periods of SPAN at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.titles import distinctive, number_tokens, overlap, title_tokens, trigrams
from .folders import written

SPAN, LEAST_CHARS, LEAST_TOKENS, LEAST_DISTINCTIVE, TRIGRAMS = 36 * 3600, 55, 8, 4, 0.65


def title_classes(reports: DataFrame) -> DataFrame:
    """``reports`` (item, kind, title, url, published) that may have a near-duplicate, with tokens, figures and class (of equal title, kind and figures)."""
    known = reports.where("published is not null and title is not null and url is not null").where(F.length("title") >= LEAST_CHARS)
    told = known.withColumn("tokens", title_tokens(F.col("title")))
    told = told.where((F.size("tokens") >= LEAST_TOKENS) & (distinctive(F.col("tokens")) >= LEAST_DISTINCTIVE))
    figures = F.concat_ws("|", F.array_join(number_tokens(F.col("tokens")), " "), F.array_join(number_tokens(title_tokens(F.col("url"))), " "))
    return told.withColumn("figures", figures).withColumn("class", F.sha2(F.concat_ws("\n", F.coalesce("kind", F.lit("")), "figures", "title"), 256))


def similar_classes(classes: DataFrame) -> DataFrame:
    """class, other, likeness (of trigrams) of near-duplicate titles, both ways and each with itself. ``classes``: class, kind, figures, title, tokens."""
    ranks = classes.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    each = classes.select("class", "kind", "figures", F.size("tokens").alias("size"), F.explode("tokens").alias("token")).join(ranks, "token")
    by_rarity = F.sort_array(F.collect_list(F.struct("n", "token")))
    # of sets of a and b tokens that are 0.88 alike, at least 0.88 a are common: the rest, and one more, hold one of them
    prefixes = each.groupBy("class", "kind", "figures", "size").agg(by_rarity.alias("all"))
    prefixes = prefixes.withColumn("token", F.explode(F.expr("transform(slice(all, 1, size - cast(ceil(size * 88 / 100) as int) + 1), t -> t.token)"))).drop("all")
    other = prefixes.select(F.col("class").alias("other"), F.col("kind").alias("other_kind"), F.col("figures").alias("other_figures"), F.col("size").alias("other_size"), F.col("token").alias("other_token"))
    meet = prefixes.join(other, F.col("kind").eqNullSafe(F.col("other_kind")) & (F.col("figures") == F.col("other_figures")) & (F.col("token") == F.col("other_token")))
    meet = meet.where((F.col("class") < F.col("other")) & (100 * F.least("size", "other_size") >= 88 * F.greatest("size", "other_size"))).select("class", "other").distinct()
    of = lambda c: classes.select(F.col("class").alias(c), F.col("tokens").alias(f"{c}_tokens"), F.col("title").alias(f"{c}_title"))
    both = meet.join(of("class"), "class").join(of("other"), "other")
    common = F.size(F.array_intersect("class_tokens", "other_tokens"))
    near = (common >= LEAST_TOKENS) & (100 * common >= 88 * (F.size("class_tokens") + F.size("other_tokens") - common))
    near = both.where(near).withColumn("likeness", overlap(trigrams(F.col("class_title")), trigrams(F.col("other_title")))).where(F.col("likeness") >= TRIGRAMS)
    pairs = near.select("class", "other", "likeness")
    back = pairs.select(F.col("other").alias("class"), F.col("class").alias("other"), "likeness")
    return pairs.unionByName(back).unionByName(classes.select("class", F.col("class").alias("other"), F.lit(1.0).alias("likeness")))


def near_titles(reports: DataFrame) -> DataFrame:
    """item, match, likeness: of each report the near-duplicate it belongs to, among those of the 36 hours before it (by time, then item).

    The match is the most alike, of these the first; reports without one are left out. Rows without title, address or time match nothing.
    """
    # texts are read and titles told apart once; classes are joined with each other from what is written
    told = written(title_classes(reports).select("item", "published", "class", "kind", "figures", "title", "tokens"))
    classes = written(told.groupBy("class").agg(*[F.any_value(c).alias(c) for c in ("kind", "figures", "title", "tokens")]))
    rows = told.select("item", "published", "class")
    asks = rows.join(similar_classes(classes), "class").select("item", "published", F.col("other").alias("class"), "likeness")
    period = F.floor(F.col("published") / SPAN)
    given = rows.select("item", "published", "class", F.lit(None).cast("double").alias("likeness"), F.explode(F.array(period, period + 1)).alias("period"))
    both = asks.withColumn("period", period).unionByName(given)
    # a report of another class may stand at the same time; the order of items says which came before
    before = Window.partitionBy("class", "period").orderBy("published").rangeBetween(-SPAN, 0)
    first = F.min(F.when(F.col("likeness").isNull(), F.struct("published", "item"))).over(before)
    found = both.withColumn("first", first).where("likeness is not null").where((F.col("first.published") < F.col("published")) | (F.col("first.item") < F.col("item")))
    best = found.groupBy("item").agg(F.min(F.struct((-F.col("likeness")).alias("far"), F.col("first.published").alias("at"), F.col("first.item").alias("match"))).alias("b"))
    return best.select("item", F.col("b.match").alias("match"), (-F.col("b.far")).alias("likeness"))
