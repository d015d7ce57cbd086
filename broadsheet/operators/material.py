"""How much of each source's material goes into one summary: a fair share first, then rounds by length, all within a budget.

Column expressions only; an array holds one story's lengths, twelve at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Characters in all, of each source at first, and of each source in a round; sources; the part of a share that is kept for structured material.
BUDGET, SHARE, STEP, SOURCES, RESERVED = 16_000, 1_000, 500, 12, 3
#: No source gets more than the budget, so no more rounds have anything to give.
ROUNDS = (BUDGET - SHARE) // STEP


def shares(lengths: Column) -> Column:
    """Characters that each source gets, in the order of ``lengths``.

    Each gets up to SHARE. What is left goes round in steps of STEP, the longest first (of equal ones the first), until it is
    used up or nobody needs more.
    """
    need = F.transform(lengths, lambda n: F.least(n.cast("long"), F.lit(BUDGET)))
    # longest first; the place says where each belongs
    order = F.array_sort(F.transform(lengths, lambda n, i: F.struct((-n.cast("long")).alias("less"), i.alias("place"), F.least(n.cast("long"), F.lit(BUDGET)).alias("need"))))
    start = F.transform(order, lambda x: F.least(x["need"], F.lit(SHARE).cast("long")))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)

    def round_(got: Column, _: Column) -> Column:
        wants = F.zip_with(order, got, lambda x, g: F.least(x["need"] - g, F.lit(STEP).cast("long")))
        left = F.greatest(F.lit(BUDGET) - total(got), F.lit(0)).cast("long")
        return F.zip_with(got, F.transform(wants, lambda w, i: F.greatest(F.lit(0).cast("long"), F.least(w, left - total(F.slice(wants, F.lit(1), i))))), lambda g, more: g + more)

    got = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_)
    back = F.array_sort(F.zip_with(order, got, lambda x, g: F.struct(x["place"].alias("place"), g.alias("got"))))
    return F.when(F.size(need) > 0, F.transform(back, lambda x: x["got"])).otherwise(F.array().cast("array<long>"))


def parted(body: Column, structured: Column, share: Column) -> Column:
    """struct(body, structured): characters of each within a source's share; a third is kept for structured material, as far as there is any."""
    kept = F.least(structured, F.greatest(F.floor(share / RESERVED), F.lit(1)))
    of_body = F.when(structured == 0, F.least(body, share)).otherwise(F.least(body, F.greatest(share - kept, F.lit(0))))
    of_rest = F.when(body == 0, F.least(structured, share)).otherwise(F.least(structured, F.greatest(share - of_body, F.lit(0))))
    return F.struct(of_body.cast("long").alias("body"), of_rest.cast("long").alias("structured"))


def allocated(evidence: DataFrame) -> DataFrame:
    """story, item, place, body_chars, structured_chars of the twelve newest sources of each story.

    ``evidence``: story, item, published, body_length, structured_length. Only lengths are gathered, those of twelve sources a story.
    """
    nth = F.row_number().over(Window.partitionBy("story").orderBy(F.desc_nulls_last("published"), "item"))
    newest = evidence.withColumn("place", nth).where(F.col("place") <= SOURCES)
    own = F.array_sort(F.collect_list(F.struct("place", "item", F.coalesce("body_length", F.lit(0)).cast("long").alias("body"), F.coalesce("structured_length", F.lit(0)).cast("long").alias("rest"))))
    by_story = newest.groupBy("story").agg(own.alias("own")).withColumn("shares", shares(F.transform("own", lambda x: x["body"] + x["rest"])))
    each = by_story.select("story", F.explode(F.arrays_zip("own", "shares")).alias("x"))
    return each.select("story", "x.own.item", "x.own.place", parted(F.col("x.own.body"), F.col("x.own.rest"), F.col("x.shares")).alias("p")).select("story", "item", "place", F.col("p.body").alias("body_chars"), F.col("p.structured").alias("structured_chars"))
