"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step replaces a node's links by links to its least neighbour. Both are aggregations and joins on the node,
so a node with very many links is combined in every task before it is shuffled, and its join may be split by
adaptive execution. After each round the links are written to the shared folder and read again; the rounds,
of which there are about log2 of the largest diameter, end when the links no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (a, b); root is the least node of the component and stands beside itself too.

    Links of a node to itself and repeated links are of no account. Null ends are left out.
    """
    now = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = saved(now, "links")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = saved(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        dropped(now)
        before, now = state, new
        state = _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
