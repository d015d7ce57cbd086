"""The group arbiter: leaders in rank order each take their best group, and what one has taken no later one takes again.

Taken one by one this is a fold over all leaders. Here it goes in rounds: a leader is ready when no undecided leader
of a lower rank is, or may take, itself or any member it may take. So no two ready leaders touch the same rows, and all
are decided at once, by aggregations and joins. The rest waits for the next round. Who is in one large group ends with it, as its
first leader takes all. Leaders, offers and members are tables of their own, so a group costs its rows, not their square;
each round's results are written, so executors may be lost.

Chains of overlapping groups can make many rounds of few rows. Once no more than FEW rows are left, one task folds them in
rank order: its input is bounded, and the result is the same.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folders import written

FEW = 20_000


def decided(claims: DataFrame) -> DataFrame:
    """leader, option, member of leaders whose claims are disjoint, each alone or with its group.

    ``claims``: leader, tier, option, span, keeps, member, at, gone; a leader's rows are all its offers' members.
    """
    free = claims.where((F.col("member") == F.col("leader")) | F.col("keeps") | ~F.col("gone"))
    own = F.col("member") == F.col("leader")
    sizes = free.groupBy("leader", "tier", "option").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max(F.when(own, F.col("at"))).alias("own_at"))
    best = sizes.where("n > 1 and own_at is not null").groupBy("leader").agg(F.min(F.struct("tier", (-F.col("n")).alias("less"), "option")).alias("b")).select("leader", "b.option")
    kept = free.join(best, ["leader", "option"]).join(sizes.select("leader", "option", "first", "own_at"), ["leader", "option"]).where("at <= first + span and own_at <= first + span")
    several = kept.groupBy("leader").agg(F.count("*").alias("n")).where("n > 1").select("leader")
    return kept.join(several, "leader", "left_semi").select("leader", "option", "member")


def folded(rows: pd.DataFrame) -> pd.DataFrame:
    """leader, option, member of all leaders of ``rows`` (rank beside what ``decided`` reads; option null: no offer), one by one."""
    taken, out = set(rows.loc[rows["gone"], "member"]), []
    for _, own in rows.groupby("rank", sort=True):
        leader = own["leader"].iloc[0]
        if leader in taken:
            continue
        free = own[own["option"].notna() & ((own["member"] == leader) | own["keeps"].fillna(False).astype(bool) | ~own["member"].isin(taken))]
        options = [((tier, -len(o), name), o) for (tier, name), o in free.groupby(["tier", "option"]) if len(o) > 1 and (o["member"] == leader).any()]
        name, members = None, [leader]
        if options:
            (_, _, best), o = min(options, key=lambda x: x[0])
            inside = o[o["at"] <= o["at"].min() + o["span"].iloc[0]]["member"].tolist()
            if len(inside) > 1 and leader in inside:
                name, members = best, inside
        taken.update(members)
        out += [(leader, name, m) for m in members]
    return pd.DataFrame(out, columns=["leader", "option", "member"])


def assigned_groups(leaders: DataFrame, offers: DataFrame, members: DataFrame) -> DataFrame:
    """leader, option, member: each group with all its members, the leader among them, and each leader that stays alone with a null option.

    ``leaders``: rank (no two alike), leader. ``offers``: leader, tier, option, span, keeps. ``members``: option, member, at. Only a leader's
    offers of the lowest tier that leave it a group count; of these the one with most members, then the least name. Members that are
    taken already count as long as the offer ``keeps`` them. Members later than ``span`` after the earliest are left out; the
    leader stays alone if it is one of them, or if nobody else is left.
    """
    offers = written(offers.join(leaders, "leader").select("rank", "leader", "tier", "option", "span", "keeps"))
    members = written(members.join(offers.select("option").distinct(), "option", "left_semi").select("option", "member", "at").distinct())
    left = written(leaders.join(offers.select("leader").distinct(), "leader", "left_semi"))
    groups = leaders.join(offers.select("leader").distinct(), "leader", "left_anti")
    # who has no offer and is no one's member is alone at once; who is a member waits for what becomes of it
    wanted = members.select(F.col("member").alias("leader")).distinct()
    left = written(left.unionByName(groups.join(wanted, "leader", "left_semi").select(*left.columns)))
    kind = offers.schema["option"].dataType
    done = [groups.join(wanted, "leader", "left_anti").select("leader", F.lit(None).cast(kind).alias("option"), F.col("leader").alias("member"))]
    taken = written(members.select("member").where(F.lit(False)))
    schema = ", ".join(f"{c} {t.dataType.simpleString()}" for c, t in (("leader", leaders.schema["leader"]), ("option", offers.schema["option"]), ("member", members.schema["member"])))
    while True:
        now = offers.join(left.select("rank"), "rank", "left_semi")
        claims = now.join(members, "option").join(taken.withColumn("_taken", F.lit(True)), "member", "left").withColumn("gone", F.coalesce("_taken", F.lit(False))).drop("_taken")
        if left.isEmpty():
            break
        if claims.count() + left.count() <= FEW:
            rows = left.join(claims.drop("leader"), "rank", "left").withColumn("gone", F.coalesce("gone", F.lit(False))).withColumn("member", F.coalesce("member", "leader"))
            done.append(written(rows.groupBy(F.lit(0).alias("all")).applyInPandas(folded, schema)))
            break
        # the least rank that wants an option, a member, and anyone beside it
        of_option = now.groupBy("option").agg(F.min("rank").alias("low"))
        of_member = members.join(of_option, "option").select("member", "low").unionByName(left.select(F.col("leader").alias("member"), F.col("rank").alias("low"))).groupBy("member").agg(F.min("low").alias("low"))
        within = members.join(of_member, "member").groupBy("option").agg(F.min("low").alias("low"))
        waits = now.join(within, "option").where("low < rank").select("rank").unionByName(left.join(of_member, F.col("leader") == F.col("member")).where("low < rank").select("rank"))
        ready = written(left.join(waits.distinct(), "rank", "left_anti"))
        new = decided(claims.join(ready.select("rank"), "rank", "left_semi"))
        alone = ready.join(new.select("leader").distinct(), "leader", "left_anti").select("leader", F.lit(None).cast(kind).alias("option"), F.col("leader").alias("member"))
        new = written(new.unionByName(alone))
        done.append(new)
        gone = new.select("member").distinct()
        taken = written(taken.unionByName(gone).distinct())
        left = written(left.join(ready.select("rank"), "rank", "left_anti").join(gone, F.col("leader") == F.col("member"), "left_anti"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
