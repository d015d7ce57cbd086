"""Editions under quotas, and readers' states."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Quotas of an edition: rows of one publisher, of a kind of publisher, of one topic; rows that are essential.
PER_PUBLISHER, PER_KIND, PER_TOPIC, ESSENTIAL = 2, {"community": 2, "index": 2, "podcast": 3}, 5, 5


#: Hours within which a second report of one model is a repetition, and stories to catch up on in a daily edition.
STORY_SPAN, CATCH_UP = 96 * 3600, 3
CANDIDATE = "edition, item, rank, published, at, fresh, publishers, role, community, topic, story_key"


class Quotas:
    """What has room in an edition; stories are offered in order, and what was refused once stays refused."""

    def __init__(self, per_publisher: int, per_topic: int = PER_TOPIC):
        self.per_publisher, self.per_topic = per_publisher, per_topic
        self.publishers, self.topics, self.kinds, self.stories = Counter(), Counter(), Counter(), []

    def admit(self, r) -> bool:
        keys, key = list(r.publishers) or [f"unknown:{r.item}"], r.story_key if r.role != "first_party" else None
        kinds = [k for k, own in (("community", r.community), ("index", r.role == "index"), ("podcast", r.role == "podcast")) if own]
        if any(self.publishers[k] >= self.per_publisher for k in keys) or any(self.kinds[k] >= PER_KIND[k] for k in kinds) or self.topics[r.topic] >= self.per_topic:
            return False
        if key is not None and any(k == key and (at is None or r.at is None or abs(at - r.at) // 3600 * 3600 <= STORY_SPAN) for k, at in self.stories):
            return False
        self.publishers.update(keys)
        self.kinds.update(kinds)
        self.topics[r.topic] += 1
        if r.story_key is not None:
            self.stories.append((r.story_key, r.at))
        return True


def _short(candidates: DataFrame, per_publisher: int) -> DataFrame:
    """Of candidates that quotas cannot tell apart, the first ``per_publisher``, and all that may repeat a model's story.

    This loses nothing. Quotas only fill up: of rows with equal publishers, role, topic and section, once one is refused so are
    all later ones, and after ``per_publisher`` admitted ones their publishers are full. Only the rule of one report a model looks at more.
    """
    order = [F.desc("rank"), F.desc_nulls_last("published"), F.col("item")]
    nth = F.row_number().over(Window.partitionBy("edition", "fresh", F.array_join(F.array_sort("publishers"), "|"), "role", "community", "topic").orderBy(*order))
    alone = (F.size("publishers") == 0) | (F.col("story_key").isNotNull() & (F.col("role") != "first_party"))
    return candidates.withColumn("_nth", nth).where((F.col("_nth") <= per_publisher) | alone).drop("_nth")


def _in_order(pdf: pd.DataFrame) -> list:
    pdf = pdf.sort_values(["rank", "published", "item"], ascending=[False, False, True], na_position="last")
    pdf = pdf.astype({"at": object, "story_key": object})
    return list(pdf.where(pdf.notna(), None).itertuples(index=False))


def daily_editions(candidates: DataFrame, size: int, per_publisher: int = PER_PUBLISHER) -> DataFrame:
    """edition, item, position, section: the main list in rank order within all quotas, then up to three stories to catch up on.

    ``candidates`` (CANDIDATE): ``fresh`` rows are of the edition's own day, others are worth catching up on and in no earlier edition. All of a
    story's publishers need room. Only first parties may tell a named model's story again within 96 hours. Of the main list the
    first five are essential. The choice is sequential, so an edition's candidates meet in one task, after what quotas cannot tell apart is cut.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        quotas, out, late = Quotas(per_publisher), [], 0
        rows = _in_order(pdf)
        for r in [r for r in rows if r.fresh] + [r for r in rows if not r.fresh]:
            if len(out) == size or (not r.fresh and late == CATCH_UP):
                break
            if quotas.admit(r):
                late += not r.fresh
                out.append((r.edition, r.item, len(out) + 1, "catch_up" if not r.fresh else "essential" if len(out) < ESSENTIAL else "more"))
        return pd.DataFrame(out, columns=["edition", "item", "position", "section"])

    return _short(candidates, per_publisher).groupBy("edition").applyInPandas(choose, "edition long, item long, position long, section string")


def weekly_editions(candidates: DataFrame, size: int, per_publisher: int = 3) -> DataFrame:
    """edition, item, position, section: one list within the quotas, put together by topic in the order of each topic's best (``candidates``: CANDIDATE)."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        quotas, chosen = Quotas(per_publisher), []
        for r in _in_order(pdf):
            if len(chosen) == size:
                break
            if quotas.admit(r):
                chosen.append(r)
        topics = list(dict.fromkeys(r.topic for r in chosen))
        ordered = [r for t in topics for r in chosen if r.topic == t]
        return pd.DataFrame([(r.edition, r.item, k, f"topic-{topics.index(r.topic)}") for k, r in enumerate(ordered, 1)], columns=["edition", "item", "position", "section"])

    return _short(candidates.withColumn("fresh", F.lit(True)), per_publisher).groupBy("edition").applyInPandas(choose, "edition long, item long, position long, section string")


def reader_states(actions: DataFrame, as_of: int) -> DataFrame:
    """reader, story, seen, opened, saved, dismissed (times or null), reason after all actions up to ``as_of``.

    The latest of saving, dismissing and releasing wins: dismissing clears the save, saving clears the dismissal, releasing
    clears both. Dismissing again keeps the first time and takes the new reason. One aggregation, combined before its shuffle;
    of a reader and story only the dismissals are held in a row.
    """
    last = lambda kind: F.max(F.when(F.col("action") == kind, F.struct("moment", "action_id")))
    sums = actions.where(F.col("moment") <= as_of).groupBy("reader", "story").agg(
        F.max(F.when(F.col("action").isin("seen", "opened"), F.col("moment"))).alias("seen"), F.max(F.when(F.col("action") == "opened", F.col("moment"))).alias("opened"),
        last("saved").alias("save"), last("unsaved").alias("free"), F.collect_list(F.when(F.col("action") == "dismissed", F.struct("moment", "action_id", "reason"))).alias("gone"),
    )
    never = F.struct(F.lit(-1).cast("long").alias("moment"), F.lit(-1).cast("long").alias("action_id"))
    save, free = F.coalesce("save", never), F.coalesce("free", never)
    of = sums.withColumn("clear", F.greatest(save, free))
    of = of.withColumn("gone", F.array_sort(F.filter("gone", lambda x: (x["moment"] > F.col("clear.moment")) | ((x["moment"] == F.col("clear.moment")) & (x["action_id"] > F.col("clear.action_id"))))))
    still = F.size("gone") > 0
    return of.select(
        "reader", "story", "seen", "opened", F.when(~still & (save > free), F.col("save.moment")).alias("saved"), F.when(still, F.col("gone")[0]["moment"]).alias("dismissed"),
        F.when(still, F.element_at("gone", -1)["reason"]).alias("reason"),
    )
