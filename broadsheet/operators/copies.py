"""Cohorts of copies: reports with the same title whose texts hold each other verbatim, but for numbers and negations that differ.

A title is only where to look. Reports of one title with the same sequence of numbers and the same counts of negations meet,
and a cohort takes a report only if it is a copy of every member (complete link), so no report in between joins two
stories. Titles, numbers and negations are told apart by column expressions; first titles alone say whose texts are looked at,
and each of these is taken apart once.

A title may stand over very many reports. Equal texts are one text with many reports. Which texts hold which is found by marks: the least
hashes of any WINDOWS neighbouring windows of MARK characters. They depend on what stands there alone, so all marks of a text are marks of each text
that holds it; a text is looked for under its rarest mark, and found texts are compared whole. The fold over reports reads no texts:
rows of one title pass in order of time, and it keeps what cohorts of the last 36 hours may still take.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.titles import letters, negations, numbers, trimmed
from .folders import written

HOUR = 3600
WINDOW, MOST, MEMBERS, GRAM, COMMON = 36 * HOUR, 64, 24, 5, 60
#: 60 different windows of five characters make 64 characters, and these hold 33 windows of 32: so every text that has copies has a mark.
MARK, WINDOWS = 32, 32


def copy_key(title: Column) -> Column:
    """What copies have in common in their title, null if it is too short or long to tell."""
    key = lambda plain: F.when(F.length(plain).between(24, 240), F.concat(F.lit("article-copy:"), plain, F.lit(":"), F.array_join(numbers(title), ",")))
    return F.transform(F.array(letters(title)), key)[0]


def material(title: Column, body: Column, published: Column) -> Column:
    """The body without what a publisher puts before and after it; null if less than 100 characters are left.

    Leading blocks go that repeat the title, name the source or are short and end with the time of publication (in UTC or
    eight hours ahead); closing ones that are blank or state that all rights are reserved.
    """
    stamp = lambda h: F.date_format(F.timestamp_seconds(published + h * HOUR), "yyyy-MM-dd HH:mm:ss")

    def leads(b: Column, r: Column) -> Column:
        stamped = (F.length(b) <= 100) & (b.endswith(r["stamp"]) | b.endswith(r["ahead"]))
        return b.startswith("来源：") | b.startswith("Source:") | F.coalesce(stamped, F.lit(False)) | (letters(b) == r["title"])

    def closes(b: Column) -> Column:
        return (b == "") | ((F.length(b) <= 100) & b.startswith("版权所有") & b.contains("转载"))

    def stay_from(blocks: Column, goes) -> Column:
        """How many blocks go before the first that stays, as -1 less that number; what comes after it is not looked at."""
        look = lambda n, block: F.when(n < 0, n).when(~goes(trimmed(block)), -n - 1).otherwise(n + 1)
        return F.aggregate(blocks, F.lit(0), look)

    def opened(r: Column) -> Column:
        first = F.transform(F.array(stay_from(r["blocks"], lambda b: leads(b, r))), lambda n: F.when(n < 0, F.slice(r["blocks"], -n, F.size(r["blocks"]))).otherwise(F.array().cast("array<string>")))
        return F.transform(first, closed)[0]

    def closed(rest: Column) -> Column:
        text = F.transform(F.array(stay_from(F.reverse(rest), closes)), lambda n: F.when(n < 0, F.array_join(F.slice(rest, 1, F.size(rest) + n + 1), "\n\n")))
        return F.transform(text, lambda t: F.when(F.length(t) >= 100, t))[0]

    own = F.struct(letters(title).alias("title"), stamp(0).alias("stamp"), stamp(8).alias("ahead"), F.split(body, "\n\n").alias("blocks"))
    return F.transform(F.array(own), opened)[0]


def marks(text: str) -> np.ndarray:
    """The marks of a text: those of any part of it are among them. A text of less than 63 characters has none."""
    h = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    factor, wide = np.uint64(0x9E3779B97F4A7C15), 1
    while wide < MARK:  # the hash of twice as many characters, from both halves
        h = h[: max(len(h) - wide, 0)] * factor + h[wide:]
        factor, wide = np.uint64(int(factor) ** 2 % 2**64), 2 * wide
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h, wide = h ^ (h >> np.uint64(32)), 1
    while wide < WINDOWS:
        h = np.minimum(h[: max(len(h) - wide, 0)], h[wide:])
        wide *= 2
    return np.unique(h).astype(np.int64)


def measured(rows: DataFrame) -> DataFrame:
    """``rows`` (meets, several, text, plain, n, first, last) with grams, how many windows of five characters differ, and marks of those that meet other texts; without texts of too few for copies."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.assign(grams=[len({t[i : i + GRAM] for i in range(len(t) - GRAM + 1)}) for t in pdf["plain"]])
            pdf = pdf[pdf["grams"] >= COMMON]
            yield pdf.assign(marks=[marks(t) if several else [] for t, several in zip(pdf["plain"], pdf["several"], strict=True)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(fold, f"{schema}, grams long, marks array<long>")


def copy_links(texts: DataFrame) -> DataFrame:
    """no, copies: the other texts that hold a text or are held by it, as copies. ``texts``: no, meets, plain, first, last, grams, marks.

    As one text holds the other, its windows of five characters are all in common: it needs three quarters of the other's.
    """
    size = F.length("plain").alias("size")
    # a hash of both: texts that do not meet may share one, and are told apart below
    each = written(texts.select("no", "meets", "grams", size, F.explode("marks").alias("mark")).select("no", "grams", "size", F.xxhash64("meets", "mark").alias("mark")))
    # tables of their own, here and below: so what many texts have in common is dealt to several tasks
    counts = written(each.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1"))
    rarest = each.join(counts, "mark", "left").groupBy("no", "grams", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "mark")).alias("r")).where("r.n > 1").select("no", "grams", "size", F.col("r.mark").alias("mark"))
    other = each.select(F.col("no").alias("other"), F.col("grams").alias("other_grams"), F.col("size").alias("other_size"), "mark")
    held = written(rarest.join(other, "mark").where("size < other_size and grams <= other_grams and 4 * grams >= 3 * other_grams").select("no", "other"))
    of = lambda p: [F.col(c).alias(p + c) for c in ("no", "meets", "plain", "first", "last")]
    both = held.join(texts.select(*of("")), "no").join(texts.select(*of("other_")).withColumnRenamed("other_no", "other"), "other")
    near = (F.col("meets") == F.col("other_meets")) & (F.col("first") <= F.col("other_last") + WINDOW) & (F.col("other_first") <= F.col("last") + WINDOW)
    pairs = written(both.where(near & F.col("other_plain").contains(F.col("plain"))).select("no", "other"))
    back = pairs.select(F.col("other").alias("no"), F.col("no").alias("other"))
    return pairs.unionByName(back).groupBy("no").agg(F.collect_list("other").alias("copies"))


class Cohort:
    """A cohort that may take more: ``fit`` are the texts that are copies of all its members."""

    __slots__ = ("at", "fit", "leader", "n", "texts")

    def __init__(self, at: int, leader: int, texts: frozenset[int]):
        self.at, self.leader, self.n, self.texts, self.fit = at, leader, 1, texts, texts


def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """item, leader, place, from rows in order of key and time. Each report goes to the first cohort that takes it.

    Cohorts wait under each text that fits them, the oldest first. One that is full, too old or no longer fits a text never fits it
    again and leaves, so each is looked at once for each text it waits under.
    """
    key, begun, waiting = None, deque(), defaultdict(deque)
    for pdf in batches:
        out = []
        for own, at, item, no, copies in zip(pdf["key"].tolist(), pdf["published"].tolist(), pdf["item"].tolist(), pdf["no"].tolist(), pdf["copies"], strict=True):
            if own != key:
                key, begun, waiting = own, deque(), defaultdict(deque)
            while begun and at - begun[0].at > WINDOW:
                for text in begun.popleft().texts:
                    while waiting[text] and at - waiting[text][0].at > WINDOW:
                        waiting[text].popleft()
                    if not waiting[text]:
                        del waiting[text]
            line = waiting[no]
            while line and (line[0].n >= MEMBERS or no not in line[0].fit):
                line.popleft()
            texts = frozenset([no] if copies is None else [no, *copies.tolist()])
            if not line:
                begun.append(Cohort(at, item, texts))
                for text in texts:
                    waiting[text].append(begun[-1])
                continue
            home = line[0]
            if home.n == 1:
                out.append((home.leader, home.leader, 0))
            out.append((item, home.leader, home.n))
            home.n, home.fit = home.n + 1, home.fit & texts
        if out:
            yield pd.DataFrame(out, columns=["item", "leader", "place"])


def copy_cohorts(reports: DataFrame, as_of: int, most: int | None = MOST) -> DataFrame:
    """item, leader, place of each report that has copies; the leader is the first of its cohort, at place 0.

    ``reports``: item, kind, title, body, published. Releases, discussions and what is published after ``as_of`` take no part.
    The reference passes over titles of more than MOST reports, without looking for copies; ``most`` null searches all titles.
    """
    fits = (~F.col("kind").isin("release", "discussion")) & (F.col("published") <= as_of)
    titled = reports.where(fits).withColumn("copy_key", copy_key(F.col("title")))
    looked = F.col("copy_key").isNotNull() & (F.col("n") >= 2)
    titles = written(titled.groupBy("copy_key").agg(F.count("*").alias("n")).where(looked if most is None else looked & (F.col("n") <= most)).select("copy_key"))
    # texts are dear to take apart: only those of titles that may be copies are, each once, and what is left of them is written
    denials = lambda t: F.concat_ws(",", F.transform(negations(t), lambda n: n.cast("string")))
    parts = lambda t: F.struct(letters(t).alias("plain"), F.concat_ws(",", numbers(t)).alias("figures"), denials(t).alias("denials"))
    told = F.transform(F.filter(F.array(material(F.col("title"), F.col("body"), F.col("published"))), lambda t: t.isNotNull()), parts)
    own = titled.join(titles, "copy_key", "left_semi").select("item", "published", "copy_key", F.explode(told).alias("own")).select("item", "published", "copy_key", "own.*")
    meets = F.sha2(F.concat_ws("\n", "copy_key", "figures", "denials"), 256)
    own = written(own.select("item", "published", meets.alias("meets"), F.sha2("plain", 256).alias("text"), "plain"))
    rows = own.select("item", "published", "meets", "text")
    each = rows.groupBy("meets", "text").agg(F.count("*").alias("n"), F.min("published").alias("first"), F.max("published").alias("last"))
    partners = written(each.groupBy("meets").agg(F.sum("n").alias("reports"), (F.count("*") > 1).alias("several")).where("reports > 1").select("meets", "several"))
    meet = each.join(partners, "meets").join(own.groupBy("meets", "text").agg(F.any_value("plain").alias("plain")), ["meets", "text"])
    texts = written(measured(meet).withColumn("no", F.monotonically_increasing_id()))
    links = copy_links(texts.where("several"))
    known = texts.select("meets", "text", "no", "n").join(links, "no", "left").where("n > 1 or copies is not null")
    # copies of no other text pass by themselves
    key = F.when(F.col("copies").isNull(), F.col("no")).otherwise(F.xxhash64("meets")).alias("key")
    passing = rows.join(known, ["meets", "text"]).select(key, "published", "item", "no", "copies")
    return passing.repartition("key").sortWithinPartitions("key", "published", "item", "no").mapInPandas(placed, "item long, leader long, place long")
