"""Queries of the read path: scores, filters, joins, aggregates, windows and editions over the derived views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import editions, scoring, windows
from ..sources.views import AS_OF, DAY, HOUR, actions, items, sources, table, with_views


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their sources; a few bytes a row, texts are not read past the title."""
    return items(spark, sf_dir).join(sources(spark, sf_dir), "source")


def k1_evidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.evidence_score(_evidence(spark, sf_dir), AS_OF)
    return s.select("story", "n_evidence", "quality", "corroboration", F.round("freshness", 6).alias("freshness"), F.round("score", 1).alias("score"))


_SCORE = f"""+, s as (select story, count(*) as n_evidence, max(case tier when 'T1' then 85 when 'T1.5' then 70 when 'T2' then 55 else 40 end + case when official then 10 else 0 end)::double as quality,
  least(100, 25 * greatest(count(distinct domain) - 1, 0))::double as corroboration, max(published) filter (where published <= {AS_OF} + 300) as latest from items join sources using (source) group by story),
k as (select *, coalesce(100 * power(2.0, -greatest({AS_OF} - latest, 0) / 172800.0), 0) as freshness from s),
r as (select *, floor((0.45 * quality + 0.20 * corroboration + 0.35 * freshness) * 10 + 0.5) / 10 as score from k)"""
K1 = with_views(_SCORE + " select story, n_evidence, quality, corroboration, round(freshness, 6) as freshness, round(score, 1) as score from r", "items", "sources")


def o3_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best stories."""
    s = scoring.evidence_score(_evidence(spark, sf_dir), AS_OF)
    return s.orderBy(F.desc("score"), F.desc_nulls_last("latest"), "story").limit(50).select("story", F.round("score", 1).alias("score"), "latest")


O3 = with_views(_SCORE + " select story, round(score, 1) as score, latest from r order by r.score desc, latest desc nulls last, story limit 50", "items", "sources")


def f2_list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved, not dismissed stories of the last twelve days that have an item of a first-tier source."""
    i = _evidence(spark, sf_dir)
    states = editions.reader_states(actions(spark, sf_dir), AS_OF).where("saved is not null and dismissed is null")
    fresh = i.where((F.col("published") <= AS_OF) & (F.col("published") > AS_OF - 12 * DAY)).select("story")
    first = i.where("tier = 'T1'").select("story")
    return states.join(fresh, "story", "left_semi").join(first, "story", "left_semi").select("reader", "story", "saved")


_STATES = f"""a as (select *, moment * 1000000000 + action_id as mark from actions where moment <= {AS_OF}), l as (select reader, story, max(moment) filter (where action in ('seen', 'opened')) as seen,
  max(moment) filter (where action = 'opened') as opened, coalesce(max(mark) filter (where action = 'saved'), -1) as save, coalesce(max(mark) filter (where action in ('saved', 'unsaved')), -1) as clear from a group by reader, story),
g as (select l.reader, l.story, min(moment) as dismissed, arg_max(coalesce(reason, ''), mark) as reason from l join a using (reader, story) where action = 'dismissed' and mark > clear group by all),
states as (select l.reader, l.story, seen, opened, case when dismissed is null and save >= 0 and save = clear then save // 1000000000 end as saved, dismissed, nullif(reason, '') as reason from l left join g using (reader, story))"""
F2 = with_views(
    f"""+, {_STATES} select reader, story, saved from states where saved is not null
  and story in (select story from items where published <= {AS_OF} and published > {AS_OF} - {12 * DAY}) and story in (select story from items join sources using (source) where tier = 'T1')""",
    "items", "sources", "actions",
)


def u1_reader_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editions.reader_states(actions(spark, sf_dir), AS_OF)


U1 = with_views(f"+, {_STATES} select * from states", "actions")


def f7_source_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories all of whose items come from the upper tiers."""
    return _evidence(spark, sf_dir).groupBy("story").agg(F.bool_and(F.col("tier").isin("T1", "T1.5")).alias("gate"), F.bool_or("official").alias("confirmed")).where("gate")


F7 = with_views("select story, bool_and(tier in ('T1', 'T1.5')) as gate, bool_or(official) as confirmed from items join sources using (source) group by story having gate", "items", "sources")


def j4_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories that nobody dismissed in the three days before the cut-off, with their items."""
    gone = actions(spark, sf_dir).where((F.col("action") == "dismissed") & F.col("moment").between(AS_OF - 3 * DAY, AS_OF)).select("story")
    return items(spark, sf_dir).join(gone, "story", "left_anti").groupBy("story").agg(F.count("*").alias("n_items"))


J4 = with_views(f"select story, count(*) as n_items from items i where not exists (select 1 from actions a where a.story = i.story and a.action = 'dismissed' and a.moment between {AS_OF - 3 * DAY} and {AS_OF}) group by story", "items", "actions")


def j10_time_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of orders of one customer at most 36 hours apart: joined on customer and bucket, with the neighbouring bucket."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(o_orderdate as timestamp_ntz))").alias("moment"))
    o = o.withColumn("b", F.floor(F.col("moment") / (36 * HOUR)))
    right = o.select(F.col("k").alias("k2"), "c", F.col("moment").alias("at2"), F.explode(F.array(F.col("b"), F.col("b") - 1)).alias("b"))
    left = o.select("k", "c", "moment", "b")
    near = (F.col("at2") - F.col("moment")).between(0, 36 * HOUR) & ((F.col("at2") > F.col("moment")) | (F.col("k2") > F.col("k")))
    return left.join(right, ["c", "b"]).where(near).select(F.col("k").alias("earlier"), F.col("k2").alias("later"), F.col("c").alias("customer"))


J10 = """select a.o_orderkey as earlier, b.o_orderkey as later, a.o_custkey as customer from orders a join orders b on a.o_custkey = b.o_custkey
  and epoch_us(b.o_orderdate) - epoch_us(a.o_orderdate) between 0 and 129600000000 and (b.o_orderdate > a.o_orderdate or b.o_orderkey > a.o_orderkey)"""


def g4_best_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item of the best tier of each story, the earliest of equals, and its titles newest first."""
    e = _evidence(spark, sf_dir).withColumn("points", scoring.chosen(F.col("tier"), scoring.TIER_POINTS, scoring.OTHER_TIER))
    return e.groupBy("story").agg(
        F.max_by("item", F.struct("points", -F.col("published"), -F.col("item"))).alias("best"),
        F.sha2(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("published", "item", "source")))), lambda x: x["source"]), " "), 256).alias("newest_first_sha256"),
        F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains"),
    )


G4 = with_views(
    """select story, arg_max(item, (case tier when 'T1' then 85 when 'T1.5' then 70 else 55 end, -published, -item)) as best,
  sha256(string_agg(source, ' ' order by published desc, item desc)) as newest_first_sha256, string_agg(distinct domain, ',' order by domain) as domains from items join sources using (source) group by story""",
    "items", "sources",
)


def g11_first_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first item of each source and language."""
    return items(spark, sf_dir).groupBy("source", "lang").agg(F.min_by("item", F.struct("published", "item")).alias("first_item"), F.min("published").alias("published"))


G11 = with_views("select distinct on (source, lang) source, lang, item as first_item, published from items order by source, lang, published, item", "items")


def g13_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources that cover one story, and how many stories they share."""
    of = items(spark, sf_dir).select("story", "source").distinct()
    # at most five sources a story, so an array of them is bounded
    pairs = of.groupBy("story").agg(F.array_sort(F.collect_set("source")).alias("s")).select(F.explode(F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("source_a"), F.col("p.b").alias("source_b")).agg(F.count("*").alias("n_stories"))


G13 = with_views("+, o as (select distinct story, source from items) select a.source as source_a, b.source as source_b, count(*) as n_stories from o a join o b on a.story = b.story and a.source < b.source group by all", "items")


def g14_source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named groups of sources, counted in one pass and stacked."""
    groups = {"first_tier": "tier = 'T1'", "official": "official", "companies": "entity in ('company', 'lab')", "community": "entity = 'community'", "paused": "lifecycle = 'paused'", "observing": "lifecycle = 'observing'"}
    sums = sources(spark, sf_dir).agg(*[F.count_if(F.expr(p)).alias(n) for n, p in groups.items()])
    return sums.select(F.stack(F.lit(len(groups)), *[x for n in groups for x in (F.lit(n), F.col(n))]).alias("grp", "n_sources"))


G14 = with_views(
    """select unnest(['first_tier', 'official', 'companies', 'community', 'paused', 'observing']) as grp, unnest([count(*) filter (where tier = 'T1'), count(*) filter (where official),
  count(*) filter (where entity in ('company', 'lab')), count(*) filter (where entity = 'community'), count(*) filter (where lifecycle = 'paused'), count(*) filter (where lifecycle = 'observing')]) as n_sources from sources""",
    "sources",
)


def g16_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of "long texts are good" against the labels, by language; null where undefined."""
    j = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.length("text") >= 1000).alias("said")).join(table(spark, sf_dir, "labels"), "doc_id")
    sums = j.groupBy("lang").agg(F.count_if(F.col("said") & (F.col("quality") == 1)).alias("tp"), F.count_if(F.col("said") & (F.col("quality") == 0)).alias("fp"), F.count_if(~F.col("said") & (F.col("quality") == 1)).alias("fn"))
    return sums.select("lang", "tp", "fp", "fn", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"))


G16 = """select lang, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall from (
  select lang, count(*) filter (where length(text) >= 1000 and quality = 1) as tp, count(*) filter (where length(text) >= 1000 and quality = 0) as fp,
  count(*) filter (where not length(text) >= 1000 and quality = 1) as fn from documents join labels using (doc_id) group by lang)"""


def p3_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of lengths as thresholds: accepted rows and false accepts. The grid is a constant of 24 rows."""
    grid = spark.createDataFrame([(100 * a, 500 * b) for a in range(6) for b in range(1, 5)], "least int, most int")
    j = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")).join(table(spark, sf_dir, "labels"), "doc_id").groupBy("n", "quality").agg(F.count("*").alias("rows"))
    hit = j.join(F.broadcast(grid), (F.col("n") >= F.col("least")) & (F.col("n") < F.col("most")))
    return hit.groupBy("least", "most").agg(F.sum("rows").alias("accepted"), F.sum(F.when(F.col("quality") == 0, F.col("rows")).otherwise(0)).alias("false_accepts"))


P3 = """select least::int as least, most::int as most, count(*) as accepted, count(*) filter (where quality = 0) as false_accepts from documents join labels using (doc_id),
  (select 100 * a as least, 500 * b as most from range(6) x(a), range(1, 5) y(b)) g where length(text) >= least and length(text) < most group by all"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order_id"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(o_orderdate as timestamp_ntz))").alias("moment"))


def w1_newest_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer in windows of 90 days that hang on their newest."""
    w = windows.anchored_windows(_orders(spark, sf_dir), "customer", "moment", 90 * DAY, "order_id", newest=True)
    return w.groupBy("customer", "window_no").agg(F.count("*").alias("n_orders"), F.max("anchor").alias("anchor"))


def w2_oldest_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.anchored_windows(_orders(spark, sf_dir), "customer", "moment", 30 * DAY, "order_id", newest=False)
    return w.groupBy("customer", "window_no").agg(F.count("*").alias("n_orders"), F.max("anchor").alias("anchor"))


def _anchored(span: int, pick: str, beyond: str) -> str:
    return f"""with recursive o as (select o_custkey as customer, epoch_us(o_orderdate) // 1000000 as moment from orders), w(customer, window_no, anchor) as (
  select customer, 0::bigint, {pick}(moment) from o group by customer
  union all select w.customer, w.window_no + 1, (select {pick}(o.moment) from o where o.customer = w.customer and o.moment {beyond}) from w where exists (select 1 from o where o.customer = w.customer and o.moment {beyond}))
select w.customer, window_no, count(*) as n_orders, anchor from w join o on o.customer = w.customer and abs(o.moment - w.anchor) <= {span} and {"o.moment <= w.anchor" if pick == "max" else "o.moment >= w.anchor"} group by all"""


W1 = _anchored(90 * DAY, "max", f"< w.anchor - {90 * DAY}")
W2 = _anchored(30 * DAY, "min", f"> w.anchor + {30 * DAY}")


def w4_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best stories of each local day, numbered, the first five essential."""
    s = scoring.evidence_score(_evidence(spark, sf_dir), AS_OF).where("latest is not null").withColumn("day", F.floor((F.col("latest") + 8 * HOUR) / DAY).cast("long"))
    nth = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("score"), "story"))
    return s.withColumn("position", nth.cast("long")).where("position <= 10").select("day", "story", "position", F.when(F.col("position") <= 5, "essential").otherwise("more").alias("section"))


W4 = with_views(_SCORE + """ select * from (select (latest + 28800) // 86400 as day, story, row_number() over (partition by (latest + 28800) // 86400 order by score desc, story) as position,
  case when row_number() over (partition by (latest + 28800) // 86400 order by score desc, story) <= 5 then 'essential' else 'more' end as section from r where latest is not null) where position <= 10""", "items", "sources")  # fmt: skip


def o5_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of twenty of the newest items."""
    return items(spark, sf_dir).orderBy(F.desc_nulls_last("published"), "item").offset(40).limit(20).select("item", "published")


O5 = with_views("select item, published from items order by published desc nulls last, item limit 20 offset 40", "items")


def a1_due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sources whose last item is older than their floor, the longest silent first."""
    last = items(spark, sf_dir).where(F.col("published") <= AS_OF).groupBy("source").agg(F.max("published").alias("last"))
    s = sources(spark, sf_dir).where("lifecycle in ('stable', 'observing')").join(last, "source", "left")
    floor = F.greatest(F.lit(30), scoring.chosen(F.col("entity"), {"lab": 720, "project": 360, "company": 180, "community": 1440}, 1)) * 60
    due = s.where(F.col("last").isNull() | (F.col("last") + floor <= AS_OF))
    return due.select("source", "last", F.row_number().over(Window.orderBy(F.asc_nulls_first("last"), "source")).cast("long").alias("turn"))  # a row per source


A1 = with_views(
    f"""+, l as (select source, max(published) as last from items where published <= {AS_OF} group by source)
select source, last, row_number() over (order by last asc nulls first, source) as turn from sources left join l using (source) where lifecycle in ('stable', 'observing')
  and (last is null or last + 60 * greatest(30, case entity when 'lab' then 720 when 'project' then 360 when 'company' then 180 when 'community' then 1440 else 1 end) <= {AS_OF})""",
    "items", "sources",
)


def k11_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _evidence(spark, sf_dir).where(F.col("published") <= AS_OF).groupBy("story").agg(F.count_distinct("domain").alias("publishers"), F.min("published").alias("first"))
    return s.select("story", F.round(scoring.popularity(F.col("publishers"), F.col("first"), AS_OF), 6).alias("boost"))


K11 = with_views(f"select story, round(least(3, count(distinct domain) - 1) * power(2, -({AS_OF} - min(published)) / 86400.0), 6) as boost from items join sources using (source) where published <= {AS_OF} group by story", "items", "sources")


def s4_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and JSON bytes of each reader's export."""
    rows = editions.reader_states(actions(spark, sf_dir), AS_OF)
    return rows.groupBy("reader").agg(F.count("*").alias("n_rows"), F.sum(F.octet_length(F.concat_ws(",", "story", "seen", "opened", "saved", "dismissed"))).alias("n_bytes"))


S4 = with_views(f"+, {_STATES} select reader, count(*) as n_rows, sum(strlen(concat_ws(',', story, seen, opened, saved, dismissed)))::bigint as n_bytes from states group by reader", "actions")

ALL = [
    (o3_score_topk, O3), (k1_evidence_score, K1), (f2_list_filter, F2), (u1_reader_states, U1), (f7_source_gate, F7), (j4_unseen, J4), (j10_time_band, J10), (g4_best_item, G4), (g11_first_per_source, G11),
    (g13_cooccurrence, G13), (g14_source_coverage, G14), (g16_metrics, G16), (p3_calibration, P3), (w1_newest_windows, W1), (w2_oldest_windows, W2), (w4_sections, W4), (o5_paging, O5),
    (a1_due_sources, A1), (k11_popularity, K11), (s4_export, S4),
]
