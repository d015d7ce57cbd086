"""Queries of the article rules: facets, kinds, values, significance, story features, interest, affinity and rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import policy as P
from ..functions.text import ALIASES, BUILD_HEADS, BUILD_TITLE, model_key
from ..operators import editions, scoring, stories
from ..operators import personal as personal_ops
from ..operators.folders import written
from ..sources.views import AS_OF, DAY, HOUR, actions, articles, profiles, with_views
from .listings import _STATES


def h15_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = articles(spark, sf_dir)
    return a.select("item", F.array_join(P.facets("title", "body", "type", "lang"), "|").alias("facets"))


H15 = with_views(f"select item, array_to_string({P.sql_facets('title', 'body', 'type', 'lang')}, '|') as facets from articles", "items", "sources", "articles")


def h16_technical_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("item", P.technical_basis(F.col("url"), F.col("title"), F.col("categories")).alias("basis"))


H16 = with_views(f"select item, {P.sql_technical('url', 'title', 'categories')} as basis from articles", "items", "sources", "articles")

_BUILD = """articles as (select *, coalesce(type = 'release' and (regexp_matches(hd, '{0}') or regexp_matches(hd, '{1}') or regexp_matches(hd, '{2}') or regexp_matches(hd, '{3}') or regexp_matches(hd, '{4}')
  or regexp_matches(lower(trim(title)), '{5}')), false) as is_build from (select *, lower(trim(split_part(title, ':', 1))) as hd from raw_articles))""".format(*BUILD_HEADS, BUILD_TITLE)


def _with_policy(sql: str, *names: str) -> str:
    """``sql`` behind the views, the articles with ``is_build``, and the article policy."""
    out = with_views(f"+, {_BUILD}, {P.SQL_POLICY}{sql}", "items", "sources", *names, "articles")
    return out.replace("articles as (select * exclude (c)", "raw_articles as (select * exclude (c)", 1)


def k2_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, value and eligibility of every article."""
    a = stories.with_policy(articles(spark, sf_dir))
    return a.select("item", "kind", F.col("value").cast("long").alias("value"), "eligible")


K2 = _with_policy(" select item, kind, value::bigint as value, eligible from policy")

_POINTS = ", ".join(f"('{r}', '{k}', {p.get(k, p[''])})" for r, p in scoring.ROLE_POINTS.items() for k in ("release", "research", "analysis", "news", "tutorial", "discussion", "metadata", "question", "promotion"))
_ROLES = ", ".join(f"('{e}', '{r}')" for e, r in scoring.ROLE_OF.items())
_ASSESSED = f""", roles(entity, role0) as (values {_ROLES}), points(role, kind, base) as (values {_POINTS}), g0 as (select p.*, coalesce(role0, 'unknown') as role, {P.sql_signals("title")} from policy p left join roles using (entity)),
assessed as (select g.*, least(100, greatest(0, least(100, base
  + case when role = 'first_party' and launch then case kind when 'release' then 20 when 'news' then 15 when 'research' then 5 else 0 end when role in ('editorial', 'unknown') and launch and flagship and kind in ('news', 'release') then 5 else 0 end
  + case when flagship and role not in ('community', 'index') then 5 else 0 end - case when people then 10 else 0 end
  + case when kind <> 'release' or role = 'first_party' then 0 when minor then -15 when major then 10 else 0 end))
  + case when disclosed and entity in ('company', 'lab', 'project') and kind in ('news', 'research', 'analysis', 'release') then 25 else 0 end) as significance,
  kind not in ('metadata', 'question', 'promotion') and not (community and length(left(coalesce(body, ''), 6000)) < 180) as selectable from g0 g join points using (role, kind))"""


def k3_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role and significance of every article, by its publisher, kind and title."""
    return stories.assessed(articles(spark, sf_dir)).select("item", "role", F.col("significance").cast("long").alias("significance"), "selectable")


K3 = _with_policy(_ASSESSED + " select item, role, significance::bigint as significance, selectable from assessed")

_FEATURES = _ASSESSED + f""", f0 as (select story, min(published) as freshness, arg_max(struct_pack(k := kind, v := value), (value, -published, -item)) as best, max(significance) as significance, bool_or(selectable) as selectable,
  arg_max(role, (significance, -published, -item)) as role, max(value) filter (where selectable) as selectable_value, least(3, greatest(count(distinct domain) - 1, 0)) as extra, max(title) as title, max(type) as type, max(lang) as topic,
  left(string_agg(url || ' ' || coalesce(left(body, 6000), ''), ' ' order by published desc, item desc), 12000) as material, list_sort(list(distinct domain) filter (where domain is not null)) as publishers,
  bool_and(community) as is_community, bool_or(lifecycle = 'stable') as confirmed, max(case tier when 'T1' then 85 when 'T1.5' then 70 else 55 end + case when official then 10 else 0 end) as quality,
  least(100, greatest(count(distinct domain) - 1, 0) * 25) as coverage from assessed group by story),
features as (select *, best.k as kind, best.v as value, least(100, significance + 10 * extra) as importance, {P.sql_facets('title', 'material', 'type', 'topic')} as facets,
  selectable and (least(100, significance + 10 * extra) >= 60 or least(100, significance + 10 * extra) >= 45 and coalesce(selectable_value, 0) >= 60) as brief from f0)"""


def k4_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rankers and editions know of every story."""
    f = stories.features(articles(spark, sf_dir))
    longs = [F.col(c).cast("long").alias(c) for c in ("value", "significance", "importance", "quality", "coverage")]
    return f.select("story", "freshness", "kind", "role", *longs, "brief", "is_community", "confirmed", F.array_join("facets", "|").alias("facets"), F.array_join("publishers", ",").alias("publishers"))


K4 = _with_policy(
    _FEATURES + """ select story, freshness, kind, role, value::bigint as value, significance::bigint as significance, importance::bigint as importance, quality::bigint as quality, coverage::bigint as coverage,
  brief, is_community, confirmed, array_to_string(facets, '|') as facets, array_to_string(publishers, ',') as publishers from features"""
)


def f11_catch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of the last week that are worth catching up on."""
    f = stories.features(articles(spark, sf_dir)).where(F.col("freshness").between(AS_OF - 7 * DAY, AS_OF))
    return f.where(stories.worth_catching_up(F.col("importance"), F.col("value"))).select("story", F.col("importance").cast("long").alias("importance"), F.col("value").cast("long").alias("value"))


F11 = _with_policy(_FEATURES + f" select story, importance::bigint as importance, value::bigint as value from features where freshness between {AS_OF - 7 * DAY} and {AS_OF} and importance >= 60 and value >= 70")


def _requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stories that a reader has a state of, with the stories' features."""
    f = stories.features(articles(spark, sf_dir)).select("story", "facets", "publishers", "kind", "freshness", "importance", "value", "quality")
    return editions.reader_states(actions(spark, sf_dir), AS_OF).join(f, "story")


#: What only the rank reads of a reader's stories.
_RANKED_BY = ("seen", "freshness", "importance", "value", "quality")

_PAIRS = f""", {_STATES}, requested as (select s.*, facets, publishers, kind, freshness, importance, value, quality from states s join features using (story)),
feedback as (select *, dismissed is not null as negative, coalesce(dismissed, saved) as said from requested where saved is not null or dismissed is not null),
pairs as (select r.reader, r.story, case when not b.negative and list_has_any(b.facets, r.facets) then 8 when b.negative and b.reason = 'source' and list_has_any(b.publishers, r.publishers) then -10
  when b.negative and b.reason = 'topic' and list_has_any(b.facets, r.facets) then -12 when b.negative and b.reason is null and b.kind = r.kind and list_has_any(b.facets, r.facets) then -2 else 0 end as points, b.said,
  b.story = r.story as own from requested r join feedback b on b.reader = r.reader),
said as (select reader, story, sum(points * case when ({AS_OF} - said) / 2592000.0 >= 100 then 0 else power(0.5, ({AS_OF} - said) / 2592000.0) end) filter (where not own) as points, bool_or(points < 0) as against from pairs group by all),
reading as (select reader, story, facets, 2 * power(0.5, ({AS_OF} - opened) / 1209600.0) as strength from (select *, row_number() over (partition by reader order by opened desc, story) as nth from requested
  where saved is null and dismissed is null and opened > {AS_OF - 30 * DAY}) where nth <= 150),
topics as (select reader, facet, count(*) as support, sum(strength) as strength from (select reader, strength, unnest(facets) as facet from reading) group by all),
bonus as (select r.reader, r.story, max(least(20, t.strength - coalesce(o.strength, 0))) as bonus from (select reader, story, unnest(facets) as facet from requested) r join topics t on t.reader = r.reader and t.facet = r.facet
  left join reading o on o.reader = r.reader and o.story = r.story where r.facet not in ('{P.PAPER}', '{P.PODCAST}', '{P.OTHER}') and t.support - case when o.story is null then 0 else 1 end >= 2
  and not exists (select 1 from profiles p where p.reader = r.reader and p.label = r.facet and (not p.enabled or p.weight = 0)) group by all),
affine as (select r.*, 50 + least(40, greatest(-40, coalesce(s.points, 0) + case when coalesce(s.against, false) then 0 else coalesce(b.bonus, 0) end)) as affinity, case when coalesce(s.against, false) then 0 else coalesce(b.bonus, 0) end as bonus
  from requested r left join said s on s.reader = r.reader and s.story = r.story left join bonus b on b.reader = r.reader and b.story = r.story)"""


def k6_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader's feedback on other stories says about each story of theirs."""
    a = personal_ops.affinity(_requested(spark, sf_dir).drop(*_RANKED_BY), profiles(spark, sf_dir), AS_OF)
    return a.select("reader", "story", F.round("affinity", 4).alias("affinity"))


K6 = _with_policy(_FEATURES + _PAIRS + " select reader, story, round(affinity, 4) as affinity from affine", "actions", "profiles")


def k7_reading_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader's reading adds to the affinity of each story of theirs."""
    a = personal_ops.affinity(_requested(spark, sf_dir).drop(*_RANKED_BY), profiles(spark, sf_dir), AS_OF)
    return a.where("bonus > 0").select("reader", "story", F.round("bonus", 4).alias("bonus"))


K7 = _with_policy(_FEATURES + _PAIRS + " select reader, story, round(bonus, 4) as bonus from affine where bonus > 0", "actions", "profiles")


def k12_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest weight that a reader gave to one of a story's facets; 35 without any."""
    r = personal_ops.with_interest(_requested(spark, sf_dir), profiles(spark, sf_dir))
    return r.select("reader", "story", F.col("interest").cast("long").alias("interest"))


def k12_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest weight of a label a reader asked for among a story's facets and its topic, all by their common names; 0 without any."""
    f = stories.features(articles(spark, sf_dir)).select("story", "facets", "topic")
    asked = editions.reader_states(actions(spark, sf_dir), AS_OF).select("reader", "story").join(f, "story")
    return personal_ops.relevance(asked, profiles(spark, sf_dir)).select("reader", "story", F.col("relevance").cast("long").alias("relevance"))


_INTEREST = "coalesce((select max(p.weight) from profiles p where p.reader = a.reader and p.enabled and list_contains(a.facets, p.label)), 35)"
K12 = _with_policy(_FEATURES + f", {_STATES} select a.reader, a.story, {_INTEREST}::bigint as interest from states s join features using (story), (select s.reader, s.story, facets) a", "actions", "profiles")


_ALIAS = "lower(case lower(trim({0})) " + " ".join(f"when '{k}' then '{v}'" for k, v in ALIASES.items()) + " else trim({0}) end)"
K12_RELEVANCE = _with_policy(
    _FEATURES + f""", {_STATES}, labels_of as materialized (select story, unnest(list_append(facets, topic)) as label from features), wanted as (select reader, {_ALIAS.format("label")} as label, weight from profiles where enabled)
select s.reader, s.story, coalesce(max(w.weight), 0)::bigint as relevance from states s join features using (story) left join labels_of n on n.story = s.story left join wanted w on w.reader = s.reader and w.label = {_ALIAS.format("n.label")} group by all""",
    "actions", "profiles",
)


def k9_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best stories of every reader among those with a state of theirs."""
    r = personal_ops.ranked(_requested(spark, sf_dir), profiles(spark, sf_dir), AS_OF)
    nth = F.row_number().over(Window.partitionBy("reader").orderBy(F.desc("rank"), "story"))
    return r.withColumn("rank", F.round("rank", 3)).withColumn("position", nth.cast("long")).where("position <= 10").select("reader", "story", "rank", "position")


_HALF = f"greatest(0, {AS_OF} - freshness) / 3600.0 / case when kind in ('research', 'analysis', 'tutorial') then 96 when kind = 'release' then 48 else 30 end"
K9 = _with_policy(
    _FEATURES + _PAIRS + f""", scored as (select a.reader, a.story, round(importance * 0.35 + value * 0.20 + {_INTEREST} * 0.15 + 0.15 * case when {_HALF} >= 100 then 0 else 100 * power(0.5, {_HALF}) end + quality * 0.10 + affinity * 0.05
  - case when opened is not null then 6 * power(0.5, ({AS_OF} - opened) / 172800.0) when seen is not null then 3 * power(0.5, ({AS_OF} - seen) / 86400.0) else 0 end - case when dismissed is not null then 200 else 0 end, 3) as rank from affine a)
select * from (select reader, story, rank, row_number() over (partition by reader order by rank desc, story) as position from scored) where position <= 10""",
    "actions", "profiles",
)


def k10_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two earlier rank formulas over story features, for comparison: quality, coverage, recency, a neutral interest and affinity."""
    f = stories.features(articles(spark, sf_dir)).withColumn("recency", scoring.recency(F.col("freshness"), F.col("kind"), AS_OF))
    q, c, r, v, i, a = F.col("quality"), F.col("coverage"), F.col("recency"), F.col("value"), F.lit(35.0), F.lit(50.0)
    return f.select("story", F.round(0.15 * q + 0.05 * c + 0.45 * r + 0.20 * i + 0.15 * a, 4).alias("first"), F.round(0.30 * v + 0.25 * q + 0.20 * i + 0.15 * r + 0.05 * a + 0.05 * c, 4).alias("second"))


_RECENCY = f"case when {_HALF} >= 100 then 0 else 100 * power(0.5, {_HALF}) end"
K10 = _with_policy(
    _FEATURES + f""" select story, round(0.15 * quality + 0.05 * coverage + 0.45 * {_RECENCY} + 0.20 * 35 + 0.15 * 50, 4) as first,
  round(0.30 * value + 0.25 * quality + 0.20 * 35 + 0.15 * {_RECENCY} + 0.05 * 50 + 0.05 * coverage, 4) as second from features"""
)


def k13_hype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an early rule took off stories with a shrill title, short summaries and no source of the first tier."""
    g = articles(spark, sf_dir).groupBy("story").agg(F.max("title").alias("title"), F.max(F.length("summary")).alias("most"), F.bool_or(F.col("tier") == "T1").alias("first"))
    return g.select("story", F.when(F.lower("title").rlike(P.HYPE) & (F.coalesce("most", F.lit(0)) < 240) & ~F.coalesce("first", F.lit(False)), 14).otherwise(0).cast("long").alias("penalty"))


K13 = with_views(
    f"""select story, max(case when shrill and short and not exists (select 1 from articles b where b.story = a.story and b.tier = 'T1') then 14 else 0 end)::bigint as penalty
from (select story, {P.m('lower(max(title))', P.HYPE)} as shrill, coalesce(max(length(summary)), 0) < 240 as short from articles group by story) a group by story""",
    "articles",
)


def _edition_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories that qualify for an edition, with the local day they were published on."""
    f = stories.features(articles(spark, sf_dir)).where("brief").where(F.col("freshness") <= AS_OF)
    return f.select(
        F.floor((F.col("freshness") + 8 * HOUR) / DAY).cast("long").alias("day"), F.col("story").alias("item"), F.col("importance").cast("double").alias("rank"), F.col("freshness").alias("published"), F.col("freshness").alias("at"),
        "publishers", "role", F.col("is_community").alias("community"), F.col("facets")[0].alias("topic"), model_key(F.col("title")).alias("story_key"), "value", "first_rate",
    )


def q1_edition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily editions of twenty stories: the main list of each local day, and what of the six days before is worth catching up on and was in no main list."""
    c = written(_edition_candidates(spark, sf_dir).where("first_rate"))  # read four times below; features are dear
    main = c.withColumn("edition", F.col("day")).withColumn("fresh", F.lit(True))
    shown = editions.daily_editions(main.drop("day", "value", "first_rate"), 20).select("item")
    late = c.where(stories.worth_catching_up(F.col("rank"), F.col("value"))).join(shown, "item", "left_anti")
    last = F.lit((AS_OF + 8 * HOUR) // DAY)
    late = late.withColumn("edition", F.explode(F.sequence(F.col("day") + 1, F.greatest(F.col("day") + 1, F.least(F.col("day") + 6, last))))).where(F.col("edition") <= last).withColumn("fresh", F.lit(False))
    return editions.daily_editions(main.unionByName(late).drop("day", "value", "first_rate"), 20)


def q2_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly editions of thirty stories by topic, three of a publisher at most."""
    c = _edition_candidates(spark, sf_dir).withColumn("edition", F.floor(F.col("day") / 7).cast("long")).withColumn("fresh", F.lit(True))
    return editions.weekly_editions(c.drop("day", "value", "first_rate"), 30)


ALL = [
    (h15_facets, H15), (h16_technical_basis, H16), (k2_policy, K2), (k3_significance, K3), (k4_features, K4), (f11_catch_up, F11), (k6_affinity, K6), (k7_reading_bonus, K7), (k12_interest, K12), (k9_rank, K9),
    (k12_relevance, K12_RELEVANCE), (k10_superseded, K10), (k13_hype, K13), (q1_edition, None), (q2_weekly, None),
]
