"""The news engine's tables, derived from the given Parquet tables, and the same views as SQL.

Times are whole seconds since 1970 (UTC), so no result depends on a session's time zone. Every query takes its
cut-off as a value; none reads a clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.policy import FACETS

#: The cut-off of the registered queries: 2024-01-20 00:00. Items are published over the thirty days before it and one day after.
AS_OF = 1_705_708_800
HOUR, DAY = 3600, 86_400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str) -> Column:
    """Whole seconds since 1970 of a timestamp column, with or without a zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def pick(index: Column, names: list[str]) -> Column:
    """The name at ``index`` modulo their number."""
    return F.element_at(F.array(*[F.lit(x) for x in names]), (index % len(names)).cast("int") + 1)


TIERS = ["T1", "T1.5", "T1", "T1.5", "T2", "T1", "T1.5"]
ENTITIES = ["company", "lab", "project", "publication", "author", "podcast", "community"]
LIFECYCLES = ["stable", "stable", "observing", "paused", "stable"]


def _source_columns(*names: str) -> list[Column]:
    """What a source's name says of it, as columns of any table with ``source``; all null without a source."""
    n = F.when(F.col("source").isNotNull(), F.coalesce(F.try_element_at(F.regexp_extract_all("source", F.lit("([0-9]+)"), F.lit(1)), F.lit(1)).cast("long"), F.lit(0)))
    all_of = {
        "n": n, "tier": pick(n, TIERS), "entity": pick(n, ENTITIES), "lifecycle": pick(n, LIFECYCLES), "official": n % 4 == 0, "domain": F.concat(F.lit("site"), (n % 13).cast("string"), F.lit(".example")),
    }
    return [all_of[c].alias(c) for c in names]


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, n, tier, entity, lifecycle, official, domain. One row per source: a dimension."""
    names = table(spark, sf_dir, "documents").where("source is not null").select("source").distinct()
    return names.select("source", *_source_columns("n", "tier", "entity", "lifecycle", "official", "domain"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, story (five items each), source, lang, title, length, published."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("item"), F.floor(F.col("doc_id") / 5).cast("long").alias("story"), "source", "lang",
        F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 120).alias("title"), F.length("text").cast("long").alias("length"),
        (F.lit(AS_OF - 30 * DAY) + F.pmod(F.col("doc_id") * 48_271, F.lit(31 * DAY))).alias("published"),
    )


#: What stands before an item's own words, so that the article rules have something to tell apart in the given tables' invented prose.
HEADS = [
    "", "How we built a faster pipeline: ", "Introducing GPT-6.0 ", "Claude Opus 4.5 is now available ", "Question: which GPU to buy ", "Webinar, register now: ", "Technical report on agent memory ", "v2.0.1 released ",
    "nightly-20240101 ", "abcdef0123456789: fix ", "Getting started with the python sdk ", "Analysis of chip market revenue ", "Critical vulnerability discovered and patched in ", "Jane Doe joins the lab ",
    "Deal 12345 of the day, 3000 off ", "Breaking: ", "b4321: ", "The year in review: ", "Acquisition and funding of ", "Qwen v2.05-beta1 ", "推理引擎 发布 ", "Mistral–7 B ",
]
LEADS = ["", "We ran a benchmark with an ablation of the pipeline. ", "Latency and throughput of the routing; see the dataset. ", "Agent memory and retrieval. ", "A GPU of 24 GB vram and memory. ", "Legislation and copyright. ", "", "Usability of the interface. ", "vLLM with paged attention. "]
TYPES = ["news", "release", "research", "podcast", "discussion", "news", "repository", "release", "news", "paper", "model", "news", "release"]
CATEGORIES = ["", "Research", "", "Engineering", "", "", "safety", ""]
PATHS = ["/p/", "/research/", "/engineering/", "/analysis/", "/a/", "/papers/"]


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their publishers and what the article rules read: title (the whole first line), type, url, body (the whole text), summary, flair, categories.

    A narrow view of one table: documents without a source are kept, and repeated ids stay as often as they are.
    """
    n = F.col("item")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.floor(F.col("doc_id") / 5).cast("long").alias("story"), "source", "lang", "text", *_source_columns("tier", "entity", "lifecycle", "official", "domain"))
    category = pick(n, CATEGORIES)
    return d.select(
        "item", "story", "source", "lang", F.length("text").cast("long").alias("length"), (F.lit(AS_OF - 30 * DAY) + F.pmod(n * 48_271, F.lit(31 * DAY))).alias("published"), "tier", "entity", "lifecycle", "official", "domain",
        F.concat(pick(n, HEADS), F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"), pick(n, TYPES).alias("type"), F.concat(F.lit("https://"), F.coalesce("domain", F.lit("unknown.example")), pick(n, PATHS), n.cast("string")).alias("url"),
        F.concat(pick(n, LEADS), "text").alias("body"), F.substring("text", F.lit(1), (F.col("story") % 4 * 100 + n % 5 * 10).cast("int")).alias("summary"),
        F.when(n % 6 == 0, "Help wanted").alias("flair"), F.when(category == "", F.array().cast("array<string>")).otherwise(F.array(category)).alias("categories"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, kind, title (the whole first line), url, body (the whole text), published, of each document; a narrow view."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(
        n.alias("item"), pick(F.floor(n / 7), TYPES).alias("kind"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.concat(F.lit("https://"), F.coalesce("lang", F.lit("none")), F.lit(".example/p")).alias("url"),
        F.col("text").alias("body"), (F.lit(AS_OF - 30 * DAY) + F.pmod(n * 48_271, F.lit(31 * DAY))).alias("published"),
    )


PARTS = ["alpha", "beta", "gamma", "delta", "sdk", "cli", "store"]
TONGUES = ["python", "node", "go", "rust", "java", "ts", "py"]


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, title, url, published, notes of an invented release a document: five forms of titles and tags, in the repository of its source."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    part, tongue = pick(F.floor(n / 5), PARTS), pick(F.floor(n / 5), TONGUES)
    version = F.concat_ws(".", F.lit("1"), (n % 3).cast("string"), F.lit("0"))
    forms = [
        (F.concat(F.lit("@kit/"), part, F.lit("@"), version), F.concat(F.lit("%40kit%2F"), part, F.lit("@"), version)),
        (F.concat(F.lit("memory-kit-"), part, F.lit("=="), version), F.concat(part, F.lit("=="), version)),
        (F.concat(tongue, F.lit("-v"), version), F.concat(tongue, F.lit("-v"), version)),
        (F.concat(F.lit("Memory Kit "), F.initcap(tongue), F.lit(" SDK (v"), version, F.lit(")")), F.concat(tongue, F.lit("-v"), version)),
        (F.concat(F.lit("Memory Kit "), F.initcap(part), F.lit(" Plugin (v"), version, F.lit(")")), F.concat(part, F.lit("-plugin-v"), version)),
    ]
    of = lambda k: F.element_at(F.array(*[f[k] for f in forms]), (n % 5).cast("int") + 1)
    address = F.concat(F.lit("https://github.com/acme-"), F.coalesce("source", F.lit("none")), F.lit("/memory-kit/releases/tag/"), of(1))
    notes = F.concat(F.lit("Fixes #"), (F.floor(n / 35) % 3).cast("string"), F.lit(" and others.\n"), F.coalesce("text", F.lit("")))
    return d.select(n.alias("item"), of(0).alias("title"), address.alias("url"), (F.lit(AS_OF - 30 * DAY) + F.pmod(n * 48_271, F.lit(31 * DAY))).alias("published"), notes.alias("notes"))


ACTIONS = {"view": "seen", "click": "opened", "purchase": "saved", "error": "dismissed", "signup": "unsaved"}
#: Why a reader dismissed; the empty one is unspecified.
REASONS = ["topic", "source", "old", "low_value", ""]


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reader, label, weight, enabled: which of the labels a reader asked for. A handful of rows a reader."""
    labels = F.array(*[F.struct(F.lit(k).alias("i"), F.lit(x).alias("label")) for k, x in enumerate(FACETS)])
    r = table(spark, sf_dir, "events").select(F.col("user_id").alias("reader")).distinct().withColumn("l", F.explode(labels))
    reader, i = F.col("reader"), F.col("l.i")
    return r.where((reader + i) % 3 == 0).select("reader", "l.label", ((reader * 7 + i * 13) % 101).alias("weight"), ((reader + i) % 4 != 0).alias("enabled"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """action_id, reader, story, action, moment, weight: what readers did, from the event stream."""
    e = table(spark, sf_dir, "events")
    n_stories = table(spark, sf_dir, "documents").agg(F.floor(F.max("doc_id") / 5) + 1).scalar()  # the events go over all stories there are
    kind = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])[F.col("event_type")]
    return e.select(F.col("event_id").alias("action_id"), F.col("user_id").alias("reader"), (F.col("event_id") * 7919 % n_stories).cast("long").alias("story"), kind.alias("action"), seconds("ts").alias("moment"), F.col("value").alias("weight"), F.nullif(pick(F.col("event_id"), REASONS), F.lit("")).alias("reason"))


def quoted(names: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in names) + "]"


#: The views as SQL, for the queries that state the expected results.
SQL = {
    "sources": f"""select source, n, {quoted(TIERS)}[n % {len(TIERS)} + 1] as tier, ['company','lab','project','publication','author','podcast','community'][n % 7 + 1] as entity,
  ['stable','stable','observing','paused','stable'][n % 5 + 1] as lifecycle, n % 4 = 0 as official, 'site' || (n % 13) || '.example' as domain
  from (select distinct source, coalesce(try_cast(regexp_extract(source, '([0-9]+)', 1) as bigint), 0) as n from documents where source is not null)""",
    "items": f"select doc_id as item, doc_id // 5 as story, source, lang, left(split_part(text, chr(10), 1), 120) as title, length(text) as length, {AS_OF - 30 * DAY} + doc_id * 48271 % {31 * DAY} as published from documents",
    "actions": """select event_id as action_id, user_id as reader, event_id * 7919 % (select max(doc_id) // 5 + 1 from documents) as story,
  case event_type when 'view' then 'seen' when 'click' then 'opened' when 'purchase' then 'saved' when 'error' then 'dismissed' when 'signup' then 'unsaved' end as action,
  epoch_us(ts) // 1000000 as moment, value as weight, nullif(['topic','source','old','low_value',''][event_id % 5 + 1], '') as reason from events""",
    "articles": f"""select * exclude (c), case when c = '' then []::varchar[] else [c] end as categories from (select item, item // 5 as story, source, lang, length(text) as length, {AS_OF - 30 * DAY} + item * 48271 % {31 * DAY} as published,
  {quoted(TIERS)}[n % {len(TIERS)} + 1] as tier, {quoted(ENTITIES)}[n % 7 + 1] as entity, {quoted(LIFECYCLES)}[n % 5 + 1] as lifecycle, n % 4 = 0 as official, 'site' || (n % 13) || '.example' as domain,
  {quoted(HEADS)}[item % {len(HEADS)} + 1] || split_part(text, chr(10), 1) as title, {quoted(TYPES)}[item % {len(TYPES)} + 1] as type, 'https://' || coalesce('site' || (n % 13) || '.example', 'unknown.example') || {quoted(PATHS)}[item % {len(PATHS)} + 1] || item as url,
  {quoted(LEADS)}[item % {len(LEADS)} + 1] || text as body, left(text, (item // 5 % 4 * 100 + item % 5 * 10)::int) as summary, case when item % 6 = 0 then 'Help wanted' end as flair, {quoted(CATEGORIES)}[item % {len(CATEGORIES)} + 1] as c
  from (select doc_id as item, source, lang, text, case when source is not null then coalesce(try_cast(regexp_extract(source, '([0-9]+)', 1) as bigint), 0) end as n from documents))""",
    "profiles": f"""select reader, {quoted(list(FACETS))}[i + 1] as label, (reader * 7 + i * 13) % 101 as weight, (reader + i) % 4 <> 0 as enabled
  from (select distinct user_id as reader from events), range({len(FACETS)}) t(i) where (reader + i) % 3 = 0""",
}


def with_views(sql: str, *names: str) -> str:
    """``sql`` after the named views as common table expressions; a leading + says that it goes on with more of them."""
    head = ", ".join(f"{n} as ({SQL[n]})" for n in names)
    return f"with {head}{sql[1:]}" if sql.startswith("+") else f"with {head} {sql}"
