"""Queries over reports of one thing: copies, near-duplicate titles, release families, groups; their material, page texts and item versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import article_text, page_batches, plain_text, reading_text
from ..functions.titles import COMMON_WORDS
from ..operators.arbiter import assigned_groups
from ..operators.copies import WINDOW, copy_cohorts
from ..operators.families import WINDOW as FAMILY_WINDOW
from ..operators.families import change_references, families, release_identity
from ..operators.folders import new_folder, written
from ..operators.material import allocated
from ..operators.near_titles import SPAN, near_titles
from ..operators.upserts import ItemStore
from ..sources.views import AS_OF, DAY, articles, quoted, releases, reports, seconds, table
from ..streaming.jobs import job_history


def _listed(rows: DataFrame) -> DataFrame:
    """leader, n_members, members (in their order, joined) of cohorts (item, leader, place), which are bounded by their rules."""
    members = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "item"))), lambda m: m["item"].cast("string")), ",")
    return rows.groupBy("leader").agg(F.count("*").alias("n_members"), members.alias("members"))


def c3_copy_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(copy_cohorts(reports(spark, sf_dir), AS_OF, most=None))


def e3_near_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_titles(reports(spark, sf_dir)).select("item", "match", F.round("likeness", 6).alias("likeness"))


_TOKENS = r"list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}.-]+'), lambda x: trim(x, '.-')), lambda x: x <> '')))"
_FIGURES = "list_sort(list_distinct(list_transform(list_filter({0}, lambda x: regexp_matches(x, '[0-9]')), lambda x: regexp_replace(x, '^v([0-9])', '\\1'))))"
_GRAMS = (
    r"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(title), '[^\p{L}\p{N}]+'), lambda x: x <> ''), "
    r"lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
)
E3 = f"""with r as (
  select doc_id as item, split_part(text, chr(10), 1) as title, 'https://' || coalesce(lang, 'none') || '.example/p' as url, {quoted(["news", "release", "research", "podcast", "discussion", "news", "repository", "release", "news", "paper", "model", "news", "release"])}[doc_id // 7 % 13 + 1] as kind,
    {AS_OF - 30 * DAY} + doc_id * 48271 % {31 * DAY} as published from documents
), told as (select *, {_TOKENS.format("title")} as tokens, {_TOKENS.format("url")} as url_tokens, {_GRAMS} as grams from r where length(title) >= 55
), fit as (select *, {_FIGURES.format("tokens")} as figures, {_FIGURES.format("url_tokens")} as url_figures from told
  where len(tokens) >= 8 and len(list_filter(tokens, lambda x: not list_contains({quoted(COMMON_WORDS)}, x) and not regexp_matches(x, '[0-9]'))) >= 4
), pairs as (
  select a.item, b.item as other, b.published as since, len(list_intersect(a.tokens, b.tokens)) as common, len(a.tokens) + len(b.tokens) as total,
    len(list_intersect(a.grams, b.grams))::double / (len(a.grams) + len(b.grams) - len(list_intersect(a.grams, b.grams))) as likeness
  from fit a join fit b on a.kind = b.kind and a.figures = b.figures and a.url_figures = b.url_figures and b.published between a.published - {SPAN} and a.published and (b.published < a.published or b.published = a.published and b.item < a.item)
)
select item, arg_min(other, row(-likeness, since, other)) as match, round(max(likeness), 6) as likeness from pairs where common >= 8 and 100 * common >= 88 * (total - common) and likeness >= 0.65 group by item"""


def _released(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = releases(spark, sf_dir)
    return rows.select("item", "published", release_identity(F.col("url"), F.col("title")).alias("identity"), change_references(F.col("url"), F.col("notes")).alias("changes"))


def c7_release_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(families(_released(spark, sf_dir), AS_OF))


def c11_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """leader, tier (0 copies, 1 release family; null: alone), n_members, first, last: what each leader, newest first, takes."""
    own = reports(spark, sf_dir).where(F.col("published") <= AS_OF).select("item", "published")
    leaders = own.select(((AS_OF - F.col("published")) * 1_000_000_000_000 + F.col("item")).alias("rank"), F.col("item").alias("leader"))
    copies = copy_cohorts(reports(spark, sf_dir), AS_OF, most=None).select(F.concat(F.lit("0:"), F.col("leader").cast("string")).alias("option"), "item")
    lines = families(_released(spark, sf_dir), AS_OF).select(F.concat(F.lit("1:"), F.col("leader").cast("string")).alias("option"), "item")
    both = written(copies.unionByName(lines))  # offers and members are both made of it
    tier = F.substring("option", 1, 1).cast("int")
    offers = both.select(F.col("item").alias("leader"), tier.alias("tier"), "option", F.when(tier == 0, WINDOW).otherwise(FAMILY_WINDOW).cast("long").alias("span"), (tier == 0).alias("keeps"))
    members = both.join(own, "item").select("option", F.col("item").alias("member"), F.col("published").alias("at"))
    groups = assigned_groups(leaders, offers, members)
    return groups.groupBy("leader", F.substring("option", 1, 1).cast("int").alias("tier")).agg(F.count("*").alias("n_members"), F.min("member").alias("first"), F.max("member").alias("last"))


def m1_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each article goes into the summary of its story: its body, and its short form as structured material."""
    a = articles(spark, sf_dir)
    rows = a.select("story", "item", "published", F.length("body").alias("body_length"), F.length("summary").alias("structured_length"))
    return allocated(rows).withColumn("place", F.col("place").cast("long"))


def h1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page shows: its length in one line, and its paragraphs with their hash."""
    p = page_batches(table(spark, sf_dir, "pages")).select("page_id", plain_text(F.col("html")).alias("plain"), reading_text(F.col("html")).alias("reading"))
    paragraphs = F.when(F.col("reading") == "", 0).otherwise(F.size(F.split("reading", "\n\n")))
    return p.select("page_id", F.length("plain").cast("long").alias("n_chars"), paragraphs.cast("long").alias("n_paragraphs"), F.md5(F.col("reading").cast("binary")).alias("reading_md5"))


def h11_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article text of each page that has one."""
    p = page_batches(table(spark, sf_dir, "pages")).select("page_id", article_text(F.col("html")).alias("body")).where("body is not null")
    return p.select("page_id", F.length("body").cast("long").alias("n_chars"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


def t9_item_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as fetched rows, in three batches, merged into items with versions: equal first lines of a source are one address, equal texts one id."""
    d = table(spark, sf_dir, "documents")
    first = F.md5(F.split_part("text", F.lit("\n"), F.lit(1)).cast("binary"))
    rows = d.select(
        F.col("doc_id").alias("seq"), "source", F.md5(F.col("text").cast("binary")).alias("external_id"), F.concat(F.lit("https://news.example/"), first).alias("url"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        (F.lit(AS_OF - 30 * DAY) + F.pmod(F.col("doc_id") * 48_271, F.lit(31 * DAY))).alias("published"), F.md5(F.col("text").cast("binary")).alias("hash"), F.substring("text", 1, 80).alias("summary"),
    )
    store = ItemStore(spark, new_folder(spark, "items"))
    for batch in range(3):
        store.upsert(rows.where(F.col("seq") % 3 == batch), batch)
    return store.items().select("source", "external_id", "url", "version", "created_batch", "created_seq")


def t6_job_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each job: the readers' events as a queue's, a job for each reader and local day."""
    e = table(spark, sf_dir, "events")
    at = seconds("ts")
    kinds = F.create_map(*[F.lit(x) for kv in {"view": "claim", "click": "submit", "purchase": "done", "error": "failed", "signup": "deferred"}.items() for x in kv])
    rows = e.select((F.col("user_id") * 100_000 + F.floor(at / DAY)).cast("long").alias("job"), F.col("event_id").alias("seq"), at.alias("at"), kinds[F.col("event_type")].alias("kind"), (F.col("event_id") % 2).alias("version"), F.lit("a").alias("lease"))
    h = job_history(rows, AS_OF)
    last = F.max_by(F.struct("status", "attempts"), F.struct("at", F.coalesce("seq", F.lit(0).cast("long"))))
    return h.groupBy("job").agg(F.count("*").alias("n_transitions"), F.count_if(F.col("seq").isNull()).alias("n_recovered"), last.alias("l")).select("job", "n_transitions", "n_recovered", "l.status", F.col("l.attempts").cast("long").alias("attempts"))


ALL = [(c3_copy_cohorts, None), (e3_near_titles, E3), (c7_release_families, None), (c11_groups, None), (m1_material, None), (h1_page_text, None), (h11_articles, None), (t9_item_versions, None), (t6_job_history, None)]
