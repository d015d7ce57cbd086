"""Queries of the title, address and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.views import AS_OF, articles, items, pick, quoted, table, with_views

def f5_development_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("item", T.is_build(F.col("type"), F.col("title")).alias("is_build"))


F5 = with_views(
    f"""select item, coalesce(type = 'release' and (regexp_matches(head, '{T.BUILD_HEADS[0]}') or regexp_matches(head, '{T.BUILD_HEADS[1]}') or regexp_matches(head, '{T.BUILD_HEADS[2]}')
  or regexp_matches(head, '{T.BUILD_HEADS[3]}') or regexp_matches(head, '{T.BUILD_HEADS[4]}') or regexp_matches(lower(trim(title)), '{T.BUILD_TITLE}')), false) as is_build
from (select *, lower(trim(split_part(title, ':', 1))) as head from articles)""",
    "items", "sources", "articles",
)
#: Labels as publishers write them.
LABELS = [" Agent ", "RAG", "rust", "AI infra", "something else", "推理", "hardware", "Industry", ""]


def h14_topic_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("item", T.topic_alias(pick(F.col("item"), LABELS)).alias("topic"))


H14 = with_views(
    f"""select item, coalesce(a.topic, trim(l.label)) as topic from (select item, {quoted(LABELS)}[item % {len(LABELS)} + 1] as label from items) l
left join (values {", ".join(f"('{k}', '{v}')" for k, v in T.ALIASES.items())}) a(name, topic) on lower(trim(l.label)) = a.name""",
    "items",
)


def h18_model_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("item", T.model_key(F.col("title")).alias("model"))


_M = "(?:^|[^a-z0-9])(" + "|".join(T.FAMILIES) + ")[- ]?v?([0-9]+)(?:[.]([0-9]+))?"
H18 = with_views(
    f"""select item, case when b <> '' then case a when 'chatgpt' then 'gpt' else a end || b || case when regexp_matches(c, '[1-9]') then '.' || c else '' end end as model
from (select item, regexp_extract(t, '{_M}', 1) as a, regexp_extract(t, '{_M}', 2) as b, regexp_extract(t, '{_M}', 3) as c from (select item, translate(lower(title), '–—', '--') as t from articles))""",
    "items", "sources", "articles",
)


def h19_template_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("item", T.template_key(F.col("title")).alias("template"))


H19 = with_views(
    """select item, case when regexp_matches(title, '[0-9][0-9][0-9][0-9]') and length(regexp_replace(title, '[^\\p{L}]', '', 'g')) >= 3
  then regexp_replace(regexp_replace(regexp_replace(lower(title), '[0-9]+', '#', 'g'), '[^\\p{L}#]+', '-', 'g'), '^-|-$', '', 'g') end as template from articles""",
    "items", "sources", "articles",
)


def h6_canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


H6 = f"""select page_id, case when regexp_matches(url, '^https?://') then
    case when path = '' then origin || '/' else origin || path end || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end end as canonical
from (select *, list_filter(string_split(query, '&'), lambda p: p <> '' and not starts_with(lower(split_part(p, '=', 1)), 'utm_') and not list_contains({T.TRACKING}, lower(split_part(p, '=', 1)))) as kept,
    lower(regexp_extract(base, '^([^:]+://[^/]*)', 1)) as origin, regexp_extract(base, '^[^:]+://[^/]*(.*)$', 1) as path
  from (select page_id, url, split_part(u, '?', 1) as base, case when contains(u, '?') then substr(u, strpos(u, '?') + 1) else '' end as query from (select page_id, url, split_part(trim(url), '#', 1) as u from pages)))"""


def h7_publisher_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pages").select(T.publisher_domain(F.col("url")).alias("domain"))
    return d.groupBy("domain").agg(F.count("*").alias("n_pages"))


H7 = f"""select case when list_contains({T.SUFFIXES}, array_to_string(p[-2:], '.')) then array_to_string(p[-3:], '.') else array_to_string(p[-2:], '.') end as domain, count(*) as n_pages
from (select string_split(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '.') as p from pages) group by 1"""


def h4_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.excerpt(F.coalesce("text", F.lit("")), 280), 256).alias("excerpt_sha256"))


H4 = "select doc_id, sha256(case when length(t) <= 280 then t else regexp_replace(left(t, 279), ' +$', '') || '…' end) as excerpt_sha256 from (select doc_id, coalesce(text, '') as t from documents)"


def h24_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different five-character shingles of every whole text."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.size(T.shingles(F.col("text"))).cast("long").alias("n_shingles"))


H24 = """with p as (select doc_id as item, coalesce(regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g'), '') as t from documents)
select item, len(list_distinct(list_transform(range(1, greatest(length(t) - 3, 1)), lambda i: substr(t, i, 5)))) as n_shingles from p"""


def h28_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("item", F.round(T.decay((F.lit(AS_OF) - F.col("published")) / 14_400.0), 6).alias("weight"))


H28 = with_views(f"select item, round(case when x >= 100 then 0 else power(0.5, greatest(x, 0)) end, 6) as weight from (select item, ({AS_OF} - published) / 14400.0 as x from items)", "items")


def h29_local_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each local day, and of each edition (a day begins at its slot, seven in the morning)."""
    i = items(spark, sf_dir)
    return i.groupBy(T.local_day(F.col("published")).alias("day"), T.local_day(F.col("published"), 1).alias("edition")).agg(F.count("*").alias("n_items"))


H29 = with_views("select cast(floor((published + 28800) / 86400) as bigint) as day, cast(floor((published + 3600) / 86400) as bigint) as edition, count(*) as n_items from items group by all", "items")


ALL = [
    (f5_development_build, F5), (h14_topic_alias, H14), (h18_model_key, H18), (h19_template_key, H19), (h6_canonical_url, H6), (h7_publisher_domain, H7), (h4_excerpt, H4),
    (h24_shingles, H24), (h28_decay, H28), (h29_local_day, H29),
]
