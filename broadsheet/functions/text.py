"""Text, address and title functions as column expressions; no Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, two-part public suffixes, label synonyms, model families,
# and what a title of an unnamed engineering build looks like.
TRACKING = ["fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid", "_hsenc", "_hsmi"]
SUFFIXES = ["co.uk", "org.uk", "com.au", "net.au", "co.jp", "co.nz", "com.cn", "com.br", "co.in", "co.za", "com.sg"]
ALIASES = {
    "agent": "Agent 与工具", "microsoft agent framework": "Agent 与工具", "memory": "记忆与检索", "rag": "记忆与检索", "ai coding": "AI 编程", "rust": "工程与开源",
    "开源模型": "模型与多模态", "推理": "工程与开源", "hardware": "芯片与硬件", "industry": "产业与商业", "governance": "治理与政策", "ai infra": "AI Infra", "ai-infra": "AI Infra", "ai 基础设施": "AI Infra",
}
FAMILIES = ["chatgpt", "gpt", "claude", "opus", "sonnet", "haiku", "gemini", "gemma", "llama", "grok", "mistral", "mixtral", "deepseek", "qwen", "kimi", "glm", "minimax", "mimo", "phi", "sora", "veo", "imagen"]
BUILD_HEADS = [
    "^[0-9a-f]{12,64}$",
    "^([a-z0-9]+[-_])*(handoff|runtime|build|ci|nightly)([-_][a-z0-9]+)*[-_][0-9a-f]{12,64}$",
    "^(handoff|runtime|build|ci|nightly)[-_][0-9]{5,}$",
    "^(viable|strict|main|master|trunk|dev|ci|ciflow)(/[a-z0-9._-]+)*/([0-9]{6,}|[0-9a-f]{12,64})$",
    "^[a-z]{1,3}[0-9]{4,}$",
]
BUILD_TITLE = "^(nightly|last[-_.]green|canary)([-_: ]|$)"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bare(c: Column) -> Column:
    """Without spaces at its ends."""
    return F.trim(c)


def is_build(kind: Column, title: Column) -> Column:
    """Is this release an unnamed engineering build?"""
    head, whole = ascii_lower(bare(F.split_part(title, F.lit(":"), F.lit(1)))), ascii_lower(bare(title))
    found = whole.rlike(BUILD_TITLE)
    for pattern in BUILD_HEADS:
        found = found | head.rlike(pattern)
    return F.coalesce((kind == "release") & found, F.lit(False))


def topic_alias(label: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.coalesce(known[ascii_lower(bare(label))], bare(label))


def model_key(title: Column) -> Column:
    """The first model family with a version, as family and version ("x 6.0" is "x6"); null if there is none."""
    plain = F.translate(ascii_lower(title), "‐‑‒–—―−", "-------")
    pattern = "(?:^|[^a-z0-9])(" + "|".join(FAMILIES) + ")[- ]?v?([0-9]+)(?:[.]([0-9]+))?"
    family, major, minor = (F.regexp_extract(plain, pattern, k) for k in (1, 2, 3))
    family = F.when(family == "chatgpt", "gpt").otherwise(family)
    tail = F.when(minor.rlike("[1-9]"), F.concat(F.lit("."), minor)).otherwise("")
    return F.when(major != "", F.concat(family, major, tail))


def excerpt(text: Column, most: int) -> Column:
    """``text`` if it has at most ``most`` characters, else one less with an ellipsis for the rest."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…")))


def host(url: Column) -> Column:
    """The host of an http(s) address in lower case, without port, user and trailing dot; null for other addresses."""
    found = ascii_lower(F.regexp_extract(url, "(?i)^https?://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.nullif(F.regexp_replace(found, "[.]+$", ""), F.lit(""))


def publisher_domain(url: Column) -> Column:
    """The last two labels of the host, three for a two-part public suffix, an address of four numbers whole."""
    h = host(url)
    parts = F.split(h, "[.]")
    last = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), ".")
    return F.when(h.rlike("^[0-9]+([.][0-9]+){3}$"), h).when(last(2).isin(SUFFIXES), last(3)).otherwise(last(2))


def canonical_url(url: Column) -> Column:
    """Without fragment and tracking parameters, the others in their order; null if it is no public-looking http(s) address."""
    whole = F.regexp_replace(bare(url), "#.*$", "")
    base, query = F.split_part(whole, F.lit("?"), F.lit(1)), F.regexp_extract(whole, "[?](.*)$", 1)
    key = lambda p: ascii_lower(F.split_part(p, F.lit("="), F.lit(1)))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~key(p).startswith("utm_") & ~key(p).isin(TRACKING))
    scheme, rest = ascii_lower(F.regexp_extract(base, "^([^:]+)://", 1)), F.regexp_extract(base, "^[^:]+://[^/]*(.*)$", 1)
    port = F.regexp_extract(base, "^[^:]+://[^/]*?(:[0-9]+)(?:/|$)", 1)
    made = F.concat(scheme, F.lit("://"), host(base), port, F.when(rest == "", "/").otherwise(rest), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when((F.octet_length(url) <= 2048) & host(base).isNotNull() & ~base.rlike("^[^:]+://[^/]*@"), made)


def template_key(title: Column) -> Column:
    """Runs of digits to #, other runs outside letters to one hyphen; null without four digits in a row or three letters."""
    made = F.regexp_replace(F.regexp_replace(F.lower(title), "[0-9]+", "#"), "[^\\p{L}#]+", "-")
    letters = F.length(F.regexp_replace(title, "[^\\p{L}]", ""))
    return F.when(title.rlike("[0-9]{4}") & (letters >= 3), F.regexp_replace(made, "^-|-$", ""))


def shingles(text: Column, width: int = 5) -> Column:
    """The set of ``width``-character windows of the text's letters and digits. The characters are parted once, so a window costs the same wherever it stands."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]", "")

    def of(chars: Column) -> Column:
        at = F.when(F.size(chars) >= width, F.sequence(F.lit(0), F.size(chars) - width)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(at, lambda i: F.concat(*[chars[i + k] for k in range(width)])))

    return F.transform(F.array(F.split(plain, "")), of)[0]


def decay(half_lives: Column) -> Column:
    """Half for each half-life, none after a hundred."""
    return F.when(half_lives >= 100, 0.0).otherwise(F.pow(F.lit(0.5), F.greatest(half_lives, F.lit(0.0))))


def local_day(at: Column, hours: int = 8) -> Column:
    """Days since 1970 at a fixed offset, without daylight saving."""
    return F.floor((at + hours * 3600) / 86_400).cast("long")
