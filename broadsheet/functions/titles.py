"""What titles and texts are compared by: plain letters, numbers, negations, tokens and trigrams. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that take a statement back, in their order; Chinese ones are counted as substrings.
NEGATIONS = ["no", "not", "never", "cancelled", "canceled", "withdrawn", "retracted", "denied", "postponed"]
CHINESE_NEGATIONS = ["不", "未", "取消", "撤回", "否认", "推迟", "更正", "辟谣"]
# Words of a title that say nothing about what it reports.
COMMON_WORDS = [
    "a", "an", "the", "and", "or", "to", "for", "with", "of", "in", "new", "release", "releases", "released", "notes", "update", "updates", "version", "features", "improvements",
    "fixes", "bug", "stable", "weekly", "latest", "available",
]

#: A letter or a digit of any script.
ALNUM = r"\p{IsAlphabetic}\p{N}"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def letters(text: Column) -> Column:
    """Only the letters and digits, in lower case."""
    return F.lower(F.regexp_replace(text, f"[^{ALNUM}]+", ""))


def numbers(text: Column) -> Column:
    """The numbers of a text in order, repeats included: runs of digits and dots, without dots at their ends."""
    return F.regexp_extract_all(text, F.lit(r"([0-9](?:[0-9.]*[0-9])?)"), F.lit(1))


def negations(text: Column) -> Column:
    """How often each word of NEGATIONS and each of CHINESE_NEGATIONS stands in a text.

    One pass finds all words: each is a whole run of letters, so no two overlap. The text is put in lower case once.
    """
    words = rf"(?=[{''.join(sorted({w[0] for w in NEGATIONS}))}])(?<!\p{{IsAlphabetic}})(?:{'|'.join(NEGATIONS)})(?!\p{{IsAlphabetic}})"
    lower = lambda t: F.struct(t.alias("text"), F.regexp_extract_all(t, F.lit(words), F.lit(0)).alias("found"))
    each = lambda r: F.array(*[F.size(F.filter(r["found"], lambda x: x == w)) for w in NEGATIONS], *[F.when(r["text"].contains(w), F.regexp_count(r["text"], F.lit(w))).otherwise(F.when(r["text"].isNotNull(), 0)) for w in CHINESE_NEGATIONS])
    return F.transform(F.transform(F.array(F.lower(text)), lower), each)[0]


def title_tokens(title: Column) -> Column:
    """The set of runs of letters, digits, dots and hyphens in lower case, without dots and hyphens at their ends, in order."""
    parts = F.split(F.lower(title), f"[^{ALNUM}.-]+")
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda p: F.regexp_replace(p, "^[.-]+|[.-]+$", "")), lambda p: p != "")))


def number_tokens(tokens: Column) -> Column:
    """The tokens with a digit, a v before it taken off, as a set in order."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(tokens, lambda t: t.rlike("[0-9]")), lambda t: F.regexp_replace(t, "^v(?=[0-9])", ""))))


def distinctive(tokens: Column) -> Column:
    """How many tokens are neither common nor a number."""
    return F.size(F.filter(tokens, lambda t: ~t.isin(COMMON_WORDS) & ~t.rlike("[0-9]")))


def trigrams(title: Column) -> Column:
    """The set of windows of three characters of each word, two spaces before and one after it."""
    words = F.filter(F.split(F.lower(title), f"[^{ALNUM}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, 3)))))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 0 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(common, F.size(a) + F.size(b) - common), F.lit(0.0))
