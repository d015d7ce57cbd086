"""Readable text of web pages: entities, plain text, paragraphs, and the article of a page.

Entities are decoded by column expressions in one pass: a text is cut into entities and what lies between, and each entity is
looked up once, so ``&amp;lt;`` becomes ``&lt;`` and no more. Tags nest and quote, which no expression can follow; a small
scanner reads them, over Arrow batches, a page at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Named entities, elements whose content is not shown, elements that end a line.
ENTITIES = {
    "amp": "&", "AMP": "&", "lt": "<", "LT": "<", "gt": ">", "GT": ">", "quot": '"', "QUOT": '"', "apos": "'", "nbsp": " ", "ensp": " ", "emsp": " ", "thinsp": " ", "ndash": "–", "mdash": "—", "lsquo": "'", "rsquo": "'",
    "ldquo": '"', "rdquo": '"', "hellip": "…", "bull": "·", "middot": "·", "copy": "©", "reg": "®", "trade": "™", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "times": "×", "divide": "÷", "laquo": "«", "raquo": "»",
}
HIDDEN = ["script", "style", "iframe", "object", "template", "noscript", "nav", "footer", "aside", "form"]
BLOCKS = ["p", "br", "div", "li", "ul", "ol", "hr", "table", "tr", "td", "th", "section", "article", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "pre"]
ARTICLE_CLASSES = ["article", "article-content", "entry-content"]
CHALLENGES = ["access denied", "verify you are human", "enable javascript", "just a moment", "captcha"]
LEAST_BODY = 240
#: Pages that go to a Python worker at once.
PAGES = 250

_ENTITY = r"&(?:#[xX]\+?[0-9a-fA-F]{1,30}|#\+?[0-9]{1,31}|" + "|".join(ENTITIES) + ");"
#: A tag from its name on: up to the first > that stands in no quotes.
_TAG = re.compile(r"""(/?)([a-zA-Z][a-zA-Z0-9-]*)([^>'"]*(?:(?:'[^']*'|"[^"]*")[^>'"]*)*)>""")
_MARK = re.compile(r"""[!?][^>'"]*(?:(?:'[^']*'|"[^"]*")[^>'"]*)*>""")
_CONTROLS = {c: None for c in [*range(9), *range(14, 32), *range(127, 133), *range(134, 160)]}


def decode_entities(text: Column) -> Column:
    """``text`` with each entity decoded once; what is no known entity or no character stays as it is."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s){_ENTITY}|[^&]+|&"), F.lit(0))
    names = F.create_map(*[F.lit(x) for k, v in ENTITIES.items() for x in (f"&{k};", v)])

    def numbered(piece: Column) -> Column:
        hexadecimal = piece.rlike("^&#[xX]")
        digits = F.regexp_extract(piece, r"^&#[xX]?\+?0*([0-9a-fA-F]*);$", 1)
        code = F.when(hexadecimal & (F.length(digits) <= 6), F.conv(F.concat(F.lit("0"), digits), 16, 10)).when(~hexadecimal & (F.length(digits) <= 7), F.concat(F.lit("0"), digits)).cast("long")
        fits = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(fits, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    known = lambda p: F.when(p.rlike(f"^(?:{_ENTITY})$"), F.coalesce(F.when(p.startswith("&#"), numbered(p)).otherwise(names[p]), p)).otherwise(p)
    return F.array_join(F.transform(pieces, known), "")


def shown(page: str, blocks: bool) -> str:
    """The text that a decoded page shows; a paragraph after an empty line if ``blocks``, else all in one line.

    A page that breaks off within a tag ends before it. Hidden elements end at the first closing tag of their name.
    """
    out, at, hidden = [], 0, None
    while at < len(page):
        to = page.find("<", at)
        to = len(page) if to < 0 else to
        if hidden is None:
            out.append(page[at:to].translate(_CONTROLS))
        if to == len(page):
            break
        at = to
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            out.append(" ")
            at = len(page) if end < 0 else end + 3
            continue
        tag = _TAG.match(page, at + 1)
        if tag is None:
            mark = page[at + 1 : at + 2]
            opens = mark in ("!", "?") and mark != "" or re.match("/?[a-zA-Z]", page[at + 1 : at + 3])
            if not opens:
                if hidden is None:
                    out.append("<")
                at += 1
                continue
            tag = _MARK.match(page, at + 1)
            if tag is None:
                break
            at = tag.end()
            continue
        closing, name, at = tag[1], tag[2].lower(), tag.end()
        if hidden is not None:
            if closing and name == hidden:
                hidden = None
                out.append(" ")
        elif not closing and name in HIDDEN:
            hidden = name
            out.append(" ")
        elif name in BLOCKS:
            out.append(" " if not blocks else "\n\n" if name == "br" else "\n")
    text = "".join(out)
    if not blocks:
        return " ".join(text.split())
    paragraphs = [[]]
    for line in text.split("\n"):
        words = line.split()
        if words:
            paragraphs[-1] += words
        elif paragraphs[-1]:
            paragraphs.append([])
    return "\n\n".join(" ".join(p) for p in paragraphs if p)


def element(page: str, name: str) -> str | None:
    """What stands between the first ``<name ...>`` and the next ``</name>``; null without either."""
    low = page.lower() if page.isascii() else page.translate({c: c + 32 for c in range(65, 91)})
    begin = re.search(rf"<{name}[>/ \t\r\n]", low)
    start = low.find(">", begin.start()) + 1 if begin else 0
    end = low.find(f"</{name}>", start) if start else -1
    return page[start:end] if end >= 0 else None


def article_div(page: str) -> str | None:
    """The content of the first div of an article's class, up to the closing tag that belongs to it; null without one."""
    at, depth, start = 0, 0, 0
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            if end < 0:
                return None
            at = end + 3
            continue
        tag = re.compile(r"""\s*(/?)\s*([^\s>'"/]*)([^>'"]*(?:(?:'[^']*'|"[^"]*")[^>'"]*)*)>""").match(page, at + 1)
        if tag is None:
            return None
        begin, at, name = at, tag.end(), tag[2].lower()
        if not tag[1] and name in ("script", "style", "template"):
            end = re.compile(rf"</{name}>", re.IGNORECASE).search(page, at)
            if end is None:
                return None
            at = end.end()
        elif name == "div" and tag[1]:
            depth -= depth > 0
            if depth == 0 and start:
                return page[start:begin]
        elif name == "div" and depth:
            depth += 1
        elif name == "div":
            classes = re.search(r"""(?:^|\s)class\s*=\s*(?:"([^"]*)"|'([^']*)')""", tag[3], re.IGNORECASE)
            if classes and any(c in ARTICLE_CLASSES for c in (classes[1] or classes[2] or "").lower().split()):
                depth, start = 1, at
    return None


def page_batches(pages: DataFrame) -> DataFrame:
    """``pages``, which go to Python workers in batches of at most PAGES: a page may be long, and a batch stands in memory several times."""
    conf, name = pages.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= PAGES:
        conf.set(name, str(PAGES))
    return pages


def _mapped(text: Column, f: Callable[[str], str | None]) -> Column:
    @F.pandas_udf("string")
    def mapped(pages: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else f(p) for p in pages], dtype=object)

    return mapped(text)


def plain_text(page: Column) -> Column:
    """All a page shows, in one line; null for null."""
    return _mapped(decode_entities(page), lambda p: shown(p, False))


def reading_text(page: Column) -> Column:
    """All a page shows, in paragraphs; null for null."""
    return _mapped(decode_entities(page), lambda p: shown(p, True))


def article_text(page: Column) -> Column:
    """The paragraphs of a page's article, else of its main part, else of its first div of an article's class.

    Null if there is none of them, if it shows less than LEAST_BODY characters, or if it looks like a request to prove being human.
    """

    def part(p: str) -> str | None:
        for found in (element(p, "article"), element(p, "main"), article_div(p)):
            if found is not None:
                return found
        return None

    text = reading_text(_mapped(page, part))
    bound = F.transform(F.array(text), lambda t: F.when((F.length(t) >= LEAST_BODY) & ~F.exists(F.array(*[F.lit(c) for c in CHALLENGES]), lambda c: F.lower(t).contains(c)), t))
    return bound[0]
