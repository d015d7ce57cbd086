"""Entities, readable text and articles of pages: goldens, and a reader that goes character by character."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from broadsheet.functions import html as H

GOLDEN = [
    ("&amp;lt;p&amp;gt;", "&lt;p&gt;", "&lt;p&gt;"),
    ("a &lt;b&gt;c&lt;/b&gt; d", "a c d", "a c d"),  # decoded first, so these are tags
    ("1 < 2 && 3 > 2 &unknown; &#x41;&#66;&#0067; &#xD800; &#1114112;", "1 < 2 && 3 > 2 &unknown; ABC &#xD800; &#1114112;", None),
    ("<p>one</p><p>two<br>three</p>", "one two three", "one\n\ntwo\n\nthree"),
    ("x<script>if (a<b) '</script>' \"</p>\"</script>y", None, None),
    ("<nav>a<nav>b</nav>c</nav>d", "cd", "cd"),
    ("<p title='a > b'>in</p><!-- > <p> -->out<!-- open", "in out", None),
    ("before <a href=\"x>y\">link</a> after <b unclosed", "before link after", "before link after"),
    ("<DIV>Up\x00per\x07</DIV>　wide space", "Upper wide space", None),
    ("<?xml a='>'?><!DOCTYPE html>text</3", "text</3", "text</3"), ("", "", ""), ("<", "<", "<"), ("<p", "", ""), ("&", "&", "&"), ("&#38;amp; &nbsp;.", "&amp; .", "&amp; ."),
]


def entities(text):
    out, at = "", 0
    while at < len(text):
        end = text.find(";", at)
        if text[at] == "&" and end >= 0 and len(text[at:end].encode()) <= 33:
            name = text[at + 1 : end]
            code = None
            if re.fullmatch(r"#[xX]\+?[0-9a-fA-F]+", name):
                code = int(name[2:], 16)
            elif re.fullmatch(r"#\+?[0-9]+", name):
                code = int(name[1:])
            value = H.ENTITIES.get(name) if code is None else chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else None
            if value is not None:
                out, at = out + value, end + 1
                continue
        out, at = out + text[at], at + 1
    return out


def reader(text, blocks):
    """One character at a time, with the state written out."""
    text, out, at, hidden = entities(text), "", 0, None
    while at < len(text):
        c = text[at]
        if c != "<":
            if hidden is None and (c.isspace() and c not in "\x1c\x1d\x1e\x1f" or not (ord(c) < 32 or 127 <= ord(c) < 160)):
                out += c
            at += 1
            continue
        if text[at : at + 4] == "<!--":
            end = text.find("-->", at + 4)
            at, out = (len(text) if end < 0 else end + 3), out + " "
            continue
        k = at + 1 + (text[at + 1 : at + 2] == "/")
        letter = text[k : k + 1]
        if not (letter.isascii() and letter.isalpha() or text[at + 1 : at + 2] in ("!", "?") and text[at + 1 : at + 2]):
            out += "<" if hidden is None else ""
            at += 1
            continue
        end = k
        while end < len(text) and (text[end].isascii() and text[end].isalnum() or text[end] == "-"):
            end += 1
        name, quote = text[k:end].lower(), None
        while end < len(text) and (quote or text[end] != ">"):
            quote = (None if text[end] == quote else quote) if quote else text[end] if text[end] in "'\"" else None
            end += 1
        if end == len(text):
            break
        if hidden:
            if k > at + 1 and name == hidden:
                hidden, out = None, out + " "
        elif k == at + 1 and name in H.HIDDEN:
            hidden, out = name, out + " "
        elif name in H.BLOCKS:
            out += ("\n\n" if name == "br" else "\n") if blocks else " "
        at = end + 1
    if not blocks:
        return " ".join(out.split())
    return "\n\n".join(" ".join(p.split()) for p in re.split(r"\n[^\S\n]*(?:\n[^\S\n]*)+", re.sub(r"[^\S\n]+", " ", "\n" + out + "\n")) if p.strip())


def test_goldens(spark):
    table = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(GOLDEN)], "i int, t string")
    got = table.select("i", H.decode_entities(F.col("t")).alias("e"), H.plain_text(F.col("t")).alias("p"), H.reading_text(F.col("t")).alias("r")).orderBy("i").collect()
    for r, (text, plain, reading) in zip(got, GOLDEN, strict=True):
        assert r.e == entities(text), text
        assert r.p == reader(text, False) and r.r == reader(text, True), text
        assert plain is None or r.p == plain, text
        assert reading is None or r.r == reading, text
    assert spark.createDataFrame([(None,)], "t string").select(H.plain_text(F.col("t")).alias("p"), H.article_text(F.col("t")).alias("a")).first() == (None, None)


def test_random_pages_and_table(spark, sf_dir):
    rng = random.Random(3)
    parts = ["<p>", "</p>", "<br/>", "<script>", "</script>", "<nav a='>'>", "</nav>", "text ", "&lt;", "&amp;", "&#60;", "<", ">", "'", '"', "<!--", "-->", "\n", "\r\n", "é", "<x-y z>", "</", "<?", "\x1c", "\x85"]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    pages += [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    table = spark.createDataFrame(list(enumerate(pages)), "i int, t string")
    got = table.select("i", H.plain_text(F.col("t")).alias("p"), H.reading_text(F.col("t")).alias("r")).orderBy("i").collect()
    for r, page in zip(got, pages, strict=True):
        assert r.p == reader(page, False), repr(page)
        assert r.r == reader(page, True), repr(page)


def test_articles(spark):
    body = "word " * 60
    pages = [
        (f"<body><nav>n</nav><ARTICLE class=x><p>{body}</p></ARTICLE></body>", body.strip()),
        (f"<articles>{body}</articles><main>\n<p>{body}one</p></main>", f"{body}one"),
        (f"<div><div class='wide entry-content'><div>{body}</div>two<script>'</div>'</script></div>three</div>", f"{body.strip()} two"),
        (f"<div data-class='article'>{body}</div>", None),
        (f"<article>{body} please enable JavaScript</article>", None),
        ("<article>short</article>", None),
        (f"<article>{body}", None),
        (f"<div class=\"article\">{body}<div>", None),
    ]
    table = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(pages)], "i int, t string")
    got = table.select("i", H.article_text(F.col("t")).alias("a")).orderBy("i").collect()
    assert [r.a for r in got] == [w for _, w in pages]


def test_pages_go_to_python_in_small_batches(spark, sf_dir):
    from broadsheet.plans.coverage import h1_page_text, h11_articles

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for query in (h1_page_text, h11_articles):
        spark.conf.unset(name)
        query(spark, sf_dir)
        assert 0 < int(spark.conf.get(name)) <= 250
    spark.conf.unset(name)
