"""Copies, near-duplicate titles, release families and the arbiter against plain sequential versions of their rules."""

from __future__ import annotations

import itertools
import random
from collections import defaultdict
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from broadsheet.functions.titles import NEGATIONS, negations, numbers, title_tokens, trigrams
from broadsheet.operators import arbiter
from broadsheet.operators.copies import copy_cohorts, material
from broadsheet.operators.families import change_references, families, release_identity
from broadsheet.operators.near_titles import near_titles

H = 3600
T0 = 1_700_000_000


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain(text):
    return "".join(c for c in text if c.isalnum()).lower()


def figures(text):
    out, now = [], ""
    for c in text + " ":
        if c in "0123456789.":
            now += c
        else:
            if now.strip("."):
                out.append(now.strip("."))
            now = ""
    return out


def denials(text):
    words, now = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            now += c
        else:
            words.append(now)
            now = ""
    return [words.count(m) for m in NEGATIONS] + [text.lower().count(m) for m in ["不", "未", "取消", "撤回", "否认", "推迟", "更正", "辟谣"]]


def cleaned(title, body, at):
    stamps = [datetime.fromtimestamp(at + h * H, UTC).strftime("%Y-%m-%d %H:%M:%S") for h in (0, 8)]
    blocks = body.split("\n\n")
    while blocks and (plain(blocks[0]) == plain(title) or blocks[0].strip().startswith(("来源：", "Source:")) or len(blocks[0].strip()) <= 100 and blocks[0].strip().endswith(tuple(stamps))):
        blocks.pop(0)
    while blocks and (not (b := blocks[-1].strip()) or len(b) <= 100 and b.startswith("版权所有") and "转载" in b):
        blocks.pop()
    text = "\n\n".join(blocks)
    return text if len(text) >= 100 else None


def sequential_cohorts(reports, as_of):
    buckets = defaultdict(list)
    for r in reports:
        _, kind, title, _, at = r
        if kind not in ("release", "discussion") and at is not None and at <= as_of and 24 <= len(plain(title)) <= 240:
            buckets[plain(title), tuple(figures(title))].append(r)
    out = []
    for bucket in buckets.values():
        if len(bucket) > 64:
            continue
        cohorts = []
        for item, _, title, body, at in sorted(bucket, key=lambda r: (r[4], r[0])):
            text = cleaned(title, body, at)
            if text is None:
                continue
            own = (item, at, plain(text), figures(text), denials(text))

            def copy(a, b):
                if a[3:] != b[3:] or not (a[2] in b[2] or b[2] in a[2]):
                    return False
                x, y = ({t[i : i + 5] for i in range(len(t) - 4)} for t in (a[2], b[2]))
                return len(x & y) >= 60 and len(x & y) / min(len(x), len(y)) >= 0.9 and len(x & y) / len(x | y) >= 0.75

            home = next((c for c in cohorts if len(c) < 24 and at - c[0][1] <= 36 * H and all(copy(own, m) for m in c)), None)
            home.append(own) if home else cohorts.append([own])
        out += [(m[0], c[0][0], k) for c in cohorts if len(c) > 1 for k, m in enumerate(c)]
    return sorted(out, key=repr)


TITLE = "A long enough title about memory kits 3.5 and more"
CORE = "The council did not confirm that 12 machines were moved on Monday, and it said that the next meeting would look at the plan once more with all of the parties. "


def report_rows():
    rng, out = random.Random(2), []

    def add(title, body, at, kind="news"):
        out.append((len(out), kind, title, body, at))

    for k in range(6):
        add(TITLE, CORE + CORE.upper(), T0 + k * 10 * H)  # beyond 36 hours a new cohort begins
    add(TITLE.upper() + "!", f"{TITLE}\n\nSource: a wire\n\nBy someone 2023-11-15 06:13:20\n\n{CORE}{CORE.upper()}\n\n版权所有 不得转载\n\n \n", T0 + 0)
    add(TITLE, CORE.replace("did not", "did") + CORE, T0 + 1)
    add(TITLE, CORE.replace("12", "13") + CORE, T0 + 2)
    add(TITLE, CORE + CORE.upper(), T0 + 3, "release")
    add(TITLE, CORE + CORE.upper(), T0 + 900 * H)
    add("too short", CORE * 2, T0)
    add(TITLE, "short", T0)
    add(TITLE.replace("3.5", "3.6"), CORE * 2, T0)
    # a bridge holds both ends, which do not hold each other
    a, b = "alpha beta gamma delta epsilon zeta eta theta " * 6, "iota kappa lambda mu nu xi omicron pi rho sigma "
    for body in (a + b, a + b[:30], "tau " + a + b, a + "upsilon phi chi"):
        add("Another title that is long enough to be looked at", body, T0 + len(out))
    for k in range(70):  # more than 64 of one title
        add("A title which very many reports have in common here", CORE * 2, T0 + k)
    for _ in range(60):
        words = [rng.choice("lorem ipsum dolor sit amet 12 no not 3.4 cancelled 不 more text".split()) for _ in range(60)]
        add(rng.choice(["First of two titles that are long enough", "Second of two titles that are long enough"]), " ".join(words[: rng.choice([55, 60])]), T0 + rng.randint(0, 50 * H))
    return out


def test_copy_cohorts(spark):
    rows = report_rows()
    rng = random.Random(0)
    as_of = T0 + 800 * H
    table = spark.createDataFrame(rng.sample(rows, len(rows)), "item long, kind string, title string, body string, published long")
    got = rows_of(copy_cohorts(table, as_of).select("item", "leader", "place"))
    assert got == sequential_cohorts(rows, as_of) and len(got) > 8
    assert copy_cohorts(table.limit(0), as_of).count() == 0
    null = spark.createDataFrame([(1, None, None, None, None), (2, "news", TITLE, None, T0)], table.schema)
    assert copy_cohorts(table.unionByName(null), as_of).count() == len(got)
    kept = table.select(material(F.col("title"), F.col("body"), F.col("published")).alias("m"), "title", "body", "published").collect()
    assert [r.m for r in kept] == [cleaned(r.title, r.body, r.published) for r in kept]


def test_copies_of_whole_table(spark, sf_dir):
    from broadsheet.sources.views import AS_OF, reports

    table = reports(spark, sf_dir)
    want = sequential_cohorts([tuple(r) for r in table.where("title is not null").select("item", "kind", "title", "body", "published").collect()], AS_OF)
    assert rows_of(copy_cohorts(table, AS_OF).select("item", "leader", "place")) == want


def test_text_functions(spark):
    texts = ["", "No, not NEVER; nowhere was cancelled — 不未 否认 1.2.3. and ..5 v2.0-beta. x..", "Retracted? no.no", "v1 V2.0 -x- .y. a-b"]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    got = table.select(numbers(F.col("t")).alias("n"), negations(F.col("t")).alias("d"), title_tokens(F.col("t")).alias("k"), trigrams(F.col("t")).alias("g")).collect()
    for t, r in zip(texts, got, strict=True):
        assert (list(r.n), list(r.d), list(r.k)) == (figures(t), denials(t), sorted(tokens(t)))
        assert set(r.g) == grams(t)


def tokens(title):
    out, now = set(), ""
    for c in title.lower() + " ":
        if c.isalnum() or c in ".-":
            now += c
        else:
            out.add(now.strip(".-"))
            now = ""
    return out - {""}


def grams(title):
    words = "".join(c if c.isalnum() else " " for c in title.lower()).split()
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


COMMON = set(
    "a an the and or to for with of in new release releases released notes update updates version features improvements fixes bug stable weekly latest available".split()
)


def all_pairs(reports):
    def told(title):
        t = tokens(title)
        n = {x[1:] if x[0] == "v" and len(x) > 1 and x[1] in "0123456789" else x for x in t if any(c in "0123456789" for c in x)}
        return t, n, len([x for x in t if x not in COMMON and not any(c in "0123456789" for c in x)])

    out = []
    for item, kind, title, url, at in reports:
        best = None
        for other, kind2, title2, url2, at2 in reports:
            if kind != kind2 or not (0 <= at - at2 <= 36 * H) or (at2, other) >= (at, item) or min(len(title), len(title2)) < 55:
                continue
            (t, n, d), (t2, n2, d2) = told(title), told(title2)
            if n != n2 or told(url)[1] != told(url2)[1] or min(len(t), len(t2)) < 8 or min(d, d2) < 4 or len(t & t2) < 8 or len(t & t2) / len(t | t2) < 0.88:
                continue
            likeness = len(grams(title) & grams(title2)) / len(grams(title) | grams(title2))
            if likeness >= 0.65:
                best = min(x for x in (best, (-likeness, at2, other)) if x)
        if best:
            out.append((item, best[2], round(-best[0], 9)))
    return sorted(out, key=repr)


def test_near_titles(spark):
    rng, rows = random.Random(5), []
    base = [[f"word{chr(97 + k)}{i}x".replace("0", "o").replace("1", "l") for k in range(14)] for i in range(2)]
    for _ in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(["other", "v2.0", "2.0", "New", "Extra-long"])
        rows.append((len(rows), rng.choice(["news", None]), rng.choice([" ", ", "]).join(words), rng.choice(["https://a.example/p", "https://a.example/p/7"]), T0 + rng.randint(0, 80 * H)))
    rows += [(200 + k, "news", rows[0][2], rows[0][3], T0 + 40 * H) for k in range(5)]
    table = spark.createDataFrame(rng.sample(rows, len(rows)), "item long, kind string, title string, url string, published long")
    got = [(r.item, r.match, round(r.likeness, 9)) for r in near_titles(table).collect()]
    assert sorted(got, key=repr) == all_pairs(rows) and len(got) > 30
    null = spark.createDataFrame([(900, "news", None, "u", T0), (901, "news", rows[0][2], None, T0), (902, "news", rows[0][2], "u", None)], table.schema)
    assert near_titles(table.unionByName(null)).count() == len(got)
    assert near_titles(table.limit(0)).count() == 0


PAGE = "https://github.com/acme/memory-kit/releases/tag/"
GOLDEN = [
    ("@kit/store@1.2.0", "%40kit%2Fstore@1.2.0", ("scope", "acme/memory-kit:npm-scope:kit:1.2.0", "npm:store", "1.2.0")),
    ("@kit/store@1.2.0", "@kit%2Fstore@1.2.1", None), ("@kit/Store@1.2.0", "@kit%2FStore@1.2.0", None), ("@kit/a/b@1.2.0", "@kit%2Fa%2Fb@1.2.0", None), ("@kit/store@01.2.0", "@kit%2Fstore@01.2.0", None),
    ("@kit/store@1.2.0-beta.1", "@kit%2fstore@1.2.0-beta.1", ("scope", "acme/memory-kit:npm-scope:kit:1.2.0-beta.1", "npm:store", "1.2.0-beta.1")), ("@kit/store@1.2.0-01", "@kit%2fstore@1.2.0-01", None),
    ("memory-kit==1.0.0", "1.0.0", ("package", "acme/memory-kit:package", "core", "1.0.0")), ("memory-kit-sdk==1.0.0", "sdk%3D%3d1.0.0", ("package", "acme/memory-kit:package", "component:sdk", "1.0.0")),
    ("memory-kit-sdk==1.0.0", "cli==1.0.0", None), ("memory-kit-sdk==1.0.0", "sdk==1.0.1", None), ("memory-kit==1.0.0", "1%2E0.0", None),
    ("python-v1.0.0", "python-v1.0.0", ("language", "acme/memory-kit:language:stable", "python", "1.0.0")), ("ts-1.0.0-rc.1", "ts-1.0.0-rc.1", ("language", "acme/memory-kit:language:preview", "node", "1.0.0-rc.1")), ("perl-1.0.0", "perl-1.0.0", None),
    ("Memory Kit Node CLI (v0.2.14)", "cli-node-v0.2.14", ("client", "acme/memory-kit:client", "node:cli", "v0.2.14")), ("Memory Kit Python CLI (v0.2.13)", "cli-v0.2.13", ("client", "acme/memory-kit:client", "python:cli", "v0.2.13")),
    ("Memory Kit Node SDK (v3.2.0)", "ts-v3.2.0", ("client", "acme/memory-kit:client", "node:sdk", "v3.2.0")), ("Memory Kit Python SDK (v2.1.0)", "v2.1.0", ("client", "acme/memory-kit:client", "python:sdk", "v2.1.0")),
    ("Vercel AI SDK Provider (v3.0.3)", "vercel-ai-v3.0.3", ("client", "acme/memory-kit:client", "vercelai:provider", "v3.0.3")), ("Vercel AI Provider (v3.0.3)", "vercel-ai-v3.0.3", None),
    ("Memory Kit DeepSeek Plugin (v0.3.0)", "deepseek-plugin-v0.3.0", ("plugin", "acme/memory-kit:plugin", "deepseek", "v0.3.0")), ("Memory Kit DeepSeek Plugin (v0.3.0)", "openclaw-v0.3.0", None), ("Memory Kit Plugin (v0.3.0)", "plugin-v0.3.0", None),
    ("Other DeepSeek Plugin (v0.3.0)", "deepseek-v0.3.0", None), ("Memory Kit DeepSeek Widget (v0.3.0)", "deepseek-v0.3.0", None), ("Memory Kit X Plugin (v1.0.0-v2)", "x-v1.0.0-v2", None), ("Memory Kit X Plugin (v1.0.0-)", "x-v1.0.0-", None),
]


def test_release_grammar(spark):
    table = spark.createDataFrame([(i, PAGE + tag, title) for i, (title, tag, _) in enumerate(GOLDEN)], "i int, url string, title string")
    got = table.select("i", release_identity(F.col("url"), F.col("title")).alias("r")).orderBy("i").collect()
    for r, (title, tag, want) in zip(got, GOLDEN, strict=True):
        assert (r.r and (r.r.kind, r.r.line, r.r.target, r.r.version)) == want, (title, tag)
    bad = spark.createDataFrame([("https://gitlab.com/acme/memory-kit/releases/tag/1.0.0", "memory-kit==1.0.0"), (None, "memory-kit==1.0.0"), (PAGE + "1.0.0", None), ("https://github.com/acme/memory-kit/tags/1.0.0", "memory-kit==1.0.0")], "url string, title string")
    assert bad.where(release_identity(F.col("url"), F.col("title")).isNotNull()).count() == 0
    text = "Fixes (#12), #x #13. https://github.com/Acme/Memory-kit/pull/14 and https://github.com/other/one/pull/15 [https://github.com/acme/memory-kit/issues/16]. ##17"
    assert list(spark.range(1).select(change_references(F.lit(PAGE + "v1"), F.lit(text)).alias("c")).first().c) == ["12", "13", "14", "16"]


def sequential_families(releases, as_of):
    order = sorted((r for r in releases if r[2] is not None and r[1] <= as_of), key=lambda r: (-r[1], r[0]))
    taken, out = set(), []
    for lead in order:
        if lead[0] in taken:
            continue
        (_, at, (line, target, shares, strict), changes), members = lead, [lead]
        targets, low, high, common = {target}, at, at, set(changes)
        for other in order:
            item, t, (line2, target2, *_), more = other
            if item in taken or item == lead[0] or line2 != line or max(high, t) - min(low, t) > 24 * H or target2 in targets:
                continue
            if shares and ((strict and (not common or not more)) or (common and more and not common & set(more))):
                continue
            if shares and more:
                common = common & set(more) if common else set(more)
            targets.add(target2)
            low, high = min(low, t), max(high, t)
            members.append(other)
        taken |= {m[0] for m in members}
        if len(members) > 1:
            out += [(m[0], lead[0], k) for k, m in enumerate(members)]
    return sorted(out, key=repr)


def test_families(spark):
    rng, rows = random.Random(11), []
    for i in range(400):
        line = rng.choice("abcd")
        known = (line, rng.choice("uvwxyz"), line in "ab", line == "a") if rng.random() > 0.05 else None
        rows.append((i, T0 + rng.randint(0, 300) * H // 2, known, sorted(rng.sample(["1", "2", "3"], rng.choice([0, 1, 1, 2])))))
    schema = "item long, published long, identity struct<line string, target string, shares boolean, strict boolean>, changes array<string>"
    table = spark.createDataFrame(rng.sample(rows, len(rows)), schema)
    as_of = T0 + 140 * H
    got = rows_of(families(table, as_of))
    assert got == sequential_families(rows, as_of) and len({r[1] for r in got}) > 20
    assert families(table.limit(0), as_of).count() == 0


def sequential_groups(leaders, offers, members):
    of, who = defaultdict(list), defaultdict(set)
    for leader, *offer in offers:
        of[leader].append(offer)
    for option, member, at in members:
        who[option].add((member, at))
    taken, out = set(), []
    for _, leader in sorted(leaders):
        if leader in taken:
            continue
        group = (None, [leader])
        for _, tier in itertools.groupby(sorted(of[leader]), key=lambda o: o[0]):
            options = []
            for _, option, span, keeps in tier:
                free = {(m, at) for m, at in who[option] if m == leader or keeps or m not in taken}
                if len(free) > 1 and leader in {m for m, _ in free}:
                    options.append((-len(free), option, span, free))
            if options:
                _, option, span, free = min(options, key=lambda o: o[:2])
                inside = [m for m, at in free if at <= min(a for _, a in free) + span]
                if len(inside) > 1 and leader in inside:
                    group = (option, inside)
                break
        taken.update(group[1])
        out += [(leader, group[0], m) for m in group[1]]
    return sorted(out, key=repr)


@pytest.mark.parametrize("few", [0, 20_000])
def test_arbiter(spark, monkeypatch, few):
    monkeypatch.setattr(arbiter, "FEW", few)
    rng = random.Random(7)
    n = 150
    at = {m: rng.randint(0, 100) for m in range(n)}
    leaders = [(rank, leader) for rank, leader in enumerate(rng.sample(range(n), 120))]
    offers, members = [], []
    for k in range(70):
        option, own = f"o{k}", rng.sample(range(n), rng.choice([1, 2, 3, 5, 30]))
        members += [(option, m, at[m]) for m in own]
        tier, span, keeps = rng.randint(0, 2), rng.choice([10, 60, 1000]), rng.random() < 0.3
        offers += [(m, tier, option, span, keeps) for m in own if rng.random() < 0.8] + [(rng.randrange(n), tier, option, span, keeps)]
    offers = list(dict.fromkeys(offers))
    tables = (
        spark.createDataFrame(leaders, "rank long, leader long"), spark.createDataFrame(offers, "leader long, tier int, option string, span long, keeps boolean"), spark.createDataFrame(members, "option string, member long, at long"),
    )
    assert rows_of(arbiter.assigned_groups(*tables)) == sequential_groups(leaders, offers, members)
    if few:
        assert rows_of(arbiter.assigned_groups(tables[0], tables[1].limit(0), tables[2].limit(0))) == sorted(((x, None, x) for _, x in leaders), key=repr)
        assert arbiter.assigned_groups(*(t.limit(0) for t in tables)).count() == 0


def counted(spark, kind):
    """A function that gives its argument back, and how often it was called."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf(kind)
    def same(value):
        calls.add(1)
        return value

    return same, calls


def test_copies_take_texts_apart_once(spark):
    same, calls = counted(spark, "string")
    rows = report_rows()
    table = spark.createDataFrame(rows, "item long, kind string, title string, body string, published long")
    assert copy_cohorts(table.withColumn("body", same("body")), T0 + 400 * H).count() > 0
    assert 0 < calls.value <= len(rows)


def test_families_read_releases_once(spark):
    same, calls = counted(spark, "array<string>")
    rows = [(k, T0 + k, "@kit/" + "abc"[k % 3] + "@1.0.0") for k in range(30)]
    table = spark.createDataFrame(rows, "item long, published long, title string").withColumn("url", F.concat(F.lit("https://github.com/o/kit/releases/tag/"), F.regexp_replace("title", "/", "%2F")))
    told = table.select("item", "published", release_identity(F.col("url"), F.col("title")).alias("identity"), same(F.array(F.lit("1"))).alias("changes"))
    assert families(told, T0 + 99).count() > 0
    assert calls.value <= len(rows)


def test_near_titles_read_titles_once(spark):
    same, calls = counted(spark, "string")
    title = "The regional council approves a revised harbour railway plan after lengthy talks"
    rows = [(k, "news", title + " soon" * (k % 2), "https://a.example/p", T0 + k * H) for k in range(8)]
    table = spark.createDataFrame(rows, "item long, kind string, title string, url string, published long")
    assert near_titles(table.withColumn("title", same("title"))).count() > 0
    assert calls.value <= 2 * len(rows)  # to see whether it fits, and what it is
