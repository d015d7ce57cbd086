"""Copies under titles that very many reports have, against the plain sequential rule over all of them; the queries that list and group them."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from test_coverage import TITLE, cleaned, denials, figures, plain, rows_of

from broadsheet.operators.copies import copy_cohorts, marks, placed
from broadsheet.plans import registry
from broadsheet.sources.views import AS_OF, reports

H = 3600
T0 = 1_700_000_000


def copies_of(a, b):
    if not (a in b or b in a):
        return False
    x, y = ({t[i : i + 5] for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) >= 60 and len(x & y) / min(len(x), len(y)) >= 0.9 and len(x & y) / len(x | y) >= 0.75


def sequential(rows, as_of):
    """All titles, however many reports have them."""
    meet = {}
    for item, kind, title, body, at in rows:
        if kind not in ("release", "discussion") and at <= as_of and 24 <= len(plain(title)) <= 240 and (text := cleaned(title, body, at)) is not None:
            meet.setdefault((plain(title), *map(tuple, (figures(title), figures(text), denials(text)))), []).append((at, item, plain(text)))
    out = []
    for own in meet.values():
        cohorts = []
        for r in sorted(own):
            home = next((c for c in cohorts if len(c) < 24 and r[0] - c[0][0] <= 36 * H and all(copies_of(r[2], m[2]) for m in c)), None)
            home.append(r) if home else cohorts.append([r])
        out += [(m[1], c[0][1], k) for c in cohorts if len(c) > 1 for k, m in enumerate(c)]
    return sorted(out, key=repr)


def edited(rng, words, text):
    own, kind = text.split(), rng.random()
    if kind < 0.2:
        return " ".join(own[: rng.randint(44, 60)])  # nested, one within the other
    if kind < 0.35:
        return " ".join(own[rng.randint(0, 16) :])
    if kind < 0.45:
        return " ".join([rng.choice(words), *own, rng.choice(words)])
    if kind < 0.55:
        own[rng.randrange(60)] = "edited"
        return " ".join(own)
    return text + rng.choice(["", "", " 不", " 7"])


@pytest.mark.parametrize(("seed", "hours"), [(0, 60), (1, 300), (2, 5)])
def test_copies_under_a_common_title(spark, seed, hours):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(3)]
    rows = [(k, "news", TITLE, edited(rng, words, rng.choice(texts)), T0 + rng.randint(0, hours * H)) for k in range(200)]
    table = spark.createDataFrame(rng.sample(rows, len(rows)), "item long, kind string, title string, body string, published long")
    want = sequential(rows, T0 + 800 * H)
    assert rows_of(copy_cohorts(table, T0 + 800 * H, most=None).select("item", "leader", "place")) == want and len(want) > 64
    assert copy_cohorts(table.limit(0), T0, most=None).count() == 0


def test_marks_of_parts():
    rng = random.Random(3)
    for _ in range(50):
        text = "".join(rng.choice("ab不😀c") for _ in range(rng.randint(64, 400)))
        begin = rng.randint(0, len(text) - 64)
        part = text[begin : rng.randint(begin + 64, len(text))]
        assert 0 < len(marks(part)) and set(marks(part)) <= set(marks(text))
    assert [len(marks(t)) for t in ("", "a", "a" * 62, "a" * 63)] == [0, 0, 0, 1]


def test_reports_pass_in_batches_of_any_size():
    rng = random.Random(4)
    near = {no: np.array([x for x in range(6) if x != no and (x + no) % 3]) for no in range(5)} | {5: None}
    rows = pd.DataFrame(sorted((k % 2, rng.randint(0, 90 * H), k, rng.randrange(6)) for k in range(300)), columns=["key", "published", "item", "no"])
    rows["copies"] = [near[no] for no in rows["no"]]
    whole = pd.concat(placed(iter([rows])), ignore_index=True)
    parts = pd.concat(placed(iter([rows.iloc[k : k + 7] for k in range(0, len(rows), 7)])), ignore_index=True)
    assert sorted(whole.itertuples(index=False)) == sorted(parts.itertuples(index=False)) and len(whole) > 100


@pytest.fixture(scope="module")
def common_title(spark, tmp_path_factory):
    """A folder with a table of documents of one title and few texts, and the cohorts it has."""
    rng = random.Random(5)
    texts = ["\n".join([TITLE, "".join(rng.choice("abcdefgh ") for _ in range(400))]) for _ in range(2)]
    folder = str(tmp_path_factory.mktemp("common"))
    rows = [(k, rng.choice(texts), "en", f"site{k % 9}", 400) for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    told = reports(spark, folder).select("item", "kind", "title", "body", "published").collect()
    cohorts = {}
    for item, leader, place in sequential([tuple(r) for r in told], AS_OF):
        cohorts.setdefault(leader, []).append((place, item))
    return folder, {leader: [item for _, item in sorted(members)] for leader, members in cohorts.items()}


def test_c3_lists_copies_under_a_common_title(spark, common_title):
    folder, cohorts = common_title
    got = {r.leader: (r.n_members, r.members) for r in registry.queries()["c3_copy_cohorts"](spark, folder).collect()}
    assert got == {leader: (len(m), ",".join(map(str, m))) for leader, m in cohorts.items()} and len(got) > 5


def test_c11_groups_copies_under_a_common_title(spark, common_title):
    folder, cohorts = common_title
    got = rows_of(registry.queries()["c11_groups"](spark, folder).where("tier = 0").select("n_members", "first", "last"))
    assert got == sorted(((len(m), min(m), max(m)) for m in cohorts.values()), key=repr) and len(got) > 5
