"""Daily and weekly editions against a choice that looks at every candidate in turn."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from broadsheet.operators.editions import daily_editions, weekly_editions

SCHEMA = "edition long, item long, rank double, published long, at long, fresh boolean, publishers array<string>, role string, community boolean, topic string, story_key string"


def chosen(rows, size, weekly):
    out = []
    for edition in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == edition), key=lambda r: (-r[2], r[3] is None, -(r[3] or 0), r[1]))
        taken = []

        def fits(r):
            _, _, _, _, at, _, publishers, role, community, topic, key = r
            for p in publishers:
                if sum(p in t[6] for t in taken) >= (3 if weekly else 2):
                    return False
            if community and sum(t[8] for t in taken) >= 2 or role == "index" and sum(t[7] == "index" for t in taken) >= 2 or role == "podcast" and sum(t[7] == "podcast" for t in taken) >= 3:
                return False
            if Counter(t[9] for t in taken)[topic] >= 5:
                return False
            return not (key and role != "first_party" and any(t[10] == key and (t[4] is None or at is None or int(abs(t[4] - at) / 3600) <= 96) for t in taken))

        sections = {}
        for fresh in (True,) if weekly else (True, False):
            for r in own:
                if (weekly or r[5] == fresh) and len(taken) < size and (fresh or sum(not t[5] for t in taken) < 3) and fits(r):
                    taken.append(r)
                    sections[r[1]] = "catch_up" if not fresh else "essential" if len(taken) <= 5 else "more"
        if weekly:
            topics = list(dict.fromkeys(t[9] for t in taken))
            taken = [t for topic in topics for t in taken if t[9] == topic]
            sections = {t[1]: f"topic-{topics.index(t[9])}" for t in taken}
        out += [(edition, t[1], k, sections[t[1]]) for k, t in enumerate(taken, 1)]
    return sorted(out)


def candidates(seed, n):
    rng, out = random.Random(seed), []
    for i in range(n):
        at = rng.choice([None, rng.randrange(200 * 3600), rng.randrange(200 * 3600)])
        publishers = rng.sample([f"p{k}" for k in range(rng.choice([4, 12]))], rng.choice([0, 1, 1, 2, 3]))
        role = rng.choice(["first_party", "editorial", "index", "podcast", "community", "unknown"])
        out.append((rng.randrange(4), i, float(rng.randrange(20)), rng.choice([None, at]), at, rng.random() < 0.7, publishers, role, role == "community" or rng.random() < 0.05, f"t{rng.randrange(6)}", rng.choice([None, None, "gpt6", "qwen3"])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_editions(spark, seed):
    rows = candidates(seed, 900)
    table = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), SCHEMA)
    assert sorted(tuple(r) for r in daily_editions(table, 20).collect()) == chosen(rows, 20, False)
    assert sorted(tuple(r) for r in weekly_editions(table, 30).collect()) == chosen(rows, 30, True)
    assert daily_editions(table.limit(0), 20).count() == 0


def test_candidates_of_an_edition_are_made_once(spark, sf_dir):
    from broadsheet.plans.editorial import q1_edition

    assert not any("documents.parquet" in f for f in q1_edition(spark, sf_dir).inputFiles())
