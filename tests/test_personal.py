"""The reading bonus against its rule, written plainly; readers' stories are judged where they stand."""

from __future__ import annotations

import random

import pytest

from broadsheet.functions.policy import OTHER
from broadsheet.operators import personal
from broadsheet.sources.views import AS_OF, DAY


def test_bonus_of_each_story(spark):
    rng = random.Random(3)
    rows = []
    for reader, n in ((1, 30), (2, 200), (3, 1)):
        for story in range(n):
            facets = rng.sample(["a", "b", "c", OTHER], rng.randint(0, 3))
            rows.append((reader, story, facets, ["b"] if reader == 1 else [], rng.choice([None, *[AS_OF - rng.randrange(35 * DAY)] * 9]), rng.choice([None] * 9 + [AS_OF - 5]), None))
    table = spark.createDataFrame(rows, "reader long, story long, facets array<string>, barred array<string>, opened long, saved long, dismissed long")
    want = {}
    for reader in (1, 2, 3):
        of = [r for r in rows if r[0] == reader]
        read = sorted((r for r in of if r[5] is None and r[4] is not None and r[4] > AS_OF - 30 * DAY), key=lambda r: (-r[4], r[1]))[:150]
        own = {r[1]: 2 * 0.5 ** ((AS_OF - r[4]) / (14 * DAY)) for r in read}
        for r in of:
            values = []
            for f in set(r[2]) - set(r[3]) - {OTHER}:
                others = [own[x[1]] for x in read if f in x[2] and x[1] != r[1]]
                if len(others) >= 2:
                    values.append(min(20.0, sum(others)))
            want[reader, r[1]] = max(values, default=None)
    out = personal.with_bonus(personal.with_reading(table, AS_OF))
    got = {(r[0], r[1]): r[2] for r in out.select("reader", "story", "bonus").collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1  # of readings, not of all stories again
