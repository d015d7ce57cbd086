"""The material budget against a loop over rounds."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from broadsheet.operators.material import allocated, shares


def looped(lengths):
    got = [min(n, 1000) for n in lengths]
    left = 16_000 - sum(got)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    while left > 0:
        before = left
        for i in order:
            more = min(min(lengths[i], 16_000) - got[i], 500, left)
            got[i] += more
            left -= more
        if left == before:
            break
    return got


def parts(body, rest, share):
    if not rest:
        return min(body, share), 0
    if not body:
        return 0, min(rest, share)
    kept = min(rest, max(share // 3, 1))
    b = min(body, max(share - kept, 0))
    return b, min(rest, max(share - b, 0))


def test_shares(spark):
    rng = random.Random(4)
    cases = [[], [0], [5], [20_000], [16_000] * 12, [1_000] * 12, [1_001] * 12, [0, 0, 30_000], [15_999, 2], [1_500, 1_500, 1_501], [700, 16_000, 900, 16_000]]
    cases += [[rng.choice([0, 10, 999, 1_000, 1_250, 5_000, 40_000, rng.randrange(9_000)]) for _ in range(rng.randint(1, 12))] for _ in range(150)]
    table = spark.createDataFrame(list(enumerate(cases)), "i int, n array<int>")
    got = table.select("i", shares(F.col("n")).alias("s")).orderBy("i").collect()
    for r, case in zip(got, cases, strict=True):
        assert list(r.s) == looped(case), case
        assert sum(r.s) == min(16_000, sum(case))


def test_allocated(spark):
    rng = random.Random(9)
    rows = [(s, i, rng.choice([None, rng.randrange(50)]), rng.choice([None, 0, 300, 9_000]), rng.choice([None, 0, 100, 7_000])) for i, s in enumerate(rng.choices(range(12), k=150))]
    got = sorted(tuple(r) for r in allocated(spark.createDataFrame(rows, "story long, item long, published long, body_length int, structured_length int")).collect())
    want = []
    for story in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == story), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))[:12]
        for place, (r, share) in enumerate(zip(own, looped([(r[3] or 0) + (r[4] or 0) for r in own]), strict=True), 1):
            want.append((story, r[1], place, *parts(r[3] or 0, r[4] or 0, share)))
    assert got == sorted(want)
