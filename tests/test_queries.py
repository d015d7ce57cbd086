"""Every registered query that SQL can state, against DuckDB on the same tables; the others against small brute force."""

from __future__ import annotations

import math

import duckdb
import pytest

from broadsheet.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(rows):
    same = lambda v: round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(same(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, sf_dir, duck, name):
    got = registry.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert plain(got.select(*columns).collect()) == plain([tuple(r[i] for i in order) for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_run(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0
