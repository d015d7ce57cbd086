"""Queries cover stories of every id, not only those of the small tables."""

from __future__ import annotations

from datetime import datetime

import pytest

from broadsheet.plans import registry


@pytest.fixture(scope="module")
def wide_dir(spark, tmp_path_factory):
    """220 stories; readers save, open and dismiss early and late ones."""
    to = str(tmp_path_factory.mktemp("wide"))
    docs = [(i, f"Title {i}", "en", "src1" if i // 5 == 215 else "src2", 8) for i in range(1100)]
    at = {i * 7919 % 220: i for i in range(220)}  # story -> event
    said = [(at[3], "purchase"), (at[215], "error"), (at[4], "click"), (at[5], "click"), (at[216], "click"), (at[217], "view")]
    events = [(e, datetime(2024, 1, 19), 1, kind, 1.0) for e, kind in said]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{to}/events.parquet")
    return to


def test_every_story_of_a_reader_is_judged(spark, wide_dir):
    assert {r.story for r in registry.queries()["k6_affinity"](spark, wide_dir).collect()} == {3, 4, 5, 215, 216, 217}


def test_a_dismissed_late_story_is_known(spark, wide_dir):
    assert {r.story for r in registry.queries()["j4_unseen"](spark, wide_dir).collect()} == set(range(220)) - {215}
