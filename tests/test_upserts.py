"""The item store against one fold over all rows; replayed batches, streams and compaction."""

from __future__ import annotations

import random

from broadsheet.operators import upserts
from broadsheet.operators.upserts import FETCHED, ItemStore


def fetched(n, seed=1):
    rng, out = random.Random(seed), []
    for seq in range(n):
        source, k = rng.choice(["s1", "s2", None]), rng.randrange(12)
        ext = rng.choice([f"e{k}", f"e{k}", f"e{rng.randrange(12)}", None])
        url = rng.choice([f"u{k}", f"u{k}", f"u{rng.randrange(12)}", None])
        out.append((seq, source, ext, url, f"t{rng.randrange(3)}", rng.choice([None, seq]), f"h{rng.randrange(3)}", rng.choice([None, "", "s"])))
    return out


def folded(batches):
    """Row by row, searching all items and identities each time."""
    items, identities = [], {}
    for batch, rows in enumerate(batches):
        for seq, source, ext, url, title, published, digest, summary in sorted(rows):
            keys = [k for k in ((source, "external", ext), (source, "url", url)) if k[2] is not None]
            fits = [x for x in items if x["source"] == source and (ext is not None and x["external_id"] == ext or url is not None and x["url"] == url or any(identities.get(k) is x for k in keys))]
            fits.sort(key=lambda x: (x["hash"] != digest, ext is None or x["external_id"] != ext, x["created"]))
            new = {"external_id": ext, "url": url, "title": title, "published": published, "hash": digest, "summary": summary or ""}
            if not fits:
                x = {"source": source, **new, "version": 1, "created": (batch, seq)}
                items.append(x)
            else:
                x = fits[0]
                if x["hash"] != digest or x["summary"] != (summary or ""):
                    new["published"] = x["published"] if published is None else published
                    x.update(new, version=x["version"] + 1)
            for k in keys:
                identities.setdefault(k, x)
    return sorted([(x["source"], x["external_id"], x["url"], x["title"], x["published"], x["hash"], x["summary"], x["version"], *x["created"]) for x in items], key=repr)


SEEN = ["source", "external_id", "url", "title", "published", "hash", "summary", "version", "created_batch", "created_seq"]


def rows_of(store):
    return sorted((tuple(r) for r in store.items().select(*SEEN).collect()), key=repr)


def test_batches_and_replays(spark, tmp_path):
    rows = fetched(150)
    batches = [rows[:70], rows[70:75], [], rows[75:]]
    store = ItemStore(spark, f"file://{tmp_path}/store")
    for k, batch in enumerate(batches):
        store.upsert(spark.createDataFrame(random.Random(k).sample(batch, len(batch)), FETCHED), k)
        if k == 1:
            before = rows_of(store)
            store.upsert(spark.createDataFrame(batch, FETCHED), k)
            assert rows_of(store) == before
    want = folded(batches)
    assert rows_of(store) == want and max(r[7] for r in want) > 3
    for k in (3,):  # the last batch run again changes nothing
        store.upsert(spark.createDataFrame(batches[k], FETCHED), k)
    assert rows_of(store) == want
    small = store.compacted(f"file://{tmp_path}/small", 3)
    assert rows_of(small) == want
    more = fetched(10, 9)
    for s in (store, small):
        s.upsert(spark.createDataFrame(more, FETCHED), 4)
    assert rows_of(small) == rows_of(store) == folded([*batches, more])


def test_stream(spark, tmp_path):
    rows = fetched(40, 3)
    spark.createDataFrame(rows[:25], FETCHED).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(FETCHED).parquet(f"{tmp_path}/in")
    path = f"file://{tmp_path}/store"
    upserts.upsert_stream(stream(), path, f"{tmp_path}/check").awaitTermination(180)
    spark.createDataFrame(rows[25:], FETCHED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    upserts.upsert_stream(stream(), path, f"{tmp_path}/check").awaitTermination(180)
    assert rows_of(ItemStore(spark, path)) == folded([rows[:25], rows[25:]])


def test_a_group_is_not_searched_for_every_row():
    class Held(dict):
        looked = 0

        def items(self):
            Held.looked += 1
            return super().items()

    rows = [{"seq": k, "source": "s", "external_id": f"e{k % 40}", "url": f"u{k % 7}", "title": "t", "published": k, "hash": f"h{k % 5}", "summary": ""} for k in range(200)]
    upserts.fold_rows(rows, Held(), {}, 0)
    assert Held.looked <= 1
