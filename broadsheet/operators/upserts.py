"""Items with versions on Parquet: an idempotent merge of batches of fetched rows, for foreachBatch or by hand.

An item of a source is known by its external id, its address and all earlier ones of both. Of several items that a fetched row
could be, the one with its content hash is meant, then the one with its external id, then the oldest. A row
without one makes a new item of version 1; one whose content or summary is new makes the item's next version; others change nothing.
An id or address belongs to the item that had it first.

The store is a log: each batch writes one folder of new versions and one of new identities, named by the batch, and reads
only folders of earlier batches. So a batch that is run again writes the same folders over, and nothing else changes. Ids
are made of batch and place, not drawn. What a batch costs is its rows and the identities they meet; ``compacted`` folds old folders into one.

Rows of a batch that may concern one item are those that share an id, an address or a known item; they are gathered by the least
place that each shares with others, over some rounds, and folded in order, one group at a time. Rows without both keys make new items.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import exists, written

FETCHED = "seq long, source string, external_id string, url string, title string, published long, hash string, summary string"
ITEM = "item string, source string, external_id string, url string, title string, published long, hash string, summary string, version long, created_batch long, created_seq long"
IDENTITY = "source string, kind string, value string, item string"
_MADE = pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in (c.split() for c in f"made string, {ITEM}, kind string, value string".split(", "))])
_ITEM, _IDENTITY = ([c.split()[0] for c in s.split(", ")] for s in (ITEM, IDENTITY))


def fold_rows(rows: list[dict], items: dict[str, dict], identities: dict[tuple, str], batch: int) -> tuple[dict[str, dict], dict[tuple, str]]:
    """The items and identities that are new or changed after ``rows`` in order; ``items`` and ``identities`` are brought up to date."""
    changed, added = {}, {}
    # items by the id and address they have now
    holders: dict[tuple, set[str]] = {}
    named = lambda x: [(x["source"], kind, x[c]) for kind, c in (("external", "external_id"), ("url", "url")) if x[c] is not None]
    for i, x in items.items():
        for k in named(x):
            holders.setdefault(k, set()).add(i)
    for r in sorted(rows, key=lambda r: r["seq"]):
        keys = named(r)
        meant = {identities[k] for k in keys if k in identities}
        meant = meant.union(*(holders.get(k, ()) for k in keys))
        first = lambda i: (items[i]["hash"] != r["hash"], r["external_id"] is None or items[i]["external_id"] != r["external_id"], items[i]["created_batch"], items[i]["created_seq"], i)
        found = min(meant, key=first, default=None)
        own = {c: r[c] for c in ("external_id", "url", "title", "published", "hash")} | {"summary": r["summary"] or ""}
        if found is None:
            found = hashlib.sha256(f"{batch}:{r['seq']}".encode()).hexdigest()[:32]
            items[found] = changed[found] = {"item": found, "source": r["source"], **own, "version": 1, "created_batch": batch, "created_seq": r["seq"]}
            for k in keys:
                holders.setdefault(k, set()).add(found)
        elif items[found]["hash"] != own["hash"] or items[found]["summary"] != own["summary"]:
            before = items[found]
            own["published"] = before["published"] if own["published"] is None else own["published"]
            items[found] = changed[found] = {**before, **own, "version": before["version"] + 1}
            for k in named(before):
                holders[k].discard(found)
            for k in keys:
                holders.setdefault(k, set()).add(found)
        for k in keys:
            if k not in identities:
                identities[k] = added[k] = found
    return changed, added


class ItemStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self, table: str, schema: str, before: int | None) -> DataFrame:
        """All rows of the folders of a table, of batches earlier than ``before``, with their batch."""
        at = f"{self.path}/{table}"
        if not exists(self.spark, at):
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
        rows = self.spark.read.schema(f"{schema}, batch long").parquet(at)
        return rows if before is None else rows.where(F.col("batch") < before)

    def items(self, before: int | None = None) -> DataFrame:
        """The latest version of each item."""
        log = self._log("items", ITEM, before)
        last = log.groupBy("item").agg(F.max("version").alias("version"))
        return log.join(last, ["item", "version"]).select(*_ITEM)

    def identities(self, before: int | None = None) -> DataFrame:
        return self._log("identities", IDENTITY, before).select(*_IDENTITY)

    def upsert(self, fetched: DataFrame, batch: int) -> None:
        """Merge ``fetched`` (as FETCHED; no two rows have one ``seq``) as the batch of that number; numbers grow, a number may be run again."""
        rows = written(fetched.select(*[c.split()[0] for c in FETCHED.split(", ")]), "fetched")
        keys = rows.select("seq", "source", F.explode(F.array(F.struct(F.lit("external").alias("kind"), F.col("external_id").alias("value")), F.struct(F.lit("url").alias("kind"), F.col("url").alias("value")))).alias("k"))
        keys = keys.select("seq", "source", "k.kind", "k.value").where("value is not null")
        named = self.identities(batch).select(F.col("source").alias("of"), "kind", "value", "item")
        known = written(keys.join(named, (keys["kind"] == named["kind"]) & (keys["value"] == named["value"]) & keys["source"].eqNullSafe(named["of"]), "left").select(keys["seq"], keys["source"], keys["kind"], keys["value"], "item"), "keys")
        met = known.where("item is not null").select("seq", "item")
        ties = known.select("seq", F.sha2(F.to_json(F.struct("source", "kind", "value")), 256).alias("tie")).unionByName(met.select("seq", F.concat(F.lit("item:"), "item").alias("tie")))
        labels = written(self._gathered(rows.select("seq"), ties), "labels")
        items = self.items(batch).join(met.select("item").distinct(), "item", "left_semi")
        of_item = met.join(labels, "seq").groupBy("item").agg(F.min("label").alias("label"))
        old = items.join(of_item, "item")
        others = self.identities(batch).join(of_item, "item")

        def folded(own: list[dict]) -> list[dict]:
            parts = {name: [x["data"] for x in own if x["part"] == name] for name in ("row", "item", "identity")}
            held = {x["item"]: {c: x[c] for c in _ITEM} for x in parts["item"]}
            changed, added = fold_rows(parts["row"], held, {(x["source"], x["kind"], x["value"]): x["item"] for x in parts["identity"]}, batch)
            out = [{"made": "item", **x} for x in changed.values()]
            return out + [{"made": "identity", "source": s, "kind": k, "value": v, "item": i} for (s, k, v), i in added.items()]

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[dict] = []  # the rows of the group that may go on
            for rows_of in batches:
                out = []
                for x in rows_of.to_pylist():
                    if held and held[0]["label"] != x["label"]:
                        out += folded(held)
                        held = []
                    held.append(x)
                yield pa.RecordBatch.from_pylist(out, _MADE)
            yield pa.RecordBatch.from_pylist(folded(held) if held else [], _MADE)

        as_part = lambda df, name: df.select("label", F.lit(name).alias("part"), F.struct(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in _FIELDS.items()]).alias("data"))
        both = as_part(rows.join(labels, "seq"), "row").unionByName(as_part(old, "item")).unionByName(as_part(others, "identity"))
        # most groups are one or two rows: they pass in order through one task's batches, not each as a table of its own
        made = written(both.repartition("label").sortWithinPartitions("label").mapInArrow(fold, f"made string, {ITEM}, kind string, value string"), "merged")
        for table, columns, kind in (("items", _ITEM, "item"), ("identities", _IDENTITY, "identity")):
            made.where(F.col("made") == kind).select(*columns).write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch}")

    def _gathered(self, rows: DataFrame, ties: DataFrame) -> DataFrame:
        """seq, label: the least seq that ties lead to."""
        ties = written(ties.distinct(), "ties")
        labels = rows.select("seq", F.col("seq").alias("label"))
        while True:
            low = ties.join(labels, "seq").groupBy("tie").agg(F.min("label").alias("low"))
            new = ties.join(low, "tie").groupBy("seq").agg(F.min("low").alias("low"))
            moved = written(labels.join(new, "seq", "left").select("seq", F.least("label", F.coalesce("low", "label")).alias("label"), (F.col("low") < F.col("label")).alias("moved")), "labels")
            labels = moved.select("seq", "label")
            if moved.where("moved").isEmpty():
                return labels

    def compacted(self, to: str, batch: int) -> ItemStore:
        """A new store at ``to`` that holds what this one holds, as that one batch."""
        self.items().write.mode("overwrite").parquet(f"{to}/items/batch={batch}")
        self.identities().write.mode("overwrite").parquet(f"{to}/identities/batch={batch}")
        return ItemStore(self.spark, to)


_FIELDS = dict(c.split() for s in (FETCHED, ITEM, IDENTITY) for c in s.split(", "))


def upsert_stream(fetched: DataFrame, path: str, checkpoint: str):
    """A running query that merges a stream of fetched rows into the store at ``path``; a batch that is run again changes nothing."""
    return fetched.writeStream.foreachBatch(lambda df, batch: ItemStore(df.sparkSession, path).upsert(df, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
