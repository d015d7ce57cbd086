"""Operator 1: sharding by Karmarkar-Karp differencing. Law: ``bytes`` (shard sizes near equal).

Documents with equal texts form an indivisible group. The multi-way differencing method starts with one
partial partition per group (its bytes in one of the n subsets), and again and again takes the two partial
partitions of largest spread and adds them up oppositely ordered: the largest subset of one to the smallest
of the other. It is run in levels so that no task holds more than about FAN_IN partial partitions: groups are
dealt into buckets by hash, each bucket is differenced into one partial partition, FAN_IN of these are
differenced into one again, and so on to the last. Every level's output is a table; a group's shard follows
from its subset at each level. Only bucket tables (n rows a bucket) are joined, never texts.

Rows get gapless slots from 0 within their shard, in order of id chunk and id. Null texts count as empty
texts (size 1, crc32 0, one group with them). Repeated rows fall into one group and get slots of their own.
Null ids come first. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, saved

#: Groups or partial partitions that one task differences at once, and rows numbered by one window.
FAN_IN, CHUNK_ROWS = 8_192, 100_000


def difference(sums: np.ndarray) -> np.ndarray:
    """Karmarkar-Karp over partial partitions.

    ``sums`` has a row per partial partition and a column per subset. Returns, of the same shape, the final
    subset that each one's subset ends in.
    """
    rows, n = sums.shape
    out = np.empty((rows, n), np.int64)
    if not rows:
        return out
    node_sums: list[list[int]] = []
    #: of a leaf: its row and the order of its columns; of a joint: its two parts, and for each part the joint's place of each of its places
    nodes: list[tuple] = []
    heap = []
    for k, row in enumerate(sums.tolist()):
        order = sorted(range(n), key=lambda c: (-row[c], c))
        node_sums.append([row[c] for c in order])
        nodes.append((k, order))
        heap.append((-(row[order[0]] - row[order[-1]]), k))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = node_sums[a], node_sums[b]
        joint = [p + q for p, q in zip(x, reversed(y), strict=True)]
        order = sorted(range(n), key=lambda c: (-joint[c], c))
        place = [0] * n
        for to, c in enumerate(order):
            place[c] = to
        node_sums.append([joint[c] for c in order])
        node_sums[a] = node_sums[b] = []  # no longer needed
        nodes.append((a, b, place, place[::-1]))
        new = node_sums[-1]
        heapq.heappush(heap, (-(new[0] - new[-1]), len(nodes) - 1))
    final: dict[int, list[int]] = {len(nodes) - 1: list(range(n))}
    for k in range(len(nodes) - 1, -1, -1):
        at = final.pop(k)
        node = nodes[k]
        if len(node) == 2:
            row, order = node
            for i, c in enumerate(order):
                out[row, c] = at[i]
        else:
            a, b, pa, pb = node
            final[a] = [at[p] for p in pa]
            final[b] = [at[p] for p in pb]
    return out


def _difference_groups(n: int):
    """One bucket of groups: each group's subset."""

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "group"], ascending=[False, True])
        sums = np.zeros((len(pdf), n), np.int64)
        sums[:, 0] = pdf["bytes"]
        return pd.DataFrame({"bucket": pdf["bucket"], "group": pdf["group"], "bytes": pdf["bytes"], "subset": difference(sums)[:, 0]})

    return go


def _difference_buckets(n: int):
    """Partial partitions of one level: the subset of the next level that each subset goes to."""

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="bucket", columns="subset", values="bytes", aggfunc="sum", fill_value=0).reindex(columns=range(n), fill_value=0).sort_index()
        to = difference(wide.to_numpy(np.int64))
        buckets = np.repeat(wide.index.to_numpy(), n)
        return pd.DataFrame({"bucket": buckets, "subset": np.tile(np.arange(n), len(wide)), "next": np.repeat(pdf["next"].iloc[0], len(buckets)), "to": to.ravel(), "bytes": wide.to_numpy(np.int64).ravel()})

    return go


def group_shards(groups: DataFrame, n_groups: int, n_shards: int) -> DataFrame:
    """group, shard of a table of (group, bytes)."""
    buckets = max(1, -(-n_groups // FAN_IN))
    first = groups.withColumn("bucket", F.pmod(F.hash("group"), F.lit(buckets)).cast("long"))
    subsets = saved(first.groupBy("bucket").applyInPandas(_difference_groups(n_shards), "bucket long, group long, bytes long, subset int"), "groups")
    levels, tables = [], subsets.groupBy("bucket", "subset").agg(F.sum("bytes").alias("bytes"))
    while buckets > 1:
        buckets = -(-buckets // FAN_IN)
        level = saved(tables.withColumn("next", F.col("bucket") % F.lit(buckets)).groupBy("next").applyInPandas(_difference_buckets(n_shards), "bucket long, subset int, next long, to int, bytes long"), "level")
        levels.append(level)
        tables = level.groupBy(F.col("next").alias("bucket"), F.col("to").alias("subset")).agg(F.sum("bytes").alias("bytes"))
    if not levels:
        return subsets.select("group", F.col("subset").alias("shard"))
    # from the last level back: the shard of each bucket's subset
    shard_of = levels[-1].select("bucket", "subset", F.col("to").alias("shard"))
    for level in reversed(levels[:-1]):
        up = shard_of.select(F.col("bucket").alias("next"), F.col("subset").alias("to"), "shard")
        shard_of = level.join(up, ["next", "to"]).select("bucket", "subset", "shard")
    return subsets.join(shard_of, ["bucket", "subset"]).select("group", "shard")


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law) of each document."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = saved(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        # two texts of one hash would share a group, which keeps every promise but a byte or so of balance
        F.xxhash64(text, F.octet_length(text)).alias("group"),
    ), "rows")
    groups = saved(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "sizes")
    n_rows, n_groups = rows.count(), groups.count()
    placed = rows.join(group_shards(groups, n_groups, n_shards), "group")
    # gapless slots: number the rows of each chunk of ids, and add what the chunks before it hold
    chunks = max(1, -(-n_rows // CHUNK_ROWS)) * 4
    placed = saved(placed.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.pmod(F.hash("doc_id"), F.lit(chunks)).alias("chunk")), "placed")
    held = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = held.select("shard", "chunk", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size"))
    out = placed.withColumn("nth", nth).join(before, ["shard", "chunk"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, to: str, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents as one folder per shard, each row once and with all its columns, and the shard as ``_shard`` (or that name with more underscores).

    A row's shard follows from its text, as equal texts share one; so ids may be null or repeated.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    group, name = fresh(docs.columns, "_group"), fresh(docs.columns, "_shard")
    keyed = docs.withColumn(group, F.xxhash64(text, F.octet_length(text)))
    groups = saved(keyed.groupBy(group).agg(F.sum(F.octet_length(text).cast("long") + 1).alias("bytes")).withColumnRenamed(group, "group"), "sizes")
    placed = group_shards(groups, groups.count(), n_shards).select(F.col("group").alias(group), F.col("shard").alias(name))
    keyed.join(placed, group).drop(group).write.partitionBy(name).parquet(to)


def spread(sums: list[int]) -> float:
    """The largest shard over the mean, less one."""
    mean = math.fsum(sums) / max(len(sums), 1)
    return max(sums, default=0) / mean - 1 if mean else 0.0
