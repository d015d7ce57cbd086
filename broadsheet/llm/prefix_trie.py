"""Operator 13: the prefix trie of conversations, by distributed radix partitioning from the first turn on.

Turns are dictionary-encoded: each distinct (role, text) gets an integer id, and a conversation is the array of its turns'
ids; texts are hashed where they are read and never shuffled. Equal conversations are one sequence with its
number of copies. All sequences begin as one bucket. A bucket of more than LOCAL sequences advances by the turns that all
of them share and is dealt into one bucket for each id that follows; the counts are combined before they are shuffled, and
the sequences stay where adaptive execution may split a large bucket. Buckets of at most LOCAL sequences leave the recursion:
tasks take many of them, and a multikey quicksort (three parts by one turn id, the equal part one turn deeper) emits
their nodes. At last the large buckets, the few nodes above, are summed from the last round up. A round reads only
buckets that are still large, and a prefix that many share costs one round, however long it is.

A node is named by (conv_id, depth), conv_id being its smallest member. Conversations that end at a node with d turns are the
copies of one sequence, so their ids are hashed by sequence, sorted, in one stream; memory is bounded, though the ids of one sequence,
8 bytes each, pass through one task, as SHA-256 of a list has to. A conversation's turn ids (8 bytes each) stand in one row.

Null role and text are empty. Rows of a conversation with the same turn (repeated rows too) all count and are ordered by
the SHA-256 of role and text; null turns come first. Rows without conv_id belong to no conversation and are left out. An
empty table has no node, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved

#: Sequences of a bucket that one task finishes, and turns by which a large bucket may advance in a round.
LOCAL, AHEAD = 200, 64
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends long, top boolean"


def turn_digest() -> Column:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text).cast("binary"), 256))


def encoded(turns: DataFrame) -> DataFrame:
    """conv_id, ids, sizes of each conversation: its turns' ids in the dictionary and their code points, in order."""
    own = turns.where("conv_id is not null").select("conv_id", "turn", turn_digest().alias("digest"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"))
    own = saved(own, "turns")
    # saved, as the ids are given by where a row happens to stand
    words = saved(own.select("digest").distinct().withColumn("id", F.monotonically_increasing_id()), "dictionary")
    rows = own.join(words, "digest").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "id", "size"))).alias("turns"))
    return rows.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.size").alias("sizes"))


def rebuilt(conversations: DataFrame, every: int = 100, turns: int = 6) -> DataFrame:
    """conv_id, ids, sizes, where the first h turns come from conversation conv_id - conv_id % every; h = crc32(conv_id) % turns."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % turns).cast("int")
    base = conversations.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), *(F.slice(c, 1, turns).alias(f"base_{c}") for c in ("ids", "sizes")))
    both = conversations.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(base, "base", "left").withColumn("h", h)
    first = lambda c: F.coalesce(F.slice(f"base_{c}", F.lit(1), F.col("h")), F.array().cast("array<long>"))
    rest = lambda c: F.slice(c, F.col("h") + 1, F.greatest(F.size(c), F.lit(1)))
    return both.select("conv_id", *(F.concat(first(c), rest(c)).alias(c) for c in ("ids", "sizes")))


def sequences(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct sequences (conv_id: the smallest; ids, sizes, n) and the hash of the conv_ids of each (ends, ends_sha256)."""
    named = convs.withColumn("key", F.unhex(F.sha2(F.array_join("ids", ",").cast("binary"), 256)))
    named = saved(named, "rebuilt")
    few = saved(named.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")), "keys")
    one = named.join(few.select("conv_id", "n"), "conv_id").select("conv_id", "ids", "sizes", "n")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, first, digest = None, None, None
        for rows in batches:
            ids, keys = rows["conv_id"].to_numpy(), rows["key"].to_numpy()
            cut = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
            done = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                listed = ",".join(map(str, ids[a:b].tolist())).encode()
                if keys[a] == key:
                    digest.update(b"," + listed)
                    continue
                if key is not None:
                    done.append((first, digest.hexdigest()))
                key, first, digest = keys[a], ids[a], hashlib.sha256(listed)
            yield pd.DataFrame(done, columns=["ends", "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(first, digest.hexdigest())], columns=["ends", "ends_sha256"])

    # a sequence of one conversation needs no neighbours
    alone = few.where("n = 1").select(F.col("conv_id").alias("ends"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256).alias("ends_sha256"))
    several = named.join(few.where("n > 1").select("key"), "key", "left_semi").select("key", "conv_id")
    listed = several.repartition("key").sortWithinPartitions("key", "conv_id").mapInPandas(hashed, "ends long, ends_sha256 string")
    return one, alone.unionByName(listed)


def sorted_nodes(ids: list, sizes: list, convs: list, copies: list, depth: int, parent: int | None) -> list[list]:
    """The nodes (as NODE) of sequences that share their first ``depth`` turns, by multikey quicksort; the first node is that prefix."""
    nodes: list[list] = []
    above: list[int] = []

    def emit(members: list[int], at: int, up: int) -> int:
        ended = [i for i in members if len(ids[i]) == at]
        node = [min(convs[i] for i in members), at, parent if up < 0 else nodes[up][0], sum(copies[i] for i in members), 0, 0, 0, convs[ended[0]] if ended else None, up < 0]
        node[6] = (node[3] - 1) * (sizes[members[0]][at - 1] if at else 0)
        nodes.append(node)
        above.append(up)
        return len(nodes) - 1

    todo = [(list(range(len(ids))), depth, emit(list(range(len(ids))), depth, -1))]
    while todo:
        members, at, up = todo.pop()
        members = [i for i in members if len(ids[i]) > at]
        if not members:
            continue
        pivot = ids[members[len(members) // 2]][at]
        less, equal, more = [], [], []
        for i in members:
            turn = ids[i][at]
            (equal if turn == pivot else less if turn < pivot else more).append(i)
        todo += [(part, at, up) for part in (less, more) if part]
        todo.append((equal, at + 1, emit(equal, at + 1, up)))
    for k in range(len(nodes) - 1, -1, -1):  # what lies below a node stands after it
        nodes[k][5] = nodes[k][5] or 1
        if above[k] >= 0:
            up = nodes[above[k]]
            up[4], up[5], up[6] = up[4] + 1, up[5] + nodes[k][5], up[6] + nodes[k][6]
    return nodes


def local_nodes(rows: DataFrame) -> DataFrame:
    """The nodes of all small buckets; tasks take many buckets."""

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in NODE.split(", ")]

        def nodes_of(own: pd.DataFrame) -> pd.DataFrame:
            parent = own["parent"].iloc[0]
            as_lists = [[x.tolist() for x in own[c]] for c in ("ids", "sizes")]
            made = sorted_nodes(*as_lists, own["conv_id"].tolist(), own["n"].tolist(), int(own["at"].iloc[0]), None if pd.isna(parent) else int(parent))
            return pd.DataFrame({c: pd.array([x[k] for x in made], "boolean" if c == "top" else "Int64") for k, c in enumerate(names)})

        held: list[pd.DataFrame] = []
        for batch in batches:
            for _, own in batch.groupby(["bucket", "at"], sort=False):
                if held and (held[0]["bucket"].iloc[0], held[0]["at"].iloc[0]) != (own["bucket"].iloc[0], own["at"].iloc[0]):
                    yield nodes_of(pd.concat(held))
                    held = []
                held.append(own)
        if held:
            yield nodes_of(pd.concat(held))

    return rows.select("bucket", "at", "parent", "conv_id", "ids", "sizes", "n").repartition("bucket", "at").sortWithinPartitions("bucket", "at").mapInPandas(finish, NODE)


def shared_prefix(low: str, high: str) -> Column:
    """How many elements two arrays have in common from the first on."""
    same = F.zip_with(low, high, lambda x, y: x.eqNullSafe(y))
    return F.when(F.forall(same, lambda x: x), F.least(F.size(low), F.size(high))).otherwise(F.array_position(same, F.lit(False)) - 1).cast("int")


def dealt(large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: the large buckets, each advanced by what its sequences share, and their sequences in the buckets below.

    ``large``: bucket, at (turns all sequences of a bucket are known to share), parent, conv_id, ids, sizes, n.
    """
    ahead = F.expr(f"slice(ids, at + 1, {AHEAD})")
    stems = large.groupBy("bucket", "at", "parent").agg(
        F.min(ahead).alias("low"), F.max(ahead).alias("high"), F.sum("n").alias("n_convs"), F.min(F.struct("conv_id", F.expr(f"slice(sizes, greatest(at, 1), {AHEAD + 1})").alias("sizes"))).alias("one")
    )
    stems = stems.withColumn("to", F.col("at") + shared_prefix("low", "high")).withColumn("sizes", F.col("one.sizes")).drop("low", "high", "one")
    stems = saved(stems, "stems")
    rows = large.join(stems.select("bucket", "at", "to"), ["bucket", "at"]).withColumn("turn", F.expr("try_element_at(ids, to + 1)"))
    below = rows.where("turn is not null")
    parts = below.groupBy("bucket", "to", "turn").agg(F.min("conv_id").alias("child"), F.count("*").alias("rows"))
    out = below.join(parts, ["bucket", "to", "turn"])
    out = out.select(F.col("child").alias("bucket"), (F.col("to") + 1).alias("at"), F.col("bucket").alias("parent"), "conv_id", "ids", "sizes", "n", "rows")
    ended = rows.where("turn is null").select("bucket", "at", F.col("conv_id").alias("ends"))
    whole = saved(stems.join(ended, ["bucket", "at"], "left"), "stems")
    out = saved(out, "buckets")
    dropped(stems)
    return whole, out


def chain(stems: DataFrame, below: DataFrame) -> DataFrame:
    """The nodes (as NODE) of a round's stems, each from depth ``at`` to ``to``; ``below``: the nodes right under them."""
    sums = below.groupBy(F.col("parent_conv_id").alias("bucket"), (F.col("depth") - 1).alias("to")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
    rows = stems.join(sums, ["bucket", "to"], "left").withColumn("depth", F.explode(F.sequence("at", "to")))
    # sizes begins with turn max(at, 1): the last turn of a node of depth d is its element d - max(at, 1) + 1
    own = F.expr("if(to < 1, 0L, aggregate(slice(sizes, greatest(depth, 1) - greatest(at, 1) + 1, to - greatest(depth, 1) + 1), 0L, (s, x) -> s + x))")
    ends = F.when(F.col("depth") == F.col("to"), F.col("ends"))
    return rows.select(
        F.col("bucket").alias("conv_id"), F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") == F.col("at"), F.col("parent")).otherwise(F.when(F.col("depth") > 0, F.col("bucket"))).alias("parent_conv_id"),
        "n_convs", F.when(F.col("depth") == F.col("to"), F.coalesce("n_children", F.lit(0))).otherwise(1).cast("long").alias("n_children"),
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), (F.coalesce("below", F.lit(0)) + (F.col("n_convs") - 1) * own).cast("long").alias("saved_tokens"), ends.alias("ends"), (F.col("depth") == F.col("at")).alias("top"),
    )


def trie(sequences: DataFrame) -> DataFrame:
    """The nodes (as NODE) of all prefixes of ``sequences`` (conv_id, ids, sizes, n); ``ends`` names the sequence that ends at a node."""
    rows = saved(sequences, "sequences")
    least, count = rows.agg(F.min("conv_id"), F.count("*")).first()
    start = rows.select(F.lit(least).cast("long").alias("bucket"), F.lit(0).alias("at"), F.lit(None).cast("long").alias("parent"), "conv_id", "ids", "sizes", "n", F.lit(count).alias("rows"))
    rounds, below, held = [], start, rows
    while True:
        small = saved(local_nodes(below.where(F.col("rows") <= LOCAL)), "nodes")
        large = below.where(F.col("rows") > LOCAL)
        if large.isEmpty():
            break
        stems, new = dealt(large.drop("rows"))
        rounds.append((small, stems))
        dropped(held)
        below = held = new
    dropped(held)
    nodes, under = small, small
    for small, stems in reversed(rounds):
        upper = saved(chain(stems, under.where("top")), "nodes")
        dropped(stems)
        nodes, under = nodes.unionByName(upper).unionByName(small), upper.unionByName(small)
    return nodes.drop("top")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node of the rebuilt conversations."""
    one, ends = sequences(rebuilt(saved(encoded(conversations), "encoded")))
    nodes = trie(one).join(ends, "ends", "left")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


#: The whole result in DuckDB's SQL: {every} and {turns} as in ``rebuilt``.
SQL = """
with t as (
    select conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) as key, coalesce(length(text), 0) as size
    from conversations where conv_id is not null
), own as (
    select conv_id, list({{'key': key, 'size': size}} order by turn nulls first, key) as turns from t group by conv_id
), dealt as (
    select *, conv_id - conv_id % {every} as base,
        xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i, 1))::bigint)),
            lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda r, k: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295) % {turns} as h
    from own
), built as (
    select d.conv_id, list_concat(coalesce(b.turns, [])[1 : d.h], d.turns[d.h + 1 : len(d.turns)]) as turns from dealt d left join own b on b.conv_id = d.base
), prefixes as (
    select conv_id, len(turns) as whole, d, list_transform(turns[1 : d], lambda x: x.key) as p, case when d = 0 then 0 else turns[d].size end as size
    from (select *, unnest(range(0, len(turns) + 1)) as d from built)
), nodes as (
    select p, d, min(conv_id) as conv_id, count(*) as n_convs, any_value(size) as size,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (whole = d), '')) as ends_sha256
    from prefixes group by p, d
), children as (
    select p[1 : d - 1] as p, count(*) as n_children from nodes where d > 0 group by 1
), told as (
    select n.*, coalesce(c.n_children, 0) as n_children from nodes n left join children c on c.p = n.p
), sums as (
    select up as p, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum((n_convs - 1) * size) as saved_tokens
    from (select p[1 : k] as up, n_children, n_convs, size from (select *, unnest(range(0, d + 1)) as k from told)) group by 1
)
select n.conv_id, n.d::bigint as depth, u.conv_id as parent_conv_id, n.n_convs, n.n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, n.ends_sha256
from told n join sums s on s.p = n.p left join told u on n.d > 0 and u.p = n.p[1 : n.d - 1]
"""
