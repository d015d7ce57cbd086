"""Operator 5: SimHash near-duplicates by pigeonring filtering.

A fingerprint of B bits is seen as a ring of m segments. If two fingerprints differ in at most t bits, some
segment begins a chain in which, for every length l, the first l segments differ in at most floor(l * t / m) bits
together (the pigeonring principle; with t < m the first segment is equal, and the second differs in at most
one bit). So each distinct fingerprint is listed under every first segment joined with the second as it is,
and looks under the second with one of its zero bits set: each pair that passes the first two links of a
chain meets exactly once for that chain. What meets is checked link by link up to the whole ring, whose
budget is the full Hamming distance. Copies are one fingerprint throughout.

A key that holds more than HOT_ROWS rows is not compared in one task: its rows are dealt into blocks of about
that size, and every pair of blocks is a task of its own, which takes the full Hamming distance at once.
Nothing is capped; what is sent grows with the number of blocks of a key, what is compared with its square. Links
are thinned to spanning trees in every task before they are shuffled, and joined to components by Spark.

Words are runs of characters other than U+0020 and U+0009 to U+000D, A-Z in lower case. A text with fewer
words than a shingle is one shingle; a text without words (null and empty ones too) has fingerprint zero,
linked like any other. ``component_id`` is the least id reachable, null if there is none; null ids get their
component's. Repeated rows get repeated results; an empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, saved
from .components import components

HOT_ROWS, PAIRS = 20_000, 2_000_000
#: A wide fingerprint's ring: 160 segments of 16 bits; small sets (up to FEW shingles), whose bits differ more often, have two of them.
RING_WORDS, FEW = 40, 40
#: Bits of the 64 after an equal segment in which a pair may differ: at a Jaccard similarity of 0.8 some 9.7 do (standard deviation 2.9).
CHAIN_BITS = 16
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = x + _MIX[0]
    x = (x ^ x >> np.uint64(30)) * _MIX[1]
    x = (x ^ x >> np.uint64(27)) * _MIX[2]
    return x ^ x >> np.uint64(31)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included."""
    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[: len(words) - width] + 1])
    return np.fromiter([digest(joined[b:e], 42) for b, e in zip(begins.tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64, len(begins))


def fingerprint(text: str | None, width: int, words: int) -> str:
    """``words`` times 64 bits in hex; word 0 is made of the hashes themselves, later ones of mixed hashes."""
    h = shingle_hashes(text, width)
    out = []
    for k in range(words):
        own = h if k == 0 else mixed(h + np.uint64(k) * _MIX[0])
        ones = np.zeros(64, np.int64)
        for at in range(0, len(own), 65_536):
            ones += np.unpackbits(own[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        bits = np.packbits(2 * ones > len(own), bitorder="little")
        out.append(f"{int.from_bytes(bits.tobytes(), 'little'):016x}")
    return "".join(out)


def with_fingerprint(docs: DataFrame, name: str, text_col: str = "text", width: int = 3, words: int = 1) -> DataFrame:
    @F.pandas_udf("string")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width, words) for t in texts], dtype=object)

    return docs.withColumn(name, prints(F.col(text_col)))


class Ring:
    """``words`` 64-bit words cut into ``segments``, with at most ``most`` differing bits."""

    def __init__(self, words: int, segments: int, most: int):
        if 64 * words % segments or 64 % (64 * words // segments) or most >= segments:
            raise ValueError("segments must divide the words evenly and outnumber the differing bits")
        self.words, self.m, self.most, self.width = words, segments, most, 64 * words // segments

    def budget(self, links: int) -> int:
        return links * self.most // self.m

    def segment(self, w: np.ndarray, s: np.ndarray | int) -> np.ndarray:
        """Segment s (a number, or one per row) of the rows of w."""
        bit = (np.asarray(s) % self.m) * self.width
        word = w[:, bit // 64] if np.ndim(bit) == 0 else w[np.arange(len(w)), bit // 64]
        return word >> (bit % 64).astype(np.uint64) & np.uint64((1 << self.width) - 1)

    def flips(self, least: int, most: int) -> np.ndarray:
        """Masks of ``least`` to ``most`` bits of a segment."""
        return np.array([sum(1 << b for b in c) for n in range(least, most + 1) for c in combinations(range(self.width), n)], np.uint64)

    def check(self, w: np.ndarray, a: np.ndarray, b: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Which pairs of rows keep every budget of the chain that begins at segment ``table``."""
        x = w[a] ^ w[b]
        stay, spent = np.arange(len(a)), np.zeros(len(a), np.int64)
        for link in range(1, self.m + 1):
            spent = spent + np.bitwise_count(self.segment(x, table + (link - 1)))
            ok = spent <= self.budget(link)
            x, stay, spent, table = x[ok], stay[ok], spent[ok], table[ok]
            if not len(stay):
                break
        return stay


def _key(before: np.ndarray, seg: np.ndarray) -> np.ndarray:
    return mixed(before ^ mixed(seg + np.uint64(1)))


def to_words(prints: pd.Series, words: int) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(prints)), ">u8").astype(np.uint64).reshape(-1, words)


def _rows(ring: Ring, parts: list[tuple]) -> pd.DataFrame:
    """One frame of (key, table, side, spent, words) pieces."""
    key, table, side, spent, w = (np.concatenate(x) for x in zip(*parts, strict=True))
    out = {"key": key.view(np.int64), "tbl": table.astype(np.int16), "side": side.astype(np.int8), "spent": spent.astype(np.int8)}
    return pd.DataFrame(out | {f"w{k}": w[:, k].view(np.int64) for k in range(ring.words)})


def listed(ring: Ring):
    """Distinct fingerprints to the rows of the first level: both segments as they are, and with a zero bit set."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 4096):
                w = to_words(whole["fp"].iloc[at : at + 4096], ring.words)
                n, parts = len(w), []
                for i in range(ring.m):
                    start, second = _key(np.full(n, i, np.uint64), ring.segment(w, i)), ring.segment(w, i + 1)
                    parts.append((_key(start, second), np.full(n, i), np.zeros(n), np.zeros(n), w))
                    if ring.budget(2):
                        for bit in ring.flips(1, 1):
                            z = np.flatnonzero(second & bit == 0)
                            parts.append((_key(start[z], second[z] | bit), np.full(len(z), i), np.ones(len(z)), np.ones(len(z)), w[z]))
                yield _rows(ring, parts)

    return go


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component) that say the same as the links a-b over nodes 0 to n - 1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


LINKS = "a string, b string, key long, tbl short, side byte, spent byte"


def named(w: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """The links a-b between rows of w, thinned to spanning trees, with fingerprints as names."""
    used, nodes = np.unique(np.concatenate([w[a], w[b]]), axis=0, return_inverse=True)
    u, v = forest(nodes.ravel()[: len(a)], nodes.ravel()[len(a) :], len(used))
    hexes = ["".join(f"{int(x):016x}" for x in row) for row in used]
    return pd.DataFrame({"a": [hexes[i] for i in u], "b": [hexes[i] for i in v]}, dtype=object)


def between(ring: Ring):
    """One pair of blocks of a hot key (columns i, j: the blocks, own: the row's block) to its links."""

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        w = np.column_stack([pdf[f"w{k}"].to_numpy(np.int64).view(np.uint64) for k in range(ring.words)])
        own, asks = pdf["own"].to_numpy(), pdf["side"].to_numpy() == 1
        left = np.flatnonzero(own == pdf["i"].iloc[0])
        right = np.flatnonzero(own == pdf["j"].iloc[0])
        found_a, found_b = [], []
        step = max(1, PAIRS // max(len(right), 1))
        for at in range(0, len(left), step):
            some = left[at : at + step]
            far = np.zeros((len(some), len(right)), np.uint8)
            for k in range(ring.words):
                far += np.bitwise_count(w[some, k][:, None] ^ w[right, k][None, :])
            far[np.ix_(asks[some], asks[right])] = 255  # of rows that look for others, another key tells
            x, y = np.nonzero(far <= ring.most)
            a, b = some[x], right[y]
            if len(a):
                a, b = forest(a, b, len(w))
                found_a.append(a)
                found_b.append(b)
        if not found_a:
            return pd.DataFrame({"a": [], "b": []}, dtype=object)
        return named(w, np.concatenate(found_a), np.concatenate(found_b))

    return go


def met(ring: Ring, hot_rows: int):
    """Rows in order of (key, side) to links, and to the rows of hot keys (those with ``key`` set)."""
    names = [f"w{k}" for k in range(ring.words)]

    def links(pdf: pd.DataFrame) -> pd.DataFrame | None:
        key, side, table = pdf["key"].to_numpy(np.int64), pdf["side"].to_numpy(), pdf["tbl"].to_numpy(np.int64)
        w = np.column_stack([pdf[c].to_numpy(np.int64).view(np.uint64) for c in names])
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(begin, len(key)))
        listed_rows = np.add.reduceat((side == 0).astype(np.int64), begin)
        run = np.repeat(np.arange(len(begin)), size)
        # each row meets the listed rows that stand before it under its key
        partners = np.minimum(np.arange(len(key)) - begin[run], listed_rows[run])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        rows = np.flatnonzero(partners)
        upto = np.cumsum(partners[rows])
        at = 0
        while at < len(rows):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            some = rows[at:end]
            n = partners[some]
            a = np.repeat(some, n)
            b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[run[a]]
            ok = ring.check(w, a, b, table[a])
            a, b = a[ok], b[ok]
            if len(a):
                found.append((a, b))
            at = end
        if not found:
            return None
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return named(w, a, b)

    def shaped(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.reindex(columns=["a", "b", "key", "tbl", "side", "spent", *names])
        for c, kind in (("key", "Int64"), ("tbl", "Int16"), ("side", "Int8"), ("spent", "Int8"), *((n, "Int64") for n in names)):
            out[c] = out[c].astype(kind)
        return out.astype({"a": object, "b": object})

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the rows of the key that may go on
        n_held, hot = 0, None  # hot: the key that is being passed on

        for pdf in batches:
            if hot is not None:
                more = (pdf["key"] == hot).to_numpy()
                if more.any():
                    yield shaped(pdf[more])
                    pdf = pdf[~more]
                if not len(pdf):
                    continue
                hot = None
            last_key = pdf["key"].iloc[-1]
            tail = (pdf["key"] == last_key).to_numpy()
            if held and held[0]["key"].iloc[0] == last_key:  # then the whole batch is of this key
                held.append(pdf)
                n_held += len(pdf)
            else:
                ready = pd.concat([*held, pdf[~tail]], ignore_index=True)
                held, n_held = [pdf[tail]], int(tail.sum())
                yield from emitted(ready)
            if n_held > hot_rows:
                yield from (shaped(x) for x in held)
                held, n_held, hot = [], 0, last_key
        if held:
            yield from emitted(pd.concat(held, ignore_index=True))

    def emitted(ready: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(ready):
            return
        size = ready.groupby("key", sort=False)["key"].transform("size").to_numpy()
        if (size > hot_rows).any():
            yield shaped(ready[size > hot_rows])
            ready = ready[size <= hot_rows].reset_index(drop=True)
        if len(ready) and (out := links(ready)) is not None and len(out):
            yield shaped(out)

    return go


def fingerprint_links(prints: DataFrame, ring: Ring, hot_rows: int = HOT_ROWS) -> DataFrame:
    """a, b: links that join all distinct fingerprints (column fp) which differ in at most ``ring.most`` bits."""
    names = [f"w{k}" for k in range(ring.words)]
    words = ", ".join(f"{c} long" for c in names)
    rows = prints.mapInPandas(listed(ring), f"key long, tbl short, side byte, spent byte, {words}")
    found = saved(rows.repartition("key").sortWithinPartitions("key", "side").mapInPandas(met(ring, hot_rows), f"{LINKS}, {words}"), "met")
    links, hot = found.where("key is null").select("a", "b"), found.where("key is not null").select("key", "side", *names)
    if hot.isEmpty():
        return links
    blocks = hot.groupBy("key").agg(F.ceil(F.count("*") / F.lit(hot_rows)).cast("int").alias("blocks"))
    dealt = hot.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64(*names), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "side", *names, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return links.unionByName(pairs.groupBy("key", "i", "j").applyInPandas(between(ring), "a string, b string"))


def near_duplicates(docs: DataFrame, width: int = 3, words: int = 1, segments: int = 4, most: int = 3, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, fingerprint, component_id of each document.

    Texts are read once and never shuffled; the fingerprints are saved.
    """
    ring = Ring(words, segments, most)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = saved(with_fingerprint(own, "fingerprint", "text", width, words).select("doc_id", "fingerprint"), "prints")
    distinct = saved(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(fingerprint_links(distinct.select("fp"), ring, hot_rows))
    of = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # fingerprints without a link are their own component; the aggregation is combined in every task
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = of.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(classes, F.col("fingerprint") == F.col("fp")).select("doc_id", "fingerprint", "component_id")


def _added(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry of three bits, in 64 bits a word at once."""
    x = a ^ b
    return x ^ c, a & b | x & c


def wide_print(shingles: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles in RING_WORDS words, or twice as many for a small set. Bits are counted by carry-save adders, 15 shingles at once."""
    words = RING_WORDS * (2 if len(shingles) <= FEW else 1)
    steps, ones = np.arange(1, words + 1, dtype=np.uint64) * _MIX[0], np.zeros(64 * words, np.int32)
    for at in range(0, len(shingles), 255):
        some = shingles[at : at + 255]
        rows = -(-len(some) // 15)
        x = np.zeros((15 * rows, words), np.uint64)
        x[: len(some)] = mixed(some[:, None] + steps)
        x = x.reshape(15, rows, words)
        by_three = [_added(x[i], x[i + 1], x[i + 2]) for i in range(0, 15, 3)]
        (s1, t1), (s2, t2), (s3, t3), (s4, t4), (s5, t5) = by_three
        s6, t6 = _added(s1, s2, s3)
        one, t7 = _added(s6, s4, s5)
        (u1, f1), (u2, f2) = _added(t1, t2, t3), _added(t4, t5, t6)
        two, f3 = _added(u1, u2, t7)
        four, eight = _added(f1, f2, f3)
        bits = [np.unpackbits(np.ascontiguousarray(y).view(np.uint8), axis=1, bitorder="little") << k for k, y in enumerate((one, two, four, eight))]
        ones += (bits[0] + bits[1] + bits[2] + bits[3]).sum(0, dtype=np.uint8)  # 17 rows of at most 15: 255 at most
    return np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)


def segment_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Wide fingerprints (sid, print) to a row for each segment: key (ring, place and value of the segment), sid, chain (the four segments behind it)."""
    m = 4 * RING_WORDS
    for whole in batches:
        for at in range(0, len(whole), 1024):
            some = whole.iloc[at : at + 1024]
            length = some["print"].str.len().to_numpy()
            for own in np.unique(length[length > 0]):
                of = some[length == own]
                rings = own // (2 * m)
                s = np.frombuffer(b"".join(of["print"]), "<u2").reshape(len(of) * rings, m)
                sid, ring = np.repeat(of["sid"].to_numpy(np.int64), rings), np.tile(np.arange(rings), len(of))
                around = np.concatenate([s, s[:, :4]], axis=1)
                key = ((ring[:, None] * m + np.arange(m)) << 16) + s
                chain = sum(around[:, k : k + m].astype(np.uint64) << np.uint64(16 * (k - 1)) for k in range(1, 5))
                yield pd.DataFrame({"key": key.ravel().astype(np.int32), "sid": np.repeat(sid, m), "chain": chain.ravel().view(np.int64)})


def earlier_in_run(begin: np.ndarray, n: int, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """a, b: each of n rows with all that stand before it in its run (``begin``: the runs' first rows), about ``most`` pairs at once."""
    first = np.repeat(begin, np.diff(np.append(begin, n)))
    partners = np.arange(n) - first
    rows = np.flatnonzero(partners)
    upto = np.cumsum(partners[rows])
    at = 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        some = rows[at:end]
        a = np.repeat(some, partners[some])
        yield a, np.arange(len(a)) - np.repeat(np.cumsum(partners[some]) - partners[some], partners[some]) + first[a]
        at = end


def _clusters(key: np.ndarray, sid: np.ndarray, chain: np.ndarray) -> pd.DataFrame | None:
    """cluster, sid, place, n (the cluster's sets): of rows in order of their key, those that are joined under a key by chains within CHAIN_BITS. A cluster is named by its members."""
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    found_a, found_b = [], []
    for a, b in earlier_in_run(begin, len(key)):
        near = np.flatnonzero(np.bitwise_count(chain[a] ^ chain[b]) <= CHAIN_BITS)
        if len(near):
            used, ends = np.unique(np.concatenate([a[near], b[near]]), return_inverse=True)
            node, root = forest(ends[: len(near)], ends[len(near) :], len(used))
            found_a.append(used[node])
            found_b.append(used[root])
    if not found_a:
        return None
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    used, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(used))
    node, root = forest(ends[: len(a)], ends[len(a) :], len(used))
    label[node] = root
    order = np.argsort(label, kind="stable")
    head = np.flatnonzero(np.append(True, np.diff(label[order]) > 0))
    ids = sid[used[order]]
    names = np.add.reduceat(mixed(ids.view(np.uint64)), head)
    n = np.diff(np.append(head, len(ids)))
    return pd.DataFrame({"cluster": np.repeat(names, n).view(np.int64), "sid": ids, "place": (key[used[order]] >> 16).astype(np.int32), "n": np.repeat(n, n)})


def whole_groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Rows in order of ``by`` in frames that end where a group ends."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        begin = len(pdf) - int(np.logical_and.reduce([pdf[c].to_numpy() == pdf[c].iat[-1] for c in by]).sum())  # of the last group
        if not begin and held and all(held[-1][c].iat[-1] == pdf[c].iat[-1] for c in by):
            held.append(pdf)
            continue
        if held or begin:
            yield pd.concat([*held, pdf.iloc[:begin]], ignore_index=True)
        held = [pdf.iloc[begin:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def clusters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of ``segment_rows`` in order of their key to ``_clusters``; what is held is two words a row of the last key."""
    for pdf in whole_groups(batches, ["key"]):
        out = _clusters(pdf["key"].to_numpy(), pdf["sid"].to_numpy(np.int64), pdf["chain"].to_numpy(np.int64).view(np.uint64))
        if out is not None:
            yield out


def prefixes(prints: pd.Series) -> np.ndarray:
    """First segments of wide fingerprints (bytes), a row each; ``met_before`` looks at no segment beyond the shorter of two."""
    length = prints.str.len().to_numpy()
    out = np.zeros((len(prints), int(length.max(initial=0)) // 2), "<u2")
    for own in np.unique(length):
        rows = np.flatnonzero(length == own)
        out[rows, : own // 2] = np.frombuffer(b"".join(prints.iloc[rows]), "<u2").reshape(len(rows), -1)
    return out


def met_before(first: np.ndarray, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether rows a and b of ``first`` (``prefixes`` that reach four segments beyond ``place``, or to the ring's end) meet at a segment before ``place``."""
    m, before = 4 * RING_WORDS, np.zeros(len(a), bool)
    step = max(1, PAIRS // max(1, first.shape[1]))
    for at in range(0, len(a), step):
        some = slice(at, at + step)
        far = np.bitwise_count(first[a[some]] ^ first[b[some]])
        for ring in range(0, far.shape[1], m):
            own = far[:, ring : ring + m]
            around = np.concatenate([own, np.zeros((len(own), m - own.shape[1]), np.uint8), own[:, :4]], axis=1)[:, : own.shape[1] + 4]
            chain = sum(around[:, k : k + own.shape[1]] for k in range(1, 5))
            before[some] |= ((own == 0) & (chain <= CHAIN_BITS) & (ring + np.arange(own.shape[1]) < place[some, None])).any(axis=1)
    return before


def segment_clusters(prints: DataFrame) -> DataFrame:
    """key, sid: the sets (long sid, binary print: ``wide_print``) that meet, by clusters; each set of members once. ``key`` tells a cluster's key, first place and n, the sets in it.

    A pair meets if some segment is equal and the chain of the four behind it differs in at most CHAIN_BITS bits. A cluster holds all
    that such pairs join under one segment, so its rows grow with its members, not with their pairs.
    """
    rows = prints.mapInPandas(segment_rows, "key int, sid long, chain long")
    met = rows.repartition("key").sortWithinPartitions("key").mapInPandas(clusters, "cluster long, sid long, place int, n long")
    met = met.groupBy("cluster", "sid").agg(F.min("place").alias("place"), F.max("n").alias("n"))
    return met.select(F.struct(F.col("cluster").alias("key"), "place", "n").alias("key"), "sid")


def one_of_each(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, of which each component's least id is theirs; repeated rows of it stay once.

    Components are of documents whose sets of shingles have a Jaccard similarity of 0.8 or more: wide SimHashes find the pairs, whole
    sets confirm them (``near_copies``). Texts travel by one path at all sizes, so that what is shuffled grows with the table.
    """
    from .near_copies import near_copies

    found = saved(near_copies(docs, width, id_col, text_col), "classes")
    name = fresh(docs.columns, "_kept_id")
    keep = saved(found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias(name)).agg(F.count("*").alias("n")), "kept")
    same = F.col(id_col).eqNullSafe(F.col(name))
    once = docs.hint("merge").join(keep.where("n = 1").select(name), same, "left_semi")
    if keep.where("n > 1").isEmpty():
        return once
    return once.unionByName(docs.join(keep.where("n > 1").select(name), same, "left_semi").dropDuplicates([id_col]))
