"""Operator 9: benchmark decontamination by suffix arrays over the training words.

Words are the runs of characters outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. Each batch
of training documents is a shard: its suffixes are sorted by their first WINDOW words (those that hold words
of no benchmark item within the least window are left out, as nothing can match there), and every benchmark
suffix is looked up by two binary searches. The interval between them holds all places where it occurs
verbatim. A document word inside an occurrence of a window (WINDOW words of an item, or all words of a
shorter one) is hit. Neighbouring windows on one diagonal are joined into the longest verbatim matches with their places
(``longest_matches`` has all of them, ``contamination`` each document's longest); ``decontaminate`` removes the affected
documents.

The benchmark is searched in blocks of at most BLOCK_BYTES of text, each broadcast while its pass lasts, so a benchmark of
any size is checked against all documents. Of several passes only the hits of distinct affected texts are kept. Null and
empty texts have no words, are never contaminated and, as items, match nothing. An item without an id makes hits, but has no
name to be listed or counted by. Items with equal texts all count. Repeated rows get repeated results; empty tables give empty
results, or clean documents if the benchmark is empty. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, saved

WINDOW, BLOCK_BYTES = 10, 8_000_000
#: Characters of texts in one shard, and pairs of places joined into matches at once.
CHUNK, PAIRS = 4_000_000, 4_000_000
FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, longest_words long, longest_item string, longest_at long"
RAW = "n_words long, first array<long>, last array<long>, items array<string>, longest_words long, longest_item string, longest_at long"
#: Letters to lower case, other characters outside digits, letters and non-ASCII to blanks.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TABLE).split() if text else []


class _Known(dict):
    def __missing__(self, key: bytes) -> int:
        return 0


class Benchmark:
    """The distinct windows of a block of items, by length: sortable keys, and the items and places of each, as flat arrays."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        self.vocab = _Known()
        named = [(name, words) for name, text in items if (words := words_of(text))]
        named.sort(key=lambda x: (x[0] is None, x[0] or ""))
        self.names: list[str | None] = sorted({n for n, _ in named if n is not None}) + [None]
        number = {n: k for k, n in enumerate(self.names)}
        parts: dict[int, list[tuple[np.ndarray, int]]] = {}
        for name, words in named:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], ">u4")
            parts.setdefault(min(window, len(ids)), []).append((ids, number[name]))
        self.least = min(parts, default=window)
        #: (length, first keys, last keys, where each key's entries begin, items of the entries, places of the entries)
        self.windows = []
        for n, found in sorted(parts.items()):
            rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(ids, n) for ids, _ in found])
            counts = [len(ids) - n + 1 for ids, _ in found]
            item = np.repeat([k for _, k in found], counts)
            place = np.concatenate([np.arange(c) for c in counts])
            wide = np.zeros((len(rows), window), ">u4")
            wide[:, :n] = rows
            keys = np.ascontiguousarray(wide).view(f"S{4 * window}").ravel()
            order = np.lexsort((place, item, keys))
            keys, item, place = keys[order], item[order], place[order]
            begin = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
            wide = wide[order][begin[:-1]]
            wide[:, n:] = 0xFFFFFFFF
            self.windows.append((n, keys[begin[:-1]], np.ascontiguousarray(wide).view(f"S{4 * window}").ravel(), begin, item, place))

    def shard(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The suffix array of some documents: (words of each, where each begins, suffixes in order, their keys)."""
        of = self.vocab.__getitem__
        parts, counts = [], []
        for t in texts:
            words = words_of(t)
            counts.append(len(words))
            parts.append(np.fromiter(map(of, words), np.int64, len(words)))
            parts.append(np.zeros(1, np.int64))  # no match runs across documents
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        n_words = np.array(counts, np.int64)
        begins = np.cumsum(n_words + 1) - (n_words + 1)
        unknown = np.flatnonzero(flat == 0)
        at = np.flatnonzero(flat)
        run = unknown[np.searchsorted(unknown, at)] - at if len(at) else at  # known words from here on
        at = at[run >= self.least]
        padded = np.append(flat, np.zeros(self.window, np.int64)).astype(">u4")
        rows = padded[at[:, None] + np.arange(self.window)]
        # what stands behind an unknown word is of no account
        rows[np.cumsum(rows == 0, axis=1) > 0] = 0
        keys = np.ascontiguousarray(rows).view(f"S{4 * self.window}").ravel() if len(at) else np.zeros(0, f"S{4 * self.window}")
        order = np.argsort(keys, kind="stable")
        return n_words, begins, at[order], keys[order]

    def search(self, suffixes: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each window that occurs: its length, its items and their places, and where it occurs."""
        for n, first, last, begin, item, place in self.windows:
            lo, hi = np.searchsorted(keys, first, "left"), np.searchsorted(keys, last, "right")
            for k in np.flatnonzero(hi > lo).tolist():
                yield n, item[begin[k] : begin[k + 1]], place[begin[k] : begin[k + 1]], suffixes[lo[k] : hi[k]]

    def hits(self, texts: list[str | None]) -> list[tuple]:
        """Rows of RAW, one for each document: the hit words as runs, the items, and the longest match."""
        n_words, begins, suffixes, keys = self.shard(texts)
        edge = np.zeros(int((n_words + 1).sum()) + 1, np.int64)
        found: dict[int, set[int]] = {}
        occurring = list(self.search(suffixes, keys))
        for n, item, _, at in occurring:
            np.add.at(edge, at, 1)
            np.add.at(edge, at + n, -1)
            items = np.unique(item).tolist()
            for d in np.unique(np.searchsorted(begins, at, "right") - 1).tolist():
                found.setdefault(d, set()).update(items)
        longest: dict[int, tuple] = {}
        for d, item, _, at, n in self._matches(occurring, begins):
            if n > longest.get(d, (0,))[0]:
                longest[d] = (n, item, at)
        out: list[tuple] = [(int(n), [], [], [], 0, None, None) for n in n_words]
        for d, items in found.items():
            inside = np.cumsum(edge[begins[d] : begins[d] + n_words[d] + 1]) > 0
            turn = np.diff(np.concatenate([[0], inside.astype(np.int8)]))
            named = [self.names[k] for k in sorted(items) if self.names[k] is not None]
            out[d] = (int(n_words[d]), np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), named, *longest[d])
        return out

    def longest(self, texts: list[str | None]) -> list[tuple[int, str | None, int, int, int]]:
        """(document number, item, first word in the item, first word in the document, words) of each longest match."""
        _, begins, suffixes, keys = self.shard(texts)
        return list(self._matches(list(self.search(suffixes, keys)), begins))

    def _matches(self, occurring: list[tuple], begins: np.ndarray) -> Iterator[tuple[int, str | None, int, int, int]]:
        """Windows at neighbouring places of one item and one document, joined. Ordered by document, then by place in it and by item."""
        if not occurring:
            return
        doc = np.concatenate([np.searchsorted(begins, at, "right") - 1 for *_, at in occurring])
        at = np.concatenate([at for *_, at in occurring])
        of = np.repeat(np.arange(len(occurring)), [len(x[3]) for x in occurring])
        order = np.argsort(doc, kind="stable")
        doc, at, of = doc[order], at[order], of[order]
        entries = np.array([len(x[1]) for x in occurring])
        first, length = np.cumsum(entries) - entries, np.array([x[0] for x in occurring])
        items, places = np.concatenate([x[1] for x in occurring]), np.concatenate([x[2] for x in occurring])
        head = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc))
        upto = np.append(0, np.cumsum(entries[of]))
        lo = 0
        while lo < len(head) - 1:  # whole documents, about PAIRS pairs at once
            hi = max(lo + 1, int(np.searchsorted(upto[head], upto[head[lo]] + PAIRS, "right")) - 1)
            own = slice(head[lo], head[hi])
            n = entries[of[own]]
            pair = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[of[own]], n)
            p, d, size = np.repeat(at[own], n), np.repeat(doc[own], n), np.repeat(length[of[own]], n)
            item, place = items[pair], places[pair]
            turn = np.lexsort((place, p - place, item, d))
            p, d, size, item, place = p[turn], d[turn], size[turn], item[turn], place[turn]
            new = np.append(True, (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (p[1:] - place[1:] != p[:-1] - place[:-1]) | (place[1:] != place[:-1] + 1))
            start = np.flatnonzero(new)
            end = np.append(start[1:], len(new)) - 1
            words = place[end] + size[end] - place[start]
            rows = sorted(zip(d[start].tolist(), (p[start] - begins[d[start]]).tolist(), item[start].tolist(), place[start].tolist(), words.tolist(), strict=True))
            yield from ((a, self.names[i], w, b, m) for a, b, i, w, m in rows)
            lo = hi


def benchmark_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> Iterator[tuple[int, Broadcast]]:
    """(number of blocks, block): the benchmark in blocks that are small enough to broadcast, made one after the other."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-size // BLOCK_BYTES))
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield n, benchmark.sparkSession.sparkContext.broadcast(Benchmark([tuple(r) for r in block.collect()], window))


def digest(row: tuple) -> tuple:
    """A row of RAW to one of FOUND."""
    n_words, first, last, items, *longest = row
    return n_words, sum(last) - sum(first), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), *longest


def _column(text: Column, block: Broadcast, raw: bool) -> Column:
    kind = RAW if raw else FOUND
    names = [x.split()[0] for x in kind.split(", ")]

    @F.pandas_udf(kind)
    def hits(texts: pd.Series) -> pd.DataFrame:
        rows, part, chars = [], [], 0
        for k, t in enumerate(texts):
            part.append(t)
            chars += len(t or "")
            if chars > CHUNK or k == len(texts) - 1:
                rows += block.value.hits(part)
                part, chars = [], 0
        out = pd.DataFrame(rows if raw else [digest(r) for r in rows], columns=names)
        return out.astype({"longest_at": "Int64", "longest_item": object})

    return hits.asNondeterministic()(text)  # so marked, it runs once for filter and columns


def _united(runs: Column) -> Column:
    """Rows of RAW of one text, from several blocks, to one row of FOUND."""

    @F.pandas_udf(FOUND)
    def union(runs: pd.Series) -> pd.DataFrame:
        rows = []
        for found in runs:
            items = sorted({str(i) for b in found for i in b["items"]})
            first, last = [], []
            for a, z in sorted((int(a), int(z)) for b in found for a, z in zip(b["first"], b["last"], strict=True)):
                if last and a <= last[-1]:
                    last[-1] = max(last[-1], z)
                else:
                    first.append(a)
                    last.append(z)
            best = min(found, key=lambda b: (-b["longest_words"], b["longest_at"], b["longest_item"] is None, b["longest_item"] or ""))
            rows.append(digest((int(found[0]["n_words"]), first, last, items, best["longest_words"], best["longest_item"], best["longest_at"])))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in FOUND.split(", ")])

    return union(runs)


def with_hits(docs: DataFrame, benchmark: DataFrame, name: str, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with a column ``name``, a struct as FOUND has it. A narrow map over the documents if the benchmark is one block."""
    t, parts = F.col(f"`{text_col}`"), None
    for n, block in benchmark_blocks(benchmark, item_col, item_text, window):
        if n == 1:
            return docs.withColumn(name, _column(t, block, raw=False))
        own = docs.select(t.alias("text"), _column(t, block, raw=True).alias("raw")).where("size(raw.first) > 0")
        part = saved(own.select(F.sha2("text", 256).alias("key"), "raw").dropDuplicates(["key"]), "hits")
        parts = part if parts is None else parts.unionByName(part)
        block.destroy()
    hit = parts.groupBy("key").agg(F.collect_list("raw").alias("runs")).select("key", _united(F.col("runs")).alias("found"))
    key, found = fresh([*docs.columns, name], "_hit_key"), fresh([*docs.columns, name], "_hit_found")

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(words_of(x)) for x in texts], dtype="int64")

    none = F.struct(
        count(t).alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit(hashlib.sha256(b"").hexdigest()).alias("items_sha256"),
        F.lit(0).cast("long").alias("longest_words"), F.lit(None).cast("string").alias("longest_item"), F.lit(None).cast("long").alias("longest_at"),
    )
    joined = docs.join(hit.select(F.col("key").alias(key), F.col("found").alias(found)), F.sha2(t, 256) == F.col(key), "left")
    return joined.withColumn(name, F.coalesce(F.col(found), none)).drop(key, found)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the longest match: its words, item and first word."""
    found = with_hits(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, "_h", window=window)
    return found.select("doc_id", "_h.n_words", "_h.n_hit", "_h.n_items", "_h.items_sha256", (F.col("_h.n_hit") > 0).alias("contaminated"), "_h.longest_words", "_h.longest_item", "_h.longest_at")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without a hit word, with all their columns."""
    name = fresh(docs.columns, "_hits")
    return with_hits(docs, benchmark, name, text_col, window=window).where(F.col(f"{name}.n_hit") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def _longest_column(text: Column, block: Broadcast) -> Column:
    @F.pandas_udf("array<struct<item_id: string, item_word: long, doc_word: long, n_words: long>>")
    def longest(texts: pd.Series) -> pd.Series:
        rows: list[list] = [[] for _ in texts]
        for d, item, a, b, n in block.value.longest(list(texts)):
            rows[d].append({"item_id": item, "item_word": a, "doc_word": b, "n_words": n})
        return pd.Series(rows, dtype=object)

    return longest(text)


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, item_word, doc_word, n_words of every longest verbatim match of at least a window."""
    out = None
    for n, block in benchmark_blocks(benchmark, window=window):
        part = docs.select(F.col(id_col).alias("doc_id"), F.explode(_longest_column(F.col(text_col), block)).alias("_m")).select("doc_id", "_m.*")
        if n > 1:
            part = saved(part, "matches")
            block.destroy()
        out = part if out is None else out.unionByName(part)
    return out
