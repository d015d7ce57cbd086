"""Operator 8: removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every byte covered by a string of LENGTH bytes that also starts anywhere else in the corpus goes.

1. Anchors. Of the K-byte strings inside a string of LENGTH bytes the one of least hash (the first of equals) is
   its anchor; equal strings have equal anchors at equal places. The strings of one document that share an
   anchor lie side by side and make up a context. So a string can only recur in contexts of its anchor's hash,
   and each place belongs to exactly one context.
2. Anchors that occur once drop out (a count, combined in every task before it is shuffled). Contexts that occur twice
   or more as they stand are repeated throughout. What is left to compare are the different contexts of one anchor.
3. Contexts of many anchors are packed into blocks; those that share too few bytes around their anchor with any other to
   hold a repeat are left out. For a block the Burrows-Wheeler transform is made, and breadth-first
   backward extension of intervals, one byte a level, sets each boundary between neighbouring suffixes to the level at
   which it first appears: common prefixes come out by increasing length. The search stops at LENGTH; boundaries
   that are still unset then part suffixes with a common prefix of LENGTH bytes or more, which are the repeats.
   An anchor with more than HOT_BYTES of different contexts is not put into one block: its strings are counted by
   128-bit hash in a Spark aggregation instead. Nothing is capped.
4. Spans are joined to the documents by the hash of their text.

Null and empty texts have no bytes. Copies count as other places, so a text of at least LENGTH bytes that occurs twice
goes altogether. Repeated rows count as copies; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, saved
from .simhash import mixed

LENGTH, K = 200, 32
#: Bytes of contexts in a block, bytes of different contexts of one anchor that a block takes, bytes of a text looked at at once.
BLOCK_BYTES, HOT_BYTES, CHUNK = 2_000_000, 4_000_000, 1 << 16
#: Ranges into which the anchor's places within a string are cut, before strings are compared.
RANGES = 8
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        x = np.full(n, _BASE if kind == "up" else _INVERSE, np.uint64)
        x[0] = 1
        _powers[kind] = np.cumprod(x)
    return _powers[kind][:n]


def prefix_sums(b: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * BASE^i modulo 2^64 up to each place."""
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power("up", len(b)), out=out[1:])
    return out


def hashes(p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of the bytes lo to hi, wherever they stand."""
    return mixed((p[hi] - p[lo]) * _power("down", len(p))[lo] + (hi - lo).astype(np.uint64))


def contexts(b: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, context hash, first byte, bytes and anchor's place of every context of texts that stand in a row.

    ``ends`` are the texts' ends in ``b``; each has ``length`` bytes or more.
    """
    n, w = len(b) - length + 1, length - k + 1
    p = prefix_sums(b)
    at = np.arange(len(b) - k + 1)
    h = hashes(p, at, at + k)
    # hash above, place below: the least is the first of the least hash
    v = h >> np.uint64(20) << np.uint64(20) | at.astype(np.uint64)
    step = 1
    while step * 2 <= w:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    v = np.minimum(v[:n], v[w - step : w - step + n]) if step < w else v[:n]
    anchor = (v & np.uint64((1 << 20) - 1)).astype(np.int64)
    inside = np.ones(n, bool)  # strings that lie in one text
    for end in ends[:-1].tolist():
        inside[end - length + 1 : end] = False
    starts = np.flatnonzero(inside)
    anchor = anchor[starts]
    head = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    first, last, anchor = starts[head], starts[np.append(head[1:], len(starts)) - 1], anchor[head]
    return h[anchor], hashes(p, first, last + length), first, last + length - first, anchor - first


def context_table(docs: DataFrame, length: int = LENGTH, k: int = K, text_col: str = "text") -> DataFrame:
    """a, c (hashes of anchor and context), th, nb (hash and bytes of the text), lo, len, p (the anchor's place) of every context."""

    def rows_of(group: list[tuple[bytes, int, int, int]]) -> pd.DataFrame:
        raw, th, nb, at = zip(*group, strict=True)
        ends = np.cumsum([len(r) for r in raw])
        a, c, first, size, p = contexts(np.frombuffer(b"".join(raw), np.uint8), ends, length, k)
        of = np.searchsorted(ends, first, "right")
        lo = first - np.append(0, ends)[of] + np.array(at)[of]
        return pd.DataFrame({"a": a.view(np.int64), "c": c.view(np.int64), "th": np.array(th)[of], "nb": np.array(nb)[of], "lo": lo, "len": size.astype(np.int32), "p": p.astype(np.int32)})

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            group, held = [], 0  # short texts are taken together, long ones in pieces
            for th, text in zip(pdf["th"], pdf["text"], strict=True):
                raw = text.encode()
                for at in range(0, len(raw) - length + 1, CHUNK):
                    group.append((raw[at : at + CHUNK + length - 1], th, len(raw), at))
                    held += len(group[-1][0])
                    if held >= CHUNK:
                        yield rows_of(group)
                        group, held = [], 0
            if group:
                yield rows_of(group)

    t = F.col(text_col)
    return docs.where(F.octet_length(t) >= length).select(F.xxhash64(t).alias("th"), t.alias("text")).mapInPandas(go, "a long, c long, th long, nb long, lo long, len int, p int")


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols or more, up to the next 0; ties in any order."""
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1  # symbols up to and with the next 0
    key = np.zeros(n, np.int64)
    for j in range(7):
        part = np.zeros(n, np.int64)
        part[: max(n - j, 0)] = symbols[j:]
        part[left <= j] = 0
        key = key << 9 | part
    h = 7
    order = np.argsort(key)
    while True:
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(1, key[order[1:]] != key[order[:-1]]))
        if h >= min(depth, n) or rank[order[-1]] == n:
            return order
        behind = np.zeros(n, np.int64)
        behind[: n - h] = rank[h:]
        behind[left <= h] = 0
        key = rank * (n + 1) + behind
        order = np.argsort(key)
        h *= 2


def repeated_suffixes(symbols: np.ndarray, length: int) -> np.ndarray:
    """Places where a string of ``length`` symbols starts that starts elsewhere too. 0 ends each of the strings in a row, and is in no match."""
    n = len(symbols)
    order = suffix_order(symbols, length)
    bwt = symbols[order - 1]  # the symbol before the first is the last, an end
    by_symbol = np.argsort(bwt.astype(np.uint16), kind="stable")
    lf = np.empty(n, np.int64)
    lf[by_symbol] = np.arange(n)
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    # level 1: an interval for each end on its own (they are all different), and one for each byte
    n_ends = int((symbols == 0).sum())
    begins = np.concatenate([np.arange(n_ends), np.searchsorted(symbols[order], np.unique(symbols[symbols > 0]))])
    lo, hi = begins, np.append(begins[1:], n)
    for _ in range(1, length + 1):
        new = unset[hi]
        lo, hi = lo[new], hi[new]
        unset[hi] = False
        if not len(lo):
            break
        # extend each interval by every symbol before one of its suffixes
        size = hi - lo
        q = np.repeat(np.arange(len(lo)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[q]
        c = bwt[at]
        inner = c > 0
        q, at, c = q[inner], at[inner], c[inner]
        if not len(q):
            break
        to = lf[at]
        turn = np.argsort(q * n + to)
        q, to, c = q[turn], to[turn], c[turn]
        head = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (c[1:] != c[:-1])))
        lo, hi = to[head], to[np.append(head[1:], len(to)) - 1] + 1
    same = unset[:n] | unset[1:]
    return np.sort(order[same])


def _spans(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of bytes that strings at ``starts`` (in order) cover."""
    head = np.flatnonzero(np.append(True, starts[1:] > starts[:-1] + length))
    return starts[head], starts[np.append(head[1:], len(starts)) - 1] + length


def may_recur(b: np.ndarray, begin: np.ndarray, size: np.ndarray, place: np.ndarray, length: int, k: int) -> np.ndarray:
    """Which contexts (at ``begin`` in b) can hold a string that another of them holds.

    The anchor's places in a string are cut into ranges. Of two equal strings with the anchor in a range, the bytes
    from the range's least place before the anchor to its greatest place before the string's end are equal
    too; a context whose bytes for every range stand in no other context is out.
    """
    p, keep = prefix_sums(b), np.zeros(len(begin), bool)
    cuts = np.unique(np.linspace(0, length - k, RANGES + 1).astype(np.int64))
    for least, most in zip(cuts[:-1], cuts[1:], strict=True):
        own = np.flatnonzero((place >= least) & (place + length - most <= size))
        at = begin[own] + place[own]
        _, which, n = np.unique(hashes(p, at - least, at + length - most), return_inverse=True, return_counts=True)
        keep[own] |= n[which] > 1
    return keep


def _compare(length: int, k: int, block_bytes: int, hot_bytes: int):
    """Contexts in order of their anchor to spans (lo, hi in the text), or to the strings of hot anchors (``s1``, ``s2`` set)."""

    def compared(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(parts, ignore_index=True)
        size = pdf["len"].to_numpy(np.int64)
        keep = may_recur(np.frombuffer(b"".join(pdf["bytes"]), np.uint8), np.cumsum(size) - size, size, pdf["p"].to_numpy(np.int64), length, k)
        if not keep.any():
            return
        pdf = pdf[keep].reset_index(drop=True)
        raw = b"".join(b + b"\0" for b in pdf["bytes"])
        size = np.array([len(b) + 1 for b in pdf["bytes"]], np.int64)
        ends = np.cumsum(size)
        symbols = np.frombuffer(raw, np.uint8).astype(np.int64) + 1
        symbols[ends - 1] = 0
        starts = repeated_suffixes(symbols, length)
        if not len(starts):
            return
        row = np.searchsorted(ends, starts, "right")
        lo, hi = _spans(starts, length)  # no span runs across an end: a string stands between
        of = row[np.searchsorted(starts, lo)]
        begin = ends[of] - size[of]
        once = pdf["m"].to_numpy()[of] == 1  # the others are repeated throughout anyway
        yield _out(pdf.iloc[of[once]], pdf["lo"].to_numpy()[of[once]] + (lo - begin)[once], pdf["lo"].to_numpy()[of[once]] + (hi - begin)[once])

    def strings(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Every string of the contexts of a hot anchor, by two hashes."""
        for k in range(len(pdf)):
            b = np.frombuffer(pdf["bytes"].iloc[k], np.uint8)
            at = np.arange(len(b) - length + 1)
            s1 = hashes(prefix_sums(b), at, at + length)
            s2 = hashes(prefix_sums(b ^ np.uint8(0x5A)), at, at + length)
            out = _out(pdf.iloc[[k] * len(at)], pdf["lo"].iloc[k] + at, pdf["lo"].iloc[k] + at + length)
            out["s1"], out["s2"] = pd.array(s1.view(np.int64), "Int64"), pd.array(s2.view(np.int64), "Int64")
            yield out

    def _out(rows: pd.DataFrame, lo, hi) -> pd.DataFrame:
        out = pd.DataFrame({"a": rows["a"].to_numpy(), "th": rows["th"].to_numpy(), "nb": rows["nb"].to_numpy(), "m": rows["m"].to_numpy(), "lo": lo, "hi": hi})
        out["s1"], out["s2"] = pd.array([None] * len(out), "Int64"), pd.array([None] * len(out), "Int64")
        return out

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block: list[pd.DataFrame] = []  # whole groups
        block_size = 0
        group: list[pd.DataFrame] = []  # the anchor that may go on
        group_size, hot = 0, None
        for pdf in batches:
            keys = pdf["a"].to_numpy()
            cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)], strict=True):
                part = pdf.iloc[lo:hi]
                if hot is not None and keys[lo] == hot:
                    yield from strings(part)
                    continue
                hot = None
                if group and group[0]["a"].iloc[0] != keys[lo]:
                    block += group
                    block_size += group_size
                    group, group_size = [], 0
                    if block_size >= block_bytes:
                        yield from compared(block)
                        block, block_size = [], 0
                group.append(part)
                group_size += int(part["len"].sum())
                if group_size > hot_bytes:
                    hot = keys[lo]
                    for x in group:
                        yield from strings(x)
                    group, group_size = [], 0
        if block or group:
            yield from compared(block + group)

    return go


def cut_contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts with arrays of what is asked of them (a, m, lo, len, p) to a row a context with its bytes; a frame holds the contexts of many texts."""
    for pdf in batches:
        at, held, raws = 0, 0, []
        for k, (text, lo, size) in enumerate(zip(pdf["text"], pdf["lo"], pdf["len"], strict=True)):
            raw = text.encode()
            raws += [raw[b : b + n] for b, n in zip(lo.tolist(), size.tolist(), strict=True)]
            held += int(size.sum())
            if held >= BLOCK_BYTES or k + 1 == len(pdf):
                some = pdf.iloc[at : k + 1]
                times = some["lo"].str.len().to_numpy(np.int64)
                out = {"a": np.concatenate(some["a"].to_list()), "th": np.repeat(some["th"].to_numpy(), times), "nb": np.repeat(some["nb"].to_numpy(), times)}
                yield pd.DataFrame(out | {c: np.concatenate(some[c].to_list()) for c in ("m", "lo", "len", "p")} | {"bytes": raws})
                at, held, raws = k + 1, 0, []


def repeat_spans(docs: DataFrame, length: int = LENGTH, k: int = K, text_col: str = "text", block_bytes: int = BLOCK_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """th, nb, lo, hi: spans of repeated bytes of each distinct text; they may overlap."""
    table = saved(context_table(docs, length, k, text_col), "table")
    often = table.groupBy("a").agg(F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("n > 1")
    often = saved(often.select("a", (F.col("c0") == F.col("c1")).alias("alone")), "anchors")
    some = saved(table.join(often, "a"), "contexts")
    each = saved(some.where("not alone").groupBy("a", "c").agg(F.count("*").alias("m"), F.min(F.struct("th", "nb", "lo", "len", "p")).alias("at")), "different")
    whole = some.join(each.where("m > 1").select("a", "c"), ["a", "c"], "left_semi").unionByName(some.where("alone").select("a", "c", *[x for x in some.columns if x not in ("a", "c")]))
    whole = whole.select("th", "nb", "lo", (F.col("lo") + F.col("len")).alias("hi"))
    # the bytes of each different context, from one document of its text
    wanted = each.select("a", "c", "m", "at.*").groupBy("th", "nb").agg(F.collect_list(F.struct("a", "m", "lo", "len", "p")).alias("parts"))
    own = docs.select(F.xxhash64(text_col).alias("th"), F.octet_length(text_col).cast("long").alias("nb"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    first = own.groupBy("th", "nb").agg(F.min("row").alias("row"))
    wanted = wanted.join(first, ["th", "nb"])

    # a column of each field: whole arrays come to Python, not a row for each context
    fields = ("a", "m", "lo", "len", "p")
    asked = own.join(wanted, ["th", "nb", "row"]).select("th", "nb", "text", *[F.col(f"parts.{c}").alias(c) for c in fields])
    # rows that repeat altogether would give a context twice
    pieces = asked.mapInPandas(cut_contexts, "a long, th long, nb long, m long, lo long, len int, p int, bytes binary").dropDuplicates(["a", "th", "nb", "lo"])
    out = saved(pieces.repartition("a").sortWithinPartitions("a").mapInPandas(_compare(length, k, block_bytes, hot_bytes), "a long, th long, nb long, m long, lo long, hi long, s1 long, s2 long"), "spans")
    strings = out.where("s1 is not null")
    twice = strings.groupBy("a", "s1", "s2").agg(F.sum("m").alias("n")).where("n > 1").select("a", "s1", "s2")
    found = out.where("s1 is null").unionByName(strings.join(twice, ["a", "s1", "s2"], "left_semi"), allowMissingColumns=True)
    return whole.unionByName(found.select("th", "nb", "lo", "hi"))


def _removed(text: Column, spans: Column) -> Column:
    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for t, found in zip(texts, spans, strict=True):
            raw = (t or "").encode()
            if found is None or not len(found):
                rows.append((len(raw), 0, 0, raw))
                continue
            runs: list[list[int]] = []
            for lo, hi in sorted((s["lo"], s["hi"]) for s in found):
                if runs and lo <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], hi)
                else:
                    runs.append([lo, hi])
            kept, at = [], 0
            for lo, hi in runs:
                kept.append(raw[at:lo])
                at = hi
            kept.append(raw[at:])
            rest = b"".join(kept)
            rows.append((len(raw), len(raw) - len(rest), len(runs), rest))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    return cut(text, spans)


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, text_col: str = "text", block_bytes: int = BLOCK_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """``docs`` with columns n_bytes, n_removed, n_spans, kept (bytes: what is left may part a character)."""
    found = repeat_spans(docs, length, k, text_col, block_bytes, hot_bytes)
    name, spans = fresh(docs.columns, "_repeats_of"), fresh([*docs.columns, "_repeats_of"], "_repeats")
    per_text = found.distinct().groupBy("th", "nb").agg(F.collect_list(F.struct("lo", "hi")).alias(spans)).select(F.struct("th", "nb").alias(name), spans)
    t = F.col(text_col)
    key = F.struct(F.xxhash64(t).alias("th"), F.octet_length(t).cast("long").alias("nb"))
    out = docs.join(per_text, key == F.col(name), "left")
    result = fresh([*out.columns], "_cut")
    return out.withColumn(result, _removed(t, F.col(spans))).select(*[F.col(f"`{c}`") for c in docs.columns], f"{result}.*")


def repeat_digests(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return remove_repeats(own, length, text_col="text", **limits).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

