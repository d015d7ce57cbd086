"""Operator 10: token counts by rank-synchronous array merging.

All pre-tokens of a batch that have not been seen lie in one flat array of symbols with the start of each
pre-token beside it (a ragged array). In every round each pre-token's lowest-ranked pair is found by one
segmented minimum, and all its occurrences are merged at once, in all pre-tokens together; runs of equal
symbols merge from the left, in twos. A pre-token without a mergeable pair is done, and the number of
symbols that survive is its count.

Null and empty texts have no tokens. Strings of added tokens count as one token, as the library's default
has it. Rows are independent; other columns are never read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import PIECES, ByteBPE, load, units

#: Entries (some 150 bytes each) that a worker's caches hold before they start anew, and characters merged at once.
CACHE, CHUNK = 150_000, 1_000_000
_NONE = np.int64(1 << 40)


class RankMerger:
    def __init__(self, bpe: ByteBPE):
        self.bpe = bpe
        keys = bpe.left << 20 | bpe.right
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], np.int64(1) << 62), np.append(order, _NONE)
        self.spaced: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge_counts(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols survive in each of ``pieces`` (none of them empty)."""
        counts = np.zeros(len(pieces), np.int64)
        size = np.array([len(p) for p in pieces], np.int64)
        sym = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        own = np.repeat(np.arange(len(pieces)), size)
        rank = self._pair_ranks(sym, own)
        while len(sym):
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            n = np.diff(np.append(first, len(own)))
            low = np.minimum.reduceat(rank, first)
            done = low == _NONE
            if done.any():
                counts[own[first[done]]] = n[done]
                stay = np.repeat(~done, n)
                sym, own, rank = sym[stay], own[stay], rank[stay]
                low, n = low[~done], n[~done]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(low, n))
            # overlapping occurrences (a run of one symbol) merge from the left, in twos
            run = np.append(True, at[1:] != at[:-1] + 1)
            head = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - head) % 2 == 0]
            sym[at] = 256 + rank[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            touched[np.maximum(at - 1, 0)] = True
            # the symbol before a merged one may itself have been dropped; then the one before that is its neighbour
            touched[np.maximum(at - 2, 0)] = True
            sym, own, rank, touched = sym[keep], own[keep], rank[keep], touched[keep]
            self._renew(sym, own, rank, np.flatnonzero(touched))
        return counts

    def _pair_ranks(self, sym: np.ndarray, own: np.ndarray) -> np.ndarray:
        rank = np.full(len(sym), _NONE)
        self._renew(sym, own, rank, np.arange(len(sym)))
        return rank

    def _renew(self, sym, own, rank, at) -> None:
        """Ranks of the pairs that begin at ``at``; the last symbol of a pre-token begins none."""
        rank[at] = _NONE
        at = at[at + 1 < len(sym)]
        at = at[own[at] == own[at + 1]]
        rank[at] = self.ranks_of(sym[at], sym[at + 1])

    def _learn(self, strings: set[str]) -> None:
        new = [s for s in strings if s not in self.pieces]
        if len(self.pieces) + len(new) > CACHE:
            self.pieces.clear()
            new = list(strings)
        begin = 0
        while begin < len(new):
            end, chars = begin, 0
            while end < len(new) and (end == begin or chars + len(new[end]) <= CHUNK):
                chars += len(new[end])
                end += 1
            self.pieces.update(zip(new[begin:end], self.merge_counts([s.encode() for s in new[begin:end]]).tolist(), strict=True))
            begin = end

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text. The pre-tokens of all ``texts`` are merged together."""
        special, plans, need_units, need_pieces = [], [], set(), set()
        for t in texts:
            parts = self.bpe.parts(t)
            special.append(len(parts) // 2)
            firsts, chunks = [], []
            for part in parts[::2]:
                cut = units(part)
                if cut is None:
                    found = PIECES.findall(part)
                    need_pieces.update(found)
                    firsts.append(found)
                else:
                    found = PIECES.findall(cut[0])
                    need_pieces.update(found)
                    firsts.append(found)
                    chunks.append(cut[1])
                    need_units.update(cut[1])
            plans.append((firsts, chunks))
        need_units.difference_update(self.spaced.keys())
        split = {u: PIECES.findall(" " + u) for u in need_units}
        for found in split.values():
            need_pieces.update(found)
        self._learn(need_pieces)
        pieces = self.pieces
        if len(self.spaced) + len(split) > CACHE:
            self.spaced.clear()
            missing = {u for _, chunks in plans for c in chunks for u in c} - split.keys()
            split |= {u: PIECES.findall(" " + u) for u in missing}
            self._learn({p for found in split.values() for p in found} | need_pieces)
        spaced = self.spaced
        for u, found in split.items():
            spaced[u] = sum([pieces[p] for p in found])
        return [n + sum(sum(map(pieces.__getitem__, f)) for f in firsts) + sum(sum(map(spaced.__getitem__, c)) for c in chunks) for n, (firsts, chunks) in zip(special, plans, strict=True)]


@lru_cache(maxsize=2)
def _merger(path: str) -> RankMerger:
    return RankMerger(load(path))


def count_column(text: Column, path: str) -> Column:
    """Tokens of each text as a long (null and empty: 0)."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        merger, out, part, chars = _merger(path), [], [], 0
        for t in texts:
            part.append(t or "")
            chars += len(part[-1])
            if chars > CHUNK:
                out += merger.count(part)
                part, chars = [], 0
        return pd.Series(out + merger.count(part), dtype="int64")

    return count(text)


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes (UTF-8; null: 0), n_tokens, over_limit. A narrow map: nothing is shuffled."""
    t = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(t).cast("long"), F.lit(0).cast("long")).alias("n_bytes"), count_column(t, path).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
