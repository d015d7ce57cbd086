"""Operator 2: BPE encoding by backtracking over longest matches, and decoding by an offset table.

Encoder. An Aho-Corasick automaton over all tokens finds the longest token at each place. Two
neighbouring tokens may stand beside each other only if merging their joint text would give exactly
these two; whether it does is looked up in a pair-compatibility table (filled from the merge ranks on
first use). A text's encoding is the one sequence of tokens whose neighbours are all compatible. If the
longest matches in a row are compatible they are the answer; else the search steps back to a shorter
token, never trying the same place twice, so the time is linear in the text.

Decoder. The bytes of all tokens lie in one array; an offset table says where each id's bytes begin.

Null texts count as empty texts and give no ids. Empty texts give no ids. Strings of added tokens inside
a text become those tokens, as the library's default has it. Rows are independent: repeated rows give
repeated results, an empty table gives an empty result, other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import PIECES, ByteBPE, load, units
from .common import BoundedCache, task_over

#: Pairs (some 150 bytes each) that the pair table of a worker holds before it starts anew.
PAIRS = 200_000


class BacktrackingEncoder:
    """Exact BPE of one pre-token, and of texts through a bounded cache of units."""

    def __init__(self, bpe: ByteBPE):
        self.bpe = bpe
        self.left, self.right = bpe.left.tolist(), bpe.right.tolist()
        self.merged = {(a, b): 256 + r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        self.text_of = [x.decode("latin-1") for x in bpe.symbol_bytes]
        self.size = [len(x) for x in self.text_of]
        self.symbol = {x: s for s, x in enumerate(self.text_of)}
        self.tokens = ahocorasick.Automaton()
        for x, s in self.symbol.items():
            self.tokens.add_word(x, s)
        self.tokens.make_automaton()
        self.shorter: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.packed = [int(i).to_bytes(4, "little") for i in bpe.ids]
        self.spaced, self.plain = BoundedCache(lambda unit: self._unit(" " + unit)), BoundedCache(self._piece)

    def compatible(self, a: int, b: int) -> bool:
        """Would BPE of both tokens' joint bytes end as exactly (a, b)?

        Undo the merges on both sides of the seam from the latest to the earliest; the pair is spoilt as
        soon as a merge across the seam exists that ranks before the one undone last.
        """
        known = self.fits.get((a, b))
        if known is not None:
            return known
        last, x, y = 1 << 60, a, b
        while True:
            across = self.merged.get((x, y))
            if across is not None and across < last:
                found = False
                break
            if x < 256 and y < 256:
                found = True
                break
            # of two merges of one rank the left one was made first, so the right one is undone first
            if x > y:
                last, x = x, self.right[x - 256]
            else:
                last, y = y + 1, self.left[y - 256]
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        self.fits[a, b] = found
        return found

    def next_shorter(self, s: int) -> int:
        """The longest token that is a proper prefix of token s; -1 for a single byte."""
        if s not in self.shorter:
            x = self.text_of[s]
            self.shorter[s] = next((self.symbol[x[:n]] for n in range(len(x) - 1, 0, -1) if x[:n] in self.symbol), -1)
        return self.shorter[s]

    def encode_piece(self, piece: bytes) -> list[int]:
        """The symbols of one pre-token."""
        text = piece.decode("latin-1")
        found = [s for _, s in self.tokens.iter_long(text)]
        fits, last = self.fits.get, -1
        for k, s in enumerate(found):
            if last >= 0 and not (fits((last, s)) or self.compatible(last, s)):
                return self._backtrack(text, found, k)
            last = s
        return found

    def _longest(self, text: str, at: int) -> int:
        return next(self.tokens.iter_long(text, at))[1]

    def _backtrack(self, text: str, found: list[int], k: int) -> list[int]:
        """Go on from the longest matches ``found`` of which the first k are compatible and the next is not."""
        size, fits, shorter, n = self.size, self.fits.get, self.shorter.get, len(text)
        out = found[:k]
        at, s = sum([size[x] for x in out]), found[k]
        dead = set()  # places from which no compatible way led on
        while at < n:
            last = out[-1] if out else -1
            while s >= 0 and (at + size[s] in dead or (last >= 0 and not (fits((last, s)) or self.compatible(last, s)))):
                less = shorter(s)
                s = self.next_shorter(s) if less is None else less
            if s >= 0:
                out.append(s)
                at += size[s]
                s = self._longest(text, at) if at < n else -1
            else:
                if not out:
                    raise ValueError("no compatible sequence: the merges are not a proper BPE")
                dead.add(at)
                s = out.pop()
                at -= size[s]
                s = self.next_shorter(s)
        return out

    def _piece(self, piece: str) -> bytes:
        packed = self.packed
        return b"".join([packed[s] for s in self.encode_piece(piece.encode())])

    def _unit(self, unit: str) -> bytes:
        return b"".join(map(self._piece, PIECES.findall(unit)))

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        out = []
        for k, part in enumerate(self.bpe.parts(text)):
            if k % 2:
                out.append(self.bpe.special[part].to_bytes(4, "little"))
                continue
            cut = units(part)
            if cut is None:
                out.extend(map(self.plain.__getitem__, PIECES.findall(part)))
            else:
                out.append(self._unit(cut[0]))
                out.extend(map(self.spaced.__getitem__, cut[1]))
        return b"".join(out)


class OffsetDecoder:
    def __init__(self, bpe: ByteBPE):
        self.bytes, self.offsets = bpe.offset_table()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        begin = self.offsets[ids]
        size = self.offsets[ids + 1] - begin
        ends = np.cumsum(size)
        if not len(ends) or not ends[-1]:
            return b""
        at = np.repeat(begin - (ends - size), size)
        at += np.arange(ends[-1])
        return self.bytes[at].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _codec(path: str) -> tuple[BacktrackingEncoder, OffsetDecoder]:
    bpe = load(path)
    return BacktrackingEncoder(bpe), OffsetDecoder(bpe)


def encode_column(text: Column, path: str) -> Column:
    """The ids of each text, as a binary of little-endian unsigned 32-bit integers (null text: none)."""

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder, _ = _codec(path)
        for texts in batches:
            yield pd.Series([encoder.encode(t or "") for t in texts], dtype=object)
        task_over(_codec, load)

    return ids(text)


def decode_column(ids: Column, path: str) -> Column:
    """The text of each binary of ids; bytes that are no UTF-8 become U+FFFD, null gives null."""

    @F.pandas_udf("string")
    def text(packed: pd.Series) -> pd.Series:
        _, decoder = _codec(path)
        return pd.Series([None if p is None else decoder.decode(np.frombuffer(p, "<u4")) for p in packed], dtype=object)

    return text(ids)


def digest_column(text: Column, path: str) -> Column:
    """Encode, decode, and return only struct(n_tokens, ids_sha256, decoded_sha256): ids never leave the worker."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder, decoder = _codec(path)
        for texts in batches:
            rows = []
            for t in texts:
                packed = encoder.encode(t or "")
                back = decoder.decode(np.frombuffer(packed, "<u4"))
                rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        task_over(_codec, load)

    return digest(text)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256. A narrow map: nothing is shuffled."""
    return docs.select(F.col(id_col).alias("doc_id"), digest_column(F.col(text_col), path).alias("_x")).select("doc_id", "_x.n_tokens", "_x.ids_sha256", "_x.decoded_sha256")
