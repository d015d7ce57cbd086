"""A byte-level BPE vocabulary read from a tokenizer file, and the split of texts into units.

The file is the JSON form of the public ``tokenizers`` library. Only what the operators need is kept:
the bytes of every token, the merge ranks, and the added tokens. Inside this package a symbol is
numbered 0 to 255 for a single byte and 256 + r for the result of the merge of rank r.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import regex

#: The published split pattern of byte-level BPE ("ByteLevel" with use_regex).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_BLANK_RUN = re.compile(r"\s ")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from U+0100."""
    out, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class ByteBPE:
    """Tokens as bytes, merges as pairs of symbols, and the id of every symbol in the file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pre = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only plain byte-level BPE files are read")
        of_char = {c: b for b, c in enumerate(byte_chars())}
        vocab = model["vocab"]
        symbol = {c: b for c, b in of_char.items()}
        left, right = [], []
        for r, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left.append(symbol[a])
            right.append(symbol[b])
            if a + b in symbol:
                raise ValueError("a token is made by two merges")
            symbol[a + b] = 256 + r
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        self.n_symbols = len(symbol)
        ids = np.zeros(self.n_symbols, np.uint32)
        self.symbol_bytes: list[bytes] = [b""] * self.n_symbols
        for chars, s in symbol.items():
            ids[s] = vocab[chars]
            self.symbol_bytes[s] = bytes(of_char[c] for c in chars)
        self.ids = ids
        self.special: dict[str, int] = {}
        for t in spec.get("added_tokens", []):
            if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]:
                raise ValueError("only added tokens that match as they stand are read")
            self.special[t["content"]] = t["id"]
        self._special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def parts(self, text: str) -> list[str]:
        """``text`` cut at added tokens; every second part is one."""
        if self._special and any(s in text for s in self.special):
            return self._special.split(text)
        return [text]

    def offset_table(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all tokens in a row, and where each id's bytes begin (one more at the end)."""
        n = int(max([*self.ids.tolist(), *self.special.values()], default=-1)) + 1
        table = [b""] * n
        for s, i in enumerate(self.ids.tolist()):
            table[i] = self.symbol_bytes[s]
        for s, i in self.special.items():
            table[i] = s.encode()
        offsets = np.zeros(n + 1, np.int64)
        np.cumsum([len(x) for x in table], out=offsets[1:])
        return np.frombuffer(b"".join(table), np.uint8), offsets


@lru_cache(maxsize=4)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def units(text: str) -> tuple[str, list[str]] | None:
    """(first unit, the later units without their leading space) if the text can be cut at its spaces.

    No alternative of the split pattern runs from a non-blank into a space, so a text may be cut before
    any space that follows a non-blank. None if some space follows a blank: then the pattern itself
    has to be run over the whole text.
    """
    if text[:1] == " " or _BLANK_RUN.search(text):
        return None
    cut = text.split(" ")
    if cut[-1] == "":  # a space at the end is a unit of its own and not what comes before a word
        return None
    return cut[0], cut[1:]
