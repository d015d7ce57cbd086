"""Operator 6: token ids written as frequency-ranked variable-length binary files, and read back.

File format (a folder):

* ``ids/``: Parquet files whose order is the order of the documents. One row per document: ``part`` and
  ``local_start`` (ids of the documents before it in its part), ``n_tokens``, ``control`` and ``data``.
  Each id is replaced by its rank by frequency over the whole corpus (ties: the smaller id first), so
  that frequent ids take one byte. ``data`` holds each rank in 1 to 4 little-endian bytes; ``control`` holds
  two bits for each rank, the number of its bytes less one, four ranks in a byte from the low bits up.
* ``ranks/``: Parquet with ``rank`` and ``id``. Its size is that of the vocabulary.

Encoder and decoder are numpy table lookups over a batch of documents at once; the decoder looks every control byte
up in a 256-row table of lengths. Spark's writer commits the files, so a lost executor's part is written anew.

Texts are tokenized by the public ``tokenizers`` library. As its normalizer and split work within runs of
non-blanks, each distinct run is encoded once and kept in a cache of bounded size; runs are cut once more, at marks
behind letters, where the split always parts them.

Null texts count as empty; an empty text has the end id alone. Documents are ordered by id, nulls first;
rows with one id are ordered by their number of tokens, then by their ids' bytes. Repeated rows are written repeatedly. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .byte_bpe import byte_chars
from .common import CACHE_BYTES, BoundedCache, dropped, new_path, saved, task_over

#: Lengths of the four ranks that a control byte describes.
LENGTHS = np.stack([(np.arange(256) >> 2 * k & 3) + 1 for k in range(4)], axis=1).astype(np.int64)
_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint64)
#: Ids that are packed or unpacked at once, and bytes of ids that one task sorts and writes.
BATCH_IDS, PART_BYTES = 1_000_000, 32_000_000
_BEYOND = re.compile("[^\\x00-\xff]")
#: Small Latin letters; none of them is changed by normalization as long as no mark stands behind.
_SMALL = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: What a byte is: 1 an ASCII mark, 2 an ASCII letter or digit, 3 the first byte of a letter of Latin-1 (C3), 4 the second.
_KIND = np.zeros(256, np.uint8)
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 1
_KIND[[b for b in range(48, 123) if chr(b).isalnum()]] = 2
_KIND[0xC3] = 3
_KIND[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = 4  # but the signs of multiplication and division


def parted(raw: bytes) -> list[bytes]:
    """A UTF-8 text cut at ASCII blanks, and where a mark follows a letter or digit: no alternative of the split pattern runs across."""
    kind = _KIND[np.frombuffer(raw, np.uint8)]
    after = kind[:-1] == 2
    after[1:] |= (kind[:-2] == 3) & (kind[1:-1] == 4)
    at = np.flatnonzero(after & (kind[1:] == 1)) + 1
    return (np.insert(np.frombuffer(raw, np.uint8), at, 32).tobytes() if len(at) else raw).split()


class RunTokenizer:
    """The library's ids of whole texts, through a cache of their pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        spec = _spec(path)
        if not _splits_at_blanks(spec):
            raise ValueError("this tokenizer does not drop blanks; its texts cannot be cut at them")
        self.plain = _is_plain(spec)
        self.added = [t["content"].lower() for t in spec.get("added_tokens", [])]
        self.chars = {b: c for b, c in enumerate(byte_chars())}
        self.dtype, self.code = ("<u2", "H") if self.size <= 1 << 16 else ("<u4", "I")
        self.pieces = BoundedCache(self._piece, 3 * CACHE_BYTES)

    def _ids(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: bytes) -> bytes:
        text = piece.decode()
        if self.plain and _SMALL.fullmatch(text):  # the normalizer and the split leave it as it is
            return self._ids([t.id for t in self.model.tokenize(text if text.isascii() else piece.decode("latin-1").translate(self.chars))])
        return self._whole(text)

    def encode(self, text: str) -> bytes:
        """Ids of a text, in little-endian integers of ``dtype``."""
        low = text.lower()
        # the one letter whose small form ends in a mark stays with the marks behind it; added tokens may hold marks
        if not self.plain or "\u0130" in text or any(t in low for t in self.added):
            # bytes split at the ASCII blanks only; other blanks stay inside a run and are left to the library
            return b"".join([self._whole(r.decode()) for r in text.encode().split()])
        # beyond Latin-1, lowering before or after normalizing may differ
        return b"".join(map(self.pieces.__getitem__, parted((text if _BEYOND.search(text) else low).encode())))


def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _splits_at_blanks(spec: dict) -> bool:
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [{}])[0]
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or set(t["content"]) & set(" \t\n\r\v\f")) for t in spec.get("added_tokens", []))
    # a Split that keeps only matches of a pattern in which no alternative matches a blank
    return plain and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and "\\s+" not in first["pattern"].get("Regex", "\\s+") and not spec.get("truncation") and not spec.get("padding")


def _is_plain(spec: dict) -> bool:
    """Whether normalizer and split are the published ones: NFC, blanks, lower case; contractions, letters, a digit, marks."""
    steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = pre[0].get("pattern", {}).get("Regex") if pre else None
    return steps == ["NFC", "Replace", "Lowercase"] and pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and [p.get("type") for p in pre[1:]] == ["ByteLevel"] and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex")


@lru_cache(maxsize=2)
def _runs(path: str) -> RunTokenizer:
    return RunTokenizer(path)


def _slices(n_ids: np.ndarray) -> Iterator[slice]:
    """Rows of a batch in slices of about BATCH_IDS ids, one row at least."""
    part = np.cumsum(n_ids) // BATCH_IDS
    head = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    for lo, hi in zip(head.tolist(), [*head[1:].tolist(), len(part)], strict=True):
        yield slice(lo, hi)


def _cut(flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    raw, ends = flat.tobytes(), np.cumsum(sizes).tolist()
    return [raw[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]


def pack(ranks: np.ndarray, n: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """(control, data) of each of some documents, whose ``n`` ranks each lie in a row."""
    r = ranks.astype("<u4")
    more = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    fours = -(-n // 4)
    padded = np.zeros(int(fours.sum()) * 4, np.uint8)
    padded[np.arange(len(r)) + np.repeat(4 * (np.cumsum(fours) - fours) - (np.cumsum(n) - n), n)] = more
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= more[:, None]]
    ends = np.append(0, np.cumsum(more, dtype=np.int64) + np.arange(1, len(r) + 1))[np.cumsum(n)]
    return _cut(control, fours), _cut(data, np.diff(np.append(0, ends)))


def unpack(control: list[bytes], data: list[bytes], n: np.ndarray) -> np.ndarray:
    """The ranks that ``pack`` was given, in a row."""
    size = LENGTHS[np.frombuffer(b"".join(control), np.uint8)].ravel()
    fours = -(-n // 4)
    size = size[np.arange(int(n.sum())) + np.repeat(4 * (np.cumsum(fours) - fours) - (np.cumsum(n) - n), n)]
    if not len(size):
        return np.zeros(0, np.uint32)
    begin = np.cumsum(size) - size
    raw = np.frombuffer(b"".join([*data, b"\0\0\0"]), np.uint8)
    out = raw[begin].astype(np.uint64)
    for k in range(1, 4):
        out |= raw[begin + k].astype(np.uint64) << np.uint64(8 * k)
    return (out & _MASK[size]).astype(np.uint32)


def encoded(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Two tables, written by one pass over the texts: doc_id, n_tokens, ids of each document with the end id, and id, n of each task's ids."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs, count = _runs(path), np.zeros(0, np.int64)
        end = runs._ids([end_id])
        for pdf in batches:
            found, held, lo = [], 0, 0
            names, last = pdf["doc_id"], len(pdf) - 1
            for k, text in enumerate(pdf["text"]):
                found.append((runs.encode(text) if text else b"") + end)
                held += len(found[-1])
                if held > 2 * BATCH_IDS or k == last:
                    count = _added(count, np.frombuffer(b"".join(found), runs.dtype))
                    out = pd.DataFrame({"doc_id": names.iloc[lo : k + 1], "n_tokens": [len(x) // len(end) for x in found], "ids": pd.Series(found, dtype=object, index=names.index[lo : k + 1])})
                    yield out.assign(id=None, n=None)
                    found, held, lo = [], 0, k + 1
        task_over(_runs)
        used = np.flatnonzero(count)
        yield pd.DataFrame({"doc_id": pd.Series([None] * len(used), dtype=object), "n_tokens": None, "ids": None, "id": used, "n": count[used]})

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    both = saved(own.mapInPandas(encode, f"doc_id {kind}, n_tokens long, ids binary, id long, n long"), "encoded")
    return both, both.where("id is not null").select("id", "n")


def _added(count: np.ndarray, ids: np.ndarray) -> np.ndarray:
    own = np.bincount(ids, minlength=len(count))
    own[: len(count)] += count
    return own


def rank_table(counts: DataFrame) -> np.ndarray:
    """rank -> id over all documents, from (id, n); the driver gets one row per id of the vocabulary."""
    rows = counts.groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return rows.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.uint32)


def write_token_files(docs: DataFrame, to: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all documents to the folder ``to`` in ascending order of their ids."""
    spark = docs.sparkSession
    both, counts = encoded(docs, path, end_id, id_col, text_col)
    of_rank = rank_table(counts)
    table = pd.DataFrame({"rank": np.arange(len(of_rank)), "id": of_rank.astype(np.int64)})
    spark.createDataFrame(table, "rank long, id long").coalesce(1).write.parquet(f"{to}/ranks")
    shared = spark.sparkContext.broadcast(of_rank)  # at most the vocabulary
    kind, width = both.schema["doc_id"].dataType.simpleString(), np.dtype(_runs(path).dtype).itemsize

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = np.zeros(int(shared.value.max(initial=0)) + 1, np.uint32)
        rank[shared.value] = np.arange(len(shared.value), dtype=np.uint32)
        part_no, at = TaskContext.get().partitionId(), 0
        for whole in batches:
            for rows in _slices(whole["n_tokens"].to_numpy(np.int64)):
                pdf = whole.iloc[rows]
                n = pdf["n_tokens"].to_numpy(np.int64)
                control, data = pack(rank[np.frombuffer(b"".join(pdf["ids"]), f"<u{width}")], n)
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "part": part_no, "local_start": at + np.cumsum(n) - n, "n_tokens": n, "control": control, "data": data})
                at += int(n.sum())

    ids = both.where("ids is not null").select("doc_id", "n_tokens", "ids")
    parts = max(1, -(-(ids.agg(F.sum("n_tokens")).first()[0] or 0) * width // PART_BYTES))  # so a part does not grow with the corpus
    ordered = ids.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids")
    ordered.mapInPandas(write, f"doc_id {kind}, part int, local_start long, n_tokens long, control binary, data binary").write.parquet(f"{to}/ids")
    dropped(both)


def read_token_files(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, control, data of each document; ``id_table`` has what the ranks stand for."""
    ids = spark.read.parquet(f"{at}/ids")
    # one row per part (a task's worth of documents), so this window and its broadcast are small
    sizes = ids.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = sizes.select(F.col("part").alias("_part"), F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ids.join(before, F.col("part") == F.col("_part")).select("doc_id", (F.col("_before") + F.col("local_start")).alias("start"), "n_tokens", "control", "data")


def id_table(spark: SparkSession, at: str) -> np.ndarray:
    """rank -> id of a folder; at most the vocabulary."""
    rows = spark.read.parquet(f"{at}/ranks").toPandas()
    return rows.sort_values("rank")["id"].to_numpy(np.uint32)


def token_file_digests(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to the shared folder and return doc_id, start, n_tokens and ids_crc32 as read back from them."""
    spark = docs.sparkSession
    to = new_path(spark, "token-files")
    write_token_files(docs, to, path, end_id, id_col, text_col)
    table = spark.sparkContext.broadcast(id_table(spark, to))

    @F.pandas_udf("long")
    def crc(control: pd.Series, data: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for rows in _slices(n.to_numpy(np.int64)):
            own = n.iloc[rows].to_numpy(np.int64)
            flat = table.value[unpack(list(control.iloc[rows]), list(data.iloc[rows]), own)].astype("<u4").view(np.uint8).data
            ends = (4 * np.cumsum(own)).tolist()
            out += [zlib.crc32(flat[lo:hi]) for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]
        return pd.Series(out, dtype="int64")

    return read_token_files(spark, to).select("doc_id", "start", "n_tokens", crc("control", "data", "n_tokens").alias("ids_crc32"))
