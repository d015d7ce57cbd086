"""Operator 12: cross-tokenizer alignment by interval joins in DuckDB, one Arrow batch at a time.

Each batch of texts is encoded twice: space + text by a byte-level BPE vocabulary (A), text by a sentencepiece model (B,
which adds the space itself). The tokens of a batch become two interval tables (position, id, start, end) on one byte
axis, on which documents follow each other. DuckDB joins them: an ASOF join finds the B token under the first
byte of each A token, a range join the A token around each B token that begins within one; together that is each
overlapping pair once. Places where tokens of both sides end cut the tokens into groups, which are numbered by window sums.

Id pairs are numbered within a batch. A document keeps only these numbers and how often it holds each; a batch
sends each of its pairs once, with the number of its documents that hold it linked. Spark merges the partial counts, and
the merged counts come back to the batches. So what is shuffled grows with the distinct pairs of batches, not with
tokens. A pair that stands in very many batches is summed before the shuffle, and its join may be split by adaptive execution.
A very long text is cut at common ends into stretches of SLICE tokens, as no link crosses one; no text is cut off.

Texts that are null or empty, and texts whose B bytes differ from space + text (a text that holds U+2581, or what the
model's normalizer changes), have no tokens: zeros, and '' for the groups. Null ids and repeated rows
get a row each, and each row counts as a document of its own. An empty table gives an empty result. Columns other than
the two named are never read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import PIECES, load
from .common import saved, task_over

#: Characters of text that are encoded together, and tokens of one side that DuckDB joins at once.
CHARS, SLICE = 2_000_000, 1_000_000

#: ``begins`` and ``ends`` say whether the other side has a token that begins or ends there, too, ``equal`` whether it has this very interval.
#: An A token that no B token equals is the only kind another B token may begin within.
LINKS = """
    select a.doc, a.id as a, b.id as b from a asof join b on a.s >= b.s
    union all
    select wide.doc, wide.id, inner_b.id from (select * from b where not begins) inner_b
    join (select * from a where not equal) wide on inner_b.s > wide.s and inner_b.s < wide.e
"""
PAIRS = f"select doc, a, b, count(*)::integer as n from ({LINKS}) group by all"
#: Of each token of one side, how many common ends stand up to its own. The window runs over the rows as they come, in order.
GROUPS = "select pos, sum(ends::integer) over (rows unbounded preceding) as upto from {own}"


def common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of two ascending arrays' elements stand in the other, too."""
    at = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
    in_a = b[at] == a if len(b) else np.zeros(len(a), bool)
    in_b = np.zeros(len(b), bool)
    in_b[at[in_a]] = True
    return in_a, in_b


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        bpe = load(a_path)
        if (np.diff(bpe.ids[256:].astype(np.int64)) <= 0).any():
            raise ValueError("only vocabularies whose ids follow the merges are read")
        a_bytes = {int(i): bpe.symbol_bytes[s] for s, i in enumerate(bpe.ids.tolist())}
        self.encoder = tiktoken.Encoding("a", pat_str=PIECES.pattern, mergeable_ranks={b: i for i, b in a_bytes.items()}, special_tokens={})
        self.a_size = np.zeros(max(a_bytes) + 1, np.int64)
        for i, b in a_bytes.items():
            self.a_size[i] = len(b)
        self.model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = range(self.model.get_piece_size())
        self.b_bytes = [bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode() for i in pieces]
        self.b_size = np.array([len(b) for b in self.b_bytes], np.int64)
        # what a token writes before the end of its side of a group, and at it
        self.a_words = [np.array([f"{i}{end}" for i in range(len(self.a_size))], object) for end in ",|"]
        self.b_words = [np.array([f"{i}{end}" for i in pieces], object) for end in ",;"]
        self.db = duckdb.connect(config={"threads": 1})

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        spaced = " " + text
        a, b = self.encoder.encode_ordinary(spaced), self.model.encode(text)
        if b"".join(map(self.b_bytes.__getitem__, b)) != spaced.encode():
            return none, none
        return np.array(a, np.int64), np.array(b, np.int64)

    def interval_tables(self, a: np.ndarray, b: np.ndarray, own_a: np.ndarray, own_b: np.ndarray) -> tuple[pa.Table, pa.Table]:
        """The intervals of the tokens of both sides, which begin and end together."""
        ends = [np.cumsum(size[ids]) for ids, size in ((a, self.a_size), (b, self.b_size))]
        shared = common(*ends)
        begins = [np.append(True, x[:-1]) for x in shared]  # a token begins where the one before it ends
        whole = [np.flatnonzero(x & y) for x, y in zip(begins, shared, strict=True)]
        # both begin and end on common places: equal if they end together and are as long
        same = common(*(e[w] for e, w in zip(ends, whole, strict=True)))
        tables = []
        for ids, own, size, e, x, y, w, k in zip((a, b), (own_a, own_b), (self.a_size, self.b_size), ends, begins, shared, whole, same, strict=True):
            equal = np.zeros(len(ids), bool)
            equal[w[k]] = True
            columns = {"doc": own, "pos": np.arange(len(ids)), "id": ids, "s": e - size[ids], "e": e}
            tables.append(pa.table({c: pa.array(v.astype(np.int32)) for c, v in columns.items()} | {"begins": pa.array(x), "ends": pa.array(y), "equal": pa.array(equal)}))
        return tables[0], tables[1]

    def joined(self, a: pa.Table, b: pa.Table) -> tuple:
        """doc, a, b, n of each linked pair, and the group of each token of A and of B."""
        self.db.register("a", a)
        self.db.register("b", b)
        pairs = {c: np.asarray(v, np.int64) for c, v in self.db.sql(PAIRS).fetchnumpy().items()}
        parts = []
        for own, table in (("a", a), ("b", b)):
            rows = self.db.sql(GROUPS.format(own=own)).fetchnumpy()
            if (np.diff(rows["pos"]) != 1).any():
                raise RuntimeError("tokens came back out of order")
            parts.append(np.asarray(rows["upto"], np.int64) - table["ends"].to_numpy(zero_copy_only=False))
        self.db.unregister("a")
        self.db.unregister("b")
        return pairs, *parts

    def groups_text(self, a: np.ndarray, b: np.ndarray, a_part: np.ndarray, b_part: np.ndarray) -> list[str]:
        """The words of all groups in order; joined, less the last character, they are the groups' text."""
        n = int(a_part[-1]) + 1
        a_count, b_count = np.bincount(a_part, minlength=n), np.bincount(b_part, minlength=n)
        out = np.empty(len(a) + len(b), object)
        last_a, last_b = np.append(a_part[1:] != a_part[:-1], True), np.append(b_part[1:] != b_part[:-1], True)
        out[np.arange(len(a)) + (np.cumsum(b_count) - b_count)[a_part]] = np.where(last_a, self.a_words[1][a], self.a_words[0][a])
        out[np.arange(len(b)) + np.cumsum(a_count)[b_part]] = np.where(last_b, self.b_words[1][b], self.b_words[0][b])
        return out.tolist()

    def stretches(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Ranges of A and of B tokens that end together, of about SLICE tokens each."""
        if max(len(a), len(b)) <= SLICE:
            return [(0, len(a), 0, len(b))]
        _, at_a, at_b = np.intersect1d(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), assume_unique=True, return_indices=True)
        goal = np.arange(SLICE, len(a), SLICE)
        at = np.unique(np.minimum(np.searchsorted(at_a, goal), len(at_a) - 1))
        cuts = np.unique(np.append(at, len(at_a) - 1))
        ends_a, ends_b = [0, *(at_a[cuts] + 1).tolist()], [0, *(at_b[cuts] + 1).tolist()]
        return list(zip(ends_a[:-1], ends_a[1:], ends_b[:-1], ends_b[1:], strict=True))

    def align(self, texts: list[str | None]) -> tuple[dict, np.ndarray, np.ndarray]:
        """Columns with a value per text, and the distinct pairs of all (a << 32 | b) with the number of texts that hold each linked."""
        encoded = [self.tokens(t) for t in texts]
        digest = [hashlib.sha256() for _ in texts]
        begun, n_groups, found = [False] * len(texts), np.zeros(len(texts), np.int64), []
        todo: list[tuple[int, np.ndarray, np.ndarray]] = [(d, a[p:q], b[r:s]) for d, (a, b) in enumerate(encoded) if len(a) for p, q, r, s in self.stretches(a, b)]
        while todo:
            n, held = 0, 0
            while n < len(todo) and (not n or held + len(todo[n][1]) <= SLICE):
                held, n = held + len(todo[n][1]), n + 1
            now, todo = todo[:n], todo[n:]
            own_a, own_b = (np.repeat([x[0] for x in now], [len(x[k]) for x in now]) for k in (1, 2))
            a, b = (np.concatenate([x[k] for x in now]) for k in (1, 2))
            table_a, table_b = self.interval_tables(a, b, own_a, own_b)
            pairs, part_a, part_b = self.joined(table_a, table_b)
            found.append((pairs["doc"], pairs["a"] << 32 | pairs["b"], pairs["n"]))
            n_groups += np.bincount(own_a[table_a["ends"].to_numpy(zero_copy_only=False)], minlength=len(texts))
            words, at = self.groups_text(a, b, part_a, part_b), 0
            for d, xa, xb in now:
                text = "".join(words[at : at + len(xa) + len(xb)])[:-1]
                digest[d].update(((";" if begun[d] else "") + text).encode())
                begun[d] = True
                at += len(xa) + len(xb)
        doc, key, n = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in range(3))
        # a text that was joined in several stretches may hold a pair in more than one
        order = np.lexsort((key, doc))
        doc, key, n = doc[order], key[order], n[order]
        first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))) if len(doc) else np.zeros(0, np.int64)
        doc, key, n = doc[first], key[first], np.add.reduceat(n, first) if len(first) else n
        distinct, number, held = np.unique(key, return_inverse=True, return_counts=True)
        ends = np.searchsorted(doc, np.arange(len(texts) + 1))
        of = [slice(x, y) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        rows = {
            "n_a": [len(a) for a, _ in encoded], "n_b": [len(b) for _, b in encoded], "n_groups": n_groups, "n_links": [int(n[x].sum()) for x in of],
            "groups_sha256": [h.hexdigest() if some else "" for h, some in zip(digest, begun, strict=True)],
            "steps": [np.diff(number[x], prepend=0) for x in of], "times": [n[x] for x in of],
        }
        return rows, distinct, held


@lru_cache(maxsize=1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """A row per document, and one per batch with its distinct pairs, saved.

    ``batch`` names the batch. ``steps`` are the differences of a document's ascending pair numbers, ``times`` how often it
    links each; pair_a, pair_b and pair_n are the batch's pairs by number, and the documents that hold each.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"batch string, doc_id {own.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, steps array<int>, times array<int>, pair_a array<int>, pair_b array<int>, pair_n array<int>"

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for rows in batches:
                texts, at = rows.column("text").to_pylist(), 0
                while at < len(texts):
                    to, chars = at, 0
                    while to < len(texts) and (to == at or chars + len(texts[to] or "") <= CHARS):
                        chars, to = chars + len(texts[to] or ""), to + 1
                    out, pairs, held = _aligner(a_path, b_path).align(texts[at:to])
                    name = uuid.uuid4().hex
                    yield of_columns({"batch": [name] * (to - at), "doc_id": rows.column("doc_id")[at:to], **out}, to - at, rows.schema.field("doc_id").type)
                    yield of_columns({"batch": [name], "pair_a": [pairs >> 32], "pair_b": [pairs & 0xFFFFFFFF], "pair_n": [held]}, 1, rows.schema.field("doc_id").type)
                    at = to
        finally:
            task_over(_aligner)

    return saved(own.mapInArrow(align, schema), "aligned")


LISTS = {"steps", "times", "pair_a", "pair_b", "pair_n"}
COLUMNS = ["batch", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "steps", "times", "pair_a", "pair_b", "pair_n"]


def of_columns(given: dict, n: int, id_type: pa.DataType) -> pa.RecordBatch:
    """A record batch with all COLUMNS; those not given are null."""
    kinds = {c: pa.list_(pa.int32()) if c in LISTS else pa.int64() for c in COLUMNS} | {"batch": pa.string(), "groups_sha256": pa.string(), "doc_id": id_type}
    made = [given[c] if isinstance(given.get(c), pa.Array) else pa.array(given[c], kinds[c]) if c in given else pa.nulls(n, kinds[c]) for c in COLUMNS]
    return pa.RecordBatch.from_arrays(made, names=COLUMNS)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, count (documents that hold the pair linked) and best (whether no other pair of a has more), saved."""
    counts = saved(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document (see above)."""
    both = aligned(docs, a_path, b_path, id_col, text_col)
    pairs = both.where("pair_a is not null").select("batch", F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("number", "pair"))
    pairs = pairs.select("batch", "number", F.col("pair.pair_a").alias("a"), F.col("pair.pair_b").alias("b"), F.col("pair.pair_n").alias("n"))
    told = pairs.join(pair_counts(pairs), ["a", "b"]).select(F.col("batch").alias("of"), "number", "count", "best")
    rows = both.where("pair_a is null").drop("pair_a", "pair_b", "pair_n")
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept) + ", n_best long, count_sum long, groups_sha256 string"

    def score(own: pa.Table, pairs: pa.Table) -> pa.Table:
        number = pairs.column("number").to_numpy()
        count, best = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        count[number], best[number] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
        # all documents' pair numbers lie in one array: sums of steps that begin anew with each document
        steps, times = (own.column(c).combine_chunks() for c in ("steps", "times"))
        n = pa.compute.list_value_length(steps).to_numpy()
        at, of = np.cumsum(steps.flatten().to_numpy().astype(np.int64)), times.flatten().to_numpy().astype(np.int64)
        begin = np.cumsum(n) - n
        at = at - np.repeat(np.append(0, at)[begin], n)
        total = lambda x: np.diff(np.append(0, np.cumsum(x[at] * of))[np.append(begin, len(at))])
        sums = [total(best), total(count)]
        out = own.select(kept).append_column("n_best", pa.array(sums[0], pa.int64())).append_column("count_sum", pa.array(sums[1], pa.int64()))
        return out.append_column("groups_sha256", own.column("groups_sha256"))

    return rows.groupBy("batch").cogroup(told.groupBy("of")).applyInArrow(score, schema)
