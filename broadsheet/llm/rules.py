"""Operator 3: quality rules, judged by an isolation forest over the rules' statistics.

Words are runs of characters other than U+0020 and U+0009 to U+000D. Every statistic covers the whole text:
``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` as the contract has them, and besides
lines, characters and capitals. A document fails the base rules if it has fewer than 20 words or more than
30 % of its words lie in repeated 8-word windows. All others get an isolation-forest score: the mean depth
at which random splits part a row from the rest, over TREES trees of SUBSAMPLE rows each. Rows that are
parted early are anomalous. The forest is fitted on at most TREES * SUBSAMPLE rows labelled good, those of
the least hashed id (a documented bound; the method subsamples by itself). Its cuts fall anywhere in the range
that all labelled rows span: most good rows have no symbol at all, and cuts drawn from their own range alone
would never look at symbols. The threshold is chosen on all labelled rows: the one with the most correct
verdicts, where a good row that is rejected counts COST times.

Null and empty texts have no words, all statistics 0, and fail. Ties do not matter; repeated rows get
repeated results; an empty table gives an empty result. Without usable labels the base rules decide alone.
Labels that contradict each other for one id count as the worse one. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

TREES, SUBSAMPLE, COST, SEED = 100, 256, 3.0, 7
SYMBOLS = "#*$%&|<>"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MORE = "n_lines long, n_chars long, n_upper long"
_FIELDS = [x.split()[0] for x in f"{BASE}, {MORE}".split(", ")]
_ODD = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of ``width`` words that occur twice or more, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = np.zeros(n, np.uint64)
    for k in range(width):
        w = w * _ODD + h[k : k + n]
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    some = np.zeros(n, bool)
    some[order[1:][same]] = True
    some[order[:-1][same]] = True
    at = np.flatnonzero(some).tolist()  # equal hashes; the words themselves decide
    seen: dict[tuple[bytes, ...], int] = {}
    keys = [tuple(words[i : i + width]) for i in at]
    for k in keys:
        seen[k] = seen.get(k, 0) + 1
    edge = np.zeros(len(words) + 1, np.int64)
    hit = np.array([i for i, k in zip(at, keys, strict=True) if seen[k] > 1], np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """The base statistics, then what only the forest uses."""
    if not text:
        return (0,) * len(_FIELDS)
    raw = text.encode()
    words = raw.split()  # bytes are split at exactly these six characters
    lines = [x for x in raw.split(b"\n") if x.strip()]
    blanks = sum(map(text.count, "\x20\x09\x0a\x0b\x0c\x0d"))
    b = np.bincount(np.frombuffer(raw, np.uint8), minlength=128)
    return (
        len(words), len(text) - blanks, int(sum(b[ord(c)] for c in SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), len(text), int(b[65:91].sum()),
    )


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of each document."""

    @F.pandas_udf(f"{BASE}, {MORE}")
    def stats(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics(t) for t in texts], columns=_FIELDS, dtype="int64")

    return docs.select(F.col(id_col).alias("doc_id"), stats(F.col(text_col)).alias("_s")).select("doc_id", "_s.*")


def features(s: pd.DataFrame) -> np.ndarray:
    """What the forest splits on: each row is a document, each column a rate."""
    n = np.maximum(s["n_words"].to_numpy(float), 1)
    lines, chars = np.maximum(s["n_lines"].to_numpy(float), 1), np.maximum(s["n_chars"].to_numpy(float), 1)
    return np.column_stack([np.sqrt(s["n_symbols"] / n), s["n_dup_lines"] / lines, s["n_repeat_words"] / n, s["n_upper"] / chars]).astype(np.float64)


def _mean_depth(n: np.ndarray | float) -> np.ndarray | float:
    """The mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees as flat arrays: feature (-1 at a leaf), cut, left child, and the depth that a leaf stands for."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], size: int):
        self.trees, self.size = trees, size

    @classmethod
    def fit(cls, x: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> IsolationForest:
        """Trees on the rows of x; ``low`` and ``high`` span the box that cuts are drawn from."""
        rng = np.random.default_rng(seed)
        size = min(subsample, len(x))
        limit = int(np.ceil(np.log2(max(size, 2))))
        out = []
        for _ in range(trees):
            nodes: list[list[float]] = []  # feature, cut, left, depth, right

            def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> int:
                at = len(nodes)
                nodes.append([-1, 0.0, 0, depth + float(_mean_depth(len(rows))), 0])
                can = np.flatnonzero(high > low)
                if depth >= limit or len(rows) < 2 or not len(can):
                    return at
                f = int(rng.choice(can))
                cut = rng.uniform(low[f], high[f])
                top, bottom = high.copy(), low.copy()
                top[f] = bottom[f] = cut
                left = grow(rows[rows[:, f] < cut], low, top, depth + 1)
                right = grow(rows[rows[:, f] >= cut], bottom, high, depth + 1)
                nodes[at][:3], nodes[at][4] = [f, cut, left], right
                return at

            grow(x[rng.choice(len(x), size, replace=False)], low, high, 0)
            out.append((np.array([int(n[0]) for n in nodes]), np.array([n[1] for n in nodes]), np.array([[n[2], n[4]] for n in nodes], np.int64), np.array([n[3] for n in nodes])))
        return cls(out, size)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, higher: parted earlier, more anomalous."""
        total = np.zeros(len(x))
        for f, cut, child, depth in self.trees:
            at = np.zeros(len(x), np.int64)
            inner = np.flatnonzero(f[at] >= 0)
            while len(inner):
                node = at[inner]
                go = (x[inner, f[node]] >= cut[node]).astype(np.int64)
                at[inner] = child[node, go]
                inner = inner[f[at[inner]] >= 0]
            total += depth[at]
        return 2.0 ** (-total / max(len(self.trees), 1) / max(float(_mean_depth(self.size)), 1e-9))


def base_failed(n_words="n_words", n_repeat="n_repeat_words"):
    return (F.col(n_words) < 20) | (100 * F.col(n_repeat) > 30 * F.col(n_words))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, threshold, kept.

    Texts are read once; what follows works on the saved statistics, some hundred bytes a document.
    """
    spark = docs.sparkSession
    stats = saved(text_statistics(docs, id_col, text_col), "rules")
    judged = labels.where(F.col(label).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("_id")).agg(F.min(label).alias("_good"))
    known = stats.join(judged, F.col("doc_id") == F.col("_id")).where(~base_failed()).drop("_id")
    # the forest's sample: bounded by its parameters, the same whatever the partitions
    sample = known.where("_good = 1").orderBy(F.xxhash64(F.col("doc_id").cast("string")), *_FIELDS).limit(TREES * SUBSAMPLE).select(*_FIELDS).toPandas()
    if len(sample) < 2:
        return stats.withColumn("base_failed", base_failed()).withColumns({"score": F.lit(None).cast("double"), "threshold": F.lit(None).cast("double")}).withColumn("kept", ~F.col("base_failed")).select("doc_id", *_FIELDS[:5], "base_failed", "score", "threshold", "kept")

    @F.pandas_udf("array<double>")
    def rates(s: pd.DataFrame) -> pd.Series:
        return pd.Series(list(features(s)))

    ends = known.select(rates(F.struct(*_FIELDS)).alias("r"))
    span = [ends.agg(*[f(F.col("r")[k]).alias(f"r{k}") for k in range(4)]).first() for f in (F.min, F.max)]
    # TREES trees of at most 2 ** (1 + log2(SUBSAMPLE)) nodes
    forest = spark.sparkContext.broadcast(IsolationForest.fit(features(sample), np.array(span[0], float), np.array(span[1], float)))

    @F.pandas_udf("double")
    def anomaly(s: pd.DataFrame) -> pd.Series:
        return pd.Series(forest.value.score(features(s)))

    score = anomaly(F.struct(*_FIELDS))
    # all labelled rows, as counts by score: at most 2 * 4097 rows reach the driver
    bins = known.select(F.round(score * 4096).cast("int").alias("bin"), "_good").groupBy("bin").agg(F.count_if(F.col("_good") == 1).alias("good"), F.count_if(F.col("_good") != 1).alias("bad")).toPandas()
    threshold = float(calibrated(bins))
    out = stats.withColumn("base_failed", base_failed()).withColumn("score", score).withColumn("threshold", F.lit(threshold))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") * 4096 < F.col("threshold"))).select("doc_id", *_FIELDS[:5], "base_failed", "score", "threshold", "kept")


def calibrated(bins: pd.DataFrame) -> float:
    """The score (times 4096) from which rows are rejected, at the least cost; the highest of equals."""
    good, bad = np.zeros(4098), np.zeros(4098)
    np.add.at(good, bins["bin"].to_numpy(int), bins["good"].to_numpy(float))
    np.add.at(bad, bins["bin"].to_numpy(int), bins["bad"].to_numpy(float))
    # rejecting from bin t on loses the good at t and above and misses the bad below t
    cost = COST * np.cumsum(good[::-1])[::-1] + np.append(0, np.cumsum(bad))[:-1]
    return float(len(cost) - 1 - int(np.argmin(cost[::-1]))) - 0.5

