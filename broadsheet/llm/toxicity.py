"""Operator 4: toxicity by maximum-scoring segments.

Tokens are words (runs of letters in lower case, cut into pieces of WORD letters; letters of scripts that are written
without blanks stand alone). A token's score is the log-odds of being in a toxic document against being in any, under a
hierarchical Dirichlet prior: the share of a token is drawn to that of its longest prefix in PREFIXES with a weight
of PRIOR documents, a prefix's to that of the next shorter one, and the shortest to the share of all. So a word never
seen is judged by its stem, and one seen thrice hardly departs from it. Counts are of (document, token) pairs;
within a text a token scores at its first place only, repeats tell nothing new. DRIFT is taken from every score, so
that they fall on average, as the law below asks.

A linear-time scan finds all maximal-scoring segments of a text. Karlin and Altschul's extreme-value law turns a
segment's score S in a text of n tokens into significance, ``z = lambda * S - ln(K * n)``, where lambda solves
``sum p_i exp(lambda * s_i) = 1`` over the clean documents' scores and K is fitted to their best segments. A
document's evidence is the sum of the z of all segments above zero, else its best z, on an inverse hyperbolic sine
scale; a logistic curve fitted on the learnt-from rows makes it the score. These rows are scored as if they had not been
learnt from: each one's own pair is taken out of every count it is scored by.

The model is fitted on at most SAMPLE labelled documents, those of the least hashed ids, and holds at most MAX_NODES
tokens and prefixes, those that depart most from their prefix; both are documented bounds of the model. Every whole text is
scanned. Null texts count as empty; a text without tokens has no segment and gets the score of a text of one clean token.
Ids with contradicting labels count as toxic; null labels are left out. Without labels of both classes the score is the
share of toxic rows, 0 if there are none. Repeated rows get repeated results, an empty table gives an empty result.
Labels, language, source and id are never inputs of a score; the id only says which labelled rows are held out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, fresh, saved, task_over, text_batches

PREFIXES, WORD, PRIOR, DRIFT, MIN_DOCS = (3, 5, 7), 24, 30.0, 0.1, 3
#: Bounds of the model: labelled documents it is fitted on, and tokens and prefixes it holds.
SAMPLE, MAX_NODES = 200_000, 100_000
#: A token or prefix whose score departs from its prefix's by less is left to that one.
LEAST_CHANGE = 0.05
#: Labelled ids up to this number are sent to all tasks (16 bytes each); beyond it the tables are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Counters that a task holds before it hands them on.
HELD = 200_000
_ALONE = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿"
LETTERS = re.compile(rf"[{_ALONE}]|[^\W\d_{_ALONE}]{{1,{WORD}}}")
#: The score of a row that is not, is toxic, or is clean among those learnt from.
PLAIN, TOXIC, CLEAN = 0, 1, 2


@dataclass
class Model:
    nodes: dict[str, int]  # prefixes as they are, whole tokens with a blank behind
    scores: np.ndarray  # of each node: plain, without a toxic pair, without a clean pair
    lam: float = 1.0
    ln_k: float = 0.0
    a: float = 0.0
    b: float = 0.0


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def nodes_of(word: str) -> list[str]:
    """The word's prefixes and itself, from the shortest on."""
    return [*[word[:k] for k in PREFIXES if k < len(word)], word + " "]


def scorer(model: Model, kind: int = PLAIN) -> BoundedCache:
    """The score of each token: that of its longest node that the model holds, 0 if it holds none."""
    nodes, scores = model.nodes, model.scores[:, kind].tolist()

    lengths = PREFIXES[::-1]

    def score(word: str) -> float:
        at = nodes.get(word + " ")
        for k in lengths if at is None else ():
            if k < len(word) and (at := nodes.get(word[:k])) is not None:
                break
        return 0.0 if at is None else scores[at]

    return BoundedCache(score)


def maximal_segments(scores: list[float], places: list[int], before: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score).

    ``places`` are where ``scores`` are positive, ``before`` the sums up to each place and the end. A list of
    candidate segments is kept, each with the sums at its two ends; a new one is joined to the last
    candidate that begins lower, as long as that raises the score. Each is looked at a bounded number of times.
    """
    found: list[list[float]] = []  # [sum before, sum behind, first, end, last candidate that begins lower]
    for p in places:
        new = [before[p], before[p + 1], p, p + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= new[0]:
                j = int(found[j][4])
            if j < 0 or found[j][1] >= new[1]:
                found.append([*new, j])
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(int(f), int(e), r - l) for l, r, f, e, _ in found]


def token_scores(words: list[str], score_of: BoundedCache, every: bool = False) -> np.ndarray:
    """A token's score at its first place, 0 at the others, less DRIFT everywhere; at each place if ``every``."""
    n = len(words)
    if every:
        return np.fromiter(map(score_of.__getitem__, words), float, n) - DRIFT
    out = np.full(n, -DRIFT)
    first = dict(zip(reversed(words), range(n - 1, -1, -1), strict=True))
    out[np.fromiter(first.values(), np.int64, len(first))] += np.fromiter(map(score_of.__getitem__, first), float, len(first))
    return out


def scan(text: str | None, score_of: BoundedCache, every: bool = False) -> tuple[int, list[tuple[int, int, float]]]:
    """(tokens, segments with token positions) of one text. As evidence of a document a word counts once; as a passage it counts wherever it stands (``every``)."""
    words = words_of(text)
    if not words:
        return 0, []
    s = token_scores(words, score_of, every)
    places = np.flatnonzero(s > 0)
    if not len(places):
        return len(words), []
    return len(words), maximal_segments(s, places.tolist(), np.concatenate([[0.0], np.cumsum(s)]))


def _counts(rows: DataFrame) -> DataFrame:
    """node, toxic and other (document, token) pairs that fall under it. Counted in each task, then summed by Spark."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pd.DataFrame:
            names = list(kinds[0].keys() | kinds[1].keys())
            out = pd.DataFrame({"node": pd.Series(names, dtype=object), "other": [kinds[0][w] for w in names], "toxic": [kinds[1][w] for w in names]})
            for k in kinds:
                k.clear()
            return out

        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["_toxic"], strict=True):
                own = kinds[1 if toxic else 0]
                words = set(words_of(text))
                own.update({n for w in words for n in nodes_of(w)})
                own[""] += len(words)
                if len(kinds[0]) + len(kinds[1]) > HELD:
                    yield flush()
        yield flush()

    return rows.mapInPandas(count, "node string, other long, toxic long").groupBy("node").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))


def learnable(labels: DataFrame, label_id: str = "doc_id", label: str = "toxic", folds: int = 5) -> DataFrame:
    """_id, _toxic of the labelled ids that are not held out."""
    return labels.where(F.col(label).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("_id")).agg(F.max(label).cast("int").alias("_toxic")).where(~held_out(F.col("_id"), folds))


def held_out(id_: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % folds == 0, F.lit(False))


def learn(rows: DataFrame) -> Model | None:
    """Token scores from ``rows`` (text, _toxic). None without tokens of both classes."""
    counts = saved(_counts(rows), "toxicity")
    total = counts.where("node = ''").select("toxic", "other").first()
    if total is None or not total[0] or not total[1]:
        return None
    base = total[0] / (total[0] + total[1])
    counts = counts.where((F.col("node") != "") & (F.col("toxic") + F.col("other") >= MIN_DOCS))
    size = F.length(F.rtrim("node"))
    now = counts.withColumn("pairs", F.struct("toxic", "other"))
    for k in PREFIXES:  # whatever falls under a node falls under its prefixes too, so they are there
        own = counts.where(~F.col("node").endswith(" ") & (F.length("node") == k)).select(F.col("node").alias("up"), F.struct("toxic", "other").alias(f"under{k}"))
        now = now.join(own, (F.substring("node", 1, k) == F.col("up")) & (size > k), "left").drop("up")

    def odds(r: Column) -> Column:
        return F.log(r / (1 - r)) - math.log(base / (1 - base))

    scores, changes = [], []
    for toxic_less, other_less in ((0, 0), (1, 0), (0, 1)):  # PLAIN, TOXIC, CLEAN
        rate, above = F.lit(base), None
        for c in [*(F.col(f"under{k}") for k in PREFIXES), F.col("pairs")]:
            t, o = F.greatest(c["toxic"] - toxic_less, F.lit(0)), F.greatest(c["other"] - other_less, F.lit(0))
            above = rate
            rate = (F.coalesce(t, F.lit(0)) + PRIOR * above) / (F.coalesce(t + o, F.lit(0)) + PRIOR)  # without such a prefix: as above
        scores.append(odds(rate))
        changes.append(F.abs(odds(rate) - odds(above)))
    out = now.select("node", F.array(*scores).alias("scores"), F.greatest(*changes).alias("change"))
    top = out.where(F.col("change") >= LEAST_CHANGE).orderBy(F.desc("change"), "node").limit(MAX_NODES).select("node", *[F.col("scores")[k].alias(f"s{k}") for k in range(3)]).toArrow().to_pandas()
    return Model({n: k for k, n in enumerate(top["node"])}, top[["s0", "s1", "s2"]].to_numpy(float))


def extreme_lambda(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1; 1 if scores do not fall on average or never rise."""
    p = p / max(p.sum(), 1e-300)

    def excess(x: float) -> float:
        return float((p * np.exp(x * s)).sum() - 1)

    if not len(s) or float((p * s).sum()) >= 0 or s.max() <= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def clean_scores(rows: DataFrame, model: Broadcast) -> pd.DataFrame:
    """s, n: the tokens' scores in clean rows in steps of 1/50, and how many there are. At most some thousand rows."""

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score_of, total = scorer(model.value, CLEAN), Counter()
        for pdf in batches:
            for text in pdf["text"]:
                words = words_of(text)
                if words:
                    at, n = np.unique(np.rint(token_scores(words, score_of) * 50).astype(np.int64), return_counts=True)
                    total.update(dict(zip(at.tolist(), n.tolist(), strict=True)))
        yield pd.DataFrame({"bin": list(total.keys()), "n": list(total.values())}, dtype="int64")

    out = rows.where("_toxic <> 1").select("text").mapInPandas(bins, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").toPandas()
    return pd.DataFrame({"s": out["bin"] / 50, "n": out["n"]})


def segments_column(text: Column, model: Broadcast, kind: Column | None = None) -> Column:
    """struct(n tokens, segment scores) of each text, scored as rows of ``kind`` (PLAIN if none is given)."""

    @F.pandas_udf("n long, segments array<double>")
    def segments(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        of = {k: scorer(model.value, k) for k in (PLAIN, TOXIC, CLEAN)}  # gone with the task
        for texts, kinds in batches:
            rows = [scan(t, of[k]) for t, k in zip(texts, kinds, strict=True)]
            yield pd.DataFrame({"n": [n for n, _ in rows], "segments": pd.Series([[x[2] for x in found] for _, found in rows], dtype=object)})
        of.clear()
        task_over()

    # so marked, it is not run once for the filter and once more for the column
    return segments.asNondeterministic()(text, F.lit(PLAIN) if kind is None else kind)


def best_z(lam: float, ln_k: float, n: str = "n", segments: str = "segments") -> Column:
    """The evidence of a document: summed z of its significant segments, else the best z."""
    shift = F.lit(ln_k) + F.log(F.greatest(F.col(n), F.lit(1)).cast("double"))
    z = F.transform(segments, lambda s: F.lit(lam) * s - shift)
    over = F.aggregate(F.filter(z, lambda x: x > 0), F.lit(0.0), lambda a, x: a + x)
    return F.when(over > 0, over).otherwise(F.coalesce(F.array_max(z), -shift))


def logistic(x: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a + b x))) by Newton's method on counts, with a small ridge."""
    a, b, total = 0.0, 0.0, pos + neg
    mean, spread = float(np.average(x, weights=total)), float(np.sqrt(np.average((x - np.average(x, weights=total)) ** 2, weights=total))) or 1.0
    u = (x - mean) / spread
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a + b * u, -35, 35)))
        w = np.maximum(total * p * (1 - p), 1e-9)
        g0, g1 = (pos - total * p).sum(), ((pos - total * p) * u).sum() - 1e-2 * b
        h00, h01, h11 = w.sum() + 1e-6, (w * u).sum(), (w * u * u).sum() + 1e-2
        det = h00 * h11 - h01 * h01
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        step = min(1.0, 4 / max(abs(da), abs(db), 1e-12))
        a, b = a + step * da, b + step * db
        if max(abs(da), abs(db)) < 1e-9:
            break
    b = max(b, 0.0)
    return a - b * mean / spread, b / spread


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label: str = "toxic", folds: int = 5) -> Model | float:
    """The model of the labelled documents that may be learnt from; a constant score if these lack a class."""
    text_batches(docs)
    train = learnable(labels, label_id, label, folds).orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(SAMPLE)
    train = saved(train, "train")
    n_train, n_toxic = train.agg(F.count("*"), F.coalesce(F.sum("_toxic"), F.lit(0))).first()
    constant = n_toxic / n_train if n_train else 0.0
    side = F.broadcast(train) if n_train <= BROADCAST_IDS else train
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).join(side, F.col("_doc") == F.col("_id")).select("text", "_toxic")
    rows = saved(rows, "learnt-from")  # at most the sample's texts and their copies: the corpus is read once to find them
    model = learn(rows)
    if model is None:
        return constant
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_NODES tokens and prefixes
    clean = clean_scores(rows, shared)
    model.lam = extreme_lambda(clean["n"].to_numpy(float), clean["s"].to_numpy(float))
    kind = F.when(F.col("_toxic") == 1, TOXIC).otherwise(CLEAN)
    known = saved(rows.select("_toxic", segments_column(F.col("text"), shared, kind).alias("_s")).select("_toxic", "_s.*"), "segments")
    # method of moments on the clean documents' best segments
    best = F.lit(model.lam) * F.coalesce(F.array_max("segments"), F.lit(0.0)) - F.log(F.greatest("n", F.lit(1)).cast("double"))
    model.ln_k = float(known.where("_toxic <> 1 and n > 0").agg(F.coalesce(F.avg(best), F.lit(0.0))).first()[0]) - float(np.euler_gamma)
    # all rows that may be learnt from, as counts by evidence: some hundred rows reach the driver
    bins = known.select(F.round(evidence(model) * 20).cast("int").alias("bin"), "_toxic").groupBy("bin").agg(F.count_if(F.col("_toxic") == 1).alias("pos"), F.count_if(F.col("_toxic") != 1).alias("neg")).orderBy("bin").toPandas()
    shared.unpersist()
    if not len(bins):
        return constant
    model.a, model.b = logistic(bins["bin"].to_numpy(float) / 20, bins["pos"].to_numpy(float), bins["neg"].to_numpy(float))
    return model


def evidence(model: Model, n: str = "n", segments: str = "segments") -> Column:
    return F.asinh(best_z(model.lam, model.ln_k, n, segments))


def with_score(docs: DataFrame, model: Model | float, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the score in a column ``name``: a narrow map over the documents."""
    if not isinstance(model, Model):
        return docs.withColumn(name, F.lit(model))
    found = fresh(docs.columns, "_segments")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.withColumn(found, segments_column(F.col(f"`{text_col}`"), shared))
    x = evidence(model, f"{found}.n", f"{found}.segments")
    return out.withColumn(name, 1 / (1 + F.exp(-(F.lit(model.a) + F.lit(model.b) * x)))).drop(found)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label: str = "toxic", folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of each document. All texts are read once to find the labelled ones and once to be scored."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = with_score(own, fit(own, labels, "doc_id", "text", label_id, label, folds), "score")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose score is below 0.5, with all their columns."""
    name = fresh(docs.columns, "_score")
    return with_score(docs, fit(docs, labels, id_col, text_col), name, text_col).where(F.col(name) < 0.5).drop(name)


def toxic_segments(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", min_z: float = 0.0) -> DataFrame:
    """doc_id, first, end (in tokens), score, z of every passage more significant than ``min_z``, by a model of ``fit``; repeated passages are all found."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<first: long, end: long, score: double, z: double>>")
    def passages(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, score_of = shared.value, scorer(shared.value)
        for texts in batches:
            rows = []
            for t in texts:
                n, found = scan(t, score_of, every=True)
                z = [m.lam * s - m.ln_k - math.log(max(n, 1)) for _, _, s in found]
                rows.append([{"first": f, "end": e, "score": s, "z": x} for (f, e, s), x in zip(found, z, strict=True) if x > min_z])
            yield pd.Series(rows, dtype=object)

    return docs.select(F.col(id_col).alias("doc_id"), F.explode(passages(F.col(text_col))).alias("_p")).select("doc_id", "_p.*")
