"""Components of documents whose sets of word shingles have a Jaccard similarity of at least 0.8.

Candidates come from SimHash (``simhash.segment_clusters``): a set's fingerprint is a ring of 160 segments of 16 bits, and two
sets meet if a segment is equal and the chain of four segments behind it differs in few bits. At 0.8 a bit differs with a probability of
0.152, a segment is equal with 0.0717 and its chain passes with 0.99, so such a pair is missed with a probability of (1 - 0.071)^160, some 8e-6, and
a nearer one more rarely. In small sets more bits differ (0.1875 for four shingles of five), so sets of up to 40 shingles have two rings. A
single fingerprint searched by its whole distance cannot do this: of 128 bits about 19 differ (standard deviation 4).
Every pair that meets is then confirmed on the whole sets.

Sets that are equal are one set throughout. What meets comes as clusters, in number of rows bound to their members; large clusters are first compared with one
set each, drawn anew in every round, and what that joins need not meet again. After each round sets go that cannot be similar to anything
left: a shingle that stands in one component alone is in no common part, so the rest of a set bounds its common part
with every set of another component. Once rounds help no more, the sets that share a cluster and are not yet in one component are
compared by odd sketches (a bit for each of some four times as many places as a set has shingles: whether an odd number of them falls
there). Two sets differ in at least as many shingles as their sketches in bits, so a pair whose sketches are too far apart is not
similar, and nothing is lost by leaving it out. Sketches are some 16 times smaller than sets. Pairs of clusters up to SMALL sets are made by a
join; a larger one is compared where its sketches lie, in pairs of blocks of BLOCK sets, which send only the pairs the bound lets pass, and of
these none that meets at an earlier segment and so in another cluster: near copies share many. Whole sets meet for those alone. Nothing is capped: what sketches are compared in the end grows with the square of the
sets of a cluster that neither rounds could join nor the bound part, what is confirmed with the pairs that are similar or nearly so. Sets
that share a segment by chance are compared by their chains in one task a key, two words a set: that grows with the square of the
sets, some sets * sets / 65,536 * 80 comparisons of a word.

Words and shingles are those of ``simhash.shingle_hashes`` (a shingle stands as its XXH64). Texts without words are
equal to each other and similar to nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved
from .components import components
from .simhash import earlier_in_run, met_before, mixed, prefixes, segment_clusters, shingle_hashes, whole_groups, wide_print

#: Sets of a cluster whose pairs are made by a join (at most two and a half a row), of a block of a larger one; pairs and 64-bit words of sketches that are compared at once.
SMALL, BLOCK, PAIRS, WORDS = 6, 512, 500_000, 2_000_000
#: What rows of two blocks of a cluster have in common.
DEALT = ["key", "low", "high"]
#: Rounds go on while the pairs left outnumber the rows by so much, and the last round took at least this share of them.
MANY, TAKEN = 40, 0.5


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def set_id(shingles: np.ndarray) -> str:
    return hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=16).hexdigest()


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each of 64 places a word; words are a power of two, at least one for 16 shingles."""
    words = max(2, 1 << max(0, (len(shingles) - 1) // 16).bit_length())
    place = mixed(shingles ^ np.uint64(0x0DD)) & np.uint64(64 * words - 1)
    odd = np.bincount(place.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """The sketches (rows) as they would be with fewer words."""
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, words), axis=1)


def with_prints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, set_id, sid (a part of it), size (of the set), print (its SimHash; empty without shingles) and sketch of each document."""

    @F.pandas_udf("set_id string, sid long, size long, print binary, sketch array<long>")
    def prints(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for s in (shingle_set(t, width) for t in texts):  # one set at a time in memory
            name = set_id(s)
            rows.append((name, int.from_bytes(bytes.fromhex(name[:16]), "little", signed=True), len(s), wide_print(s).astype("<u8").tobytes() if len(s) else b"", odd_sketch(s)))
        return pd.DataFrame(rows, columns=["set_id", "sid", "size", "print", "sketch"])

    return docs.withColumn("_own", prints("text")).select("doc_id", "_own.*")


def with_shingles(docs: DataFrame, width: int) -> DataFrame:
    @F.pandas_udf("set_id string, shingles array<long>")
    def whole(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, width) for t in texts]
        return pd.DataFrame({"set_id": [set_id(s) for s in sets], "shingles": [s.view(np.int64) for s in sets]})

    return docs.withColumn("_own", whole("text")).select("_own.*")


def close_sizes(a: str, b: str):
    """Whether sets of these sizes can be similar at all: 0.8 <= least / greatest."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def bounded_pairs(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """a, b: set ids of the pairs (sids a, b, and most: what they can have in common) whose sizes and sketches (sid, set_id, size, sketch) do not rule out that they are similar.

    Sketches of other sizes tell nothing here.
    """
    of = lambda c: sketches.select(F.col("sid").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("set_id", "size", "sketch")])
    both = pairs.join(of("a"), "a").join(of("b"), "b").where(close_sizes("size_a", "size_b") & (9 * F.col("most") >= 4 * (F.col("size_a") + F.col("size_b"))))
    far = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    near = both.where((F.size("sketch_a") != F.size("sketch_b")) | (9 * far <= F.col("size_a") + F.col("size_b")))
    return near.select(F.least("set_id_a", "set_id_b").alias("a"), F.greatest("set_id_a", "set_id_b").alias("b"))


def sketches_near(sketches: pd.Series, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sketches of rows a and b do not rule out that their sets are similar."""
    words, place, near = sketches.str.len().to_numpy(), np.zeros(len(sketches), np.int64), np.zeros(len(a), bool)
    stacked = {}
    for own in np.unique(words):
        rows = np.flatnonzero(words == own)
        stacked[own], place[rows] = np.stack(sketches.iloc[rows].to_list()).view(np.uint64), np.arange(len(rows))
    for one in stacked:
        for other in stacked:
            pairs = np.flatnonzero((words[a] == one) & (words[b] == other))
            few = min(one, other)
            x, y = folded(stacked[one], few), folded(stacked[other], few)
            step = max(1, WORDS // int(few))
            for at in range(0, len(pairs), step):
                some = pairs[at : at + step]
                far = np.bitwise_count(x[place[a[some]]] ^ y[place[b[some]]]).sum(-1, dtype=np.int64)
                near[some] = 9 * far <= size[a[some]] + size[b[some]]
    return near


def near_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """a, b: of rows in order of DEALT (two blocks of one cluster, or one block), the pairs of different components that may be similar.

    A pair that meets at a segment before its cluster's first place is left to the cluster it shares there, so it hardly ever comes twice.
    """
    for own in whole_groups(batches, DEALT):
        begin = np.flatnonzero(np.append(True, (own[DEALT].iloc[1:].to_numpy() != own[DEALT].iloc[:-1].to_numpy()).any(axis=1)))
        size, shared, block, place = (own[c].to_numpy(np.int64) for c in ("size", "shared", "block", "place"))
        across, comp, ids = (own["low"] != own["high"]).to_numpy(), pd.factorize(own["comp"])[0], own["set_id"].to_numpy()
        first = prefixes(own["first"])
        for a, b in earlier_in_run(begin, len(own), PAIRS):
            total = size[a] + size[b]
            may = (5 * np.minimum(size[a], size[b]) >= 4 * np.maximum(size[a], size[b])) & (9 * np.minimum(shared[a], shared[b]) >= 4 * total)
            may &= (comp[a] != comp[b]) & (~across[a] | (block[a] != block[b]))
            a, b = a[may], b[may]
            near = sketches_near(own["sketch"], size, a, b)
            a, b = a[near], b[near]
            new = ~met_before(first, a, b, place[a])
            if new.any():
                x, y = ids[a[new]], ids[b[new]]
                yield pd.DataFrame({"a": np.where(x < y, x, y), "b": np.where(x < y, y, x)}, dtype=object)


def pairs_by_sketch(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """a, b of all clusters, once each; ``rows``: key, sid, comp, shared, place, n (sets of the cluster, or more), ``sketches``: sid, set_id, size, sketch, print."""
    rows = rows.select("key", "sid", "comp", "shared", "place", "n")
    few = rows.where(F.col("n") <= SMALL).select("key", "sid", "comp", "shared")
    other = few.select("key", *[F.col(c).alias(f"other_{c}") for c in ("sid", "comp", "shared")])
    pairs = few.join(other, "key").where((F.col("sid") < F.col("other_sid")) & (F.col("comp") != F.col("other_comp")))
    pairs = bounded_pairs(pairs.select(F.col("sid").alias("a"), F.col("other_sid").alias("b"), F.least("shared", "other_shared").alias("most")).distinct(), sketches)
    many = rows.where(F.col("n") > SMALL)
    one = many.where(F.col("n") <= BLOCK).withColumns({c: F.lit(0) for c in ("block", "low", "high")})
    more = many.where(F.col("n") > BLOCK).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    more = more.withColumn("block", F.pmod(F.xxhash64("sid", "key"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
    more = more.withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")})
    dealt = one.unionByName(more.select(one.columns)).join(sketches.select("sid", "set_id", "size", "sketch", "print"), "sid")
    dealt = dealt.select(*DEALT, "set_id", "size", "shared", "comp", "block", "place", "sketch", F.expr("substring(print, 1, 2 * place + 8)").alias("first"))
    return pairs.unionByName(dealt.repartition(*DEALT).sortWithinPartitions(*DEALT).mapInPandas(near_pairs, "a string, b string")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of set ids whose similarity is at least 0.8, in whole numbers: 9 common >= 4 (a + b)."""
    pairs = saved(pairs, "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    few = saved(sets.join(ends, "set_id", "left_semi"), "ends")
    of = lambda c: few.hint("merge").select(F.col("set_id").alias(c), F.col("shingles").alias(f"of_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    out = saved(both.where(9 * common >= 4 * (F.size("of_a") + F.size("of_b"))).select("a", "b"), "similar")
    dropped(pairs)
    dropped(few)
    return out


def mixed_bands(rows: DataFrame) -> DataFrame:
    """``rows`` without the clusters whose sets are all in one component, saved."""
    several = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    return saved(rows.join(several, "key", "left_semi"), "bands")


def with_component(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the column comp made anew, in mixed clusters."""
    roots = components(links)
    return mixed_bands(rows.drop("comp").join(roots, F.col("set_id") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "set_id")).drop("node", "root"))


def pairs_left(rows: DataFrame) -> tuple[float, int]:
    """Pairs of sets of different components that share a cluster, once a cluster, and the rows."""
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.expr("n * cast(n as double)")).alias("within"))
    n = sizes.agg(F.sum(F.expr("(n * cast(n as double) - within) / 2")), F.sum("n")).first()
    return n[0] or 0.0, n[1] or 0


def may_be(other: str):
    """Whether sets may be similar, by their sizes and by their ``shared`` shingles: the common part is no larger."""
    most = F.least("shared", f"{other}shared")
    return close_sizes("size", f"{other}size") & (9 * most >= 4 * (F.col("size") + F.col(f"{other}size")))


def bounded(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """The rows whose set may be similar to one of another component; ``shared`` counts the shingles that stand in several components.

    A common part is no larger than that, and the other set no smaller than the least of the cluster and 0.8 of this one.
    """
    each = whole.join(rows.select("set_id", "comp").distinct(), "set_id").select("set_id", "comp", F.explode("shingles").alias("shingle"))
    several = each.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("shingle")
    shared = each.join(several, "shingle", "left_semi").groupBy("set_id").agg(F.count("*").alias("shared"))
    least = rows.groupBy("key").agg(F.min("size").alias("least"))
    may = rows.drop("shared").join(shared, "set_id").join(least, "key").where("45 * shared >= 20 * size + 4 * greatest(5 * least, 4 * size)")
    return mixed_bands(may.drop("least"))


def rounds(rows: DataFrame, links: DataFrame, whole: DataFrame, sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and links after rounds in which the sets of each cluster meet one of them, and those that can meet none go.

    Rows without set_id and size get them for the first round; without one they do without.
    """
    before, step = float("inf"), 0
    while True:
        left, n = pairs_left(rows)
        if left <= MANY * n or left > (1 - TAKEN) * before:
            return rows, links
        if "size" not in rows.columns:
            rows = rows.drop("comp", "shared").join(sketches.select("sid", "set_id", "size"), "sid").withColumns({"comp": F.col("set_id"), "shared": F.col("size")})
        drawn = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("set_id", F.lit(step)), "sid", "size", "comp", "shared")).alias("one"))
        pairs = rows.join(drawn, "key").where((F.col("comp") != F.col("one.comp")) & may_be("one."))
        pairs = pairs.select(F.least("sid", "one.sid").alias("a"), F.greatest("sid", "one.sid").alias("b"), F.least("shared", "one.shared").alias("most")).distinct()
        new = confirmed(bounded_pairs(pairs, sketches), whole)
        links, before, step = links.unionByName(new), left, step + 1
        joined = with_component(rows, links)
        dropped(rows)
        rows = bounded(joined, whole)
        dropped(joined)


def similar_links(docs: DataFrame, of: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """a, b: links that join all sets which are similar."""
    spark = docs.sparkSession
    single = saved(of.select("set_id", "sid", "size", "print", "sketch").dropDuplicates(["set_id"]), "sets")
    met = saved(segment_clusters(single.select("sid", "print")).select("key.*", "sid"), "bands")
    first = met.withColumns({"comp": F.col("sid").cast("string"), "shared": F.lit((1 << 31) - 1).cast("long")})  # nothing is joined, and no bound known
    own = single.join(met.select("sid").distinct(), "sid", "left_semi").select("set_id")
    wanted = saved(sets.join(own, "set_id", "left_semi").select("set_id", "first"), "wanted")
    texts = docs.hint("merge").join(wanted.select("first").distinct(), F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")
    whole = with_shingles(texts, width).join(wanted.select("set_id"), "set_id", "left_semi")
    whole = saved(whole.groupBy("set_id").agg(F.first("shingles").alias("shingles")), "shingles")
    dropped(wanted)
    links = spark.createDataFrame([], "a string, b string")
    rows, links = rounds(first, links, whole, single)
    links = links.unionByName(confirmed(pairs_by_sketch(rows, single), whole))
    for done in (met, rows, whole, single):
        dropped(done)
    return links


def near_copies(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id of each document; the latter is the least id of all that similar pairs lead to, null if there is none."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    of = saved(with_prints(own, width), "sketches")
    sets = saved(of.groupBy("set_id").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(similar_links(own, of, sets, width))
    named = sets.join(roots, F.col("set_id") == F.col("node"), "left").select("set_id", "first", F.coalesce("root", "set_id").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return of.select("doc_id", "set_id").join(named.join(least, "root").select("set_id", "component_id"), "set_id").select("doc_id", "component_id")
