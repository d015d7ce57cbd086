"""Operator 11: embedding near-duplicates by spherical-cap filters of structured random product codes.

Each of CODES codes rotates the space at random, cuts it into blocks, and has some random directions for each block; a
filter is one direction of every block, joined. A vector belongs to all filters whose direction it exceeds: its cosine
with it is at least the cap's height. They are listed by decoding: the blocks' products are sorted, and partial sums that the
rest cannot lift to the height are left out, so filters it is not in cost next to nothing. Two vectors meet in the filters they
share, where their cosine is computed in double precision.

The height is such that a filter would hold about SIZE vectors, were they spread evenly, and the number of filters is
such that a pair just at the limit shares SHARED of them on average; a pair that shares none is missed. Of 8,000 pairs at a cosine of exactly 0.9 in 64
dimensions 0, 2, 3 and 27 were missed with the filters for 2,000, 10,000, 50,000 and 5,000,000 vectors, nearer pairs more rarely. Both follow from the number of vectors by one formula at every size.

Equal vectors are one vector with its number of copies throughout. A filter with more than BLOCK vectors is dealt into
blocks of that size, and each pair of blocks is a group of its own, so no group is larger than two blocks, however
many vectors are near each other. No pair leaves its group: a pair counts in the least filter that both share, so each
group adds up its vectors' partners and sends one row a vector: that sum, and one link to the least vector of its part of
the group. Near each other or not, all vectors of a filter are compared, as the number of partners is asked for.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and neither do vectors of
different length. Each row is a vector of its own, also with a repeated or null id; a null id is never a component's name: if a
component has no other, its name is null and ``kept`` false. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved
from .components import components

LIMIT = 0.9
#: Vectors that a filter holds if all are spread evenly, filters that a pair at the limit shares, codes, vectors of a block.
SIZE, SHARED, CODES, BLOCK = 256, 14.0, 16, 256


def caps(height: np.ndarray, dims: int) -> np.ndarray:
    """The share of the sphere in ``dims`` dimensions above a height, for each height."""
    x = np.linspace(-1.0, 1.0, 20_001)
    mass = np.cumsum(np.maximum(1 - x * x, 0) ** (max(dims - 3, 0) / 2))
    return 1 - np.interp(height, x, mass / mass[-1])


def shared_part(height: float, dims: int, limit: float) -> float:
    """The chance that a vector at cosine ``limit`` of one in a cap is in that cap, too."""
    x = np.linspace(height, 1.0, 2_001)[:-1]
    weight = np.maximum(1 - x * x, 1e-300) ** (max(dims - 3, 0) / 2)
    other = (height - limit * x) / np.sqrt(np.maximum((1 - limit * limit) * (1 - x * x), 1e-300))
    return float((caps(np.clip(other, -1, 1), max(dims - 1, 1)) * weight).sum() / weight.sum())


class ProductCode:
    """The codes for vectors of one length in a table of ``count`` vectors; the same for everyone who asks."""

    def __init__(self, dims: int, count: int, limit: float):
        rng = np.random.default_rng([dims, 11])
        heights = np.linspace(0.02, 0.98, 961)
        self.height = float(np.interp(min(0.3, SIZE / max(count, 1)), caps(heights, dims)[::-1], heights[::-1]))
        wanted = SHARED / max(shared_part(self.height, dims, limit), 1e-6) / CODES / float(caps(np.array([self.height]), dims)[0])
        self.blocks = min(max(2, int(np.ceil(np.log(wanted) / np.log(512)))), max(1, dims // 12))
        self.words = int(np.ceil(wanted ** (1 / self.blocks)))
        self.rotations, self.code = [], []
        cut = np.array_split(np.arange(dims), self.blocks)
        for _ in range(CODES):
            self.rotations.append(np.linalg.qr(rng.standard_normal((dims, dims)))[0])
            code = []
            for own in cut:
                c = rng.standard_normal((self.words, len(own)))
                code.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(self.blocks))
            self.code.append(code)
        self.cut = cut

    def filters(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of unit vectors (rows): the row and the filter's number, for all filters they exceed."""
        rows, found = [], []
        for k, (rotation, code) in enumerate(zip(self.rotations, self.code, strict=True)):
            turned = unit @ rotation
            products = [turned[:, own] @ c.T for own, c in zip(self.cut, code, strict=True)]
            best = np.array([p.max(1) for p in products])
            rest = np.cumsum(best[::-1], 0)[::-1]
            at = np.arange(len(unit))
            total, number = np.zeros(len(unit)), np.full(len(unit), k, np.int64)
            for block, p in enumerate(products):
                order = np.argsort(-p, axis=1, kind="stable")
                p = np.take_along_axis(p, order, 1)
                need = self.height - total - (rest[block + 1][at] if block + 1 < len(products) else 0)
                many = (p[at] >= need[:, None]).sum(1)  # they come first
                ends = np.cumsum(many)
                step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many)
                up = np.repeat(np.arange(len(at)), many)
                total, number, at = total[up] + p[at[up], step], number[up] * self.words + order[at[up], step], at[up]
            rows.append(at)
            found.append(number)
        return np.concatenate(rows), np.concatenate(found)


@lru_cache(maxsize=8)
def product_code(dims: int, count: int, limit: float) -> ProductCode:
    return ProductCode(dims, count, limit)


def unit_rows(packed: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length as rows of length 1."""
    x = np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def packed_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """vec_id, key (a hash of the bytes; null: links with nothing) and packed, saved; and the numbers' kind."""
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"

    @F.pandas_udf("key binary, packed binary")
    def pack(rows: pd.Series) -> pd.DataFrame:
        out = []
        for v in rows:
            x = np.zeros(0) if v is None else np.asarray([np.nan if e is None else e for e in v] if getattr(v, "dtype", None) == object else v, kind)
            fits = len(x) and np.isfinite(x).all() and x.any()
            raw = x.tobytes() if fits else None
            out.append((hashlib.blake2b(raw, digest_size=16).digest() if fits else None, raw))
        return pd.DataFrame(out, columns=["key", "packed"])

    cast = F.col(vector_col) if kind == "<f4" else F.col(vector_col).cast("array<double>")
    return saved(vectors.select(F.col(id_col).alias("vec_id"), pack(cast).alias("own")).select("vec_id", "own.*"), "vectors"), kind


def local_roots(links: np.ndarray) -> np.ndarray:
    """The least index that each row of a symmetric matrix of links reaches."""
    root = np.arange(len(links))
    while True:
        new = np.minimum(root, np.where(links, root[None, :], len(links)).min(1, initial=len(links)))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def partners(distinct: DataFrame, kind: str, count: int, limit: float) -> DataFrame:
    """key, links (to vectors of other keys), other (a key in the same component, or null): rows of groups, to be summed; saved."""

    @F.pandas_udf("array<long>")
    def listed(packed: pd.Series) -> pd.Series:
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(packed)
        for size, own in pd.Series(range(len(packed))).groupby(packed.str.len().to_numpy()):
            code = product_code(size // np.dtype(kind).itemsize, count, limit)
            for at in range(0, len(own), 500):
                part = own.iloc[at : at + 500].tolist()
                row, number = code.filters(unit_rows([packed.iloc[i] for i in part], kind))
                order = np.lexsort((number, row))
                for i, numbers in zip(part, np.split(number[order], np.cumsum(np.bincount(row, minlength=len(part)))[:-1]), strict=True):
                    out[i] = numbers
        return pd.Series(out)

    owned = saved(distinct.withColumn("filters", listed("packed")).withColumn("size", F.length("packed")), "filters")
    exploded = owned.select("key", "size", F.explode("filters").alias("filter"))
    loads = exploded.groupBy("size", "filter").agg(F.count("*").alias("load")).where("load > 1")
    # a vector's filters that hold another one: light rows, so that vectors themselves are sent once
    useful = exploded.join(loads, ["size", "filter"]).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("filter", "load"))).alias("of"))
    rows = owned.drop("filters").join(useful, "key").select("key", "copies", "packed", "size", F.col("of.filter").alias("filters"), F.posexplode("of").alias("at", "f"))
    blocks = F.ceil(F.col("f.load") / BLOCK).cast("int")
    below = F.slice("filters", F.lit(1), F.col("at"))  # what a group has to know of a vector's other filters
    rows = rows.select("key", "copies", "packed", below.alias("below"), "size", F.col("f.filter").alias("filter"), blocks.alias("blocks"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key", "filter"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("key", "copies", "packed", "below", "size", "filter", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))

    def compare(own: pd.DataFrame) -> pd.DataFrame:
        unit = unit_rows(own["packed"].tolist(), kind)
        near = unit @ unit.T >= limit
        np.fill_diagonal(near, False)
        here = np.flatnonzero(near.any(1))
        if not len(here):
            return pd.DataFrame({"key": [], "links": [], "other": []})
        near, own = near[np.ix_(here, here)], own.iloc[here]
        keys, copies, block = own["key"].tolist(), own["copies"].to_numpy(), own["block"].to_numpy()
        # filters below this one that two of the rows share: there the pair is counted
        below = own["below"].tolist()
        at = np.repeat(np.arange(len(below)), [len(f) for f in below])
        _, column, held = np.unique(np.concatenate(below), return_inverse=True, return_counts=True)
        number = np.where(held > 1, np.cumsum(held > 1) - 1, -1)[column]
        member = np.zeros((len(below), int((held > 1).sum())), np.float32)
        member[at[number >= 0], number[number >= 0]] = 1
        once = near & (member @ member.T < 0.5)
        if own["low"].iloc[0] != own["high"].iloc[0]:
            once &= block[:, None] != block[None, :]  # pairs within a block meet in its own group
        root = local_roots(near)
        return pd.DataFrame({"key": keys, "links": once @ copies, "other": [keys[r] if r != i else None for i, r in enumerate(root.tolist())]})

    return saved(rows.groupBy("size", "filter", "low", "high").applyInPandas(compare, "key binary, links long, other binary"), "partners")


def near_duplicates(vectors: DataFrame, limit: float = LIMIT, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of each vector (see above)."""
    of, kind = packed_vectors(vectors, id_col, vector_col)
    distinct = of.where("key is not null").groupBy("key").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("packed").alias("packed"))
    distinct = saved(distinct, "distinct")
    found = partners(distinct.select("key", "copies", "packed"), kind, distinct.count(), limit)
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    told = distinct.select("key", "copies", "least").join(links, "key", "left").join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))
    names = told.groupBy("root").agg(F.min("least").alias("component_id"))
    told = told.join(names, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    out = of.select("vec_id", "key").join(told, "key", "left")
    alone = F.col("key").isNull()
    out = out.select("vec_id", F.when(alone, F.lit(0).cast("long")).otherwise(F.col("n_links")).alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
