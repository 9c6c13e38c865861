"""Exact top-k inner products by multi-resolution segment statistics.

The distance is the negative inner product of quantised vectors. A vector is
cut into segments; each keeps its mean m and the norm r of its deviations from
it. For two vectors <q, x> <= sum(len * mq * mx + rq * rx), one inner product
of short vectors, so a bound for many pairs is a small matrix product. Coarse
bounds come first, finer ones for what they leave, exact products last; the
k-th best score so far is the bar. Bars only rise and bounds never
underestimate, so nothing is lost.

Queries are broadcast in passes of bounded size; each task keeps its own k best
for each query, which are then merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import docs_of, staged

LEVELS = (4, 16)
ROWS, BLOCK = 4096, 256
#: Bytes of query vectors that one pass broadcasts.
PASS_BYTES = 64 << 20
LOWEST = np.iinfo(np.int64).min


def quantised(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers; what leaves their range is held at its edge."""
    with np.errstate(over="ignore"):
        x = np.floor(flat.astype(np.float64) * scale)
    return np.where(x >= 2.0**63, np.iinfo(np.int64).max, np.where(x < -(2.0**63), LOWEST, np.clip(x, -(2.0**63), 2.0**63 - 1025).astype(np.int64)))


def vectors_by_length(ids: pa.Array, vectors: pa.Array, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and quantised vectors by dimension; those null or with null or non-finite components are left out."""
    out = {}
    good = [i for i, (d, v) in enumerate(zip(ids.is_valid().to_pylist(), vectors.is_valid().to_pylist(), strict=True)) if d and v]
    ids, vectors = ids.take(pa.array(good, pa.int64())), vectors.take(pa.array(good, pa.int64()))
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    values[~flat.is_valid().to_numpy(zero_copy_only=False)] = np.nan
    starts = np.cumsum(sizes) - sizes
    names = ids.to_numpy(zero_copy_only=False).astype(np.int64)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        x = values[starts[rows][:, None] + np.arange(d)]
        fine = np.isfinite(x).all(axis=1)
        out[d] = names[rows[fine]], quantised(x[fine], scale)
    return out


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """One row a vector: its weighted segment means and its deviations' norms, whose inner products are the bounds.

    The last column adds a millionth of a millionth of both norms' product, more than rounding can take away.
    """
    n, d = x.shape
    if not d:
        return np.zeros((n, 1))
    edges = np.unique(np.linspace(0, d, min(segments, d) + 1).astype(int))
    size = np.diff(edges).astype(np.float64)
    x = x.astype(np.float64)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / size
    apart = np.add.reduceat((x - np.repeat(mean, size.astype(int), axis=1)) ** 2, edges[:-1], axis=1)
    return np.concatenate([mean * np.sqrt(size), np.sqrt(apart), 1e-6 * np.sqrt((x**2).sum(axis=1, keepdims=True))], axis=1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of q with the same rows of x."""
    return saturated(q, x, lambda a, b: np.einsum("ij,ij->i", a, b))


def saturated(q: np.ndarray, x: np.ndarray, multiply) -> np.ndarray:
    """multiply(q, x) in floats where they are exact, else in integers of any size, held at the edges of a long."""
    if not q.size or not x.size:
        return multiply(q, x).astype(np.int64)
    most = float(np.abs(q.astype(np.float64)).max()) * float(np.abs(x.astype(np.float64)).max()) * q.shape[1]
    if most < 2.0**53:
        return multiply(q.astype(np.float64), x.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return multiply(q, x)
    wide = multiply(q.astype(object), x.astype(object))
    return np.minimum(np.maximum(wide, LOWEST), np.iinfo(np.int64).max).astype(np.int64)


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.levels = [statistics(vectors, s) for s in LEVELS]
        self.scores = np.full((len(ids), k), LOWEST)
        self.names = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.held = np.zeros(len(ids), np.int64)

    def merge(self, rows: np.ndarray, names: np.ndarray, scores: np.ndarray) -> None:
        touched, back = np.unique(rows, return_inverse=True)
        k = self.k
        old = np.arange(k) < self.held[touched, None]
        r = np.concatenate([np.nonzero(old)[0], back])
        n = np.concatenate([self.names[touched][old], names])
        s = np.concatenate([self.scores[touched][old], scores])
        order = np.lexsort((n, ~s, r))  # ~s falls as s rises, without overflow
        r, n, s = r[order], n[order], s[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        top = place < k
        self.scores[touched[r[top]], place[top]] = s[top]
        self.names[touched[r[top]], place[top]] = n[top]
        self.held[touched] = np.minimum(k, np.bincount(r, minlength=len(touched)))

    def add(self, names: np.ndarray, x: np.ndarray) -> None:
        if not len(x):
            return
        levels = [statistics(x, s) for s in LEVELS]
        for a in range(0, len(self.ids), BLOCK):
            rows = np.arange(a, min(a + BLOCK, len(self.ids)))
            bound = self.levels[0][rows] @ levels[0].T
            other = self.ids[rows, None] != names
            seed = np.flatnonzero(self.held[rows] < self.k)
            if len(seed):  # the likeliest rows by the coarse bound set a first bar
                near = np.argpartition(-np.where(other[seed], bound[seed], -np.inf), min(self.k, len(names)) - 1, axis=1)[:, : self.k]
                i, j = np.repeat(seed, near.shape[1]), near.ravel()
                fine = other[i, j]
                i, j = i[fine], j[fine]
                self.merge(rows[i], names[j], products(self.vectors[rows[i]], x[j]))
                other[i, j] = False
            bar = np.where((self.held[rows] < self.k) | (self.scores[rows, -1] == LOWEST), -np.inf, self.scores[rows, -1].astype(np.float64))
            bar = bar - np.where(np.isfinite(bar), 1e-12 * np.abs(bar), 0)
            i, j = np.nonzero(other & (bound >= bar[:, None]))
            if len(i):
                if len(i) > bound.size // 8:
                    finer = (self.levels[1][rows] @ levels[1].T)[i, j]
                else:
                    finer = np.einsum("ij,ij->i", self.levels[1][rows[i]], levels[1][j])
                left = finer >= bar[i]
                i, j = i[left], j[left]
            if len(i):
                if len(i) > bound.size // 8:
                    scores = saturated(self.vectors[rows], x, lambda q, y: q @ y.T)[i, j]
                else:
                    scores = products(self.vectors[rows[i]], x[j])
                good = (scores >= self.scores[rows[i], -1]) | (self.held[rows[i]] < self.k)
                if good.any():
                    self.merge(rows[i[good]], names[j[good]], scores[good])


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query of each pass, from those of all tasks."""
    order = Window.partitionBy("p", "d", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query among all rows of other ids.

    Ties go to the smaller id; repeated rows count as often as they stand, and
    repeated queries are answered each. Rows with a null id, a null vector, or
    a null or non-finite component take no part; vectors of another length
    than a query's are no candidates for it. Fewer than k candidates are all
    returned; empty tables give no rows; other columns are not read.
    """
    pick = lambda df: df.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{vector_col}`").alias("v")).where("i is not null and v is not null")
    asked = pick(queries)
    size = asked.agg(F.sum(F.size("v") * 8 + 64)).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))
    sc = vectors.sparkSession.sparkContext
    found = None
    for p in range(passes):
        part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == p)
        table = part.toArrow()
        groups = vectors_by_length(table.column("i").combine_chunks(), table.column("v").combine_chunks(), scale) if table.num_rows else {}
        shared = sc.broadcast(groups)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = {d: Best(*g, k) for d, g in shared.value.items()}
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    for d, (names, x) in vectors_by_length(part.column("i"), part.column("v"), scale).items():
                        if d in best:
                            best[d].add(names, x)
            for d, b in best.items():
                q, r = np.nonzero(np.arange(k) < b.held[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), d, np.int64)), pa.array(q), *map(pa.array, (b.ids[q], b.names[q, r], b.scores[q, r]))], names=["d", "q", "query_id", "vec_id", "score"])

        own = pick(vectors).mapInArrow(run, "d long, q long, query_id long, vec_id long, score long").withColumn("p", F.lit(p))
        if passes > 1:  # One pass's queries at a time are held, by the driver and the executors.
            own = staged(ranked(own, k).drop("rank"), "pass")
            shared.destroy()
        found = own if found is None else found.unionByName(own)
    return ranked(found, k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = docs_of(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select * from r where rank <= 5
"""
