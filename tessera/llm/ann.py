"""Approximate nearest neighbours by collision counting (query-aware hashing).

Vectors are projected on single lines, each kept as one sorted array. A query opens
a window around its own projection on every line; by virtual rehashing the windows
grow by a factor until enough vectors collide with the query on at least a
threshold of the lines. Those are verified with the exact measure. Largest inner
product becomes nearest distance by one more coordinate, sqrt(M^2 - |x|^2) for the
largest norm M, which is 0 for queries. Vectors of like norms make a range with an M of
its own: one long vector would stretch that coordinate for all.

Lines come in orthogonal sets, each a random basis of the space: counts then scatter far
less than on independent lines, so that few vectors need to be verified (figures in the README).

The table is cut into blocks; a block of queries meets a block of vectors in one group,
so both sides of a task are bounded. One array over all vectors for each line, with
queries that travel to their windows, would be the other way to deal the work. It only pays
where windows are narrow: vectors without clusters need windows of most of a line, and
every collision would be shuffled (about 0.3 x lines x queries x vectors rows).
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table

#: So many lines at least, and so many whole sets of them: a set has as many lines as the space has dimensions, and fewer would not see all of it.
LINES, SETS = 192, 2
THRESHOLD = 0.85
GROWTH = 1.02
#: Windows stop growing when so many times the neighbours asked for, and this share of the block besides, are candidates.
CANDIDATES = 4
FALSE_POSITIVES = 0.03
#: Vectors and queries of a group; wide vectors have so many places on all lines together at most.
BLOCK_ROWS, QUERY_ROWS = 16384, 65536
BLOCK_PLACES = 1 << 24
#: Lines that are projected on at once.
AT_ONCE = 256
#: Within a range of norms the largest is at most so many times the least, so that the added coordinate does not hide the angles.
NORM_RATIO = 1.1


@lru_cache(maxsize=2)
def orthogonal_lines(width: int, seed: int) -> np.ndarray:
    """LINES and more lines of length sqrt(width): whole random orthonormal bases, one after the other, made once a worker."""
    rng, bases = np.random.default_rng(seed), []
    for _ in range(max(SETS, -(-LINES // width))):
        bases.append(np.linalg.qr(rng.standard_normal((width, width)))[0].T * math.sqrt(width))
    return np.concatenate(bases)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """By a power of two, so that the largest component is below 1: squares neither overflow nor vanish with the whole."""
    largest = float(np.abs(vectors).max(initial=0.0))
    return np.ldexp(vectors, -math.frexp(largest)[1]) if largest else vectors


class Index:
    """The sorted projections of a block of vectors, which are scaled."""

    def __init__(self, vectors: np.ndarray, largest: float, seed: int = 42):
        self.vectors, self.largest, self.n = vectors, largest, len(vectors)
        self.lines = orthogonal_lines(vectors.shape[1] + 1, seed)
        self.n_lines = len(self.lines)
        extra = np.sqrt(np.maximum(0.0, largest**2 - (vectors**2).sum(1)))
        self.order = np.empty((self.n_lines, self.n), np.int32)
        held = np.empty((self.n_lines, self.n))
        sample = []
        for at in range(0, self.n_lines, AT_ONCE):
            some = slice(at, at + AT_ONCE)
            projected = self.lines[some, :-1] @ vectors.T + self.lines[some, -1:] * extra
            self.order[some] = np.argsort(projected, axis=1)
            held[some] = np.take_along_axis(projected, self.order[some], 1)
            sample.append(projected[:, :: max(1, self.n // 32)].copy())
        # Lines end to end, shifted apart, so that one search finds the windows on all of them.
        self.bound = float(np.abs(held).max()) + 0.25
        self.shift = np.arange(self.n_lines) * (4.0 * self.bound)
        held += self.shift[:, None]
        self.flat = held.ravel()
        self.sample = np.concatenate(sample)

    def _windows(self, projection: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """First and last place (exclusive) of each line's window."""
        first = np.arange(self.n_lines) * self.n
        low = self.flat.searchsorted(np.clip(projection - width, -self.bound, self.bound) + self.shift) - first
        high = self.flat.searchsorted(np.clip(projection + width, -self.bound, self.bound) + self.shift, "right") - first
        return np.clip(low, 0, self.n), np.clip(high, 0, self.n)

    def candidates(self, query: np.ndarray, enough: int) -> np.ndarray:
        """Places of the vectors whose collisions reach the threshold when ``enough`` do (all, if the windows come to cover the block).

        ``query`` is scaled to the largest norm, which does not change its order of inner products.
        """
        if enough >= self.n:
            return np.arange(self.n)
        projection = self.lines[:, :-1] @ query
        spared = self.n_lines - math.ceil(THRESHOLD * self.n_lines)
        # Start where a line's window holds a share that lets few vectors over the threshold.
        share = THRESHOLD - 2.5 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / self.n_lines)
        width = max(float(np.quantile(np.abs(self.sample - projection[:, None]), share)), 1e-6 * self.bound)
        low, high = self._windows(projection, width)
        # Windows cover most of a line, so what lies outside is counted: collisions are the lines less these.
        parts = [x for line, a, b in zip(self.order, low.tolist(), high.tolist()) for x in (line[:a], line[b:])]
        outside = np.bincount(np.concatenate(parts), minlength=self.n)
        while True:
            found = np.flatnonzero(outside <= spared)
            if len(found) >= enough or (low.max() == 0 and high.min() == self.n):
                return found
            width *= GROWTH
            wider = self._windows(projection, width)
            ends = zip(self.order, wider[0].tolist(), low.tolist(), high.tolist(), wider[1].tolist())
            outside -= np.bincount(np.concatenate([x for line, a, b, c, d in ends for x in (line[a:b], line[c:d])]), minlength=self.n)
            low, high = wider


def norm_ranges(norms: np.ndarray, k: int) -> list[np.ndarray]:
    """Places by falling norm, cut where the norm falls below the range's largest by NORM_RATIO; ranges that are verified whole may be wider."""
    order = np.argsort(-norms, kind="stable")
    falling, whole, out, start = norms[order], int(CANDIDATES * k / (1 - FALSE_POSITIVES)), [], 0
    while start < len(order):
        end = int(np.searchsorted(-falling, -falling[start] / NORM_RATIO, "right"))
        end = max(end, min(start + whole, len(order)))
        out.append(np.sort(order[start:end]))
        start = end
    return out


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query_id, vec_id, score of the ``k`` best found of each query, how many vectors were verified): ranges of like norms, each with its own largest norm.

    Ranges whose largest norm cannot reach a query's k-th score are passed over. No vector or query is zero; those whose
    squares vanish beside the block's largest component count as zero for the search, not for the score. ``exact`` verifies every vector.
    """
    x = scaled(vectors)
    q = np.array([scaled(y) for y in queries]).reshape(queries.shape)
    q /= np.sqrt((q**2).sum(1))[:, None]
    norms = np.sqrt((x**2).sum(1))
    near = [np.empty(0, np.int64)] * len(q)
    rough = [np.empty(0)] * len(q)
    verified = 0
    for part in norm_ranges(norms, k):
        largest = float(norms[part].max())
        asked = [n for n in range(len(q)) if len(rough[n]) < k or rough[n].min() <= largest * (1 + 1e-9)]
        if not asked:
            continue
        enough = min(len(part), CANDIDATES * k + int(FALSE_POSITIVES * len(part)))
        index = Index(x[part], largest) if enough < len(part) and not exact else None
        for n in asked:
            found = part[index.candidates(q[n] * largest, enough)] if index else part
            verified += len(found)
            found = found[ids[found] != query_ids[n]]
            score = np.concatenate([rough[n], x[found] @ q[n]])
            found = np.concatenate([near[n], found])
            if len(found) > k:  # the exact sum decides later, only where it can matter
                keep = score >= np.partition(score, len(score) - k)[len(score) - k] - 1e-9 * norms.max()
                found, score = found[keep], score[keep]
            near[n], rough[n] = found, score
    out = []
    for n, found in enumerate(near):
        score = inner_products(queries[n], vectors[found])
        best = np.lexsort((ids[found], -score))[:k]
        out.append((np.full(len(best), query_ids[n]), ids[found][best], score[best]))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    return *columns, verified


def inner_products(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """In double precision, summed from the first component on, so that equal vectors get equal scores anywhere.

    What overflows is infinite (such scores are equal in rank); a sum of both infinities counts as the lowest.
    """
    score = np.zeros(len(vectors))
    with np.errstate(over="ignore", invalid="ignore"):
        for d in range(vectors.shape[1]):
            score += query[d] * vectors[:, d]
    return np.where(np.isnan(score), -np.inf, score)


def _takes_part(v: Column) -> Column:
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & F.coalesce(sound, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _side(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors as doubles, filled with zeros): of rows under one id the least vector."""
    ids = rows.column("vec_id").combine_chunks().to_numpy(zero_copy_only=False)
    vectors = rows.column("v").combine_chunks()
    vectors = pa.concat_arrays(vectors.chunks) if isinstance(vectors, pa.ChunkedArray) else vectors
    size = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(ids), width))
    out[np.arange(width) < size[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    if len(ids) and (np.diff(ids[order]) == 0).any():
        order = np.lexsort((*out.T[::-1], ids))
    ids, out = ids[order], out[order]
    once = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.empty(0, bool)
    return ids[once], out[once]


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, block_rows: int | None = None, query_rows: int = QUERY_ROWS, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each vector whose id is divisible by ``every``.

    ``vectors`` has vec_id and embedding. Ids or vectors that are null, vectors that are zero, empty or hold a
    null or non-finite component take no part. Shorter vectors count as filled with zeros. Of rows repeated under one
    vec_id one counts (the least vector). Ties go to the smaller vec_id; an empty table gives an empty result. Other
    columns are ignored. Vectors travel once for each ``query_rows`` queries, queries once for each ``block_rows`` vectors
    (BLOCK_ROWS, fewer of wide vectors). ``exact`` scores all pairs instead of those that collide.
    """
    v = F.col("embedding")
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & _takes_part(F.col("v")))
    rows, asked, width = sound.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.max(F.size("v"))).first()
    if not rows or not asked:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = int(width)
    lines = max(SETS, -(-LINES // (width + 1))) * (width + 1)
    block_rows = block_rows or max(1, min(BLOCK_ROWS, BLOCK_PLACES // lines))
    blocks, query_blocks = math.ceil(rows / block_rows), math.ceil(asked / query_rows)
    place = F.xxhash64("vec_id")
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = sound.select("vec_id", "v", F.pmod(place, F.lit(blocks)).cast("int").alias("block"), to_all(query_blocks).alias("query_block"))
    queries = sound.where(F.col("vec_id") % every == 0).select(
        "vec_id", "v", F.pmod(place, F.lit(query_blocks)).cast("int").alias("query_block"), to_all(blocks).alias("block")
    )

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        (query_ids, query_matrix), (ids, matrix) = _side(asked, width), _side(held, width)
        found = search_block(ids, matrix, query_ids, query_matrix, k, exact)[:3] if len(ids) and len(query_ids) else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found)))

    found = queries.groupBy("block", "query_block").cogroup(base.groupBy("block", "query_block")).applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
