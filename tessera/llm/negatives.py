"""Hard negatives by branch and bound over ball trees.

Rows are dealt to shards, anchors to blocks. A task holds one block of anchors with the best
they have found so far and streams one shard past it; each chunk of the shard gets a ball tree of
its own. A ball with centre c and radius r bounds an anchor's inner products from both
sides, <a, c> - |a| r and <a, c> + |a| r: balls wholly outside the window of scores
that an anchor looks for, and balls strictly beneath its current k-th score, are passed
over. What is left is scored exactly. First each anchor's positives are found (any score, same
label), then the negatives of each positive (scores in its window, other labels).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Written, table

#: Rows of a chunk (one ball tree) and of a leaf, and anchors that go through a tree at once.
CHUNK_ROWS, LEAF_ROWS, AT_ONCE = 16_384, 64, 4096
#: A chunk of wide vectors has fewer rows, of so many bytes (as doubles).
CHUNK_BYTES = 16 << 20
#: A block of anchors and a shard of rows have about so many bytes of vectors (as doubles); a shard is streamed, a block is held.
ANCHOR_BYTES, SHARD_BYTES = 32 << 20, 256 << 20
#: Where there is less than a shard of rows for each core, shards of so many rows and more are made.
LEAST_SHARD = 1024
#: Sums of products below this are exact in double precision.
EXACT = 1 << 53
#: In place of a score: nothing found yet.
NONE = np.iinfo(np.int64).min


@dataclass
class Tree:
    """Nodes by level from the root on; ``low`` and ``high`` are a node's rows in the order of ``rows``."""

    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    parent: np.ndarray
    is_leaf: np.ndarray
    centre: np.ndarray
    radius: np.ndarray


def ball_tree(vectors: np.ndarray, leaf: int = LEAF_ROWS) -> Tree:
    """Halves rows at the median of the direction from the row farthest from the centre to the one farthest from that."""
    rows = np.arange(len(vectors))
    low, high, parent, is_leaf, centre, radius = [0], [len(rows)], [-1], [], [], []
    n = 0
    while n < len(low):
        a, b = low[n], high[n]
        x = vectors[rows[a:b]]
        c = x.mean(0)
        away = ((x - c) ** 2).sum(1)
        centre.append(c)
        radius.append(math.sqrt(float(away.max())))
        is_leaf.append(b - a <= leaf or not away.max())
        if not is_leaf[-1]:
            first = x[int(away.argmax())]
            second = x[int(((x - first) ** 2).sum(1).argmax())]
            at = (b - a) // 2
            rows[a:b] = rows[a:b][np.argpartition(x @ (second - first), at)]
            low += [a, a + at]
            high += [a + at, b]
            parent += [n, n]
        n += 1
    return Tree(rows, np.array(low), np.array(high), np.array(parent), np.array(is_leaf), np.array(centre), np.array(radius))


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of whole numbers, exactly: in doubles where they hold every sum, else in longs."""
    most = [int(np.abs(x).max(initial=0)) for x in (a, b)]
    if most[0] * most[1] * a.shape[1] < EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


class Miner:
    """The best ``k`` found so far in each window of each anchor: scores and ids, best first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        """``low`` and ``high``: a row of windows for each anchor, empty where low is above high. ``same`` looks for the anchor's label, else for all others."""
        self.ids, self.vectors, self.labels, self.low, self.high, self.same, self.k = ids, vectors, labels, low, high, same, k
        self.rough = vectors.astype(float)
        self.norms = np.sqrt((self.rough**2).sum(1))
        self.scores = np.full((*low.shape, k), NONE)
        self.found = np.full((*low.shape, k), np.iinfo(np.int64).max)
        self.scored = self.met = 0

    def search(self, ids: np.ndarray, vectors: np.ndarray, labels: np.ndarray) -> None:
        """Takes a chunk of rows into account."""
        tree = ball_tree(vectors.astype(float))
        ordered = labels[tree.rows]
        spread = [(ordered[a:b].min(), ordered[a:b].max()) for a, b in zip(tree.low, tree.high)]
        leaves = np.flatnonzero(tree.is_leaf)
        for at in range(0, len(self.ids), AT_ONCE):
            some = np.arange(at, min(at + AT_ONCE, len(self.ids)))
            middle = self.rough[some] @ tree.centre.T
            # Bounds give way for what rounding may take from them.
            reach = self.norms[some, None] * tree.radius + 1e-9 * (self.norms[some, None] * (np.sqrt((tree.centre**2).sum(1)) + tree.radius) + 1)
            upper, lower = middle + reach, middle - reach
            may = np.empty(upper.shape, bool)
            for n, up in enumerate(tree.parent):  # parents come first
                may[:, n] = self._labelled(some, *spread[n]) & self._wanted(some, upper[:, n], lower[:, n])
                if up >= 0:
                    may[:, n] &= may[:, up]
            # Each anchor's most promising leaf comes first, then the leaves that promise most to any, so that the k-th scores rise early.
            own_leaf = leaves[np.where(may[:, leaves], upper[:, leaves], -np.inf).argmax(1)]
            falling = leaves[np.argsort(-middle[:, leaves].max(0), kind="stable")]
            for n, asked in [*((n, np.flatnonzero((own_leaf == n) & may[:, n])) for n in np.unique(own_leaf)), *((n, None) for n in falling)]:
                if asked is None:
                    asked = np.flatnonzero(may[:, n] & (own_leaf != n))
                    asked = asked[self._wanted(some[asked], upper[asked, n], lower[asked, n])]
                if len(asked):
                    held = tree.rows[tree.low[n] : tree.high[n]]
                    self._score(some[asked], ids[held], vectors[held], labels[held])
        self.met += len(self.ids) * len(ids)

    def _labelled(self, some: np.ndarray, first: int, last: int) -> np.ndarray:
        """Whether a ball with labels from ``first`` to ``last`` can hold a label that the anchors look for."""
        own = self.labels[some]
        return (first <= own) & (own <= last) if self.same else (first != own) | (last != own)

    def _wanted(self, some: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Whether a ball meets a window of each anchor and is not strictly beneath its k-th score there."""
        low, high = self.low[some], self.high[some]
        return ((low <= high) & (upper[:, None] >= np.maximum(low, self.scores[some, :, -1])) & (lower[:, None] <= high)).any(1)

    def _score(self, asked: np.ndarray, ids: np.ndarray, vectors: np.ndarray, labels: np.ndarray) -> None:
        scores = inner_products(self.vectors[asked], vectors)
        self.scored += scores.size
        sound = ((labels == self.labels[asked, None]) == self.same) & (ids != self.ids[asked, None])
        for w in range(self.low.shape[1]):
            least = np.maximum(self.low[asked, w], self.scores[asked, w, -1])
            row, column = np.nonzero(sound & (scores >= least[:, None]) & (scores <= self.high[asked, w, None]))
            if not len(row):
                continue
            better = np.unique(row)
            of = np.concatenate([np.repeat(asked[better], self.k), asked[row]])
            score = np.concatenate([self.scores[asked[better], w].ravel(), scores[row, column]])
            own = np.concatenate([self.found[asked[better], w].ravel(), ids[column]])
            order = np.lexsort((own, ~score, of))  # ~ falls as scores rise, also for the least long
            of = of[order]
            first = np.flatnonzero(np.diff(of, prepend=-1))
            rank = np.arange(len(of)) - np.repeat(first, np.diff(first, append=len(of)))
            keep = rank < self.k
            self.scores[of[keep], w, rank[keep]] = score[order][keep]
            self.found[of[keep], w, rank[keep]] = own[order][keep]

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place of the anchor, window, id, score) of all that was found."""
        place, window, rank = np.nonzero(self.scores != NONE)
        return place, window, self.found[place, window, rank], self.scores[place, window, rank]


def _whole_numbers(vectors: pa.ListArray, width: int, scale: float) -> np.ndarray:
    """floor(scale x) of each component, shorter vectors filled with zeros; held to the range in which a sum of products is a long."""
    out = np.zeros((len(vectors), width))
    size = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out[np.arange(width) < size[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    most = float(math.isqrt((1 << 62) // max(1, width)))
    with np.errstate(over="ignore"):
        return np.clip(np.floor(out * scale), -most, most).astype(np.int64)


def _streamed(rows: DataFrame, width: int, scale: float, same: bool, k: int) -> DataFrame:
    """anchor_id, mark (of the window), vec_id, score: ``rows`` are the anchors (tag 0) and the rows (tag 1) of each group, in this order.

    Of rows of a group under one vec_id the first counts.
    """

    chunk_rows = max(1, min(CHUNK_ROWS, CHUNK_BYTES // (8 * max(1, width))))

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
        """Runs of rows of one group and tag."""
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "tag")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield int(keys[0, a]), int(keys[1, a]), batch.slice(a, b - a)

    def side(held: list[pa.RecordBatch]) -> tuple[pa.Table, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        rows = pa.Table.from_batches(held).combine_chunks()
        vectors = _whole_numbers(_one(rows.column("v")), width, scale)
        return rows, (rows.column("vec_id").to_numpy(), vectors, rows.column("label").to_numpy())

    def begun(anchors: list[pa.RecordBatch]) -> tuple[Miner, np.ndarray] | None:
        if not anchors:
            return None
        rows, own = side(anchors)
        marks, low, high = (_padded(_one(rows.column(c)), fill) for c, fill in (("marks", 0), ("low", 1), ("high", 0)))
        return Miner(*own, low, high, same, k), marks

    def results(mining: tuple[Miner, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        if mining:
            miner, marks = mining
            place, window, ids, scores = miner.results()
            columns = (miner.ids[place], marks[place, window], ids, scores)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor_id", "mark", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, mining, anchors, chunk = None, None, None, [], []

        def searched() -> None:
            if chunk and mining:
                mining[0].search(*side(chunk)[1])
            chunk.clear()

        for batch in batches:
            for group, tag, part in parts(batch):
                if (group, tag) != key:
                    if key is None or group != key[0]:
                        searched()
                        yield from results(mining)
                        mining = None
                        anchors.clear()
                    if tag == 1:
                        mining = begun(anchors)
                    key, last = (group, tag), None
                ids = part.column("vec_id").to_numpy(zero_copy_only=False)
                part = part.filter(pa.array(np.concatenate([[ids[0] != last], ids[1:] != ids[:-1]]).astype(bool)))
                last = ids[-1]
                if tag == 0:
                    anchors.append(part)
                    continue
                for at in range(0, part.num_rows, chunk_rows):
                    chunk.append(part.slice(at, chunk_rows))
                    if sum(x.num_rows for x in chunk) >= chunk_rows:
                        searched()
        searched()
        yield from results(mining)

    return rows.mapInArrow(run, "anchor_id long, mark long, vec_id long, score long")


def _one(column: pa.ChunkedArray) -> pa.Array:
    held = column.combine_chunks()
    return pa.concat_arrays(held.chunks) if isinstance(held, pa.ChunkedArray) else held


def _padded(lists: pa.ListArray, fill: int) -> np.ndarray:
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.full((len(lists), int(size.max(initial=1))), fill, np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _takes_part(v: Column) -> Column:
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & F.coalesce(sound, F.lit(False))


@dataclass(frozen=True)
class Plan:
    """How many blocks of anchors and shards of rows there are, and how wide vectors are."""

    blocks: int
    shards: int
    width: int

    @classmethod
    def of(cls, n_rows: int, n_anchors: int, width: int, cores: int) -> Plan:
        size = 8 * max(1, width)
        by_cores = min(2 * cores, math.ceil(n_rows / LEAST_SHARD))
        return cls(max(1, math.ceil(n_anchors * size / ANCHOR_BYTES)), max(1, by_cores, math.ceil(n_rows * size / SHARD_BYTES)), width)


def _best(anchors: DataFrame, rows: DataFrame, plan: Plan, scale: float, same: bool, k: int) -> DataFrame:
    """anchor_id, mark, vec_id, score, rank: the ``k`` best of ``rows`` in each window of ``anchors`` (vec_id, label, v, marks, low, high).

    Rows travel once for each block of anchors, anchors once for each shard; each task gives back no more than ``k`` rows a window.
    """
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    group = (F.col("block") * plan.shards + F.col("shard")).alias("group")
    windows = [F.col(c) for c in ("marks", "low", "high")]
    none = [F.array().cast("array<bigint>").alias(c) for c in ("marks", "low", "high")]
    asked = anchors.select("*", dealt(plan.blocks).alias("block"), every(plan.shards).alias("shard")).select(group, F.lit(0).alias("tag"), "vec_id", "label", "v", *windows)
    held = rows.select("*", dealt(plan.shards).alias("shard"), every(plan.blocks).alias("block")).select(group, F.lit(1).alias("tag"), "vec_id", "label", "v", *none)
    met = asked.unionByName(held).repartitionById(plan.blocks * plan.shards, F.col("group")).sortWithinPartitions("group", "tag", "vec_id", "label", "v")
    best = Window.partitionBy("anchor_id", "mark").orderBy(F.desc("score"), "vec_id")
    return _streamed(met, plan.width, scale, same, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 5, least: int = 80, most: int = 100, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding and label. Anchors are the rows whose vec_id is divisible by ``every``; an anchor's positives are its
    ``n_positives`` best others of its label, and each positive's negatives the best ``n_negatives`` rows of other labels that score from
    ``least`` to ``most`` percent of the positive's score (none, if that is below 0). Scores are inner products of the components times
    ``scale``, cut to whole numbers. Ties go to the smaller vec_id. Rows with a null vec_id, label, vector or component, or one
    that is not finite, take no part; empty and short vectors count as filled with zeros. Of rows repeated under one vec_id one
    counts (the least label, then vector). Other columns are ignored; an empty table gives an empty result. Products are exact; components are held to
    the range in which their sums fit a long.
    """
    if not 0 <= least <= most <= 100:
        raise ValueError("0 <= least <= most <= 100 must hold")
    v = F.col("embedding")
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v")).where("vec_id IS NOT NULL AND label IS NOT NULL").where(_takes_part(F.col("v")))
    n_rows, n_anchors, width = sound.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.max(F.size("v"))).first()
    plan = Plan.of(n_rows, n_anchors, int(width or 0), vectors.sparkSession.sparkContext.defaultParallelism)
    anchors = sound.where(F.col("vec_id") % every == 0)
    whole = [F.array(F.lit(x).cast("long")).alias(c) for c, x in (("marks", 0), ("low", NONE + 1), ("high", (1 << 63) - 1))]
    positives = _best(anchors.select("*", *whole), sound, plan, scale, True, n_positives)
    positives = Written(positives.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))).read()

    def percent(share: int, up: bool) -> Column:
        """The least whole number not below, or the largest not above, that share of the score, without a product that a long cannot hold."""
        whole = F.expr("(positive_score - pmod(positive_score, 100L)) div 100L")
        return whole * share + (F.expr(f"(pmod(positive_score, 100L) * {share} + {99 if up else 0}) div 100L"))

    windows = positives.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("positive_id").alias("mark"), percent(least, True).alias("low"), percent(most, False).alias("high")))).alias("windows")
    )
    asked = anchors.join(windows, "vec_id").select("vec_id", "label", "v", F.col("windows.mark").alias("marks"), F.col("windows.low").alias("low"), F.col("windows.high").alias("high"))
    found = _best(asked, sound, plan, scale, False, n_negatives).select("anchor_id", F.col("mark").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(positives, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(rows.select("vec_id", "embedding", label.alias("label")))
