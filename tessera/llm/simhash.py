"""SimHash near-duplicates found with BK-trees.

Fingerprints within three bits agree on at least two of five bit blocks, so each
distinct fingerprint goes to one shard for each pair of blocks, keyed by their bits.
A shard is a BK-tree: children hang on edges labelled with the integer Hamming
distance to their parent, and a search follows only edges within the radius. Trees
meet their queries in the shard's task instead of being broadcast, because shards
have no size bound. A shard gives a spanning edge for each link that joins two of
its parts, which loses no link between components; components follow by
large-star and small-star steps on the edges.

Edited copies may lie further apart than three bits. Where a similarity is asked for,
texts that agree in a MinHash band of their 5-word shingles are candidates, whose
Jaccard similarity is computed on the whole sets of shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Written, fresh, materialise, table

RADIUS = 3
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: (shift, width) of the five blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Shards of more fingerprints are cut again by five blocks of what their key leaves open.
LARGE_SHARD = 4096
#: For links by similarity: words of a shingle, and MinHash bands of so many rows. Of pairs at 0.8, 0.07 % agree in no band.
SHINGLE, BANDS, ROWS = 5, 24, 6
_FACTORS = np.random.default_rng(42).integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str, size: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of each ``size``-word shingle of the lower-cased text; a shorter text is one shingle."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    cuts = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    return np.array([h(joined[a:b], 42) for a, b in cuts], np.uint64)


def fingerprint(text: str | None) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; without words the fingerprint is 0."""
    hashes = shingle_hashes(text or "")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key (the md5 of the text, or "-"), fp (the 64 bits as a long) for each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([fingerprint(x) for x in part.column(1).to_pylist()], pa.int64())], ["doc_id", "key", "fp"]
                )

    return _keyed(docs).mapInArrow(run, "doc_id long, key string, fp long")


def _text_key():
    return F.coalesce(F.md5("text"), F.lit("-"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_key().alias("key"))


class BKTree:
    """Children of a node are keyed by their Hamming distance to it. Equal values are held once."""

    def __init__(self, value: int):
        self.root = (value, {})

    def link(self, value: int, radius: int) -> list[int]:
        """The values within the radius; then the value is added."""
        found, todo = [], [self.root]
        while todo:
            node, children = todo.pop()
            d = (node ^ value).bit_count()
            if d <= radius:
                found.append(node)
            if children:
                if len(children) <= 2 * radius + 1:
                    todo += [x for k, x in children.items() if -radius <= k - d <= radius]
                else:
                    todo += [children[k] for k in range(max(1, d - radius), d + radius + 1) if k in children]
        self._add(value)
        return found

    def _add(self, value: int) -> None:
        node, children = self.root
        while d := (node ^ value).bit_count():
            if d not in children:
                children[d] = (value, {})
                return
            node, children = children[d]


def spanning_edges(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges within the radius that connect whatever links of these distinct values connect, at most one less than values."""
    parent = {x: x for x in values}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    edges: list[tuple[int, int]] = []

    def join(found: list[int], value: int) -> None:
        for other in found:
            a, b = top(other), top(value)
            if a != b:
                parent[a] = b
                edges.append((other, value))

    def search(part: list[int], free: tuple[int, ...]) -> None:
        """``free``: the bits in which these values may differ."""
        if len(part) <= LARGE_SHARD or len(free) < 20:
            tree = BKTree(part[0])
            for x in part[1:]:
                join(tree.link(x, radius), x)
            return
        # Values within the radius agree on one of radius + 1 blocks of the free bits at least.
        for k in range(radius + 1):
            mask = sum(1 << bit for bit in free[k :: radius + 1])
            cut: dict[int, list[int]] = {}
            for x in part:
                cut.setdefault(x & mask, []).append(x)
            rest = tuple(bit for bit in free if not mask >> bit & 1)
            for group in cut.values():
                if len(group) > 1:
                    search(group, rest)

    constant = 0
    for x in values:
        constant |= x ^ values[0]
    search(values, tuple(bit for bit in range(64) if constant >> bit & 1))
    return edges


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): spanning edges between fingerprints within the radius, from distinct ``fp``."""
    keys = F.array(
        *[
            F.struct(F.lit(k).alias("pair"), (_block("fp", i) * 8192 + _block("fp", j)).alias("bits"))
            for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))
        ]
    )
    shards = distinct.select("fp", F.explode(keys).alias("key")).select("key.*", "fp")
    spread = shards.repartition("pair", "bits").sortWithinPartitions("pair", "bits")

    def run(batches: Iterator[pa.RecordBatch]):
        rest = np.empty((0, 3), np.int64)
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
            rest = np.concatenate([rest, rows])
            change = np.flatnonzero((np.diff(rest[:, :2], axis=0) != 0).any(1)) + 1
            if len(change):
                yield _edges(rest[: change[-1]])
                rest = rest[change[-1] :]
        if len(rest):
            yield _edges(rest)

    return spread.mapInArrow(run, "a long, b long")


def _block(column: str, i: int):
    shift, width = BLOCKS[i]
    return F.shiftrightunsigned(F.col(column), shift).bitwiseAND(F.lit((1 << width) - 1))


def _edges(rows: np.ndarray) -> pa.RecordBatch:
    """Spanning edges of each shard in rows (pair, bits, fp) sorted by shard; shards of one row have none."""
    first = np.concatenate([[True], (np.diff(rows[:, :2], axis=0) != 0).any(1)])
    starts = np.append(np.flatnonzero(first), len(rows))
    edges: list[tuple[int, int]] = []
    for k in np.flatnonzero(np.diff(starts) > 1):
        edges += spanning_edges([int(x) & 0xFFFFFFFFFFFFFFFF for x in rows[starts[k] : starts[k + 1], 2]])
    pairs = np.array(edges, np.uint64).reshape(-1, 2).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each connected component, for the other nodes that have an edge (a, b).

    Each round is a large-star and a small-star step (Kiveris et al., 2014): a node points its larger
    neighbours, then itself and its smaller ones, at the least of them. Hubs are only aggregated to a
    minimum and joined, which Spark may split. Each round's edges are written and those of the round before dropped.
    """
    held = Written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    current, signature = held.read(), None
    for _ in range(most_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(below, "a")
            .select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
            .select(F.col("x.b").alias("a"), F.col("x.m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        after = Written(small)
        held.drop()
        held, current = after, after.read()
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if now == signature:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        signature = now
    raise RuntimeError("components did not settle")


def minhash_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of a set of shingle hashes: its number and its rows' least hashes mixed."""
    least = np.empty(len(_FACTORS), np.uint64)
    for at in range(0, len(_FACTORS), 16):
        part = least[at : at + 16]
        part[:] = np.iinfo(np.uint64).max
        for k in range(0, len(hashes), 65536):
            x = hashes[k : k + 65536][None, :] * _FACTORS[at : at + 16, None]
            np.minimum(part, (x ^ (x >> np.uint64(32))).min(1), out=part)
    bands = np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64)
    return bands.astype(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key, fp as in ``fingerprints``; same (a hash of the set of SHINGLE-word shingles), keys (minhash_keys of the set), null without words or doc_id."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, texts = part.column(0), part.column(1).to_pylist()
                same, keys = [], []
                for doc_id, text in zip(ids.to_pylist(), texts):
                    hashes = np.unique(shingle_hashes(text or "", SHINGLE)) if doc_id is not None else ()
                    same.append(_same(hashes) if len(hashes) else None)
                    keys.append(minhash_keys(hashes) if len(hashes) else None)
                yield pa.RecordBatch.from_arrays(
                    [ids, part.column(2), pa.array([fingerprint(x) for x in texts], pa.int64()), pa.array(same, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "key", "fp", "same", "keys"],
                )

    return _keyed(docs).mapInArrow(run, "doc_id long, key string, fp long, same long, keys array<long>")


def _same(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), 42) - 2**63


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets of hashes."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    return min(len(a), len(b)) >= similarity * max(len(a), len(b)) and jaccard(a, b) >= similarity


def joining_edges(sets: list[np.ndarray], clusters: list[int], similarity: float) -> list[tuple[int, int]]:
    """Edges (places in ``sets``) that connect whatever clusters are connected by so similar pairs; of clusters that are connected already, one likeness joins them all."""
    parts: dict[int, list[int]] = {}
    for x, cluster in enumerate(clusters):
        parts.setdefault(cluster, []).append(x)
    edges: list[tuple[int, int]] = []
    done: list[list[int]] = []
    for part in parts.values():
        apart = []
        for other in done:
            found = next(((x, y) for x in part for y in other if alike(sets[x], sets[y], similarity)), None)
            if found is None:
                apart.append(other)
            else:
                edges.append(found)
                part = other + part
        done = [*apart, part]
    return edges


def similar_links(docs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b): edges between the fingerprints of texts whose sets of shingles are so similar; ``rows`` are the sketches of ``docs``.

    Sets that agree in a band are candidates of one bucket. Every member is compared with its bucket's least one, pair by
    pair, which settles buckets whose members are all like it, however many they are. Only buckets that are then still in
    several clusters meet in a task each, where members of different clusters are compared. Likeness is computed on the
    whole sets. Equal sets are held once and need no comparison.
    """
    sets = materialise(rows.where("same IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp"), F.first("keys").alias("keys")))
    equal = rows.select("same", F.col("fp").alias("a")).join(sets.select("same", F.col("fp").alias("b")), "same").select("a", "b").where("a <> b").distinct()
    banded = sets.select("same", F.explode("keys").alias("key"))
    hubs = banded.groupBy("key").agg(F.min("same").alias("hub"), F.count("*").alias("n")).where("n > 1")
    buckets = Written(banded.join(hubs, "key")).read()
    needed = sets.select("same", "doc_id", "fp").join(buckets.select("same").distinct(), "same")
    texts = docs.selectExpr("bigint(doc_id) doc_id", "text").join(needed, "doc_id").select("same", "fp", "text")

    def shingled(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held = [np.unique(shingle_hashes(x or "", SHINGLE)) for x in part.column(2).to_pylist()]
                # Other rows under the same doc_id may have another text.
                keep = [k for k, (h, x) in enumerate(zip(held, part.column(0).to_pylist())) if len(h) and _same(h) == x]
                cut = part.take(pa.array(keep, pa.int32()))
                yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), pa.array([held[k].tobytes() for k in keep], pa.binary())], ["same", "fp", "hashes"])

    def compared(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in (4, 5))
            keep = pa.array([alike(x, y, similarity) for x, y in zip(a, b)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in range(4)], ["same", "hub", "a", "b"])

    def joined(group: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
        fp, edges = group.column("fp").to_numpy(), joining_edges(hashes, group.column("cluster").to_pylist(), similarity)
        pairs = np.array(edges, np.int64).reshape(-1, 2)
        return pa.table({"a": fp[pairs[:, 0]], "b": fp[pairs[:, 1]]})

    held = Written(texts.mapInArrow(shingled, "same long, fp long, hashes binary").dropDuplicates(["same"])).read()
    of_hub = held.select(F.col("same").alias("hub"), F.col("fp").alias("hub_fp"), F.col("hashes").alias("hub_hashes"))
    pairs = buckets.where("same <> hub").select("same", "hub").distinct().join(held, "same").join(of_hub, "hub")
    near = Written(pairs.select("same", "hub", "fp", "hub_fp", "hashes", "hub_hashes").mapInArrow(compared, "same long, hub long, a long, b long")).read()
    clusters = components(near.select(F.col("same").alias("a"), F.col("hub").alias("b")))
    inside = buckets.where("n > 2").join(clusters.withColumnRenamed("node", "same"), "same", "left").withColumn("cluster", F.coalesce("root", "same"))
    apart = inside.groupBy("key").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low <> high").select("key")
    rest = inside.join(apart, "key").select("key", "same", "cluster").join(held, "same").groupBy("key").applyInArrow(joined, "a long, b long")
    return near.select("a", "b").unionByName(rest).unionByName(equal)


def _members(docs: DataFrame, similarity: float | None) -> DataFrame:
    """doc_id, key, fp, root (which names the component) and component_id for each row of ``docs``."""
    rows = materialise(fingerprints(docs) if similarity is None else sketches(docs))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    edges = links(distinct.select("fp"))
    roots = components(edges if similarity is None else edges.unionByName(similar_links(docs, rows, similarity)))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_fp = named.join(least, "root").select("fp", "root", "component_id")
    return rows.select("doc_id", "key", "fp").join(of_fp, "fp")


def near_duplicates(docs: DataFrame, similarity: float | None = None) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable by links, the document's own included) for each row of ``docs``.

    With ``similarity``, texts are also linked whose SHINGLE-word shingles have at least that Jaccard similarity,
    however far apart their fingerprints are. Null and empty texts have fingerprint 0 and are linked like any
    other. Null doc_ids are kept, and never name a component unless it has no other; repeated rows share their
    component, and rows with different texts under one doc_id are judged by their texts. Other columns are ignored.
    Texts of any length are read whole. An empty table gives an empty result.
    """
    return _members(docs, similarity).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, similarity: float | None = None) -> DataFrame:
    """One row of each group of near-duplicates: of its rows with the least doc_id one with the least md5 of its text.

    Rows are told apart by doc_id and text, so that each text under a doc_id stays or goes with its own group; of rows
    equal in both, one stays. Rows without a doc_id are all kept. Columns may have any names.
    """
    first = _members(docs, similarity).where("doc_id IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("first")).select("first.*")
    key = fresh("key")
    once = docs.where("doc_id IS NOT NULL").withColumn(key, _text_key()).dropDuplicates(["doc_id", key])
    first = first.select(F.col("doc_id").alias(fresh("id")), F.col("key").alias(fresh("first")))
    kept = once.join(first, (F.col("doc_id").cast("long") == first[0]) & (F.col(key) == first[1]), "left_semi").drop(key)
    return kept.unionByName(docs.where("doc_id IS NULL"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
