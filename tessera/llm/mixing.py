"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (DataFrame and SQL only).

Each source's documents are permuted by a hash and cut into blocks of words; the
source's target gives its exact quota of blocks. From the root on, each node of a
binary tree deals half of its blocks to the left child: how many of each source is
a multivariate hypergeometric draw, made source by source by inversion of a seeded
uniform. The leaves are output shards, which draw disjoint ranges of the permuted
blocks and order them by a local key. Only (source, node) counts enter the tree.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, fresh, ln_factorial, materialise, numbers_below, table

#: Weights of the sources in code point order, repeating (fixed values).
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """(skey, source_size, target) from (skey, source_size): ``share`` of all sizes by weight, at most ``most`` x each.

    Handing on the excess until none is above its limit ends at ``min(limit, level * weight)`` for one
    level, which is found in order of limit / weight. The windows run over one row a source.
    """
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "skey")
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy("skey")))
    weighed = (
        ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("limit", most * F.col("source_size"))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("total", share * F.sum("source_size").over(everything))
    )
    levels = weighed.withColumn(
        "level",
        (F.col("total") - F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        / F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    ).withColumn("place", F.row_number().over(by_ratio))
    found = levels.withColumn(
        "found", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("place", "level"))).over(everything)
    )
    free = F.col("place") >= F.col("found.place")
    return found.select(
        "skey", "source_size", F.when(free, F.col("found.level") * F.col("weight")).otherwise(F.col("limit")).alias("target")
    )


def _hypergeometric(population: str, marked: str, drawn: str, uniform: str) -> str:
    """SQL text: inverts ``uniform`` to the number of marked ones among ``drawn``, walking outwards from the mode."""
    low, high = f"greatest(0L, {drawn} - ({population} - {marked}))", f"least({marked}, {drawn})"
    mode = f"least({high}, greatest({low}, bigint(floor(({drawn} + 1D) * ({marked} + 1D) / ({population} + 2D)))))"

    def ln_choose(n: str, k: str) -> str:
        return f"({ln_factorial(n)} - {ln_factorial(k)} - {ln_factorial(f'({n} - {k})')})"

    spread = f"sqrt(greatest(0D, double({drawn}) * {marked} / {population} * ({population} - {marked}) / {population}))"
    step_up = f"(s.up * ({marked} - s.hi) / (s.hi + 1D) * ({drawn} - s.hi) / ({population} - {marked} - {drawn} + s.hi + 1D))"
    step_down = f"(s.down * s.lo / ({marked} - s.lo + 1D) * ({population} - {marked} - {drawn} + s.lo) / ({drawn} - s.lo + 1D))"
    at_mode = f"exp({ln_choose(marked, 'm')} + {ln_choose(f'({population} - {marked})', f'({drawn} - m)')} - {ln_choose(population, drawn)})"
    # s: what is left of the uniform, the walk's two ends and their probabilities, the answer or -1.
    walk = f"""aggregate(sequence(1, int(24 * {spread}) + 40),
        element_at(transform(array({at_mode}), p -> named_struct('left', {uniform} - p, 'hi', m, 'lo', m, 'up', p, 'down', p,
            'found', CASE WHEN {uniform} < p THEN m ELSE -1L END)), 1),
        (s, i) -> CASE WHEN s.found >= 0 THEN s
            WHEN (i % 2 = 1 OR s.lo <= {low}) AND s.hi < {high} THEN named_struct('left', s.left - {step_up}, 'hi', s.hi + 1, 'lo', s.lo,
                'up', {step_up}, 'down', s.down, 'found', CASE WHEN s.left < {step_up} THEN s.hi + 1 ELSE -1L END)
            WHEN s.lo > {low} THEN named_struct('left', s.left - {step_down}, 'hi', s.hi, 'lo', s.lo - 1,
                'up', s.up, 'down', {step_down}, 'found', CASE WHEN s.left < {step_down} THEN s.lo - 1 ELSE -1L END)
            ELSE s END,
        s -> CASE WHEN s.found >= 0 THEN s.found ELSE m END)"""
    return f"CASE WHEN {low} = {high} THEN {low} ELSE element_at(transform(array({mode}), m -> {walk}), 1) END"


def split_quotas(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """(skey, shard, quota) from (skey, quota): ``n_shards`` is a power of two, and each level halves the nodes' blocks.

    A node's sources are gathered in one array, so its length is the number of sources.
    """
    if n_shards < 1 or n_shards & (n_shards - 1):
        raise ValueError("n_shards must be a power of two")
    level = quotas.select(F.lit(0).alias("node"), "skey", "quota")
    uniform = f"(shiftrightunsigned(xxhash64({seed}L, 2 * node + depth, it.skey), 11) / 9007199254740992D)"
    draw = _hypergeometric("a.rest", "it.quota", "a.free", uniform)
    for depth in range(n_shards.bit_length() - 1):
        level = (
            level.groupBy("node")
            .agg(F.sort_array(F.collect_list(F.struct("skey", "quota"))).alias("items"), F.sum("quota").alias("n"))
            .withColumn("depth", F.lit(depth * 1_000_003))
            .withColumn(
                "dealt",
                F.expr(
                    f"""aggregate(items, named_struct('rest', n, 'free', bigint(n div 2), 'out', slice(array(0L), 1, 0)),
                    (a, it) -> element_at(transform(array({draw}), x -> named_struct('rest', a.rest - it.quota, 'free', a.free - x,
                        'out', concat(a.out, array(x)))), 1), a -> a.out)"""
                ),
            )
            .select("node", "dealt", F.posexplode("items").alias("at", "item"))
            .select("node", F.col("item.skey").alias("skey"), F.col("item.quota").alias("quota"), F.get("dealt", F.col("at")).alias("dealt"))
            .withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
            .select(
                (2 * F.col("node") + F.col("side")).alias("node"),
                "skey",
                F.when(F.col("side") == 0, F.col("dealt")).otherwise(F.col("quota") - F.col("dealt")).alias("quota"),
            )
        )
    return level.select("skey", F.col("node").alias("shard"), "quota")


def _groups(docs: DataFrame) -> DataFrame:
    """(doc_id, skey, size, text_key, n): rows of ``docs`` that are equal in these, counted before they are shuffled."""
    return docs.groupBy(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")).alias("skey"),  # null last
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("text_key"),
    ).agg(F.count("*").alias("n"))


def _dealt(docs: DataFrame, n_shards: int, seed: int, least_block: int, blocks: int, bucket_rows: int, tree_seed: int | None = None) -> DataFrame:
    """Each group with its source's size, target, block and shard ends; ``start`` (its words begin there in its source) and ``drawn`` (how many of its rows are drawn as first and as second copy)."""
    slim = materialise(_groups(docs).withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "text_key")))
    parts = max(1, math.ceil(slim.count() / bucket_rows))
    slim = slim.withColumn("part", F.pmod("draw", F.lit(parts)))
    by_part = slim.groupBy("skey", "part").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    targets = source_targets(by_part.groupBy("skey").agg(F.sum("words").alias("source_size")))
    everything = Window.partitionBy()
    targets = materialise(
        targets.withColumn("block", F.greatest(F.lit(least_block), F.ceil(F.sum("target").over(everything) / blocks)).cast("long"))
    )
    quotas = targets.select("skey", F.ceil(F.col("target") / F.col("block")).cast("long").alias("quota"))
    up_to = Window.partitionBy("skey").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        split_quotas(quotas, n_shards, seed if tree_seed is None else tree_seed)
        .withColumn("end", F.sum("quota").over(up_to))
        .groupBy("skey")
        .agg(F.sort_array(F.collect_list("end")).alias("ends"))
    )
    before = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        by_part.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .join(targets.join(ends, "skey"), "skey")
        .drop("words")
    )
    within = Window.partitionBy("skey", "part").orderBy("draw", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)

    def drawn(copy: int):
        # A row is drawn if its middle lies below the target; these are the first rows of a group.
        room = F.col("target") - F.col("start") - copy * F.col("source_size")
        rows = F.ceil(room / F.col("size") - 0.5).cast("long")
        return F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.col("n"), rows))).otherwise(F.lit(0)).cast("long")

    return (
        slim.join(offsets, ["skey", "part"])
        .withColumn("start", F.col("offset") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(within), F.lit(0)))
        .withColumn("drawn", F.array(drawn(0), drawn(1)))
    )


def _placed(copy: int, seed: int) -> Column:
    """Shard, block and local order of one row of a group as its ``copy``, or null if it is not drawn: the block in which its words begin belongs to the shard whose quota it is in."""
    start = F.col("start") + F.col("turn") * F.col("size") + copy * F.col("source_size")
    block = F.floor(start / F.col("block")).cast("long")
    place = F.struct(
        F.size(F.filter("ends", lambda end: end <= block)).alias("shard"),
        block.alias("block"),
        F.xxhash64(F.lit(seed), "block", "doc_id", F.lit(copy)).alias("local_key"),
        F.lit(copy).alias("copy"),
    )
    return F.when(F.col("turn") < F.get("drawn", F.lit(copy)), place)


def mix(docs: DataFrame, n_shards: int = 8, seed: int = 42, least_block: int = 1024, blocks: int = 65536, bucket_rows: int = 1024, tree_seed: int | None = None) -> DataFrame:
    """A row for each document (doc_id, text, source) with its draws in ``placements`` (shard, block, local_key, copy).

    A null text has size 0 and is never drawn; null sources form one source, the last. Repeated rows
    and null doc_ids count as rows of their own; rows that are equal are counted before anything is shuffled. Other
    columns are ignored; texts of any length are read whole. An empty table gives an empty result. The running sum
    over a source is taken in hashed buckets, so a hot source is spread over many tasks. ``tree_seed`` (``seed``, if it is not given) decides which
    shard gets which blocks, ``seed`` how documents are permuted into blocks.
    """
    some, each = numbers_below("n")
    return (
        _dealt(docs, n_shards, seed, least_block, blocks, bucket_rows, tree_seed)
        .withColumn("_hundreds", F.explode(some))
        .withColumn("turn", F.explode(each))
        .select(
            "doc_id",
            "text_key",
            F.when(F.col("skey").startswith("s"), F.expr("substring(skey, 2)")).alias("source"),
            "size",
            "source_size",
            "target",
            F.filter(F.array(_placed(0, seed), _placed(1, seed)), lambda x: x.isNotNull()).alias("placements"),
        )
    )


def mixed_rows(mixed: DataFrame) -> DataFrame:
    """The training order: a row for each draw; sort by (shard, local_key) within each shard."""
    return mixed.select("doc_id", "source", "size", F.explode("placements").alias("x")).select("doc_id", "source", "size", "x.*")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with a row for each draw of ``mix``, shard by shard in local order; columns may have any names.

    The tree's quotas say which blocks a shard holds. A shard's rows are dealt by their local key, which is a hash, to equal ranges, so
    that its size does not bound the number of tasks; partitions, and so the files that are written of them, follow the order of (shard, local
    key). Rows that are equal in doc_id, text and source count each, and one of them stands for all when they are drawn.
    """
    options = {"n_shards": 8, "seed": 42, "least_block": 1024, "blocks": 65536, "bucket_rows": 1024} | options
    keys = {"doc_id": F.col("doc_id").cast("long"), "skey": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")), "text_key": F.xxhash64("text")}
    row = fresh("row")
    one = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), *[v.alias(f"own_{k}") for k, v in keys.items()])
    one = one.groupBy(*[f"own_{k}" for k in keys]).agg(F.first(row).alias(row))
    draws = _dealt(docs, **options).where("drawn[0] + drawn[1] > 0").select(*keys, "n", "size", "source_size", "start", "block", "ends", "drawn")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"own_{k}")) for k in keys])
    some, each = numbers_below("n")
    turns = one.join(draws, same).withColumn("_hundreds", F.explode(some)).withColumn("turn", F.explode(each))
    copies = F.filter(F.array(_placed(0, options["seed"]), _placed(1, options["seed"])), lambda x: x.isNotNull())
    placed = turns.select(row, "turn", F.explode(copies).alias("x"))
    ranges = max(1, math.ceil(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) / options["n_shards"]))
    range_of = F.shiftright((F.shiftright("x.local_key", 32) + (1 << 31)) * ranges, 32)
    ordered = placed.repartitionById(options["n_shards"] * ranges, (F.col("x.shard") * ranges + range_of).cast("int"))
    return ordered.sortWithinPartitions("x.shard", "x.local_key", "x.copy", "turn").select(*[F.col(row)[c].alias(c) for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("placements")).cast("long").alias("taken"), "placements"
    )
