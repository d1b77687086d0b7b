"""Sharding by longest processing time first: groups of equal texts stay together.

Groups larger than the mean bundle are scheduled one by one; the others are first
hashed into a fixed number of bundles. So the heap on the driver holds at most
twice ``bundles`` items at any input size, and the result is as even as one bundle.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise, numbers_below, table


#: Hashed bundles of small groups; rows of a shard that are numbered in one task.
BUNDLES, SLOT_ROWS = 16384, 4096


def schedule(items: list[tuple[str, int]], n_shards: int) -> list[tuple[str, int]]:
    """(item, shard): items from the largest on, each to the shard with the least load (ties: lower shard, lesser key)."""
    loads = [(0, shard) for shard in range(n_shards)]
    placed = []
    for item, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(loads)
        placed.append((item, shard))
        heapq.heappush(loads, (load + size, shard))
    return placed


def _number(digest: Column) -> Column:
    """The first 32 bits of a hexadecimal digest; 0 for "-"."""
    return F.coalesce(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(0))


def shard_documents(docs: DataFrame, n_shards: int = 8, bundles: int = BUNDLES, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs`` (doc_id, text).

    Sizes are UTF-8 bytes plus one. A null text has size 1 and crc32 0, and all null texts are one
    group apart from empty texts. Rows repeated under one doc_id each get a row and a slot, and are counted
    before anything is shuffled; null doc_ids are kept. An empty table gives an empty result. Other columns are ignored;
    texts of any length are read whole.
    """
    slim = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
            F.coalesce(F.md5("text"), F.lit("-")).alias("same_text"),
        )
        .groupBy("doc_id", "size", "text_crc32", "same_text")
        .agg(F.count("*").alias("n"))
    )
    rows, total = slim.agg(F.count("*"), F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0))).first()
    bundle = F.concat(F.lit("bundle "), _number(F.col("same_text")) % bundles)
    items = (
        slim.groupBy("same_text")
        .agg(F.sum(F.col("size") * F.col("n")).alias("size"))
        .groupBy(F.when(F.col("size") > total / bundles, F.col("same_text")).otherwise(bundle).alias("item"))
        .agg(F.sum("size").alias("size"))
    )
    # At most `bundles` groups exceed the mean bundle, so this collects at most 2 x `bundles` rows.
    placed = schedule([(x["item"], x["size"]) for x in items.collect()], n_shards)
    plan = F.broadcast(docs.sparkSession.createDataFrame(placed, "item string, shard int"))
    alone = plan.select(F.col("item").alias("same_text"), F.col("shard").alias("shard_alone"))
    bundled = plan.select(F.col("item").alias("bundle"), F.col("shard").alias("shard_bundled"))
    parts = max(1, math.ceil(rows / slot_rows / n_shards))
    placed_rows = (
        slim.withColumn("bundle", bundle)
        .join(alone, "same_text", "left")
        .join(bundled, "bundle", "left")
        .select(
            *slim.columns,
            F.coalesce("shard_alone", "shard_bundled").alias("shard"),
            (_number(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "same_text"))) % parts).alias("part"),
        )
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed_rows.groupBy("shard", "part")
        .agg(F.sum("n").alias("n"))
        .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "same_text").rowsBetween(Window.unboundedPreceding, -1)
    some, each = numbers_below("n")
    first = (F.col("offset") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("first")
    return (
        placed_rows.join(offsets, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", "shard", "n", first)
        .withColumn("_hundreds", F.explode(some))
        .withColumn("turn", F.explode(each))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first") + F.col("turn")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
