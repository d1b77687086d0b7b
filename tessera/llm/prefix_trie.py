"""A trie of conversations by chained prefix digests.

Each turn is hashed by itself, so that texts are not shuffled a second time; the digest of
a prefix is that of the prefix before it and the turn's hash. Every prefix of every
conversation is a row; rows grouped by (depth, digest) are the trie's nodes, owned by the
least conversation that starts with them. A conversation owns a node only if it owns all
nodes below on its own way, so owned nodes form one path to each conversation's end.
For sums over subtrees each path, summed up first, is exploded to all paths that it
descends from, at the node where it leaves them, and running sums along each path do the
rest: the same sums as by exploding every node to every ancestor, in time that does not grow
with the square of a conversation's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Written, table

#: A rebuilt conversation takes its lead from the conversation whose id is the next lower multiple of LEAD.
LEAD = 5
#: A lead has below so many turns.
LEAD_TURNS = 9
#: Nodes with one in HEAVY of all prefixes as members, or more, are joined by broadcast: as counts add up to the number of prefixes,
#: there are at most HEAVY of them.
HEAVY = 10_000
#: Ids of conversations that end in a node are joined in ranges of 2**ID_BITS before they are hashed.
ID_BITS = 12


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), turn_key (SHA-256 of role and text), bytes of each turn; rows without conv_id go.

    By turn, null first, then by role and text; null roles and texts are empty.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), text("role").alias("role"), text("text").alias("text")).where("conv_id IS NOT NULL")
    # The role's length tells where the text begins.
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return rows.select("conv_id", F.row_number().over(order).alias("place"), key.alias("turn_key"), F.octet_length("text").cast("long").alias("bytes"))


def rebuilt(ordered: DataFrame) -> DataFrame:
    """conv_id, part, place, turn_key, bytes: a row without key for each conversation (part 0), the turns of its lead (1) and its own (2).

    Only the first turns of leads travel, fewer than LEAD_TURNS each, to at most LEAD - 1 conversations; whole conversations stay where they are.
    """
    lead_turns = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(LEAD_TURNS))
    conversations = ordered.where("place = 1").select("conv_id")
    roots = conversations.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("place"), F.lit(None).cast("binary").alias("turn_key"), F.lit(0).cast("long").alias("bytes"))
    own_lead = F.col("conv_id") % LEAD == 0
    own = ordered.where(own_lead | (F.col("place") > lead_turns)).select("conv_id", F.lit(2).alias("part"), "place", "turn_key", "bytes")
    # Ids of one sign count away from zero: the conversations led by c are those whose id divided by LEAD, cut off, is c's.
    followers = F.when(F.col("conv_id") > 0, F.sequence(F.lit(1), F.lit(LEAD - 1))).when(F.col("conv_id") < 0, F.sequence(F.lit(1 - LEAD), F.lit(-1), F.lit(1))).otherwise(
        F.array(*[F.lit(k) for k in range(1 - LEAD, LEAD) if k])
    )
    leads = ordered.where(own_lead & (F.col("place") < LEAD_TURNS)).select(F.col("conv_id").alias("lead"), "place", "turn_key", "bytes", F.explode(followers).alias("step"))
    leads = leads.select((F.col("lead") + F.col("step")).alias("conv_id"), F.lit(1).alias("part"), "place", "turn_key", "bytes").where(F.col("place") <= lead_turns)
    return roots.unionByName(leads.join(conversations, "conv_id", "left_semi")).unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, digest, bytes (of the last turn's text), is_end of every prefix of every rebuilt conversation, the empty one included.

    Each conversation's turns are chained in order as a stream, so that a long one needs no memory.
    """

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, depth, digest, held = None, 0, b"", None  # held: the last row, until it is known whether its conversation goes on
        for batch in batches:
            out: list[tuple] = []
            for c, key, size in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if held is not None:
                    out.append((*held, c != conv))
                if c != conv:
                    conv, depth, digest = c, 0, b""
                else:
                    depth, digest = depth + 1, hashlib.sha256(digest + key).digest()
                held = (c, depth, digest, size)
            yield _batch(out)
        if held is not None:
            yield _batch([(*held, True)])

    # Dealt by a hash of the id, not by the id: Spark leaves out an exchange that the parts of the union already have, and then
    # coalesces each of them by itself, so that the rows of a conversation would lie apart.
    rows = rebuilt(ordered_turns(turns)).repartition(F.xxhash64("conv_id")).sortWithinPartitions("conv_id", "part", "place")
    return rows.select("conv_id", "turn_key", "bytes").mapInArrow(chain, "conv_id long, depth int, digest binary, bytes long, is_end boolean")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"conv_id": pa.int64(), "depth": pa.int32(), "digest": pa.binary(), "bytes": pa.int64(), "is_end": pa.bool_()}
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], list(kinds))


def _owners(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """``paths`` with their nodes' owner and n_convs: nodes with a large share of all rows by broadcast, all others by a join whose keys are then small."""
    least = F.greatest(F.lit(2), F.ceil(nodes.select(F.sum("n_convs").alias("n")).scalar() / HEAVY))
    marked = nodes.select("depth", "digest", "owner", "n_convs", (F.col("n_convs") >= least).alias("heavy"))
    heavy = marked.where("heavy").drop("heavy")
    first = paths.join(F.broadcast(heavy), ["depth", "digest"], "left")
    rest = first.where("owner IS NULL").drop("owner", "n_convs").join(marked.where("NOT heavy").drop("heavy"), ["depth", "digest"])
    return first.where("owner IS NOT NULL").unionByName(rest)


def _ends(paths: DataFrame) -> DataFrame:
    """depth, digest, ends_sha256 of the nodes in which conversations end: the hash of their ids in order.

    A range of ids is joined in one array of at most 2**ID_BITS, so ranges, not conversations, meet in a node's stream,
    which is hashed as it comes: SHA-256 reads its input in order, so this is one task a node, without memory.
    """
    ranges = paths.where("is_end").groupBy("depth", "digest", F.shiftright("conv_id", ID_BITS).alias("range")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["depth", "digest", "ends_sha256"]
        key, state, out = None, None, []
        for batch in batches:
            for depth, digest, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (depth, digest) != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (depth, digest), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.string()))], names)
                out = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, state.hexdigest()), (pa.int32(), pa.binary(), pa.string()))], names)

    ordered = ranges.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "range")
    return ordered.select("depth", "digest", "ids").mapInArrow(fold, "depth int, digest binary, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, digest of each node of the trie over ``turns`` (conv_id, turn, role, text).

    Rows without conv_id take no part. Turns of one conversation with equal numbers come by role, then text; repeated rows are turns
    of their own. Null roles and texts are empty, texts of any length are hashed whole, other columns are ignored, whatever their names. An
    empty table has no root and gives an empty result.
    """
    paths = Written(prefixes(turns)).read()
    nodes = Written(paths.groupBy("depth", "digest").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))).read()
    owned = _owners(paths.select("conv_id", "depth", "digest"), nodes)
    # The paths that each conversation's way runs along, and where it leaves them; conversations that own nothing end in others' paths.
    ways = Written(owned.groupBy("conv_id", "owner").agg(F.max("depth").alias("leaves_at"))).read()
    held = ways.where("conv_id = owner").select("conv_id")
    above = ways.where("conv_id <> owner").join(held, "conv_id", "left_semi")
    parents = above.groupBy("conv_id").agg(F.max_by("owner", "leaves_at").alias("parent"), F.max("leaves_at").alias("leaves_at"))
    own_saved = (F.col("n_convs") - 1) * F.col("bytes")
    # Children on the path itself are one a node, but for its last node; the others are the paths that leave it there.
    lengths = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.max("depth").alias("last"), F.sum(own_saved).alias("path_saved"))
    branches = parents.groupBy(F.col("parent").alias("owner"), F.col("leaves_at").alias("depth")).agg(F.count("*").alias("branches"))
    tails = lengths.join(branches.select(F.col("owner").alias("conv_id"), F.col("depth").alias("last"), "branches"), ["conv_id", "last"], "left")
    sums = tails.select("conv_id", "path_saved", F.col("branches").isNull().cast("long").alias("path_leaves"))
    below = above.join(sums, "conv_id").groupBy("owner", F.col("leaves_at").alias("depth")).agg(F.sum("path_saved").alias("below_saved"), F.sum("path_leaves").alias("below_leaves"))
    here = nodes.join(below, ["owner", "depth"], "left").join(branches, ["owner", "depth"], "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    path = Window.partitionBy("owner").orderBy(F.desc("depth"))
    on_path = F.lag("depth").over(path).isNotNull().cast("long")
    here = here.withColumn("n_children", none(F.col("branches")) + on_path)
    so_far = path.rowsBetween(Window.unboundedPreceding, 0)
    summed = here.select(
        F.col("owner").alias("conv_id"), "depth", "digest", "n_convs", "n_children",
        F.sum(none(F.col("below_leaves")) + (F.col("n_children") == 0).cast("long")).over(so_far).alias("n_leaves"),
        F.sum(none(F.col("below_saved")) + own_saved).over(so_far).alias("saved_tokens"),
    )
    parent = F.when(F.col("leaves_at") == F.col("depth") - 1, F.col("parent")).when(F.col("depth") > 0, F.col("conv_id"))
    named = summed.join(parents, "conv_id", "left").join(_ends(paths), ["depth", "digest"], "left")
    return named.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "digest",
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations")).drop("digest")
