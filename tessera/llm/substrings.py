"""Substring dedup by level-wise doubling: windows of 4, then 8, then 13 words.

A window can only repeat if the windows inside it repeat, so each level asks only about
what the one before it left: anchors (of each 13-word window the 4-word window with the
least hash) that two rows have; the 8-word windows that extend those to the left or
right; and the 13-word windows whose 8-word half repeats. When a level leaves nothing in
a chunk, nothing of it is sent any more.

Texts are written once as chunks of a few MB, in a table bucketed by chunk, so no level
moves them again: a chunk sends what it asks about to buckets, and a bucket answers with
one bit for each question. Levels 4 and 8 ask by 32-bit tags, where a false alarm only
costs a question at the next level. The last level decides: it compares 128-bit
BLAKE2b digests of the words themselves.

A chunk asks about a window once, whatever number of its documents hold it. A passage
that all documents share thus brings 24 bytes of each chunk to one task: about 3 MB
for each TB of text.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import compress
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import delete_path, materialise, shared_folder, table
from tessera.llm.wordhash import _BASE, _mixed

#: UTF-8 bytes of text in a chunk (one text may have more); bytes of questions that meet in a bucket.
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 1 << 20
WINDOW, HALF, QUARTER = 13, 8, 4
#: Questions that each level is expected to ask for each byte of text, in bytes; they only set the number of buckets.
_ASKED = {"anchors": 0.13, "halves": 0.08, "windows": 0.8}
_DIGEST = np.dtype([("hi", "<u8"), ("lo", "<u8"), ("least", "<i8")])
_SENT = "bucket int, part long, asked binary"
_ANSWERED = "part long, bucket int, bits binary"


def _paired(h: np.ndarray, by: int) -> np.ndarray:
    """Hashes of windows made of two (overlapping) ones that start ``by`` words apart."""
    return _mixed(h[: len(h) - by] * _BASE + h[by:]) if len(h) > by else h[:0]


def anchors(h4: np.ndarray, n: int) -> np.ndarray:
    """For each of the first ``n`` windows of 13 words: where its leftmost 4-word window of the least hash starts."""
    width = WINDOW - QUARTER + 1
    best, span = np.arange(len(h4)), 1

    def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(h4[b] < h4[a], b, a)

    while 2 * span <= width:
        best = least(best[: len(best) - span], best[span:])
        span *= 2
    return least(best[:n], best[width - span : width - span + n])


class Chunk:
    """The rows of one chunk in their order, and the windows over their words; rows without a doc_id have none."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        order = np.argsort(rows.column("ord").to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        self.ids = rows.column("doc_id").to_pylist()
        self.words = [(x or b"").split() for x in rows.column("text").cast(pa.large_binary()).to_pylist()]
        taking = [k for k, x in enumerate(self.ids) if x is not None and len(self.words[k]) >= WINDOW]
        size = np.array([len(self.words[k]) for k in taking], np.int64)
        self.row = np.repeat(np.array(taking, np.int64), size)
        self.place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        self.taking = taking
        self.id_of = np.array([self.ids[k] if self.ids[k] is not None else 0 for k in range(len(self.ids))], np.int64)
        self.starts = np.flatnonzero(self.row[: max(0, len(self.row) - WINDOW + 1)] == self.row[WINDOW - 1 :])

    def hashed(self) -> SimpleNamespace:
        """h4, h8; the anchor of each window and whether its 8-word half is the left or the right extension of it."""
        words = (x for k in self.taking for x in self.words[k])
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(self.row))
        h4 = _paired(_paired(h, 1), 2)
        h8 = _paired(h4, QUARTER)
        anchor = anchors(h4, len(self.row) - WINDOW + 1)[self.starts] if len(self.starts) else self.starts
        half = np.where(anchor - self.starts >= HALF - QUARTER, anchor - QUARTER, anchor)
        return SimpleNamespace(h4=h4, h8=h8, anchor=anchor, half=half)

    def digests(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct windows as _DIGEST with the least doc_id here, the one of each window); ``windows`` are words where they start."""
        if not len(windows):
            return np.empty(0, _DIGEST), np.empty(0, np.int64)
        made = []
        row, place = self.row[windows], self.place[windows]
        for at in np.split(np.arange(len(windows)), np.flatnonzero(np.diff(row)) + 1):
            words = self.words[row[at[0]]]
            text = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            first = np.concatenate([[0], ends])
            begin, end = first[place[at]].tolist(), (ends[place[at] + WINDOW - 1] - 1).tolist()
            made += [hashlib.blake2b(text[a:b], digest_size=16).digest() for a, b in zip(begin, end)]
        pairs = np.frombuffer(b"".join(made), "<u8").reshape(-1, 2)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        new = np.concatenate([[True], (pairs[order][1:] != pairs[order][:-1]).any(1)])
        of_window = np.empty(len(windows), np.int64)
        of_window[order] = np.cumsum(new) - 1
        out = np.empty(int(new.sum()), _DIGEST)
        out["hi"], out["lo"] = pairs[order][new].T
        out["least"] = np.minimum.reduceat(self.id_of[row[order]], np.flatnonzero(new))
        return out, of_window


def _dealt(own: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of distinct hashes by bucket, where each bucket begins in it, and the end)."""
    bucket = (_mixed(own) >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))


def _rows(part: int, asked: np.ndarray, own: np.ndarray, buckets: int, memo: np.ndarray | None = None) -> pa.Table:
    """What a chunk sends: a row for each bucket, and what it will know again (bits) under a bucket below 0."""
    order, ends = _dealt(own, buckets)
    held = np.flatnonzero(np.diff(ends))
    payload = [asked[order[ends[b] : ends[b + 1]]].tobytes() for b in held]
    where = held.tolist()
    if memo is not None:
        where, payload = [*where, -1 - ((part >> 24) * 7919 + part % (1 << 24)) % (1 << 30)], [*payload, np.packbits(memo).tobytes()]
    return pa.table({"bucket": pa.array(where, pa.int32()), "part": pa.array([part] * len(where), pa.int64()), "asked": pa.array(payload, pa.binary())})


def _answers(answered: pa.Table, own: np.ndarray, buckets: int) -> np.ndarray:
    """The answer to each question of a chunk."""
    order, ends = _dealt(own, buckets)
    out = np.zeros(len(own), bool)
    for b, bits in zip(answered.column("bucket").to_pylist(), answered.column("bits").to_pylist()):
        if b >= 0:
            mine = order[ends[b] : ends[b + 1]]
            out[mine] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(mine)).astype(bool)
    return out


def _memo(answered: pa.Table, n: int) -> np.ndarray:
    for b, bits in zip(answered.column("bucket").to_pylist(), answered.column("bits").to_pylist()):
        if b < 0:
            return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
    return np.zeros(n, bool)


def _found(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, the one of each, whether two rows have it)."""
    own, inverse = np.unique(hashes, return_inverse=True)
    low = np.full(len(own), np.iinfo(np.int64).max)
    high = np.full(len(own), -1, np.int64)
    np.minimum.at(low, inverse, rows)
    np.maximum.at(high, inverse, rows)
    return own, inverse, low < high


def _places(n: int, where: np.ndarray) -> np.ndarray:
    """Distinct places below ``n``, in order."""
    marked = np.zeros(n, bool)
    marked[where] = True
    return np.flatnonzero(marked)


def _anchor_questions(c: Chunk, h: SimpleNamespace):
    at = _places(len(c.row), h.anchor)
    own, inverse, twice = _found(h.h4[at], c.row[at])
    return at, own, inverse, twice


def _half_questions(c: Chunk, h: SimpleNamespace, alive: np.ndarray):
    """Of the windows whose anchor is alive."""
    at = _places(len(c.row), h.half[alive[h.anchor]])
    own, inverse, twice = _found(h.h8[at], c.row[at])
    return at, own, inverse, twice


def _tags(own: np.ndarray) -> np.ndarray:
    return own.astype(np.uint32)


def _level_4(buckets: dict):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        c = Chunk(rows)
        _, own, _, _ = _anchor_questions(c, c.hashed())
        return _rows(key[0].as_py(), _tags(own), own, buckets["anchors"])

    return run


def _level_8(buckets: dict):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, answered: pa.Table) -> pa.Table:
        c = Chunk(rows)
        h = c.hashed()
        at, own, inverse, twice = _anchor_questions(c, h)
        alive = np.zeros(len(c.row), bool)
        alive[at] = (twice | _answers(answered, own, buckets["anchors"]))[inverse]
        _, own, _, _ = _half_questions(c, h, alive)
        return _rows(key[0].as_py(), _tags(own), own, buckets["halves"], alive)

    return run


def _level_13(buckets: dict):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, answered: pa.Table) -> pa.Table:
        c = Chunk(rows)
        h = c.hashed()
        anchored = _memo(answered, len(c.row))
        at, own, inverse, twice = _half_questions(c, h, anchored)
        half = np.zeros(len(c.row), bool)
        half[at] = (twice | _answers(answered, own, buckets["halves"]))[inverse]
        alive = np.zeros(len(c.row), bool)
        alive[c.starts] = anchored[h.anchor] & half[h.half]
        asked, _ = c.digests(np.flatnonzero(alive))
        return _rows(key[0].as_py(), asked, asked["hi"], buckets["windows"], alive)

    return run


def _repeated(rows: pa.Table) -> pa.Table:
    """A bucket of tags: whether two chunks ask for a tag."""
    return _bucket(rows, np.dtype("<u4"), lambda tag, part: _found(tag, part)[2][np.unique(tag, return_inverse=True)[1]])


def _smaller(rows: pa.Table) -> pa.Table:
    """A bucket of windows: whether another chunk has it in a smaller document."""

    def answer(x: np.ndarray, part: np.ndarray) -> np.ndarray:
        order = np.lexsort((x["lo"], x["hi"]))
        s = x[order]
        runs = np.flatnonzero(np.concatenate([[True], (s["hi"][1:] != s["hi"][:-1]) | (s["lo"][1:] != s["lo"][:-1])]))
        out = np.empty(len(x), bool)
        out[order] = s["least"] > np.repeat(np.minimum.reduceat(s["least"], runs), np.diff(runs, append=len(s)))
        return out

    return _bucket(rows, _DIGEST, answer)


def _bucket(rows: pa.Table, kind: np.dtype, answer) -> pa.Table:
    bucket, part, asked = (rows.column(x) for x in ("bucket", "part", "asked"))
    asked = asked.to_pylist()
    if bucket[0].as_py() < 0:  # chunks' memos go back as they are
        bits = asked
    else:
        parts = [np.frombuffer(x, kind) for x in asked]
        size = [len(x) for x in parts]
        out = answer(np.concatenate(parts), np.repeat(part.to_numpy(), size))
        bits = [np.packbits(x).tobytes() for x in np.split(out, np.cumsum(size)[:-1])]
    return pa.table({"part": part.cast(pa.int64()), "bucket": bucket.cast(pa.int32()), "bits": pa.array(bits, pa.binary())})


def removed_words(n_words: int, windows: np.ndarray) -> np.ndarray:
    """Whether each word is covered by a window that starts at one of these words."""
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, windows, 1)
    np.add.at(steps, windows + WINDOW, -1)
    return np.cumsum(steps[:-1]) > 0


def _finished(buckets: dict, digest: bool):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] if digest else ["doc_id", "n_words", "n_removed", "kept", "removed"]

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, answered: pa.Table) -> pa.Table:
        c = Chunk(rows)
        windows = np.flatnonzero(_memo(answered, len(c.row)))
        asked, of_window = c.digests(windows)
        again = _answers(answered, asked["hi"], buckets["windows"])[of_window]
        windows = windows[again | (c.id_of[c.row[windows]] > asked["least"][of_window])]
        ends = np.searchsorted(c.row[windows], np.arange(len(c.ids) + 1))
        n, removed, out, spans = [], [], [], []
        for k, words in enumerate(c.words):
            n.append(len(words))
            gone = removed_words(len(words), c.place[windows[ends[k] : ends[k + 1]]]) if ends[k] < ends[k + 1] else None
            removed.append(int(gone.sum()) if gone is not None else 0)
            left = b" ".join(words if gone is None else compress(words, (~gone).tolist()))
            out.append(hashlib.sha256(left).hexdigest() if digest else left.decode())
            if not digest:
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(np.int8))) if gone is not None else np.empty(0, int)
                spans.append([{"first": int(a), "words": int(b - a)} for a, b in edges.reshape(-1, 2)])
        arrays = [pa.array(c.ids, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())]
        if not digest:
            arrays.append(pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))))
        return pa.Table.from_arrays(arrays, names)

    return run


class _Chunks:
    """``docs`` (doc_id, text) as a table of chunks in the shared folder, bucketed by chunk."""

    def __init__(self, docs: DataFrame, total: int):
        self.spark = docs.sparkSession
        self.name = f"substrings_{uuid.uuid4().hex}"
        # With fewer buckets than shuffle partitions the planner would shuffle the texts after all. Beyond the most that a table may
        # have, several chunks share a bucket; chunks are told apart by part.
        most = int(self.spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
        n = min(most, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-total // CHUNK_BYTES)))
        size = CHUNK_BYTES

        def numbered(batches):
            part, used, place = TaskContext.get().partitionId() << 24, 0, 0
            for batch in batches:
                lengths = batch.column(1).cast(pa.large_binary())
                parts, ords = [], []
                for x in pa.compute.binary_length(lengths).fill_null(0).to_pylist():
                    if used and used + x > size:
                        part, used, place = part + 1, 0, 0
                    parts.append(part)
                    ords.append(place)
                    used, place = used + x + 16, place + 1
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(ords, pa.int32()), batch.column(0), batch.column(1)], ["part", "ord", "doc_id", "text"])

        made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(numbered, "part long, ord int, doc_id long, text string")
        self.path = f"{shared_folder(self.spark)}/{self.name}"
        made.write.bucketBy(int(n), "part").option("path", self.path).saveAsTable(self.name, format="parquet")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_path(self.spark, self.path)


def _without_repeats(docs: DataFrame, digest: bool) -> DataFrame:
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))).first()[0] or 0
    buckets = {level: int(1 + total * share // BUCKET_BYTES) for level, share in _ASKED.items()}
    chunks = _Chunks(docs, total)
    texts = chunks.read().groupBy("part")

    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def answered(sent: DataFrame, by) -> DataFrame:
        # Buckets in turn instead of by a hash, which would put twice the mean into some task.
        return sent.repartitionById(partitions, F.col("bucket")).groupBy("bucket").applyInArrow(by, _ANSWERED)

    first = answered(texts.applyInArrow(_level_4(buckets), _SENT), _repeated)
    second = answered(texts.cogroup(first.groupBy("part")).applyInArrow(_level_8(buckets), _SENT), _repeated)
    third = answered(texts.cogroup(second.groupBy("part")).applyInArrow(_level_13(buckets), _SENT), _smaller)
    columns = "doc_id long, n_words long, n_removed long, " + ("kept_sha256 string" if digest else "kept string, removed array<struct<first:long,words:long>>")
    done = materialise(texts.cogroup(third.groupBy("part")).applyInArrow(_finished(buckets, digest), columns))
    chunks.drop()
    return done


def kept_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space), removed (first word and number of each run) for each row of ``docs``.

    Null texts have no words. Rows without a doc_id neither lose words nor make others lose them; rows that share a
    doc_id do not make each other lose words. Texts of any length are read whole (a text is in one chunk). Other
    columns are ignored; an empty table gives an empty result.
    """
    return _without_repeats(docs, digest=False)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no words and the hash of the empty string; an empty table gives an empty result."""
    return _without_repeats(table(spark, sf_dir, "documents"), digest=True)
