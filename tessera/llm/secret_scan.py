"""Secrets: strict patterns, and windows of high Shannon entropy over candidate strings.

Three patterns give the base spans, which always stay. Beyond them, each character class
has candidates, the maximal runs of its characters that fill a window. The window slides
over a candidate one character at a time: the count of the character that leaves and of
the one that enters change the sum of n log n over the counts, so the entropy follows from
running totals (integers, so it does not hang on the order of summing). Overlapping
windows that reach the class's entropy make one span, unless the allow-list knows it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, table
from tessera.llm.wordhash import _texts

BASE = ("assign", "access", "hex")
#: Letters of the names count in both ASCII cases and in no other.
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED, LEAST_ACCESS = 12, 18


@dataclass(frozen=True)
class CharacterClass:
    """Candidates are runs of ``characters`` of ``window`` and more; ``bits`` is the entropy from which a window is a secret's."""

    name: str
    characters: str
    window: int
    bits: float


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharacterClass("base64", _DIGITS + _LOWER + _UPPER + "+/_=-", 24, 4.0),
    CharacterClass("base16", _DIGITS + "abcdefABCDEF", 24, 3.0),
)
KINDS = (*BASE, *(c.name for c in CLASSES))

#: The allow-list: what a whole span may be, what it may hold, and what may stand before it. Words and numbers with marks between
#: them (paths, identifiers), UUIDs and digits; placeholders; digests that are named as such.
WORDS = r"(?:(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|[0-9]++)[-_/+=]*+)++"
UUID = r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
WHOLE = (WORDS, UUID)
INSIDE = (r"(?i)example|placeholder|changeme|dummy|xxxx|your[-_]?(?:key|token|secret)",)
BEFORE = (r"(?i)(?:sha-?(?:1|224|256|384|512)|md5|checksum|digest|integrity|commit|etag)[-:=_\x20\"']{0,3}$",)
#: Spans of so large a share of steps from a character to the next one of the code (abcdef, 012345) are alphabets, not secrets.
STEPS = 0.8
#: How many characters before a span are held against BEFORE.
AROUND = 16
#: Texts of so many bytes are scanned at once.
BLOCK_BYTES = 4 << 20
_UNIT = 1 << 20


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order: leftmost non-overlapping matches of each kind; matches that are too short are dropped."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def _runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal runs of ``least`` bytes and more that ``inside`` has, cut at ``offsets``."""
    held = np.zeros(len(data) + 2, bool)
    held[1:-1] = inside[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(held[1:-1] & (~held[:-2] | cut[:-1]))
    ends = np.flatnonzero(held[1:-1] & (~held[2:] | cut[1:])) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def _sums(window: int) -> np.ndarray:
    """n log2 n for counts up to the window, in units of 2**-20."""
    return np.array([0, *(round(n * math.log2(n) * _UNIT) for n in range(1, window + 1))], np.int64)


def dense_windows(codes: np.ndarray, lengths: np.ndarray, window: int, bits: float) -> np.ndarray:
    """Whether the window from each place of the candidates (end to end in ``codes``) reaches ``bits``; places without a whole window do not.

    The totals at one window are those at the one before, less what the character that leaves takes away
    and plus what the one that enters brings, each by its count in the window; running sums give them all at once.
    """
    n = len(codes)
    run = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(n)
    key = run * 256 + codes
    held = np.sort(key * n + place)  # the places of each character of each candidate, in order
    rank = np.searchsorted(held, key * n + place)
    seen = rank + 1 - np.searchsorted(held, key * n + np.maximum(place - window + 1, 0))
    left = np.searchsorted(held, key * n + np.minimum(place + window, n)) - rank
    cost = _sums(window)
    entered = np.concatenate([[0], np.cumsum(cost[seen] - cost[seen - 1])])
    gone = np.concatenate([[0], np.cumsum(cost[left] - cost[left - 1])])
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    end = np.repeat(np.cumsum(lengths), lengths)
    total = entered[np.minimum(place + window, n)] - entered[first] - gone[place] + gone[first]
    return (place + window <= end) & (total <= math.floor(window * (math.log2(window) - bits) * _UNIT))


def _class_spans(data: np.ndarray, offsets: np.ndarray, kind: CharacterClass) -> list[tuple[int, int]]:
    """(start, end) in bytes of the joined windows of one class."""
    inside = np.zeros(256, bool)
    inside[np.frombuffer(kind.characters.encode(), np.uint8)] = True
    starts, ends = _runs(data, offsets, inside, kind.window)
    if not len(starts):
        return []
    lengths = ends - starts
    at = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    dense = np.flatnonzero(dense_windows(data[at].astype(np.int64), lengths, kind.window, kind.bits))
    if not len(dense):
        return []
    run = np.repeat(np.arange(len(lengths)), lengths)[dense]
    fresh_span = np.concatenate([[True], (np.diff(dense) > kind.window) | (np.diff(run) > 0)])
    last = np.append(np.flatnonzero(fresh_span)[1:] - 1, len(dense) - 1)
    return list(zip(at[dense[fresh_span]].tolist(), (at[dense[last]] + kind.window).tolist()))


class AllowList:
    """Patterns of spans that are no secrets: of the whole span, of a part of it, or of what stands before it."""

    def __init__(self, whole: tuple[str, ...] = WHOLE, inside: tuple[str, ...] = INSIDE, before: tuple[str, ...] = BEFORE):
        self.whole, self.inside, self.before = ([re.compile(x) for x in y] for y in (whole, inside, before))

    def knows(self, text: str, start: int, end: int) -> bool:
        span, around = text[start:end], text[max(0, start - AROUND) : start]
        steps = sum(ord(b) - ord(a) == 1 for a, b in zip(span, span[1:]))
        return (
            steps >= STEPS * (len(span) - 1)
            or any(x.fullmatch(span) for x in self.whole)
            or any(x.search(span) for x in self.inside)
            or any(x.search(around) for x in self.before)
        )


def _added(texts: list[str], data: np.ndarray, offsets: np.ndarray, allowed: AllowList) -> dict[int, list[tuple[int, int, int]]]:
    """(start, kind, end) in code points of each text's joined windows that the allow-list does not know."""
    spans: dict[int, list[tuple[int, int, int]]] = {}
    points = None
    for k, kind in enumerate(CLASSES):
        for start, end in _class_spans(data, offsets, kind):
            if points is None:  # code points before each byte
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            n = int(np.searchsorted(offsets, start, "right")) - 1
            first = int(points[start] - points[offsets[n]])
            if not allowed.knows(texts[n], first, first + end - start):
                spans.setdefault(n, []).append((first, len(BASE) + k, first + end - start))
    return spans


def scan_texts(texts: list[str], data: np.ndarray, offsets: np.ndarray, allowed: AllowList) -> list[list[tuple[int, int, int]]]:
    """All spans (start, kind, end) of each text, in order; an added one that lies inside another span is left out."""
    added = _added(texts, data, offsets, allowed)
    out = []
    for n, text in enumerate(texts):
        spans, reach = base_spans(text), 0
        if n in added:
            every, spans = sorted(spans + added[n]), []
            for start, kind, end in every:
                if kind < len(BASE) or end > reach:
                    spans.append((start, kind, end))
                    reach = max(reach, end)
        out.append(spans)
    return out


def _found(text: Column, columns: list[tuple[str, Column]], docs: DataFrame, allowed: AllowList | None) -> DataFrame:
    """``columns`` and ``spans`` of each row, by Arrow batches that are scanned in blocks of bounded size."""
    allowed = allowed or AllowList()
    rows = docs.select(*[c.alias(name) for name, c in columns], text.alias("_scanned"))
    names, place = [name for name, _ in columns], len(columns)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _texts(batch, place)
            at = 0
            while at < batch.num_rows:
                to = int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1
                to = min(max(to, at + 1), batch.num_rows)
                part = batch.slice(at, to - at)
                texts = [x or "" for x in part.column(place).to_pylist()]
                spans = scan_texts(texts, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], allowed)
                named = pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in x] for x in spans], span)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], named], [*names, "spans"])
                at = to

    held = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{held}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def find(docs: DataFrame, allowed: AllowList | None = None) -> DataFrame:
    """doc_id and ``spans`` (kind, start, end: code points, end exclusive; by start, then kind) of each row of ``docs`` (doc_id, text).

    A null text is empty; texts of any length are scanned whole. Repeated rows and null doc_ids are kept, other columns are
    ignored, an empty table gives an empty result. Ties cannot be: two spans of one kind never start at one place.
    """
    return _found(F.col("text"), [("doc_id", F.col("doc_id").cast("long"))], docs, allowed)


def masked(docs: DataFrame, allowed: AllowList | None = None) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by its kind in angle brackets; spans that overlap are replaced together, by the first one's kind.

    Rows, null texts and other columns, whatever their names, stay as they are.
    """
    row = fresh("row")
    found = _found(F.col(f"{row}.text"), [(row, F.col(row))], docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row)), allowed)
    pieces = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("said"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(F.concat(a["said"], F.substr(F.col(f"{row}.text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("said"), s["end"].alias("at")),
        ).otherwise(F.struct(a["said"].alias("said"), F.greatest(a["at"], s["end"]).alias("at"))),
        lambda a: F.concat(a["said"], F.substr(F.col(f"{row}.text"), (a["at"] + 1).cast("int"))),
    )
    text = F.when(F.size("spans") > 0, pieces).otherwise(F.col(f"{row}.text"))
    return found.select(*[(text if c == "text" else F.col(row)[c]).alias(c) for c in docs.columns])


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
