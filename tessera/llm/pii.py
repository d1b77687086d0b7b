"""Personal data by weak supervision.

Strict patterns give the base spans, which always stay. Looser patterns give
candidates, on which labelers vote (+1, -1 or 0): the shape, check digits, gazetteers
and the words around. Expectation-maximisation over the counts of vote patterns
estimates each labeler's reliability and the posterior of each pattern; a logistic
span classifier is then trained on the candidates' features against those
posteriors, and candidates that it accepts are added. Votes and features are a few
signs, so the counts over all documents are a small table of bounded size.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise, table

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@+]")
_DIGIT = re.compile(r"[^0-9]")
_SPELLED = re.compile(r"[(\[{]| dot ", re.I)

_LOOSE = {
    "ip": re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|\(dot\)|\[dot\]|\{dot\}| dot )\s?[0-9]{1,3}){3}(?![0-9A-Za-z])", re.I),
    "card": re.compile(r"(?<![0-9A-Za-z.])[0-9](?:[\x20.-]?[0-9]){12,18}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+.(])(?:\([0-9]{2,5}\)[\x20-]?|[0-9]{2,5}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z.-])"),
}
#: What follows the name in a loose e-mail address. Names are found from here to the left, so that long runs of letters cost no more than their length.
_AT_DOMAIN = re.compile(r"\s?(?:\(at\)|\[at\]|\{at\}| at )\s?[A-Za-z0-9-]+(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\}| dot )\s?[A-Za-z0-9-]+)+", re.I)
#: Ignoring case, these four count as letters as well.
_NAME = _LOCAL | frozenset("\u0130\u0131\u017f\u212a")
_NO_FIRST = frozenset("._%+-")

#: Gazetteers (fixed values): top-level domains, card issuers' prefixes, and words by which each kind is announced or ruled out.
DOMAINS = frozenset("com org net edu gov io co info biz de fr es uk eu us ca ch at it nl be pt".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|30[0-5]|62")
ANNOUNCED = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|courriel|correo|kontakt)\b", re.I),
    "ip": re.compile(r"\b(?:ip|ipv4|host|server|address|adresse|dirección|ping)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|carte|tarjeta|karte|kreditkarte)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|téléphone|teléfono|telefon|handy|appelez)\b", re.I),
}
RULED_OUT = re.compile(r"\b(?:token|key|hash|sha\d*|md5|uuid|isbn|issn|doi|order|invoice|version|serial|id|ref|page|pages)\b", re.I)
LABELERS = ("shape", "checked", "gazetteer", "context")
AROUND = 48


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start: leftmost non-overlapping matches of each kind; matches that fail their check are dropped."""
    spans = []
    if not _ANY.search(text):
        return spans
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                spans.append((0, start, m.end()))
                last = m.end()
    for m in _IP.finditer(text):
        if all(len(x) < 4 and int(x) <= 255 if len(x) < 4 else int(x.lstrip("0")[:4] or 0) <= 255 for x in m[0].split(".")):
            spans.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _DIGIT.sub("", m[0])) <= 19 and luhn(d):
            spans.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.sub("", m[0])) <= 15:
                spans.append((3, m.start(), m.end()))
    return spans


def _votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """Each labeler's vote on one candidate; 0 abstains."""
    span, around = text[start:end], text[max(0, start - AROUND) : start]
    digits = _DIGIT.sub("", span)
    context = -1 if RULED_OUT.search(around) else 1 if ANNOUNCED[kind].search(around) else 0
    if kind == "email":
        last = re.split(r"[^A-Za-z0-9-]+", span)[-1].lower()
        return (1 if re.search(r"[(\[{]", span) else 0, 0, 1 if last in DOMAINS else -1, context)
    if kind == "ip":
        parts = [int(x) for x in re.findall(r"[0-9]+", span)]
        return (1 if len(set(re.split(r"[0-9]+", span)[1:-1])) == 1 else -1, 1 if max(parts) <= 255 else -1, 1 if 0 < parts[0] < 224 else -1, context)
    if kind == "card":
        grouped = 1 if re.fullmatch(r"[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([\x20.-])[0-9]{6}\2[0-9]{5}", span) else 0
        return (grouped, 1 if luhn(digits) else -1, 1 if ISSUERS.match(digits) else -1, context)
    return (1 if "(" in span else 0, 1 if 9 <= len(digits) <= 12 else -1, 0, context)


def loose_mail(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping spans of a name (letters, digits and ._%+-, no mark first) and ``_AT_DOMAIN`` right behind it."""
    spans, last = [], 0
    m = _AT_DOMAIN.search(text)
    while m:
        start = m.start()
        while start > last and text[start - 1] in _NAME:
            start -= 1
        while start < m.start() and text[start] in _NO_FIRST:
            start += 1
        if start < m.start():
            spans.append((start, m.end()))
            last = m.end()
        m = _AT_DOMAIN.search(text, m.end() if start < m.start() else m.start() + 1)
    return spans


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, code) of loose matches clear of every base span and of each other; the code packs votes and features."""
    found: list[tuple[int, int, int, int]] = []
    taken: list[tuple[int, int]] = []  # disjoint, in order
    for _, s, e in sorted(base, key=lambda x: x[1:]):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    for kind in KINDS:
        for start, end in loose_mail(text) if kind == "email" else (m.span() for m in _LOOSE[kind].finditer(text)):
            at = bisect.bisect_left(taken, (end,))
            if at and taken[at - 1][1] > start:
                continue
            votes = _votes(kind, text, start, end)
            code = 0
            for v in votes:
                code = code * 3 + v + 1
            length = min(3, (end - start) // 8)
            # Of mail: spelled out with brackets or " dot "; else it may as well be prose ("look at this. It").
            mixed = int(bool((_SPELLED if kind == "email" else _DIGIT).search(text[start:end])))
            found.append((KINDS.index(kind), start, end, (code * 4 + length) * 2 + mixed))
            taken.insert(at, (start, end))
    return found


def _votes_of(code: np.ndarray) -> np.ndarray:
    code = code // 8
    return np.stack([code // 3**k % 3 - 1 for k in range(len(LABELERS) - 1, -1, -1)], 1)


def _features_of(code: np.ndarray) -> np.ndarray:
    votes = _votes_of(code)
    return np.concatenate([votes > 0, votes < 0, np.eye(4)[code // 2 % 4], (code % 2)[:, None], np.ones((len(code), 1))], 1).astype(float)


def em(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each pattern, reliability of each labeler): independent labelers, abstentions carry nothing.

    A labeler's reliability has a Beta(8, 2) prior and the share of true candidates a Beta(1, 3) one, so
    few or one-sided votes stay near the prior.
    """
    reliability, share = np.full(votes.shape[1], 0.8), 0.25
    posterior = np.full(len(votes), share)
    for _ in range(rounds):
        odds = np.log(share / (1 - share)) + votes @ np.log(reliability / (1 - reliability))
        posterior = 1 / (1 + np.exp(-odds))
        voted = (votes != 0) * counts[:, None]
        right = np.where(votes > 0, posterior[:, None], 1 - posterior[:, None]) * voted
        reliability = np.clip((right.sum(0) + 8) / (voted.sum(0) + 10), 0.55, 0.98)
        share = np.clip((posterior @ counts + 1) / (counts.sum() + 4), 0.01, 0.99)
    return posterior, reliability


def span_classifier(codes: np.ndarray, posterior: np.ndarray, counts: np.ndarray, rounds: int = 400, penalty: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression on the features, fitted to the posteriors by gradient steps over the counted patterns."""
    x, weight = _features_of(codes), counts / counts.sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 2.0 * (x.T @ (weight * (p - posterior)) + penalty * w)
    return w


def train(found: DataFrame, threshold: float = 0.9) -> frozenset:
    """(kind, code) pairs that the classifiers accept, from the ``candidates`` column of all documents."""
    patterns = found.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.code").count()
    # A code packs 3^4 vote patterns, 4 lengths and a flag, so at most 4 x 648 rows are collected.
    rows = np.array([tuple(x) for x in patterns.collect()], dtype=np.int64).reshape(-1, 3)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    accepted = set()
    # Mail that is not spelled out is mostly prose and would drown the few that are, so each sort is judged by itself.
    sort = np.where(rows[:, 0] == 0, rows[:, 1] % 2, 0)
    for kind, part in np.unique(np.stack([rows[:, 0], sort], 1), axis=0):
        _, codes, counts = rows[(rows[:, 0] == kind) & (sort == part)].T
        posterior, _ = em(_votes_of(codes), counts.astype(float))
        p = 1 / (1 + np.exp(-_features_of(codes) @ span_classifier(codes, posterior, counts.astype(float))))
        # Both must agree: the classifier alone may smooth over a pattern that labelers vote against.
        accepted |= {(int(kind), int(c)) for c, a, b in zip(codes, p, posterior) if min(a, b) >= threshold}
    return frozenset(accepted)


_FOUND = "doc_id long, base array<struct<kind:int,start:int,end:int>>, candidates array<struct<kind:int,start:int,end:int,code:int>>"


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base, candidates of each row of ``docs`` (doc_id, text)."""
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    coded = pa.struct([*span, pa.field("code", pa.int32())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                base, more = [], []
                for text in part.column(1).to_pylist():
                    spans = base_spans(text or "")
                    base.append([dict(zip(("kind", "start", "end"), x)) for x in spans])
                    more.append([dict(zip(("kind", "start", "end", "code"), x)) for x in candidates(text or "", spans)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(base, pa.list_(span)), pa.array(more, pa.list_(coded))], ["doc_id", "base", "candidates"]
                )

    return docs.selectExpr("bigint(doc_id) doc_id", "text").mapInArrow(run, _FOUND)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end) in order of kind, then start; spans holds base and the added ones.

    Null and empty texts have no spans. Repeated rows and null doc_ids are kept as they are; an empty
    table gives an empty result. Kinds count as in KINDS; ends are exclusive, in code points.
    """
    found = materialise(find(docs))
    accepted = train(found)
    added = F.filter("candidates", lambda c: F.array_contains(F.array(*[F.lit(k * 10_000 + c) for k, c in sorted(accepted)] or [F.lit(-1)]), c["kind"] * 10_000 + c["code"]))
    plain = F.transform(added, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return found.select("doc_id", F.sort_array("base").alias("base"), F.sort_array(F.concat("base", plain)).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in angle brackets; overlapping spans become one."""
    accepted = train(materialise(find(docs).where("size(candidates) > 0").select("candidates")))
    at, columns = docs.columns.index("text"), docs.columns

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [x if x is None else _redacted(x, accepted) for x in part.column(at).to_pylist()]
                arrays = [pa.array(texts, part.schema.field(at).type) if k == at else part.column(k) for k in range(len(columns))]
                yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return docs.mapInArrow(run, docs.schema)


def _redacted(text: str, accepted: frozenset) -> str:
    base = base_spans(text)
    spans = base + [x[:3] for x in candidates(text, base) if (x[0], x[3]) in accepted]
    out, last = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= last:
            out += [text[last:start], f"<{KINDS[kind].upper()}>"]
        last = max(last, end)
    return "".join([*out, text[last:]]) if out else text


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, KINDS))

    def listed(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    # A lambda's second parameter, even one with a default, would be the place in the array.
    def number(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return detect(table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
