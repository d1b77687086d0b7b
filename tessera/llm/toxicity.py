"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own embedding (words of the training sample that are frequent
enough; one embedding for the others) and the sum of its character runs' embeddings.
Overlapping windows of words run through a GRU in both directions; attention pools
the states to a logit. A document's score is that of its highest window, calibrated.
Training is multiple-instance: each document teaches through its highest window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.wordhash import _BASE, _BYTE, _M1, _texts, word_hashes

#: The classifier is fitted on at most so many labelled texts of each class (those with the least hash of doc_id) and bytes
#: of them; texts of more than SAMPLE_TEXT bytes are left out of the sample (they are scored like all others).
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 3000
SAMPLE_BYTES, SAMPLE_TEXT = 12 << 20, 1 << 19
#: A word of the vocabulary is in so many documents of the sample at least, and in one of so many.
VOCABULARY, LEAST_DOCUMENTS, LEAST_SHARE = 16384, 5, 250
WINDOW, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN = 10, 6, 8
STEPS, REFRESH, BATCH = 200, 40, 256
#: A log odds counted in SHRINK documents is halved.
SHRINK = 10
THRESHOLD = 0.3
#: Texts of so many bytes are scored at once.
BLOCK_BYTES = 1 << 20
#: Words and windows go through matrix products so many at a time, the last ones filled up: a product rounds by its shape, and
#: a text's score must not hang on the texts beside it.
ROWS = 2048
#: Documents of the sample that are counted at once.
SLICE = 256

_ASCII = np.arange(128)
_LETTER = ((_ASCII | 32) >= 97) & ((_ASCII | 32) <= 122)
_BETWEEN = np.concatenate([~(_LETTER | ((_ASCII >= 48) & (_ASCII <= 57))), np.zeros(128, bool)])
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
#: A word's characters enter as runs of GRAM bytes of the word behind a mark, hashed into GRAMS rows.
GRAM, GRAMS = 5, 1 << 16
_CODE = np.arange(1, 257, dtype=np.uint64)
_CODE[65:91] = _CODE[97:123]


@dataclass
class Model:
    words: np.ndarray  # sorted hashes of the vocabulary
    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: tuple[float, float] = (1.0, 0.0)


@dataclass
class Block:
    """Texts as words: the distinct words (hash, rows of its characters) and the windows over them."""

    hashes: np.ndarray
    grams: np.ndarray  # rows of all distinct words' characters, end to end
    first: np.ndarray  # where each word's rows start, and the end
    windows: np.ndarray  # places in the distinct words, or their number for padding
    doc: np.ndarray  # of each window
    n: int


def read_block(data: np.ndarray, offsets: np.ndarray) -> Block:
    hashes, first = word_hashes(data, offsets, _BETWEEN, _FOLDED)
    n = len(offsets) - 1
    own, place, of_word = np.unique(hashes, return_index=True, return_inverse=True)
    inside = ~_BETWEEN[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    grams, gram_first = np.empty(0, np.int32), np.zeros(1, np.int64)
    if len(own):
        places = np.flatnonzero(inside)
        at = np.searchsorted(places, np.flatnonzero(begins))
        lengths = np.diff(at, append=len(places))[place]
        spots = np.repeat(at[place] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        marked = lengths + GRAM  # a mark before each word, and room behind it
        start = np.cumsum(marked) - marked
        code = np.zeros(marked.sum() + GRAM, np.uint64)
        code[start] = 999
        code[np.repeat(start + 1 - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())] = _CODE[data[places[spots]]]
        count = np.maximum(1, lengths + 2 - GRAM)
        gram_first = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(start - gram_first[:-1], count) + np.arange(gram_first[-1])
        mixed = np.zeros(len(at), np.uint64)
        for k in range(GRAM):
            mixed = mixed * _BASE + code[at + k]
        grams = ((mixed * _M1) >> np.uint64(40)).astype(np.int32) % GRAMS
    size = np.diff(first)
    windows = np.maximum(1, -(-(size - WINDOW) // STRIDE) + 1)  # the last one reaches the end
    doc = np.repeat(np.arange(n), windows)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = np.minimum(number * STRIDE, np.maximum(0, size[doc] - WINDOW))
    at = start[:, None] + np.arange(WINDOW)
    inside_doc = at < size[doc][:, None]
    padded = np.append(of_word, len(own)).astype(np.int32)
    index = np.where(inside_doc, np.minimum(first[:-1][doc][:, None] + at, len(of_word)), len(of_word))
    return Block(own, grams, gram_first, padded[index], doc, n)


def read_blocks(data: np.ndarray, offsets: np.ndarray) -> Block:
    """As ``read_block``, which takes some 30 times the memory of its texts, about BLOCK_BYTES at a time."""
    parts, at, n = [], 0, len(offsets) - 1
    while at < n:
        to = min(max(int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1, at + 1), n)
        parts.append(read_block(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]))
        at = to
    if len(parts) < 2:
        return parts[0] if parts else read_block(data, offsets)
    own, place, of_word = np.unique(np.concatenate([x.hashes for x in parts]), return_index=True, return_inverse=True)
    count = np.concatenate([np.diff(x.first) for x in parts])
    start = (np.cumsum(count) - count)[place]
    count = count[place]
    first = np.concatenate([[0], np.cumsum(count)])
    grams = np.concatenate([x.grams for x in parts])[np.repeat(start - first[:-1], count) + np.arange(first[-1])]
    windows, docs, words, texts = [], [], 0, 0
    for x in parts:
        windows.append(np.append(of_word[words : words + len(x.hashes)], len(own)).astype(np.int32)[x.windows])
        docs.append(x.doc + texts)
        words, texts = words + len(x.hashes), texts + x.n
    return Block(own, grams, first, np.concatenate(windows), np.concatenate(docs), texts)


def _rows(block: Block, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(character rows of some distinct words end to end, where each word's start)."""
    count = np.diff(block.first)[own]
    start = np.cumsum(count) - count
    return block.grams[np.repeat(block.first[own] - start, count) + np.arange(count.sum())], start


def _inputs(m: Model, hashes: np.ndarray, grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vocabulary row, input vector) of distinct words; the last row of the vocabulary is for unknown words."""
    at = np.minimum(np.searchsorted(m.words, hashes), max(0, len(m.words) - 1))
    row = np.where(m.words[at] == hashes, at, len(m.words)) if len(m.words) else np.zeros(len(hashes), np.int64)
    char = np.add.reduceat(m.p["char"][grams], first) if len(first) else np.empty((0, CHAR_DIM), np.float32)
    return row, np.concatenate([m.p["word"][row], char], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -80, 80)))


def _product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, by ROWS rows at a time."""
    out = np.zeros((-(-len(x) // ROWS) * ROWS, x.shape[1]), x.dtype)
    out[: len(x)] = x
    return (out.reshape(-1, ROWS, x.shape[1]) @ w).reshape(-1, w.shape[1])[: len(x)]


def _gates(m: Model, x: np.ndarray, side: str) -> np.ndarray:
    """What the words give to the gates (keep, reset, new); a last row for padding keeps the state."""
    pad = np.zeros((1, 3 * HIDDEN), np.float32)
    pad[0, :HIDDEN] = 30
    return np.concatenate([_product(x, m.p["w" + side]) + m.p["b" + side], pad]).astype(np.float32)


def _run(gates: np.ndarray, u: np.ndarray, index: np.ndarray, backwards: bool, saved: list | None = None) -> np.ndarray:
    """States (steps, windows, HIDDEN) of one direction."""
    steps = range(WINDOW - 1, -1, -1) if backwards else range(WINDOW)
    h = np.zeros((len(index), HIDDEN), np.float32)
    out = np.empty((WINDOW, len(index), HIDDEN), np.float32)
    for t in steps:
        a, g = gates[index[:, t]], h @ u
        zr = _sigmoid(a[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(a[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        if saved is not None:
            saved.append((t, h, z, r, n, g[:, 2 * HIDDEN :]))
        h = z * h + (1 - z) * n
        out[t] = h
    return out


def _pooled(m: Model, states: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(attention, pooled states, logits); ``real`` tells words from padding."""
    s = np.where(real, states @ m.p["attention"], -30)
    a = np.exp(s - s.max(0))
    a /= a.sum(0)
    pooled = (a[:, :, None] * states).sum(0)
    return a, pooled, pooled @ m.p["out"] + m.p["bias"][0]


def logits(m: Model, block: Block) -> np.ndarray:
    """The logit of each window."""
    _, x = _inputs(m, block.hashes, block.grams, block.first[:-1])
    gates = [_gates(m, x, side) for side in "fb"]
    out = np.empty(len(block.windows), np.float32)
    for at in range(0, len(out), ROWS):
        index = np.full((ROWS, WINDOW), len(block.hashes), block.windows.dtype)
        part = block.windows[at : at + ROWS]
        index[: len(part)] = part
        states = np.concatenate([_run(g, m.p["u" + side], index, side == "b") for g, side in zip(gates, "fb")], 2)
        out[at : at + ROWS] = _pooled(m, states, (index < len(block.hashes)).T)[2][: len(part)]
    return out


def highest(m: Model, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(logit, window) of each text's highest window."""
    score = logits(m, block)
    order = np.lexsort((-score, block.doc))
    first = order[np.flatnonzero(np.diff(block.doc[order], prepend=-1))]
    return score[first], first


def _gradients(m: Model, block: Block, index: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy of some windows."""
    own, flat = np.unique(index, return_inverse=True)
    local = flat.reshape(index.shape)
    known = own < len(block.hashes)
    grams, first = _rows(block, own[known])
    row, x = _inputs(m, block.hashes[own[known]], grams, first)
    saved: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate([_run(_gates(m, x, s), m.p["u" + s], local, s == "b", saved[s]) for s in "fb"], 2)
    real = (index < len(block.hashes)).T
    a, pooled, logit = _pooled(m, states, real)
    d_logit = ((_sigmoid(logit) - target) / len(target)).astype(np.float32)
    g = {"out": pooled.T @ d_logit, "bias": np.array([d_logit.sum()])}
    d_pooled = d_logit[:, None] * m.p["out"]
    d_states = a[:, :, None] * d_pooled
    d_a = (states * d_pooled).sum(2)
    d_s = np.where(real, a * (d_a - (a * d_a).sum(0)), 0)
    g["attention"] = np.einsum("tb,tbh->h", d_s, states)
    d_states = d_states + d_s[:, :, None] * m.p["attention"]
    d_x = np.zeros_like(x)
    for side, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
        u = m.p["u" + side]
        d_u, d_h = np.zeros_like(u), np.zeros((len(index), HIDDEN), np.float32)
        d_gates = np.zeros((len(x) + 1, 3 * HIDDEN), np.float32)
        for t, before, z, r, n, gn in reversed(saved[side]):
            d_h = d_h + d_states[t][:, part]
            d_n = d_h * (1 - z) * (1 - n * n)
            d_z = d_h * (before - n) * z * (1 - z)
            d_r = d_n * gn * r * (1 - r)
            d_g = np.concatenate([d_z, d_r, d_n * r], 1)
            np.add.at(d_gates, local[:, t], np.concatenate([d_z, d_r, d_n], 1))
            d_u += before.T @ d_g
            d_h = d_h * z + d_g @ u.T
        d_gates = d_gates[:-1]
        g["u" + side], g["w" + side], g["b" + side] = d_u, x.T @ d_gates, d_gates.sum(0)
        d_x += d_gates @ m.p["w" + side].T
    g["word"] = np.zeros_like(m.p["word"])
    np.add.at(g["word"], row, d_x[:, :WORD_DIM])
    g["char"] = np.zeros_like(m.p["char"])
    np.add.at(g["char"], grams, np.repeat(d_x[:, WORD_DIM:], np.diff(first, append=len(grams)), axis=0))
    return g


def _words_of(block: Block, a: int, b: int) -> np.ndarray:
    """(document, word) of each word that the windows from ``a`` to ``b`` hold, once."""
    windows = block.windows[a:b]
    real = windows < len(block.hashes)
    both = np.unique(np.broadcast_to(block.doc[a:b, None], real.shape)[real] * np.int64(len(block.hashes) + 1) + windows[real])
    return np.stack(np.divmod(both, len(block.hashes) + 1), 1).astype(np.int32)


def train(texts: list[str], toxic: np.ndarray, share: float, seed: int = 42) -> Model:
    """``share``: the true share of toxic documents, to which scores are calibrated."""
    rng = np.random.default_rng(seed)
    encoded = [(x or "").encode() for x in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in encoded])]).astype(np.int64)
    block = read_blocks(np.frombuffer(b"".join(encoded), np.uint8), offsets)
    del encoded
    toxic = np.asarray(toxic, bool)
    aside = rng.random(block.n) < 0.2  # for calibration alone
    learn = ~aside
    # Each word once a document, for some documents (whose windows lie together) at a time.
    cuts = np.searchsorted(block.doc, range(0, block.n + SLICE, SLICE))
    pairs = np.concatenate([np.empty((0, 2), np.int32), *(_words_of(block, a, b) for a, b in zip(cuts, cuts[1:]))]).T
    in_toxic = np.bincount(pairs[1][(toxic & learn)[pairs[0]]], minlength=len(block.hashes))
    in_clean = np.bincount(pairs[1][(~toxic & learn)[pairs[0]]], minlength=len(block.hashes))
    often = in_toxic + in_clean
    rank = np.lexsort((block.hashes, -often))[:VOCABULARY]
    chosen = np.sort(rank[often[rank] >= max(LEAST_DOCUMENTS, block.n // LEAST_SHARE)])
    shrunk = lambda x, n: x * n / (n + SHRINK)
    odds = np.log((in_toxic + 0.5) / ((toxic & learn).sum() + 1)) - np.log((in_clean + 0.5) / ((~toxic & learn).sum() + 1))
    m = Model(block.hashes[chosen])
    shapes = {"attention": (2 * HIDDEN,), "out": (2 * HIDDEN,)}
    for side in "fb":
        shapes |= {"w" + side: (WORD_DIM + CHAR_DIM, 3 * HIDDEN), "u" + side: (HIDDEN, 3 * HIDDEN)}
        m.p["b" + side] = np.zeros(3 * HIDDEN, np.float32)
    for name, shape in shapes.items():
        m.p[name] = (rng.standard_normal(shape) * 0.1).astype(np.float32)
    m.p["bias"] = np.array([-1.0], np.float32)
    # The first two units of each direction begin by passing on the log odds (see below) of the word read last and of
    # its characters, so that few labels only have to correct what words and characters say by themselves.
    for side, unit in (("f", 0), ("b", HIDDEN)):
        for k, evidence in enumerate((0, WORD_DIM)):
            m.p["w" + side][[0, WORD_DIM], 2 * HIDDEN + k] = 0.0
            m.p["w" + side][evidence, 2 * HIDDEN + k] = 1.0
            m.p["b" + side][[k, 2 * HIDDEN + k]] = -2.0, -1.5
            m.p["attention"][unit + k] = m.p["out"][unit + k] = 2.0
    # Embeddings begin with log odds, shrunk for what is rare, in the first place.
    m.p["word"] = np.zeros((len(chosen) + 1, WORD_DIM), np.float32)
    m.p["word"][:-1, 0] = shrunk(odds, often)[chosen]
    m.p["word"][:, 1:] = rng.standard_normal((len(chosen) + 1, WORD_DIM - 1)) * 0.05
    in_toxic, in_clean = np.zeros(GRAMS, np.int64), np.zeros(GRAMS, np.int64)
    cuts = np.searchsorted(pairs[0], range(0, block.n + SLICE, SLICE))
    for a, b in zip(cuts, cuts[1:]):
        rows, start = _rows(block, pairs[1][a:b])
        seen = np.unique(np.repeat(pairs[0][a:b], np.diff(start, append=len(rows))).astype(np.int64) * GRAMS + rows)
        doc, row = seen // GRAMS, seen % GRAMS
        in_toxic += np.bincount(row[(toxic & learn)[doc]], minlength=GRAMS)
        in_clean += np.bincount(row[(~toxic & learn)[doc]], minlength=GRAMS)
    char_odds = np.log((in_toxic + 0.5) / ((toxic & learn).sum() + 1)) - np.log((in_clean + 0.5) / ((~toxic & learn).sum() + 1))
    m.p["char"] = (rng.standard_normal((GRAMS, CHAR_DIM)) * 0.02).astype(np.float32)
    m.p["char"][:, 0] = 0.3 * shrunk(char_odds, in_toxic + in_clean)
    gain = np.zeros(len(block.hashes) + 1)
    if len(block.hashes):
        gain[:-1] = np.maximum.reduceat(shrunk(char_odds, in_toxic + in_clean)[block.grams], block.first[:-1])
    gain[chosen] = np.maximum(gain[chosen], m.p["word"][:-1, 0])
    score = np.maximum(gain[block.windows], 0).max(1)
    order = np.lexsort((-score, block.doc))
    best = order[np.flatnonzero(np.diff(block.doc[order], prepend=-1))]
    counts = np.bincount(block.doc, minlength=block.n)
    start = np.cumsum(counts) - counts
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.p.items()}
    queue = np.empty(0, np.int64)
    for step in range(1, STEPS + 1 if learn.any() else 0):
        if step % REFRESH == 0:
            _, best = highest(m, block)
            queue = queue[:0]
        if not len(queue):
            other = start + (rng.random(block.n) * counts).astype(np.int64)
            window = np.concatenate([best[learn], other[learn & ~toxic]])
            target = np.concatenate([toxic[learn], np.zeros((learn & ~toxic).sum())]).astype(np.float32) * 0.96 + 0.02
            queue = rng.permutation(len(window))
        take, queue = queue[:BATCH], queue[BATCH:]
        for k, g in _gradients(m, block, block.windows[window[take]], target[take]).items():
            a, b = moments[k]
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            m.p[k] -= (0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-6)).astype(np.float32) + 1e-5 * m.p[k]
    if block.n:
        m.scale = _calibrated(highest(m, block)[0][aside], toxic[aside], share)
    return m


def _calibrated(score: np.ndarray, toxic: np.ndarray, share: float) -> tuple[float, float]:
    """(slope, offset) of a logistic regression on the highest logits, its classes weighted to ``share``; by Newton's method."""
    weight = np.where(toxic, share / max(1, toxic.sum()), (1 - share) / max(1, (~toxic).sum())) * len(toxic)
    x, w = np.stack([score, np.ones(len(score))], 1).astype(float), np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ w)
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2)
        w -= np.linalg.solve(hessian, x.T @ (weight * (p - toxic)) + (w - [1.0, 0.0]))
    return max(0.01, float(w[0])), float(w[1])


def sample(docs: DataFrame, labels: DataFrame, seed: int = 42) -> tuple[DataFrame, float]:
    """(draw, doc_id, text, toxic of the labelled texts to learn from, the share of toxic labels outside the held-out quarter)."""
    truth = (
        labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL AND crc32(string(doc_id)) % 4 <> 2")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("draw", F.xxhash64(F.lit(seed), "doc_id"))
    )
    n = {x["toxic"]: x["count"] for x in truth.groupBy("toxic").count().collect()}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("same", F.md5("text"))
    sizes = texts.select("doc_id", "same", F.octet_length("text").cast("long").alias("size")).where(F.col("size") <= SAMPLE_TEXT).distinct()
    labelled, parts = sizes.join(truth, "doc_id"), []
    for toxic, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        first = labelled.where(F.col("toxic") == toxic).orderBy("draw", "doc_id", "same").limit(most)
        so_far = F.sum("size").over(Window.orderBy("draw", "doc_id", "same"))  # over ``most`` rows
        parts.append(first.withColumn("bytes", so_far).where(F.col("bytes") <= SAMPLE_BYTES))
    chosen = F.broadcast(parts[0].unionByName(parts[1]).drop("size", "bytes"))  # SAMPLE_TOXIC + SAMPLE_CLEAN rows at most
    rows = texts.join(chosen, ["doc_id", "same"]).groupBy("draw", "doc_id", "same", "toxic").agg(F.first("text").alias("text"))
    return rows.select("draw", "doc_id", "text", "toxic"), n.get(1, 0) / max(1, sum(n.values()))


def fit(docs: DataFrame, labels: DataFrame, seed: int = 42) -> Model:
    """On labelled documents outside the held-out quarter. The sample is bounded in rows and bytes; null labels are left out."""
    rows, share = sample(docs, labels, seed)
    rows = rows.toArrow()
    rows = sorted(zip(*[rows.column(k).to_pylist() for k in range(4)]), key=lambda x: x[:3])
    return train([x[2] for x in rows], np.array([x[3] == 1 for x in rows], bool), min(0.99, max(0.01, share)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text); only the text decides the score.

    Null and empty texts are scored as one window without words, texts of any length by all their windows. Repeated
    rows and null doc_ids are kept (a null doc_id is not held out); other columns are ignored; an empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by VOCABULARY
    names = ["doc_id", "held_out", "score"]

    def run(batches: Iterator[pa.RecordBatch]):
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = _texts(batch, 2)
            at, n = 0, batch.num_rows
            while at < n:
                to = int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1
                to = min(max(to, at + 1), n)
                block = read_block(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                slope, offset = m.scale
                value = _sigmoid(slope * highest(m, block)[0].astype(float) + offset)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(value)], names)
                at = to

    held_out = F.coalesce(F.expr("crc32(string(bigint(doc_id))) % 4 = 2"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
