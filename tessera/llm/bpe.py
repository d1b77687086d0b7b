"""Byte-level BPE with the tokenizers library, over Arrow batches.

The tokenizer is made from a file of ranks (a token's bytes and its id, which is also the order
of merges): a token's merge is the pair that is left of its bytes when all lower ranks are merged.

A text is cut at spaces that always end a pre-token, so its pieces can be encoded
apart; each worker keeps a bounded table of pieces it has encoded. Ids decode
through the byte-to-character table of byte-level vocabularies, reversed: pieces of
a character that was split between tokens meet again as bytes.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Memory of the pieces that a worker keeps, each counted as its characters and PIECE_COST more; the table is emptied when it is full.
KEPT_BYTES, PIECE_COST = 64 << 20, 150
#: Texts and their bytes that are encoded together (one text may have more).
ROWS, ROW_BYTES = 128, 1 << 20
#: A space after a character that is no white space: a pre-token always ends before it.
_CUT = re.compile(r"(?<=\S)(?= )")


def byte_characters() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the other bytes count up from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The last two parts of a token of several bytes."""
    parts, own = [token[k : k + 1] for k in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, own), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= own:
            raise ValueError(f"token {own} is no merge of lower ranks")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def tokenizer_of(path: str):
    """A tokenizer from a file of ranks, or from the library's own JSON."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    if not path.endswith(".tiktoken"):
        return Tokenizer.from_file(path)
    import public_tokenizers

    ranks = read_ranks(path)
    character = {b: c for c, b in byte_characters().items()}
    said = lambda token: "".join(character[b] for b in token)
    merges = [tuple(map(said, merge_of(x, ranks))) for x in sorted(ranks, key=ranks.get) if len(x) > 1]
    tokenizer = Tokenizer(models.BPE(vocab={said(x): i for x, i in ranks.items()}, merges=merges))
    cut = pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated")
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([cut, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


def vocabulary_path(name: str | None = None) -> str:
    import public_tokenizers

    return name if name and os.path.isabs(name) else public_tokenizers.path(name or VOCABULARY)


class Codec:
    """Encodes and decodes; keeps the ids of known pieces end to end in one array (``pool``)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = tokenizer_of(path)
        self.tokenizer.encode_special_tokens = True
        byte_of = byte_characters()
        self.bytes_of = {
            i: bytes(byte_of[c] for c in token) for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if all(c in byte_of for c in token)
        }
        self.size_of = np.zeros(max(self.bytes_of, default=0) + 1, np.int64)
        for i, x in self.bytes_of.items():
            self.size_of[i] = len(x)
        self.byte_list = [self.bytes_of.get(i) for i in range(len(self.size_of))]
        self.digits = list(map(str, range(len(self.size_of))))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # pieces after a space: their place below, or -1 where white space could go on behind them
        self.held = 0
        self.pool, self.first, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Encode pieces that follow a space. As they end with no white space, many go as one text, whose ids are cut at the pieces' last bytes."""
        safe = [x for x in new if x and not x[-1].isspace()]
        self.known.update(dict.fromkeys(new, -1))
        if not safe:
            return
        joined = ["".join([f" {x}" for x in safe[at : at + 256]]) for at in range(0, len(safe), 256)]
        ids = np.fromiter((i for x in self._encode(joined) for i in x), np.int32)
        last = np.cumsum(np.fromiter((1 + len(x.encode()) for x in safe), np.int64, len(safe)))
        ends = np.searchsorted(np.cumsum(self.size_of[ids]), last) + 1
        counts = np.diff(ends, prepend=0)
        self.known.update(zip(safe, range(len(self.first), len(self.first) + len(safe))))
        self.first = np.concatenate([self.first, len(self.pool) + ends - counts])
        self.count = np.concatenate([self.count, counts])
        self.pool = np.concatenate([self.pool, ids])

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        parts = [x.split(" ") for x in texts]
        heads = self._encode([x[0] for x in parts])
        own = set().union(*[x[1:] for x in parts])
        new = [x for x in own if x not in self.known]
        if self.held + sum(map(len, new)) + PIECE_COST * len(new) > KEPT_BYTES:
            self._forget()
            new = list(own)
        self.held += sum(map(len, new)) + PIECE_COST * len(new)
        self._learn(new)
        out = []
        for text, (head, *tail), ids in zip(texts, parts, heads):
            at = [self.known[x] for x in tail]
            if head[-1:].isspace() or -1 in at:
                out.append(self._in_blocks(text))
                continue
            at = np.array(at, np.int64)
            counts = self.count[at]
            places = np.repeat(self.first[at] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            out.append(np.concatenate([np.array(ids, np.int32), self.pool[places]]))
        return out

    def _in_blocks(self, text: str, characters: int = 65536) -> np.ndarray:
        """A text with runs of white space: cut only where a space follows something else, and encoded in blocks of such pieces."""
        blocks, size = [[]], 0
        for piece in _CUT.split(text):
            if size > characters:
                blocks.append([])
                size = 0
            blocks[-1].append(piece)
            size += len(piece)
        return np.concatenate([np.array(x, np.int32) for block in blocks for x in self._encode(["".join(block)])])

    def encode(self, text: str) -> list[int]:
        return self.encode_texts([text])[0].tolist()

    def starts(self, ids: list[int]) -> list[int]:
        """The byte of the text where each token starts."""
        sizes = np.fromiter((len(self.bytes_of[i]) for i in ids), np.int64, len(ids))
        return (np.cumsum(sizes) - sizes).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.byte_list.__getitem__, ids))

    def decimal(self, ids: list[int]) -> str:
        return " ".join(map(self.digits.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _texts(batches: Iterator[pa.RecordBatch], column: str = "text"):
    for batch in batches:
        place = batch.schema.get_field_index(column)
        size = batch.column(place)
        size = (pc.binary_length(size) if pa.types.is_string(size.type) or pa.types.is_large_string(size.type) else pc.list_value_length(size)).fill_null(0).to_numpy()
        ends, at = np.cumsum(size.astype(np.int64)), 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ROW_BYTES, "right"))
            to = max(at + 1, min(to, at + ROWS))
            part = batch.slice(at, to - at)
            yield part, part.column(place).to_pylist()
            at = to


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids, starts (the byte offset of each token) for each row of ``docs`` (doc_id, text); a null text is empty."""

    def run(batches):
        c = codec(vocabulary_path(vocabulary))
        for part, texts in _texts(batches):
            ids = [x.tolist() for x in c.encode_texts([x or "" for x in texts])]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([c.starts(x) for x in ids], pa.list_(pa.int64()))],
                ["doc_id", "ids", "starts"],
            )

    return docs.selectExpr("bigint(doc_id) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, starts array<long>")


def decode(tokens: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, text from (doc_id, ids); bytes that are no UTF-8 (ids cut inside a character) become U+FFFD, null ids the empty text."""

    def run(batches):
        c = codec(vocabulary_path(vocabulary))
        for part, lists in _texts(batches, "ids"):
            texts = [c.decode(x or []).decode("utf-8", "replace") for x in lists]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.selectExpr("bigint(doc_id) doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids of each row of ``docs`` (doc_id, text).

    Null and empty texts have no tokens and the hashes of the empty string. Null doc_ids and repeated
    rows are kept; other columns are ignored. Texts are read whole, and one text at a time is encoded.
    """

    def run(batches):
        c = codec(vocabulary_path(vocabulary))
        for part, texts in _texts(batches):
            n, ids, decoded, lists = [], [], [], []
            for x in c.encode_texts([x or "" for x in texts]):
                found = x.tolist()
                if with_ids:
                    lists.append(x)
                n.append(len(found))
                ids.append(hashlib.sha256(c.decimal(found).encode()).hexdigest())
                decoded.append(hashlib.sha256(c.decode(found)).hexdigest())
            columns = [part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.selectExpr("bigint(doc_id) doc_id", "text").mapInArrow(run, schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
