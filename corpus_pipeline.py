"""A training corpus from the documents: quality rules, near-dedup, personal data, mixing, token ids.

Each stage takes (spark, docs, sf_dir), works on every row it is given and returns a
DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, pii, quality, simhash
from tessera.llm.common import Written, table

#: Jaccard similarity of 5-word shingles from which documents are near-duplicates.
NEAR = 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; cutoffs are certified on the labelled documents among ``docs``."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id stays: within op6's three bits, or NEAR and more alike."""
    return simhash.keep_first(docs, NEAR)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars follows the text."""
    redacted = pii.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else redacted


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix draws a document."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the hashes of the ids and of the bytes they decode to, and the ids."""
    return bpe.digests(docs, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("PII", personal_data),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", token_ids),
]

#: SQL expresses neither the certified cutoffs nor the draws, fingerprints and tokens; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each one's rows are written as Parquet in the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        written = Written(stage(spark, docs, sf_dir))
        if before:
            before.drop()
        docs, before = written.read(), written
    return docs
