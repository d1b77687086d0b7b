"""Reranking by BM25, with the corpus statistics in a table that upserts keep up with the collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.store import Keyed

#: Saturation of a token's count, and how far a passage's length counts.
K1, B = 1.2, 0.75
TOKENS = r"[^\p{L}\p{N}]+"


def tokens_of(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKENS), lambda x: x != "")


class TermStatistics:
    """Of the passages (id, text) of a collection: how many there are, their lengths, and in how many each token is.

    ``lengths`` holds a row a passage, with its distinct tokens, so that a passage that changes or goes can be taken out of the counts; ``terms`` a row
    a token. Both are tables whose upserts touch the parts of their keys alone.
    """

    def __init__(self, spark: SparkSession, name: str, parts: int = 16):
        self.spark = spark
        self.lengths = Keyed(spark, f"{name}_lengths", "id bigint, length bigint, tokens array<string>", "id", parts)
        self.terms = Keyed(spark, f"{name}_terms", "token string, n bigint", "token", parts)

    def upsert(self, passages: DataFrame) -> None:
        """New and changed passages, one row an id. The counts of their old tokens go down, those of the new ones up."""
        new = passages.select(F.col("id").cast("long").alias("id"), F.size(tokens_of(F.col("text"))).cast("long").alias("length"), F.array_distinct(tokens_of(F.col("text"))).alias("tokens"))
        before = self.lengths.read().join(new.select("id"), "id", "left_semi")
        each = lambda rows, by: rows.select(F.explode("tokens").alias("token"), F.lit(by).alias("by"))
        change = each(new, 1).unionByName(each(before, -1)).groupBy("token").agg(F.sum("by").alias("by")).where("by <> 0")
        counts = change.join(self.terms.read(), "token", "left").select("token", (F.coalesce("n", F.lit(0)) + F.col("by")).alias("n"))
        self.terms.upsert(counts)  # a token that no passage has any more stays with 0
        self.lengths.upsert(new)

    def recount(self) -> None:
        """The counts from the passages' tokens, for when an upsert failed between its two tables."""
        self.terms.replace(self.lengths.read().select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")))

    def totals(self) -> tuple[int, float]:
        """(passages, their mean length)."""
        n, length = self.lengths.read().agg(F.count("*"), F.sum("length")).first()
        return n, (length or 0) / max(1, n)

    def drop(self) -> None:
        self.lengths.drop()
        self.terms.drop()


def bm25_scores(candidates: DataFrame, statistics: TermStatistics, k1: float = K1, b: float = B) -> DataFrame:
    """``candidates`` (query_id, id, query, text) with rerank_score: the BM25 of the passage for the question's distinct tokens.

    Tokens that no passage of the statistics has count as in none. A candidate that shares no token scores 0. Only tokens that a question
    and its passage share are joined with the statistics, so their number is bounded by the questions.
    """
    n, mean = statistics.totals()
    held = candidates.select("query_id", "id", F.array_distinct(tokens_of(F.col("query"))).alias("asked"), tokens_of(F.col("text")).alias("said"))
    shared = held.select("query_id", "id", F.size("said").alias("length"), F.explode(F.filter("said", lambda x: F.array_contains("asked", x))).alias("token"))
    counts = shared.groupBy("query_id", "id", "length", "token").agg(F.count("*").alias("f"))
    known = counts.join(statistics.terms.read().withColumnRenamed("n", "df"), "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    weight = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    relative = F.col("length") / F.lit(mean or 1.0)
    part = weight * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * relative))
    # In order of the tokens, so that equal passages get equal sums.
    summed = known.groupBy("query_id", "id").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("token", part.alias("x")))), F.lit(0.0), lambda s, x: s + x["x"]).alias("rerank_score"))
    return candidates.join(summed, ["query_id", "id"], "left").withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0)))


def bm25_reranked(candidates: DataFrame, statistics: TermStatistics, k: int) -> DataFrame:
    """The ``k`` best of (query_id, id, query, text) by BM25, with rerank_score (rounded to 9 digits) and rank from 1; ties to the smaller id."""
    scored = bm25_scores(candidates, statistics).withColumn("rerank_score", F.round("rerank_score", 9))
    best = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "id")
    return scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)
