"""From passages to prompts to answers, with the fixed fallback where nothing was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import CONTEXT_SEPARATOR, NO_DOCUMENT, PROMPT
from tessera.models import generate_udf


def contexts_of(passages: DataFrame) -> DataFrame:
    """query_id, contexts: the texts of (query_id, rank, text) in order of rank."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "text")))
    return passages.groupBy("query_id").agg(F.transform(ordered, lambda x: x["text"]).alias("contexts"))


def prompt_of(contexts: Column, query: Column) -> Column:
    return F.concat(F.lit(PROMPT[0]), F.array_join(contexts, CONTEXT_SEPARATOR), F.lit(PROMPT[1]), query, F.lit(PROMPT[2]))


def answers(questions: DataFrame, passages: DataFrame, generate=None) -> DataFrame:
    """query_id, query, answer, contexts; a question without passages gets the fixed answer and no call to the generator."""
    joined = questions.join(contexts_of(passages), "query_id", "left")
    found = joined.where("size(contexts) > 0").withColumn("answer", (generate or generate_udf())(prompt_of(F.col("contexts"), F.col("query"))))
    none = joined.where("contexts IS NULL OR size(contexts) = 0").select(
        "query_id", "query", F.lit(NO_DOCUMENT).alias("answer"), F.array().cast("array<string>").alias("contexts")
    )
    return found.select("query_id", "query", "answer", "contexts").unionByName(none)
