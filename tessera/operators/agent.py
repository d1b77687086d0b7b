"""From questions to cached answers: retrieval, prompt, generator and cache together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.models import embed_udf
from tessera.operators.answer import answers
from tessera.operators.cache import AnswerCache
from tessera.operators.retrieve import search


def researcher(collection: DataFrame, embed=None, rerank=None, generate=None, k: int = 3, overfetch: int = 3) -> Callable[[DataFrame], DataFrame]:
    """A function from questions (query_id, query) to query_id, query, answer, contexts over the points of ``collection``."""
    embed = embed or embed_udf()

    def ask(questions: DataFrame) -> DataFrame:
        return answers(questions, search(questions, collection, embed, k, overfetch, rerank), generate)

    return ask


def chat(questions: DataFrame, collection: DataFrame, cache: AnswerCache, now: Column | None = None, keep_errors: bool = True, **models) -> DataFrame:
    """query_id, answer, source, contexts of questions (query_id, query): from the cache while it has a live answer, else from the agent, whose answer is kept."""
    return cache.respond(questions, researcher(collection, **models), F.current_timestamp() if now is None else now, keep_errors)
