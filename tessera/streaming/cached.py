"""The chat endpoint over a stream of questions, with its answers cached in the stream's keyed state.

Questions and answers come into one stateful operator, keyed by the cache's key. Its state is the answer,
with a lifetime in processing time that begins when the answer is written; reading it prolongs nothing. A question
leaves with the live answer or without any; those without go to the agent, whose answers are a stream that comes back
in. So no table of answers is read or written, and a key costs nothing once its lifetime is over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tessera.config import FROM_AGENT, FROM_CACHE, LLM_FAILED, LLM_MISSING, NO_DOCUMENT
from tessera.operators.cache import cache_key
from tessera.staging import Written, owner
from tessera.streaming.mailbox import Sink, folder_sink

#: What the query is started with (it keeps the session's settings of that moment): state with a lifetime needs this store, and
#: without data there is nothing to do, as state that has expired is not read and goes with the next micro-batch.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
ANSWER = "key string, query_id long, query string, answer string"


def held_answers(ttl_seconds: int) -> StatefulProcessor:
    """Made within a function, so that it travels by its code: the state's worker on the driver does not get shipped packages."""

    class HeldAnswers(StatefulProcessor):
        """One key: answers that come are held, questions leave with what is held."""

        def __init__(self, ttl_seconds: int):
            self.ttl_seconds = ttl_seconds

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.answer = handle.getValueState("answer", "answer string", ttlDurationMs=self.ttl_seconds * 1000)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            asked, said, query = [], None, None
            for batch in rows:
                answers = batch["answer"].dropna()
                said = answers.iloc[-1] if len(answers) else said
                questions = batch[batch["query_id"].notna()]
                if len(questions):
                    query = questions["query"].iloc[0]  # one key is one question
                    asked.append(questions["query_id"].to_numpy("int64"))
            if said is not None:
                self.answer.update((said,))
            held = self.answer.get()[0] if self.answer.exists() else None
            for ids in asked:
                yield pd.DataFrame({"query_id": ids, "query": query, "answer": pd.Series([held or None] * len(ids), dtype="object")})

        def close(self) -> None:
            pass

    return HeldAnswers(ttl_seconds)


def routed(questions: DataFrame, answers: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """query_id, query, answer (null: ask the agent) of a stream of questions (query_id, query), given a stream of answers (key, answer).

    Answers of a micro-batch are held before its questions are looked up. Empty answers are held and count as none. Null questions are
    keyed as such and always go to the agent.
    """
    asked = questions.select(F.coalesce(cache_key(F.col("query")), F.lit("")).alias("key"), F.col("query_id").cast("long").alias("query_id"), "query", F.lit(None).cast("string").alias("answer"))
    said = answers.select("key", F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("string").alias("query"), "answer")
    return asked.unionByName(said).groupBy("key").transformWithStateInPandas(held_answers(ttl_seconds), "query_id long, query string, answer string", "append", "processingTime")


def serve_cached(
    questions: DataFrame, agent: Callable[[DataFrame], DataFrame], sink: str | Sink, answers: str, checkpoint: str, ttl_seconds: int = 3600, keep_errors: bool = True
) -> StreamingQuery:
    """Answers a stream of (query_id, query) into ``sink`` (a folder for Parquet, or what sends a micro-batch): batch, query_id, answer, source, contexts.

    ``agent`` makes query_id, query, answer, contexts of questions, each distinct one once a micro-batch. What it says
    goes to the folder ``answers``, from which the next micro-batch takes it into the state. Each micro-batch has a folder
    of its own in both places, which is overwritten when it is run again after a failure: no response is lost or comes twice.
    """
    spark, send = questions.sparkSession, folder_sink(sink) if isinstance(sink, str) else sink
    spark.createDataFrame([], "key string, answer string").write.mode("append").parquet(answers)
    back = spark.readStream.schema("key string, answer string").option("recursiveFileLookup", "true").parquet(answers)

    def answer(rows: DataFrame, batch: int) -> None:
        with owner():
            probed = Written(rows).read()  # the state is read and written once
            hits = probed.where("answer IS NOT NULL").select("query_id", "answer", F.lit(FROM_CACHE).alias("source"), F.array().cast("array<string>").alias("contexts"))
            misses = probed.where("answer IS NULL").select("query_id", "query")
            once = misses.groupBy("query").agg(F.min("query_id").alias("query_id")).select("query_id", "query")
            made = Written(agent(once).select("query", "answer", F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"))).read()
            answered = misses.join(made, misses["query"].eqNullSafe(made["query"])).select("query_id", "answer", F.lit(FROM_AGENT).alias("source"), "contexts")
            responses = hits.unionByName(answered).withColumn("batch", F.lit(batch).cast("long"))
            send(responses, batch)
            entries = made.where("answer IS NOT NULL AND query IS NOT NULL")
            if not keep_errors:
                entries = entries.where(~F.col("answer").isin(NO_DOCUMENT, LLM_MISSING) & ~F.col("answer").startswith(LLM_FAILED))
            entries = entries.select(cache_key(F.col("query")).alias("key"), "answer")
            if not entries.isEmpty():  # a file without answers would start another micro-batch, and so on
                entries.write.mode("overwrite").parquet(f"{answers}/micro_batch={batch}")

    before = {k: spark.conf.get(k) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        return routed(questions, back, ttl_seconds).writeStream.foreachBatch(answer).outputMode("append").option("checkpointLocation", checkpoint).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
