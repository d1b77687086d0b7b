"""The chat endpoint over a stream of questions, with its answers cached in a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.agent import chat
from tessera.operators.cache import AnswerCache
from tessera.staging import owner
from tessera.streaming.mailbox import Sink, folder_sink


def serve(questions: DataFrame, collection: Callable[[], DataFrame], cache: AnswerCache, sink: str | Sink, checkpoint: str, keep_errors: bool = True, **models) -> StreamingQuery:
    """Answers a stream of (query_id, query) into ``sink`` (a folder for Parquet, or what sends a micro-batch): batch, query_id, answer, source, contexts.

    ``collection`` is read anew for each micro-batch, so that new points are found. Questions of one micro-batch are
    answered together; one that comes twice in it is asked once. Rows in Parquet lie in a folder for each micro-batch, which
    is overwritten when the micro-batch is run again after a failure.
    """
    send = folder_sink(sink) if isinstance(sink, str) else sink

    def answer(rows: DataFrame, batch: int) -> None:
        with owner():
            responses = chat(rows, collection(), cache, keep_errors=keep_errors, **models)
            send(responses.withColumn("batch", F.lit(batch).cast("long")), batch)

    return questions.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).start()
