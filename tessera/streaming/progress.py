"""What streams do while they run: rows, time and counted values of each micro-batch, and how each stream ended."""

from __future__ import annotations

import logging
import threading
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class MicroBatch:
    """``counted`` has the values of each ``observe`` of the stream's plan under its name."""

    run: str
    stream: str | None
    batch: int
    n_rows: int
    milliseconds: int
    counted: dict[str, dict] = field(default_factory=dict)


class Progress(StreamingQueryListener):
    """The last ``keep`` micro-batches of all streams, the rows of each run as a whole, and why runs ended (None: they were stopped).

    A trigger that found nothing new is no micro-batch and is not kept. A micro-batch that is run again after a failure belongs to another run.
    """

    def __init__(self, keep: int = 10_000):
        self._lock = threading.Condition()
        self._batches: deque[MicroBatch] = deque(maxlen=keep)
        self._rows: dict[str, int] = {}
        self._ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        log.info("stream %s: run %s begins", event.name or event.id, event.runId)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if not p.numInputRows:
            return
        counted = {name: row.asDict() for name, row in p.observedMetrics.items()}
        made = MicroBatch(str(p.runId), p.name, p.batchId, p.numInputRows, p.batchDuration, counted)
        with self._lock:
            self._batches.append(made)
            self._rows[made.run] = self._rows.get(made.run, 0) + made.n_rows
        log.info("stream %s: micro-batch %d, %d rows, %d ms %s", p.name or p.id, made.batch, made.n_rows, made.milliseconds, counted or "")

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._ended[str(event.runId)] = event.exception
            self._lock.notify_all()
        log.log(logging.ERROR if event.exception else logging.INFO, "stream %s ended: %s", event.id, event.exception or "stopped")

    def batches(self, run: object) -> list[MicroBatch]:
        with self._lock:
            return [x for x in self._batches if x.run == str(run)]

    def n_rows(self, run: object) -> int:
        """The rows of all micro-batches of the run, those no longer kept included."""
        with self._lock:
            return self._rows.get(str(run), 0)

    def end(self, run: object, patience: float = 60) -> str | None:
        """Waits until the run's end was reported, before which all of its micro-batches were; why it ended."""
        with self._lock:
            if not self._lock.wait_for(lambda: str(run) in self._ended, patience):
                raise TimeoutError(f"no end of run {run} was reported")
            return self._ended[str(run)]


@contextmanager
def watched(spark: SparkSession, keep: int = 10_000) -> Iterator[Progress]:
    """Streams of the session that run within the block are reported."""
    progress = Progress(keep)
    spark.streams.addListener(progress)
    try:
        yield progress
    finally:
        spark.streams.removeListener(progress)
