"""Requests from and responses to a service over HTTP, as Spark data sources: a stream with offsets, and a writer that commits.

What the service offers below its address:

* ``GET latest``: ``{"next": n}``, the number of requests so far; they are numbered from 0 and kept until they are ``done``.
* ``GET requests?from=a&to=b``: a list of ``{"query_id": ..., "query": ...}``, the requests a to b - 1.
* ``POST done``: ``{"to": n}``: requests below n are answered for good.
* ``POST staged/TOKEN``: a list of responses, put behind those of that token; nobody sees them yet.
* ``POST commits``: ``{"stream": ..., "batch": ..., "staged": [TOKEN, ...]}``: shows them all at once, unless that batch of that stream was shown before.
* ``POST aborts``: ``{"staged": [TOKEN, ...]}``: they may be thrown away.

A task that is run again stages under a token of its own, and only tokens of tasks that ended well are committed. A micro-batch that is run
again has the same requests and the same number. So a response is neither lost nor given twice, wherever the query dies.
"""

from __future__ import annotations

import json
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

REQUEST = "query_id long, query string"
#: Seconds after which a call to the service fails, and with it the task, which Spark runs again.
PATIENCE = 60

Sink = Callable[[DataFrame, int], None]


def _call(address: str, body: object = None):
    data = None if body is None else json.dumps(body).encode()
    with urllib.request.urlopen(urllib.request.Request(address, data, {"Content-Type": "application/json"}), timeout=PATIENCE) as reply:
        said = reply.read()
    return json.loads(said) if said else None


class RequestReader(DataSourceStreamReader):
    """``each`` requests a task."""

    def __init__(self, url: str, each: int):
        self.url, self.each = url, each

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        return {"next": _call(f"{self.url}/latest")["next"]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition((low, min(low + self.each, end["next"]))) for low in range(start["next"], end["next"], self.each)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        low, high = partition.value
        found = _call(f"{self.url}/requests?from={low}&to={high}")
        if len(found) != high - low:
            raise ValueError(f"{len(found)} requests came where those from {low} to {high} were asked for")
        return iter([(x.get("query_id"), x.get("query")) for x in found])

    def commit(self, end: dict) -> None:
        _call(f"{self.url}/done", {"to": end["next"]})


@dataclass
class Staged(WriterCommitMessage):
    token: str


class ResponseWriter(DataSourceWriter):
    """``each`` rows a call; a task without rows stages nothing."""

    def __init__(self, url: str, stream: str, batch: int, each: int):
        self.url, self.stream, self.batch, self.each = url, stream, batch, each

    def write(self, iterator: Iterator[Row]) -> Staged:
        token, held = uuid.uuid4().hex, []
        for row in iterator:
            held.append(row.asDict(recursive=True))
            if len(held) == self.each:
                _call(f"{self.url}/staged/{token}", held)
                held = []
        if held:
            _call(f"{self.url}/staged/{token}", held)
        return Staged(token)

    def commit(self, messages: list) -> None:
        _call(f"{self.url}/commits", {"stream": self.stream, "batch": self.batch, "staged": [m.token for m in messages if m]})

    def abort(self, messages: list) -> None:
        _call(f"{self.url}/aborts", {"staged": [m.token for m in messages if m]})


class Mailbox(DataSource):
    """Options: url; each (100); to write, stream and batch as well."""

    @classmethod
    def name(cls) -> str:
        return "tessera_mailbox"

    def schema(self) -> str:
        return REQUEST

    def _each(self) -> int:
        return int(self.options.get("each", "100"))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return RequestReader(self.options["url"], self._each())

    def reader(self, schema) -> DataSourceReader:
        raise NotImplementedError("requests are a stream")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ResponseWriter(self.options["url"], self.options["stream"], int(self.options["batch"]), self._each())


def requests_from(spark: SparkSession, url: str, each: int = 100) -> DataFrame:
    """The stream of requests: query_id, query."""
    spark.dataSource.register(Mailbox)
    return spark.readStream.format(Mailbox.name()).option("url", url).option("each", each).load()


def responses_to(url: str, stream: str, each: int = 100) -> Sink:
    """Sends the rows of a micro-batch of ``stream``, a name that goes with its checkpoint. A batch that was shown stays as it was."""

    def send(rows: DataFrame, batch: int) -> None:
        rows.sparkSession.dataSource.register(Mailbox)
        rows.write.format(Mailbox.name()).option("url", url).option("stream", stream).option("batch", batch).option("each", each).mode("append").save()

    return send


def folder_sink(path: str) -> Sink:
    """A folder of Parquet for each micro-batch, which is overwritten when it is run again."""
    return lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/micro_batch={batch}")
