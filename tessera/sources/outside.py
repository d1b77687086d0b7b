"""Rows from outside as a Spark data source: pieces (files, pages of an interface, shards) are read side by side, each by a Python iterator.

Every row has its piece, its number within it and its values. A piece that fails keeps the rows before the failure
and gives one more row, which has the failure in place of values; the pieces beside it are not touched. A lost executor's
pieces are read anew by Spark, as whole tasks.
"""

from __future__ import annotations

import io
import json
import logging
import uuid
from collections.abc import Callable, Iterator, Sequence
from itertools import islice, takewhile
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

log = logging.getLogger(__name__)

#: rows(piece, columns) gives dicts; columns are all that will be looked at.
Rows = Callable[[Any, list[str]], Iterator[dict]]
#: Partitions of one read; beyond it a task reads several pieces, one after the other.
MOST_TASKS = 10_000
#: So many pieces and no more are left to a task where there are more than TASKS_A_CORE for each core.
PIECES_A_TASK, TASKS_A_CORE = 64, 4


def json_lines(path: str, columns: list[str]) -> Iterator[dict]:
    """The objects of a file with one a line, packed (gz, bz2, zst) or not, in any file system that Arrow opens by its URI. Blank lines are passed over."""
    system, place = fs.FileSystem.from_uri(path) if path.startswith("file:") or "://" in path else (fs.LocalFileSystem(), path)
    with system.open_input_stream(place) as packed:
        for line in io.BufferedReader(packed, 1 << 20):
            if line.strip():
                yield _object(line, columns)


def _object(line: bytes, columns: list[str]) -> dict:
    found = json.loads(line)
    return {c: found.get(c) for c in columns}


def batches(number: int, piece: Any, rows: Rows, layout: pa.Schema, head: int | None, batch: int) -> Iterator[pa.RecordBatch]:
    """The rows of one piece, ``head`` at most; after a failure those before it and the failure."""
    columns = [f.name for f in layout.field("row").type]
    held: list[dict] = []
    done = 0
    try:
        for row in islice(iter(rows(piece, columns)), head):
            held.append({"piece": number, "n": done + len(held), "row": {c: row.get(c) for c in columns}, "failure": None})
            if len(held) == batch:
                yield pa.RecordBatch.from_pylist(held, schema=layout)
                done, held = done + len(held), []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=layout)
    except Exception as failure:
        log.exception("piece %d failed while it was read", number)
        sound = list(takewhile(lambda row: _fits(row, layout), held))
        said = {"piece": number, "n": done + len(sound), "row": None, "failure": f"{type(failure).__name__}: {failure}"}
        yield pa.RecordBatch.from_pylist([*sound, said], schema=layout)


def _fits(row: dict, layout: pa.Schema) -> bool:
    try:
        return pa.RecordBatch.from_pylist([row], schema=layout).num_rows == 1
    except (pa.ArrowException, OverflowError, TypeError, ValueError):
        return False


def outside_rows(
    spark: SparkSession, pieces: Sequence[Any], rows: Rows, schema: str | T.StructType, columns: list[str] | None = None, head: int | None = None, first: int = 0, batch: int = 1000
) -> DataFrame:
    """piece int (from ``first``), n long (from 0), row struct (null for a failure), failure string.

    ``columns`` (all, if not given) reach the reader, and so does ``head``, the most rows of each piece. Values absent from a row are null.
    """
    whole = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    kept = T.StructType([f for f in whole.fields if columns is None or f.name in columns])
    layout = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("row", kept), T.StructField("failure", T.StringType())])
    numbered = list(enumerate(pieces, first))
    tasks = min(len(numbered), MOST_TASKS, max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, -(-len(numbered) // PIECES_A_TASK)))
    title = f"outside_{uuid.uuid4().hex}"

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(numbered[k::tasks]) for k in range(tasks)]

        def read(self, partition):
            arrow = to_arrow_schema(layout)
            for number, piece in partition.value if partition else []:
                yield from batches(number, piece, rows, arrow, head, batch)

    class Outside(DataSource):
        @classmethod
        def name(cls):
            return title

        def schema(self):
            return layout

        def reader(self, schema):
            return Reader()

    if not numbered:
        return spark.createDataFrame([], layout)
    spark.dataSource.register(Outside)
    return spark.read.format(title).load()
