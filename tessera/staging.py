"""Tables written once in the folder that all executors share, for results that are used more than once."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only where spark.checkpoint.dir is absent on a local master (tests) a temporary folder is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_owners = threading.local()


@contextmanager
def owner() -> Iterator[list]:
    """Whatever this thread writes in the shared folder within the block is dropped at its end, so nothing that reads it may leave the block unread."""
    held: list = []
    stack = _owners.__dict__.setdefault("stack", [])
    stack.append(held)
    try:
        yield held
    finally:
        stack.remove(held)
        for made in held:
            made.drop()


def owned(made) -> None:
    """Hands what has a ``drop`` to the innermost owner, if there is one."""
    if _owners.__dict__.get("stack"):
        _owners.stack[-1].append(made)


def result_only(query: Callable[[], DataFrame]) -> DataFrame:
    """The query's rows. If it wrote tables on the way, its rows are written as well, and those tables are dropped."""
    with owner() as held:
        df = query()
        if not held:
            return df
        result = Written(df, owned_by_block=False)
    return result.read()


class Written:
    """A table written as Parquet in the shared folder; ``drop`` removes it, and so does the end of the block that owns it."""

    def __init__(self, df: DataFrame, owned_by_block: bool = True):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = f"{shared_folder(self.spark)}/table-{uuid.uuid4().hex}"
        if owned_by_block:
            owned(self)  # before it is written: a write that fails is cleared away as well
        df.write.parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        delete_path(self.spark, self.path)
