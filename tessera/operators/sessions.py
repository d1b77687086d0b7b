"""Chat sessions: an append-only log, replayed in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def appended(log: DataFrame, turns: DataFrame) -> DataFrame:
    """``log`` with a user's turns (conv_id, turn, query, answer): the question always, the answer only where there is one."""
    asked = turns.select("conv_id", "turn", F.lit("user").alias("role"), F.col("query").alias("text"))
    said = turns.where("answer IS NOT NULL").select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text"))
    return log.unionByName(asked).unionByName(said)


def replay(log: DataFrame) -> DataFrame:
    """conv_id, position (from 1), role, text in order of turns."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role")
    return log.select("conv_id", F.row_number().over(order).cast("long").alias("position"), "role", "text")


def numbered_contexts(responses: DataFrame) -> DataFrame:
    """query_id, number (from 1), context of responses that have contexts."""
    return responses.where("size(contexts) > 0").select("query_id", F.posexplode("contexts").alias("pos", "context")).select(
        "query_id", (F.col("pos") + 1).cast("long").alias("number"), "context"
    )


class SessionLog:
    """The log as a table (``Settings.sessions`` names it): turns are appended, nothing that was written is read or changed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (conv_id bigint, turn bigint, role string, text string) USING parquet")

    def append(self, turns: DataFrame) -> None:
        """``turns``: conv_id, turn, query, answer."""
        none = self.spark.createDataFrame([], "conv_id long, turn long, role string, text string")
        appended(none, turns).write.insertInto(self.name)

    def replay(self) -> DataFrame:
        return replay(self.spark.table(self.name))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
