"""The answer cache: keyed by the md5 of the raw question, with a lifetime fixed at the write."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import FROM_AGENT, FROM_CACHE, LLM_FAILED, LLM_MISSING, NO_DOCUMENT
from tessera.operators.store import Keyed
from tessera.staging import Written

ENTRY = "key string, answer string, expires_at timestamp"


def cache_key(query: Column) -> Column:
    return F.md5(query.cast("binary"))


def looked_up(questions: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """``questions`` (with query) and ``cached``: the live, non-empty answer of (key, answer, expires_at), or null.

    Of several entries under one key the one that lives longest counts.
    """
    live = cache.where((F.col("expires_at") > now) & (F.col("answer") != ""))
    live = live.groupBy("key").agg(F.max_by("answer", F.struct("expires_at", "answer")).alias("cached"))
    return questions.withColumn("key", cache_key(F.col("query"))).join(live, "key", "left")


def cache_aside(questions: DataFrame, cache: DataFrame, agent: Callable[[DataFrame], DataFrame], now: Column, ttl_seconds: int = 3600, keep_errors: bool = True) -> tuple[DataFrame, DataFrame]:
    """(responses, cache entries to write). Hits answer with no contexts; misses go to ``agent``, and whatever it answers is kept.

    ``agent`` is asked once for each distinct question that misses, not at all where none does, and what it answers is written before it is used, as a
    generator may say something else when asked again. ``keep_errors=False`` leaves out fixed messages and failures of the generator.
    """
    probed = Written(looked_up(questions.select("query_id", "query"), cache, now)).read()
    hits = probed.where("cached IS NOT NULL").select(
        "query_id", F.col("cached").alias("answer"), F.lit(FROM_CACHE).alias("source"), F.array().cast("array<string>").alias("contexts")
    )
    misses = probed.where("cached IS NULL")
    once = misses.groupBy("query").agg(F.min("query_id").alias("query_id")).select("query_id", "query")
    if misses.isEmpty():  # a search without questions would still read all points
        made = questions.sparkSession.createDataFrame([], "query string, answer string, contexts array<string>")
    else:
        made = Written(agent(once).select("query", "answer", F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"))).read()
    answered = misses.select("query_id", "query").join(made, "query").select("query_id", "answer", F.lit(FROM_AGENT).alias("source"), "contexts")
    entries = made.where("answer IS NOT NULL")
    if not keep_errors:
        entries = entries.where(~F.col("answer").isin(NO_DOCUMENT, LLM_MISSING) & ~F.col("answer").startswith(LLM_FAILED))
    entries = entries.select(cache_key(F.col("query")).alias("key"), "answer", (now + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at"))
    return hits.unionByName(answered), entries


class AnswerCache(Keyed):
    """Entries by key, in a table. Writing a key again overwrites its answer and starts its lifetime anew; only the parts of the keys that are written change."""

    def __init__(self, spark: SparkSession, name: str, ttl_seconds: int = 3600, parts: int = 16):
        super().__init__(spark, name, ENTRY, "key", parts)
        self.ttl_seconds = ttl_seconds

    def get(self, questions: DataFrame, now: Column) -> DataFrame:
        return looked_up(questions, self.read(), now)

    def put(self, answers: DataFrame, now: Column) -> None:
        """``answers``: query, answer, one row a query. Entries that have expired by ``now`` go from all parts."""
        expires = now + F.make_dt_interval(secs=F.lit(self.ttl_seconds))
        self.write_entries(answers.where("answer IS NOT NULL").select(cache_key(F.col("query")).alias("key"), "answer", expires.alias("expires_at")), now)
        self.swept(now)

    def write_entries(self, entries: DataFrame, now: Column) -> None:
        """Entries that have expired by ``now`` are left behind in the parts that are written; ``swept`` leaves them behind everywhere."""
        self.upsert(entries, F.col("expires_at") > now)

    def swept(self, now: Column) -> None:
        """Parts that hold entries which have expired by ``now`` are written without them."""
        gone = [r["part"] for r in self.read().where(F.col("expires_at") <= now).select(self._part()).distinct().collect()]
        if gone:
            self.write(self.rows(gone).where(F.col("expires_at") > now).withColumn("part", self._part()), gone)

    def respond(self, questions: DataFrame, agent: Callable[[DataFrame], DataFrame], now: Column, keep_errors: bool = True) -> DataFrame:
        """query_id, answer, source, contexts; new answers are in the table before they are returned."""
        responses, entries = cache_aside(questions, self.read(), agent, now, self.ttl_seconds, keep_errors)
        self.write_entries(entries, now)
        return responses


def replayed(requests: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """event_id, hit of requests (key, ts, event_id) served one after the other: a miss writes, reads do not prolong.

    Requests are sorted by key and time within partitions and folded as a stream, so a hot key needs no memory, but its
    requests are served one after the other by one task: whether one hits hangs on all before it.
    """
    lifetime = ttl_seconds * 1_000_000
    ordered = requests.select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id").repartition("key").sortWithinPartitions("key", "at", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = expires = None
        for batch in batches:
            hits = []
            for k, at in zip(batch["key"].tolist(), batch["at"].tolist()):
                if k != key:
                    key, expires = k, None
                hit = expires is not None and at < expires
                if not hit:
                    expires = at + lifetime
                hits.append(hit)
            yield pd.DataFrame({"event_id": batch["event_id"], "hit": hits})

    return ordered.mapInPandas(run, "event_id long, hit boolean")
