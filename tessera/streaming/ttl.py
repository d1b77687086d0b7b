"""The cache with a fixed lifetime over a stream of requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_hits(requests: DataFrame, ttl_seconds: int = 3600, lateness: str = "1 day", buckets: int = 1024) -> DataFrame:
    """event_id, hit of a stream of requests (key, ts, event_id). The state holds when each key's entry expires, which is dropped
    once no request can find it alive: when the latest time seen is ``lateness`` past that. Requests that are later than ``lateness`` are dropped.
    A request without a time is a miss that writes nothing.

    Requests of a micro-batch are served in order of time; what comes in a later batch is served after it, whatever its time.
    Keys are dealt to ``buckets`` by a hash, and a bucket is served by one call of Python, which holds its requests of the micro-batch
    (numbers, a text for each key) and its live entries: a call for each key costs milliseconds. A checkpoint is bound to its number of buckets.
    """
    lifetime = ttl_seconds * 1_000_000

    def serve(bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        held = dict(zip(*state.get)) if state.exists else {}
        hits = []
        for key, at in zip(rows["key"], rows["at"]):
            expires = held.get(key)
            hit = expires is not None and at < expires
            if not hit and at == at:
                held[key] = int(at) + lifetime
            hits.append(hit)
        passed = state.getCurrentWatermarkMs() * 1000  # requests of the next micro-batch are later than this, those of this one need not be
        held = {key: expires for key, expires in held.items() if expires > passed}
        if held:
            state.update((list(held), list(held.values())))
            state.setTimeoutTimestamp(max(held.values()) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "hit": hits})

    timed = requests.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("time"), "event_id").withWatermark("time", lateness)
    timed = timed.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", "time", F.unix_micros("time").alias("at"), "event_id")
    return timed.groupBy("bucket").applyInPandasWithState(serve, "event_id long, hit boolean", "keys array<string>, expires array<long>", "append", GroupStateTimeout.EventTimeTimeout)
