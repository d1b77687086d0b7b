"""The stateful endpoint against the batch cache, its lifetime, and what streams and queries leave behind."""

import hashlib
import os
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.operators import cache, store
from tessera.plans import catalogue
from tessera.staging import shared_folder
from tessera.streaming import cached, endpoint
from tessera.streaming.ttl import stream_hits

SF = "/root/testdata/sf0.001"


def _agent(mark):
    def ask(questions):
        return questions.select("query_id", "query", F.when(F.col("query") == "empty", "").when(F.col("query") != "none", F.concat(F.lit(mark), "query")).alias("answer"), F.array("query").alias("contexts"))

    return ask


class Served:
    """A stream of questions in files, a micro-batch each."""

    def __init__(self, spark, folder, agent, ttl=3600):
        self.spark, self.folder = spark, str(folder)
        spark.createDataFrame([], "query_id long, query string").write.parquet(f"{self.folder}/in")
        self.start(agent, ttl)

    def start(self, agent, ttl=3600):
        stream = self.spark.readStream.schema("query_id long, query string").option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        self.query = cached.serve_cached(stream, agent, f"{self.folder}/out", f"{self.folder}/answers", f"{self.folder}/state", ttl)

    def ask(self, rows):
        self.spark.createDataFrame(rows, "query_id long, query string").coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        self.query.processAllAvailable()

    def said(self):
        rows = self.spark.read.schema("query_id long, answer string, source string, contexts array<string>").parquet(f"{self.folder}/out").collect()
        return sorted(((r["query_id"], r["answer"], r["source"], tuple(r["contexts"])) for r in rows), key=str)


def test_state_equals_the_batch_cache(spark, tmp_path):
    """The same questions, micro-batch by micro-batch, through the state and through the table."""
    rounds = [[(1, "a"), (2, "b"), (3, "a"), (4, "empty"), (5, "none"), (6, None)], [(11, "a"), (12, "c"), (14, "empty"), (15, "none"), (16, None)], [(21, "c"), (22, "b"), (23, "d")]]
    served = Served(spark, tmp_path, _agent("says "))
    held = cache.AnswerCache(spark, "state_equals", parts=4)
    expected = []
    for k, rows in enumerate(rounds):
        served.ask(rows)
        asked = spark.createDataFrame([r for r in rows if r[1] is not None], "query_id long, query string")
        made = held.respond(asked, _agent("says "), F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.lit(k)))
        expected += [(r["query_id"], r["answer"], r["source"], tuple(r["contexts"])) for r in made.collect()]
    served.query.stop()
    said = served.said()
    assert [r for r in said if r[0] not in (6, 16)] == sorted(expected, key=str)
    assert [r[2] for r in said if r[0] in (6, 16)] == ["Research Agent"] * 2
    held.drop()


def test_state_is_gone_after_its_lifetime(spark, tmp_path):
    served = Served(spark, tmp_path, _agent("x "), ttl=12)
    served.ask([(1, "a"), (2, "b")])
    began = time.time()
    served.ask([(3, "a")])
    rows = [x["numRowsTotal"] for p in served.query.recentProgress for x in p["stateOperators"]]
    assert max(rows) >= 2
    if time.time() - began < 10:
        assert (3, "x a", "Redis Memory", ()) in served.said()
    time.sleep(max(0, began + 14 - time.time()))
    served.ask([(4, "a")])
    served.query.stop()
    assert (4, "x a", "Research Agent", ("a",)) in served.said()
    assert "b" not in {r["value"]["value"]["answer"].removeprefix("x ") for r in spark.read.format("statestore").option("stateVarName", "answer").load(f"{served.folder}/state").collect()}


def test_a_rerun_micro_batch_neither_loses_nor_repeats(spark, tmp_path):
    """The agent answers, then the query dies before it commits; the next start runs the micro-batch again."""
    died = []

    def deadly(questions):
        made = _agent("first ")(questions)
        if questions.where("query = 'bomb'").count():
            died.append(made.count())
            raise RuntimeError("killed")
        return made

    served = Served(spark, tmp_path, deadly)
    served.ask([(1, "a")])
    with pytest.raises(Exception, match="killed"):
        served.ask([(2, "a"), (3, "bomb")])
    assert died == [1]
    served.start(_agent("second "))
    served.query.processAllAvailable()
    served.ask([(4, "bomb"), (5, "a")])
    served.query.stop()
    assert [r[:3] for r in served.said()] == [
        (1, "first a", "Research Agent"), (2, "first a", "Redis Memory"), (3, "second bomb", "Research Agent"), (4, "second bomb", "Redis Memory"), (5, "first a", "Redis Memory")
    ]


def _left(spark):
    return set(os.listdir(shared_folder(spark).removeprefix("file:")))


@pytest.mark.parametrize("name", ["rag_answers", "chat_answers", "stream_chat", "ingest_points", "line_chunks", "source_counts"])
def test_queries_leave_their_result_alone(spark, name):
    before, tables = _left(spark), {t.name for t in spark.catalog.listTables()}
    df = __spark_entry__.queries()[name](spark, SF)
    assert df.count() > 0 and len(_left(spark) - before) <= 1
    assert {t.name for t in spark.catalog.listTables()} == tables


def test_every_row_of_every_source_becomes_points(spark, tmp_path):
    """More conversations than any head of a source holds."""
    said = [(c, t, "user", f"word{c} turn{t}") for c in range(1, 151) for t in range(1, 4)]
    spark.createDataFrame([(k, f"text {k}", "en", "web", 6) for k in range(1, 4)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(said, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["id"]: r["text_md5"] for r in __spark_entry__.queries()["ingest_points"](spark, str(tmp_path)).collect()}
    texts = [f"{k} text {k} en web 6" for k in range(1, 4)] + [f"{c} {t} user {x}" for c, t, _, x in said]
    assert got == {k: hashlib.md5(x.encode()).hexdigest() for k, x in enumerate(texts)}


def test_micro_batches_leave_nothing(spark, tmp_path):
    collection, held = store.Collection(spark, "left_points", 64, parts=2), cache.AnswerCache(spark, "left_cache", parts=2)
    collection.ingest(spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "id long, text string"))
    spark.createDataFrame([], "query_id long, query string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("query_id long, query string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = endpoint.serve(stream, collection.read, held, f"{tmp_path}/out", f"{tmp_path}/state")
    seen = []
    for k in range(4):
        spark.createDataFrame([(k, f"alpha {k}")], "query_id long, query string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query.processAllAvailable()
        seen.append(len(_left(spark)))
    query.stop()
    assert len(set(seen)) == 1 and held.read().count() == 4
    collection.drop()
    held.drop()


def test_no_agent_is_asked_where_all_answers_are_held(spark):
    held, now = cache.AnswerCache(spark, "all_held", parts=2), F.lit("2024-01-01").cast("timestamp")
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "query_id long, query string")
    held.put(spark.createDataFrame([("a", "x"), ("b", "y")], "query string, answer string"), now)

    def agent(questions):
        raise AssertionError("asked")

    assert sorted((r["query_id"], r["answer"], r["source"]) for r in held.respond(asked, agent, now).collect()) == [(k, x, "Redis Memory") for k, x in ((1, "x"), (2, "y"), (3, "x"))]
    held.drop()


def _hits(spark, folder, rounds, **options):
    """event_id to hit of requests (key, seconds or none, event_id), a micro-batch a round, and the rows of state after each micro-batch."""
    at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("s"))
    arrivals = [spark.createDataFrame(rows, "key string, s decimal(18, 6), event_id long").select("key", at.alias("ts"), "event_id") for rows in rounds]
    state = []
    for query in catalogue._streamed(arrivals, str(folder), lambda stream: stream_hits(stream, **options).writeStream):
        state += [x["numRowsTotal"] for p in query.recentProgress for x in p["stateOperators"]]
    return {r["event_id"]: r["hit"] for r in spark.read.schema("event_id long, hit boolean").parquet(f"{folder}/out").collect()}, state


def test_keys_share_calls_and_state(spark, tmp_path):
    """A call and a row of state for each bucket, not for each key, and each key with a lifetime of its own."""
    first = [(f"k{n}", Decimal(n), n) for n in range(500)]
    again = [(f"k{n}", Decimal(3600 + n) - Decimal(n % 2) / 1_000_000, 1000 + n) for n in range(500)]
    got, state = _hits(spark, tmp_path, [first, again], buckets=8)
    assert got == {n: False for n in range(500)} | {1000 + n: n % 2 == 1 for n in range(500)}
    assert 0 < max(state) <= 8


def test_entries_of_a_bucket_are_dropped_one_by_one(spark, tmp_path):
    day = 24 * 3600
    rounds = [[("a", Decimal(0), 1), ("b", Decimal(1800), 2)], [("c", Decimal(2 * day), 3)], [("c", Decimal(2 * day + 60), 4), ("a", Decimal(2 * day + 60), 5)]]
    got, _ = _hits(spark, tmp_path, rounds, buckets=1)
    assert got == {1: False, 2: False, 3: False, 4: True, 5: False}
    held = spark.read.format("statestore").load(f"{tmp_path}/state").select("value.groupState.keys").collect()
    assert [sorted(r["keys"]) for r in held] == [["a", "c"]]


def test_requests_behind_the_watermark_null_keys_and_times(spark, tmp_path):
    """The micro-batch that follows a later time without another in between still takes what is behind it."""
    day = 24 * 3600
    rounds = [[("a", Decimal(9 * day), 1), (None, Decimal(9 * day), 2)], [("b", Decimal(5 * day), 3), ("b", Decimal(5 * day + 60), 4), (None, Decimal(9 * day + 60), 5), ("a", None, 6), ("n", None, 7)]]
    before = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        got, _ = _hits(spark, tmp_path, rounds, buckets=3)
    finally:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", before)
    assert got == {1: False, 2: False, 3: False, 4: True, 5: True, 6: False, 7: False}


@pytest.mark.parametrize("copies", [0, 5])
def test_stream_ttl_of_ids_out_of_time(spark, tmp_path, copies):
    """Tables side by side in time, with other ids and users, and an empty one: no event is taken for a late one."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    made = events.crossJoin(spark.range(copies).withColumnRenamed("id", "k")).withColumns({"event_id": F.col("event_id") + 1000 * F.col("k"), "user_id": F.col("user_id") + 1000 * F.col("k")})
    made.drop("k").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, catalogue.stream_ttl(spark, str(tmp_path)).collect()))
    assert got == sorted(map(tuple, catalogue.ttl_cache(spark, str(tmp_path)).collect())) and len(got) == copies * events.count()


def test_an_arrival_of_many_files_is_one_micro_batch(spark, tmp_path):
    arrivals = [spark.range(10 * k, 10 * k + 10, 1, 5) for k in range(3)]
    got = [[(p["batchId"], p["numInputRows"]) for p in q.recentProgress if p["numInputRows"]] for q in catalogue._streamed(arrivals, str(tmp_path), lambda s: s.writeStream)]
    assert got == [[(k, 10)] for k in range(3)] and spark.read.parquet(f"{tmp_path}/out").count() == 30
    assert len([f for f in os.listdir(f"{tmp_path}/in") if f.endswith(".parquet")]) == 15
