import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import ingest, models
from tessera.config import LLM_FAILED, LLM_MISSING, NO_DOCUMENT, NOT_IN_CONTEXT, Settings
from tessera.functions.text import not_blank, row_text, split_text
from tessera.operators import answer, cache, chunks, retrieve, sessions, store
from tessera.plans import catalogue
from tessera.sources import loader
from tessera.streaming.ttl import stream_hits

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{SF}/{f}'")
    return con


def _rows(rows):
    return sorted((tuple("~" if x is None else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = duck.sql(catalogue.SQL[name]).select(*[f'"{c}"' for c in columns]).fetchall()
    assert _rows(tuple(r) for r in df.select(*columns).collect()) == _rows(expected)


@pytest.mark.parametrize(
    ("text", "sizes"),
    [("a" * 2000, [800, 800, 700]), ("a" * 800, [800]), ("x " * 500, [799, 349]), ("a" * 799 + "\n\n" + "b" * 10, [799, 10]), ("p1\n\np2", [6]), ("", [])],
)
def test_splitter(text, sizes):
    assert [len(x) for x in split_text(text)] == sizes


def test_splitter_keeps_what_is_not_blank(spark):
    for row in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect():
        parts = split_text(row["text"])
        assert all(x.strip() and len(x) <= 800 for x in parts)
        assert set(row["text"].split()) <= set(" ".join(parts).split())


def test_falsy_values_fall_out_of_row_text(spark):
    df = spark.createDataFrame([("a", "", None, 0, 1.5, True), ("", " ", None, 3, 0.0, False), (None, None, None, 0, 0.0, False)], "a string, b string, c string, d int, e double, f boolean")
    assert [r[0] for r in df.select(row_text(df)).collect()] == ["a 1.5 True", "  3", ""]


def test_blanks(spark):
    df = spark.createDataFrame([(x,) for x in (" ", "　", "\t\n", "\x1c", "\x85", "\xa0", "​", None)], "t string")
    assert [r[0] for r in df.select(not_blank(F.col("t"))).collect()] == [False] * 6 + [True, False]


def test_chunk_ids_have_gaps(spark):
    docs = spark.createDataFrame([(0, "one"), (1, "gone"), (2, "three"), (3, None), (4, "")], "doc_id long, text string")
    drop = models.segment_udf(lambda x: "" if x == "gone" else x)
    assert sorted(map(tuple, chunks.chunk_documents(docs, ["doc_id"], segment=drop).collect())) == [(0, "one"), (2, "three")]


def test_other_types_in_row_text(spark):
    df = spark.sql(
        """SELECT * FROM VALUES
        (cast('0.00' AS decimal(12,7)), array(1, 2), named_struct('a', 1, 'b', array(named_struct('c', 'x'))), map('k', 1.5D), X'00ff', timestamp_ntz'2024-01-01 00:00:00.5', date'2024-02-29'),
        (cast('0.0000001' AS decimal(12,7)), array(), null, map(), X'', null, null) AS t(d, l, s, m, b, t, y)"""
    )
    expected = ["[1, 2] {'a': 1, 'b': [{'c': 'x'}]} {'k': 1.5} b'\\x00\\xff' 2024-01-01 00:00:00.500000 2024-02-29", "1E-7"]
    assert [r[0] for r in df.select(row_text(df)).collect()] == expected
    with pytest.raises(TypeError, match="column v"):
        row_text(spark.sql("SELECT parse_json('1') AS v"))


def test_order_keys_of_any_type(spark):
    rows = spark.createDataFrame([("b", -5, "x"), ("a", 7, "y"), ("b", 10, "z"), (None, 1, "n")], "k string, n long, text string")
    source = loader.Source("s", lambda s: rows.repartition(3), ("k", "n"))
    texts = loader.load(spark, [source])
    assert [r["text"][-1] for r in texts.orderBy("source_ord", "doc_ord").collect()] == ["n", "y", "x", "z"]
    assert [r["id"] for r in chunks.chunk_documents(texts, ["source_ord", "doc_ord"]).orderBy("id").collect()] == [0, 1, 2, 3]


def test_rows_before_a_failure_stay(spark):
    def rows(piece, columns):
        yield {"k": 1, "text": "one"}
        yield {"k": 2, "text": "two"}
        raise OSError("gone")

    fine = loader.Source("fine", lambda s: s.createDataFrame([(3, "three")], "k long, text string"), ("k",))
    never = loader.Source("never", lambda s: s.createDataFrame([(3, "three")], "k long, text string").select("absent"), ("k",))
    texts, report = loader.load_report(spark, [loader.row_source("broken", [None], rows, "k long, text string"), never, fine])
    assert [r["text"] for r in texts.orderBy("source_ord", "doc_ord").collect()] == ["1 one", "2 two", "3 three"]
    assert [tuple(r)[2:] for r in report.orderBy("source_ord").collect()] == [(2, 2, True), (0, 0, True), (1, 1, False)]
    heads = loader.load(spark, [loader.Source("h", fine.load, ("k",), 1), loader.row_source("few", [None], rows, "k long, text string", head=1)])
    assert [r["text"] for r in heads.orderBy("source_ord", "doc_ord").collect()] == ["3 three", "1 one"]


def test_numbers_are_global_over_many_ranges(spark):
    docs = spark.range(500).select("id", F.concat(F.lit("t"), F.col("id")).alias("text")).repartition(7)
    got = chunks.number_pieces(docs.select(F.col("id").alias("k"), "text"), ["k"], F.array(F.col("text"), F.lit("x")), per_part=40)
    assert [(r["id"], r["piece"]) for r in got.orderBy("id").collect()] == [(2 * k + j, x) for k in range(500) for j, x in enumerate((f"t{k}", "x"))]


def test_collection_keeps_a_stale_tail(spark):
    c = store.Collection(spark, "points_test", 64)
    chunk = lambda n, mark: spark.range(n).select("id", F.concat(F.lit(mark), F.col("id").cast("string")).alias("text"))
    c.ingest(chunk(5, "old "))
    c.ingest(chunk(3, "new "))
    texts = lambda: [r[0] for r in c.read().orderBy("id").select("payload.text").collect()]
    assert texts() == ["new 0", "new 1", "new 2", "old 3", "old 4"]
    assert c.exists()
    with pytest.raises(Exception, match="64 components"):
        c.upsert(c.read().withColumn("dense", F.array(F.lit(1.0))))
    assert texts() == ["new 0", "new 1", "new 2", "old 3", "old 4"]  # a write that fails changes nothing
    c.ingest(chunk(1, "newer "))
    assert texts()[0] == "newer 0"
    again = store.Collection(spark, "points_test", 8)
    assert (again.dimension, again.metric) == (64, "cosine")  # what exists stays as it was created
    held = {r[0].removeprefix("slot=") for r in spark.sql("SHOW PARTITIONS points_test_rows").collect()}
    said = c.properties()
    assert held == set(c.slots().values()) | set(said["replaced"].split(",")) and len(said["replaced"].split(",")) == 1  # what the last write but one replaced is gone
    c.replace(store.points_of(chunk(1, "only ")))
    assert texts() == ["only 0"]
    c.drop()
    assert not c.exists() and not [t.name for t in spark.catalog.listTables() if t.name.startswith("points_test")]


def test_flush_in_lists(spark, tmp_path):
    folder = str(tmp_path)

    def write(points):
        import uuid as u
        from pathlib import Path

        Path(folder, u.uuid4().hex).write_text(" ".join(str(p["id"]) for p in points))

    store.flush(spark.range(130).coalesce(1), write)
    held = [[int(x) for x in p.read_text().split()] for p in tmp_path.iterdir()]
    assert sorted(map(len, held)) == [30, 50, 50] and sorted(x for h in held for x in h) == list(range(130))


def test_blocks_of_questions_and_points(spark):
    points = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"))
    queries = points.select(F.col("id").alias("query_id"), "dense")
    whole, cut = retrieve.dense_top_k(queries, points, 5), retrieve.dense_top_k(queries, points, 5, query_block=90, point_block=70)
    assert _rows(map(tuple, whole.collect())) == _rows(map(tuple, cut.collect()))


def test_a_reply_over_http(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append(body)
            said = {"a": '{"response":"fine"}', "b": '{"error":"x"}', "c": "no json"}[body["prompt"]]
            self.send_response(500 if body["prompt"] == "b" else 200)
            self.end_headers()
            self.wfile.write(said.encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    settings = Settings(generator_url=f"http://127.0.0.1:{server.server_port}/", generator_model="m")
    generate = models.generate_udf(models.configured_generator(settings))
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "p string").coalesce(1)
    got = [r[0] for r in df.select(generate("p")).collect()]
    server.shutdown()
    assert got[:2] == ["fine", LLM_MISSING] and got[2].startswith(LLM_FAILED)
    assert asked[0] == {"model": "m", "prompt": "a", "stream": False, "system": settings.system_prompt, "options": {"temperature": 0.1}}
    assert NOT_IN_CONTEXT in settings.system_prompt


def test_settings_from_the_environment():
    got = Settings.from_environment({"TESSERA_DIMENSION": "8", "TESSERA_TEMPERATURE": "0.5", "TESSERA_COLLECTION": "c", "OTHER": "x"})
    assert (got.dimension, got.temperature, got.collection, got.passages) == (8, 0.5, "c", 3)
    with pytest.raises(ValueError, match="TESSERA_DIMENSION"):
        Settings.from_environment({"TESSERA_DIMENSION": "many"})


def test_ingest_from_the_command_line(spark, monkeypatch):
    monkeypatch.setenv("TESSERA_COLLECTION", "ingested")
    monkeypatch.setenv("TESSERA_DIMENSION", "64")
    assert ingest.main(["none=/no/such/path:id"], spark) == 1
    assert not spark.catalog.tableExists("ingested")  # without a text no collection is made
    assert ingest.main([f"docs={SF}/documents.parquet:doc_id:5", "none=/no/such/path:id"], spark) == 0
    collection = store.Collection(spark, "ingested")
    assert collection.read().count() > 5 and collection.dimension == 64
    collection.drop()
    with pytest.raises(SystemExit):
        ingest.main(["nonsense"], spark)


def test_models_are_loaded_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import uuid as u
        from pathlib import Path

        Path(folder, u.uuid4().hex).touch()
        return models.embed

    df = spark.range(0, 5000, 1, 1).select(F.col("id").cast("string").alias("t"))
    assert df.select(models.embed_udf(load=load)("t").alias("e")).where("size(e.dense) = 64").count() == 5000
    assert len(list(tmp_path.iterdir())) == 1


def test_cache_table(spark):
    held = cache.AnswerCache(spark, "cache_test")
    at = lambda s: F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.lit(s))
    q = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "query_id long, query string")
    held.put(spark.createDataFrame([("a", "old"), ("b", ""), ("c", None)], "query string, answer string"), at(0))
    held.put(spark.createDataFrame([("a", "new")], "query string, answer string"), at(10))
    found = lambda now: {r["query_id"]: r["cached"] for r in held.get(q, now).collect()}
    assert found(at(3609.9)) == {1: "new", 2: None, 3: "new", 4: None} and found(at(3610))[1] is None
    assert held.read().count() == 2
    held.put(spark.createDataFrame([("d", "x")], "query string, answer string"), at(5000))
    assert [r["answer"] for r in held.read().collect()] == ["x"]  # what has expired is not kept
    held.drop()


def test_a_generator_is_asked_once_a_question(spark):
    """Two entries under one key do not double a question, and what is answered is what is cached."""
    import uuid as u

    calls = F.udf(lambda q: f"{q} {u.uuid4().hex}").asNondeterministic()
    agent = lambda q: q.select("query_id", "query", calls("query").alias("answer"), F.lit(None).cast("array<string>").alias("contexts"))
    now = F.lit("2024-01-01").cast("timestamp")
    later = now + F.make_dt_interval(secs=F.lit(9))
    key = F.md5(F.lit("b").cast("binary"))
    twice = spark.range(2).select(key.alias("key"), F.concat(F.lit("kept "), F.col("id")).alias("answer"), (later + F.make_dt_interval(secs=F.col("id"))).alias("expires_at"))
    questions = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "query_id long, query string")
    responses, entries = cache.cache_aside(questions, twice, agent, now)
    said = {r["query_id"]: r["answer"] for r in responses.collect()}
    assert len(said) == 3 and said[2] == "kept 1" and said[1] == said[3] == entries.collect()[0]["answer"]


def test_top_k_beyond_the_collection(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "id long, dense array<float>")
    queries = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, dense array<float>")
    assert [(r["id"], r["rank"]) for r in retrieve.dense_top_k(queries, points, 3).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_no_documents(spark):
    questions = spark.createDataFrame([(1, "Xin chào")], "query_id long, query string")
    empty = spark.createDataFrame([], "query_id long, rank long, text string")

    def never(prompt):
        raise AssertionError

    (row,) = answer.answers(questions, empty, models.generate_udf(never)).collect()
    assert row["answer"] == NO_DOCUMENT and row["contexts"] == []


def test_failures_become_messages():
    def fail(prompt):
        raise ValueError("E")

    assert models.guarded(fail)("x") == LLM_FAILED + "E"
    assert [models.response_text(x) for x in ('{"response":"ok"}', '{"response":null}', '{"error":"x"}', '{"response":""}')] == ["ok", None, LLM_MISSING, ""]


def test_cache_keys_differ(spark):
    df = spark.createDataFrame([("Xin chào",), ("xin chào",), ("Xin chào ",)], "q string")
    assert df.select(cache.cache_key(F.col("q"))).distinct().count() == 3


def test_lifetime_is_fixed_from_the_write(spark):
    df = spark.sql("SELECT 'k' AS key, timestamp'2024-01-01' + make_dt_interval(0, 0, 0, s) AS ts, i AS event_id FROM VALUES (0.0, 1L), (3599.999999, 2L), (3600.0, 3L) AS t(s, i)")
    assert sorted(map(tuple, cache.replayed(df).collect())) == [(1, False), (2, True), (3, False)]


def test_cached_errors_can_be_left_out(spark):
    questions = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, query string")
    held = spark.createDataFrame([], "key string, answer string, expires_at timestamp")
    agent = lambda q: q.select("query_id", "query", F.when(F.col("query") == "a", NO_DOCUMENT).otherwise("fine").alias("answer"), F.lit(None).cast("array<string>").alias("contexts"))
    now = F.current_timestamp()
    assert cache.cache_aside(questions, held, agent, now)[1].count() == 2
    responses, kept = cache.cache_aside(questions, held, agent, now, keep_errors=False)
    assert kept.count() == 1 and {tuple(r["contexts"]) for r in responses.collect()} == {()}


def test_stream_equals_batch(spark, tmp_path):
    requests = catalogue._requests(spark.read.parquet(f"{SF}/events.parquet"))
    for k in range(3):
        requests.where((F.col("event_id") >= k * 334) & (F.col("event_id") < (k + 1) * 334)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_hits(stream).writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("hits").collect())) == sorted(map(tuple, cache.replayed(requests).collect()))


def test_failed_turns_keep_the_question_only(spark):
    log = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    turns = spark.createDataFrame([(1, 0, "q", "a"), (1, 2, "r", None)], "conv_id long, turn long, query string, answer string")
    assert [r["text"] for r in sessions.replay(sessions.appended(log, turns)).orderBy("position").collect()] == ["q", "a", "r"]


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 40
