"""The registered queries of the answering engine and the SQL they are held against.

Stand-in models take the place of the segmenter, embedder, reranker and generator.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tessera import config, ingest, models
from tessera.functions import segment
from tessera.functions.text import not_blank, row_text
from tessera.functions.vectors import cosine, sparse_parts, token_bucket
from tessera.operators import agent, answer, bm25, cache, chunks, retrieve, sessions, store
from tessera.operators.index import CellIndex
from tessera.plans import chunk_sql
from tessera.sources import loader
from tessera.sources.outside import json_lines
from tessera.staging import Written, delete_path, shared_folder
from tessera.streaming import cached, endpoint, progress, ttl

#: Literal texts for the blank test: blanks of several kinds, then texts that are none.
_BLANKS = ("", " ", "\t\n", "　", "\x1c\x1d", "\u0085", " ", "​", " a ")
TOKENS = r"[^\p{L}\p{N}]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_texts(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = row_text(rows)
    return rows.select("conv_id", "turn", text.alias("row_text")).where(not_blank(F.col("row_text")))


def nonblank_docs(spark, sf_dir):
    literals = spark.range(1).select(F.posexplode(F.array(*map(F.lit, _BLANKS))).alias("k", "text")).select((-1 - F.col("k")).cast("long").alias("doc_id"), "text")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(literals)
    return docs.where(F.col("text").isNotNull() & (F.col("text") != "") & not_blank(F.col("text"))).select("doc_id", F.md5("text").alias("text_md5"))


def _sources(sf_dir: str) -> list[loader.Source]:
    return [
        loader.Source("documents", lambda s: _table(s, sf_dir, "documents").select("doc_id", "text"), ("doc_id",)),
        loader.Source("conversations", lambda s: _table(s, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ("conv_id", "turn"), 200),
    ]


def union_sources(spark, sf_dir):
    rows = loader.load(spark, _sources(sf_dir))
    keys = F.transform(F.slice("doc_ord", 2, 10), lambda x: (x.cast("decimal(20,0)") - F.lit("9223372036854775808").cast("decimal(20,0)")).cast("long").cast("string"))
    return rows.select("source_ord", F.array_join(keys, "/").alias("doc_ord"), F.md5("text").alias("text_md5"))


def source_counts(spark, sf_dir):
    return loader.source_counts(
        spark, [*_sources(sf_dir), loader.Source("pages", lambda s: _table(s, sf_dir, "pages"), ("page_id",))]
    ).unionByName(loader.load(spark, _sources(sf_dir)).agg(F.count("*").alias("n_rows")).select(F.lit("corpus").alias("source"), "n_rows"))


def partial_sources(spark, sf_dir):
    """A source whose second piece cannot be read, one that cannot be read at all, and one that can."""
    pages = f"{sf_dir}/pages.parquet"
    broken = loader.parquet_source("pages", [pages, f"{sf_dir}/no_such_table.parquet", pages], ("page_id",))
    _, report = loader.load_report(spark, [broken, loader.parquet_source("none", f"{sf_dir}/none.parquet", ("id",)), *_sources(sf_dir)])
    return report


def outside_pages(spark, sf_dir):
    """Pages as packed lines of JSON, a file for each ten, one of which breaks off after its fourth page; another file is not there."""
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    pages = _table(spark, sf_dir, "pages").select("page_id", F.to_json(F.struct("page_id", "url", "html")).alias("value"))
    broken = pages.where("page_id = 13").select(F.col("page_id") + 0.5, F.lit('{"page_id": 13, "url": '))
    lines = pages.union(broken).withColumn("ten", F.floor(F.col("page_id") / 10))
    try:
        lines.repartition("ten").sortWithinPartitions("ten", "page_id").select("ten", "value").write.partitionBy("ten").option("compression", "gzip").text(folder)
        files = sorted(spark.read.text(folder).inputFiles())
        source = loader.row_source("pages", [*files[:1], f"{folder}/none.gz", *files[1:]], json_lines, "page_id long, url string, html string", ["page_id", "url"])
        texts, report = loader.load_report(spark, [source, _sources(sf_dir)[1]])
        number = F.coalesce(F.split("text", " ")[0].try_cast("long"), F.lit(0))  # the number 0 is no text
        kept = texts.where("source_ord = 0").select(number.alias("page_id"), "text")
        said = report.select((-1 - F.col("source_ord")).cast("long").alias("page_id"), F.concat_ws(" ", "source", "n_rows", "failed").alias("text"))
        return Written(kept.unionByName(said)).read()
    finally:
        delete_path(spark, folder)


def row_text_orders(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", F.md5(row_text(rows)).alias("text_md5"))


def row_text_nested(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    rows = part.select(
        "p_partkey",
        F.col("p_retailprice").cast("decimal(12,2)").alias("price"),
        F.lit(0).cast("decimal(5,2)").alias("nothing"),
        F.array("p_size", "p_partkey").alias("pair"),
        F.array().cast("array<int>").alias("no_items"),
        F.struct(F.col("p_size").alias("size"), F.array("p_brand").alias("brands"), F.lit(None).cast("int").alias("missing")).alias("described"),
        F.create_map(F.col("p_brand"), F.col("p_size") > 25).alias("large"),
        F.lit("2024-02-29").cast("date").alias("day"),
    )
    return rows.select("p_partkey", row_text(rows).alias("row_text"))


def line_chunks(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").where("text IS NOT NULL AND text <> ''")
    numbered = chunks.number_pieces(docs.select("doc_id", "text"), ["doc_id"], F.split("text", "\n"), F.col("text"))
    return numbered.where(not_blank(F.col("piece"))).select("id", F.md5("piece").alias("text_md5"))


def recursive_chunks(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunks.chunk_documents(docs, ["doc_id"])


def fault_isolation(spark, sf_dir):
    broken = loader.parquet_source("broken", f"{sf_dir}/no_such_table.parquet", ("doc_id",))
    return loader.load(spark, [broken, _sources(sf_dir)[0]]).agg(F.count("*").alias("n_texts"))


def _points(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"))


def dense_top9(spark, sf_dir):
    points = _points(spark, sf_dir)
    found = retrieve.dense_top_k(points.where("id = 0").select(F.col("id").alias("query_id"), "dense"), points, 9)
    return found.select("id", "rank", F.round("score", 6).alias("score"))


def dense_topk_batch(spark, sf_dir):
    points = _points(spark, sf_dir)
    found = retrieve.dense_top_k(points.select(F.col("id").alias("query_id"), "dense"), points, 9)
    return found.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def indexed_top9(spark, sf_dir):
    """By the index, asked in all of its cells, after a third of the points came and a ninth was put right by upserts."""
    points = _points(spark, sf_dir)
    early = points.where("id % 3 <> 0").unionByName(points.where("id % 9 = 0").withColumn("dense", F.transform("dense", lambda x: -x)))
    index = CellIndex.build(spark, f"index_{uuid.uuid4().hex}", early)
    index.upsert(points.where("id % 3 = 0"))
    found = Written(index.search(points.select(F.col("id").alias("query_id"), "dense"), 9, probes=index.cells)).read()
    index.drop()
    return found.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def index_recall(spark, sf_dir):
    """Every point as a question to the index as it is: whether it finds nine in ten of the nine nearest."""
    points = _points(spark, sf_dir)
    index = CellIndex.build(spark, f"index_{uuid.uuid4().hex}", points)
    queries = points.select(F.col("id").alias("query_id"), "dense")
    exact, found = retrieve.dense_top_k(queries, points, 9).select("query_id", "id"), index.search(queries, 9).select("query_id", "id", F.lit(1).alias("hit"))
    judged = exact.join(found, ["query_id", "id"], "left").agg((F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count("*")).alias("nine_in_ten"), F.count_distinct("query_id").alias("n_questions"))
    made = Written(judged.crossJoin(index.read().agg(F.count("*").alias("n_points"))).select("n_points", "n_questions", "nine_in_ten")).read()
    index.drop()
    return made


def cosine_pairs(spark, sf_dir):
    points = _points(spark, sf_dir)
    pairs = points.select((F.col("id") + 1).alias("next"), F.col("dense").alias("before")).join(points, F.col("next") == F.col("id"))
    return pairs.select("id", F.round(cosine(F.col("dense"), F.col("before")), 6).alias("cosine"))


def sparse_weights(spark, sf_dir):
    tokens = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.lower("text"), TOKENS)).alias("token")).where("token <> ''")
    return tokens.groupBy("doc_id", token_bucket(F.col("token")).alias("bucket")).agg(F.count("*").alias("weight"))


def sparse_vectors(spark, sf_dir):
    entries = F.transform(F.sort_array(F.collect_list(F.struct("bucket", "weight"))), lambda x: F.struct(x["bucket"].cast("string"), x["weight"]))
    by_doc = sparse_weights(spark, sf_dir).groupBy("doc_id").agg(sparse_parts(F.map_from_entries(entries)).alias("s"))
    texts = lambda c: F.array_join(F.transform(c, lambda v: v.cast("int").cast("string")), ",")
    return by_doc.select("doc_id", texts(F.array_sort("s.indices")).alias("indices"), texts(_by_index("s")).alias("vals"))


def _by_index(parts: str):
    """The values in order of their indices."""
    pairs = F.array_sort(F.arrays_zip(F.col(f"{parts}.indices").alias("indices"), F.col(f"{parts}.values").alias("values")))
    return F.transform(pairs, lambda x: x["values"])


def _questions(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def retrieve_rerank(spark, sf_dir):
    """Whole documents as passages: nine by vector, then three by the reranker."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    points = Written(store.points_of(docs)).read()
    found = retrieve.search(_questions(spark, sf_dir), points, models.embed_udf())
    return found.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "rank", F.col("rerank_score").cast("long").alias("overlap"))


def rerank_bm25(spark, sf_dir):
    """The same ranked by BM25. Its statistics come from an upsert of all documents, a third of them with other texts, and one that puts these right."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    statistics = bm25.TermStatistics(spark, f"terms_{uuid.uuid4().hex}", parts=4)
    statistics.upsert(docs.withColumn("text", F.when(F.col("id") % 3 == 0, F.concat(F.lit("moved away "), "id")).otherwise(F.col("text"))))
    statistics.upsert(docs.where("id % 3 = 0"))
    points = Written(store.points_of(docs)).read()
    found = retrieve.search(_questions(spark, sf_dir), points, models.embed_udf(), ranker=lambda c, k: bm25.bm25_reranked(c, statistics, k))
    made = Written(found.select("query_id", "id", "rank", F.round("rerank_score", 6).alias("score"))).read()
    statistics.drop()
    return made


def syllable_words(spark, sf_dir):
    """Where learning the lexicon of the segmenter begins: syllables, and runs of up to four that come three times or more."""
    return segment.ngram_counts(segment.run_counts(_table(spark, sf_dir, "documents")))


def segmented_docs(spark, sf_dir):
    """Documents segmented by the lexicon learned from them; without the marks that join syllables their tokens are left."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    said = docs.select("doc_id", segment.lexicon_udf(segment.learn(docs), spark)("text").alias("said"))
    return said.select("doc_id", F.md5(F.translate("said", "_", " ")).alias("tokens_md5"), (F.size(F.split("said", " ")) <= F.size(F.split(F.translate("said", "_", " "), " "))).alias("joined"))


def prompt_build(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text")
    prompt = answer.prompt_of(F.col("contexts"), F.col("query_id").cast("string"))
    return answer.contexts_of(turns).select("query_id", F.md5(prompt).alias("prompt_md5"), F.size("contexts").cast("long").alias("n_contexts"))


def fallback_answer(spark, sf_dir):
    """Each question as it is, with the document of its number as passage, and once more under a number that no document has."""
    questions = _questions(spark, sf_dir)
    passages = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.lit(1).alias("rank"), "text")
    asked = questions.unionByName(questions.withColumn("query_id", -1 - F.col("query_id")))
    return answer.answers(asked, passages).select("query_id", "answer", F.size("contexts").cast("long").alias("n_contexts"))


#: Replies of a generator to each event: with a text, with null, without the field, with no text, no object, no JSON.
_REPLIES = ("ok", "null", "absent", "empty", "list", "broken")


def llm_parse(spark, sf_dir):
    said = {"null": '{"response":null}', "empty": '{"response":""}', "list": "[1]", "broken": "{bad"}
    replies = {"ok": F.to_json(F.struct(F.concat(F.lit("ok "), "event_type").alias("response"))), "absent": F.col("props")} | {k: F.lit(v) for k, v in said.items()}
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), replies[k].alias("body")) for k in _REPLIES])).alias("reply")
    return _table(spark, sf_dir, "events").select("event_id", kinds).select("event_id", "reply.kind", models.parsed_response(F.col("reply.body")).alias("answer"))


def generator_messages(spark, sf_dir):
    """A generator that fails for every third prompt."""

    def generate(prompt: str) -> str:
        if int(prompt) % 3 == 0:
            raise ValueError(f"no {prompt}")
        return models.response_text('{"error":"x"}' if int(prompt) % 3 == 1 else f'{{"response":"said {prompt}"}}')

    return _table(spark, sf_dir, "events").select("event_id", models.generate_udf(generate)(F.col("event_id").cast("string")).alias("answer"))


def upsert_last_wins(spark, sf_dir):
    held = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.round("c_acctbal", 2).alias("balance"))
    changed = held.where("id % 3 = 0").withColumn("balance", F.round(F.col("balance") + 1, 2)).withColumn("batch", F.lit(1))
    again = held.where("id % 6 = 0").withColumn("balance", F.round(F.col("balance") + 2, 2)).withColumn("batch", F.lit(2))
    added = held.where("id % 300 = 0").withColumn("id", F.col("id") + 1_000_000).withColumn("batch", F.lit(3))
    new = store.last_wins(changed.unionByName(again).unionByName(added), "id", "batch").drop("batch")
    return store.upserted(held, new)


def upsert_batches(spark, sf_dir):
    return store.flush_batches(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def cache_key(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", cache.cache_key(F.col("text")).alias("key"))


def _requests(events: DataFrame) -> DataFrame:
    return events.select(F.md5(F.concat_ws("|", F.col("user_id").cast("string"), "event_type")).alias("key"), "ts", "event_id")


def ttl_cache(spark, sf_dir):
    return cache.replayed(_requests(_table(spark, sf_dir, "events")))


def cache_route(spark, sf_dir):
    asked = _table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("text").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"))
    questions = asked.select("query_id", F.col("text").alias("query"))
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    held = questions.where("query_id % 3 <> 0").select(
        cache.cache_key(F.col("query")).alias("key"),
        F.when(F.col("query_id") % 7 == 0, "").otherwise(F.concat(F.lit("cached "), F.md5("query"))).alias("answer"),
        F.when(F.col("query_id") % 5 == 0, now).otherwise(now + F.make_dt_interval(secs=F.lit(60))).alias("expires_at"),
    )
    agent = lambda misses: misses.select("query_id", "query", F.concat(F.lit("fresh "), F.md5("query")).alias("answer"), F.array(F.col("query")).alias("contexts"))
    responses, _ = cache.cache_aside(questions, held, agent, now)
    return responses.select("query_id", "answer", "source", F.size("contexts").cast("long").alias("n_contexts"))


def session_replay(spark, sf_dir):
    return sessions.replay(_table(spark, sf_dir, "conversations")).select("conv_id", "position", "role", F.md5("text").alias("text_md5"))


def context_numbers(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text")
    return sessions.numbered_contexts(answer.contexts_of(turns)).select("query_id", "number", F.md5("context").alias("context_md5"))


def answer_cache(spark, sf_dir):
    """All questions cached, every other one overwritten later, looked up after the first ones have expired."""
    at = lambda seconds: F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.lit(seconds))
    asked = _table(spark, sf_dir, "conversations").groupBy(F.col("text").alias("query")).agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"))
    held = cache.AnswerCache(spark, f"cache_{uuid.uuid4().hex}")
    held.put(asked.select("query", F.concat(F.lit("first "), F.md5("query")).alias("answer")), at(0))
    held.put(asked.where("query_id % 2 = 0").select("query", F.concat(F.lit("second "), F.md5("query")).alias("answer")), at(1800))
    found = Written(held.get(asked, at(3600)).select("query_id", F.col("cached").alias("answer"))).read()
    held.drop()
    return found


def session_append(spark, sf_dir):
    """Each conversation with one more turn, which failed for every third."""
    log = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    last = log.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn"))
    turns = last.select("conv_id", "turn", F.lit("and then?").alias("query"), F.when(F.col("conv_id") % 3 != 0, F.lit("nothing more")).alias("answer"))
    return sessions.replay(sessions.appended(log, turns)).select("conv_id", "position", "role", F.md5("text").alias("text_md5"))


def session_log(spark, sf_dir):
    """Each user's turn appended to the table of sessions, the even conversations first; every third conversation got no answers."""
    asked = _table(spark, sf_dir, "conversations").where("role = 'user'")
    turns = asked.select("conv_id", "turn", F.col("text").alias("query"), F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("on "), F.md5("text"))).alias("answer"))
    log = sessions.SessionLog(spark, f"sessions_{uuid.uuid4().hex}")
    log.append(turns.where("conv_id % 2 = 0"))
    log.append(turns.where("conv_id % 2 <> 0"))
    made = Written(log.replay().select("conv_id", "position", "role", F.md5("text").alias("text_md5"))).read()
    log.drop()
    return made


def question_vectors(spark, sf_dir):
    vectors = _questions(spark, sf_dir).select("query_id", F.posexplode(models.embed_udf()("query")["dense"]).alias("place", "v")).where("v <> 0")
    return vectors.select("query_id", F.col("place").cast("long").alias("place"), F.round(F.col("v").cast("double"), 6).alias("v"))


def _collection(spark, sf_dir) -> DataFrame:
    """All documents as chunks and points, written once."""
    made = chunks.chunk_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return Written(store.points_of(made)).read()


def retrieve_passages(spark, sf_dir):
    found = retrieve.search(_questions(spark, sf_dir), _collection(spark, sf_dir), models.embed_udf())
    return found.select("query_id", "id", "rank", F.col("rerank_score").cast("long").alias("overlap"), F.md5("text").alias("text_md5"))


def rag_answers(spark, sf_dir):
    """Documents to chunks to points; each benchmark text as a question: vector search, rerank, prompt, answer."""
    made = agent.researcher(_collection(spark, sf_dir))(_questions(spark, sf_dir))
    return made.select("query_id", "answer", F.size("contexts").cast("long").alias("n_contexts"))


def empty_collection(spark, sf_dir):
    """Questions to a collection without points: the fixed answer, whatever the generator."""
    name = f"collection_{uuid.uuid4().hex}"
    collection = store.Collection(spark, name, 64)
    made = Written(agent.researcher(collection.read())(_questions(spark, sf_dir))).read()
    collection.drop()
    return made.select("query_id", "answer", F.size("contexts").cast("long").alias("n_contexts"))


def chat_answers(spark, sf_dir):
    """The questions asked twice: the agent answers, then the cache."""
    collection, held = _collection(spark, sf_dir), cache.AnswerCache(spark, f"cache_{uuid.uuid4().hex}")
    asked, rounds = _questions(spark, sf_dir), []
    for turn in (1, 2):
        made = agent.chat(asked, collection, held, F.lit("2024-01-01 00:00:00").cast("timestamp"))
        rounds.append(Written(made.select(F.lit(turn).alias("round"), "query_id", "answer", "source", F.size("contexts").cast("long").alias("n_contexts"))).read())
    held.drop()
    return rounds[0].unionByName(rounds[1])


def stream_chat(spark, sf_dir):
    """The same over a stream: two micro-batches of the same questions."""
    collection, held = _collection(spark, sf_dir), cache.AnswerCache(spark, f"cache_{uuid.uuid4().hex}")
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    asked = _questions(spark, sf_dir)
    asked.coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = endpoint.serve(stream, lambda: collection, held, f"{folder}/out", f"{folder}/state")
    query.processAllAvailable()
    asked.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    query.processAllAvailable()
    query.stop()
    made = Written(spark.read.parquet(f"{folder}/out")).read()
    held.drop()
    delete_path(spark, folder)
    return made.select((F.col("batch") + 1).cast("int").alias("round"), "query_id", "answer", "source", F.size("contexts").cast("long").alias("n_contexts"))


def stream_cached_chat(spark, sf_dir):
    """The same with answers in the stream's state: the second time all come from there."""
    collection = _collection(spark, sf_dir)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    asked = _questions(spark, sf_dir)
    asked.coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = cached.serve_cached(stream, agent.researcher(collection), f"{folder}/out", f"{folder}/answers", f"{folder}/state")
    query.processAllAvailable()
    asked.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    query.processAllAvailable()
    query.stop()
    made = Written(spark.read.schema("query_id long, answer string, source string, contexts array<string>, batch long").parquet(f"{folder}/out")).read()
    delete_path(spark, folder)
    rounds = made.select("batch").distinct().select("batch", F.row_number().over(Window.orderBy("batch")).cast("int").alias("round"))  # a row a micro-batch
    return made.join(F.broadcast(rounds), "batch").select("round", "query_id", "answer", "source", F.size("contexts").cast("long").alias("n_contexts"))


def _streamed(arrivals: list[DataFrame], folder: str, begin: Callable[[DataFrame], DataStreamWriter]) -> Iterator[StreamingQuery]:
    """Runs of one stream, from one checkpoint: each takes an arrival as a micro-batch, whose files, as many as its tasks, are all there when it starts."""
    for arrival in arrivals:
        arrival.write.mode("append").parquet(f"{folder}/in")
        stream = arrival.sparkSession.readStream.schema(arrival.schema).parquet(f"{folder}/in")
        query = begin(stream).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        yield query


def stream_ttl(spark, sf_dir):
    """The cache with a fixed lifetime over a stream of four micro-batches, in order of time."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    requests = _requests(_table(spark, sf_dir, "events"))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = requests.agg(F.percentile_approx(at, [0.25, 0.5, 0.75], 1000)).first()[0] or [0, 0, 0]
    arrived = F.when(at <= ends[0], 0).when(at <= ends[1], 1).when(at <= ends[2], 2).otherwise(3)
    for _ in _streamed([requests.where(arrived == k) for k in range(4)], folder, lambda stream: ttl.stream_hits(stream).writeStream):
        pass
    made = Written(spark.read.schema("event_id long, hit boolean").parquet(f"{folder}/out")).read()
    delete_path(spark, folder)
    return made


def stream_progress(spark, sf_dir):
    """Rows that the micro-batches of a stream of events reported while it ran, each a quarter of the events, and what was counted of them on the way."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    requests = _requests(_table(spark, sf_dir, "events"))
    n = (requests.agg(F.max("event_id")).first()[0] or 0) + 1
    quarters = [requests.where(F.col("event_id").between(k * n // 4, (k + 1) * n // 4 - 1)) for k in range(4)]
    counted = lambda stream: stream.observe("events", F.min("event_id").alias("first"), F.max("event_id").alias("last")).writeStream
    rows = []
    with progress.watched(spark) as seen:
        for query in _streamed(quarters, folder, counted):
            seen.end(query.runId)
            rows += [(x.batch, x.n_rows, x.counted["events"]["first"], x.counted["events"]["last"]) for x in seen.batches(query.runId)]
    delete_path(spark, folder)
    return spark.createDataFrame(rows, "batch long, n_rows long, first_event long, last_event long")


def ingest_points(spark, sf_dir):
    """The ingest entry point with two whole sources, run twice: ids are the same, so the second run replaces what the first one wrote."""
    settings = config.Settings(collection=f"collection_{uuid.uuid4().hex}", dimension=64)
    sources = [ingest.source_of(f"documents={sf_dir}/documents.parquet:doc_id"), ingest.source_of(f"conversations={sf_dir}/conversations.parquet:conv_id,turn")]
    for _ in range(2):
        collection = ingest.ingest(spark, sources, settings)
    made = Written(collection.read().select("id", F.md5("payload.text").alias("text_md5"), F.size("dense").cast("long").alias("n_dense"), F.size("sparse.indices").cast("long").alias("n_sparse"))).read()
    collection.drop()
    return made


QUERIES = {
    "row_text": row_texts,
    **{
        f.__name__: f
        for f in (
            row_text_orders, row_text_nested, nonblank_docs, union_sources, source_counts, partial_sources, outside_pages, fault_isolation, line_chunks, recursive_chunks, dense_top9, dense_topk_batch, indexed_top9, index_recall, cosine_pairs,
            sparse_weights, sparse_vectors, retrieve_rerank, rerank_bm25, syllable_words, segmented_docs, prompt_build, fallback_answer, llm_parse, upsert_last_wins, upsert_batches, cache_key,
            ttl_cache, cache_route, answer_cache, session_replay, session_append, session_log, context_numbers, generator_messages, question_vectors, retrieve_passages, rag_answers,
            empty_collection, chat_answers, stream_chat, stream_cached_chat, stream_ttl, stream_progress, ingest_points,
        )
    },
}

_ROW = "concat_ws(' ', CASE WHEN conv_id <> 0 THEN conv_id::VARCHAR END, CASE WHEN turn <> 0 THEN turn::VARCHAR END, nullif(role, ''), nullif(text, ''))"
_DOC_ROW = "concat_ws(' ', CASE WHEN doc_id <> 0 THEN doc_id::VARCHAR END, nullif(text, ''))"
_SOLID = r"regexp_matches({}, '[^\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]')"
_CORPUS = f"""SELECT 0 AS source_ord, doc_id::VARCHAR AS doc_ord, md5(t) AS text_md5 FROM (SELECT doc_id, {_DOC_ROW} t FROM documents) WHERE {_SOLID.format("t")}
  UNION ALL SELECT 1, conv_id || '/' || turn, md5(t) FROM (SELECT conv_id, turn, {_ROW} t FROM (SELECT * FROM conversations ORDER BY conv_id, turn LIMIT 200)) WHERE {_SOLID.format("t")}"""
_WORDS = "SELECT {key}, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS token FROM {table}"
_WEIGHTS = f"SELECT doc_id, ('0x' || md5(token)[1:8])::BIGINT % 1024 AS bucket, count(*) AS weight FROM ({_WORDS.format(key='doc_id', table='documents')}) WHERE token <> '' GROUP BY 1, 2"
_TOP = """SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, p.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 12) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 12) DESC, p.vec_id) AS rank
  FROM embeddings q, embeddings p WHERE {}) WHERE rank <= 9"""
_JOINED = f"string_agg(text, '{config.CONTEXT_SEPARATOR}' ORDER BY turn)"

SQL = {
    "row_text": f"SELECT conv_id, turn, row_text FROM (SELECT conv_id, turn, {_ROW} AS row_text FROM conversations) WHERE {_SOLID.format('row_text')}",
    "nonblank_docs": f"SELECT doc_id, md5(text) AS text_md5 FROM (SELECT doc_id, text FROM documents UNION ALL VALUES {', '.join(f'({-1 - k}::BIGINT, {chr(39)}{x}{chr(39)})' for k, x in enumerate(_BLANKS))}) WHERE {_SOLID.format('text')}",
    "union_sources": _CORPUS,
    "source_counts": f"SELECT 'documents' AS source, count(*) AS n_rows FROM documents UNION ALL SELECT 'conversations', least(200, count(*)) FROM conversations UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'corpus', count(*) FROM ({_CORPUS})",
    "fault_isolation": f"SELECT count(*) AS n_texts FROM (SELECT {_DOC_ROW} t FROM documents) WHERE {_SOLID.format('t')}",
    "line_chunks": f"""SELECT id, md5(piece) AS text_md5 FROM (SELECT row_number() OVER (ORDER BY doc_id, k) - 1 AS id, piece FROM
  (SELECT doc_id, unnest(string_split(text, chr(10))) AS piece, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text <> '')) WHERE {_SOLID.format('piece')}""",
    "dense_top9": f"SELECT id, rank, score FROM ({_TOP.format('q.vec_id = 0')})",
    "dense_topk_batch": _TOP.format("true"),
    "indexed_top9": _TOP.format("true"),
    "index_recall": "SELECT count(*) AS n_points, count(*) AS n_questions, true AS nine_in_ten FROM embeddings",
    "cosine_pairs": "SELECT b.vec_id AS id, round(list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "sparse_weights": _WEIGHTS,
    "sparse_vectors": f"SELECT doc_id, string_agg(bucket::VARCHAR, ',' ORDER BY bucket) AS indices, string_agg(weight::VARCHAR, ',' ORDER BY bucket) AS vals FROM ({_WEIGHTS}) GROUP BY 1",
    "retrieve_rerank": chunk_sql.RERANKED,
    "rerank_bm25": chunk_sql.BM25,
    "syllable_words": chunk_sql.SYLLABLES,
    "segmented_docs": f"SELECT doc_id, md5(replace(coalesce(array_to_string(regexp_extract_all(text, '{chunk_sql.TOKEN}'), ' '), ''), '_', ' ')) AS tokens_md5, true AS joined FROM documents",
    "recursive_chunks": chunk_sql.RECURSIVE_CHUNKS,
    "question_vectors": chunk_sql.VECTORS,
    "retrieve_passages": chunk_sql.PASSAGES,
    "rag_answers": f"{chunk_sql.ANSWERS} SELECT query_id, answer, n_contexts FROM answered",
    "chat_answers": chunk_sql.CHATS,
    "stream_chat": chunk_sql.CHATS,
    "stream_cached_chat": chunk_sql.CHATS,
    "ingest_points": chunk_sql.POINTS,
    "stream_progress": """SELECT batch, count(*) AS n_rows, min(event_id) AS first_event, max(event_id) AS last_event FROM
  (SELECT event_id, k AS batch FROM events, (SELECT coalesce(max(event_id), 0) + 1 AS n FROM events), range(4) r(k) WHERE event_id >= k * n // 4 AND event_id < (k + 1) * n // 4) GROUP BY 1""",
    "empty_collection": f"SELECT item_id AS query_id, '{config.NO_DOCUMENT}' AS answer, 0::BIGINT AS n_contexts FROM benchmark",
    "row_text_orders": "SELECT o_orderkey, md5(concat_ws(' ', CASE WHEN o_orderkey <> 0 THEN o_orderkey::VARCHAR END, CASE WHEN o_custkey <> 0 THEN o_custkey::VARCHAR END, nullif(o_orderstatus, ''), CASE WHEN o_totalprice <> 0 THEN o_totalprice::VARCHAR END, o_orderdate::VARCHAR, nullif(o_orderpriority, ''))) AS text_md5 FROM orders",
    "row_text_nested": """SELECT p_partkey, concat_ws(' ', CASE WHEN p_partkey <> 0 THEN p_partkey::VARCHAR END, CASE WHEN p_retailprice <> 0 THEN p_retailprice::DECIMAL(12,2)::VARCHAR END,
  '[' || p_size || ', ' || p_partkey || ']', '{''size'': ' || p_size || ', ''brands'': [''' || p_brand || '''], ''missing'': None}',
  '{''' || p_brand || ''': ' || CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END || '}', '2024-02-29') AS row_text FROM part""",
    "partial_sources": f"""SELECT * FROM (VALUES (0, 'pages', true), (1, 'none', true), (2, 'documents', false), (3, 'conversations', false)) s(source_ord, source, failed)
  JOIN (SELECT 0 AS source_ord, count(*) AS n_rows, count(*) AS n_texts FROM pages UNION ALL SELECT 1, 0, 0 UNION ALL SELECT 2, count(*), (SELECT count(*) FROM ({_CORPUS}) WHERE source_ord = 0) FROM documents
  UNION ALL SELECT 3, least(200, count(*)), (SELECT count(*) FROM ({_CORPUS}) WHERE source_ord = 1) FROM conversations) USING (source_ord)""",
    "outside_pages": f"""WITH kept AS (SELECT page_id, concat_ws(' ', CASE WHEN page_id <> 0 THEN page_id::VARCHAR END, nullif(url, '')) AS text FROM pages WHERE page_id NOT BETWEEN 14 AND 19)
  SELECT * FROM kept WHERE trim(text) <> '' UNION ALL SELECT -1, 'pages ' || (SELECT count(*) FROM kept) || ' true' UNION ALL SELECT -2, 'conversations ' || (SELECT least(200, count(*)) FROM conversations) || ' false'""",
    "answer_cache": """SELECT query_id, CASE WHEN query_id % 2 = 0 THEN 'second ' || md5(text) END AS answer FROM (SELECT text, min(conv_id * 1000 + turn) AS query_id FROM conversations GROUP BY text)""",
    "generator_messages": f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{config.LLM_FAILED}no ' || event_id WHEN 1 THEN '{config.LLM_MISSING}' ELSE 'said ' || event_id END AS answer FROM events",
    "session_append": """WITH l AS (SELECT conv_id, max(turn) + 1 AS turn FROM conversations GROUP BY 1), a AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, turn, 'user', 'and then?' FROM l
  UNION ALL SELECT conv_id, turn + 1, 'assistant', 'nothing more' FROM l WHERE conv_id % 3 <> 0)
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS position, role, md5(text) AS text_md5 FROM a""",
    "session_log": """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS position, role, md5(text) AS text_md5 FROM
  (SELECT conv_id, turn, role, text FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn + 1, 'assistant', 'on ' || md5(text) FROM conversations WHERE role = 'user' AND conv_id % 3 <> 0)""",
    "prompt_build": f"SELECT conv_id AS query_id, md5('{config.PROMPT[0]}' || {_JOINED} || '{config.PROMPT[1]}' || conv_id || '{config.PROMPT[2]}') AS prompt_md5, count(*) AS n_contexts FROM conversations GROUP BY 1",
    "fallback_answer": f"""SELECT query_id, CASE WHEN doc_id IS NULL THEN '{config.NO_DOCUMENT}' ELSE 'answer ' || md5('{config.PROMPT[0]}' || d.text || '{config.PROMPT[1]}' || b.text || '{config.PROMPT[2]}') END AS answer,
  (doc_id IS NOT NULL)::BIGINT AS n_contexts FROM (SELECT item_id AS query_id, text FROM benchmark UNION ALL SELECT -1 - item_id, text FROM benchmark) b LEFT JOIN documents d ON d.doc_id = query_id""",
    "llm_parse": f"""SELECT event_id, kind, CASE kind WHEN 'ok' THEN 'ok ' || event_type WHEN 'absent' THEN '{config.LLM_MISSING}' WHEN 'empty' THEN ''
  WHEN 'list' THEN '{config.LLM_FAILED}''list'' object has no attribute ''get''' WHEN 'broken' THEN '{config.LLM_FAILED}Expecting property name enclosed in double quotes: line 1 column 2 (char 1)' END AS answer
  FROM events, (VALUES {", ".join(f"('{k}')" for k in _REPLIES)}) r(kind)""",
    "upsert_last_wins": """WITH h AS (SELECT c_custkey AS id, c_name AS name, round(c_acctbal, 2) AS balance FROM customer),
  a AS (SELECT *, 0 AS batch FROM h UNION ALL SELECT id, name, round(balance + 1, 2), 1 FROM h WHERE id % 3 = 0 UNION ALL SELECT id, name, round(balance + 2, 2), 2 FROM h WHERE id % 6 = 0
  UNION ALL SELECT id + 1000000, name, balance, 3 FROM h WHERE id % 300 = 0)
  SELECT id, name, balance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch DESC) AS n FROM a) WHERE n = 1""",
    "upsert_batches": "SELECT batch, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS batch FROM documents) GROUP BY 1",
    "cache_key": "SELECT conv_id, turn, md5(text) AS key FROM conversations",
    "ttl_cache": """WITH RECURSIVE e AS (SELECT event_id, ts, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
  f AS (SELECT user_id, event_type, n, event_id, ts + INTERVAL 3600 SECOND AS expires, false AS hit FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_type, e.n, e.event_id, CASE WHEN e.ts >= f.expires THEN e.ts + INTERVAL 3600 SECOND ELSE f.expires END, e.ts < f.expires
  FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.n = f.n + 1) SELECT event_id, hit FROM f""",
    "cache_route": f"""SELECT query_id, CASE WHEN hit THEN 'cached ' ELSE 'fresh ' END || md5(text) AS answer, CASE WHEN hit THEN '{config.FROM_CACHE}' ELSE '{config.FROM_AGENT}' END AS source, (NOT hit)::BIGINT AS n_contexts
  FROM (SELECT text, query_id, query_id % 3 <> 0 AND query_id % 7 <> 0 AND query_id % 5 <> 0 AS hit FROM (SELECT text, min(conv_id * 1000 + turn) AS query_id FROM conversations WHERE role = 'user' GROUP BY text))""",
    "session_replay": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS position, role, md5(text) AS text_md5 FROM conversations",
    "context_numbers": "SELECT conv_id AS query_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number, md5(text) AS context_md5 FROM conversations",
}
SQL["stream_ttl"] = SQL["ttl_cache"]
