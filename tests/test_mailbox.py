"""The endpoint between a service's requests and responses, and what is left when it dies at several points."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tessera.streaming import cached, mailbox


class Service:
    """``fail`` names what breaks: 'before' a commit, or 'after' it, when its reply is lost."""

    def __init__(self):
        self.asked, self.staged, self.shown, self.done, self.fail, self.lock = [], {}, {}, 0, None, threading.Lock()
        service = self

        class Handler(BaseHTTPRequestHandler):
            def reply(self, body=None, status=200):
                body = b"" if body is None else json.dumps(body).encode()
                self.send_response(status)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def do_GET(self):
                at = urlparse(self.path)
                if at.path == "/latest":
                    return self.reply({"next": len(service.asked)})
                low, high = (int(parse_qs(at.query)[k][0]) for k in ("from", "to"))
                self.reply([{"query_id": k, "query": service.asked[k]} for k in range(low, min(high, len(service.asked)))])

            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                with service.lock:
                    self.reply(status=service.post(self.path, body))

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"

    def post(self, path, body):
        if path.startswith("/staged/"):
            self.staged.setdefault(path.removeprefix("/staged/"), []).extend(body)
        elif path == "/done":
            self.done = body["to"]
        elif path == "/aborts":
            for token in body["staged"]:
                self.staged.pop(token, None)
        elif path == "/commits":
            fail, self.fail = self.fail, None
            if fail == "before":
                return 500
            rows = [x for token in body["staged"] for x in self.staged.pop(token, [])]
            self.shown.setdefault((body["stream"], body["batch"]), rows)
            return 500 if fail == "after" else 200
        return 200

    def said(self):
        return sorted((x["query_id"], x["answer"], x["source"]) for rows in self.shown.values() for x in rows)


@pytest.fixture
def service():
    held = Service()
    yield held
    held.server.shutdown()


def _agent(mark):
    return lambda questions: questions.select("query_id", "query", F.concat(F.lit(mark), "query").alias("answer"), F.array("query").alias("contexts"))


def _start(spark, service, folder, mark):
    requests = mailbox.requests_from(spark, service.url, each=2)
    return cached.serve_cached(requests, _agent(mark), mailbox.responses_to(service.url, "s", each=2), f"{folder}/answers", f"{folder}/state")


@pytest.mark.parametrize("point", ["before", "after"])
def test_responses_are_neither_lost_nor_repeated(spark, tmp_path, service, point):
    service.asked += ["a", "b", "a", "c", "d"]
    query = _start(spark, service, tmp_path, "first ")
    query.processAllAvailable()
    assert [x[:2] for x in service.said()] == [(k, f"first {q}") for k, q in enumerate("abacd")]
    service.fail = point
    service.asked += ["e", "b", "f"]
    with pytest.raises(Exception, match="500"):
        query.processAllAvailable()
    assert len(service.said()) == (5 if point == "before" else 8)
    query = _start(spark, service, tmp_path, "second ")
    query.processAllAvailable()
    service.asked += ["b"]
    query.processAllAvailable()
    query.stop()
    again = "second " if point == "before" else "first "  # what was shown stays
    assert service.said()[5:] == [(5, f"{again}e", "Research Agent"), (6, "first b", "Redis Memory"), (7, f"{again}f", "Research Agent"), (8, "first b", "Redis Memory")]
    assert max(Counter(x[0] for x in service.said()).values()) == 1 and service.done >= 8


def test_partitions_cover_the_range():
    reader = mailbox.RequestReader("http://none", 3)
    assert [p.value for p in reader.partitions({"next": 2}, {"next": 9})] == [(2, 5), (5, 8), (8, 9)]
    assert reader.partitions({"next": 4}, {"next": 4}) == []


def test_a_table_is_sent_whole(spark, service):
    rows = spark.range(0, 23, 1, 5).select(F.col("id").alias("query_id"), F.lit("x").alias("answer"), F.lit("s").alias("source"), F.array(F.lit(None).cast("string")).alias("contexts"))
    mailbox.responses_to(service.url, "t", each=2)(rows, 7)
    mailbox.responses_to(service.url, "t", each=2)(rows.where("query_id < 3"), 7)  # run again
    assert sorted(x["query_id"] for x in service.shown["t", 7]) == list(range(23)) and service.shown["t", 7][0]["contexts"] == [None]
    mailbox.responses_to(service.url, "t")(rows.where("query_id < 0"), 8)
    assert service.shown["t", 8] == []
