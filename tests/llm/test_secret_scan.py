"""Secret scans against brute force: every window's entropy counted anew, and the patterns in either case."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessera.llm import registry, secret_scan

RNG = random.Random(11)


def _token(n, letters="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
    return "".join(RNG.choices(letters, k=n))


def _texts():
    say = lambda n: " ".join(RNG.choices(["alpha", "key", "token:", "der", "é", "中文", "src/main/word_list", "x=1", "AKIA", "AKIA12", "deadbeef", "ſecret", "toKen"], k=n))
    out = [None, "", " ", say(40), 'Token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', "toKen: abcdefghijkl", "password=short", "passwd== 'x", "api_key:apikey=0123456789ab"]
    out += [f"é {_token(40)} 中文 {_token(24)}.{_token(60)}\n{_token(23)}", _token(30, "0123456789ABCDEF") + " " + _token(30, "0123456789"), "AKIA" + "Z" * 13 + " AKIA" + "Z" * 14]
    out += ["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "sha256-" + _token(44), "sha256: " + _token(44), "123e4567-e89b-12d3-a456-426614174000", f"EXAMPLE{_token(30)}"]
    out += ["/usr/local/share/python/SomeCamelCaseName/config_values_2024", "x" * 300 + _token(50) + "y" * 300, "aB3" * 400, _token(3000), f"secret:{_token(2000)} " * 3, f"key {_token(30)}" * 50]
    out += ["token=" + "0123456789abcdef" * 3, "Α" * 100 + _token(32) + "ß", "Key api_Key=abcdefghijklmnop", " ".join(_token(RNG.randint(16, 60), "ABCDEF0123456789abcdefGHxyz/_-") for _ in range(300))]
    return out


TEXTS = _texts()


def _entropy(window):
    return math.log2(len(window)) - sum(round(n * math.log2(n) * 2**20) for n in Counter(window).values()) / 2**20 / len(window)


def _brute(text):
    text = text or ""
    either = lambda x: "".join(f"[{c}{c.upper()}]" if c.islower() else c for c in x)
    pattern = either("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    base = [(m.start(), 0, m.end()) for m in re.finditer(pattern, text) if len(m[2]) >= 12]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    added, allowed = [], secret_scan.AllowList()
    for k, kind in enumerate(secret_scan.CLASSES):
        at = 0
        while at < len(text):
            end = at
            while end < len(text) and text[end] in kind.characters:
                end += 1
            marked = set()
            for i in range(at, end - kind.window + 1):
                if math.floor(kind.window * (math.log2(kind.window) - kind.bits) * 2**20) >= sum(round(n * math.log2(n) * 2**20) for n in Counter(text[i : i + kind.window]).values()):
                    marked.add(i)
            spans = []
            for i in sorted(marked):
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + kind.window
                else:
                    spans.append([i, i + kind.window])
            added += [(a, 3 + k, b) for a, b in spans if not allowed.knows(text, a, b)]
            at = end + 1
    spans = list(base)
    for a, k, b in sorted(added):
        if not any(x <= a and b <= y for x, _, y in spans):
            spans.append((a, k, b))
    return sorted(base), sorted(spans)


def _row(doc_id, text):
    base, spans = _brute(text)
    said = lambda x: ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in x)
    return (doc_id, *[sum(k == n for _, k, _ in base) for n in range(3)], hashlib.sha256(said(base).encode()).hexdigest(), said(spans))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(k, t, "x", 1, None) for k, t in enumerate(TEXTS)] + [(3, TEXTS[9], "x", 1, None), (3, TEXTS[9], "x", 1, None), (None, TEXTS[10], None, None, None)]
    path = str(tmp_path_factory.mktemp("secrets"))
    spark.createDataFrame(rows, "doc_id long, text string, spans string, start int, kind string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path, [r[:2] for r in rows]


def test_query_against_brute_force(spark, folder):
    got = registry.QUERIES["op11_secrets"](spark, folder[0])
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    key = lambda r: [str(x) for x in r]
    expected = sorted((_row(*r) for r in folder[1]), key=key)
    assert sorted((tuple(r) for r in got.collect()), key=key) == expected
    assert sum("base64" in r[-1] for r in expected) > 5 and any("base16" in r[-1] for r in expected)


@pytest.mark.parametrize("blocks", [1, 100, 5000])
def test_blocks_do_not_change_spans(monkeypatch, blocks):
    """The same spans, whatever texts are scanned together."""
    encoded = [(t or "").encode() for t in TEXTS]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in encoded])])
    data, allowed, out = np.frombuffer(b"".join(encoded), np.uint8), secret_scan.AllowList(), []
    for at in range(0, len(TEXTS), blocks):
        to = min(at + blocks, len(TEXTS))
        out += secret_scan.scan_texts([t or "" for t in TEXTS[at:to]], data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], allowed)
    assert out == [_brute(t)[1] for t in TEXTS]


def test_allow_list():
    knows = secret_scan.AllowList().knows
    for text in ("src/knowledge/SomeLongClassName_with_words", "123e4567-e89b-12d3-a456-426614174000", "abcdefghijklmnopqrstuvwxyz012345", "12345678901234567890123456", "Ab9EXAMPLEkey00x"):
        assert knows(text, 0, len(text))
    assert knows("sha512-q1W2e3R4t5Y6u7I8o9P0aZsX", 7, 31) and not knows("sha512 of it: q1W2e3R4t5Y6u7I8o9P0aZsX", 14, 38)
    assert not secret_scan.AllowList((), (), ()).knows("config_values_for_the_host_name", 0, 31)


def test_masked(spark):
    token = base64.b64encode(hashlib.sha512(b"x").digest()).decode()[:60]
    docs = spark.createDataFrame([(1, f"é token={'ab12' * 4} and {token}.", 5), (2, None, 6), (None, "plain", 7), (2, "", 8)], "doc_id long, text string, spans int")
    assert sorted(map(str, secret_scan.masked(docs).collect())) == sorted(map(str, spark.createDataFrame([(1, "é <ASSIGN> and <BASE64>.", 5), (2, None, 6), (None, "plain", 7), (2, "", 8)], docs.schema).collect()))


@pytest.mark.parametrize("where", ["odd", "/root/testdata/sf0.001"])
def test_sql(spark, folder, where):
    path = folder[0] if where == "odd" else where
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{path}/documents.parquet{'/*.parquet' if where == 'odd' else ''}'")
    expected = con.execute(registry.SQL["op11_secrets"])
    columns = [c[0] for c in expected.description]
    got = registry.QUERIES["op11_secrets"](spark, path).select(*columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected.fetchall()))


def test_long_candidates_take_time_in_proportion():
    import time

    seconds = []
    for n in (200_000, 800_000):
        text = _token(n)
        began = time.perf_counter()
        secret_scan.scan_texts([text], np.frombuffer(text.encode(), np.uint8), np.array([0, n]), secret_scan.AllowList())
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 12 * seconds[0]
