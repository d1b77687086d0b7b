"""Hard negatives against all pairs, with exact whole numbers."""

import math

import duckdb
import numpy as np
import pytest

from tessera.llm import negatives, registry

COLUMNS = "vec_id long, embedding array<float>, label int, score long, rank int, shard int, group int, mark string"


def _rows():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 8))
    rows = [(k, (centres[k % 6] + 0.3 * rng.standard_normal(8)).astype(np.float32).tolist(), int(rng.integers(0, 4))) for k in range(900)]
    rows += [(k, rows[0][1], k % 3) for k in range(1000, 1200)]  # copies: ties
    rows += [(-100, rows[5][1], 1), (-200, [0.0] * 8, 2), (2000, [0.0] * 8, 2), (2100, rows[7][1][:5], 0), (2200, [], 3), (2300, None, 1), (2400, rows[1][1], None), (None, rows[1][1], 1)]
    rows += [(2500, [float("nan")] + [1.0] * 7, 1), (2600, [float("inf")] + [1.0] * 7, 1), (2700, [None] + [1.0] * 7, 1), (100, rows[100][1], rows[100][2]), (300, rows[9][1], 99), (17, rows[17][1], rows[17][2])]
    rows += [(2800, [-x for x in rows[0][1]], 50), (2801, rows[3][1], 50)]  # the one positive scores below 0
    return rows


def _brute(rows, every=100, n_positives=5, n_negatives=5, least=80):
    held = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        one = (label, v)
        held[i] = min(held.get(i, one), one)
    whole = {i: [math.floor(256 * x) for x in v] for i, (_, v) in held.items()}
    out = []
    for a in held:
        if a % every == 0:
            score = {i: sum(x * y for x, y in zip(whole[a], whole[i])) for i in held if i != a}
            order = sorted(score, key=lambda i: (-score[i], i))
            for p in [i for i in order if held[i][0] == held[a][0]][:n_positives]:
                fits = [i for i in order if held[i][0] != held[a][0] and least * score[p] <= 100 * score[i] <= 100 * score[p]]
                out += [(a, p, n, i, score[p], score[i]) for n, i in enumerate(fits[:n_negatives], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("negatives"))
    spark.createDataFrame([(*r, 1, 2, 3, 4, "x") for r in _rows()], COLUMNS).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path


def test_query_against_brute_force(spark, folder):
    got = registry.QUERIES["op13_negatives"](spark, folder)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = _brute(_rows())
    assert sorted(map(tuple, got.collect())) == expected and len(expected) > 100


@pytest.mark.parametrize(("chunk", "leaf", "at_once", "shard_bytes", "anchor_bytes"), [(50, 4, 3, 8000, 300), (333, 1, 1000, 20000, 100), (16_384, 2000, 1, 1 << 30, 1 << 30)])
def test_blocks_and_shards_do_not_change_results(spark, folder, monkeypatch, chunk, leaf, at_once, shard_bytes, anchor_bytes):
    monkeypatch.setattr(negatives, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", anchor_bytes)
    monkeypatch.setattr(negatives.ball_tree, "__defaults__", (leaf,))
    monkeypatch.setattr(negatives, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(negatives, "AT_ONCE", at_once)
    rows = _rows()
    assert sorted(map(tuple, registry.QUERIES["op13_negatives"](spark, folder).collect())) == _brute(rows)


def test_empty(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], COLUMNS)).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<float>, label int")).collect() == []


def _miner(x, labels, n_anchors, low, high, same, k=5):
    ids = np.arange(len(x)) * 3
    miner = negatives.Miner(ids[:n_anchors], x[:n_anchors], labels[:n_anchors], low, high, same, k)
    for at in range(0, len(x), 1000):
        miner.search(ids[at : at + 1000], x[at : at + 1000], labels[at : at + 1000])
    return miner


@pytest.mark.parametrize("size", [100, 10**6, 10**8])
@pytest.mark.parametrize("same", [True, False])
def test_windows_against_all_scores(size, same):
    """Whole numbers small enough for doubles and beyond; narrow windows, empty ones, ties."""
    rng = np.random.default_rng(size)
    x = rng.integers(-size, size, (3000, 6))
    x[2000:2500] = x[:500]
    labels = rng.integers(0, 3, 3000)
    exact = x[:40].astype(object) @ x.T.astype(object)
    low = np.stack([np.full(40, negatives.NONE + 1), np.quantile(exact.astype(float), 0.4, axis=1).astype(np.int64), np.ones(40, np.int64)], 1)
    high = np.stack([np.full(40, (1 << 63) - 1), np.quantile(exact.astype(float), 0.6, axis=1).astype(np.int64), np.zeros(40, np.int64)], 1)
    miner = _miner(x, labels, 40, low, high, same)
    got = {}
    for a, w, i, s in zip(*miner.results()):
        got.setdefault((a, w), []).append((int(s), int(i)))
    for a in range(40):
        for w in range(3):
            fits = sorted(((int(exact[a, i]), 3 * i) for i in range(3000) if i != a and (labels[i] == labels[a]) == same and low[a, w] <= exact[a, i] <= high[a, w]), key=lambda y: (-y[0], y[1]))[:5]
            assert got.get((a, w), []) == fits


def test_trees_prune():
    """Clustered rows: of all pairs only a small part is scored, in an open window and in a narrow one beneath the best."""
    rng = np.random.default_rng(1)
    x = np.floor(256 * (rng.standard_normal((50, 32))[rng.integers(0, 50, 20_000)] + 0.05 * rng.standard_normal((20_000, 32)))).astype(np.int64)
    labels, shares = np.zeros(20_000, np.int64), []
    best = (x[:50].astype(float) @ x.T.astype(float)).max(1).astype(np.int64)
    for low, high in ((np.full((50, 1), negatives.NONE + 1), np.full((50, 1), (1 << 63) - 1)), ((0.4 * best).astype(np.int64)[:, None], (0.41 * best).astype(np.int64)[:, None])):
        ids = np.arange(20_000)
        miner = negatives.Miner(ids[:50], x[:50], labels[:50], low, high, True, 5)
        miner.search(ids, x, labels)
        shares.append(miner.scored / miner.met)
    print("shares scored", shares)
    assert max(shares) < 0.2


def test_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS FROM '/root/testdata/sf0.001/embeddings.parquet'")
    expected = con.execute(registry.SQL["op13_negatives"])
    columns = [c[0] for c in expected.description]
    got = registry.QUERIES["op13_negatives"](spark, "/root/testdata/sf0.001").select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(expected.fetchall())
