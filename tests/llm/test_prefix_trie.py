"""The trie of rebuilt conversations against a brute-force one, which keeps every prefix as it is."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from tessera.llm import prefix_trie, registry

COLUMNS = "conv_id long, turn long, role string, text string, depth int, owner string, digest long, place long, is_end int"


def _rows():
    rng = random.Random(5)
    says = ["", "hello", "hello there", "é 中文", "ab", "yes", None]
    rows = [(c, k, rng.choice(["user", "assistant", None, ""]), rng.choice(says)) for c in range(-30, 120) if c % 7 for k in range(rng.randint(0, 12))]
    rows += [(c, k, "user", f"same {k}") for c in range(200, 260) for k in range(20)]  # copies, in all but the least of each five other heads
    rows += [(1000, k, "user", f"long {k % 3}") for k in range(700)] + [(c, 3, "user", "alone") for c in (1003, 2001, 2007, 2009, 3_000_000_000)]
    rows += [(5000 + 5 * c, 0, "user", f"turn {k}") for c in range(30) for k in range(3)]  # equal turn numbers
    rows += [(7000, None, "user", "null turn"), (7000, 0, "user", "then"), (7000, 0, "user", "then"), (None, 1, "user", "nobody"), (None, None, None, None), (7005, 1, "r" * 10, "x"), (7010, 1, "r" * 9, "rx")]
    return rows


def _brute(rows):
    own = defaultdict(list)
    for c, k, role, text in rows:
        if c is not None:
            own[c].append((k is not None, k or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    rebuilt = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        lead = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = turns.get(lead, [])[:h] + mine[h:]
    members, children = defaultdict(list), defaultdict(set)
    for c, mine in rebuilt.items():
        for d in range(len(mine) + 1):
            members[tuple(mine[:d])].append(c)
            if d:
                children[tuple(mine[: d - 1])].add(tuple(mine[:d]))
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def _sorted(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("trie"))
    rows = _rows()
    random.Random(1).shuffle(rows)
    spark.createDataFrame([(*r, *[None] * 5) for r in rows], COLUMNS).repartition(3).write.parquet(f"{path}/conversations.parquet")
    return path


def test_query_against_brute_force(spark, folder):
    got = registry.QUERIES["op12_prefix_trie"](spark, folder)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert _sorted(got.collect()) == _sorted(_brute(_rows()))


@pytest.mark.parametrize(("heavy", "bits"), [(1, 1), (50, 3), (10**9, 12)])
def test_joins_and_ranges_do_not_change_the_trie(spark, folder, monkeypatch, heavy, bits):
    monkeypatch.setattr(prefix_trie, "HEAVY", heavy)
    monkeypatch.setattr(prefix_trie, "ID_BITS", bits)
    assert _sorted(registry.QUERIES["op12_prefix_trie"](spark, folder).collect()) == _sorted(_brute(_rows()))


def test_empty_and_turnless(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert prefix_trie.trie(none).collect() == []
    for rows in ([(7, 1, "a", "b")], [(7, 1, "a", "b"), (5, 1, "a", "b")], [(3, None, None, None)]):
        got = prefix_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).drop("digest")
        assert _sorted(got.collect()) == _sorted(_brute(rows))


def test_turns_meet_whatever_is_coalesced(spark):
    """Without broadcast joins all parts of a conversation come from exchanges by its id, each of which is coalesced by itself."""
    rows = [(7, 1, "a", "b"), (5, 1, "a", "b"), *[(c, k, "user", f"turn {k}") for c in range(20, 40) for k in range(12)]]
    said = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in said}
    try:
        for k, v in said.items():
            spark.conf.set(k, v)
        got = prefix_trie.prefixes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        assert got.where("depth = 0").count() == len({r[0] for r in rows})
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_two_long_copies_are_no_square(spark):
    """A node for each depth, and rows in proportion to them on the way."""
    rows = [(c, k, "user", "again") for c in (5, 10) for k in range(6000)]
    got = prefix_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    top = got.where("depth = 0").first()
    assert got.count() == 6001 and (top["n_convs"], top["n_leaves"], top["saved_tokens"]) == (2, 1, 6000 * 5)


@pytest.mark.parametrize("where", ["odd", "/root/testdata/sf0.001"])
def test_sql(spark, folder, where):
    path = folder if where == "odd" else where
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT conv_id, turn, role, text FROM '{path}/conversations.parquet{'/*.parquet' if where == 'odd' else ''}'{' WHERE conv_id IS DISTINCT FROM 1000' if where == 'odd' else ''}")
    expected = con.execute(registry.SQL["op12_prefix_trie"])
    columns = [c[0] for c in expected.description]
    turns = spark.read.parquet(f"{path}/conversations.parquet").where("conv_id IS NULL OR conv_id <> 1000" if where == "odd" else "true")
    assert _sorted(prefix_trie.trie(turns).select(*columns).collect()) == _sorted(expected.fetchall())
