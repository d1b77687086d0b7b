import gzip
import json

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.sources import loader
from tessera.sources.outside import batches, json_lines, outside_rows
from tessera.staging import owner

SCHEMA = "k long, text string, more array<int>"


def _numbers():
    """Within a function, so that it travels by its code: workers do not have this module."""

    def rows(piece, columns):
        start, many, fails = piece
        for k in range(start, start + many):
            if k == fails:
                raise OSError(f"gone at {k}")
            yield {"k": k, "text": f"t{k}", "more": [k], "unasked": object()}

    return rows


numbers = _numbers()


def test_pieces_are_partitions_and_fail_alone(spark):
    df = outside_rows(spark, [(0, 5, None), (5, 5, 7), (10, 0, None), (20, 3, 20), (30, 2, None)], numbers, SCHEMA, batch=2)
    assert df.rdd.getNumPartitions() == 5
    rows = df.orderBy("piece", "n").collect()
    assert [(r["piece"], r["n"], r["row"]["k"]) for r in rows if r["failure"] is None] == [(0, n, n) for n in range(5)] + [(1, 0, 5), (1, 1, 6), (4, 0, 30), (4, 1, 31)]
    assert [(r["piece"], r["n"], r["row"], r["failure"]) for r in rows if r["failure"]] == [(1, 2, None, "OSError: gone at 7"), (3, 0, None, "OSError: gone at 20")]


def test_columns_and_head_reach_the_reader(spark):
    def asked(piece, columns):
        k = 0
        while True:  # without a head it would not end
            yield {"k": k, "text": ",".join(columns), "more": None}
            k += 1

    df = outside_rows(spark, ["a", "b"], asked, SCHEMA, ["text"], head=3)
    assert df.schema["row"].dataType.names == ["text"]
    assert [(r["piece"], r["n"], r["row"]["text"]) for r in df.orderBy("piece", "n").collect()] == [(p, n, "text") for p in (0, 1) for n in range(3)]


def test_more_pieces_than_tasks(spark, monkeypatch):
    monkeypatch.setattr("tessera.sources.outside.MOST_TASKS", 3)
    df = outside_rows(spark, [(10 * k, 2, 10 * k if k == 3 else None) for k in range(8)], numbers, SCHEMA)
    assert df.rdd.getNumPartitions() == 3
    assert sorted(r["row"]["k"] for r in df.where("failure IS NULL").collect()) == [10 * k + j for k in range(8) if k != 3 for j in range(2)]


def test_a_value_of_another_type_fails_at_its_row(spark):
    layout = to_arrow_schema(outside_rows(spark, [None], numbers, SCHEMA).schema)

    def rows(piece, columns):
        yield from ({"k": k, "text": "x"} for k in (1, 2, "three", 4))

    got = pa.Table.from_batches(batches(0, None, rows, layout, None, 100)).to_pylist()
    assert [x["row"] and x["row"]["k"] for x in got] == [1, 2, None] and got[2]["failure"] and got[2]["n"] == 2


@pytest.mark.parametrize(("head", "kept", "reads"), [(None, 12, 4), (0, 0, 0), (2, 2, 1), (5, 5, 3), (12, 12, 4), (50, 12, 4)])
def test_a_head_reads_no_more_pieces_than_it_needs(spark, tmp_path, head, kept, reads):
    folder = str(tmp_path)

    def rows(piece, columns):
        from pathlib import Path

        Path(folder, str(piece)).touch()
        yield from ({"k": 10 * piece + j, "text": "", "more": []} for j in (2, 1, 0))

    with owner():
        texts, report = loader.load_report(spark, [loader.row_source("s", [0, 1, 2, 3], rows, SCHEMA, ["k"], head)])
        every = [10 * p + j for p in range(4) for j in (2, 1, 0)][:kept]  # in the order of the pieces
        assert [int(r["text"]) for r in texts.orderBy("source_ord", "doc_ord").collect()] == [k for k in every if k]
        assert [(r["n_rows"], r["failed"]) for r in report.collect()] == [(kept, False)]
    assert len(list(tmp_path.iterdir())) == reads


def test_counts_of_empty_sources(spark):
    none = spark.createDataFrame([], "k long, text string")
    sources = [loader.Source("none", lambda s: none, ("k",)), loader.Source("head", lambda s: none.where("k > 1"), ("k",), 5), loader.row_source("no pieces", [], numbers, SCHEMA)]
    with owner():
        texts, report = loader.load_report(spark, sources)
        assert texts.isEmpty()
        assert [tuple(r) for r in report.orderBy("source_ord").collect()] == [(0, "none", 0, 0, False), (1, "head", 0, 0, False), (2, "no pieces", 0, 0, False)]


def test_lines_of_files(spark, tmp_path):
    def lines(keys):
        return "".join(json.dumps({"k": k, "text": f"é{k}", "more": [k, None], "other": 1}) + "\n" for k in keys).encode()

    plain, packed, cut, none = tmp_path / "a.jsonl", tmp_path / "b.jsonl.gz", tmp_path / "c.jsonl.gz", tmp_path / "none"
    plain.write_bytes(b"\n" + lines([0, 1]).rstrip())
    packed.write_bytes(gzip.compress(lines([2, 3])))
    whole = gzip.compress(lines(range(50_000)))
    cut.write_bytes(whole[: len(whole) // 2])
    df = outside_rows(spark, [str(plain), packed.as_uri(), str(cut), str(none)], json_lines, SCHEMA)
    rows = df.where("piece <> 2 AND failure IS NULL").orderBy("piece", "n").collect()
    assert [(r["row"]["k"], r["row"]["text"], r["row"]["more"]) for r in rows] == [(k, f"é{k}", [k, None]) for k in range(4)]
    part = [r["row"]["k"] for r in df.where("piece = 2 AND failure IS NULL").orderBy("n").collect()]
    assert 0 < len(part) < 50_000 and part == list(range(len(part)))
    assert [r["piece"] for r in df.where("failure IS NOT NULL").orderBy("piece").collect()] == [2, 3]


def test_many_small_pieces_share_tasks(spark):
    df = outside_rows(spark, list(range(600)), lambda piece, columns: iter([{"a": piece}]), "a long")
    assert df.rdd.getNumPartitions() <= max(10, 4 * spark.sparkContext.defaultParallelism)
    assert sorted((r["piece"], r["n"], r["row"]["a"]) for r in df.collect()) == [(k, 0, k) for k in range(600)]
