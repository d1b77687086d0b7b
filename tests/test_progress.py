"""Progress of streams, and weights that travel with the job."""

import json
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import models
from tessera.streaming.progress import Progress, watched


def _stream(spark, folder, name=None):
    stream = spark.readStream.schema("n long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stream = stream.observe("sums", F.sum("n").alias("total"), F.count(F.when(F.col("n") % 2 == 1, 1)).alias("odd"))
    checked = stream.select(F.when(F.col("n") < 1000, F.col("n")).otherwise(F.raise_error(F.lit("too large"))).alias("n"))
    return checked.writeStream.queryName(name or "plain").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").start()


def _arrive(spark, folder, first, end):
    spark.range(first, end, 1, 1).withColumnRenamed("id", "n").write.mode("append").parquet(f"{folder}/in")


def test_micro_batches_are_reported_with_what_is_counted(spark, tmp_path):
    _arrive(spark, tmp_path, 0, 10)
    with watched(spark) as seen:
        query = _stream(spark, tmp_path, "counted")
        query.processAllAvailable()
        _arrive(spark, tmp_path, 10, 15)
        query.processAllAvailable()
        query.processAllAvailable()  # nothing new: no micro-batch
        query.stop()
        assert seen.end(query.runId) is None
    got = [(x.stream, x.batch, x.n_rows, x.counted) for x in seen.batches(query.runId)]
    assert got == [("counted", 0, 10, {"sums": {"total": 45, "odd": 5}}), ("counted", 1, 5, {"sums": {"total": 60, "odd": 2}})]
    assert seen.n_rows(query.runId) == 15 and all(x.milliseconds >= 0 for x in seen.batches(query.runId))


def test_a_failure_is_reported_and_the_next_run_is_one_of_its_own(spark, tmp_path):
    _arrive(spark, tmp_path, 0, 3)
    with watched(spark) as seen:
        query = _stream(spark, tmp_path)
        query.processAllAvailable()
        _arrive(spark, tmp_path, 1000, 1001)
        with pytest.raises(Exception, match="too large"):
            query.processAllAvailable()
        assert "too large" in seen.end(query.runId)
        assert seen.n_rows(query.runId) == 3
        again = _stream(spark, tmp_path)
        with pytest.raises(Exception, match="too large"):
            again.processAllAvailable()
        assert "too large" in seen.end(again.runId) and seen.n_rows(again.runId) == 0
    assert again.runId != query.runId


def test_only_streams_within_the_block_and_the_last_batches_are_kept(spark, tmp_path):
    for k in range(3):
        _arrive(spark, tmp_path, 10 * k, 10 * k + 10)
    with watched(spark, keep=2) as seen:
        query = _stream(spark, tmp_path)
        query.processAllAvailable()
        query.stop()
        seen.end(query.runId)
    assert [x.batch for x in seen.batches(query.runId)] == [1, 2] and seen.n_rows(query.runId) == 30
    _arrive(spark, tmp_path, 30, 40)
    later = _stream(spark, tmp_path)
    later.processAllAvailable()
    later.stop()
    assert seen.batches(later.runId) == []
    with pytest.raises(TimeoutError):
        Progress().end(later.runId, patience=0.1)


def test_weights_travel_with_the_job(spark, tmp_path):
    """The folder of weights is gone from the driver's path when the tasks run."""
    folder = tmp_path / "weights-of-a-test"
    folder.mkdir()
    np.save(folder / "w.npy", np.arange(4.0))
    (folder / "deep").mkdir()
    (folder / "deep" / "names.json").write_text(json.dumps(["a", "b", "c", "d"]))

    def make(place):
        import json

        import numpy as np

        w, names = np.load(f"{place}/w.npy"), json.load(open(f"{place}/deep/names.json"))
        return lambda texts: [([float(x) for x in w if str(int(x)) in t], {k: 1.0 for k, n in enumerate(names) if n in t}) for t in texts]

    load = models.shipped(spark, str(folder), make)
    shutil.rmtree(folder)
    embed = models.embed_udf(load=load)
    got = spark.createDataFrame([(0, "1 3 a"), (1, "d"), (2, "")], "k int, text string").repartition(3).select("k", embed("text").alias("e")).collect()
    assert {r["k"]: (r["e"]["dense"], r["e"]["sparse"]) for r in got} == {0: ([1.0, 3.0], {0: 1.0}), 1: ([], {3: 1.0}), 2: ([], {})}


def test_a_file_of_weights_is_the_one_that_was_shipped(spark, tmp_path):
    file = tmp_path / "weight.txt"
    loads = []
    for said in ("0.25", "0.5"):
        file.write_text(said)
        loads.append(models.shipped(spark, str(file), lambda place: (lambda x: lambda query, text: x)(float(open(place).read()))))
    file.unlink()
    rerank = [models.rerank_udf(load=load) for load in loads]
    got = spark.range(4).select(*[f(F.lit("q"), F.lit("t")).alias(f"r{k}") for k, f in enumerate(rerank)]).collect()
    assert {(r["r0"], r["r1"]) for r in got} == {(0.25, 0.5)}
