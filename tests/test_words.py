"""Segmentation against all segmentations of short runs, and BM25 against its formula."""

import math
import random
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import segment
from tessera.operators import bm25, chunks


def _cuts(run):
    """All ways to cut a run into words."""
    for marks in product((0, 1), repeat=len(run) - 1):
        words, word = [], [run[0]]
        for mark, syllable in zip(marks, run[1:]):
            if mark:
                words.append(word)
                word = []
            word.append(syllable)
        yield [*words, word]


def _lexicon(rng):
    syllables = "ha noi viet nam thanh pho".split()
    counts = {s: rng.uniform(1, 9) for s in syllables[:-1]}
    counts |= {"_".join(rng.choices(syllables, k=k)): rng.uniform(0.2, 9) for k in (2, 2, 2, 3, 3, 4) for _ in range(4)}
    return syllables, segment.Lexicon(counts)


@pytest.mark.parametrize("seed", range(20))
def test_against_all_segmentations(seed):
    rng = random.Random(seed)
    syllables, lexicon = _lexicon(rng)
    run = rng.choices([*syllables, "new"], k=rng.randint(1, 9))
    weights = {}
    for words in _cuts(run):
        logs = [lexicon.of(w) if len(w) <= segment.SYLLABLES else None for w in words]
        if None not in logs:
            weights[tuple("_".join(w) for w in words)] = sum(logs)
    best = lexicon.segmented([x.title() for x in run])
    assert math.isclose(weights[tuple(x.lower() for x in best)], max(weights.values()), abs_tol=1e-9)
    assert " ".join(best).replace("_", " ") == " ".join(run).title()
    total, expected = sum(map(math.exp, weights.values())), {}
    for words, w in weights.items():
        for x in words:
            expected[x] = expected.get(x, 0.0) + 3 * math.exp(w) / total
    got = {}
    lexicon.expected(run, got, 3)
    assert {x: n for x, n in got.items() if n > 1e-12} == pytest.approx({x: n for x, n in expected.items() if n > 1e-12}, abs=1e-9)


@pytest.mark.parametrize("seed", range(8))
def test_many_runs_at_once(seed):
    """Runs side by side get what each gets alone."""
    rng = random.Random(seed)
    syllables, lexicon = _lexicon(rng)
    table = segment.Table(lexicon)
    held = [rng.choices([*syllables, "new", "other"], k=rng.choice([1, 2, 3, 5, 9, 30])) for _ in range(60)]
    times = [rng.randint(1, 4) for _ in held]
    expected = {}
    for run, n in zip(held, times):
        lexicon.expected(run, expected, n)
    words, n = table.laid(pa.array([x for run in held for x in run]), np.array([len(x) for x in held])).expected(np.array(times))
    got = dict(zip(words.to_pylist(), n.tolist()))
    assert len(got) == len(words) and got == pytest.approx({x: expected.get(x, 0.0) for x in got}, abs=1e-9) and set(expected) <= set(got) | {x for x in expected if expected[x] == 0}
    marks = [", ", " - ", "_", " ", "\n", "."]
    texts = [None, "", " .", *["".join(x.title() + rng.choice(marks) for x in run) for run in held]]
    assert segment.segmented_texts(texts, table) == [segment.segment(x, lexicon) for x in texts]


def test_no_syllable_is_left_out_of_the_counts(spark):
    """However many there are; learning alone takes the most frequent."""
    texts = spark.range(2001).select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda k: F.concat(F.lit("w"), F.col("id") * 100 + k)), " ").alias("text"))
    counts = segment.ngram_counts(segment.run_counts(texts))
    assert counts.count() == 200_100 > segment.MOST and counts.where("n <> 1").isEmpty()


def test_words_of_long_runs_are_all_counted(spark):
    """Wherever in a run they begin, and however long it is."""
    run = [f"s{k}" for k in range(500)]
    texts = spark.createDataFrame([(" ".join(run) + "." * k,) for k in range(3)] + [("s0",)], "text string")
    got = {r["word"]: r["n"] for r in segment.ngram_counts(segment.run_counts(texts)).collect()}
    assert got == {"_".join(run[a : a + k]): 3 + (a == 0 and k == 1) for k in range(1, 5) for a in range(501 - k)}


@pytest.mark.parametrize("seed", range(3))
def test_longer_words_are_looked_for_behind_the_most_frequent(spark, seed):
    """The same as the most frequent of all words, ties by word included."""
    rng = random.Random(seed)
    texts = spark.createDataFrame([(" ".join(rng.choices("abcdé", (9, 5, 3, 1, 1), k=rng.choice([3, 20, 200]))),) for _ in range(40)], "text string").repartition(3)
    runs = segment.run_counts(texts)
    every = sorted(segment.ngram_counts(runs, 2).collect(), key=lambda r: (-r["n"], r["word"]))
    for most in (1, 3, 7, 50, 10_000):
        first = [[(r["word"], r["n"]) for r in every if ("_" in r["word"]) == several][:most] for several in (False, True)]
        assert segment.frequent_words(runs, 2, most) == dict(first[0] + first[1])


def test_stretches_teach_what_whole_runs_teach(spark):
    """A round over stretches of runs expects what one over the runs does; a word across the 64th syllable is learned."""
    rng = random.Random(1)
    texts = spark.createDataFrame([(" ".join(rng.choice(["ha noi", "viet nam", "an", "di", "o", f"x{rng.randrange(99)}"]) for _ in range(rng.choice([4, 90]))),) for _ in range(60)], "text string")
    runs = segment.run_counts(texts)
    lexicon = segment.Lexicon(segment.frequent_words(runs, 3, 12))
    stretches = segment.stretch_counts(runs, lexicon).collect()
    assert max(len(r["run"].split(" ")) for r in stretches) < max(len(r["run"].split(" ")) for r in runs.collect())
    by_run, by_stretch = {}, {}
    for rows, into in ((runs.collect(), by_run), (stretches, by_stretch)):
        for r in rows:
            lexicon.expected(r["run"].split(" "), into, r["times"])
    assert by_run == pytest.approx(by_stretch, rel=1e-9, abs=1e-9)
    learned = segment.learn(texts, 1, 3, 12)
    total = sum(n for n in sorted(by_run.values())[-24:]) + segment.UNSEEN
    assert all(math.isclose(p, math.log(by_run[w] / total), abs_tol=1e-9) for w, p in learned.log.items()) and len(learned.log) == 24
    long = spark.createDataFrame([(" ".join([f"u{k}{j}" for j in range(63)] + ["ha", "noi"]),) for k in range(9)], "text string")
    assert "ha_noi" in segment.learn(long).log


def test_steps_follow_the_stretches():
    """However long a run is, it takes as many steps as its longest stretch of words that overlap or touch within; capitals of all kinds stay as they are."""
    table = segment.Table(segment.Lexicon({"ha_noi": 9.0, "noi_o": 4.0, "an": 1.0}))
    laid = table.laid(pa.array(["an", "ha", "noi", "o", "di"] * 1000, pa.string()), np.array([5000]))
    assert laid.most == 3 and len(laid.starts) == 3000 and laid.joined().tolist() == [False, False, True, False, False] * 1000
    assert segment.segmented_texts(["İ HA  Noi\x1cΑΣ ΣΑ", None, "\n"], table) == ["İ HA_Noi ΑΣ ΣΑ", "", ""]


def test_tokens_and_runs():
    assert segment.runs("Hà Nội, thủ-đô\n của nó a_b 3.5") == [["Hà", "Nội"], [","], ["thủ"], ["-"], ["đô", "của", "nó", "a"], ["_"], ["b", "3"], ["."], ["5"]]
    assert segment.runs(None) == segment.runs(" \n") == []
    lexicon = segment.Lexicon({"hà_nội": 9.0, "hà": 1.0, "nội": 1.0})
    assert segment.segment("Ở Hà  Nội, Hà-Nội", lexicon) == "Ở Hà_Nội , Hà - Nội" and segment.segment(None, lexicon) == ""


def test_learning_joins_what_goes_together(spark):
    """Two syllables that only come together become a word; ones that come with all others do not. Likelihood never falls."""
    rng = random.Random(4)
    say = lambda: " ".join(rng.choice(["ha noi", "viet nam", "an", "di", "o"]) for _ in range(12))
    texts = spark.createDataFrame([(say(),) for _ in range(300)] + [(None,), ("",), ("noi",)], "text string").repartition(3)
    held, found = segment.run_counts(texts).collect(), []
    for rounds in (0, 1, 2, 5):
        lexicon = segment.learn(texts, rounds)
        total = 0.0
        for r in held:
            forward = [0.0]
            run = r["run"].split(" ")
            for end in range(1, len(run) + 1):
                ways = [forward[end - k] + p for k in range(1, min(4, end) + 1) if (p := lexicon.of(run[end - k : end])) is not None]
                forward.append(max(ways) + math.log(sum(math.exp(w - max(ways)) for w in ways)))
            total += r["times"] * forward[-1]
        found.append(total)
    assert found == sorted(found)
    assert "ha_noi" in segment.segment("ha noi", lexicon) and lexicon.log["ha_noi"] > lexicon.log.get("noi", -99)
    docs = spark.createDataFrame([(1, "o ha noi. An o viet nam"), (2, None)], "doc_id long, text string")
    made = chunks.chunk_documents(docs, ["doc_id"], segment=segment.lexicon_udf(lexicon, spark)).collect()
    assert [(r["id"], r["text"].replace("_", " ")) for r in made] == [(0, "o ha noi . An o viet nam")] and "ha_noi" in made[0]["text"]


def test_bm25_against_its_formula(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "Été", "x1"]
    texts = {k: " ".join(rng.choices(words, k=rng.randint(0, 30))) for k in range(60)} | {60: None, 61: ""}
    held = bm25.TermStatistics(spark, "terms_test", parts=3)
    held.upsert(spark.createDataFrame([(k, "old words " * k) for k in range(0, 60, 2)] + [(k, t) for k, t in texts.items() if k % 2 or k >= 60], "id long, text string"))
    held.upsert(spark.createDataFrame([(k, t) for k, t in texts.items() if k % 2 == 0], "id long, text string"))
    split = {k: [x.lower() for x in (t or "").split()] for k, t in texts.items()}
    df = {w.lower(): sum(w.lower() in s for s in split.values()) for w in words}
    assert {r["token"]: r["n"] for r in held.terms.read().where("n > 0").collect()} == df
    mean = sum(map(len, split.values())) / len(split)
    assert held.totals() == (62, pytest.approx(mean))
    held.terms.upsert(spark.createDataFrame([("alpha", 999)], "token string, n long"))
    held.recount()
    assert {r["token"]: r["n"] for r in held.terms.read().collect()} == df
    questions = {1: "alpha ALPHA été nothing", 2: "", 3: None, 4: "delta x1"}
    rows = [(q, k, said, t) for q, said in questions.items() for k, t in texts.items()]
    got = {(r["query_id"], r["id"]): r["rerank_score"] for r in bm25.bm25_scores(spark.createDataFrame(rows, "query_id long, id long, query string, text string"), held).collect()}
    for q, k, said, _ in rows:
        expected = 0.0
        for w in set((said or "").lower().split()):
            f = split[k].count(w)
            if f:
                expected += math.log(1 + (62 - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(split[k]) / mean))
        assert got[q, k] == pytest.approx(expected, abs=1e-9)
    best = bm25.bm25_reranked(spark.createDataFrame(rows, "query_id long, id long, query string, text string"), held, 2).where("query_id = 2").orderBy("rank")
    assert [(r["id"], r["rank"]) for r in best.collect()] == [(0, 1), (1, 2)]
    held.drop()
