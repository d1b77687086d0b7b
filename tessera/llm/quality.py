"""Quality rules whose cutoffs are certified on labelled documents (DataFrame and SQL only).

A path tightens the rules in turn, one cutoff a step, from the mildest on; there is a path
for all rules together and one without each rule. A step's risk is the share of a
stratum's (language's) good documents that any of its rules rejects. Steps are tested in
order by the exact binomial tail P(Bin(n, alpha) <= k), for k of n good labelled documents
rejected, against delta / (strata x paths); the first failure ends a path (fixed-sequence
testing). So with probability 1 - delta no certified step of any path and stratum rejects more than
alpha of the good documents of its stratum, and whichever is chosen among them is safe: the one that
rejects most junk, less a price for good documents.

Trials are distinct texts that pass the base rules, so copies count once and the bound
is on what the method itself rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, fresh, let, ln_factorial, materialise, table

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Cutoffs of each rule, from the mildest to the strictest; a document is rejected above its cutoff.
RULES = {
    "symbols": (0.5, 0.3, 0.2, 0.1, 0.05, 0.02),
    "dup_lines": (0.9, 0.7, 0.5, 0.4, 0.3, 0.25),
    "repeats": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15),
    "exclaims": (0.8, 0.5, 0.3, 0.2, 0.1, 0.05),
}
#: Rules of each path: all, and all but one.
PATHS = (tuple(RULES), *(tuple(r for r in RULES if r != out) for out in RULES))
#: Share of a stratum's good documents that the rules together may reject; error rate over all tests; junk that a rejected good document outweighs.
ALPHA, DELTA, PRICE = 0.03, 0.05, 5.0


def _without(text: Column, characters: str) -> Column:
    for x in characters:
        text = F.replace(text, F.lit(x), F.lit(""))
    return text


def _repeated_words(words: Column) -> Column:
    """Words covered by 3-word windows that are found twice or more; windows are compared by 64-bit hashes within a text."""

    def covered(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda e, k, by: F.coalesce(F.get(s, k + by)["x"] == e["x"], F.lit(False))
            found = F.transform(s, lambda e, k: F.when(same(e, k, -1) | same(e, k, 1), e["i"]))
            return F.sort_array(F.filter(found, lambda i: i.isNotNull()))

        return F.aggregate(
            let(ordered, places),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"), (i + 3).alias("end")),
            lambda a: a["n"],
        )

    def grams(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def counted(w: Column) -> Column:
        return let(grams(w), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(covered(g)))

    return F.when(F.size(words) < 4, 0).otherwise(counted(words))


def _stratum() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("none"))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text_key and the counts of each row of ``docs`` (doc_id, text, lang); null texts count as empty."""
    text = F.coalesce("text", F.lit(""))
    has_word = lambda line: line.rlike(WORD)
    of_words = let(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w).cast("long").alias("n_repeat_words")),
    )
    of_lines = let(
        F.filter(F.split(text, "\n"), has_word),
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _stratum().alias("stratum"),
        F.xxhash64("text").alias("text_key"),
        F.length(_without(text, SPACES)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(_without(text, "!"))).cast("long").alias("n_exclaims"),
        of_words.alias("w"),
        of_lines.alias("l"),
    ).select("doc_id", "stratum", "text_key", "word_chars", "n_symbols", "n_exclaims", "w.*", "l.*")


def with_statistics(counts: DataFrame) -> DataFrame:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return counts.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "symbols": share("n_symbols", "word_chars"),
            "dup_lines": share("n_dup_lines", "n_lines"),
            "repeats": share("n_repeat_words", "n_words"),
            "exclaims": share("n_exclaims", "n_words"),
        }
    )


def binomial_tail(n: str, k: str, p: float) -> str:
    """SQL text for P(Bin(n, p) <= k), all terms summed from k downwards. From the mean on (k >= n p) the tail is not small, and 1 is returned."""
    first = (
        f"exp({ln_factorial(n)} - {ln_factorial(k)} - {ln_factorial(f'({n} - {k})')} + {k} * ln({p}D) + ({n} - {k}) * ln({1 - p}D))"
    )
    ratio = f"(s.j * {1 - p}D / (({n} - s.j + 1D) * {p}D))"
    return f"""CASE WHEN {n} = 0 OR {k} >= {n} * {p}D THEN 1D ELSE aggregate(sequence(1, int({k}) + 1),
        named_struct('sum', 0D, 'term', {first}, 'j', double({k})),
        (s, i) -> named_struct('sum', s.sum + s.term, 'term', s.term * {ratio}, 'j', s.j - 1D), s -> least(1D, s.sum)) END"""


def first_steps() -> Column:
    """For each path, the first step that rejects a document with the shares in RULES' columns; null where none does."""

    def of(path: tuple[str, ...]) -> Column:
        found = [
            F.coalesce(*[F.when(F.col(rule) > cutoff, F.lit(k * len(path) + place + 1)) for k, cutoff in enumerate(RULES[rule])])
            for place, rule in enumerate(path)
        ]
        return F.least(*found)

    return F.array(*[of(path) for path in PATHS])


def certified_steps(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA, price: float = PRICE) -> DataFrame:
    """(stratum, path, step, n, rejected, caught): the chosen step, for strata where one is certified and does more good than harm.

    ``labelled`` has stratum, text_key, quality (0 or 1) and steps (``first_steps``); rows with one stratum and text_key
    are one trial, a good one if none of them is bad.
    """
    trials = labelled.groupBy("stratum", "text_key").agg(F.min("quality").alias("quality"), F.first("steps").alias("steps"))
    good, bad = F.sum((F.col("quality") == 1).cast("long")), F.sum((F.col("quality") == 0).cast("long"))
    strata = trials.groupBy("stratum").agg(good.alias("n")).withColumn("tests", F.count("*").over(Window.partitionBy()) * len(PATHS))
    so_far = Window.partitionBy("stratum", "path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    # Steps at which no trial is newly rejected have the test of the step before them.
    tested = (
        trials.select("stratum", "quality", F.posexplode("steps").alias("path", "step"))
        .where("step IS NOT NULL")
        .groupBy("stratum", "path", "step")
        .agg(good.alias("good"), bad.alias("bad"))
        .withColumns({"rejected": F.sum("good").over(so_far), "caught": F.sum("bad").over(so_far)})
        .join(strata, "stratum")
        .withColumn("passes", F.expr(binomial_tail("n", "rejected", alpha)) <= delta / F.col("tests"))
        .withColumn("certified", F.min("passes").over(so_far))
        .withColumn("gain", F.col("caught") - price * F.col("rejected"))
    )
    chosen = F.max_by(F.struct("path", "step", "n", "rejected", "caught"), F.struct("gain", -F.col("path"), -F.col("step")))
    return tested.where("certified AND gain > 0").groupBy("stratum").agg(chosen.alias("c")).select("stratum", "c.*")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts of each document, base_failed, kept, and the path and step that were chosen for its stratum (null: none).

    Labels are one row a document: of repeated labels the smallest quality counts, null ones none. Documents
    without a language form a stratum; a stratum without a certified step rejects by the base rules alone.
    Null and empty texts have no words and fail the base rules; texts of any length are read whole. Repeated rows and
    null doc_ids are kept as they are; other columns are ignored; an empty table gives an empty result.
    """
    counts = materialise(with_statistics(features(docs)).withColumn("steps", first_steps()))
    truth = labels.filter("quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    chosen = certified_steps(counts.where("NOT base_failed").join(truth, "doc_id"))
    over = F.coalesce(F.get("steps", F.col("path")) <= F.col("step"), F.lit(False))
    return counts.join(chosen.select("stratum", "path", "step"), "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~over)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep; columns may have any names. The verdict depends on language and text alone, so it is joined by those."""
    names = {x: fresh(x) for x in ("doc_id", "text_key", "stratum")}
    verdicts = judge(docs, labels).filter("kept").select(*[F.col(k).alias(v) for k, v in names.items()])
    return docs.join(
        verdicts,
        F.col("doc_id").eqNullSafe(F.col(names["doc_id"])) & F.xxhash64("text").eqNullSafe(F.col(names["text_key"])) & _stratum().eqNullSafe(F.col(names["stratum"])),
        "left_semi",
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
