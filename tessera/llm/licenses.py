"""License scans by MinHash bands over overlapping text windows (DataFrame and SQL only).

A text's 5-word shingles are hashed. Windows of WINDOW neighbouring shingles (8 words), STRIDE apart (so that
they overlap by 4 words), have a MinHash for each of BANDS x ROWS hash functions; a window whose ROWS of a band all
agree with those of a template's window (templates have one at every place) is a candidate. Windows of
similarity J meet with probability 1 - (1 - J^ROWS)^BANDS, equal windows always. And a copy
that holds 0.8 of the shingles of a template of 8 shingles or more always has an equal window: a changed,
added or lost word in the middle costs 4 shingles at least, so n shingles have at most n / 20
such places, and 7 shingles in a row are left somewhere, which hold a whole window. Shorter notices are looked up by windows of one shingle, where 0.8 leaves at least one.

Candidates are then verified: a license is reported where at least 0.8 of a template's distinct
shingles are found, by their words, in the stretch of text where the template would lie.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import let, materialise, table
from tessera.llm.license_texts import TEMPLATES

SHINGLE, CONTAINMENT = 5, 0.8
WINDOW, STRIDE, BANDS, ROWS = 4, 4, 2, 2
#: Templates of fewer shingles are notices, which are looked up shingle by shingle.
LONG = 8
#: Words of the lower-cased text: runs of ASCII letters and digits and of non-ASCII characters.
TOKEN = r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _shingles(words: Column, of) -> Column:
    """``of`` applied to each run of SHINGLE words; none for fewer words."""
    each = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: of([F.get(words, i + k) for k in range(SHINGLE)]))
    return F.when(F.size(words) >= SHINGLE, each).otherwise(F.array().cast("array<bigint>") if of is _hashed else F.array().cast("array<string>"))


def _hashed(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def _joined(words: list[Column]) -> Column:
    return F.concat_ws(" ", *words)


def _band_windows(hashes: Column, stride: int) -> Column:
    """(at, keys) of each window of WINDOW shingles; a key for each band."""

    def over(rows: Column) -> Column:
        def key(i: Column, band: int) -> Column:
            return F.xxhash64(*[F.array_min(F.slice(rows[f"r{band * ROWS + k}"], i + 1, WINDOW)) for k in range(ROWS)])

        windows = F.sequence(F.lit(0), F.size(hashes) - WINDOW, F.lit(stride))
        return F.transform(windows, lambda i: F.struct(i.alias("at"), F.array(*[key(i, b) for b in range(BANDS)]).alias("keys")))

    def permuted(k: int) -> Column:
        return F.transform(hashes, lambda h: F.xxhash64(h, F.lit(k)))

    rows = F.struct(*[permuted(k).alias(f"r{k}") for k in range(BANDS * ROWS)])
    return F.when(F.size(hashes) >= WINDOW, let(rows, over)).otherwise(F.array().cast("array<struct<at:int,keys:array<bigint>>>"))


def template_bands(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """template, license, shingles (distinct, by their words), n (with repeats), band (-1: a single shingle), key, offset: where in the template the window starts."""
    rows = F.array(*[F.struct(F.lit(k).alias("template"), F.lit(a).alias("license"), F.lit(b).alias("text")) for k, (a, b) in enumerate(templates)])
    held = spark.range(1).select(F.explode(rows).alias("t")).select("t.*").withColumn("words", _words(F.col("text")))
    held = held.select("template", "license", _shingles(F.col("words"), _joined).alias("shingles"), _shingles(F.col("words"), _hashed).alias("hashes"))
    banded = F.transform(_band_windows(F.col("hashes"), 1), lambda w: F.transform(w["keys"], lambda k, b: F.struct(b.alias("band"), k.alias("key"), w["at"].alias("offset"))))
    single = F.transform("hashes", lambda h, i: F.struct(F.lit(-1).alias("band"), h.alias("key"), i.alias("offset")))
    n = F.size("hashes")
    return held.select(
        "template", "license", F.array_distinct("shingles").alias("shingles"), n.alias("n"), F.explode(F.when(n < LONG, single).otherwise(F.flatten(banded))).alias("k")
    ).select("template", "license", "shingles", "n", "k.*")


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, license, containment, first_word: a row for each license found in each row of ``docs`` (doc_id, text).

    ``containment`` is the largest share of a template's shingles found together, rounded to four places;
    ``first_word`` the first word of the first place that has it. Of templates found at one place, one all of whose
    shingles there belong to a better one is a worse reading of the same words and not reported there. Null, empty and
    short texts have no license; texts of any length are read whole. Rows repeated with the same doc_id and text give
    one set of rows; null doc_ids are kept. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bands = template_bands(spark, templates)
    # As many keys as the fixed templates have windows and bands.
    wanted: dict[int, list[int]] = {}
    for x in bands.select("band", "key").distinct().collect():
        wanted.setdefault(x["band"], []).append(x["key"])

    def hits(hashes: Column) -> Column:
        """(at, band, key) of the windows that agree with a template's."""
        single = F.filter(F.transform(hashes, lambda h, i: F.struct(i.alias("at"), F.lit(-1).alias("band"), h.alias("key"))), lambda x: x["key"].isin(wanted.get(-1, [])))
        agrees = lambda w: F.exists(w["keys"], lambda k: k.isin([k for b, keys in wanted.items() if b >= 0 for k in keys]))
        banded = F.filter(_band_windows(hashes, STRIDE), agrees)
        every = F.flatten(F.transform(banded, lambda w: F.transform(w["keys"], lambda k, b: F.struct(w["at"].alias("at"), b.alias("band"), k.alias("key")))))
        return F.concat(single, every)

    near = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.xxhash64("text").alias("text_key"),
            let(_words(F.coalesce("text", F.lit(""))), lambda w: F.struct(w.alias("words"), let(_shingles(w, _hashed), hits).alias("hits"))).alias("x"),
        )
        .where(F.size("x.hits") > 0)
        .select("doc_id", "text_key", F.col("x.words").alias("words"), F.explode("x.hits").alias("hit"))
        .select("doc_id", "text_key", "words", "hit.*")
        .join(F.broadcast(bands), ["band", "key"])
    )
    # Where the template would lie, and a quarter of its length and a shingle on both sides. The windows of one copy agree on
    # that place, so that it is read once; only its words are shuffled.
    slack = F.ceil(F.col("n") / 4).cast("int") + SHINGLE
    start = F.col("at") - F.col("offset")
    begin = F.greatest(F.lit(0), start - slack)
    places = (
        near.select("doc_id", "text_key", "template", start.alias("start"), begin.alias("begin"), "at", F.slice("words", begin + 1, start + F.col("n") + slack - begin + SHINGLE - 1).alias("words"))
        .groupBy("doc_id", "text_key", "template", "start", "begin")
        .agg(F.collect_set("at").alias("at"), F.first("words").alias("words"))
    )
    held = bands.select("template", "license", "shingles").dropDuplicates(["template"])
    own = F.filter(F.transform("stretch", lambda x, i: F.when(F.array_contains(F.col("shingles"), x), i)), lambda i: i.isNotNull())
    # Three uses follow; without a written table each would scan the texts again.
    verified = materialise(
        places.join(F.broadcast(held), "template")
        .withColumn("stretch", _shingles(F.col("words"), _joined))
        .withColumn("seen", F.array_intersect("shingles", "stretch"))
        .withColumn("containment", F.round(F.size("seen") / F.size("shingles"), 4))
        .where(F.col("containment") >= CONTAINMENT)
        .select("doc_id", "text_key", "template", "at", "license", "containment", "seen", (F.col("begin") + F.array_min(own)).cast("long").alias("first_word"))
    )
    # A reading is worse than another that shares a window with it, explains all its shingles there and is better: the
    # other's shingles are compared with the words that this one has seen. As many as there are templates are collected.
    by_window = verified.withColumn("at", F.explode("at"))
    others = by_window.groupBy("doc_id", "text_key", "at").agg(F.collect_set(F.struct("containment", "template")).alias("others"))
    worse = (
        by_window.join(others, ["doc_id", "text_key", "at"])
        .select("doc_id", "text_key", "license", "containment", "first_word", "seen", F.explode("others").alias("other"))
        .where(F.col("other.containment") > F.col("containment"))
        .join(F.broadcast(held.select(F.col("template").alias("better"), F.col("shingles").alias("all"))), F.col("other.template") == F.col("better"))
        .where(F.size(F.array_except("seen", "all")) == 0)
        .select("doc_id", "text_key", "license", "containment", "first_word")
        .distinct()
    )
    best = F.max_by(F.struct("containment", "first_word"), F.struct("containment", -F.col("first_word")))
    sound = verified.alias("v").join(worse.alias("w"), reduce(lambda a, b: a & b, [F.col(f"v.{c}").eqNullSafe(F.col(f"w.{c}")) for c in worse.columns]), "left_anti")
    return sound.groupBy("doc_id", "text_key", "license").agg(best.alias("best")).select("doc_id", "license", "best.*")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
