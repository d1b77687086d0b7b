"""What the corpus operators share: words, checkpoints and a few SQL fragments."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.staging import Written, delete_path, shared_folder

__all__ = ["WORD", "Written", "delete_path", "fresh", "let", "ln_factorial", "materialise", "numbers_below", "shared_folder", "table"]

#: A word is a maximal run of characters other than the six ASCII white-space characters.
#: ``bytes.split()`` without arguments cuts UTF-8 at exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder named by spark.checkpoint.dir.

    The folder is shared on a cluster, so a lost executor loses nothing. Only where
    the setting is absent (tests) a temporary folder is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(name: str) -> str:
    """A column name that no table has, for columns that stand beside those of a user's table."""
    return f"_{name}_{uuid.uuid4().hex[:12]}"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once for each row and hand it to ``body`` (a lambda variable is never evaluated again)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def numbers_below(n: str, step: int = 10_000) -> tuple[Column, Column]:
    """(array to explode as ``_hundreds``, array to explode then): together 0 .. n - 1 without one array of that length."""
    return (
        F.expr(f"sequence(0L, greatest(0L, {n} - 1) div {step})"),
        F.expr(f"CASE WHEN {n} > _hundreds * {step} THEN sequence(_hundreds * {step}, least({n}, (_hundreds + 1) * {step}) - 1) ELSE slice(array(0L), 1, 0) END"),
    )


def ln_factorial(n: str) -> str:
    """SQL text for ln(n!): the factorial itself up to 20, Stirling's series above (its error is below 1e-12 there)."""
    x = f"greatest(double({n}), 21D)"
    return (
        f"(CASE WHEN {n} < 2 THEN 0D WHEN {n} <= 20 THEN ln(double(factorial(int(least({n}, 20L))))) ELSE ({x} + 0.5D) * ln({x}) - {x} + 0.9189385332046727D"
        f" + 1D / (12D * {x}) - 1D / (360D * pow({x}, 3)) + 1D / (1260D * pow({x}, 5)) END)"
    )
