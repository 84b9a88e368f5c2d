"""Lookups and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acadspark.functions.text import list_containing


def dictionary_match(df: DataFrame, col: str, words, out: str = "matches") -> DataFrame:
    """Words of the dictionary contained in the text, case-insensitively, in dictionary order."""
    return df.withColumn(out, list_containing(F.col(col), words))


def extraction_rules(targets: DataFrame, rules: DataFrame, generic: str | None, fallback: str) -> DataFrame:
    """Add ``rule``: by site and department, else by host, else the generic one, else the fallback.

    ``rules`` has site, department and rule; a null department means "any". Joins carry no broadcast hint: Spark
    broadcasts the rule table when its measured size allows and shuffles otherwise.
    """
    exact = rules.filter("site IS NOT NULL AND department IS NOT NULL").select("site", "department", F.col("rule").alias("_exact"))
    by_host = rules.filter("site IS NOT NULL AND department IS NULL").select("site", F.col("rule").alias("_host"))
    j = targets.join(exact, ["site", "department"], "left").join(by_host, "site", "left")
    return j.withColumn("rule", F.coalesce("_exact", "_host", F.lit(generic), F.lit(fallback))).drop("_exact", "_host")
