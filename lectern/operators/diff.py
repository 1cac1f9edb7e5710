"""Differences of chunk lists and of indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def chunk_diff(prior: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, chunk_hash, prior_ordinal, new_ordinal, change) with change in added, reused, removed.

    Both sides have doc_id, ordinal and chunk_hash and are compared as multisets: the n-th of equal chunks meets the n-th of the
    other side. Order does not matter.
    """

    def numbered(side: DataFrame, name: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("doc_id", "chunk_hash").orderBy("ordinal"))
        return side.select("doc_id", "chunk_hash", F.col("ordinal").alias(name), nth.alias("nth"))

    both = numbered(prior, "prior_ordinal").join(numbered(new, "new_ordinal"), ["doc_id", "chunk_hash", "nth"], "full_outer")
    change = F.when(F.col("prior_ordinal").isNull(), "added").when(F.col("new_ordinal").isNull(), "removed").otherwise("reused")
    return both.withColumn("change", change).drop("nth")


def diff_counts(diff: DataFrame) -> DataFrame:
    """(doc_id, added, reused, removed)."""
    count = lambda name: F.count_if(F.col("change") == name).alias(name)
    return diff.groupBy("doc_id").agg(count("added"), count("reused"), count("removed"))


def reconcile(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, finding) with finding ``missing`` for what is expected but not there, ``orphaned`` for the reverse."""
    want, have = expected.select(key).distinct(), actual.select(key).distinct()
    missing = want.join(have, key, "left_anti").withColumn("finding", F.lit("missing"))
    return missing.unionByName(have.join(want, key, "left_anti").withColumn("finding", F.lit("orphaned")))
