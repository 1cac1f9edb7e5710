"""The evidence gate: whether what was found supports an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.config import Thresholds


def _unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))))


def signals(candidates: DataFrame, top_k: int = 5) -> DataFrame:
    """(question_id, max_dense, lexical, token_coverage, overlap, candidate_count) over the whole window of candidates.

    Each is the best of the window, cut to [0, 1]; overlap is the share that the first ``top_k`` of both arms have in common.
    """
    d, w = F.col("dense_rank") <= top_k, F.col("lexical_rank") <= top_k
    either, both = F.count_if(F.coalesce(d, F.lit(False)) | F.coalesce(w, F.lit(False))), F.count_if(d & w)
    return candidates.groupBy("question_id").agg(
        _unit(F.max("similarity")).alias("max_dense"),
        _unit(F.max("lexical_score")).alias("lexical"),
        _unit(F.max("token_coverage")).alias("token_coverage"),
        F.when(either > 0, both / either).otherwise(0.0).alias("overlap"),
        F.count("*").alias("candidate_count"),
    )


def verdict(found: DataFrame, bars: Thresholds | None = None) -> DataFrame:
    """The signals with ``passed`` and ``reason``; bars are inclusive, no candidates always refuses."""
    t = bars or Thresholds()
    covered = (F.col("max_dense") >= t.min_dense) & (F.col("token_coverage") >= t.min_coverage)
    reason = (
        F.when(F.col("candidate_count") == 0, "below_threshold")
        .when(covered, "dense+coverage")
        .when(F.col("token_coverage") >= t.min_coverage_high, "exact_terms")
        .otherwise("below_threshold")
    )
    return found.withColumn("reason", reason).withColumn("passed", F.col("reason") != "below_threshold")


def evidence_score() -> Column:
    """How much stands behind an answer, from the signals."""
    return _unit(0.4 * F.col("token_coverage") + 0.3 * F.col("max_dense") + 0.3 * F.col("lexical"))
