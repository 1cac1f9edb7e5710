"""Weighted reciprocal-rank fusion of two arms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.errors import ConfigError


def fuse(
    dense: DataFrame,
    lexical: DataFrame,
    dense_weight: float = 0.9,
    lexical_weight: float = 0.1,
    k: int = 60,
    limit: int | None = 30,
    allowed: DataFrame | None = None,
) -> DataFrame:
    """(question_id, chunk_id, dense_rank, lexical_rank, similarity, bm25, lexical_score, score, rank).

    The score is the sum of weight / (k + rank) over the arms that have the chunk. An arm of weight 0 is left out with
    everything that only it has. Ties go to the smaller chunk_id. With ``allowed`` only its chunks stay; as they are sorted out behind the
    arms' windows and before the limit, a narrow filter may leave few.
    """
    if k <= 0 or min(dense_weight, lexical_weight) < 0:
        raise ConfigError("k must be positive and weights must not be negative")
    if dense_weight == 0:
        dense = dense.where(F.lit(False))
    if lexical_weight == 0:
        lexical = lexical.where(F.lit(False))
    both = dense.select("question_id", "chunk_id", "dense_rank", "similarity").join(
        lexical.select("question_id", "chunk_id", "lexical_rank", "bm25", "lexical_score"), ["question_id", "chunk_id"], "full_outer"
    )
    part = lambda w, rank: F.coalesce(F.lit(float(w)) / (F.lit(k) + F.col(rank)), F.lit(0.0))
    scored = both.withColumn("score", part(dense_weight, "dense_rank") + part(lexical_weight, "lexical_rank"))
    if allowed is not None:
        scored = scored.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def fused_by_weight(dense: DataFrame, lexical: DataFrame, weights: DataFrame, k: int = 60, limit: int = 5) -> DataFrame:
    """The fusion for every row of weights (config, dense_weight, lexical_weight), a small table, in one plan."""
    both = dense.select("question_id", "chunk_id", "dense_rank").join(
        lexical.select("question_id", "chunk_id", "lexical_rank"), ["question_id", "chunk_id"], "full_outer"
    )
    each = both.crossJoin(F.broadcast(weights))  # a fixed lattice of weights
    part = lambda w, rank: F.coalesce(F.when(F.col(w) > 0, F.col(w) / (F.lit(k) + F.col(rank))), F.lit(0.0))
    scored = each.withColumn("score", part("dense_weight", "dense_rank") + part("lexical_weight", "lexical_rank")).where("score > 0")
    order = Window.partitionBy("config", "question_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
