"""The vector index as a table: (chunk_id, model_id, dim, vector), one row per chunk and model.

Every model has one length. What does not fit is reported, never stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.errors import ConfigError
from lectern.functions.identity import collection_name


def collections(index: DataFrame) -> DataFrame:
    """(model_id, dim, collection, vectors): what the index holds, with the name of each collection."""
    held = index.where(F.col("model_id").isNotNull() & F.col("dim").isNotNull()).groupBy("model_id", "dim").agg(F.count("*").alias("vectors"))
    return held.select("model_id", "dim", collection_name(F.col("model_id"), F.col("dim")).alias("collection"), "vectors")


def open_collection(index: DataFrame, model_id: str, dim: int) -> DataFrame:
    """The rows of a model; refused where the index holds the model with another length. An index without the model is new."""
    lengths = [r["dim"] for r in index.where(F.col("model_id") == model_id).select("dim").distinct().limit(2).collect()]
    if any(n != dim for n in lengths):
        raise ConfigError(f"vectors of {model_id} are stored with length {lengths[0]}, not {dim}")
    return index.where(F.col("model_id") == model_id)


def fitting(dim: Column | int) -> Column:
    """Whether a vector is complete and has the length."""
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v))
    return F.coalesce((F.size("vector") == dim) & ~bad, F.lit(False))


def upsert_vectors(index: DataFrame, fresh: DataFrame, model_id: str, dim: int) -> DataFrame:
    """The index after an upsert of (chunk_id, vector): fresh rows replace those of their chunk.

    Rows without a chunk or with a vector that does not fit are left out (see ``misfits``). Of several fresh rows of a chunk the
    greatest vector is kept, so that a repeated job gives the same index.
    """
    good = fresh.where(F.col("chunk_id").isNotNull() & fitting(dim)).groupBy("chunk_id").agg(F.max("vector").alias("vector"))
    rows = good.select("chunk_id", F.lit(model_id).alias("model_id"), F.lit(dim).alias("dim"), "vector")
    kept = index.join(rows.select("chunk_id", "model_id"), ["chunk_id", "model_id"], "left_anti")
    return kept.select(rows.columns).unionByName(rows)


def misfits(fresh: DataFrame, dim: int) -> DataFrame:
    """(chunk_id, length) of rows that an upsert leaves out; length is null for a null vector."""
    wrong = fresh.where(F.col("chunk_id").isNull() | ~fitting(dim))
    return wrong.select("chunk_id", F.when(F.col("vector").isNotNull(), F.size("vector")).alias("length"))


def delete_vectors(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without the chunks of ``gone``; unknown ones are ignored."""
    return index.join(gone.select("chunk_id").distinct(), "chunk_id", "left_anti")


def presence(expected: DataFrame, index: DataFrame, model_id: str) -> DataFrame:
    """(chunk_id, present) for every expected chunk."""
    held = index.where(F.col("model_id") == model_id).select("chunk_id").distinct().withColumn("present", F.lit(True))
    return expected.select("chunk_id").distinct().join(held, "chunk_id", "left").withColumn("present", F.coalesce("present", F.lit(False)))
