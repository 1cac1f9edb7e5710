"""Embedding inputs: the cache, request batches, and vectors for chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.config import EngineConfig


def distinct_cache(cache: DataFrame) -> DataFrame:
    """One usable row per (input_hash, model_id): of repeated ones the one stored last."""
    usable = cache.where(F.col("vector").isNotNull() & (F.size("vector") == F.col("dim")))
    best = F.max(F.struct("created_at", "dim", "vector")).alias("row")
    return usable.groupBy("input_hash", "model_id").agg(best).select("input_hash", "model_id", "row.dim", "row.vector", "row.created_at")


def cache_split(inputs: DataFrame, cache: DataFrame, model_id: str) -> DataFrame:
    """(input_hash, cached) for every distinct input: what must be embedded is where cached is false."""
    held = cache.where((F.col("model_id") == model_id) & F.col("vector").isNotNull()).select("input_hash").distinct()
    found = inputs.select("input_hash").distinct().join(held.withColumn("cached", F.lit(True)), "input_hash", "left")
    return found.withColumn("cached", F.coalesce("cached", F.lit(False)))


def cache_upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with those fresh rows whose key it lacks; of several the one stored last."""
    lacking = fresh.join(cache.select("input_hash", "model_id").distinct(), ["input_hash", "model_id"], "left_anti")
    return cache.unionByName(distinct_cache(lacking).select(cache.columns))


def rebuild_vectors(chunks: DataFrame, cache: DataFrame, model_id: str) -> DataFrame:
    """(chunk_id, model_id, dim, vector) for every chunk whose input is in the cache: the index without any request."""
    held = distinct_cache(cache.where(F.col("model_id") == model_id))
    keys = chunks.select("chunk_id", F.col("embed_input_hash").alias("input_hash")).distinct()
    return keys.join(held, "input_hash").select("chunk_id", "model_id", "dim", "vector")


def one_dimension(cache: DataFrame) -> DataFrame:
    """Models with more than one stored vector length: must be empty before an index is built."""
    return cache.where(F.col("dim").isNotNull()).groupBy("model_id").agg(F.count_distinct("dim").alias("dims")).where("dims > 1")


def plan_batches(items: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """(item, batch_part, batch_no, error): greedy batches under the caps on items and on characters.

    items has item and chars. Batches are filled in the order of the items within each partition; an item above the cap of
    its own gets no batch but an error.
    """
    c = config or EngineConfig()
    kind = items.schema["item"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch = count = chars = 0
        for frame in frames:
            numbers = []
            for n in frame["chars"].fillna(0):
                if n > c.item_chars:
                    numbers.append(None)
                    continue
                if count and (count == c.batch_items or chars + n > c.batch_chars):
                    batch, count, chars = batch + 1, 0, 0
                count, chars = count + 1, chars + n
                numbers.append(batch)
            yield pd.DataFrame(
                {
                    "item": frame["item"],
                    "batch_part": frame["part"],
                    "batch_no": pd.array(numbers, dtype="Int32"),
                    "error": [None if n is not None else "FILE_TOO_LARGE" for n in numbers],
                }
            )

    ordered = items.select("item", "chars").repartitionByRange(F.col("item")).sortWithinPartitions("item")
    return ordered.withColumn("part", F.spark_partition_id()).mapInPandas(
        run, f"item {kind}, batch_part int, batch_no int, error string"
    )


def plan_document_batches(items: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """(doc_id, item, batch_no, error): the same greedy batches for each document by itself, in the order of its items.

    items has distinct (doc_id, item) with chars; null counts as 0. A document's items pass through one task in their order, but are
    never held together.
    """
    c = config or EngineConfig()
    kinds = [items.schema[n].dataType.simpleString() for n in ("doc_id", "item")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        document, batch, count, chars = None, 0, 0, 0
        for frame in frames:
            numbers: list[int | None] = []
            for doc, n in zip(frame["doc_id"], frame["chars"].fillna(0)):
                if doc != document:
                    document, batch, count, chars = doc, 0, 0, 0
                if n > c.item_chars:
                    numbers.append(None)
                    continue
                if count and (count == c.batch_items or chars + n > c.batch_chars):
                    batch, count, chars = batch + 1, 0, 0
                count, chars = count + 1, chars + n
                numbers.append(batch)
            errors = [None if n is not None else "FILE_TOO_LARGE" for n in numbers]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "item": frame["item"], "batch_no": pd.array(numbers, dtype="Int32"), "error": errors})

    ordered = items.select("doc_id", "item", "chars").repartition("doc_id").sortWithinPartitions("doc_id", "item")
    return ordered.mapInPandas(run, f"doc_id {kinds[0]}, item {kinds[1]}, batch_no int, error string")
