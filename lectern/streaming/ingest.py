"""Ingestion of files as they arrive: an extension of the batch plan, not a different one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.config import EngineConfig
from lectern.operators.chunking import chunk_sections
from lectern.sources.files import parse_files, section_rows


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, content) of new files in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).load(folder)
    return found.select(F.col("path").alias("filename"), "content")


def ingest_stream(
    files: DataFrame, publish: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, config: EngineConfig | None = None
) -> StreamingQuery:
    """Parse and chunk each batch of files and hand (documents, chunks, batch id) to ``publish``, which must be idempotent
    by the batch id: a batch may come again after a failure."""

    def batch(rows: DataFrame, number: int) -> None:
        parsed = parse_files(rows).persist()
        try:
            publish(parsed, chunk_sections(section_rows(parsed), config), number)
        finally:
            parsed.unpersist()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
