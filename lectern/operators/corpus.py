"""Versioned documents: allocation, publication, deletion and what is visible of them.

Versions are immutable rows with a state. What is visible is one pointer per document; publishing and deleting change
the pointer only, so that readers see the old or the new version, never a mixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATES = ("staging", "published", "superseded", "failed")


def distinct_versions(versions: DataFrame) -> DataFrame:
    """One row per (doc_id, version): of repeated rows the one created last, then the greater state."""
    names = [c for c in versions.columns if c not in ("doc_id", "version")]
    best = F.max(F.struct("created_at", "state", *(c for c in names if c not in ("created_at", "state"))))
    return versions.groupBy("doc_id", "version").agg(best.alias("row")).select("doc_id", "version", *(f"row.{c}" for c in names))


def visible_documents(versions: DataFrame) -> DataFrame:
    """(doc_id, current_version, last_version, status) from the states of the versions.

    The current version is the greatest published one; a document without one is not visible.
    """
    found = versions.groupBy("doc_id").agg(
        F.max(F.when(F.col("state") == "published", F.col("version"))).alias("current_version"),
        F.max("version").alias("last_version"),
    )
    status = F.when(F.col("current_version").isNull(), "deleted").otherwise("active")
    return found.withColumn("status", status)


def allocate_versions(documents: DataFrame, uploads: DataFrame) -> DataFrame:
    """(doc_id, version): the next version of every uploaded document; several uploads of one are one after the other.

    uploads has doc_id and upload_no, which orders them. Numbers of failed versions are not used again.
    """
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("upload_no"))
    base = documents.select("doc_id", "last_version")
    numbered = uploads.select("doc_id", "upload_no").withColumn("nth", nth).join(base, "doc_id", "left")
    return numbered.select("doc_id", "upload_no", (F.coalesce("last_version", F.lit(0)) + F.col("nth")).alias("version"))


def publish(versions: DataFrame, staged: DataFrame) -> DataFrame:
    """Versions after publication of the staged (doc_id, version): they are published, what was published before is
    superseded. A staged version that does not exist changes nothing."""
    mark = staged.select("doc_id", F.col("version").alias("new_version")).groupBy("doc_id").agg(F.max("new_version").alias("new_version"))
    real = versions.select("doc_id", F.col("version").alias("new_version")).join(mark, ["doc_id", "new_version"], "left_semi").distinct()
    state = (
        F.when(F.col("version") == F.col("new_version"), "published")
        .when(F.col("new_version").isNotNull() & (F.col("state") == "published"), "superseded")
        .otherwise(F.col("state"))
    )
    return versions.join(real, "doc_id", "left").withColumn("state", state).drop("new_version")


def mark_deleted(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents after deletion: a tombstone without current version; history and version numbers stay."""
    marked = documents.join(gone.select("doc_id").distinct().withColumn("gone", F.lit(True)), "doc_id", "left")
    return marked.withColumns(
        {
            "status": F.when(F.col("gone"), "deleted").otherwise(F.col("status")),
            "current_version": F.when(F.col("gone"), None).otherwise(F.col("current_version")),
        }
    ).drop("gone")


def mark_failed(versions: DataFrame, which: Column) -> DataFrame:
    """Versions in staging that meet the condition become failed."""
    stale = (F.col("state") == "staging") & which
    return versions.withColumn("state", F.when(stale, "failed").otherwise(F.col("state")))


def purge(chunks: DataFrame, versions: DataFrame, states: tuple[str, ...] = ("superseded", "failed")) -> DataFrame:
    """Chunks without those of versions in the given states."""
    dead = versions.where(F.col("state").isin(*states)).select("doc_id", F.col("version").alias("doc_version"))
    return chunks.join(dead, ["doc_id", "doc_version"], "left_anti")


def eligible_chunks(
    chunks: DataFrame,
    documents: DataFrame,
    doc_ids: list[str] | None = None,
    chunk_ids: list[str] | None = None,
    language: str | None = None,
) -> DataFrame:
    """Chunks of current versions of active documents, each key once: of repeated rows the greatest by ordinal, hash and text.

    A filter that is None does not filter, an empty list lets nothing through. Filters reach the scan.
    """
    found = chunks
    for column, wanted in (("doc_id", doc_ids), ("chunk_id", chunk_ids)):
        if wanted is not None:
            found = found.where(F.col(column).isin(*wanted) if wanted else F.lit(False))
    if language is not None:
        found = found.where(F.col("language") == language)
    current = documents.where(F.col("status") == "active").select("doc_id", F.col("current_version").alias("doc_version"))
    return first_of_chunk(found.join(current, ["doc_id", "doc_version"], "left_semi"))


def first_of_chunk(chunks: DataFrame) -> DataFrame:
    """One row for each chunk_id, partitioned by it, in as many partitions as the session's shuffles have, since what follows
    is dear for its bytes. Only ids and hashes of rows are compared, so that texts are not sorted."""
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc(c) for c in ("ordinal", "chunk_hash") if c in chunks.columns] + [F.desc(F.xxhash64(*chunks.columns))]
    return chunks.repartition(parts, "chunk_id").withColumn("nth", F.row_number().over(Window.partitionBy("chunk_id").orderBy(*order))).where("nth = 1").drop("nth")


def source_texts(versions: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, version, source_text) of the current version of every active document; of repeated rows the greatest text."""
    current = documents.where(F.col("status") == "active").select("doc_id", F.col("current_version").alias("version"))
    found = versions.join(current, ["doc_id", "version"], "left_semi")
    return found.groupBy("doc_id", "version").agg(F.max("source_text").alias("source_text"))


def version_facts(versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, version, state, chunks): every version with the state of its last row and its number of chunks."""
    counts = chunks.groupBy("doc_id", F.col("doc_version").alias("version")).agg(F.count_distinct("chunk_id").alias("chunks"))
    found = distinct_versions(versions).select("doc_id", "version", "state").join(counts, ["doc_id", "version"], "left")
    return found.withColumn("chunks", F.coalesce("chunks", F.lit(0)))


def document_page(documents: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of the active documents in the order of their ids, each row with the total."""
    active = documents.where(F.col("status") == "active")
    total = active.agg(F.count("*").alias("total"))
    return active.orderBy("doc_id").offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def outline(chunks: DataFrame) -> DataFrame:
    """First chunk of every distinct section of a document version: (doc_id, doc_version, section_path_json, ordinal, chunk_id)."""
    first = F.min(F.struct("ordinal", "chunk_id")).alias("first")
    return chunks.groupBy("doc_id", "doc_version", "section_path_json").agg(first).select(
        "doc_id", "doc_version", "section_path_json", "first.ordinal", "first.chunk_id"
    )
