"""Uploads to published versions, as one plan over any number of documents.

What is known of versions is a table of events: a version's state is that of its last event. A batch of uploads only adds rows to
the tables, the new versions become visible by one swap of the store's pointer, and what they replace is hidden at once by
the events; removing it from disk is a later job that may fail and be repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern import errors
from lectern.config import EngineConfig
from lectern.functions import identity
from lectern.operators import corpus, diff, vector_index
from lectern.operators.chunking import chunk_sections, dominant_language
from lectern.session import checkpointed
from lectern.sources.embedder import Embedder, request_groups
from lectern.sources.files import parse_files, section_rows
from lectern.sources.store import TableStore

EVENT = "doc_id string, version int, seq long, state string, title string, source_name string, format string, content_hash string, parsed_hash string, language string"
CHUNK = (
    "chunk_id string, doc_id string, doc_version int, ordinal int, text string, char_start int, char_end int, chunk_hash string, embed_input_hash string, "
    "section_path array<string>, page_start int, page_end int, line_start int, line_end int, language string"
)
SOURCE = "doc_id string, version int, source_text string"
VECTOR = "chunk_id string, model_id string, dim int, vector array<double>"
CACHED = "input_hash string, model_id string, dim int, vector array<double>"
LOG = (
    "batch long, doc_id string, action string, prev_version int, new_version int, chunks_added long, chunks_reused long, chunks_removed long, "
    "embed_requests long, status string, error_code string"
)
TABLES = {"events": EVENT, "chunks": CHUNK, "sources": SOURCE, "vectors": VECTOR, "cache": CACHED, "log": LOG}


def states(events: DataFrame) -> DataFrame:
    """One row per (doc_id, version) with the state and attributes of its last event."""
    names = [c for c in events.columns if c not in ("doc_id", "version", "seq")]
    last = F.max(F.struct("seq", *names)).alias("last")
    return events.groupBy("doc_id", "version").agg(last).select("doc_id", "version", *(f"last.{c}" for c in names))


def outcomes(uploads: DataFrame, new_chunks: DataFrame, documents: DataFrame, published_chunks: DataFrame) -> DataFrame:
    """What an upload of every document would do: (doc_id, status, prev_version, new_version, chunks_added, chunks_reused, chunks_removed).

    uploads has distinct doc_id with parsed_hash, new_chunks (doc_id, ordinal, chunk_hash); documents has doc_id, status, current_version,
    last_version and parsed_hash, published_chunks the same as new_chunks of the current versions. The same parsed text as the
    active version's is ``unchanged``, whatever its bytes, and reuses all chunks; else the document is ``created`` or ``updated``.
    """
    joined = uploads.select("doc_id", F.col("parsed_hash").alias("new_hash")).join(documents, "doc_id", "left")
    active = F.coalesce(F.col("status") == "active", F.lit(False))
    same = active & F.coalesce(F.col("new_hash") == F.col("parsed_hash"), F.lit(False))
    decided = joined.select(
        "doc_id",
        F.when(same, "unchanged").when(active, "updated").otherwise("created").alias("status"),
        F.when(active, F.col("current_version")).alias("prev_version"),
        F.when(same, F.col("current_version")).otherwise(F.coalesce("last_version", F.lit(0)) + 1).alias("new_version"),
    )
    prior = published_chunks.join(decided.where("status = 'updated'").select("doc_id"), "doc_id", "left_semi")
    counts = diff.diff_counts(diff.chunk_diff(prior, new_chunks.join(decided.where("status <> 'unchanged'").select("doc_id"), "doc_id", "left_semi")))
    whole = new_chunks.groupBy("doc_id").agg(F.count("*").alias("whole"))
    unchanged = F.col("status") == "unchanged"
    return decided.join(counts, "doc_id", "left").join(whole, "doc_id", "left").select(
        "doc_id", "status", "prev_version", "new_version",
        F.coalesce("added", F.lit(0)).cast("long").alias("chunks_added"),
        F.coalesce(F.when(unchanged, F.col("whole")).otherwise(F.col("reused")), F.lit(0)).cast("long").alias("chunks_reused"),
        F.coalesce("removed", F.lit(0)).cast("long").alias("chunks_removed"),
    )


def embed_rows(inputs: DataFrame, factory: Callable[[], Embedder], config: EngineConfig | None = None) -> DataFrame:
    """(input_hash, vector, request, error_code) of distinct (input_hash, input).

    Each task builds its embedder and fills requests in the order of its rows; ``request`` names the one that an input went out with.
    An input above its cap is an error of its own. Where a request fails its inputs are sent one by one, so that a bad input fails
    the documents that need it and no others. Nothing is truncated.
    """
    c = config or EngineConfig()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder = None
        for number, frame in enumerate(frames):
            texts = frame["input"].fillna("").tolist()
            vectors: list = [None] * len(texts)
            request: list = [None] * len(texts)
            codes: list = [errors.FILE_TOO_LARGE if len(t) > c.item_chars else None for t in texts]
            fits = [i for i, code in enumerate(codes) if code is None]
            for group in request_groups([len(texts[i]) for i in fits], c):
                rows = [fits[g] for g in group]
                name = f"{frame['part'].iloc[0]}-{number}-{group.start}"
                try:
                    embedder = embedder or factory()
                    found = embedder.embed([texts[i] for i in rows])
                    for i, v in zip(rows, found):
                        vectors[i], request[i] = v, name
                except errors.LecternError:
                    for i in rows:
                        try:
                            vectors[i], request[i] = (embedder or factory()).embed([texts[i]])[0], f"{name}-{i}"
                        except errors.LecternError as problem:
                            codes[i] = problem.code
            yield pd.DataFrame({"input_hash": frame["input_hash"], "vector": vectors, "request": request, "error_code": codes})

    placed = inputs.select("input_hash", "input").withColumn("part", F.spark_partition_id())
    return placed.mapInPandas(run, "input_hash string, vector array<double>, request string, error_code string")


@dataclass
class IngestJob:
    """Ingest, delete, reconcile and clean-up over a table store."""

    store: TableStore
    factory: Callable[[], Embedder]
    model_id: str
    dim: int
    config: EngineConfig = field(default_factory=EngineConfig)

    @property
    def spark(self) -> SparkSession:
        """The store's session."""
        return self.store.spark

    def table(self, name: str) -> DataFrame:
        """A table of the published version, empty if there is none yet."""
        if name in self.store.pointer()["tables"]:
            return self.store.read(name)
        return self.spark.createDataFrame([], TABLES[name])

    def documents(self) -> DataFrame:
        """(doc_id, status, current_version, last_version, parsed_hash, title, source_name, format, language) of every document ever seen."""
        versions = states(self.table("events"))
        seen = corpus.visible_documents(versions)
        now = versions.select("doc_id", F.col("version").alias("current_version"), "parsed_hash", "title", "source_name", "format", "language")
        return seen.join(now, ["doc_id", "current_version"], "left")

    def visible_chunks(self) -> DataFrame:
        """Chunks of the active documents' current versions."""
        return corpus.eligible_chunks(self.table("chunks"), self.documents())

    def ingest(self, files: DataFrame) -> DataFrame:
        """Publish (filename, content) and return the batch's rows of the log.

        Of several files of one document in a batch the greatest file name counts, the others are logged as skipped. A file that can't be
        parsed, gives no chunk or lacks a vector fails alone: its version is spent, nothing of it becomes visible.
        """
        vector_index.open_collection(self.table("vectors"), self.model_id, self.dim)
        batch = self.store.pointer()["version"] + 1
        hashed = files.select("filename", "content").withColumn("raw_hash", identity.content_hash(F.col("content")))
        nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("filename")))
        parsed = parse_files(hashed).join(hashed.select("filename", "raw_hash"), "filename").withColumn("nth", nth)
        parsed = checkpointed(parsed.withColumn("parsed_hash", identity.content_hash(F.col("text"))))
        first = parsed.where("nth = 1")
        good = first.where("error_code IS NULL").select("doc_id", "filename", "format", "title", "text", "sections", "error_code", "raw_hash", "parsed_hash")
        documents = self.documents()
        published = self.visible_chunks().select("doc_id", "ordinal", "chunk_hash")

        cut = chunk_sections(section_rows(good), self.config).join(good.select("doc_id", "title"), "doc_id")
        text = identity.embed_input(F.col("title"), F.col("section_path"), F.col("text"))
        new = checkpointed(cut.withColumn("input", text).withColumn("embed_input_hash", identity.content_hash(F.col("input"))))
        plan = checkpointed(outcomes(good, new.select("doc_id", "ordinal", "chunk_hash"), documents, published))
        fresh = plan.where("status <> 'unchanged'").select("doc_id", F.col("new_version").alias("doc_version"))
        chunks = new.join(fresh, "doc_id").withColumn("chunk_id", identity.chunk_id(F.col("doc_id"), F.col("doc_version"), F.col("ordinal")))

        cache = self.table("cache").where((F.col("model_id") == self.model_id) & vector_index.fitting(self.dim))
        inputs = chunks.groupBy(F.col("embed_input_hash").alias("input_hash")).agg(F.min("input").alias("input"))
        embedded = checkpointed(embed_rows(inputs.join(cache, "input_hash", "left_anti"), self.factory, self.config))
        ready = cache.select("input_hash", "vector").unionByName(embedded.where(vector_index.fitting(self.dim)).select("input_hash", "vector"))
        held = ready.groupBy("input_hash").agg(F.max("vector").alias("vector"))
        joined = chunks.join(held, chunks["embed_input_hash"] == held["input_hash"], "left").drop("input_hash")
        sent = embedded.select(F.col("input_hash").alias("embed_input_hash"), "request", F.col("error_code").alias("embed_error"))
        checked = joined.join(sent, "embed_input_hash", "left").groupBy("doc_id").agg(
            F.count("*").alias("made"), F.count("vector").alias("vectors"), F.count_distinct("request").alias("embed_requests"), F.max("embed_error").alias("embed_error")
        )
        judged = plan.join(checked, "doc_id", "left").withColumn(
            "error_code",
            F.when(F.col("status") == "unchanged", None)
            .when(F.coalesce("made", F.lit(0)) == 0, errors.VECTOR_STORE_UNAVAILABLE)
            .when(F.col("vectors") < F.col("made"), F.coalesce("embed_error", F.lit(errors.VECTOR_STORE_UNAVAILABLE))),
        )
        judged = checkpointed(judged)
        done = judged.where("error_code IS NULL AND status <> 'unchanged'").select("doc_id")
        published_chunks = joined.join(done, "doc_id", "left_semi")

        facts = good.select("doc_id", "title", identity.basename(F.col("filename")).alias("source_name"), "format", F.col("raw_hash").alias("content_hash"), "parsed_hash")
        spoken = dominant_language(new.select("doc_id", "ordinal", "language"))
        tried = judged.where("status <> 'unchanged'").join(facts, "doc_id").join(spoken, "doc_id", "left")
        state = F.when(F.col("error_code").isNull(), "published").otherwise("failed")
        event_columns = [c.split()[0] for c in EVENT.split(", ")]
        events = tried.select("doc_id", F.col("new_version").alias("version"), F.lit(2 * batch + 1).cast("long").alias("seq"), state.alias("state"), *event_columns[4:])
        before = states(self.table("events")).where("state = 'published'").join(done, "doc_id", "left_semi")
        events = events.unionByName(before.select("doc_id", "version", F.lit(2 * batch).cast("long").alias("seq"), F.lit("superseded").alias("state"), *event_columns[4:]))

        log = self._log(batch, parsed, judged)
        added = {
            "events": events,
            "chunks": published_chunks.select(*(c.split()[0] for c in CHUNK.split(", "))),
            "sources": good.join(done, "doc_id", "left_semi").join(fresh, "doc_id").select("doc_id", F.col("doc_version").alias("version"), F.col("text").alias("source_text")),
            "vectors": published_chunks.select("chunk_id", F.lit(self.model_id).alias("model_id"), F.lit(self.dim).alias("dim"), "vector"),
            "cache": embedded.where(vector_index.fitting(self.dim)).select("input_hash", F.lit(self.model_id).alias("model_id"), F.lit(self.dim).alias("dim"), "vector"),
            "log": log,
        }
        self._publish(added, batch)
        return self.table("log").where(F.col("batch") == batch)

    def _log(self, batch: int, parsed: DataFrame, judged: DataFrame) -> DataFrame:
        ok = F.col("error_code").isNull()
        action = F.when(F.col("status") == "unchanged", "unchanged").otherwise("publish")
        number = lambda c: F.when(ok, F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c)
        counts = ["chunks_added", "chunks_reused", "chunks_removed"]
        tried = judged.select(
            F.lit(batch).cast("long").alias("batch"), "doc_id", action.alias("action"), F.when(ok, F.col("prev_version")).alias("prev_version"),
            F.when(ok, F.col("new_version")).alias("new_version"), *map(number, counts), F.coalesce("embed_requests", F.lit(0)).cast("long").alias("embed_requests"),
            F.when(ok, "ok").otherwise("failed").alias("status"), "error_code",
        )
        left = parsed.where("nth > 1 OR error_code IS NOT NULL").select(
            F.lit(batch).cast("long").alias("batch"), "doc_id", F.when(F.col("nth") > 1, "skip").otherwise("publish").alias("action"), F.lit(None).cast("int").alias("prev_version"),
            F.lit(None).cast("int").alias("new_version"), *(F.lit(0).cast("long").alias(c) for c in [*counts, "embed_requests"]),
            F.when(F.col("nth") > 1, "ok").otherwise("failed").alias("status"), F.when(F.col("nth") == 1, F.col("error_code")).alias("error_code"),
        )
        return tried.unionByName(left)

    def _publish(self, added: dict[str, DataFrame], batch: int) -> None:
        """Stage, verify and swap: every new chunk must have its vector in what was written."""
        with self.store.lock():
            if self.store.pointer()["version"] + 1 != batch:
                raise errors.LockedError("another batch was published meanwhile")
            version = self.store.stage(added)
            written, vectors = self.store.staged(version, "chunks"), self.store.staged(version, "vectors")
            lacking = vector_index.presence(written, vectors, self.model_id).where("NOT present")
            if not lacking.isEmpty():
                raise errors.VerificationError("staged chunks lack their vectors")
            self.store.publish(version, adds=tuple(added))

    def delete(self, doc_ids: list[str]) -> DataFrame:
        """Hide documents: their versions become superseded by events, and nothing of them is visible from then on. An unknown or
        deleted one among them is an error, and nothing is changed."""
        active = self.documents().where(F.col("status") == "active").where(F.col("doc_id").isin(*doc_ids) if doc_ids else F.lit(False))
        known = {r["doc_id"] for r in active.select("doc_id").collect()}
        if unknown := sorted(set(doc_ids) - known):
            raise errors.NotFoundError("no active document of this id", doc_ids=unknown)
        batch = self.store.pointer()["version"] + 1
        columns = [c.split()[0] for c in EVENT.split(", ")]
        versions = states(self.table("events")).where("state = 'published'").where(F.col("doc_id").isin(*doc_ids))
        events = versions.withColumn("seq", F.lit(2 * batch).cast("long")).withColumn("state", F.lit("superseded")).select(columns)
        chunks = self.table("chunks").where(F.col("doc_id").isin(*doc_ids)).groupBy("doc_id").agg(F.count("*").alias("n"))
        log = active.join(chunks, "doc_id", "left").select(
            F.lit(batch).cast("long").alias("batch"), "doc_id", F.lit("delete").alias("action"), F.col("current_version").alias("prev_version"),
            F.lit(None).cast("int").alias("new_version"), *(F.lit(0).cast("long").alias(c) for c in ("chunks_added", "chunks_reused")),
            F.coalesce("n", F.lit(0)).cast("long").alias("chunks_removed"), F.lit(0).cast("long").alias("embed_requests"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error_code"),
        )
        with self.store.lock():
            self.store.publish(self.store.stage({"events": events, "log": log}), adds=("events", "log"))
        return self.table("log").where(F.col("batch") == batch)

    def drift(self) -> DataFrame:
        """(chunk_id, finding): visible chunks without a vector, and vectors of chunks that are not visible."""
        return diff.reconcile(self.visible_chunks(), self.table("vectors").where(F.col("model_id") == self.model_id), "chunk_id")

    def reconcile(self) -> DataFrame:
        """Bring the index in line with the visible chunks and return the drift as it was found: stray vectors go, missing ones come
        from the cache, and chunks of versions that are not current are removed from disk. Versions left in staging become failed."""
        found = checkpointed(self.drift())
        visible = self.visible_chunks()
        batch = self.store.pointer()["version"] + 1
        columns = [c.split()[0] for c in EVENT.split(", ")]
        stale = states(self.table("events")).where("state = 'staging'").withColumn("seq", F.lit(2 * batch).cast("long")).withColumn("state", F.lit("failed")).select(columns)
        with self.store.lock():
            version = self.store.stage({"events": self.table("events").select(columns).unionByName(stale), "chunks": visible, "vectors": self.rebuilt(visible)})
            self.store.publish(version)
        return found

    def rebuilt(self, visible: DataFrame) -> DataFrame:
        """Vectors of the visible chunks from the cache alone."""
        held = self.table("cache").where(F.col("model_id") == self.model_id).groupBy("input_hash").agg(F.max("vector").alias("vector"))
        keys = visible.select("chunk_id", F.col("embed_input_hash").alias("input_hash"))
        others = self.table("vectors").where(F.col("model_id") != self.model_id)
        mine = keys.join(held, "input_hash").select("chunk_id", F.lit(self.model_id).alias("model_id"), F.lit(self.dim).alias("dim"), "vector")
        return others.select(mine.columns).unionByName(mine)

    def clean(self) -> list[int]:
        """Delete versions of the store that hold no part of a table. It comes after the swap and may fail without harm."""
        return self.store.clean(keep=1)
