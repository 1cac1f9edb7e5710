"""The engine over one store: ingest and ask, with settings, thresholds, embedder and log put together once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.config import EngineConfig, Thresholds, load_thresholds
from lectern.errors import ConfigError, VerificationError
from lectern.functions import text as t
from lectern.operators import answering, dense, fusion, gate, lexical, vector_index
from lectern.operators.ingest import TABLES, IngestJob
from lectern.operators.requests import request_error
from lectern.session import checkpointed
from lectern.sources.embedder import Embedder, HashEmbedder
from lectern.sources.store import TableStore


@dataclass
class Engine:
    """Store, embedder and settings. ``open`` checks that they fit each other."""

    job: IngestJob
    thresholds: Thresholds
    config: EngineConfig = field(default_factory=EngineConfig)

    @classmethod
    def open(
        cls, spark: SparkSession, folder: str, factory: Callable[[], Embedder] = HashEmbedder, config: EngineConfig | None = None, thresholds_path: str | None = None
    ) -> Engine:
        """The engine over a folder: an embedder is built once to learn its model and length, which must be those of the store."""
        config, probe = config or EngineConfig(), factory()
        if probe.dimension < 1:
            raise ConfigError("the embedder must know the length of its vectors")
        job = IngestJob(TableStore(spark, folder), factory, probe.model_id, probe.dimension, config)
        vector_index.open_collection(job.table("vectors"), probe.model_id, probe.dimension)
        bars = load_thresholds(thresholds_path, probe.model_id) if thresholds_path else Thresholds(model_id=probe.model_id)
        return cls(job, bars, config)

    def _embedded(self, questions: DataFrame) -> DataFrame:
        factory = self.job.factory

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def vector(texts: pd.Series) -> pd.Series:
            return pd.Series(factory().embed(texts.tolist()))

        return questions.select(F.col("question_id").alias("query_id"), vector("question").alias("vector"))

    def ask(self, questions: DataFrame, doc_ids: Sequence[str] | None = None, language: str | None = None, top_k: int | None = None, debug: bool = False) -> DataFrame:
        """One row for each (question_id, question); null and repeated ids are not allowed.

        Requests are checked first, and nothing is searched or embedded for those that are not valid. The filters apply behind the windows of
        both arms. The gate judges the whole window, the answer is made of its first ``top_k``.
        """
        c, k = self.config, top_k or self.config.top_k
        checked = questions.select("question_id", "question").withColumn("terms", t.query_terms(t.tokenize(F.col("question"))))
        code = request_error(F.col("question"), F.col("terms"), F.lit(top_k).cast("int"), F.lit(language).cast("string"))
        checked = checkpointed(checked.withColumn("error_code", code))
        asked = checked.where("error_code IS NULL")
        named = self.job.documents().select("doc_id", F.col("source_name").alias("document"))
        chunks = checkpointed(self.job.visible_chunks().join(named, "doc_id", "left").withColumn("tokens", t.tokenize(F.col("text"))))
        words = lexical.bm25(asked, chunks.select("chunk_id", "tokens"), c.candidates)
        mine = self.job.table("vectors").where(F.col("model_id") == self.job.model_id).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
        near = dense.cosine_topk(self._embedded(asked), mine.select(F.col("chunk_id").alias("id"), "vector"), c.candidates * c.dense_overfetch)
        near = near.select(F.col("query_id").alias("question_id"), F.col("id").alias("chunk_id"), "similarity", "dense_rank")
        allowed = chunks
        if doc_ids is not None:
            allowed = allowed.where(F.col("doc_id").isin(*doc_ids) if doc_ids else F.lit(False))
        if language is not None:
            allowed = allowed.where(F.col("language") == language)
        fused = checkpointed(fusion.fuse(near, words, c.dense_weight, c.lexical_weight, c.rrf_k, c.candidates, allowed))
        window = fused.join(chunks.select("chunk_id", "tokens", "text"), "chunk_id").join(asked.select("question_id", "terms"), "question_id")
        covered = window.withColumn("token_coverage", t.coverage(F.col("terms"), F.col("tokens")))
        judged = gate.verdict(gate.signals(covered, c.top_k), self.thresholds)
        terms = asked.select("question_id", F.explode("terms").alias("term"))
        shown = answering.debug_records(covered, judged) if debug else None
        return answering.build_answers(
            checked, window.where(F.col("rank") <= k), terms, chunks, judged, self.thresholds.min_sentence_overlap, c.max_sentences, chunks.isEmpty(), shown
        )

    def check(self) -> dict:
        """What the store holds and whether it hangs together: rows of the tables, documents, drift, unknown tables."""
        tables = self.job.store.pointer()["tables"]
        if unknown := sorted(set(tables) - set(TABLES)):
            raise VerificationError("the store holds unknown tables", tables=unknown)
        drift = {r["finding"]: r["count"] for r in self.job.drift().groupBy("finding").count().collect()}
        status = {r["status"]: r["count"] for r in self.job.documents().groupBy("status").count().collect()}
        return {"version": self.job.store.pointer()["version"], "rows": {name: self.job.table(name).count() for name in TABLES}, "documents": status, "drift": drift}


def as_json(answers: DataFrame) -> DataFrame:
    """(question_id, response): each answer as the record a service would send; what is null is shown as null."""
    columns = [c for c in answers.columns if c != "question_id"]
    return answers.select("question_id", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("response"))
