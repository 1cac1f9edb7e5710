import pytest
from pyspark.sql import functions as F

from lectern.config import EngineConfig
from lectern.errors import ConfigError, EmbeddingUnavailableError, LockedError, NotFoundError
from lectern.operators.ingest import IngestJob
from lectern.sources.embedder import HashEmbedder
from lectern.sources.store import TableStore

CONFIG = EngineConfig(chunk_target_tokens=10, chunk_hard_max_tokens=20, batch_items=2)


class Picky(HashEmbedder):
    def embed(self, texts):
        if any("poison" in t for t in texts):
            raise EmbeddingUnavailableError("down")
        return super().embed(texts)


@pytest.fixture()
def job(spark, tmp_path):
    return IngestJob(TableStore(spark, str(tmp_path / "store")), Picky, "hash-embedder", 32, CONFIG)


def _files(job, **texts):
    return job.spark.createDataFrame([(f"{n}.txt", bytearray(t if isinstance(t, bytes) else t.encode())) for n, t in texts.items()], "filename string, content binary")


def _log(rows):
    return {r.doc_id: (r.action, r.prev_version, r.new_version, r.chunks_added, r.chunks_reused, r.chunks_removed, r.status, r.error_code) for r in rows.collect()}


def test_versions_from_upload_to_deletion(job):
    one = _log(job.ingest(_files(job, a="First text.\n\nSecond text.", b="Only one.", bad=b"\xff\xfe", empty=" ")))
    assert one["a"] == ("publish", None, 1, 2, 0, 0, "ok", None) and one["b"][:4] == ("publish", None, 1, 1)
    assert one["bad"][6:] == ("failed", "PARSE_ERROR") and one["empty"][6:] == ("failed", "EMPTY_DOCUMENT")
    assert job.drift().count() == 0
    two = _log(job.ingest(_files(job, a="First text.\n\nThird text.", b="﻿Only one.", c="poison here.")))
    assert two["a"] == ("publish", 1, 2, 1, 1, 1, "ok", None)
    assert two["b"] == ("unchanged", 1, 1, 0, 1, 0, "ok", None)
    assert two["c"][6:] == ("failed", "EMBEDDING_UNAVAILABLE")
    seen = {(r.doc_id, r.doc_version, r.text) for r in job.visible_chunks().collect()}
    assert seen == {("a", 2, "First text."), ("a", 2, "Third text."), ("b", 1, "Only one.")}
    found = sorted(map(tuple, job.reconcile().collect()))
    assert found == [("a:v1:0", "orphaned"), ("a:v1:1", "orphaned")]
    assert job.drift().count() == 0 and job.table("chunks").count() == 3
    gone = _log(job.delete(["b"]))
    assert gone == {"b": ("delete", 1, None, 0, 0, 1, "ok", None)}
    with pytest.raises(NotFoundError):
        job.delete(["b", "nobody"])
    three = _log(job.ingest(_files(job, b="Only one.", c="Now fine.")))
    assert three["b"][:4] == ("publish", None, 2, 1) and three["c"][:3] == ("publish", None, 2)
    states = {(r.doc_id, r.status) for r in job.documents().collect()}
    assert states == {("a", "active"), ("b", "active"), ("c", "active")}
    assert job.table("log").count() == 4 + 3 + 1 + 2
    job.clean()
    assert {r.text for r in job.visible_chunks().collect()} == {"First text.", "Third text.", "Only one.", "Now fine."}


def test_vectors_come_from_the_cache(job):
    first = {r.doc_id: r.embed_requests for r in job.ingest(_files(job, a="One.\n\nTwo.\n\nThree.")).collect()}
    assert first["a"] >= 2  # two inputs a request
    again = {r.doc_id: r.embed_requests for r in job.ingest(_files(job, a="One.\n\nTwo.")).collect()}
    assert again == {"a": 0}
    cached = job.table("cache")
    assert cached.count() == cached.select("input_hash").distinct().count() == 3


def test_one_length_a_model_and_one_writer(job):
    job.ingest(_files(job, a="One."))
    other = IngestJob(job.store, Picky, "hash-embedder", 16, CONFIG)
    with pytest.raises(ConfigError):
        other.ingest(_files(job, b="Two."))
    with job.store.lock(), pytest.raises(LockedError):
        job.delete(["a"])
    assert job.documents().where(F.col("status") == "active").count() == 1


def test_two_files_of_one_document(job):
    rows = job.spark.createDataFrame([("x/a.txt", bytearray(b"Old.")), ("y/a.txt", bytearray(b"New."))], "filename string, content binary")
    actions = sorted((r.action, r.new_version) for r in job.ingest(rows).collect())
    assert actions == [("publish", 1), ("skip", None)] and [r.text for r in job.visible_chunks().collect()] == ["New."]
