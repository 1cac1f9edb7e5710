import pytest

from lectern.errors import VerificationError
from lectern.sources.store import TableStore
from lectern.streaming.ingest import ingest_stream, stream_files


def test_publication_swaps_all_tables_at_once(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))
    with pytest.raises(VerificationError):
        store.read("a")
    one = store.stage({"a": spark.range(3), "b": spark.range(1)})
    assert store.pointer()["version"] == 0
    store.publish(one, {"a": 3})
    two = store.stage({"a": spark.range(5), "b": spark.range(2)})
    assert store.read("a").count() == 3
    with pytest.raises(VerificationError):
        store.publish(two, {"a": 4})
    assert store.read("a").count() == 3 and store.read("b").count() == 1
    store.publish(two, {"a": 5})
    assert store.read("a").count() == 5 and store.read("b").count() == 2
    three = store.stage({"a": spark.range(1)})
    store.publish(three)
    assert store.clean(keep=0) == [one] and store.versions() == [two, three]
    with pytest.raises(VerificationError):
        store.publish(99)


def test_streamed_files_are_chunked(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text("# T\n\nFirst one. Second one.", encoding="utf-8")
    (folder / "b.txt").write_text(" ", encoding="utf-8")
    seen = []

    def publish(documents, chunks, number):
        seen.append((sorted((r.doc_id, r.error_code) for r in documents.collect()), [r.text for r in chunks.collect()]))

    query = ingest_stream(stream_files(spark, str(folder)), publish, str(tmp_path / "check"))
    query.awaitTermination(60)
    assert not query.exception()
    assert seen == [([("a", None), ("b", "EMPTY_DOCUMENT")], ["First one. Second one."])]
