import os

import pytest

from lectern.llm import queries

TABLES = ("benchmark", "chunks", "citations", "documents", "embedding_cache", "lexical_hits", "passages", "questions", "sentences")


@pytest.fixture(scope="module", params=["empty", "nulls"])
def folder(request, spark, sf, tmp_path_factory):
    """The tables without rows, or with two equal rows of nulls only."""
    root = tmp_path_factory.mktemp(request.param)
    for name in TABLES:
        schema = spark.read.parquet(os.path.join(sf, f"{name}.parquet")).schema
        rows = [] if request.param == "empty" else [tuple(None for _ in schema)] * 2
        for field in schema:
            field.nullable = True
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(root / f"{name}.parquet"))
    return str(root)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables_and_rows_of_nulls(spark, folder, name):
    rows = queries.queries()[name](spark, folder).collect()
    if name in ("p8_ids",):
        assert all(r.ids == [] for r in rows)
    elif name == "p9_cleaned":
        assert all((r.text, r.removed_chars) == (None, 0) for r in rows)
    elif name in ("p2_segments", "p10_statistics"):
        assert len(rows) <= 2
    else:
        assert rows == []
