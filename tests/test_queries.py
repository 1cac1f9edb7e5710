import pytest

import __spark_entry__ as entry
from lectern.plans import queries as core


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(core.queries()) <= set(entry.queries())


def test_core_does_not_import_the_training_data_operators():
    import pathlib

    root = pathlib.Path(core.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "lectern.llm" not in path.read_text(encoding="utf-8"), path


@pytest.mark.parametrize("name", ["visible_documents", "chunk_diff", "rrf_fuse", "p6_found"])
def test_against_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("chunks", "document_versions", "lexical_hits", "citations", "eligible_snapshots"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = core.queries()[name](spark, sf).toPandas()
    want = con.sql(core.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    text = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy()))
    assert text(got) == text(want)


def test_latency_percentiles_hold_no_group_in_one_task(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    got = core.queries()["latency_percentiles"](spark, sf)
    plan = got._jdf.queryExecution().toString()
    assert "collect_list(" not in plan and "median(" not in plan
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(core.oracle_sql()["latency_percentiles"]).fetchall())


def test_median_and_percentile_of_any_groups(spark):
    import math
    import random
    from statistics import median

    from lectern.plans import evaluation

    rnd = random.Random(1)
    groups = {None: [1.0, 2.0], "one": [3.0], "even": [rnd.random() for _ in range(40)], "same": [rnd.choice([1.0, 2.0, 5.0]) for _ in range(301)]}
    rows = [(g, v) for g, values in groups.items() for v in [*values, None]] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.median, r.percentile) for r in evaluation.median_and_percentile(df, "g", "v", 0.95).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g] == (pytest.approx(median(values)), sorted(values)[min(len(values) - 1, math.floor(len(values) * 0.95))])
    assert evaluation.median_and_percentile(df.where("false"), "g", "v", 0.95).count() == 0


def test_hash_embedding_of_all_chunks(spark, sf):
    import os

    got = core.queries()["hash_embedding_chunks"](spark, sf).collect()
    chunks = spark.read.parquet(os.path.join(sf, "chunks.parquet")).select("chunk_id", "text").distinct()
    assert sorted(r.chunk_id for r in got) == sorted(r.chunk_id for r in chunks.collect())
    assert all(len(r.vector) == 32 for r in got)


def test_chunk_sizes_agree_with_the_windows(spark, sf):
    sweep = {r.config: r for r in core.queries()["chunk_size_sweep"](spark, sf).collect()}
    windows = [r.char_end - r.char_start for r in core.queries()["chunk_windows"](spark, sf).collect()]
    assert (sweep[0].chunks, sweep[0].chars, sweep[0].longest) == (len(windows), sum(windows), max(windows))
    assert sweep[0].chunks > sweep[1].chunks > sweep[2].chunks and [sweep[i].longest for i in range(3)] <= [180, 360, 1050]
