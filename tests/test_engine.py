import json
import math
import pathlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.config import EngineConfig, Thresholds, load_thresholds, save_thresholds
from lectern.errors import ConfigError
from lectern.functions import text as t
from lectern.operators import answering, chunking, corpus, dense, diff, embedding, fusion, gate, lexical, vector_index
from lectern.operators.requests import request_error
from lectern.plans import evaluation, queries
from lectern.plans.report import render
from lectern.sources.files import parse_files, parse_pages, parse_texts, read_cases, section_rows
from lectern.sources.sections import markdown_sections, text_sections


def test_chunks_are_slices_of_the_expected_windows(spark):
    c = EngineConfig(chunk_target_tokens=20, chunk_hard_max_tokens=40)  # 30 characters, 60 at most, 4 repeated
    texts = ["One. Two! " * 9, "word " * 40, "Short.", "a" * 200 + ". " + "b c. " * 20]
    windows = [
        [(0, 29), (25, 54), (50, 79), (75, 89)],
        [(0, 60), (56, 116), (112, 172), (168, 199)],
        [(0, 6)],
        [(0, 60), (56, 116), (112, 172), (168, 201), (197, 226), (222, 251), (247, 276), (272, 301)],
    ]
    rows = [(i, 0, 0, x.strip(), ["T"], None, None, 1, 1) for i, x in enumerate(texts)] + [(9, 0, 0, " \n", ["T"], None, None, 1, 1)]
    schema = "doc_id int, section_no int, char_start int, body string, section_path array<string>, page_start int, page_end int, line_start int, line_end int"
    got = chunking.chunk_sections(spark.createDataFrame(rows, schema), c).orderBy("doc_id", "ordinal").collect()
    for i, x in enumerate(texts):
        mine = [r for r in got if r.doc_id == i]
        assert [(r.char_start, r.char_end) for r in mine] == windows[i]
        assert [r.ordinal for r in mine] == list(range(len(mine)))
        assert all(x.strip()[r.char_start : r.char_end] == r.text for r in mine)
    assert not [r for r in got if r.doc_id == 9]


def test_sections_of_text_and_markdown():
    text = "a\nb\n\n \nc \n"
    assert [(text[s.char_start : s.char_end], s.line_start, s.line_end) for s in text_sections(text, "x")] == [("a\nb", 1, 2), ("c", 5, 5)]
    md = "# One `x`\n\ntext\nmore\n\n## Two\n- i\n- j\n\n```\n# no\n```\nThree\n=====\nend"
    title, found = markdown_sections(md, "file")
    assert title == "One x"
    assert [(md[s.char_start : s.char_end], s.path) for s in found] == [
        ("text\nmore", ("One x",)), ("- i", ("One x", "Two")), ("- j", ("One x", "Two")), ("```\n# no\n```", ("One x", "Two")), ("end", ("Three",)),
    ]


@pytest.mark.parametrize(
    ("md", "want"),
    [
        ("intro\n\n# A\n\nx\n\n### B\n\ny\n\n## C\nz", [("intro", "file"), ("x", "A"), ("y", "A > B"), ("z", "A > C")]),
        ("### X\na\n## Y\nb", [("a", "X"), ("b", "X > Y")]),
        ("#\ntext", [("text", "Untitled")]),
        ("- a\n  - b\n      - c\n- d\n\n  more of d\n\nend", [("- a", "file"), ("- b", "file"), ("- c", "file"), ("- d", "file"), ("more of d", "file"), ("end", "file")]),
        ("> quoted\n> on\n>\n> # In\n> below\n\nafter", [("> quoted\n> on", "file"), ("> below", "In"), ("after", "In")]),
        ("1. one\n\n   ```sh\n   # no heading\n\n   x\n   ```\n2. two", [("1. one", "file"), ("```sh\n   # no heading\n\n   x\n   ```", "file"), ("2. two", "file")]),
        ("a\n\n    code\n\n    more\n\nb", [("a", "file"), ("code\n\n    more", "file"), ("b", "file")]),
        ("<!-- one\n\ntwo -->\ntext\n\n<div>\nx\n</div>\n\n***\n\n| a | b |\n|---|---|\n| 1 | 2 |", [("<!-- one\n\ntwo -->", "file"), ("text", "file"), ("<div>\nx\n</div>", "file"), ("| a | b |\n|---|---|\n| 1 | 2 |", "file")]),
        ("[a]: http://x \"t\"\n[b]: http://y\n\n[c]: http://z\ntext", [("text", "file")]),
        ("```\nopen", [("```\nopen", "file")]),
        ("a\n-\nb\n~~~\n```\n~~~\nc", [("b", "a"), ("~~~\n```\n~~~", "a"), ("c", "a")]),
        ("", []),
    ],
)
def test_markdown_blocks(md, want):
    _, found = markdown_sections(md, "file")
    assert [(md[s.char_start : s.char_end], " > ".join(s.path)) for s in found] == want


def test_files_give_rows_or_codes(spark):
    files = [
        ("d/A b.md", b"# T\n\nx"), ("b.txt", "﻿one\r\n\r\ntwo".encode()), ("c.txt", b"\xff\xfe"), ("d.pdf", b"%PDF-1.7"),
        ("e.txt", b"%PDF-1.7"), ("f.pdf", b"no"), ("g.txt", b" \n"), ("h.txt", b"x" * 60), ("i.doc", b"x"), ("j.txt", None),
    ]
    df = spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in files], "filename string, content binary")
    got = {r.filename: r for r in parse_files(df, max_bytes=50).collect()}
    codes = {k: v.error_code for k, v in got.items()}
    assert codes == {
        "d/A b.md": None, "b.txt": None, "c.txt": "PARSE_ERROR", "d.pdf": "PARSE_ERROR", "e.txt": "PARSE_ERROR",
        "f.pdf": "UNSUPPORTED_FORMAT", "g.txt": "EMPTY_DOCUMENT", "h.txt": "FILE_TOO_LARGE", "i.doc": "UNSUPPORTED_FORMAT", "j.txt": "EMPTY_DOCUMENT",
    }
    assert got["d/A b.md"].doc_id == "a-b" and got["b.txt"].text == "one\n\ntwo" and len(got["b.txt"].sections) == 2


def test_pages_and_texts(spark):
    pages = spark.createDataFrame([("p", "T", 2, "ﬁne"), ("p", "T", 1, "one"), ("p", "T", 3, " "), ("q", "U", 1, None)], "doc_id string, title string, page_no int, text string")
    got = {r.doc_id: r for r in parse_pages(pages).collect()}
    assert got["p"].text == "one\nfine" and [s.page_start for s in got["p"].sections] == [1, 2]
    assert got["q"].error_code == "NO_TEXT_LAYER"
    docs = spark.createDataFrame([(1, "a\x0cb", "pdf", "T"), (2, None, "md", "T"), (3, "x", None, None)], "id long, text string, format string, title string")
    rows = section_rows(parse_texts(docs, "id", "text", "format", "title")).orderBy("doc_id", "section_no").collect()
    assert [(r.doc_id, r.body, r.page_start) for r in rows] == [(1, "a", 1), (1, "b", 2), (3, "x", None)]


def test_versions(spark):
    v = spark.createDataFrame([("a", 1, "published"), ("a", 2, "staging"), ("b", 1, "published"), ("c", 1, "failed")], "doc_id string, version int, state string")
    seen = {r.doc_id: (r.current_version, r.last_version, r.status) for r in corpus.visible_documents(v).collect()}
    assert seen == {"a": (1, 2, "active"), "b": (1, 1, "active"), "c": (None, 1, "deleted")}
    after = corpus.publish(v, spark.createDataFrame([("a", 2), ("b", 9)], "doc_id string, version int"))
    assert {(r.doc_id, r.version): r.state for r in after.collect()} == {("a", 1): "superseded", ("a", 2): "published", ("b", 1): "published", ("c", 1): "failed"}
    chunks = spark.createDataFrame([("a:v1:0", "a", 1, "en"), ("a:v2:0", "a", 2, "fa"), ("b:v1:0", "b", 1, "en"), ("b:v1:0", "b", 1, "en")], "chunk_id string, doc_id string, doc_version int, language string")
    ids = lambda df: sorted(r.chunk_id for r in df.collect())
    docs = corpus.visible_documents(after)
    assert ids(corpus.eligible_chunks(chunks, docs)) == ["a:v2:0", "b:v1:0"]
    assert ids(corpus.eligible_chunks(chunks, docs, doc_ids=[])) == [] and ids(corpus.eligible_chunks(chunks, docs, language="fa")) == ["a:v2:0"]
    gone = corpus.mark_deleted(docs, spark.createDataFrame([("a",)], "doc_id string"))
    assert ids(corpus.eligible_chunks(chunks, gone)) == ["b:v1:0"] and gone.count() == 3
    ups = spark.createDataFrame([("a", 1), ("a", 2), ("new", 1)], "doc_id string, upload_no int")
    assert sorted((r.doc_id, r.version) for r in corpus.allocate_versions(docs, ups).collect()) == [("a", 3), ("a", 4), ("new", 1)]


def test_diff_keeps_multiplicity_and_ignores_order(spark):
    side = lambda hs: spark.createDataFrame([("d", i, h) for i, h in enumerate(hs)], "doc_id string, ordinal int, chunk_hash string")
    counts = diff.diff_counts(diff.chunk_diff(side("xxyz"), side("zxw"))).first()
    assert (counts.added, counts.reused, counts.removed) == (1, 2, 2)
    a, b = spark.createDataFrame([("1",), ("2",)], "k string"), spark.createDataFrame([("2",), ("3",)], "k string")
    assert sorted(map(tuple, diff.reconcile(a, b, "k").collect())) == [("1", "missing"), ("3", "orphaned")]


def test_batches_keep_their_caps(spark):
    items = spark.createDataFrame([(f"{i:03}", n) for i, n in enumerate([5, 9, 30, 9, 9, None, 1] * 5)], "item string, chars long")
    c = EngineConfig(batch_items=3, batch_chars=20, item_chars=10)
    rows = embedding.plan_batches(items, c).collect()
    sizes = {r.item: r.chars or 0 for r in items.collect()}
    held = {}
    for r in rows:
        assert (r.batch_no is None) == (sizes[r.item] > 10) == (r.error is not None)
        if r.batch_no is not None:
            held.setdefault((r.batch_part, r.batch_no), []).append(sizes[r.item])
    assert len(rows) == 35 and all(len(b) <= 3 and sum(b) <= 20 for b in held.values())


def test_bm25_and_stopwords(spark):
    chunks = spark.createDataFrame([("a", "red fox runs"), ("b", "red dog"), ("c", "blue whale"), ("d", "ERR-404 seen"), ("e", "one more")], "chunk_id string, text string").select("chunk_id", t.tokenize(F.col("text")).alias("tokens"))
    q = spark.createDataFrame([("1", "the red fox"), ("2", "what is the"), ("3", 'err-404" OR * ( )'), ("4", None)], "question_id string, question string")
    found = lexical.bm25(q.withColumn("terms", t.query_terms(t.tokenize(F.col("question")))), chunks).orderBy("question_id", "lexical_rank").collect()
    assert [(r.question_id, r.chunk_id) for r in found] == [("1", "a"), ("1", "b"), ("3", "d")]
    assert found[0].lexical_score == 1.0 and 0 < found[1].lexical_score < 1 and found[0].bm25 < 0


def test_parts_of_tokens(spark):
    chunks = spark.createDataFrame([("a", "err-404 seen"), ("b", "was 404 or 1.1.1"), ("c", "été here"), ("d", "err or 404"), *((f"x{i}", f"word{i}") for i in range(9))], "chunk_id string, text string").select("chunk_id", t.tokenize(F.col("text")).alias("tokens"))
    q = spark.createDataFrame([("1", "404"), ("2", "err-404"), ("3", "ete"), ("4", "1.1"), ("5", "..")], "question_id string, question string")
    asked = q.withColumn("terms", t.query_terms(t.tokenize(F.col("question"))))
    found = {}
    for r in lexical.bm25(asked, chunks, parts=True).collect():
        found.setdefault(r.question_id, set()).add(r.chunk_id)
    assert found == {"1": {"a", "b", "d"}, "2": {"a"}, "3": {"c"}, "4": {"b"}}
    assert {r.chunk_id for r in lexical.bm25(asked.where("question_id = '1'"), chunks).collect()} == {"b", "d"}


def _by_hand(questions, chunks, mean):
    """BM25 of every pair of a question and a chunk that meet, with the best first."""
    df = {}
    for held in chunks.values():
        for term in held:
            df[term] = df.get(term, 0) + 1
    out = {}
    for q, terms in questions.items():
        sums = {}
        for c, held in chunks.items():
            if both := terms & held:
                idf = [math.log((len(chunks) - df[t] + 0.5) / (df[t] + 0.5)) for t in both]
                sums[c] = -sum((x if x > 0 else 1e-6) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(held) / mean)) for x in idf)
        out[q] = sorted((round(s, 9), c) for c, s in sums.items())
    return out


@pytest.mark.parametrize("limit, block", [(7, 500_000), (None, 500_000), (7, 40)])
def test_bm25_of_questions_with_the_same_terms_and_tied_chunks(spark, monkeypatch, limit, block):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    rnd = random.Random(5)
    words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(900)]
    texts = [set(rnd.choices(words, k=rnd.randint(2, 9))) for _ in range(120)]
    chunks = {f"c{i:04}": texts[i % 120] for i in range(600)}
    sets = [frozenset(rnd.choices(words, k=rnd.randint(1, 6))) for _ in range(25)]
    questions = {f"q{i}": sets[i % 25] for i in range(50)}
    asked = spark.createDataFrame([(q, sorted(x)) for q, x in questions.items()], "question_id string, terms array<string>")
    rows = spark.createDataFrame([(c, sorted(x)) for c, x in chunks.items()], "chunk_id string, tokens array<string>")
    found = lexical.bm25(asked, rows, limit)
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan  # no question meets a posting in a join
    got = {}
    for r in found.orderBy("question_id", "lexical_rank").collect():
        got.setdefault(r.question_id, []).append((round(r.bm25, 9), r.chunk_id))
    want = _by_hand(questions, chunks, sum(map(len, chunks.values())) / 600)
    assert {q: [c for _, c in x] for q, x in got.items()} == {q: [c for _, c in x[:limit]] for q, x in want.items()}
    assert all(a[0] == pytest.approx(b[0]) for q in got for a, b in zip(got[q], want[q]))


def test_parts_stand_next_to_each_other_as_often_as_counted(spark):
    rnd = random.Random(8)
    parts = ["1", "2", "11", "a", "b"]
    tokens = lambda: list(dict.fromkeys("-".join(rnd.choices(parts, k=rnd.randint(1, 4))) for _ in range(rnd.randint(1, 5))))
    chunks = {f"c{i:03}": tokens() for i in range(80)}
    questions = {f"q{i}": tokens()[:3] for i in range(30)} | {"q0": ["1-1", "1.1", "z"]}
    rows = spark.createDataFrame(list(chunks.items()), "chunk_id string, tokens array<string>")
    found = lexical.bm25(spark.createDataFrame(list(questions.items()), "question_id string, terms array<string>"), rows, 10, parts=True)
    assert "MapInArrow" in found._jdf.queryExecution().toString()  # no question meets a posting in a join
    lines = {c: [p for x in held for p in x.split("-")] for c, held in chunks.items()}
    mean = sum(map(len, lines.values())) / len(lines)
    times = lambda line, sought: sum(line[i : i + len(sought)] == sought for i in range(len(line)))
    want = []
    for q, terms in questions.items():
        sums = {}
        for term in set(terms):
            sought = term.replace(".", "-").split("-")
            held = {c: n for c, line in lines.items() if (n := times(line, sought))}
            idf = max(math.log((len(lines) - len(held) + 0.5) / (len(held) + 0.5)), 0) or 1e-6
            for c, n in held.items():
                sums[c] = sums.get(c, 0) - idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(lines[c]) / mean))
        want += [(q, k + 1, c, pytest.approx(s, abs=2e-9)) for k, (s, c) in enumerate(sorted((round(s, 9), c) for c, s in sums.items())[:10])]
    assert sorted((r.question_id, r.lexical_rank, r.chunk_id, r.bm25) for r in found.collect()) == sorted(want, key=lambda x: x[:2])


def test_requests_have_bounds(spark):
    rows = [("ok", "what pump", 5, "en"), ("null", None, 5, "en"), ("long", "x" * 2001, 5, "en"), ("none", "", 5, None), ("top", "pump", 51, None), ("lang", "pump", None, "de"), ("stop", "the of", None, None)]
    df = spark.createDataFrame(rows, "id string, q string, k int, l string").withColumn("terms", t.query_terms(t.tokenize(F.col("q"))))
    got = {r.id: r.e for r in df.select("id", request_error(F.col("q"), F.col("terms"), F.col("k"), F.col("l")).alias("e")).collect()}
    bad = dict.fromkeys(("null", "long", "none", "top", "lang"), "VALIDATION_ERROR")
    assert got == {"ok": None, "stop": "INVALID_QUESTION"} | bad


def test_evaluation_of_cases(spark):
    golds = spark.createDataFrame([("a", 0, "d", "red"), ("a", 1, "e", "blue"), ("b", 0, "d", "green"), ("c", 0, "f", "x")], "case_id string, gold_id int, doc string, phrase string")
    found = spark.createDataFrame([("a", 1, "d", "a red fox"), ("a", 2, "d", "blue"), ("a", 3, "e", "so blue"), ("b", 7, "d", "green")], "case_id string, rank int, doc string, text string")
    cited = spark.createDataFrame([("a", "d", "a red fox"), ("b", "d", "grey"), ("c", "g", "y")], "case_id string, doc string, excerpt string")
    ranks = evaluation.gold_ranks(golds, found)
    assert {(r.case_id, r.gold_id): r["rank"] for r in ranks.collect()} == {("a", 0): 1, ("a", 1): 3, ("b", 0): 7, ("c", 0): None}
    assert {r.case_id: (r.golds, r.quoted) for r in evaluation.gold_quoted(golds, cited).collect()} == {"a": (2, 1), "b": (1, 0), "c": (1, 0)}
    causes = {(r.case_id, r.gold_id): r.cause for r in evaluation.missed_golds(golds, ranks, cited).collect()}
    assert causes == {("a", 1): "retrieval", ("b", 0): "truncation", ("c", 0): "retrieval"}
    cases = spark.createDataFrame([(True, True, 3, 2, 1), (True, False, None, 1, 0), (False, True, None, 0, 0), (False, False, None, 0, 0)], "answerable boolean, answered boolean, hit_rank int, golds long, quoted long")
    m = evaluation.case_metrics(cases).first()
    assert (m.recall_1, m.recall_3, m.answered_rate, m.false_rate, m.false_answers, m.quoted_share, m.fully_quoted) == (0, 0.5, 0.5, 0.5, 1, 0.5, 0)
    assert m.mrr_5 == pytest.approx(1 / 6)
    none = evaluation.case_metrics(cases.where("false")).first()
    assert (none.recall_1, none.quoted_share, none.answerable_cases) == (0, 0, 0)
    text = render("Run", {"Metrics": evaluation.case_metrics(cases), "Leaks": ranks.where("false")}, ["one | note"])
    assert text.startswith("# Run\n\n## Metrics\n\n| answerable_cases |") and "## Leaks\n\nNone." in text


def test_vector_index(spark):
    old = spark.createDataFrame([("a", "m", 2, [1.0, 0.0]), ("b", "m", 2, [0.0, 1.0]), ("a", "n", 3, [1.0, 0.0, 0.0])], "chunk_id string, model_id string, dim int, vector array<double>")
    fresh = spark.createDataFrame([("b", [5.0, 5.0]), ("c", [1.0]), ("d", None), (None, [1.0, 1.0]), ("e", [float("nan"), 1.0]), ("f", [2.0, 2.0])], "chunk_id string, vector array<double>")
    after = vector_index.upsert_vectors(old, fresh, "m", 2)
    assert sorted((r.chunk_id, r.model_id, r.vector[0]) for r in after.collect()) == [("a", "m", 1.0), ("a", "n", 1.0), ("b", "m", 5.0), ("f", "m", 2.0)]
    assert sorted((r.chunk_id or "", r.length) for r in vector_index.misfits(fresh, 2).collect() if r.length) == [("", 2), ("c", 1), ("e", 2)]
    gone = vector_index.delete_vectors(after, spark.createDataFrame([("a",), ("zz",)], "chunk_id string"))
    assert sorted(r.chunk_id for r in gone.collect()) == ["b", "f"]
    asked = spark.createDataFrame([("a",), ("x",)], "chunk_id string")
    assert {r.chunk_id: r.present for r in vector_index.presence(asked, after, "m").collect()} == {"a": True, "x": False}
    assert vector_index.open_collection(after, "m", 2).count() == 3 and vector_index.open_collection(after, "new", 9).count() == 0
    with pytest.raises(ConfigError):
        vector_index.open_collection(after, "m", 3)


def test_cases_are_read(spark, tmp_path):
    path = tmp_path / "cases.jsonl"
    path.write_text('{"id": "1", "question": "q", "split": "dev", "gold": [{"doc": "d", "must_contain": "x"}]}\n{"id": "2", "absent": "none"}\n', encoding="utf-8")
    got = {r.id: r for r in read_cases(spark, str(path)).collect()}
    assert got["1"].gold[0].must_contain == "x" and got["2"].gold is None and got["2"].absent == "none"


def test_cosine(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0])], "id int, vector array<float>")
    q = spark.createDataFrame([(1, [3.0, 0.0])], "query_id int, vector array<float>")
    assert [(r.id, r.similarity) for r in dense.cosine_topk(q, rows, 3).orderBy("dense_rank").collect()] == [(1, 1.0), (2, 1.0), (3, 0.0)]
    assert dense.cosine_topk(q.where("false"), rows, 3).count() == 0


def test_cosine_of_many_queries_with_ties_in_bounded_memory(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows, queries = rng.integers(-2, 3, (90, 4)).astype(float)[rng.integers(0, 90, 4000)], rng.normal(size=(2000, 4))
    monkeypatch.setattr(dense, "ID_ROWS", 900)
    ids, names = pa.array([f"r{i:04}" for i in range(4000)]), pa.array(np.arange(2000))
    batches = [pa.RecordBatch.from_arrays([ids[a : a + 1000], pa.array(list(rows[a : a + 1000]))], ["id", "vector"]) for a in range(0, 4000, 1000)]
    monkeypatch.setattr(dense, "PRODUCTS", 50_000)
    unit = lambda x: np.divide(x, n := np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=n > 0)
    tracemalloc.start()
    found = pa.Table.from_batches(dense._nearest(iter(batches), names, unit(queries), 25))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6 < 2000 * 1000 * 8 * 2  # all products of one batch are 16 MB, and were held more than once
    s = np.round(unit(queries) @ unit(rows).T, 9)
    got = {}
    for q, i in zip(found["query_id"].to_pylist(), found["id"].to_pylist(), strict=True):
        got.setdefault(q, set()).add(i)
    assert all(got[q] == {f"r{i:04}" for i in np.lexsort((np.arange(4000), -s[q]))[:25]} for q in range(2000))


@pytest.mark.parametrize("name", ["answers", "answers_debug"])
def test_questions_of_one_text_get_the_same_answer(spark, sf, tmp_path, name):
    folder = tmp_path / "t"
    folder.mkdir()
    for path in pathlib.Path(sf).iterdir():
        if path.name != "questions.parquet":
            (folder / path.name).symlink_to(path)
    asked = spark.read.parquet(f"{sf}/questions.parquet")
    twice = asked.unionByName(asked.withColumn("question_id", F.concat(F.lit("z"), "question_id")))
    none = asked.limit(1).withColumns({"question_id": F.explode(F.array(F.lit("n1"), F.lit("n2"))), "question": F.lit(None).cast("string")})
    twice.unionByName(none).write.parquet(str(folder / "questions.parquet"))
    terms = []
    keep = lexical.bm25
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lexical, "bm25", lambda questions, *a, **k: terms.append(questions.count()) or keep(questions, *a, **k))
        got = {r.question_id: r.asDict(recursive=True) for r in queries.queries()[name](spark, str(folder)).collect()}
    texts = {r.question_id: r.question for r in asked.collect()}
    assert terms == [len(set(texts.values()))]  # each text is searched for once
    for q in texts:
        assert got[q] == got[f"z{q}"] | {"question_id": q}
    assert set(got) == {*texts, *(f"z{q}" for q in texts), "n1", "n2"} and got["n1"]["status"] == got["n2"]["status"] == "invalid_question"


def test_fusion(spark):
    near = spark.createDataFrame([("q", "a", 1, 0.9), ("q", "b", 2, 0.8)], "question_id string, chunk_id string, dense_rank int, similarity double")
    words = spark.createDataFrame([("q", "b", 1, -3.0, 1.0), ("q", "c", 2, -1.0, 0.3)], "question_id string, chunk_id string, lexical_rank int, bm25 double, lexical_score double")
    got = fusion.fuse(near, words, 0.5, 0.5).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a", "c"] and abs(got[0].score - (0.5 / 62 + 0.5 / 61)) < 1e-12
    assert [r.chunk_id for r in fusion.fuse(near, words, 0, 1).orderBy("rank").collect()] == ["b", "c"]
    with pytest.raises(ConfigError):
        fusion.fuse(near, words, k=0)


def test_gate_bars_are_inclusive(spark):
    cases = [("a", 0.54, 0.4, 3), ("b", 0.539, 0.4, 3), ("c", 0.0, 0.75, 1), ("d", 1.0, 0.39, 1), ("e", 1.0, 1.0, 0)]
    df = spark.createDataFrame([(q, d, 0.0, c, 0.0, n) for q, d, c, n in cases], "question_id string, max_dense double, lexical double, token_coverage double, overlap double, candidate_count int")
    assert {r.question_id: r.reason for r in gate.verdict(df).collect()} == {"a": "dense+coverage", "b": "below_threshold", "c": "exact_terms", "d": "below_threshold", "e": "below_threshold"}


def test_answers_quote_and_refuse(spark):
    chunks = spark.createDataFrame(
        [("d:v1:0", "d", 1, 0, "The pump stops at noon. Nobody knows why. The pump starts at two.", ["Manual", "Pump"], 10, None, 3, 4), ("d:v1:1", "d", 1, 1, "Cats sleep.", [], 80, 2, 5, None)],
        "chunk_id string, doc_id string, doc_version int, ordinal int, text string, section_path array<string>, char_start int, page_start int, line_start int, line_end int",
    )
    chunks = chunks.withColumn("document", F.lit("manual.md"))
    asked = spark.createDataFrame([("1", "When does the pump stop at noon?"), ("2", "Who sings?"), ("3", "?")], "question_id string, question string").withColumn("terms", t.query_terms(t.tokenize(F.col("question"))))
    top = spark.createDataFrame([("1", "d:v1:0", 1, 0.01), ("1", "d:v1:1", 2, 0.009), ("2", "d:v1:1", 1, 0.01)], "question_id string, chunk_id string, rank int, score double")
    top = top.join(chunks.select("chunk_id", "text", t.tokenize(F.col("text")).alias("tokens")), "chunk_id")
    judged = gate.verdict(spark.createDataFrame([("1", 0.9, 1.0, 0.8, 1.0, 2), ("2", 0.1, 0.0, 0.0, 0.0, 1)], "question_id string, max_dense double, lexical double, token_coverage double, overlap double, candidate_count int"))
    terms = asked.select("question_id", F.explode("terms").alias("term"))
    got = {r.question_id: r for r in answering.build_answers(asked, top, terms, chunks, judged).collect()}
    assert got["1"].answer == "The pump stops at noon. [1] The pump starts at two. [1]" and got["1"].status == "answered"
    assert got["1"].citations[0].excerpt.startswith("The pump") and got["1"].citations[0].char_span == [10, 75]
    shown = got["1"].citations[0]
    assert (shown.document, shown.section, shown.page, shown.lines, shown.score) == ("manual.md", "Manual > Pump", None, [3, 4], 0.01)
    assert got["2"].status == "insufficient_information" and got["2"].reason == "below_threshold" and got["2"].segments is None
    assert got["3"].status == "invalid_question"
    nobody = answering.build_answers(asked, top.where("false"), terms, chunks.where("false"), judged.where("false"), empty=True).collect()
    assert {(r.question_id, r.status, r.reason) for r in nobody} == {("1", "insufficient_information", "empty_knowledge_base"), ("2", "insufficient_information", "empty_knowledge_base"), ("3", "invalid_question", "empty_knowledge_base")}
    window = top.select("*", *(F.lit(0.5).alias(c) for c in ("similarity", "bm25", "lexical_score", "token_coverage")), *(F.lit(1).alias(c) for c in ("dense_rank", "lexical_rank")))
    debug = answering.debug_records(window, judged)
    told = {r.question_id: r.debug for r in answering.build_answers(asked, top, terms, chunks, judged, debug=debug).collect()}
    assert [c.chunk_id for c in told["1"].candidates] == ["d:v1:0", "d:v1:1"] and told["2"].gate.reason == "below_threshold" and told["3"] is None


def test_neighbouring_spans_merge(spark):
    picked = spark.createDataFrame([("q", "c", 1, 0, 4), ("q", "c", 1, 5, 9), ("q", "c", 1, 12, 14)], "question_id string, chunk_id string, rank int, start int, end int")
    texts = spark.createDataFrame([("c", "One. Two. x Six")], "chunk_id string, text string")
    assert sorted((r.start, r.end) for r in answering.merge_spans(picked, texts).collect()) == [(0, 9), (12, 14)]


def test_hit_rank_and_choice(spark):
    ranks = spark.createDataFrame([("a", 0, 2), ("a", 0, 5), ("a", 1, 3), ("b", 0, None)], "case_id string, gold_id int, rank int")
    assert {r.case_id: r.hit_rank for r in evaluation.hit_ranks(ranks).collect()} == {"a": 3, "b": None}
    signals = spark.createDataFrame([(True, 0.8, 0.5), (True, 0.2, 0.9), (False, 0.9, 0.2), (False, 0.1, 0.5)], "answerable boolean, max_dense double, token_coverage double")
    grid = evaluation.grid_search(signals, evaluation.lattice(spark))
    best = evaluation.choose(grid).first()
    assert (best.answered, best.answerable, best.false_answers) == (2, 2, 0)
    assert best.min_coverage_high >= best.min_coverage


def test_thresholds(tmp_path):
    path = str(tmp_path / "t.json")
    assert load_thresholds(path, "m") == Thresholds(model_id="m")
    save_thresholds(path, Thresholds(model_id="m", min_dense=0.6))
    assert load_thresholds(path, "m").min_dense == 0.6 and json.load(open(path))["version"] == 1
    with pytest.raises(ConfigError):
        load_thresholds(path, "other")
    with pytest.raises(ConfigError):
        Thresholds(min_coverage=0.8, min_coverage_high=0.7)
    with pytest.raises(ConfigError):
        EngineConfig(top_k=0)
