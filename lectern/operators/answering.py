"""Answers made of verbatim sentences with citations, or an honest refusal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as t
from lectern.operators.gate import evidence_score

# What is said instead of an answer.
REFUSALS = {
    "en": "Not enough information in the provided documents.",
    "fa": "اطلاعات کافی در اسناد ارائه‌شده وجود ندارد.",
}
#: Weight of a chunk's score against the overlap of a sentence.
CHUNK_WEIGHT = 0.10
BLANK = r"^[\s\p{Z}]*$"


def answer_language(question: Column) -> Column:
    """``fa`` for a question in the Arabic script alone, else ``en``."""
    return F.when(t.detect_language(question) == "fa", "fa").otherwise("en")


def candidate_idf(top: DataFrame, terms: DataFrame) -> DataFrame:
    """(question_id, term, idf) over the chunks given for a question: 1 + ln(chunks / chunks with the term), at least 1;
    only terms that occur. top has question_id, chunk_id and tokens, terms has question_id and term."""
    n = top.groupBy("question_id").agg(F.count_distinct("chunk_id").alias("n"))
    held = top.select("question_id", "chunk_id", F.explode("tokens").alias("term"))
    df = held.join(terms, ["question_id", "term"]).groupBy("question_id", "term").agg(F.count_distinct("chunk_id").alias("df"))
    return df.join(n, "question_id").select("question_id", "term", F.greatest(F.lit(1.0), F.log(F.col("n") / F.col("df")) + 1).alias("idf"))


def select_sentences(top: DataFrame, terms: DataFrame, least_overlap: float = 0.15, budget: int = 5) -> DataFrame:
    """(question_id, chunk_id, rank, position, start, end, sentence, sentence_score): the sentences quoted for a question.

    top has question_id, chunk_id, rank, score, text and tokens. A sentence's overlap is the share of the terms' weight that
    it holds; below the bar it is out. Chunks spend the budget in their order, within a chunk the best sentences first.
    """
    weights = terms.join(candidate_idf(top, terms), ["question_id", "term"], "left").select("question_id", "term", F.coalesce("idf", F.lit(1.0)).alias("idf"))
    total = weights.groupBy("question_id").agg(F.sum("idf").alias("all_idf"))
    cut = top.select("question_id", "chunk_id", "rank", "score", F.posexplode(t.sentence_spans(F.col("text"))).alias("position", "s"))
    keys = ["question_id", "chunk_id", "position"]
    sentences = cut.select(*keys, "rank", "score", "s.start", "s.end", F.col("s.text").alias("sentence"))
    words = sentences.select(*keys, F.explode(t.tokenize(F.col("sentence"))).alias("term"))
    held = words.join(weights, ["question_id", "term"]).groupBy(*keys).agg(F.sum("idf").alias("held_idf"))
    scored = sentences.join(held, keys).join(total, "question_id").withColumn("overlap", F.col("held_idf") / F.col("all_idf"))
    kept = scored.where(F.round("overlap", 9) >= least_overlap).withColumn("sentence_score", F.col("overlap") + CHUNK_WEIGHT * F.col("score"))
    inside = Window.partitionBy("question_id", "chunk_id").orderBy(F.desc(F.round("sentence_score", 9)), "position")
    across = Window.partitionBy("question_id").orderBy("rank", "nth")
    picked = kept.withColumn("nth", F.row_number().over(inside)).where(F.col("nth") <= budget)
    picked = picked.withColumn("spent", F.row_number().over(across)).where(F.col("spent") <= budget)
    return picked.select(*keys, "rank", "start", "end", "sentence", "sentence_score")


def fallback_sentences(top: DataFrame, picked: DataFrame, budget: int = 5) -> DataFrame:
    """The first sentences of the best chunk, as one span, for questions of which no sentence was picked."""
    lacking = top.where(F.col("rank") == 1).join(picked.select("question_id").distinct(), "question_id", "left_anti")
    spans = F.slice(t.sentence_spans(F.col("text")), 1, budget)
    held = lacking.select("question_id", "chunk_id", "rank", "text", spans.alias("spans")).where(F.size("spans") > 0)
    start, end = F.col("spans")[0]["start"], F.element_at("spans", -1)["end"]
    return held.select("question_id", "chunk_id", "rank", start.alias("start"), end.alias("end"))


def merge_spans(picked: DataFrame, texts: DataFrame) -> DataFrame:
    """(question_id, chunk_id, rank, start, end): neighbouring spans with only white space between them become one.

    texts has chunk_id and text.
    """
    order = Window.partitionBy("question_id", "chunk_id").orderBy("start")
    gap = F.substring("text", F.col("before") + 1, F.col("start") - F.col("before"))
    joined = picked.select("question_id", "chunk_id", "rank", "start", "end").join(texts.select("chunk_id", "text"), "chunk_id")
    marked = joined.withColumn("before", F.lag("end").over(order)).withColumn(
        "fresh", F.when(F.col("before").isNull() | ~F.regexp_like(gap, F.lit(BLANK)), 1).otherwise(0)
    )
    islands = marked.withColumn("island", F.sum("fresh").over(order))
    return islands.groupBy("question_id", "chunk_id", "island").agg(
        F.min("rank").alias("rank"), F.min("start").alias("start"), F.max("end").alias("end")
    ).drop("island")


def quoted_slices(top: DataFrame, terms: DataFrame, chunks: DataFrame, least_overlap: float = 0.15, budget: int = 5) -> DataFrame:
    """(question_id, citation_id, chunk_id, start, end, slice): what is quoted for each question, numbered by document, version and
    ordinal of the chunks, so that the numbers do not hang on the ranking."""
    picked = select_sentences(top, terms, least_overlap, budget).select("question_id", "chunk_id", "rank", "start", "end")
    spans = merge_spans(picked.unionByName(fallback_sentences(top, picked, budget)), chunks)
    laid = spans.join(chunks.select("chunk_id", "doc_id", "doc_version", "ordinal", "text"), "chunk_id")
    number = F.dense_rank().over(Window.partitionBy("question_id").orderBy("doc_id", "doc_version", "ordinal", "chunk_id"))
    slice_ = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    return laid.select("question_id", number.alias("citation_id"), "chunk_id", "start", "end", slice_.alias("slice"))


def citation_record() -> Column:
    """Struct of a citation: where the chunk stands, by breadcrumb, page and lines, and all of its text. Lines come in pairs or not at all."""
    lines = F.when(F.col("line_start").isNotNull() & F.col("line_end").isNotNull(), F.array("line_start", "line_end"))
    return F.struct(
        "citation_id", "doc_id", "document", "doc_version", F.array_join("section_path", " > ").alias("section"), F.col("page_start").alias("page"),
        lines.alias("lines"), "chunk_id", F.array(F.col("char_start"), F.col("char_start") + F.length("text")).alias("char_span"),
        F.col("text").alias("excerpt"), F.round("score", 4).alias("score"),
    )


def debug_records(window: DataFrame, gate: DataFrame) -> DataFrame:
    """(question_id, debug): the gate's signals and verdict, and the scores of all candidates in their order."""
    r = lambda c, n: F.round(c, n).alias(c)
    candidate = F.struct(
        "rank", "chunk_id", r("score", 6), "similarity", "bm25", "lexical_score", r("token_coverage", 4), "dense_rank", "lexical_rank"
    )
    lists = window.groupBy("question_id").agg(F.array_sort(F.collect_list(candidate)).alias("candidates"))  # at most the window of each question
    signals = [r(c, 4) for c in ("max_dense", "lexical", "token_coverage", "overlap")]
    judged = gate.select("question_id", F.struct("passed", "reason", *signals, "candidate_count").alias("gate"))
    return judged.join(lists, "question_id", "left").select("question_id", F.struct("gate", "candidates").alias("debug"))


def build_answers(
    questions: DataFrame, top: DataFrame, terms: DataFrame, chunks: DataFrame, gate: DataFrame, least_overlap: float = 0.15, budget: int = 5,
    empty: bool = False, debug: DataFrame | None = None,
) -> DataFrame:
    """One row per question: question_id, status, answer, segments, citations, evidence_score, reason, language, and debug if given.

    questions has question_id, question and terms, and error_code where a request is not valid; chunks has chunk_id, doc_id, document,
    doc_version, ordinal, section_path, page_start, line_start, line_end, char_start and text. Slices are quoted verbatim in the order
    of the documents, each with the number of its citation. A question without terms is invalid, one that the gate refuses, or that has no
    candidates, gets the refusal of its language; ``empty`` says that there is no chunk at all.
    """
    passed = gate.where("passed").select("question_id")
    slices = quoted_slices(top.join(passed, "question_id", "left_semi"), terms, chunks, least_overlap, budget)
    places = chunks.select("chunk_id", "doc_id", "document", "doc_version", "section_path", "page_start", "line_start", "line_end", "char_start", "text")
    laid = slices.join(places, "chunk_id").join(top.select("question_id", "chunk_id", "score"), ["question_id", "chunk_id"])
    segment = F.struct("citation_id", "start", "end", F.col("slice").alias("text"))
    built = laid.groupBy("question_id").agg(
        F.array_sort(F.collect_list(segment)).alias("segments"),  # at most the budget
        F.array_sort(F.collect_set(citation_record())).alias("citations"),
    )
    rendered = F.array_join(F.transform("segments", lambda s: F.concat(s["text"], F.lit(" ["), s["citation_id"], F.lit("]"))), " ")
    judged = questions.join(gate.withColumn("evidence", evidence_score()), "question_id", "left").join(built, "question_id", "left")
    if debug is not None:
        judged = judged.join(debug, "question_id", "left")
    language = answer_language(F.col("question"))
    refusal = F.when(language == "fa", REFUSALS["fa"]).otherwise(REFUSALS["en"])
    invalid = F.coalesce(F.size("terms") == 0, F.lit(True))
    if "error_code" in questions.columns:
        invalid = invalid | F.col("error_code").isNotNull()
    answered = F.col("segments").isNotNull() & ~invalid
    missing = F.lit("empty_knowledge_base" if empty else "no_relevant_content")
    return judged.select(
        "question_id",
        F.when(invalid, "invalid_question").when(answered, "answered").otherwise("insufficient_information").alias("status"),
        F.when(answered, rendered).otherwise(refusal).alias("answer"),
        F.when(answered, F.col("segments")).alias("segments"),
        F.when(answered, F.col("citations")).alias("citations"),
        F.when(answered, F.round("evidence", 4)).otherwise(0.0).alias("evidence_score"),
        F.when(answered, F.lit(None)).otherwise(F.coalesce("reason", missing)).alias("reason"),
        language.alias("language"),
        *(["debug"] if debug is not None else []),
    )


def verify_citations(excerpts: DataFrame, chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """(question_id, citation_no, problem) of citations whose excerpt is not their chunk's text, or whose chunk is not the slice of
    the source that it names. No rows: all are verbatim. Of repeated rows of a chunk or version the greatest text counts."""
    source = versions.groupBy("doc_id", F.col("version").alias("doc_version")).agg(F.max("source_text").alias("source_text"))
    held = chunks.groupBy("chunk_id").agg(F.max("text").alias("text"))
    rows = excerpts.select("question_id", "citation_no", "chunk_id", "doc_id", "doc_version", "char_start", "char_end", "excerpt").distinct()
    joined = rows.join(held, "chunk_id", "left").join(source, ["doc_id", "doc_version"], "left")
    slice_ = F.substring("source_text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    problem = (
        F.when(F.col("text").isNull(), "no_chunk")
        .when(~F.col("excerpt").eqNullSafe(F.col("text")), "excerpt_differs")
        .when(~slice_.eqNullSafe(F.col("text")), "slice_differs")
    )
    return joined.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("question_id", "citation_no", "problem")
