"""Queries of the training-data operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.contamination import leaked_items, without_leaks
from lectern.llm.encoding import encode_texts
from lectern.llm.language import label_languages, train, wrong_labels
from lectern.llm.neighbours import latest_vectors, mutual_pairs, nearest_vectors, usable_vectors
from lectern.llm.packing import pack
from lectern.llm.quality import text_quality
from lectern.llm.quality import train as train_quality
from lectern.llm.ranking import best_of_group, ideal_point_closeness, merge_scores
from lectern.llm.sentences import split_sentences
from lectern.llm.skeleton import look_alike_pairs, look_classes
from lectern.plans.registry import Query, Registry
from lectern.session import table

LLM = Registry()

REQUEST_CHARS = 4_000


@LLM.query("p1_requests")
def p1_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Embedding requests of 4,000 characters for the distinct embedding inputs of the chunks."""
    inputs = (
        table(spark, folder, "chunks").groupBy("embed_input_hash").agg(F.max(F.length("text")).alias("chars"))
    )
    packed = pack(inputs, "embed_input_hash", F.col("chars"), REQUEST_CHARS)
    return packed.select("embed_input_hash", F.col("container").alias("request_no"), F.col("piece").alias("piece_no"))


@LLM.query("p2_found")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The languages of every chunk whose stored language is absent or does not fit its text."""
    chunks = table(spark, folder, "chunks")
    model = train(chunks, "text", "language", "chunk_id")
    return wrong_labels(label_languages(chunks, "chunk_id", "text", "language", model), "chunk_id")


@LLM.query("p2_segments")
def p2_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Language and confidence of every chunk, and of every segment of a mixed one."""
    chunks = table(spark, folder, "chunks").dropDuplicates(["chunk_id"])
    model = train(chunks, "text", "language", "chunk_id")
    labelled = label_languages(chunks, "chunk_id", "text", "language", model)
    return labelled.select(
        "chunk_id", F.col("language").alias("chunk_language"), F.col("confidence").alias("chunk_confidence"),
        F.inline_outer("segments"),
    )


@LLM.query("p3_found")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of every passage."""
    sentences = split_sentences(table(spark, folder, "passages"), "passage_id", "text")
    return sentences.select("passage_id", "char_start", "char_end").distinct()


def _nearest(spark: SparkSession, folder: str, least: float = -1.0) -> DataFrame:
    good = usable_vectors(table(spark, folder, "embedding_cache"), "model_id", "input_hash", "vector", "dim", "created_at")
    return nearest_vectors(latest_vectors(good), least=least, like=good)


@LLM.query("p4_found")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of input hashes, each among the five most similar of the other, with a cosine of 0.95 or more.

    The comparison leaves room for the rounding of single precision.
    """
    pairs = mutual_pairs(_nearest(spark, folder, 0.95 - 1e-6), 0.95 - 1e-6)
    return pairs.select(F.col("space").alias("model_id"), F.col("a").alias("input_hash_a"), F.col("b").alias("input_hash_b"))


@LLM.query("p4_neighbours")
def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar other vectors of every usable vector, within its model."""
    nearest = _nearest(spark, folder)
    return nearest.select(F.col("space").alias("model_id"), F.col("key").alias("input_hash"), "rank", F.col("other").alias("other_hash"), "similarity")


P5_SQL = """
WITH scored AS (
  SELECT question_id, chunk_id, max(b) AS b, max(l) AS l, max(s) AS s FROM (
    SELECT question_id, chunk_id, CASE WHEN isnan(bm25) THEN NULL ELSE -bm25 END AS b,
           CASE WHEN isnan(lexical_score) THEN NULL ELSE lexical_score END AS l, NULL::DOUBLE AS s FROM lexical_hits
    UNION ALL
    SELECT question_id, chunk_id, NULL, NULL, CASE WHEN isnan(score) THEN NULL ELSE score END FROM citations)
  WHERE question_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL
), bounds AS (
  SELECT question_id, quantile_disc(b, 0.05) AS b0, quantile_disc(b, 0.95) AS b1, quantile_disc(l, 0.05) AS l0,
         quantile_disc(l, 0.95) AS l1, quantile_disc(s, 0.05) AS s0, quantile_disc(s, 0.95) AS s1
  FROM scored GROUP BY question_id
), shifted AS (
  SELECT question_id, chunk_id,
         CASE WHEN b IS NULL THEN 0 ELSE least(greatest(b, b0), b1) - b0 END AS b,
         CASE WHEN l IS NULL THEN 0 ELSE least(greatest(l, l0), l1) - l0 END AS l,
         CASE WHEN s IS NULL THEN 0 ELSE least(greatest(s, s0), s1) - s0 END AS s
  FROM scored JOIN bounds USING (question_id)
), normed AS (
  SELECT question_id, chunk_id, coalesce(b / nullif(bn, 0), 0) AS b, coalesce(l / nullif(ln, 0), 0) AS l,
         coalesce(s / nullif(sn, 0), 0) AS s, coalesce(bm / nullif(bn, 0), 0) AS bi,
         coalesce(lm / nullif(ln, 0), 0) AS li, coalesce(sm / nullif(sn, 0), 0) AS si
  FROM shifted JOIN (
    SELECT question_id, sqrt(sum(b * b)) AS bn, sqrt(sum(l * l)) AS ln, sqrt(sum(s * s)) AS sn,
           max(b) AS bm, max(l) AS lm, max(s) AS sm FROM shifted GROUP BY question_id) USING (question_id)
), close AS (
  SELECT question_id, chunk_id,
         sqrt(b * b + l * l + s * s) AS far,
         sqrt((bi - b) * (bi - b) + (li - l) * (li - l) + (si - s) * (si - s)) AS near FROM normed
), ranked AS (
  SELECT question_id, chunk_id, row_number() OVER (
    PARTITION BY question_id ORDER BY round(coalesce(far / nullif(far + near, 0), 0), 12) DESC, chunk_id) AS rank FROM close
)
SELECT question_id, chunk_id FROM ranked
JOIN (SELECT question_id, max(top_n) AS top_n FROM questions GROUP BY question_id) USING (question_id)
WHERE rank <= top_n
"""


@LLM.query("p5_found", P5_SQL)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The first top_n chunks of every question when bm25, lexical_score and score have the same say."""
    hits, citations = table(spark, folder, "lexical_hits"), table(spark, folder, "citations")
    scored = merge_scores(
        [
            (hits, {"bm25": -F.col("bm25"), "lexical_score": F.col("lexical_score")}),
            (citations, {"score": F.col("score")}),
        ],
        "question_id",
        "chunk_id",
    )
    close = ideal_point_closeness(
        scored, "question_id", "chunk_id", {"bm25": 1.0, "lexical_score": 1.0, "score": 1.0}
    ).withColumn("closeness", F.round("closeness", 12))
    limits = table(spark, folder, "questions").groupBy("question_id").agg(F.max("top_n").alias("top_n"))
    return best_of_group(close, limits, "question_id", "chunk_id", "top_n").select("question_id", "chunk_id")


@LLM.query("p7_found")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks whose texts look the same but are not the same characters."""
    pairs = look_alike_pairs(table(spark, folder, "chunks"), "chunk_id", "text")
    return pairs.select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


@LLM.query("p7_classes")
def p7_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The different texts of every look that has several, with the number of chunks of each and the smallest chunk id."""
    return look_classes(table(spark, folder, "chunks"), "chunk_id", "text").select(F.hex("look").alias("look"), F.hex("form").alias("form"), "keys", "first_key")


@LLM.query("p8_ids")
def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document text by byte_bpe_50k."""
    return encode_texts(table(spark, folder, "documents"), "doc_id", "text")


def _quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return text_quality(documents, "doc_id", "text", train_quality(documents, "text"))


@LLM.query("p9_found")
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that hold at least half of a benchmark item, with the item.

    The bar is half itself: items share template phrases, so that a document with one item may hold a little less than
    half of others.
    """
    leaks = leaked_items(
        table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "benchmark"), "item_id", "text", share=0.5
    )
    return leaks.select("doc_id", "item_id").distinct()


@LLM.query("p9_cleaned")
def p9_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the passages of benchmark items."""
    documents, benchmark = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return without_leaks(documents, "doc_id", "text", benchmark, "item_id", "text", share=0.5)


@LLM.query("p10_found")
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that are not prose for the most part."""
    return _quality(spark, folder).where(F.col("prose") < 0.5).select("doc_id").distinct()


@LLM.query("p10_statistics")
def p10_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics of every document and the probability that it is prose."""
    return _quality(spark, folder)


def queries() -> dict[str, Query]:
    """Name → callable(spark, folder)."""
    return dict(LLM.queries)


def oracle_sql() -> dict[str, str]:
    """Name → equivalent SQL for those queries that SQL can express."""
    return dict(LLM.sql)
