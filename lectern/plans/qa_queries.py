"""Queries of the question-answering engine, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.config import EngineConfig
from lectern.functions import identity, text as t
from lectern.functions.vectors import hash_embedding
from lectern.operators import answering, chunking, corpus, dense, diff, embedding, fusion, gate, lexical
from lectern.operators.requests import request_error
from lectern.plans import evaluation, sql
from lectern.plans.registry import CORE
from lectern.session import checkpointed, table
from lectern.sources.files import parse_texts, section_rows

MODEL = "fenlark-embed-64"


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "questions").groupBy("question_id").agg(F.max("question").alias("question"))
    return asked.withColumn("terms", t.query_terms(t.tokenize(F.col("question"))))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """(chunk_id, text), distinct: told apart by id and hash, so that texts are not compared."""
    chunks = table(spark, folder, "chunks").select("chunk_id", "text")
    return chunks.groupBy("chunk_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("h2")).agg(F.max("text").alias("text")).select("chunk_id", "text")


def _visible(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.visible_documents(table(spark, folder, "document_versions"))


def _eligible(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.eligible_chunks(table(spark, folder, "chunks"), _visible(spark, folder))


def _arms(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Dense arm from the citations, lexical arm from the stored hits."""
    hits = table(spark, folder, "lexical_hits").where(~F.isnan("bm25")).groupBy("question_id", "chunk_id").agg(F.min("bm25").alias("bm25"))
    cited = table(spark, folder, "citations").where(~F.isnan("score")).groupBy("question_id", "chunk_id").agg(F.max("score").alias("score"))
    question = Window.partitionBy("question_id")
    ranked = cited.withColumn("dense_rank", F.row_number().over(question.orderBy(F.desc("score"), "chunk_id")))
    similar = ranked.withColumn("similarity", F.col("score") / F.max("score").over(question)).where("dense_rank <= 60")
    return similar, lexical.lexical_ranks(hits, 30)


def _covered(spark: SparkSession, folder: str) -> DataFrame:
    fused = checkpointed(fusion.fuse(*_arms(spark, folder)))  # read twice below
    texts = table(spark, folder, "chunks").groupBy("chunk_id").agg(F.max("text").alias("text"))
    needed = texts.join(fused.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", t.tokenize(F.col("text")).alias("tokens"))
    terms = _asked(spark, folder).select("question_id", "terms")
    joined = fused.join(needed, "chunk_id").join(terms, "question_id")
    return joined.withColumn("token_coverage", t.coverage(F.col("terms"), F.col("tokens"))).drop("tokens", "terms")


@CORE.query("normalize_questions", f"SELECT question_id, {sql.normalized('question')} AS normal FROM (SELECT DISTINCT question_id, question FROM questions)")
def normalize_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Index form of every question."""
    asked = table(spark, folder, "questions").select("question_id", "question").distinct()
    return asked.select("question_id", t.normalize(F.col("question")).alias("normal"))


@CORE.query("tokenize_chunks", f"SELECT chunk_id, unnest({sql.tokens('text')}) AS token FROM (SELECT DISTINCT chunk_id, text FROM chunks)")
def tokenize_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every token of every chunk."""
    chunks = _texts(spark, folder)
    return chunks.select("chunk_id", F.explode(t.tokenize(F.col("text"))).alias("token"))


@CORE.query("query_terms", f"SELECT question_id, unnest({sql.terms('question')}) AS term FROM (SELECT DISTINCT question_id, question FROM questions)")
def query_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of every question."""
    return _asked(spark, folder).select("question_id", F.explode("terms").alias("term"))


@CORE.query("detect_language", f"SELECT chunk_id, {sql.detected('text')} AS language FROM (SELECT DISTINCT chunk_id, text FROM chunks)")
def detect_language(spark: SparkSession, folder: str) -> DataFrame:
    """Script language of every chunk."""
    return _texts(spark, folder).select("chunk_id", t.detect_language(F.col("text")).alias("language"))


@CORE.query(
    "identity_hashes",
    f"""SELECT DISTINCT chunk_id, doc_id || ':v' || doc_version || ':' || ordinal AS made_id,
    sha256(array_to_string(from_json(section_path_json, '["VARCHAR"]'), ' > ') || chr(0) || {sql.normalized("text")}) AS made_hash,
    sha256(text) AS text_hash FROM chunks""",
)
def identity_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Id and hashes of every chunk, made from its parts."""
    path = F.from_json("section_path_json", "array<string>")
    made = identity.chunk_id(F.col("doc_id"), F.col("doc_version"), F.col("ordinal"))
    return (
        table(spark, folder, "chunks")
        .select("chunk_id", made.alias("made_id"), identity.chunk_hash(path, F.col("text")).alias("made_hash"), identity.content_hash(F.col("text")).alias("text_hash"))
        .distinct()
    )


@CORE.query(
    "default_doc_ids",
    r"""SELECT DISTINCT source_name, coalesce(nullif(trim(regexp_replace(lower(regexp_replace(regexp_extract(source_name, '([^/]*)$', 1),
    '\.[^.]*$', '')), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'document') AS doc_id FROM eligible_snapshots WHERE source_name IS NOT NULL""",
)
def default_doc_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Document id that each source name gives."""
    names = table(spark, folder, "eligible_snapshots").select("source_name").where("source_name IS NOT NULL").distinct()
    return names.select("source_name", identity.default_doc_id(F.col("source_name")).alias("doc_id"))


@CORE.query("split_sentences")
def split_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences for quoting, of every chunk."""
    chunks = _texts(spark, folder)
    return chunks.select("chunk_id", F.inline(t.sentence_spans(F.col("text"))))


@CORE.query("parse_documents")
def parse_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of every document by its format."""
    return section_rows(parse_texts(table(spark, folder, "documents"), "doc_id", "text", "format", "title")).drop("body")


@CORE.query("chunk_documents")
def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of every document."""
    parsed = parse_texts(table(spark, folder, "documents"), "doc_id", "text", "format", "title")
    return chunking.chunk_sections(section_rows(parsed))


@CORE.query("visible_documents", f"WITH {sql.VISIBLE} SELECT doc_id, current_version, last_version, CASE WHEN current_version IS NULL THEN 'deleted' ELSE 'active' END AS status FROM visible")
def visible_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Pointer and status of every managed document."""
    return _visible(spark, folder)


@CORE.query("eligible_chunks", f"WITH {sql.VISIBLE} SELECT chunk_id, doc_id, doc_version, ordinal FROM eligible")
def eligible_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the current versions."""
    return _eligible(spark, folder).select("chunk_id", "doc_id", "doc_version", "ordinal")


@CORE.query(
    "document_outline",
    f"""WITH {sql.VISIBLE} SELECT doc_id, doc_version, section_path_json, ordinal, chunk_id FROM eligible
    QUALIFY row_number() OVER (PARTITION BY doc_id, doc_version, section_path_json ORDER BY ordinal, chunk_id) = 1""",
)
def document_outline(spark: SparkSession, folder: str) -> DataFrame:
    """First chunk of every section of the visible documents."""
    return corpus.outline(_eligible(spark, folder))


@CORE.query(
    "dominant_language",
    f"""WITH {sql.VISIBLE}, spoken AS (SELECT doc_id, ordinal, {sql.detected("text")} AS language FROM eligible)
    SELECT doc_id, language FROM (SELECT doc_id, language, count(*) AS n, min(ordinal) AS f FROM spoken GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, (language = 'en') DESC, f) = 1""",
)
def dominant_language(spark: SparkSession, folder: str) -> DataFrame:
    """Script language of most chunks of every visible document."""
    return chunking.dominant_language(_eligible(spark, folder).select("doc_id", "ordinal", t.detect_language(F.col("text")).alias("language")))


@CORE.query(
    "document_page",
    f"""WITH {sql.VISIBLE}, active AS (SELECT * FROM visible WHERE current_version IS NOT NULL)
    SELECT doc_id, current_version, last_version, 'active' AS status, (SELECT count(*) FROM active) AS total
    FROM active ORDER BY doc_id LIMIT 20 OFFSET 20""",
)
def document_page(spark: SparkSession, folder: str) -> DataFrame:
    """Second page of the listing, twenty to a page, with the total."""
    return corpus.document_page(_visible(spark, folder), 20, 20)


@CORE.query(
    "allocate_versions",
    f"WITH {sql.VISIBLE} SELECT doc_id, unnest([1, 2]) AS upload_no, last_version + unnest([1, 2]) AS version FROM visible",
)
def allocate_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Version numbers for two uploads of every document."""
    documents = _visible(spark, folder)
    uploads = documents.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("upload_no"))
    return corpus.allocate_versions(documents, uploads)


@CORE.query(
    "publish_staged",
    """WITH v AS (SELECT DISTINCT doc_id, version, state FROM document_versions),
    s AS (SELECT doc_id, max(version) AS new FROM v WHERE state = 'staging' GROUP BY doc_id)
    SELECT v.doc_id, v.version, CASE WHEN v.version = s.new THEN 'published' WHEN s.new IS NOT NULL AND state = 'published'
    THEN 'superseded' ELSE state END AS state FROM v LEFT JOIN s USING (doc_id)""",
)
def publish_staged(spark: SparkSession, folder: str) -> DataFrame:
    """States of all versions after the newest staged one of each document is published."""
    versions = table(spark, folder, "document_versions").select("doc_id", "version", "state").distinct()
    return corpus.publish(versions, versions.where("state = 'staging'"))


@CORE.query(
    "delete_hides",
    f"""WITH {sql.VISIBLE}, failed AS (SELECT DISTINCT doc_id FROM document_versions WHERE state = 'failed')
    SELECT chunk_id FROM eligible WHERE doc_id NOT IN (SELECT doc_id FROM failed)""",
)
def delete_hides(spark: SparkSession, folder: str) -> DataFrame:
    """What is visible after every document with a failed version is deleted."""
    failed = table(spark, folder, "document_versions").where("state = 'failed'")
    return corpus.eligible_chunks(table(spark, folder, "chunks"), corpus.mark_deleted(_visible(spark, folder), failed)).select("chunk_id")


@CORE.query(
    "purge_superseded",
    """SELECT DISTINCT c.chunk_id FROM chunks c LEFT JOIN (SELECT DISTINCT doc_id, version FROM document_versions
    WHERE state IN ('superseded', 'failed')) v ON c.doc_id = v.doc_id AND c.doc_version = v.version WHERE v.doc_id IS NULL""",
)
def purge_superseded(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that stay when superseded and failed versions are purged."""
    return corpus.purge(table(spark, folder, "chunks"), table(spark, folder, "document_versions")).select("chunk_id").distinct()


DIFF_SQL = """
WITH c AS (SELECT DISTINCT doc_id, doc_version, ordinal, chunk_hash FROM chunks),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, doc_version, chunk_hash ORDER BY ordinal) AS nth FROM c),
later AS (SELECT doc_id || ':v' || doc_version AS doc_id, chunk_hash, nth, ordinal FROM n WHERE doc_version > 1),
prior AS (SELECT n.doc_id || ':v' || (doc_version + 1) AS doc_id, chunk_hash, nth, ordinal FROM n
          WHERE EXISTS (SELECT 1 FROM later l WHERE l.doc_id = n.doc_id || ':v' || (n.doc_version + 1))),
diff AS (SELECT coalesce(p.doc_id, l.doc_id) AS doc_id, coalesce(p.chunk_hash, l.chunk_hash) AS chunk_hash,
         p.ordinal AS prior_ordinal, l.ordinal AS new_ordinal,
         CASE WHEN p.doc_id IS NULL THEN 'added' WHEN l.doc_id IS NULL THEN 'removed' ELSE 'reused' END AS change
  FROM prior p FULL JOIN later l ON p.doc_id = l.doc_id AND p.chunk_hash = l.chunk_hash AND p.nth = l.nth)
"""


def _version_diff(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks").select("doc_id", "doc_version", "ordinal", "chunk_hash").distinct()
    named = lambda v: F.concat("doc_id", F.lit(":v"), v).alias("doc_id")
    later = chunks.where("doc_version > 1").select(named(F.col("doc_version")), "ordinal", "chunk_hash")
    prior = chunks.select(named(F.col("doc_version") + 1), "ordinal", "chunk_hash")
    return diff.chunk_diff(prior.join(later.select("doc_id").distinct(), "doc_id", "left_semi"), later)


@CORE.query("chunk_diff", DIFF_SQL + "SELECT doc_id, chunk_hash, coalesce(prior_ordinal, -1) AS prior_ordinal, coalesce(new_ordinal, -1) AS new_ordinal, change FROM diff")
def chunk_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks added, reused and removed by every version against the one before; an absent ordinal is -1."""
    found = _version_diff(spark, folder)
    return found.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("prior_ordinal", "new_ordinal")})


@CORE.query(
    "diff_counts",
    DIFF_SQL + """SELECT doc_id, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'reused') AS reused,
    count(*) FILTER (WHERE change = 'removed') AS removed FROM diff GROUP BY doc_id""",
)
def diff_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of changes by every version."""
    return diff.diff_counts(_version_diff(spark, folder))


@CORE.query(
    "cache_split",
    """SELECT DISTINCT model_id, embed_input_hash AS input_hash, EXISTS (SELECT 1 FROM embedding_cache e WHERE e.model_id = m.model_id AND vector IS NOT NULL
    AND e.input_hash = c.embed_input_hash) AS cached FROM chunks c, (SELECT DISTINCT model_id FROM embedding_cache WHERE model_id IS NOT NULL) m""",
)
def cache_split(spark: SparkSession, folder: str) -> DataFrame:
    """Which embedding inputs are cached for each model."""
    inputs, cache = table(spark, folder, "chunks").select(F.col("embed_input_hash").alias("input_hash")), table(spark, folder, "embedding_cache")
    return _every_model(cache, lambda model: embedding.cache_split(inputs, cache, model))


def _every_model(cache: DataFrame, one: Callable[[str], DataFrame]) -> DataFrame:
    """The rows of one model after the other, with the model; there are few."""
    out = None
    for r in cache.where("model_id IS NOT NULL").select("model_id").distinct().orderBy("model_id").collect():
        rows = one(r["model_id"]).withColumn("model_id", F.lit(r["model_id"]))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else one("").withColumn("model_id", F.lit("")).where("false")


CACHE_SQL = f"""cache AS (SELECT * FROM embedding_cache WHERE model_id = '{MODEL}' AND vector IS NOT NULL AND len(vector) = dim
  QUALIFY row_number() OVER (PARTITION BY input_hash ORDER BY created_at DESC) = 1)"""


EVERY_CACHE_SQL = """cache AS (SELECT * FROM embedding_cache WHERE model_id IS NOT NULL AND vector IS NOT NULL AND len(vector) = dim
  QUALIFY row_number() OVER (PARTITION BY input_hash, model_id ORDER BY created_at DESC) = 1)"""


@CORE.query(
    "rebuild_vectors",
    f"""WITH {sql.VISIBLE}, {EVERY_CACHE_SQL} SELECT e.chunk_id, c.model_id, c.dim,
    CASE WHEN list_sum(c.vector) IS NULL OR isnan(list_sum(c.vector)) THEN NULL ELSE round(list_sum(list_transform(c.vector, lambda x: x::DOUBLE)), 3) END AS total
    FROM eligible e JOIN cache c ON e.embed_input_hash = c.input_hash""",
)
def rebuild_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of the eligible chunks from the cache alone for every model, each shown by the sum of its numbers."""
    eligible, cache = _eligible(spark, folder), table(spark, folder, "embedding_cache")
    vectors = _every_model(cache, lambda model: embedding.rebuild_vectors(eligible, cache, model))
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return vectors.select("chunk_id", "model_id", "dim", F.when(~F.isnan(total), F.round(total, 3)).alias("total"))


@CORE.query(
    "reconcile",
    f"""WITH {sql.VISIBLE}, {EVERY_CACHE_SQL}, m AS (SELECT DISTINCT model_id FROM embedding_cache WHERE model_id IS NOT NULL),
    have AS (SELECT DISTINCT c.model_id, k.chunk_id FROM chunks k JOIN cache c ON k.embed_input_hash = c.input_hash)
    SELECT m.model_id, chunk_id, 'missing' AS finding FROM eligible e, m WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.model_id = m.model_id AND h.chunk_id = e.chunk_id)
    UNION ALL SELECT model_id, chunk_id, 'orphaned' FROM have WHERE chunk_id NOT IN (SELECT chunk_id FROM eligible)""",
)
def reconcile(spark: SparkSession, folder: str) -> DataFrame:
    """Eligible chunks without vector, and vectors of chunks that are not eligible, for every model."""
    chunks, cache, eligible = table(spark, folder, "chunks"), table(spark, folder, "embedding_cache"), _eligible(spark, folder)
    return _every_model(cache, lambda model: diff.reconcile(eligible, embedding.rebuild_vectors(chunks, cache, model), "chunk_id"))


@CORE.query("plan_batches")
def plan_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Request batches for all distinct embedding inputs."""
    items = table(spark, folder, "chunks").groupBy(F.col("embed_input_hash").alias("item")).agg(F.max(F.length("text")).alias("chars"))
    return embedding.plan_batches(items)


@CORE.query("hash_embedding")
def hash_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Model-free vectors of all questions."""
    return _asked(spark, folder).select("question_id", hash_embedding(F.col("question")).alias("vector"))


@CORE.query("hash_embedding_chunks")
def hash_embeddings_of_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Model-free vectors of the texts of all chunks."""
    chunks = _texts(spark, folder)
    return chunks.select("chunk_id", hash_embedding(F.col("text")).alias("vector"))


BM25_SQL = f"""WITH {sql.VISIBLE}, {sql.ASKED},
stats AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM chunk_tokens),
want AS (SELECT question_id, unnest(terms) AS term FROM question_terms),
post AS (SELECT chunk_id, len(tokens) AS len, unnest(tokens) AS term FROM chunk_tokens),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
scored AS (
  SELECT question_id, chunk_id, -sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
         * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len / mean))) AS bm25
  FROM want JOIN post USING (term) JOIN df USING (term), stats GROUP BY question_id, chunk_id)
SELECT question_id, chunk_id, round(bm25, 5) AS bm25,
       row_number() OVER (PARTITION BY question_id ORDER BY round(bm25, 9), chunk_id) AS lexical_rank,
       round(bm25 / min(bm25) OVER (PARTITION BY question_id), 5) AS lexical_score
FROM scored QUALIFY lexical_rank <= 30"""


def _tokens_of(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", t.tokenize(F.col("text")).alias("tokens"))


@CORE.query("bm25_topk", BM25_SQL)
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The thirty best eligible chunks by words for every question."""
    found = lexical.bm25(_asked(spark, folder), _tokens_of(_eligible(spark, folder)), 30)
    return found.select("question_id", "chunk_id", F.round("bm25", 5).alias("bm25"), "lexical_rank", F.round("lexical_score", 5).alias("lexical_score"))


@CORE.query("lexical_scores", f"WITH {sql.ARMS} SELECT question_id, chunk_id, lexical_rank, round(lexical_score, 6) AS lexical_score FROM lexical_scored")
def lexical_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Rank and normalised score of the stored hits."""
    return _arms(spark, folder)[1].select("question_id", "chunk_id", "lexical_rank", F.round("lexical_score", 6).alias("lexical_score"))


DENSE_SQL = """SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS similarity,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) DESC, c.vec_id) AS dense_rank
FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 QUALIFY dense_rank <= 60"""


def _dense(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return dense.cosine_topk(vectors.where("id % 100 = 0").withColumnRenamed("id", "query_id"), vectors, 60)


@CORE.query("dense_topk", DENSE_SQL)
def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The sixty most similar vectors for every query, the vectors whose id is divisible by 100, against all rows."""
    return _dense(spark, folder).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "dense_rank")


def _fused_columns(fused: DataFrame) -> DataFrame:
    ranks = (F.coalesce(c, F.lit(0)).alias(c) for c in ("dense_rank", "lexical_rank"))  # 0: not in this arm
    return fused.select("question_id", "chunk_id", *ranks, F.round("score", 9).alias("score"), "rank")


FUSED_COLUMNS = "SELECT question_id, chunk_id, coalesce(dense_rank, 0) AS dense_rank, coalesce(lexical_rank, 0) AS lexical_rank, round(score, 9) AS score, rank FROM ranked"


@CORE.query("rrf_fuse", f"WITH {sql.ARMS}, {sql.fused(0.9, 0.1)} {FUSED_COLUMNS}")
def rrf_fuse(spark: SparkSession, folder: str) -> DataFrame:
    """Both arms fused by weighted reciprocal ranks."""
    return _fused_columns(fusion.fuse(*_arms(spark, folder)))


@CORE.query("rrf_single_arm", f"WITH {sql.ARMS}, {sql.fused(0, 1.0)} {FUSED_COLUMNS}")
def rrf_single_arm(spark: SparkSession, folder: str) -> DataFrame:
    """The lexical arm alone: weight 0 removes the other with all that only it has."""
    return _fused_columns(fusion.fuse(*_arms(spark, folder), dense_weight=0, lexical_weight=1.0))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


GATE_WITH = f"WITH {sql.VISIBLE}, {sql.ASKED}, {sql.ARMS}, {sql.fused(0.9, 0.1)}, {sql.SIGNALS}"
SIGNAL_COLUMNS = "question_id, round(max_dense, 6) AS max_dense, round(lexical, 6) AS lexical, round(token_coverage, 6) AS token_coverage, round(overlap, 6) AS overlap, candidate_count"
REASON = "CASE WHEN max_dense >= 0.54 AND token_coverage >= 0.4 THEN 'dense+coverage' WHEN token_coverage >= 0.75 THEN 'exact_terms' ELSE 'below_threshold' END"


@CORE.query("gate_signals", f"{GATE_WITH} SELECT {SIGNAL_COLUMNS} FROM signals")
def gate_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Signals of the evidence gate for every question."""
    return _rounded(gate.signals(_covered(spark, folder)), "max_dense", "lexical", "token_coverage", "overlap")


@CORE.query(
    "gate_verdict",
    f"""{GATE_WITH} SELECT question_id, {REASON} AS reason, {REASON} <> 'below_threshold' AS passed,
    round(least(1, greatest(0, 0.4 * token_coverage + 0.3 * max_dense + 0.3 * lexical)), 6) AS evidence_score FROM signals""",
)
def gate_verdict(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict and evidence score for every question."""
    judged = gate.verdict(gate.signals(_covered(spark, folder)))
    return judged.select("question_id", "reason", "passed", F.round(gate.evidence_score(), 6).alias("evidence_score"))


def _citable(spark: SparkSession, folder: str, eligible: DataFrame | None = None) -> DataFrame:
    """Eligible chunks, or those given, with what a citation shows: the source name of the document and the breadcrumb as an array."""
    named = table(spark, folder, "eligible_snapshots").groupBy("doc_id").agg(F.max("source_name").alias("document"))
    path = F.from_json("section_path_json", "array<string>").alias("section_path")
    rows = (_eligible(spark, folder) if eligible is None else eligible).select("*", path).drop("section_path_json")
    return rows.join(named, "doc_id", "left")


def _answers(spark: SparkSession, folder: str, config: EngineConfig | None = None, debug: bool = False) -> DataFrame:
    """Every distinct question is answered once, under its first id; what is read again and again is only what its candidates need."""
    c = config or EngineConfig()
    # a key for the text, null included
    every = checkpointed(table(spark, folder, "questions").groupBy("question_id").agg(F.max("question").alias("question")).withColumn("text_key", F.to_json(F.array("question"))))
    first = every.groupBy("text_key").agg(F.min("question_id").alias("question_id"), F.max("question").alias("question"))
    first = checkpointed(first.withColumn("terms", t.query_terms(t.tokenize(F.col("question")))))
    checked = first.withColumn("error_code", request_error(F.col("question"), F.col("terms")))
    checked = checkpointed(checked)  # read by both arms and the answers
    asked = checked.where("error_code IS NULL")  # nothing is searched or embedded for the others
    chunks = checkpointed(_eligible(spark, folder))
    words = lexical.bm25(asked, _tokens_of(chunks), c.candidates)
    vectors = chunks.select(F.col("chunk_id").alias("id"), hash_embedding(F.col("text")).alias("vector"))
    asking = asked.select(F.col("question_id").alias("query_id"), hash_embedding(F.col("question")).alias("vector"))
    near = dense.cosine_topk(asking, vectors, c.candidates * c.dense_overfetch)
    near = near.select(F.col("query_id").alias("question_id"), F.col("id").alias("chunk_id"), "similarity", "dense_rank")
    fused = checkpointed(fusion.fuse(near, words, c.dense_weight, c.lexical_weight, c.rrf_k, c.candidates))
    shown = chunks.join(fused.select("chunk_id").distinct(), "chunk_id", "left_semi")
    shown = checkpointed(_citable(spark, folder, shown).withColumn("tokens", t.tokenize(F.col("text"))))
    window = fused.join(shown.select("chunk_id", "tokens"), "chunk_id").join(asked.select("question_id", "terms"), "question_id")
    covered = checkpointed(window.withColumn("token_coverage", t.coverage(F.col("terms"), F.col("tokens"))).drop("tokens", "terms"))
    judged = checkpointed(gate.verdict(gate.signals(covered, c.top_k)))
    terms = asked.select("question_id", F.explode("terms").alias("term"))
    top = checkpointed(covered.where(F.col("rank") <= c.top_k).drop("token_coverage").join(shown.select("chunk_id", "tokens", "text"), "chunk_id"))
    seen = answering.debug_records(covered, judged) if debug else None
    built = answering.build_answers(checked, top, terms, shown, judged, budget=c.max_sentences, empty=chunks.isEmpty(), debug=seen)
    keys = first.select(F.col("question_id").alias("first_id"), "text_key")
    answered = built.withColumnRenamed("question_id", "first_id").join(keys, "first_id")
    return every.select("question_id", "text_key").join(answered, "text_key").drop("text_key", "first_id")


@CORE.query("answers")
def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answer or refusal for every question over the eligible chunks, with model-free vectors as the dense arm."""
    return _answers(spark, folder)


@CORE.query("answers_debug")
def answers_debug(spark: SparkSession, folder: str) -> DataFrame:
    """The answers with the gate's signals and the scores of all candidates."""
    return _answers(spark, folder, debug=True)


@CORE.query(
    "verify_citations",
    """WITH k AS (SELECT chunk_id, any_value(text) AS text FROM chunks GROUP BY chunk_id),
    v AS (SELECT doc_id, version AS doc_version, any_value(source_text) AS source_text FROM document_versions GROUP BY ALL),
    c AS (SELECT DISTINCT question_id, citation_no, chunk_id, doc_id, doc_version, char_start, char_end, excerpt FROM citations),
    j AS (SELECT c.*, k.text, substring(source_text, char_start + 1, char_end - char_start) AS slice FROM c LEFT JOIN k USING (chunk_id) LEFT JOIN v USING (doc_id, doc_version))
    SELECT question_id, citation_no, CASE WHEN text IS NULL THEN 'no_chunk' WHEN excerpt IS DISTINCT FROM text THEN 'excerpt_differs' ELSE 'slice_differs' END AS problem
    FROM j WHERE text IS NULL OR excerpt IS DISTINCT FROM text OR slice IS DISTINCT FROM text""",
)
def verify_citations(spark: SparkSession, folder: str) -> DataFrame:
    """Citations that are not verbatim."""
    return answering.verify_citations(table(spark, folder, "citations"), table(spark, folder, "chunks"), table(spark, folder, "document_versions"))


RELEVANT_SQL = f"""near AS ({DENSE_SQL}), labelled AS (SELECT n.query_id, n.dense_rank FROM near n JOIN embeddings q ON q.vec_id = n.query_id
  JOIN embeddings c ON c.vec_id = n.id WHERE n.id <> n.query_id AND q.label = c.label),
hit AS (SELECT q.vec_id AS case_id, min(dense_rank) - 1 AS hit_rank FROM embeddings q LEFT JOIN labelled l ON l.query_id = q.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1)"""


def _label_hits(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "label")
    near = _dense(spark, folder).where("id <> query_id")
    asked = labels.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("label").alias("wanted"))
    same = near.join(labels, "id").join(asked, "query_id").where("label = wanted").select(F.col("query_id").alias("case_id"), (F.col("dense_rank") - 1).alias("rank"))
    every = asked.select(F.col("query_id").alias("case_id")).join(same, "case_id", "left").withColumn("gold_id", F.lit(0))
    return evaluation.hit_ranks(every)


@CORE.query("hit_ranks", f"WITH {RELEVANT_SQL} SELECT case_id, coalesce(hit_rank, 0) AS hit_rank FROM hit")
def hit_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Rank of the first vector of the same label for every query, itself left out; 0 for none."""
    return _label_hits(spark, folder).withColumn("hit_rank", F.coalesce("hit_rank", F.lit(0)))


@CORE.query(
    "ir_metrics",
    f"""WITH {RELEVANT_SQL} SELECT count(*) AS cases, round(avg(CASE WHEN hit_rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1,
    round(avg(CASE WHEN hit_rank <= 3 THEN 1.0 ELSE 0 END), 6) AS recall_3, round(avg(CASE WHEN hit_rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5,
    round(avg(CASE WHEN hit_rank <= 5 THEN 1.0 / hit_rank ELSE 0 END), 6) AS mrr_5 FROM hit""",
)
def ir_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Retrieval metrics of the dense arm with equal labels as relevance."""
    return _rounded(evaluation.retrieval_metrics(_label_hits(spark, folder)), "recall_1", "recall_3", "recall_5", "mrr_5")


@CORE.query(
    "weight_sweep",
    f"""WITH {sql.ARMS}, w AS (SELECT unnest(range(0, 11)) AS config), u AS (
    SELECT coalesce(d.question_id, l.question_id) AS question_id, coalesce(d.chunk_id, l.chunk_id) AS chunk_id, d.dense_rank, l.lexical_rank
    FROM dense d FULL JOIN lexical_scored l ON d.question_id = l.question_id AND d.chunk_id = l.chunk_id),
    s AS (SELECT config, question_id, chunk_id, coalesce(CASE WHEN config > 0 THEN round(config / 10, 1) / (60 + dense_rank) END, 0)
     + coalesce(CASE WHEN config < 10 THEN round(1 - config / 10, 1) / (60 + lexical_rank) END, 0) AS score FROM u, w)
    SELECT config, question_id, chunk_id, row_number() OVER (PARTITION BY config, question_id ORDER BY score DESC, chunk_id) AS rank
    FROM s WHERE score > 0 QUALIFY rank <= 5""",
)
def weight_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """First five of every question for eleven pairs of weights."""
    near, words = _arms(spark, folder)
    weights = spark.range(11).select(
        F.col("id").alias("config"), F.round(F.col("id") / 10, 1).alias("dense_weight"), F.round(1 - F.col("id") / 10, 1).alias("lexical_weight")
    )
    return fusion.fused_by_weight(near, words, weights).select("config", "question_id", "chunk_id", "rank")


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    found = _rounded(gate.signals(_covered(spark, folder)), "max_dense", "token_coverage", "overlap")
    return found.select((F.col("overlap") > 0.1).alias("answerable"), "max_dense", "token_coverage")


GRID_SQL = f"""{GATE_WITH}, cases AS (SELECT round(overlap, 6) > 0.1 AS answerable, round(max_dense, 6) AS d, round(token_coverage, 6) AS c FROM signals),
points AS (SELECT round(a / 20.0, 6) AS min_dense, round(b / 20.0, 6) AS min_coverage, round(h / 20.0, 6) AS min_coverage_high
  FROM (SELECT unnest(range(0, 21)) AS a), (SELECT unnest(range(0, 17)) AS b), (SELECT unnest(range(0, 21)) AS h) WHERE h >= b),
grid AS (SELECT min_dense, min_coverage, min_coverage_high,
  count(*) FILTER (WHERE answerable AND (d + 1e-9 >= min_dense AND c + 1e-9 >= min_coverage OR c + 1e-9 >= min_coverage_high)) AS answered,
  count(*) FILTER (WHERE answerable) AS answerable,
  count(*) FILTER (WHERE NOT answerable AND (d + 1e-9 >= min_dense AND c + 1e-9 >= min_coverage OR c + 1e-9 >= min_coverage_high)) AS false_answers
  FROM points, cases GROUP BY ALL)"""


@CORE.query("grid_search", f"{GRID_SQL} SELECT * FROM grid")
def grid_search(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of the gate at all points of the lattice; questions whose arms agree count as answerable."""
    return evaluation.grid_search(_judged(spark, folder), evaluation.lattice(spark))


@CORE.query(
    "choose_threshold",
    f"""{GRID_SQL}, ok AS (SELECT * FROM grid WHERE false_answers = 0), mid AS (SELECT avg(min_dense) AS a, avg(min_coverage) AS b, avg(min_coverage_high) AS h FROM ok)
    SELECT ok.* FROM ok, mid ORDER BY answered DESC, round(sqrt((min_dense - a) ** 2 + (min_coverage - b) ** 2 + (min_coverage_high - h) ** 2), 9),
    min_dense, min_coverage, min_coverage_high LIMIT 1""",
)
def choose_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """The bars that the calibration chooses."""
    return evaluation.choose(evaluation.grid_search(_judged(spark, folder), evaluation.lattice(spark)))


@CORE.query(
    "latency_percentiles",
    """SELECT event_type, median(value) AS p50, list_sort(list(value))[least(count(value), floor(count(value) * 0.95)::BIGINT + 1)] AS p95
    FROM events WHERE value IS NOT NULL GROUP BY event_type""",
)
def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Median and 95th percentile of the measured values by kind of event."""
    found = evaluation.median_and_percentile(table(spark, folder, "events"), "event_type", "value", 0.95)
    return found.select("event_type", F.col("median").alias("p50"), F.col("percentile").alias("p95"))


@CORE.query(
    "corpus_facts",
    f"WITH {sql.VISIBLE} SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents, count(DISTINCT section_path_json) AS sections, sum(length(text)) AS chars, max(length(text)) AS longest FROM eligible",
)
def corpus_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of what is visible."""
    return _eligible(spark, folder).agg(
        F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"), F.count_distinct("section_path_json").alias("sections"),
        F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"),
    )


@CORE.query("class_balance", "SELECT category, split, count(*) AS cases FROM benchmark GROUP BY ALL")
def class_balance(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation items by category and split."""
    return table(spark, folder, "benchmark").groupBy("category", "split").agg(F.count("*").alias("cases"))
