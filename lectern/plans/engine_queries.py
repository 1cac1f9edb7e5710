"""Queries of versions, vectors, ingest, requests and evaluation, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.config import EngineConfig
from lectern.functions import identity, text as t
from lectern.functions.redact import redacted
from lectern.functions.vectors import hash_embedding
from lectern.operators import answering, chunking, corpus, embedding, fusion, gate, ingest, lexical, vector_index
from lectern.operators.requests import request_error
from lectern.plans import evaluation, sql
from lectern.plans.qa_queries import CACHE_SQL, FUSED_COLUMNS, GATE_WITH, MODEL, _arms, _asked, _citable, _covered, _eligible, _fused_columns, _tokens_of, _visible
from lectern.plans.registry import CORE
from lectern.session import checkpointed, table
from lectern.sources.embedder import HashEmbedder
from lectern.sources.files import parse_texts, section_rows

OTHER = "fenlark-embed-64-r2"
SHORT = EngineConfig(batch_items=4, batch_chars=2_000, item_chars=3_000)

# --------------------------------------------------------------------------------------------------------------- point reads


@CORE.query(
    "source_texts",
    f"""WITH {sql.VISIBLE} SELECT doc_id, version, length(max(source_text)) AS chars, sha256(max(source_text)) AS text_hash
    FROM document_versions JOIN visible USING (doc_id) WHERE version = current_version GROUP BY ALL""",
)
def source_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Length and hash of the text of every current version."""
    found = corpus.source_texts(table(spark, folder, "document_versions"), _visible(spark, folder))
    return found.select("doc_id", "version", F.length("source_text").alias("chars"), identity.content_hash(F.col("source_text")).alias("text_hash"))


@CORE.query(
    "version_facts",
    """SELECT v.doc_id, v.version, v.state, coalesce(c.chunks, 0) AS chunks FROM (SELECT * FROM document_versions
    QUALIFY row_number() OVER (PARTITION BY doc_id, version ORDER BY created_at DESC NULLS LAST, state DESC) = 1) v
    LEFT JOIN (SELECT doc_id, doc_version, count(DISTINCT chunk_id) AS chunks FROM chunks GROUP BY ALL) c ON c.doc_id = v.doc_id AND c.doc_version = v.version""",
)
def version_facts(spark: SparkSession, folder: str) -> DataFrame:
    """State and number of chunks of every version."""
    return corpus.version_facts(table(spark, folder, "document_versions"), table(spark, folder, "chunks"))


@CORE.query(
    "stale_staging",
    """SELECT doc_id, version, CASE WHEN state = 'staging' AND version < max(version) OVER (PARTITION BY doc_id) THEN 'failed' ELSE state END AS state
    FROM (SELECT DISTINCT doc_id, version, state FROM document_versions)""",
)
def stale_staging(spark: SparkSession, folder: str) -> DataFrame:
    """States of all versions when staged ones behind the newest of their document fail."""
    versions = table(spark, folder, "document_versions").select("doc_id", "version", "state").distinct()
    newest = versions.groupBy("doc_id").agg(F.max("version").alias("newest"))
    return corpus.mark_failed(versions.join(newest, "doc_id"), F.col("version") < F.col("newest")).drop("newest")


@CORE.query("redacted_questions", "SELECT DISTINCT question_id, replace(replace(question, 'Velmora', '***REDACTED***'), 'Tarn', '***REDACTED***') AS shown FROM questions")
def redacted_questions(spark: SparkSession, folder: str) -> DataFrame:
    """All questions without two secrets."""
    return table(spark, folder, "questions").select("question_id", redacted(F.col("question"), ["Tarn", "", None, "Velmora"]).alias("shown")).distinct()


@CORE.query(
    "request_errors",
    f"""SELECT DISTINCT question_id, top_n, coalesce(language, '') AS language, coalesce(CASE WHEN question IS NULL OR length(question) NOT BETWEEN 1 AND 2000
    OR top_n * 12 NOT BETWEEN 1 AND 50 OR language NOT IN ('fa', 'en', 'mixed') THEN 'VALIDATION_ERROR'
    WHEN len({sql.terms("question")}) = 0 THEN 'INVALID_QUESTION' END, '') AS error_code FROM questions""",
)
def request_errors(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with each question as a request for twelve times its results in its stored language."""
    asked = table(spark, folder, "questions").withColumn("terms", t.query_terms(t.tokenize(F.col("question"))))
    code = request_error(F.col("question"), F.col("terms"), F.col("top_n") * 12, F.col("language"))
    return asked.select("question_id", "top_n", F.coalesce("language", F.lit("")).alias("language"), F.coalesce(code, F.lit("")).alias("error_code")).distinct()


# ------------------------------------------------------------------------------------------------------------------- vectors


def _index(spark: SparkSession, folder: str, model: str = MODEL) -> DataFrame:
    return embedding.rebuild_vectors(table(spark, folder, "chunks"), table(spark, folder, "embedding_cache"), model)


def _totals(vectors: DataFrame, *names: str) -> DataFrame:
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return vectors.select(*names, F.when(~F.isnan(total), F.round(total, 3)).alias("total"))


def _cache_sql(model: str, name: str) -> str:
    return f"""{name} AS (SELECT input_hash, dim, vector FROM embedding_cache WHERE model_id = '{model}' AND vector IS NOT NULL AND len(vector) = dim
      QUALIFY row_number() OVER (PARTITION BY input_hash ORDER BY created_at DESC) = 1)"""


SQL_TOTAL = "CASE WHEN isnan(list_sum(vector)) THEN NULL ELSE round(list_sum(list_transform(vector, lambda x: x::DOUBLE)), 3) END AS total"
SQL_CLEAN = "len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0"


@CORE.query(
    "vector_presence",
    f"""WITH {sql.VISIBLE}, {CACHE_SQL} SELECT chunk_id, embed_input_hash IN (SELECT input_hash FROM cache) AS present FROM eligible""",
)
def vector_presence(spark: SparkSession, folder: str) -> DataFrame:
    """Which eligible chunks have a vector in the index of the model."""
    return vector_index.presence(_eligible(spark, folder), _index(spark, folder), MODEL)


@CORE.query(
    "vector_collections",
    """SELECT model_id, dim, 'chunks__' || trim(regexp_replace(lower(model_id), '[^a-z0-9]+', '-', 'g'), '-') || '__d' || dim AS collection, count(*) AS vectors
    FROM (SELECT DISTINCT input_hash, model_id, dim FROM embedding_cache) WHERE model_id IS NOT NULL AND dim IS NOT NULL GROUP BY model_id, dim""",
)
def vector_collections(spark: SparkSession, folder: str) -> DataFrame:
    """Models, lengths and collection names of the cache, with the number of inputs of each."""
    return vector_index.collections(table(spark, folder, "embedding_cache").select("input_hash", "model_id", "dim").distinct())


@CORE.query("vector_lengths", "SELECT model_id, count(DISTINCT dim) AS dims FROM embedding_cache WHERE dim IS NOT NULL GROUP BY model_id HAVING count(DISTINCT dim) > 1")
def vector_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Models stored with more than one length."""
    return embedding.one_dimension(table(spark, folder, "embedding_cache"))


@CORE.query(
    "cache_upsert",
    f"""WITH {_cache_sql(MODEL, "a")}, {_cache_sql(OTHER, "b")} SELECT input_hash, {SQL_TOTAL} FROM (
    SELECT input_hash, vector FROM a UNION ALL SELECT input_hash, vector FROM b WHERE input_hash NOT IN (SELECT input_hash FROM a WHERE input_hash IS NOT NULL))""",
)
def cache_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The cache of one model after an upsert of the vectors of another under its name: only what it lacked is added."""
    cache = embedding.distinct_cache(table(spark, folder, "embedding_cache"))
    fresh = cache.where(F.col("model_id") == OTHER).withColumn("model_id", F.lit(MODEL))
    return _totals(embedding.cache_upsert(cache.where(F.col("model_id") == MODEL), fresh), "input_hash")


def _fresh(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder, OTHER).select("chunk_id", "vector")


INDEX_SQL = f"""{_cache_sql(MODEL, "a")}, {_cache_sql(OTHER, "b")}, k AS (SELECT DISTINCT chunk_id, embed_input_hash AS input_hash FROM chunks),
old AS (SELECT chunk_id, vector FROM k JOIN a USING (input_hash)), new AS (SELECT chunk_id, vector FROM k JOIN b USING (input_hash)),
good AS (SELECT chunk_id, max(vector) AS vector FROM new WHERE len(vector) = 64 AND {SQL_CLEAN} GROUP BY chunk_id)"""


@CORE.query("vector_upsert", f"WITH {INDEX_SQL} SELECT chunk_id, {SQL_TOTAL} FROM (SELECT * FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM good) UNION ALL SELECT * FROM good)")
def vector_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The index of one model after an upsert of the vectors of another."""
    return _totals(vector_index.upsert_vectors(_index(spark, folder), _fresh(spark, folder), MODEL, 64), "chunk_id")


@CORE.query(
    "vector_misfits",
    f"""SELECT DISTINCT k.chunk_id, coalesce(len(vector), -1) AS length FROM chunks k JOIN (
    SELECT input_hash, vector FROM embedding_cache WHERE model_id = '{MODEL}') e ON k.embed_input_hash = e.input_hash
    WHERE vector IS NULL OR len(vector) <> 64 OR NOT {SQL_CLEAN}""",
)
def vector_misfits(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that the cache would give a vector which does not fit, and its length, -1 for none."""
    cache = table(spark, folder, "embedding_cache").where(F.col("model_id") == MODEL).select("input_hash", "vector")
    chunks = table(spark, folder, "chunks").select("chunk_id", F.col("embed_input_hash").alias("input_hash")).distinct()
    return vector_index.misfits(chunks.join(cache, "input_hash"), 64).withColumn("length", F.coalesce("length", F.lit(-1))).distinct()


@CORE.query("vector_delete", f"WITH {sql.VISIBLE}, {INDEX_SQL} SELECT chunk_id, {SQL_TOTAL} FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM eligible)")
def vector_delete(spark: SparkSession, folder: str) -> DataFrame:
    """The index without the vectors of the eligible chunks."""
    return _totals(vector_index.delete_vectors(_index(spark, folder), _eligible(spark, folder)), "chunk_id")


@CORE.query("reconcile_apply", f"WITH {sql.VISIBLE}, {CACHE_SQL} SELECT chunk_id FROM eligible JOIN cache ON embed_input_hash = input_hash")
def reconcile_apply(spark: SparkSession, folder: str) -> DataFrame:
    """The index after strays were deleted and missing vectors rebuilt from the cache, starting from half of all chunks."""
    half = _index(spark, folder).where(F.col("chunk_id") < "m")
    eligible = _eligible(spark, folder)
    kept = half.join(eligible, "chunk_id", "left_semi")
    lacking = vector_index.presence(eligible, kept, MODEL).where("NOT present")
    missing = embedding.rebuild_vectors(eligible.join(lacking, "chunk_id", "left_semi"), table(spark, folder, "embedding_cache"), MODEL)
    return kept.unionByName(missing).select("chunk_id")


# -------------------------------------------------------------------------------------------------------------------- ingest

PLAN_SQL = f"""{sql.VISIBLE}, texts AS (SELECT doc_id, version, max(source_text) AS source_text FROM document_versions GROUP BY ALL),
picked AS (SELECT doc_id, max(version) AS version FROM document_versions WHERE state = '@' GROUP BY doc_id),
up AS (SELECT p.doc_id, p.version, sha256(x.source_text) AS h FROM picked p JOIN texts x ON x.doc_id = p.doc_id AND x.version = p.version),
docs AS (SELECT v.*, sha256(x.source_text) AS parsed FROM visible v LEFT JOIN texts x ON x.doc_id = v.doc_id AND x.version = v.current_version),
ch AS (SELECT DISTINCT doc_id, doc_version, ordinal, chunk_hash FROM chunks),
new AS (SELECT ch.doc_id, chunk_hash, row_number() OVER (PARTITION BY ch.doc_id, chunk_hash ORDER BY ordinal) AS nth FROM ch JOIN up ON up.doc_id = ch.doc_id AND up.version = ch.doc_version),
old AS (SELECT ch.doc_id, chunk_hash, row_number() OVER (PARTITION BY ch.doc_id, chunk_hash ORDER BY ordinal) AS nth FROM ch JOIN docs d ON d.doc_id = ch.doc_id AND d.current_version = ch.doc_version),
decided AS (SELECT up.doc_id, CASE WHEN d.current_version IS NOT NULL AND d.parsed = up.h THEN 'unchanged' WHEN d.current_version IS NOT NULL THEN 'updated' ELSE 'created' END AS status,
  d.current_version, d.last_version FROM up JOIN docs d USING (doc_id)),
plan AS (SELECT doc_id, status, coalesce(current_version, -1) AS prev_version, CASE WHEN status = 'unchanged' THEN current_version ELSE last_version + 1 END AS new_version,
  CASE WHEN status = 'unchanged' THEN 0 ELSE (SELECT count(*) FROM new n WHERE n.doc_id = x.doc_id AND NOT EXISTS (SELECT 1 FROM old o WHERE x.current_version IS NOT NULL AND o.doc_id = n.doc_id AND o.chunk_hash = n.chunk_hash AND o.nth = n.nth)) END AS chunks_added,
  CASE WHEN status = 'unchanged' THEN (SELECT count(*) FROM new n WHERE n.doc_id = x.doc_id) ELSE (SELECT count(*) FROM new n JOIN old o ON o.doc_id = n.doc_id AND o.chunk_hash = n.chunk_hash AND o.nth = n.nth WHERE n.doc_id = x.doc_id) END AS chunks_reused,
  CASE WHEN status = 'updated' THEN (SELECT count(*) FROM old o WHERE o.doc_id = x.doc_id AND NOT EXISTS (SELECT 1 FROM new n WHERE o.doc_id = n.doc_id AND o.chunk_hash = n.chunk_hash AND o.nth = n.nth)) ELSE 0 END AS chunks_removed
  FROM decided x)"""


def _ingest_plan(spark: SparkSession, folder: str, state: str) -> DataFrame:
    versions = table(spark, folder, "document_versions")
    texts = versions.groupBy("doc_id", "version").agg(F.max("source_text").alias("source_text"))
    hashed = texts.select("doc_id", "version", identity.content_hash(F.col("source_text")).alias("parsed_hash"))
    picked = versions.where(F.col("state") == state).groupBy("doc_id").agg(F.max("version").alias("version"))
    uploads = hashed.join(picked, ["doc_id", "version"], "left_semi")
    documents = _visible(spark, folder).join(hashed.withColumnRenamed("version", "current_version"), ["doc_id", "current_version"], "left")
    chunks = table(spark, folder, "chunks").select("doc_id", F.col("doc_version").alias("version"), "ordinal", "chunk_hash").distinct()
    new = chunks.join(uploads, ["doc_id", "version"], "left_semi").drop("version")
    current = documents.select("doc_id", F.col("current_version").alias("version"))
    old = chunks.join(current, ["doc_id", "version"], "left_semi").drop("version")
    return ingest.outcomes(uploads.drop("version"), new, documents, old)


def _plain(plan: DataFrame) -> DataFrame:
    return plan.withColumn("prev_version", F.coalesce("prev_version", F.lit(-1)))


@CORE.query("ingest_plan", f"WITH {PLAN_SQL.replace('@', 'staging')} SELECT * FROM plan")
def ingest_plan(spark: SparkSession, folder: str) -> DataFrame:
    """What an upload of the newest staged text of every document would do."""
    return _plain(_ingest_plan(spark, folder, "staging"))


@CORE.query("ingest_unchanged", f"WITH {PLAN_SQL.replace('@', 'published')} SELECT * FROM plan")
def ingest_unchanged(spark: SparkSession, folder: str) -> DataFrame:
    """What an upload of the published text of every document would do: nothing."""
    return _plain(_ingest_plan(spark, folder, "published"))


@CORE.query(
    "ingest_log",
    f"""WITH {PLAN_SQL.replace('@', 'staging')} SELECT CASE status WHEN 'unchanged' THEN 'unchanged' ELSE 'publish' END AS action, count(*) AS uploads, sum(chunks_added) AS chunks_added,
    sum(chunks_reused) AS chunks_reused, sum(chunks_removed) AS chunks_removed FROM plan GROUP BY 1""",
)
def ingest_log(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of the log of such a batch by action."""
    action = F.when(F.col("status") == "unchanged", "unchanged").otherwise("publish").alias("action")
    sums = (F.sum(c).alias(c) for c in ("chunks_added", "chunks_reused", "chunks_removed"))
    return _ingest_plan(spark, folder, "staging").groupBy(action).agg(F.count("*").alias("uploads"), *sums)


BATCH_SQL = """WITH RECURSIVE items AS (
  SELECT doc_id, chunk_id, chars, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) AS n FROM (
    SELECT doc_id, chunk_id, max(length(text)) AS chars FROM chunks GROUP BY ALL)),
fold AS (
  SELECT doc_id, chunk_id, n, chars > 3000 AS bad, 0 AS batch, CASE WHEN chars > 3000 THEN 0 ELSE 1 END AS held, CASE WHEN chars > 3000 THEN 0 ELSE chars END AS size FROM items WHERE n = 1
  UNION ALL
  SELECT i.doc_id, i.chunk_id, i.n, i.chars > 3000, CASE WHEN i.chars <= 3000 AND f.held > 0 AND (f.held = 4 OR f.size + i.chars > 2000) THEN f.batch + 1 ELSE f.batch END,
    CASE WHEN i.chars > 3000 THEN f.held WHEN f.held > 0 AND (f.held = 4 OR f.size + i.chars > 2000) THEN 1 ELSE f.held + 1 END,
    CASE WHEN i.chars > 3000 THEN f.size WHEN f.held > 0 AND (f.held = 4 OR f.size + i.chars > 2000) THEN i.chars ELSE f.size + i.chars END
  FROM fold f JOIN items i ON i.doc_id = f.doc_id AND i.n = f.n + 1),
planned AS (SELECT doc_id, chunk_id AS item, CASE WHEN bad THEN -1 ELSE batch END AS batch_no, CASE WHEN bad THEN 'FILE_TOO_LARGE' ELSE '' END AS error FROM fold)
"""


def _batches(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "chunks").groupBy("doc_id", F.col("chunk_id").alias("item")).agg(F.max(F.length("text")).alias("chars"))
    return embedding.plan_document_batches(items, SHORT)


@CORE.query("plan_document_batches", BATCH_SQL + "SELECT * FROM planned")
def plan_document_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Requests of at most 4 items and 2,000 characters for the chunks of every document; an item above 3,000 can't be sent."""
    found = _batches(spark, folder)
    return found.select("doc_id", "item", F.coalesce("batch_no", F.lit(-1)).alias("batch_no"), F.coalesce("error", F.lit("")).alias("error"))


@CORE.query("request_counts", BATCH_SQL + "SELECT doc_id, count(DISTINCT batch_no) FILTER (WHERE batch_no >= 0) AS requests FROM planned GROUP BY doc_id")
def request_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Number of such requests of every document."""
    return _batches(spark, folder).groupBy("doc_id").agg(F.count_distinct("batch_no").alias("requests"))


# ---------------------------------------------------------------------------------------------------------------- candidates


@CORE.query(
    "filtered_candidates",
    f"""WITH {sql.VISIBLE}, {sql.ARMS}, {sql.fused(0.9, 0.1, 100000)}, kept AS (SELECT r.* FROM ranked r JOIN eligible e USING (chunk_id) WHERE e.language = 'en')
    SELECT question_id, chunk_id, coalesce(dense_rank, 0) AS dense_rank, coalesce(lexical_rank, 0) AS lexical_rank, round(score, 9) AS score,
    row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM kept QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) <= 5""",
)
def filtered_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """First five eligible English candidates of every question; the filter applies behind the windows of the arms."""
    allowed = corpus.eligible_chunks(table(spark, folder, "chunks"), _visible(spark, folder)).where("language = 'en'")
    return _fused_columns(fusion.fuse(*_arms(spark, folder), limit=5, allowed=allowed))


@CORE.query(
    "refusal_reasons",
    f"""WITH {sql.VISIBLE}, {sql.ARMS}, {sql.fused(0.9, 0.1, 100000)}, kept AS (SELECT DISTINCT question_id FROM ranked JOIN eligible USING (chunk_id) WHERE language = 'es')
    SELECT DISTINCT question_id, CASE WHEN question_id IN (SELECT question_id FROM kept) THEN 'candidates' WHEN (SELECT count(*) FROM eligible) > 0
    THEN 'no_relevant_content' ELSE 'empty_knowledge_base' END AS reason FROM questions""",
)
def refusal_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Why questions restricted to Spanish chunks would be refused before the gate, or that they have candidates."""
    eligible = _eligible(spark, folder)
    found = fusion.fuse(*_arms(spark, folder), limit=None, allowed=eligible.where("language = 'es'")).select("question_id").distinct().withColumn("found", F.lit(True))
    missing = "empty_knowledge_base" if eligible.isEmpty() else "no_relevant_content"
    asked = table(spark, folder, "questions").select("question_id").distinct().join(found, "question_id", "left")
    return asked.select("question_id", F.when(F.col("found"), "candidates").otherwise(missing).alias("reason"))


PARTS_SQL = f"""WITH {sql.VISIBLE}, {sql.ASKED}, raws AS (SELECT chunk_id, {sql.raw_tokens("text")} AS raw FROM eligible),
lined AS (SELECT chunk_id, {sql.parts("list_filter(raw, lambda x, i: list_position(raw, x) = i)")} AS parts FROM raws),
line AS (SELECT chunk_id, len(parts) AS len, ' ' || array_to_string(parts, '  ') || ' ' AS line FROM lined),
stats AS (SELECT count(*) AS n, avg(len) AS mean FROM line),
want AS (SELECT question_id, unnest(terms) AS term FROM question_terms), terms AS (SELECT DISTINCT term, {sql.parts("[term]")} AS sought FROM want),
hit AS (SELECT term, chunk_id, len, len(list_filter(range(1, length(line) + 1), lambda i: line[i : i + length(p) - 1] = p)) AS tf
  FROM (SELECT term, ' ' || array_to_string(sought, '  ') || ' ' AS p FROM terms WHERE len(sought) > 0), line WHERE contains(line, p)),
df AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
scored AS (SELECT question_id, chunk_id, -sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
  * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS bm25 FROM want JOIN hit USING (term) JOIN df USING (term), stats GROUP BY question_id, chunk_id)
SELECT question_id, chunk_id, round(bm25, 5) AS bm25, row_number() OVER (PARTITION BY question_id ORDER BY round(bm25, 9), chunk_id) AS lexical_rank FROM scored
QUALIFY lexical_rank <= 30"""


@CORE.query("bm25_parts_topk", PARTS_SQL)
def bm25_parts_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The thirty best eligible chunks for every question by the parts of words, so that a number in a code is found."""
    found = lexical.bm25(_asked(spark, folder), _tokens_of(_eligible(spark, folder)), 30, parts=True)
    return found.select("question_id", "chunk_id", F.round("bm25", 5).alias("bm25"), "lexical_rank")


# ------------------------------------------------------------------------------------------------------------------- answers

SENTENCE_COLUMNS = "chunk_id, start, \"end\", text"


@CORE.query("sentence_spans", f"WITH {sql.sentences('(SELECT DISTINCT chunk_id, text FROM chunks)', 'chunk_id')} SELECT {SENTENCE_COLUMNS} FROM sentences")
def sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences for quoting, of every chunk, with offsets."""
    return table(spark, folder, "chunks").select("chunk_id", "text").distinct().select("chunk_id", F.inline(t.sentence_spans(F.col("text"))))


def _top(spark: SparkSession, folder: str, k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    chunks = checkpointed(_citable(spark, folder).withColumn("tokens", t.tokenize(F.col("text"))))
    fused = fusion.fuse(*_arms(spark, folder), limit=k, allowed=chunks)
    top = checkpointed(fused.join(chunks.select("chunk_id", "text", "tokens"), "chunk_id"))
    terms = _asked(spark, folder).select("question_id", F.explode("terms").alias("term"))
    return top, terms, chunks


PICK_SQL = f"""{sql.VISIBLE}, {sql.ASKED}, {sql.ARMS}, {sql.fused(0.9, 0.1, 100000)},
top AS (SELECT r.question_id, r.chunk_id, r.score, row_number() OVER (PARTITION BY r.question_id ORDER BY r.score DESC, r.chunk_id) AS rank, e.text, c.tokens
  FROM ranked r JOIN eligible e USING (chunk_id) JOIN chunk_tokens c USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY r.question_id ORDER BY r.score DESC, r.chunk_id) <= 5),
want AS (SELECT question_id, unnest(terms) AS term FROM question_terms),
n AS (SELECT question_id, count(*) AS n FROM top GROUP BY question_id),
df AS (SELECT question_id, term, count(*) AS df FROM (SELECT question_id, unnest(tokens) AS term FROM top) JOIN want USING (question_id, term) GROUP BY ALL),
weight AS (SELECT w.question_id, w.term, coalesce(greatest(1, ln(n / df) + 1), 1) AS idf FROM want w LEFT JOIN df USING (question_id, term) LEFT JOIN n USING (question_id)),
total AS (SELECT question_id, sum(idf) AS all_idf FROM weight GROUP BY question_id),
{sql.sentences('(SELECT DISTINCT chunk_id, text FROM top)', 'chunk_id')},
held AS (SELECT t.question_id, s.chunk_id, s.start, s."end", t.rank, t.score, sum(w.idf) AS held FROM sentences s JOIN top t USING (chunk_id)
  JOIN (SELECT chunk_id, start, unnest({sql.tokens("text")}) AS term FROM sentences) x ON x.chunk_id = s.chunk_id AND x.start = s.start
  JOIN weight w ON w.question_id = t.question_id AND w.term = x.term GROUP BY ALL),
kept AS (SELECT h.*, held / all_idf + 0.1 * score AS sentence_score FROM held h JOIN total USING (question_id) WHERE round(held / all_idf, 9) >= 0.15),
inner_rank AS (SELECT *, row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY round(sentence_score, 9) DESC, start) AS nth FROM kept QUALIFY nth <= 5),
picked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank, nth) AS spent FROM inner_rank QUALIFY spent <= 5)"""


@CORE.query("picked_sentences", f"WITH {PICK_SQL} SELECT question_id, chunk_id, rank, start, \"end\", round(sentence_score, 6) AS sentence_score FROM picked")
def picked_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences quoted for every question out of the first five eligible candidates, with their scores."""
    top, terms, _ = _top(spark, folder)
    return answering.select_sentences(top, terms).select("question_id", "chunk_id", "rank", "start", "end", F.round("sentence_score", 6).alias("sentence_score"))


QUOTE_SQL = f"""{PICK_SQL}, first AS (SELECT t.question_id, t.chunk_id, min(s.start) AS start, max(s."end") AS "end" FROM top t JOIN (
    SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY start) AS k FROM sentences) s USING (chunk_id)
    WHERE t.rank = 1 AND k <= 5 AND t.question_id NOT IN (SELECT question_id FROM picked) GROUP BY ALL),
spans AS (SELECT question_id, chunk_id, start, "end" FROM picked UNION ALL SELECT * FROM first),
gaps AS (SELECT s.*, e.text, e.doc_id, e.doc_version, e.ordinal, lag(s."end") OVER (PARTITION BY question_id, chunk_id ORDER BY s.start) AS before FROM spans s JOIN eligible e USING (chunk_id)),
islands AS (SELECT *, sum(CASE WHEN before IS NULL OR NOT regexp_full_match(text[before + 1 : start], '[\\s\\p{{Z}}]*') THEN 1 ELSE 0 END) OVER (PARTITION BY question_id, chunk_id ORDER BY start) AS island FROM gaps),
merged AS (SELECT question_id, chunk_id, doc_id, doc_version, ordinal, any_value(text) AS text, min(start) AS start, max("end") AS "end" FROM islands GROUP BY question_id, chunk_id, doc_id, doc_version, ordinal, island),
quoted AS (SELECT question_id, dense_rank() OVER (PARTITION BY question_id ORDER BY doc_id, doc_version, ordinal, chunk_id) AS citation_id, chunk_id, start, "end", text[start + 1 : "end"] AS slice FROM merged)"""


@CORE.query("quoted_slices", f"WITH {QUOTE_SQL} SELECT * FROM quoted")
def quoted_slices(spark: SparkSession, folder: str) -> DataFrame:
    """What is quoted for every question, merged and numbered, with the fallback where no sentence is good enough."""
    top, terms, chunks = _top(spark, folder)
    return answering.quoted_slices(top, terms, chunks)


def _from_arms(spark: SparkSession, folder: str) -> DataFrame:
    top, terms, chunks = _top(spark, folder)
    judged = gate.verdict(gate.signals(_covered(spark, folder)))
    return answering.build_answers(_asked(spark, folder), top, terms, chunks, judged)


@CORE.query(
    "answers_from_arms",
    f"""WITH {QUOTE_SQL}, window_of AS (SELECT * FROM ranked WHERE rank <= 30), {sql.SIGNALS.replace("ranked r", "window_of r")},
    gated AS (SELECT question_id, CASE WHEN max_dense >= 0.54 AND token_coverage >= 0.4 THEN 'dense+coverage' WHEN token_coverage >= 0.75 THEN 'exact_terms' ELSE 'below_threshold' END AS verdict,
      round(least(1, greatest(0, 0.4 * token_coverage + 0.3 * max_dense + 0.3 * lexical)), 4) AS evidence FROM signals),
    said AS (SELECT question_id, string_agg(slice || ' [' || citation_id || ']', ' ' ORDER BY citation_id, start) AS answer FROM quoted GROUP BY question_id)
    SELECT q.question_id, CASE WHEN len(terms) = 0 THEN 'invalid_question' WHEN verdict <> 'below_threshold' AND said.answer IS NOT NULL THEN 'answered' ELSE 'insufficient_information' END AS status,
    CASE WHEN len(terms) > 0 AND verdict <> 'below_threshold' AND said.answer IS NOT NULL THEN said.answer WHEN {sql.detected("question")} = 'fa' THEN 'اطلاعات کافی در اسناد ارائه‌شده وجود ندارد.'
    ELSE 'Not enough information in the provided documents.' END AS answer,
    CASE WHEN len(terms) > 0 AND verdict <> 'below_threshold' AND said.answer IS NOT NULL THEN evidence ELSE 0 END AS evidence_score
    FROM question_terms q JOIN asked USING (question_id) LEFT JOIN gated USING (question_id) LEFT JOIN said USING (question_id)""",
)
def answers_from_arms(spark: SparkSession, folder: str) -> DataFrame:
    """Answer or refusal for every question from the stored arms."""
    return _from_arms(spark, folder).select("question_id", "status", "answer", "evidence_score")


@CORE.query(
    "citation_records",
    f"""WITH {QUOTE_SQL}, named AS (SELECT doc_id, max(source_name) AS document FROM eligible_snapshots GROUP BY doc_id)
    SELECT DISTINCT q.question_id, q.citation_id, q.chunk_id, coalesce(document, '') AS document, array_to_string(from_json(section_path_json, '["VARCHAR"]'), ' > ') AS section, coalesce(page_start, -1) AS page,
    CASE WHEN line_start IS NULL OR line_end IS NULL THEN '' ELSE line_start || '-' || line_end END AS lines, char_start || '-' || (char_start + length(e.text)) AS char_span, sha256(e.text) AS excerpt_hash,
    round(t.score, 4) AS score FROM quoted q JOIN eligible e USING (chunk_id) JOIN top t ON t.question_id = q.question_id AND t.chunk_id = q.chunk_id LEFT JOIN named n ON n.doc_id = e.doc_id""",
)
def citation_records(spark: SparkSession, folder: str) -> DataFrame:
    """Citations of every question that would be answered, whatever the gate says, with all that they show."""
    top, terms, chunks = _top(spark, folder)
    laid = answering.quoted_slices(top, terms, chunks).select("question_id", "citation_id", "chunk_id").distinct().join(chunks, "chunk_id").join(top.select("question_id", "chunk_id", "score"), ["question_id", "chunk_id"])
    c = laid.select("question_id", answering.citation_record().alias("c"))
    joined = lambda a: F.coalesce(F.array_join(F.transform(a, lambda x: x.cast("string")), "-"), F.lit(""))
    return c.select(
        "question_id", "c.citation_id", "c.chunk_id", F.coalesce("c.document", F.lit("")).alias("document"), "c.section", F.coalesce("c.page", F.lit(-1)).alias("page"),
        joined(F.col("c.lines")).alias("lines"), joined(F.col("c.char_span")).alias("char_span"), identity.content_hash(F.col("c.excerpt")).alias("excerpt_hash"), "c.score",
    )


@CORE.query(
    "verify_planted",
    """WITH k AS (SELECT chunk_id, max(text) AS text FROM chunks GROUP BY chunk_id), v AS (SELECT doc_id, version AS doc_version, max(source_text) AS source_text FROM document_versions GROUP BY ALL),
    c AS (SELECT DISTINCT question_id, citation_no, CASE WHEN citation_no = 3 THEN chunk_id || 'x' ELSE chunk_id END AS chunk_id, doc_id, doc_version,
      CASE WHEN citation_no = 2 THEN char_start + 1 ELSE char_start END AS char_start, char_end, CASE WHEN citation_no = 1 THEN upper(excerpt) || '!' ELSE excerpt END AS excerpt FROM citations),
    j AS (SELECT c.*, k.text, substring(source_text, char_start + 1, char_end - char_start) AS slice FROM c LEFT JOIN k USING (chunk_id) LEFT JOIN v USING (doc_id, doc_version))
    SELECT question_id, citation_no, CASE WHEN text IS NULL THEN 'no_chunk' WHEN excerpt IS DISTINCT FROM text THEN 'excerpt_differs' ELSE 'slice_differs' END AS problem
    FROM j WHERE text IS NULL OR excerpt IS DISTINCT FROM text OR slice IS DISTINCT FROM text""",
)
def verify_planted(spark: SparkSession, folder: str) -> DataFrame:
    """What the verification finds when every first citation is altered, every second shifted and every third names no chunk."""
    no = F.col("citation_no")
    planted = table(spark, folder, "citations").withColumns(
        {
            "excerpt": F.when(no == 1, F.concat(F.upper("excerpt"), F.lit("!"))).otherwise(F.col("excerpt")),
            "char_start": F.when(no == 2, F.col("char_start") + 1).otherwise(F.col("char_start")),
            "chunk_id": F.when(no == 3, F.concat("chunk_id", F.lit("x"))).otherwise(F.col("chunk_id")),
        }
    )
    return answering.verify_citations(planted, table(spark, folder, "chunks"), table(spark, folder, "document_versions"))


# ---------------------------------------------------------------------------------------------------------------- evaluation
# Cases are made of the stored tables: the golds of a question are the openings of its two best cited chunks, every question whose
# length is no multiple of three counts as answerable, and the answer cites what was cited second and later.

CASE_SQL = f"""{GATE_WITH}, k AS (SELECT chunk_id, max(text) AS text, max(doc_id) AS doc FROM chunks GROUP BY chunk_id),
golds AS (SELECT d.question_id AS case_id, d.dense_rank AS gold_id, doc, substring(text, 1, 24) AS phrase FROM dense d JOIN k USING (chunk_id) WHERE dense_rank <= 2),
cand AS (SELECT question_id AS case_id, rank, doc, text FROM ranked JOIN k USING (chunk_id)),
cites AS (SELECT DISTINCT question_id AS case_id, doc_id AS doc, excerpt FROM citations WHERE citation_no > 1),
found AS (SELECT g.case_id, g.gold_id, min(CASE WHEN contains(text, phrase) THEN rank END) AS rank FROM golds g LEFT JOIN cand c ON c.case_id = g.case_id AND c.doc = g.doc GROUP BY ALL),
hit AS (SELECT case_id, CASE WHEN count(*) = count(rank) THEN max(rank) END AS hit_rank FROM found GROUP BY case_id),
quote AS (SELECT case_id, count(*) AS golds, count(*) FILTER (WHERE held) AS quoted FROM (
  SELECT g.case_id, g.gold_id, coalesce(bool_or(contains(excerpt, phrase)), false) AS held FROM golds g LEFT JOIN cites c USING (case_id) GROUP BY ALL) GROUP BY case_id),
verdicts AS (SELECT question_id AS case_id, max_dense >= 0.54 AND token_coverage >= 0.4 OR token_coverage >= 0.75 AS passed FROM signals),
cases AS (SELECT a.question_id AS case_id, length(a.question) % 3 <> 0 AS answerable, coalesce(passed, false) AS answered, hit_rank, golds, quoted
  FROM asked a LEFT JOIN verdicts v ON v.case_id = a.question_id LEFT JOIN hit h ON h.case_id = a.question_id LEFT JOIN quote q ON q.case_id = a.question_id)"""


def _golds(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks").groupBy("chunk_id").agg(F.max("text").alias("text"), F.max("doc_id").alias("doc"))
    best = _arms(spark, folder)[0].where("dense_rank <= 2").join(chunks, "chunk_id")
    return best.select(F.col("question_id").alias("case_id"), F.col("dense_rank").alias("gold_id"), "doc", F.substring("text", 1, 24).alias("phrase"))


def _cited(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "citations").where("citation_no > 1").select(F.col("question_id").alias("case_id"), F.col("doc_id").alias("doc"), "excerpt").distinct()


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks").groupBy("chunk_id").agg(F.max("text").alias("text"), F.max("doc_id").alias("doc"))
    return fusion.fuse(*_arms(spark, folder)).join(chunks, "chunk_id").select(F.col("question_id").alias("case_id"), "rank", "doc", "text")


def _cases(spark: SparkSession, folder: str) -> DataFrame:
    golds, ids = checkpointed(_golds(spark, folder)), F.col("question_id").alias("case_id")
    hits = evaluation.hit_ranks(evaluation.gold_ranks(golds, _candidates(spark, folder)))
    quoted = evaluation.gold_quoted(golds, _cited(spark, folder))
    passed = gate.verdict(gate.signals(_covered(spark, folder))).select(ids, "passed")
    asked = _asked(spark, folder).select(ids, (F.length("question") % 3 != 0).alias("answerable"))
    joined = asked.join(passed, "case_id", "left").join(hits, "case_id", "left").join(quoted, "case_id", "left")
    return joined.withColumn("answered", F.coalesce("passed", F.lit(False))).drop("passed")


@CORE.query("gold_ranks", f"{CASE_SQL} SELECT case_id, gold_id, coalesce(rank, 0) AS rank FROM found")
def gold_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Rank of the first candidate that holds each gold, two golds a question; 0 for none."""
    return evaluation.gold_ranks(_golds(spark, folder), _candidates(spark, folder)).withColumn("rank", F.coalesce("rank", F.lit(0)))


@CORE.query("gold_hit_ranks", f"{CASE_SQL} SELECT case_id, coalesce(hit_rank, 0) AS hit_rank FROM hit")
def gold_hit_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Where both golds of every question have been seen; 0 if one is missing."""
    found = evaluation.hit_ranks(evaluation.gold_ranks(_golds(spark, folder), _candidates(spark, folder)))
    return found.withColumn("hit_rank", F.coalesce("hit_rank", F.lit(0)))


@CORE.query("gold_quoted", f"{CASE_SQL} SELECT * FROM quote")
def gold_quoted(spark: SparkSession, folder: str) -> DataFrame:
    """Golds of every question and how many of them the cited excerpts hold."""
    return evaluation.gold_quoted(_golds(spark, folder), _cited(spark, folder))


METRIC_SQL = """count(*) FILTER (WHERE answerable) AS answerable_cases, count(*) FILTER (WHERE NOT answerable) AS other_cases,
coalesce(round(avg(CASE WHEN hit_rank <= 1 THEN 1.0 ELSE 0 END) FILTER (WHERE answerable), 6), 0) AS recall_1,
coalesce(round(avg(CASE WHEN hit_rank <= 3 THEN 1.0 ELSE 0 END) FILTER (WHERE answerable), 6), 0) AS recall_3,
coalesce(round(avg(CASE WHEN hit_rank <= 5 THEN 1.0 ELSE 0 END) FILTER (WHERE answerable), 6), 0) AS recall_5,
coalesce(round(avg(CASE WHEN hit_rank <= 5 THEN 1.0 / hit_rank ELSE 0 END) FILTER (WHERE answerable), 6), 0) AS mrr_5,
coalesce(round(avg(answered::INT) FILTER (WHERE answerable), 6), 0) AS answered_rate, coalesce(round(avg(answered::INT) FILTER (WHERE NOT answerable), 6), 0) AS false_rate,
count(*) FILTER (WHERE NOT answerable AND answered) AS false_answers,
coalesce(round(sum(quoted) FILTER (WHERE answerable AND answered) / sum(golds) FILTER (WHERE answerable AND answered), 6), 0) AS quoted_share,
coalesce(round(avg(coalesce((golds > 0 AND quoted = golds)::INT, 0)) FILTER (WHERE answerable AND answered), 6), 0) AS fully_quoted"""
RATES = ("recall_1", "recall_3", "recall_5", "mrr_5", "answered_rate", "false_rate", "quoted_share", "fully_quoted")


@CORE.query("case_metrics", f"{CASE_SQL} SELECT {METRIC_SQL} FROM cases")
def case_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """All rates over these cases."""
    found = evaluation.case_metrics(_cases(spark, folder))
    return found.withColumns({c: F.round(c, 6) for c in RATES})


@CORE.query(
    "missed_golds",
    f"""{CASE_SQL} SELECT g.case_id, g.gold_id, CASE WHEN NOT EXISTS (SELECT 1 FROM cites c WHERE c.case_id = g.case_id AND c.doc = g.doc) THEN 'retrieval'
    WHEN f.rank <= 5 THEN 'answerer' ELSE 'truncation' END AS cause FROM golds g LEFT JOIN found f USING (case_id, gold_id)
    WHERE NOT EXISTS (SELECT 1 FROM cites c WHERE c.case_id = g.case_id AND contains(c.excerpt, g.phrase))""",
)
def missed_golds(spark: SparkSession, folder: str) -> DataFrame:
    """Why each gold that no excerpt holds was missed."""
    golds = checkpointed(_golds(spark, folder))
    return evaluation.missed_golds(golds, evaluation.gold_ranks(golds, _candidates(spark, folder)), _cited(spark, folder))


BARS = ((0, 0.54, 0.40, 0.75), (1, 0.30, 0.20, 0.50), (2, 0.90, 0.80, 0.95), (3, 0.0, 0.0, 0.0))


@CORE.query(
    "regate",
    f"""{CASE_SQL}, bars AS (SELECT * FROM (VALUES {", ".join(map(str, BARS))}) b(config, min_dense, min_coverage, min_coverage_high)),
    judged AS (SELECT config, answerable, coalesce(round(max_dense, 6) >= min_dense AND round(token_coverage, 6) >= min_coverage OR round(token_coverage, 6) >= min_coverage_high, false) AS passed
      FROM cases c JOIN signals s ON s.question_id = c.case_id, bars)
    SELECT config, round(avg(passed::INT) FILTER (WHERE answerable), 6) AS answered_rate, round(avg(passed::INT) FILTER (WHERE NOT answerable), 6) AS false_rate,
    count(*) FILTER (WHERE NOT answerable AND passed) AS false_answers FROM judged GROUP BY config""",
)
def regate(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of the gate under four sets of bars, from the stored signals."""
    found = gate.signals(_covered(spark, folder)).withColumnRenamed("question_id", "case_id")
    found = found.withColumns({c: F.round(c, 6) for c in ("max_dense", "token_coverage")})
    bars = spark.createDataFrame([tuple(map(float, b)) for b in BARS], "config double, min_dense double, min_coverage double, min_coverage_high double")
    judged = evaluation.regate(found, bars.withColumn("config", F.col("config").cast("int")))
    asked = _asked(spark, folder).select(F.col("question_id").alias("case_id"), (F.length("question") % 3 != 0).alias("answerable"))
    rates = evaluation.gate_metrics(judged.join(asked, "case_id"), "config")
    return rates.withColumns({c: F.round(c, 6) for c in ("answered_rate", "false_rate")})


@CORE.query(
    "arm_sweep",
    f"""{CASE_SQL}, w AS (SELECT unnest(range(0, 11)) AS config), u AS (
    SELECT coalesce(d.question_id, l.question_id) AS question_id, coalesce(d.chunk_id, l.chunk_id) AS chunk_id, d.dense_rank, l.lexical_rank
    FROM dense d FULL JOIN lexical_scored l ON d.question_id = l.question_id AND d.chunk_id = l.chunk_id),
    sc AS (SELECT config, question_id, chunk_id, coalesce(CASE WHEN config > 0 THEN round(config / 10, 1) / (60 + dense_rank) END, 0)
     + coalesce(CASE WHEN config < 10 THEN round(1 - config / 10, 1) / (60 + lexical_rank) END, 0) AS score FROM u, w),
    rk AS (SELECT config, question_id, chunk_id, row_number() OVER (PARTITION BY config, question_id ORDER BY score DESC, chunk_id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 30),
    gr AS (SELECT w.config, g.case_id, g.gold_id, min(CASE WHEN contains(k.text, phrase) AND k.doc = g.doc THEN rank END) AS rank FROM golds g CROSS JOIN w
      LEFT JOIN rk ON rk.question_id = g.case_id AND rk.config = w.config LEFT JOIN k ON k.chunk_id = rk.chunk_id GROUP BY ALL),
    hr AS (SELECT config, case_id, CASE WHEN count(*) = count(rank) THEN max(rank) END AS hit_rank FROM gr GROUP BY ALL)
    SELECT config, count(*) AS cases, round(avg(CASE WHEN hit_rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN hit_rank <= 3 THEN 1.0 ELSE 0 END), 6) AS recall_3,
    round(avg(CASE WHEN hit_rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN hit_rank <= 5 THEN 1.0 / hit_rank ELSE 0 END), 6) AS mrr_5 FROM hr GROUP BY config""",
)
def arm_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Recall and reciprocal rank for eleven pairs of weights, from the lexical arm alone to the dense arm alone."""
    near, words = _arms(spark, folder)
    weights = spark.range(11).select(
        F.col("id").cast("int").alias("config"), F.round(F.col("id") / 10, 1).alias("dense_weight"), F.round(1 - F.col("id") / 10, 1).alias("lexical_weight")
    )
    chunks = table(spark, folder, "chunks").groupBy("chunk_id").agg(F.max("text").alias("text"), F.max("doc_id").alias("doc"))
    case = F.struct("config", F.col("question_id").alias("case")).alias("case_id")
    found = fusion.fused_by_weight(near, words, weights, limit=30).join(chunks, "chunk_id").select(case, "rank", "doc", "text")
    golds = _golds(spark, folder).withColumnRenamed("case_id", "question_id").crossJoin(F.broadcast(weights.select("config")))  # eleven rows
    hits = evaluation.hit_ranks(evaluation.gold_ranks(golds.select(case, "gold_id", "doc", "phrase"), found))
    rates = evaluation.retrieval_metrics(hits.select("case_id.config", "hit_rank"), "config")
    return rates.withColumns({c: F.round(c, 6) for c in ("recall_1", "recall_3", "recall_5", "mrr_5")})


@CORE.query(
    "stale_leaks",
    f"""WITH {sql.VISIBLE}, old AS (SELECT DISTINCT c.doc_id, substring(c.text, 1, 24) AS phrase FROM chunks c JOIN visible v USING (doc_id) WHERE v.current_version IS NOT NULL AND c.doc_version < v.current_version),
    now AS (SELECT doc_id, max(source_text) AS source_text FROM document_versions JOIN visible USING (doc_id) WHERE version = current_version GROUP BY doc_id),
    gone AS (SELECT old.doc_id, phrase FROM old JOIN now USING (doc_id) WHERE NOT contains(source_text, phrase)),
    quotes AS (SELECT question_id AS case_id, doc_id, excerpt FROM citations UNION SELECT 'planted ' || chunk_id, doc_id, text FROM chunks WHERE doc_version = 1)
    SELECT DISTINCT c.case_id, phrase FROM quotes c JOIN gone USING (doc_id) WHERE contains(c.excerpt, phrase)""",
)
def stale_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Citations, and all chunks of first versions as planted ones, that quote the opening of an old chunk which the current text of
    its document no longer holds."""
    documents, chunks = _visible(spark, folder), table(spark, folder, "chunks")
    current = documents.where("current_version IS NOT NULL").select("doc_id", "current_version")
    old = chunks.join(current, "doc_id").where("doc_version < current_version").select("doc_id", F.substring("text", 1, 24).alias("phrase")).distinct()
    now = corpus.source_texts(table(spark, folder, "document_versions"), documents)
    gone = old.join(now, "doc_id").where(~F.contains("source_text", F.col("phrase"))).select(F.col("doc_id").alias("doc"), "phrase")
    quotes = table(spark, folder, "citations").select(F.col("question_id").alias("case_id"), F.col("doc_id").alias("doc"), "excerpt")
    planted = chunks.where("doc_version = 1").select(F.concat(F.lit("planted "), "chunk_id").alias("case_id"), F.col("doc_id").alias("doc"), F.col("text").alias("excerpt"))
    quotes = quotes.unionByName(planted).distinct()
    return evaluation.stale_leaks(quotes, gone)


# ----------------------------------------------------------------------------------------------------- parsing, chunking, vectors

BLOCK_SQL = r"""
docs AS (SELECT DISTINCT doc_id, replace(replace(regexp_replace(text, '^\x{feff}', ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM docs),
placed AS (SELECT doc_id, text, n, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id, text ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place,
  NOT regexp_full_match(line, '[\s\p{Z}\x0b\x1c-\x1f\x85]*') AS filled FROM lines),
runs AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id, text, filled ORDER BY n) AS run FROM placed),
blocks AS (SELECT doc_id, min(n) AS line_start, max(n) AS line_end, min(place) AS begun, max(place + length(line)) AS done, any_value(text) AS text FROM runs WHERE filled GROUP BY doc_id, text, run),
bodies AS (SELECT *, substring(text, begun::INT + 1, (done - begun)::INT) AS body FROM blocks),
trimmed AS (SELECT doc_id, line_start, line_end, begun + length(body) - length(regexp_replace(body, '^[\s\p{Z}\x0b\x1c-\x1f\x85]+', '')) AS char_start,
  done - (length(body) - length(regexp_replace(body, '[\s\p{Z}\x0b\x1c-\x1f\x85]+$', ''))) AS char_end FROM bodies)"""


@CORE.query("text_blocks", f"WITH {BLOCK_SQL} SELECT doc_id, char_start::INT AS char_start, char_end::INT AS char_end, line_start::INT AS line_start, line_end::INT AS line_end FROM trimmed")
def text_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks between blank lines of every document, read as plain text whatever its format."""
    documents = table(spark, folder, "documents").select("doc_id", "text", "title").distinct().withColumn("kind", F.lit("txt"))
    found = section_rows(parse_texts(documents, "doc_id", "text", "kind", "title"))
    return found.select("doc_id", "char_start", "char_end", "line_start", "line_end")


TIGHT = EngineConfig(chunk_target_tokens=60, chunk_hard_max_tokens=120)

def _window_sql(c: EngineConfig) -> str:
    """Common tables that end with ``spans`` (chunk_id, a, b): the windows of every chunk's text as one section."""
    target, hard, overlap = c.target_chars, c.hard_chars, c.overlap_chars
    return f"""WITH RECURSIVE src AS (SELECT chunk_id, regexp_replace(max(text), '[\\s\\p{{Z}}]+$', '') AS text FROM chunks GROUP BY chunk_id),
big AS MATERIALIZED (SELECT chunk_id, text FROM src WHERE length(text) > {hard}), {sql.sentences("big", "chunk_id")},
numbered AS MATERIALIZED (SELECT chunk_id, start, "end", length(text) AS size, row_number() OVER (PARTITION BY chunk_id ORDER BY start) AS n FROM sentences),
fold AS (
  SELECT chunk_id, 0 AS n, 0 AS a, 0 AS b, CAST(NULL AS INT) AS out_a, CAST(NULL AS INT) AS out_b FROM big
  UNION ALL
  SELECT f.chunk_id, f.n + 1, CASE WHEN f.b > f.a AND f.b - f.a + s.size > {target} THEN greatest(f.a, f.b - {overlap}) ELSE f.a END, s."end"::INT,
    CASE WHEN f.b > f.a AND f.b - f.a + s.size > {target} THEN f.a END, CASE WHEN f.b > f.a AND f.b - f.a + s.size > {target} THEN f.b END
  FROM fold f JOIN numbered s ON s.chunk_id = f.chunk_id AND s.n = f.n + 1),
packed AS (SELECT chunk_id, out_a AS a, out_b AS b FROM fold WHERE out_a IS NOT NULL
  UNION ALL SELECT chunk_id, a, b FROM fold WHERE b > a QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY n DESC) = 1),
cut AS (SELECT chunk_id, a, b FROM packed WHERE b - a <= {hard}
  UNION ALL SELECT chunk_id, s, least(s + {hard}, b) FROM (SELECT chunk_id, b, unnest(range(a, greatest(a, b - 1) + 1, {max(1, hard - overlap)})) AS s FROM packed WHERE b - a > {hard})),
tail AS (SELECT c.chunk_id, last(c.a ORDER BY c.a, c.b) AS a, any_value(length(text)) AS b, max(c.b) AS most FROM cut c JOIN big USING (chunk_id) GROUP BY c.chunk_id),
spans AS (SELECT chunk_id, a, b FROM cut UNION ALL SELECT chunk_id, a, b FROM tail WHERE most < b
  UNION ALL SELECT chunk_id, 0, length(text) FROM src WHERE length(text) <= {hard})"""


@CORE.query(
    "chunk_windows",
    _window_sql(TIGHT) + """ SELECT chunk_id AS doc_id, row_number() OVER (PARTITION BY chunk_id ORDER BY a, b) - 1 AS ordinal, a AS char_start, b AS char_end FROM spans JOIN src USING (chunk_id)
    WHERE regexp_matches(substring(text, a + 1, b - a), '[^\\s\\p{Z}]')""".replace("\\\\", "\\"),
)
def chunk_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 90 characters, at most 180, for every chunk's text as one section."""
    found = chunking.chunk_sections(_as_sections(spark, folder), TIGHT, hashes=False)
    return found.select("doc_id", "ordinal", "char_start", "char_end")


def _as_sections(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "chunks").groupBy(F.col("chunk_id").alias("doc_id")).agg(F.regexp_replace(F.max("text"), r"[\s\p{Z}]+$", "").alias("body"))
    nothing = F.lit(None).cast("int")
    return texts.select(
        "doc_id", F.lit(0).alias("section_no"), F.lit(0).alias("char_start"), "body", F.array(F.lit("T")).alias("section_path"),
        *(nothing.alias(c) for c in ("page_start", "page_end", "line_start", "line_end")),
    )


SIZES = (EngineConfig(chunk_target_tokens=60, chunk_hard_max_tokens=120), EngineConfig(chunk_target_tokens=120, chunk_hard_max_tokens=240), EngineConfig())


@CORE.query("chunk_size_sweep")
def chunk_size_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Number and size of the windows under three settings."""
    sections, out = _as_sections(spark, folder), None
    for n, c in enumerate(SIZES):
        size = F.col("char_end") - F.col("char_start")
        one = chunking.chunk_sections(sections, c, hashes=False).agg(F.count("*").alias("chunks"), F.sum(size).alias("chars"), F.max(size).alias("longest"))
        one = one.select(F.lit(n).alias("config"), "*")
        out = one if out is None else out.unionByName(one)
    return out


HASH_SQL = """WITH asked AS (SELECT question_id, max(question) AS question FROM questions GROUP BY question_id),
words AS (SELECT question_id, unnest(CASE WHEN len(w) > 0 THEN w ELSE [''] END) AS word FROM (
  SELECT question_id, list_filter(string_split_regex(lower(question), '[\\s\\p{Z}]+'), lambda x: x <> '') AS w FROM asked)),
hashed AS (SELECT question_id, sha256(word) AS h FROM words),
signed AS (SELECT question_id, ('0x' || substring(h, 1, 16))::UBIGINT % 32 AS slot, CASE WHEN ('0x' || substring(h, 17, 2))::INT % 2 = 1 THEN 1 ELSE -1 END AS sign FROM hashed),
sums AS (SELECT question_id, s.slot, coalesce(sum(sign) FILTER (WHERE signed.slot = s.slot), 0) AS v FROM signed, (SELECT unnest(range(0, 32)) AS slot) s GROUP BY ALL),
lengths AS (SELECT question_id, sqrt(sum(v * v)) AS n FROM sums GROUP BY question_id)
SELECT question_id, slot::INT AS slot, round(CASE WHEN n > 0 THEN v / n ELSE v END, 9) AS value FROM sums JOIN lengths USING (question_id)"""


@CORE.query("hash_embedding_slots", HASH_SQL)
def hash_embedding_slots(spark: SparkSession, folder: str) -> DataFrame:
    """Model-free vectors of all questions, a row for each number."""
    vectors = _asked(spark, folder).select("question_id", hash_embedding(F.col("question")).alias("vector"))
    return vectors.select("question_id", F.posexplode("vector").alias("slot", "value")).withColumn("value", F.round("value", 9))


@CORE.query(
    "embed_requests",
    """WITH k AS (SELECT embed_input_hash AS input_hash, max(text) AS input FROM chunks WHERE embed_input_hash IS NOT NULL GROUP BY 1)
    SELECT input_hash, length(input) > 20000 AS refused FROM k WHERE input_hash NOT IN (SELECT input_hash FROM embedding_cache WHERE input_hash IS NOT NULL)""",
)
def embed_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every input without any cached vector, embedded by the model-free embedder in requests; a too long one is refused."""
    inputs = table(spark, folder, "chunks").where("embed_input_hash IS NOT NULL").groupBy(F.col("embed_input_hash").alias("input_hash")).agg(F.max("text").alias("input"))
    held = table(spark, folder, "embedding_cache").select("input_hash").distinct()
    found = ingest.embed_rows(inputs.join(held, "input_hash", "left_anti"), HashEmbedder)
    return found.where((F.size("vector") == 32) | F.col("error_code").isNotNull()).select("input_hash", F.col("error_code").isNotNull().alias("refused"))
