"""Common pieces of the SQL that the queries are held against."""

import unicodedata

# Written down here once more, so that a slip in the library's own tables shows.
# Fixed values: letters and digits folded to one form.
YEH_KAF, PLAIN_YEH_KAF = "\u064a\u0643\u0649", "\u06cc\u06a9\u06cc"
DIGITS = "".join(chr(0x660 + i) for i in range(10)) + "".join(chr(0x6F0 + i) for i in range(10))
FOLDED, FOLDED_TO = YEH_KAF + DIGITS, PLAIN_YEH_KAF + "0123456789" * 2
# Fixed values: words without weight, in the order of the alphabet.
STOPWORDS = (
    "a an and are as at be but by can could did do does for from has have he her his i in is it its no not of on or she should "
    "that the their them they this to was were what when where which who will with would you your "
    "آن از است اما این با بر برای به تا در دو دیگر را شد شود ها های هر هم همه و گفت می نیز کرد کند که یا یک بود"
).split()
# Fixed values: words after which a point ends no sentence.
SHORT_FORMS = "al co dr eq etc fig inc jr ltd mr mrs ms no prof sr st vs".split()

FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def quoted(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


def composed(column: str) -> str:
    """Compatibility composition as far as these tables need it: full-width forms, ligatures, no-break spaces and hyphens."""
    spaces = "\xa0   "
    t = f"translate({column}, {quoted(FULL + spaces + chr(0x2011))}, {quoted(HALF + '    ' + chr(0x2010))})"
    for ligature, letters in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("…", "...")):
        t = f"replace({t}, '{ligature}', '{letters}')"
    return f"nfc_normalize({t})"


def normalized(column: str) -> str:
    """The index form of a text."""
    latin, other = r"[A-Za-zÀ-ÖØ-öø-ɏ]", r"[^\P{L}A-Za-zÀ-ɏ]"
    t = f"translate({composed(column)}, {quoted(FOLDED)}, {quoted(FOLDED_TO)})"
    t = rf"regexp_replace({t}, '\p{{Cc}}', ' ', 'g')"
    t = f"replace(replace({t}, chr(8204), chr(57344)), chr(8205), chr(57345))"
    t = rf"regexp_replace({t}, '[\p{{Cf}}\p{{Mn}}\p{{Me}}\x{{0640}}]', '', 'g')"
    t = f"replace(replace({t}, chr(57344), chr(8204)), chr(57345), chr(8205))"
    t = rf"regexp_replace({t}, '({latin})({other})', '\1 \2', 'g')"
    t = rf"regexp_replace({t}, '({other})({latin})', '\1 \2', 'g')"
    return rf"trim(regexp_replace({t}, '[\s\p{{Z}}]+', ' ', 'g'))"


def raw_tokens(column: str) -> str:
    """Tokens of a text in their order, with repeats."""
    raw = rf"string_split_regex({normalized(column)}, '[^\p{{L}}\p{{N}}_\x{{200C}}\-.]+')"
    bare = rf"list_transform({raw}, lambda x: regexp_replace(regexp_replace(x, '\.+$', ''), '^[-_]+|[-_]+$', '', 'g'))"
    forms = (
        f"list_transform({bare}, lambda x: CASE WHEN contains(x, chr(8204)) "
        "THEN list_concat([x, replace(x, chr(8204), '')], string_split(x, chr(8204))) ELSE [x] END)"
    )
    return f"list_filter(list_transform(flatten({forms}), lambda x: lower(x)), lambda x: x <> '')"


def tokens(column: str) -> str:
    """Distinct tokens of a text, as a list in no order."""
    return f"list_distinct({raw_tokens(column)})"


MARKED = [chr(c) for c in range(0xC0, 0x250) if unicodedata.decomposition(chr(c)) and not unicodedata.decomposition(chr(c)).startswith("<")]


def _bare(char: str) -> str:
    while parts := unicodedata.decomposition(char):
        char = chr(int(parts.split()[0], 16))
    return char


def parts(column: str) -> str:
    """Letters and digits of a list of tokens, cut at everything else, without accents, in order."""
    plain = f"translate(array_to_string({column}, ' '), {quoted(''.join(MARKED))}, {quoted(''.join(map(_bare, MARKED)))})"
    return rf"list_filter(string_split_regex({plain}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def sentences(source: str, key: str) -> str:
    """Common tables that end with ``sentences`` (key, start, end, text) of a source with key and text."""
    short = ", ".join(map(quoted, SHORT_FORMS))
    return rf"""
source_rows AS (SELECT {key}, text FROM {source} WHERE text IS NOT NULL),
spots AS (SELECT {key}, text, unnest(range(1, length(text) + 1)) AS i FROM source_rows),
cuts AS (
  SELECT {key}, text, i FROM spots WHERE substring(text, i, 1) IN ('.', '!', '?', chr(1567), chr(1748))
  AND NOT (substring(text, i, 1) = '.' AND (regexp_full_match(substring(text, i + 1, 1), '\p{{Nd}}')
    OR lower(regexp_extract(substring(text, 1, i - 1), '([^	

 ]*)$', 1)) IN ({short})))
), ends AS (SELECT * FROM cuts UNION SELECT {key}, text, length(text) FROM source_rows),
bounds AS (SELECT {key}, text, i AS stop, coalesce(lag(i) OVER (PARTITION BY {key}, text ORDER BY i), 0) AS since FROM ends),
bare AS (SELECT {key}, stop, regexp_replace(substring(text, since + 1, stop - since), '^[\s\p{{Z}}]+', '') AS bare FROM bounds),
sentences AS (SELECT {key}, stop - length(bare) AS start, stop AS "end", bare AS text FROM bare WHERE bare <> '')"""


STOP = "[" + ", ".join(map(quoted, STOPWORDS)) + "]"


def terms(column: str) -> str:
    """Tokens of a question without the stopwords."""
    return f"list_filter({tokens(column)}, lambda x: NOT list_contains({STOP}, x))"


def detected(column: str) -> str:
    """Language by the share of the scripts."""
    a = rf"len(regexp_extract_all({column}, '[\x{{0600}}-\x{{06FF}}\x{{0750}}-\x{{077F}}\x{{FB50}}-\x{{FDFF}}\x{{FE70}}-\x{{FEFF}}]'))"
    b = rf"len(regexp_extract_all({column}, '[A-Za-z\x{{00C0}}-\x{{024F}}]'))"
    return (
        f"CASE WHEN {a} + {b} = 0 THEN 'en' WHEN {a} >= 0.2 * ({a} + {b}) AND {b} >= 0.2 * ({a} + {b}) THEN 'mixed' "
        f"WHEN {a} >= 0.2 * ({a} + {b}) THEN 'fa' ELSE 'en' END"
    )


VISIBLE = """
visible AS (
  SELECT doc_id, max(version) FILTER (WHERE state = 'published') AS current_version, max(version) AS last_version
  FROM document_versions GROUP BY doc_id
), eligible AS (
  SELECT DISTINCT ON (c.chunk_id) c.* FROM chunks c
  JOIN visible v ON c.doc_id = v.doc_id AND c.doc_version = v.current_version
)"""

ASKED = f"""
asked AS (
  SELECT question_id, any_value(question) AS question FROM questions GROUP BY question_id
), question_terms AS (
  SELECT question_id, {terms("question")} AS terms FROM asked
), chunk_tokens AS (
  SELECT chunk_id, {tokens("text")} AS tokens FROM eligible
)"""

ARMS = """
hits AS (
  SELECT question_id, chunk_id, min(bm25) AS bm25 FROM lexical_hits
  WHERE bm25 IS NOT NULL AND NOT isnan(bm25) GROUP BY ALL
), lexical AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(bm25, 9), chunk_id) AS lexical_rank FROM hits
  QUALIFY lexical_rank <= 30
), lexical_scored AS (
  SELECT *, CASE WHEN min(bm25) OVER (PARTITION BY question_id) < 0
            THEN bm25 / min(bm25) OVER (PARTITION BY question_id) ELSE 0 END AS lexical_score FROM lexical
), cited AS (
  SELECT question_id, chunk_id, max(score) AS score FROM citations
  WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL
), dense AS (
  SELECT question_id, chunk_id, score / max(score) OVER (PARTITION BY question_id) AS similarity,
         row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS dense_rank FROM cited
  QUALIFY dense_rank <= 60
)"""


def fused(dense_weight: float, lexical_weight: float, limit: int = 30) -> str:
    """Common table ``fused`` over the arms."""
    dense = "dense" if dense_weight else "(SELECT * FROM dense WHERE false)"
    lexical = "lexical_scored" if lexical_weight else "(SELECT * FROM lexical_scored WHERE false)"
    return f"""
fused AS (
  SELECT coalesce(d.question_id, l.question_id) AS question_id, coalesce(d.chunk_id, l.chunk_id) AS chunk_id,
         d.dense_rank, d.similarity, l.lexical_rank, l.bm25, l.lexical_score,
         coalesce({dense_weight} / (60 + d.dense_rank), 0) + coalesce({lexical_weight} / (60 + l.lexical_rank), 0) AS score
  FROM {dense} d FULL JOIN {lexical} l ON d.question_id = l.question_id AND d.chunk_id = l.chunk_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM fused
  QUALIFY rank <= {limit}
)"""


SIGNALS = f"""
covered AS (
  SELECT r.*, CASE WHEN len(q.terms) > 0 THEN len(list_intersect(q.terms, t.tokens)) / len(q.terms) ELSE 0 END AS token_coverage
  FROM ranked r JOIN question_terms q USING (question_id)
  JOIN (SELECT chunk_id, {tokens("text")} AS tokens FROM (SELECT chunk_id, any_value(text) AS text FROM chunks GROUP BY chunk_id)) t USING (chunk_id)
), signals AS (
  SELECT question_id, least(1, greatest(0, coalesce(max(similarity), 0))) AS max_dense,
         least(1, greatest(0, coalesce(max(lexical_score), 0))) AS lexical,
         least(1, greatest(0, coalesce(max(token_coverage), 0))) AS token_coverage,
         coalesce(count(*) FILTER (WHERE dense_rank <= 5 AND lexical_rank <= 5)
           / nullif(count(*) FILTER (WHERE dense_rank <= 5 OR lexical_rank <= 5), 0), 0) AS overlap,
         count(*) AS candidate_count
  FROM covered GROUP BY question_id
)"""
