"""Index-side text functions as columns. Stored text is never changed by them, only what is indexed and compared."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ZWNJ = "‌"
LATIN = r"A-Za-z\x{00C0}-\x{024F}"
ARABIC = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
#: Share of letters from which a script counts as present.
LEAST_SHARE = 0.2

# Words without weight in coverage and sentence scores; they are indexed like others.
STOPWORDS = tuple(
    (
        "a an and are as at be but by for from has have he her his i in is it its of on or "
        "she that the their them they this to was were what when where which who will with "
        "you your not no do does did can could should would "
        "و در به از که این را با است برای آن یک تا هم بر یا می شود اما های ها بود "
        "گفت کرد کند شد هر دو نیز همه دیگر"
    ).split()
)
# Letters and digits folded to one form.
FOLDED = "يكى٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
FOLDED_TO = "یکی01234567890123456789"
# Sentence terminators, and words after which a point ends no sentence.
TERMINATORS = ".!?؟۔"
ABBREVIATIONS = "dr mr mrs ms prof sr jr st vs etc fig no inc ltd co al eq".split()


def nfkc(text: Column) -> Column:
    """Compatibility composition; only texts beyond ASCII leave the JVM, in Arrow batches."""

    @F.pandas_udf(T.StringType())
    def form(texts):
        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return F.when(F.regexp_like(text, F.lit(r"^\p{ASCII}*$")), text).otherwise(form(text))


def fold(text: Column) -> Column:
    """Everything of ``normalize`` but the compatibility composition; stays in the JVM."""
    t = F.translate(text, FOLDED, FOLDED_TO)
    t = F.regexp_replace(t, r"\p{Cc}", " ")
    t = F.regexp_replace(t, r"[\p{Cf}\p{Mn}\p{Me}\x{0640}&&[^\x{200C}\x{200D}]]", "")
    t = F.regexp_replace(t, rf"(?<=[{LATIN}&&\p{{L}}])(?=[\p{{L}}&&[^{LATIN}]])", " ")
    t = F.regexp_replace(t, rf"(?<=[\p{{L}}&&[^{LATIN}]])(?=[{LATIN}&&\p{{L}}])", " ")
    return F.trim(F.regexp_replace(t, r"[\s\p{Z}\x{0085}]+", " "))


def normalize(text: Column) -> Column:
    """One spelling for the index: composed, letters and digits folded, invisible characters dropped, scripts parted,
    white space single. Letter case is kept, as are both joiners; null stays null."""
    return fold(nfkc(text))


def tokens_of_normal(normal: Column) -> Column:
    """Distinct lower-case tokens, in order of appearance, of a normalised text.

    Points, hyphens and underscores belong to a token inside it. A token with a zero-width non-joiner counts three
    ways: as it is, joined, and in its parts.
    """
    raw = F.split(normal, r"[^\p{L}\p{N}_\x{200C}\-.]+")
    bare = F.transform(raw, lambda t: F.regexp_replace(F.regexp_replace(t, r"\.+$", ""), r"^[-_]+|[-_]+$", ""))
    joined = F.lit(ZWNJ)
    forms = F.transform(
        bare,
        lambda t: F.when(
            F.contains(t, joined), F.concat(F.array(t, F.replace(t, joined, F.lit(""))), F.split(t, ZWNJ))
        ).otherwise(F.array(t)),
    )
    lower = F.transform(F.flatten(forms), lambda t: F.lower(t))
    return F.array_distinct(F.filter(lower, lambda t: t != ""))


def tokenize(text: Column) -> Column:
    """Tokens of any text; null gives null, a text without tokens an empty array."""
    return tokens_of_normal(normalize(text))


def query_terms(tokens: Column) -> Column:
    """Tokens that carry weight in a question: all but the stopwords, in order."""
    return F.array_except(tokens, F.array(*map(F.lit, STOPWORDS)))


def coverage(terms: Column, tokens: Column) -> Column:
    """Share of the terms among the tokens; 0 without terms."""
    return F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, tokens)) / F.size(terms)).otherwise(F.lit(0.0))


def detect_language(text: Column) -> Column:
    """``mixed`` if the Arabic and the Latin script each have a fifth of the letters, ``fa`` if only the Arabic has,
    else ``en``, also without letters."""
    arabic = F.regexp_count(text, F.lit(f"[{ARABIC}]"))
    latin = F.regexp_count(text, F.lit(f"[{LATIN}]"))
    total = arabic + latin
    enough = lambda n: n >= LEAST_SHARE * total
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when((total > 0) & enough(arabic) & enough(latin), "mixed")
        .when((total > 0) & enough(arabic), "fa")
        .otherwise("en")
    )


def sentence_spans(text: Column) -> Column:
    """Array of (start, end, text) of the sentences for quoting; offsets count code points from 0.

    A terminator ends a sentence wherever it stands, except a point before a digit or behind an abbreviation. White
    space between sentences belongs to none. Pieces are cut at a mark set behind true terminators, and their offsets
    are a running sum.
    """
    mark = "\x01"
    short = "|".join(ABBREVIATIONS)
    # the word before the point is what stands behind the last white space, compared whole
    held = F.regexp_replace(text, rf"(?i)(?<=^|\s)((?:{short}))\.", "$1\x02")
    cut = F.regexp_replace(held, r"([!?\x{061F}\x{06D4}]|\.(?!\p{Nd}))", "$1" + mark)
    pieces = F.transform(F.split(cut, mark), lambda p: F.translate(p, "\x02", "."))
    begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        bare = F.regexp_replace(piece, r"^[\s\p{Z}]+", "")
        end = acc["at"] + F.length(piece)
        start = end - F.length(bare)
        one = F.array(F.struct(start.alias("start"), end.alias("end"), bare.alias("text")))
        return F.struct(end.alias("at"), F.when(bare != "", F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pieces, begun, step, lambda acc: acc["out"])
