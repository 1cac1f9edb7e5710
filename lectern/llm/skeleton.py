"""One form for texts that look the same, by a skeleton of prototypes.

A text is decomposed, every character is replaced by the prototype it looks like, and the result is decomposed
again. Two texts look the same when their skeletons are equal. Letter case, digits, accents, words and the
zero-width non-joiner stay visible.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import checkpointed

# Letters of other scripts and the Latin letters they look like.
LOOK_ALIKES = {
    "АВЕКМНОРСТХЅІЈҮԚԜӀ": "ABEKMHOPCTXSIJYQWI",
    "аеорсухѕіјһԁԛԝӏү": "aeopcyxsijhdqwly",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ": "ABEZHIKMNOPTYXCJ",
    "αονρυϲϳ": "aovpucj",
    "ОօոսհցԼ": "Oonuhgl",
    "ɑɡıȷ": "agij",
    "ѵѴԌꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ": "vVGBPDTGKJCZFMNLSRVHWXYAEIOU",
    "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏏᏕᏙᏞᏟᏢᏦᏴ": "DRTAJEWMHGZbSVLCPKB",
    "ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥⲭ": "HIKMNOPCTYXopcx",
    "ՍՏԵյզ": "USEjq",
}
# Forms of yeh and kaf, and of heh with hamza, each with the form that stands for all.
ARABIC_FORMS = {"ي": "ی", "ى": "ی", "ې": "ی", "ك": "ک", "ڪ": "ک", "ە": "ه"}
# Kinds of hyphen.
HYPHENS = "‐‑⁃﹣－"
# Visible although of a category that is not, and the reverse.
VISIBLE = "‌"
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))
#: Compatibility decompositions that change the width, the font, the joining or the breaking of a character only.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>")
#: Ligatures and Roman numerals, whose compatibility decompositions are the letters they look like.
LIGATURES = (range(0xFB00, 0xFB50), range(0x2160, 0x2180), range(0x0132, 0x0134), range(0x01C7, 0x01CD))
#: Parts that the keys of one text are spread over in a join.
SALTS = 8


def _prototype(char: str) -> str:
    point, kind = ord(char), unicodedata.category(char)
    if char in VISIBLE:
        return char
    if kind == "Cf" or char in INVISIBLE:
        return ""
    if kind == "Zs":
        return " "
    if char in HYPHENS:
        return "-"
    tag, _, rest = unicodedata.decomposition(char).partition(" ")
    if tag in SAME_LOOK or tag == "<compat>" and any(point in r for r in LIGATURES):
        return "".join(_prototype(chr(int(x, 16))) for x in rest.split())
    return char


@lru_cache(maxsize=1)
def prototypes() -> dict[int, str]:
    """Code point → what it looks like, for every character that is not its own prototype."""
    table = {}
    for point in range(0x80, sys.maxunicode + 1):
        char = chr(point)
        if 0xD800 <= point < 0xE000 or unicodedata.category(char) == "Cn":
            continue
        if (like := _prototype(char)) != char:
            table[point] = like
    for these, like in LOOK_ALIKES.items():
        table |= {ord(a): b for a, b in zip(these, like, strict=True)}
    table |= {ord(a): b for a, b in ARABIC_FORMS.items()}
    return table


def skeleton(text: str) -> str:
    """The form that all texts of the same look share."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(prototypes()))


def consistent(text: str) -> str:
    """The skeleton in composed form: one readable text for all texts of the same look."""
    return unicodedata.normalize("NFC", skeleton(text))


def consistent_text(column: Column) -> Column:
    """The consistent form as a column; null stays null, an empty text stays empty."""

    @F.pandas_udf(T.StringType())
    def form(texts):
        return texts.map(consistent, na_action="ignore")

    return F.when(F.regexp_like(column, F.lit(r"^\p{ASCII}*$")), column).otherwise(form(column))


def _digest(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:16]


def fingerprints(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, look, form): 128-bit digests of the skeleton and of the text itself; rows with a null text are left out."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            look = pa.array([_digest(skeleton(t)) for t in texts], pa.binary())
            form = pa.array([_digest(t) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), look, form], names=["key", "look", "form"])

    picked = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    return picked.mapInArrow(run, f"key {kind}, look binary, form binary").withColumnRenamed("key", key)


def look_groups(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, look, form) of the keys whose look is shared by at least two different texts; distinct rows.

    Only digests are shuffled. Looks with one text are sorted out by an aggregate that combines before the shuffle, so
    a text copied into a third of all rows costs no more than others.
    """
    prints = checkpointed(fingerprints(rows, key, text))  # read three times below
    shared = (
        prints.groupBy("look")
        .agg(F.min("form").alias("least"), F.max("form").alias("most"))
        .where(F.col("least") != F.col("most"))
        .select("look")
    )
    return prints.join(shared, "look", "left_semi").select(key, "look", "form").distinct()


def look_classes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(look, form, keys, first_key): the different texts of every look that has two or more, with the number of keys of each and
    the smallest. This is the whole result in one row a text; pairs need only be made where they are asked for."""
    members = look_groups(rows, key, text)
    return members.groupBy("look", "form").agg(F.count_distinct(key).alias("keys"), F.min(key).alias("first_key"))


def look_alike_pairs(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b), a < b: the keys of texts that look the same but differ in their characters.

    Different texts of a look are paired first, then every such pair of texts is given its keys: pairs of identical
    texts never arise, not even as candidates. The text with more keys is the first of a pair and its keys are spread over
    ``SALTS`` parts, so that a text copied very often is joined by several tasks. A key with several rows is paired with
    others by each of its texts, never with itself.
    """
    members = checkpointed(look_groups(rows, key, text))
    forms = members.groupBy("look", "form").agg(F.count("*").alias("keys"))
    heavier = F.struct("x.keys", "x.form") > F.struct("y.keys", "y.form")
    pairs = (
        forms.alias("x")
        .join(forms.alias("y"), (F.col("x.look") == F.col("y.look")) & heavier)
        .select(F.col("x.form").alias("form_x"), F.col("y.form").alias("form_y"))
    )
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    many = members.select(F.col("form").alias("form_x"), F.col(key).alias("key_x"), F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("salt"))
    few = members.select(F.col("form").alias("form_y"), F.col(key).alias("key_y"))
    first = pairs.select("*", salts).join(many, ["form_x", "salt"])
    second = pairs.join(few, "form_y").select("*", salts)
    both = first.join(second, ["form_x", "form_y", "salt"])
    return (
        both.where(F.col("key_x") != F.col("key_y"))
        .select(F.least("key_x", "key_y").alias("a"), F.greatest("key_x", "key_y").alias("b"))
        .distinct()
    )
