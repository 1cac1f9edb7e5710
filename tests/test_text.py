import hashlib

from pyspark.sql import functions as F

from lectern.functions import identity, text as t
from lectern.functions.vectors import hash_embedding

TEXTS = [
    None, "", "   ", "Plain words, twice: words words.", "ERR-404 foo.- v2.3.1 some_name ..x",
    "می‌رود و آمد ۱۲۳ كتاب", "modelsمدل embedding", "Ａｂ ﬁle\xadx", "a\tb\nc", "dr. Who went. It cost 3.5 etc. Then!? Yes؟ بله۔ no",
]


# What each text must become, worked out by hand: index form, tokens, and (start, end) of the sentences.
EXPECTED = [
    (None, None, None),
    ("", [], []),
    ("", [], []),
    ("Plain words, twice: words words.", ["plain", "words", "twice"], [(0, 32)]),
    ("ERR-404 foo.- v2.3.1 some_name ..x", ["err-404", "foo.", "v2.3.1", "some_name", "..x"], [(0, 12), (12, 32), (32, 33), (33, 34)]),
    ("می‌رود و آمد 123 کتاب", ["می‌رود", "میرود", "می", "رود", "و", "آمد", "123", "کتاب"], [(0, 21)]),
    ("models مدل embedding", ["models", "مدل", "embedding"], [(0, 19)]),
    ("Ab filex", ["ab", "filex"], [(0, 8)]),
    ("a b c", ["a", "b", "c"], [(0, 5)]),
    (
        "dr. Who went. It cost 3.5 etc. Then!? Yes؟ بله۔ no",
        ["dr", "who", "went", "it", "cost", "3.5", "etc", "then", "yes", "بله", "no"],
        [(0, 13), (14, 36), (36, 37), (38, 42), (43, 47), (48, 50)],
    ),
]


def _rows(spark, *columns):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "i int, x string")
    return df.select("i", *columns).orderBy("i").collect()


def test_normal_form_and_tokens(spark):
    for r in _rows(spark, t.normalize(F.col("x")).alias("n"), t.tokenize(F.col("x")).alias("w")):
        assert (r.n, r.w) == EXPECTED[r.i][:2]


def test_normal_form_is_stable(spark):
    for r in _rows(spark, t.normalize(F.col("x")).alias("a"), t.normalize(t.normalize(F.col("x"))).alias("b")):
        assert r.a == r.b


def test_language_by_script(spark):
    df = spark.createDataFrame([("abc",), ("سلام",), ("abc سلام",), ("123",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(t.detect_language(F.col("x"))).collect()] == ["en", "fa", "mixed", "en", "en", None]


def test_sentences_are_slices(spark):
    for r in _rows(spark, t.sentence_spans(F.col("x")).alias("s")):
        spans = None if r.s is None else [(p.start, p.end) for p in r.s]
        assert spans == EXPECTED[r.i][2]
        assert all(TEXTS[r.i][p.start : p.end] == p.text for p in r.s or [])


def test_identities(spark):
    row = spark.createDataFrame([("A\\B/My File.v2.PDF", "T", ["a", "b"], "x  y")], "f string, t string, p array<string>, x string").select(
        identity.default_doc_id(F.col("f")), identity.chunk_hash(F.col("p"), F.col("x")), identity.embed_input(F.col("t"), F.col("p"), F.col("x")), identity.extension(F.col("f"))
    ).first()
    assert row[0] == "my-file-v2" and row[3] == ".pdf"
    assert row[1] == hashlib.sha256(b"a > b\x00x y").hexdigest()
    assert row[2] == "T > a > b\n\nx  y"


def test_hash_embedding_agrees_with_a_plain_version(spark):
    texts = ["one two two Three", "", "  ", "alpha"]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select(hash_embedding(F.col("x"))).collect()
    for text, (vector,) in zip(texts, got):
        want = [0.0] * 32
        for w in text.lower().split() or [""]:
            d = hashlib.sha256(w.encode()).digest()
            want[int.from_bytes(d[:8], "big") % 32] += 1.0 if d[8] & 1 else -1.0
        length = sum(v * v for v in want) ** 0.5
        assert all(abs(a - b / length) < 1e-12 for a, b in zip(vector, want))
