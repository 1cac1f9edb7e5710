import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import contamination, encoding, language, lattice, neighbours, packing, quality, ranking, sentences, skeleton, textstats, weaklabels
from lectern.llm.boosting import boost
from lectern.llm.hnsw import Graph


def _pack(spark, items, capacity, **kw):
    df = spark.createDataFrame([(k, n, "clash") for k, n in items], "k string, n long, container string")
    return packing.pack(df, "k", F.col("n"), capacity, **kw).collect()


@pytest.mark.parametrize("kw", [{}, {"windows": 2, "run_items": 3, "items_per_partition": 20, "fan_in": 2}])
def test_packing_is_valid_and_repeatable(spark, kw):
    rnd = random.Random(5)
    items = [(f"k{i}", rnd.choice([0, 1, 10, 33, 50, 100, 101, 250])) for i in range(120)] + [(None, 5), ("null", None)]
    rows = _pack(spark, items, 100, **kw)
    sizes, used, seen = dict(items), {}, {}
    for r in rows:
        size = min(100, sizes[r.k] - 100 * r.piece)
        used[r.container] = used.get(r.container, 0) + size
        seen[r.k] = seen.get(r.k, 0) + size
        assert r.piece == 0 or sizes[r.k] > 100
    assert seen == {k: n for k, n in items if k is not None and n is not None}
    assert max(used.values()) <= 100 and sorted(used) == list(range(len(used)))
    assert len(used) <= 1.1 * sum(seen.values()) / 100 + 3
    assert sorted(map(tuple, rows)) == sorted(map(tuple, _pack(spark, items[::-1], 100, **kw)))


def test_packing_nothing(spark):
    assert _pack(spark, [], 10) == []


def test_look_alikes(spark):
    same = ["Кafé 12", "Kafé 12", "Ｋafé 12", "K​afé 1­2"]
    apart = ["kafé 12", "Kafe 12", "Kafé 13", "Kafé ۱۲", "Kaf‌é 12", None, ""]
    rows = list(enumerate(same + apart)) + [(0, same[0]), (50, same[0])]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "id int, text string, look int")
    got = {tuple(r) for r in skeleton.look_alike_pairs(df, "id", "text").collect()}
    want = {(a, b) for a in range(4) for b in range(a + 1, 4)} | {(a, 50) for a in (1, 2, 3)}
    assert got == want
    assert {skeleton.consistent(x) for x in same} == {"Kafé 12"}
    classes = skeleton.look_classes(df, "id", "text").collect()
    assert sorted((r["keys"], r.first_key) for r in classes) == [(1, 1), (1, 2), (1, 3), (2, 0)] and len({bytes(r.look) for r in classes}) == 1
    assert skeleton.consistent("𝐀𝓫Ⅳ ℂꓐᎳ") == "AbIV CBW"
    assert skeleton.skeleton(skeleton.skeleton(same[0])) == skeleton.skeleton(same[0])
    assert skeleton.skeleton("ي ى ك") == skeleton.skeleton("ی ی ک")
    forms = df.select("id", skeleton.consistent_text(F.col("text")).alias("t")).where("id in (9, 10)").orderBy("id").collect()
    assert [r.t for r in forms] == [None, ""]


def test_encoding_equals_the_plain_encoder(spark):
    e = encoding.encoder(encoding.BYTE_BPE_50K)
    rnd = random.Random(2)
    alphabet = list("ab 'st\t\n!?1２، é漢。😀-_<|>") + [" ", "‌", "　", "endoftext"]
    texts = [None, "", "  ", "<|endoftext|>", "it's  \n\n fine", "x" * 5000] + ["".join(rnd.choices(alphabet, k=rnd.randint(0, 40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.ids for r in encoding.encode_texts(df, "id", "text").collect()}
    assert got == {i: e.encoding.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_no_cut_behind_white_space_or_within_a_token():
    e = encoding.encoder(encoding.BYTE_BPE_50K)
    text = "one  two\n\nthree's 漢字"
    for at in e.cuts(text):
        assert not text[at - 1].isspace() and text[at] != "'"


SPLIT = [
    "Dr. Ash came at 5 p.m. The rest (e.g. 4.5 of them) left. See a.txt and go.",
    'He said "Stop. Then wait." and left.Nobody moved!',
    "Heading\n\n1. First thing is\nhere. 2 more follow.\n2. Second one",
    "Am 3. Mai kam z. B. Nr. 4. Das Ende.",
    "他问：“走吗？”他走了。说：“停。走。”然后离开了。",
    "گفت: «صبر کنید. بعد بروید.» و رفت. آیا آمد؟ بله!",
    "คิวว่างแล้วหรือยัง เปิดไฟล์ a.yaml ก่อนเสมอ",
]
PARTS = [
    ["Dr. Ash came at 5 p.m.", "The rest (e.g. 4.5 of them) left.", "See a.txt and go."],
    ['He said "Stop. Then wait." and left.', "Nobody moved!"],
    ["Heading", "1. First thing is\nhere.", "2 more follow.", "2. Second one"],
    ["Am 3. Mai kam z. B. Nr. 4.", "Das Ende."],
    ["他问：“走吗？”", "他走了。", "说：“停。走。”然后离开了。"],
    ["گفت: «صبر کنید. بعد بروید.» و رفت.", "آیا آمد؟", "بله!"],
    ["คิวว่างแล้วหรือยัง", "เปิดไฟล์ a.yaml ก่อนเสมอ"],
]


@pytest.mark.parametrize("text, parts", list(zip(SPLIT, PARTS)))
def test_sentences(text, parts):
    spans = sentences.sentence_spans(text)
    if parts[0].startswith("Am 3."):
        assert [text[a:b] for a, b in spans][0].startswith("Am 3. Mai kam z. B. Nr. 4.")
    else:
        assert [text[a:b] for a, b in spans] == parts


@pytest.mark.parametrize("marks", ["“”", "()", '""', "«»"])
def test_sentences_of_a_long_quotation(marks):
    first = f"She read {marks[0]}{'We went there. ' * 100}It was late.{marks[1]} and left."
    spans = sentences.sentence_spans(f"{first} Nobody moved.")
    assert spans == [(0, len(first)), (len(first) + 1, len(first) + 14)]


def test_sentences_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n​"), (4, "Yes"), (4, "Yes")], "id int, text string")
    assert [tuple(r) for r in sentences.split_sentences(df, "id", "text").collect()] == [(4, 0, 3, "Yes")] * 2


def test_ranking_gives_every_score_the_same_say(spark):
    rows = [("q", f"c{i}", float(i), i * 1e6 + 5e9, 1.0 - 0.1 * i) for i in range(6)]
    rows += [("q", "c0", None, None, None), ("q", None, 1.0, 1.0, 1.0), ("r", "x", float("nan"), None, None), ("r", "y", None, 1.0, None)]
    df = spark.createDataFrame(rows, "g string, i string, a double, b double, c double")
    merged = ranking.merge_scores([(df, {"a": F.col("a"), "b": F.col("b"), "c": F.col("c")})], "g", "i")
    assert merged.count() == 8
    close = ranking.ideal_point_closeness(merged, "g", "i", {"a": 1.0, "b": 1.0, "c": 1.0}, 0.0, 1.0)
    got = {(r.g, r.i): r.closeness for r in close.collect()}
    assert got["q", "c5"] > got["q", "c0"]  # two scores against one, whatever their range
    assert got["r", "x"] == got["r", "y"] == 0.0
    limits = spark.createDataFrame([("q", 2), ("r", None)], "g string, n int")
    assert [r.i for r in ranking.best_of_group(close, limits, "g", "i", "n").orderBy("rank").collect()][0] == "c5"


def test_graph_recall_and_round_trip():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[1::10] = x[::10] + 0.05 * rng.normal(size=(300, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, ids, sims = Graph.build(x, 5)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    bar = -np.partition(-s, 4, axis=1)[:, [4]]
    assert (sims >= bar - 1e-6).mean() >= 0.95
    assert np.allclose(sims, np.take_along_axis(s, ids, 1), atol=1e-5)
    again = Graph.from_bytes(graph.to_bytes())
    assert (again.search(x[:50], 1)[0][:, 0] == np.arange(50)).mean() > 0.95


@pytest.mark.parametrize("per_cell", [8_192, 60])
def test_nearest_vectors(spark, per_cell):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 4))
    rows = [("m", f"k{i:02}", 4, [float(v) for v in r], i) for i, r in enumerate(x)]
    rows += [("m", "zero", 4, [0.0] * 4, 1), ("m", "nan", 4, [float("nan")] * 4, 1), ("m", "short", 4, [1.0], 1), ("m", "none", 4, None, 1), ("m", "k00", 4, [1.0] * 4, -1), ("n", "alone", 4, [1.0] * 4, 1)]
    df = spark.createDataFrame(rows, "model string, hash string, dim int, vector array<float>, at int")
    vectors = neighbours.latest_vectors(neighbours.usable_vectors(df, "model", "hash", "vector", "dim", "at"))
    assert vectors.count() == 91
    got = neighbours.nearest_vectors(vectors, k=3, per_cell=per_cell, copies=4).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    true = {(f"k{i:02}", f"k{j:02}") for i in range(90) for j in np.argsort(-s[i])[:3]}
    assert len({(r.key, r.other) for r in got} & true) >= 0.95 * len(true)
    assert neighbours.nearest_vectors(vectors.where("false")).count() == 0


@pytest.mark.parametrize("cells", [1, 8, 64])
def test_recall_over_several_cells(spark, cells):
    rng = np.random.default_rng(3)
    n, dim = 6_400, 24
    x = rng.normal(size=(n, dim)) + 1.5 * rng.normal(size=(80, dim))[rng.integers(0, 80, n)]
    df = spark.createDataFrame([("m", dim, f"k{i:05}", r.tolist()) for i, r in enumerate(x)], "space string, dim int, key string, vector array<float>")
    per_cell = 3 * n // cells if cells > 1 else n
    got = neighbours.nearest_vectors(df, k=5, per_cell=per_cell).collect()
    s = (u := x / np.linalg.norm(x, axis=1, keepdims=True)) @ u.T
    np.fill_diagonal(s, -2)
    near = np.argpartition(-s, 4, axis=1)[:, :5]
    true = {(f"k{i:05}", f"k{j:05}") for i in range(n) for j in near[i]}
    assert len(got) == 5 * n and len({(r.key, r.other) for r in got} & true) >= 0.9 * len(true)


def test_copies_of_a_vector_are_nearest_to_each_other(spark):
    rng = np.random.default_rng(4)
    rows = [("m", 3, f"c{i:03}", [2.0, 0.0, 1.0]) for i in range(300)] + [("m", 3, f"d{i}", [4.0, 0.0, 2.0]) for i in range(3)]
    rows += [("m", 3, f"r{i:03}", r.tolist()) for i, r in enumerate(rng.normal(size=(100, 3)))]
    df = spark.createDataFrame(rows, "space string, dim int, key string, vector array<float>").repartition(2)
    for per_cell in (8_192, 80):
        got = neighbours.nearest_vectors(df, k=5, per_cell=per_cell).collect()
        found = {}
        for r in sorted(got, key=lambda r: r["rank"]):
            found.setdefault(r.key, []).append(r.other)
        assert len(found) == 403 and {len(v) for v in found.values()} == {5}
        first = [f"c{i:03}" for i in range(6)]
        for key in [f"c{i:03}" for i in range(300)] + ["d0", "d1", "d2"]:
            assert found[key] == [c for c in first if c != key][:5]
        only = neighbours.nearest_vectors(df, k=5, least=0.9999, per_cell=per_cell).where("key >= 'c' and key < 'r'").count()
        assert only == 303 * 5


def test_leaks(spark):
    item = "which of the blue lamps must the night porter carry to the old mill before the third bell rings twice"
    words = item.split()
    texts = [
        f"Noise here. {item.upper()}. More noise.",
        "x " + " ".join(f"<b>{w}</b>" if i % 3 else f"**{w}**" for i, w in enumerate(words)),
        " ".join("perhaps" if i % 6 == 5 else w for i, w in enumerate(words)),
        item.replace("o", "о").replace("e", "е"),
        " ".join(words[: len(words) // 2 + 1]), " ".join(words[: len(words) // 3]), " ".join(reversed(words)), None, "", item,
    ]
    corpus = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, item string")
    items = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "")], "item_id long, text string")
    got = contamination.leaked_items(corpus, "id", "text", items, "item_id", "text").collect()
    assert sorted((r.id, r.item_id) for r in got) == [(i, 7) for i in (0, 1, 2, 3, 4, 9)]
    assert contamination.leaked_items(corpus, "id", "text", items.where("false"), "item_id", "text").count() == 0


def test_automaton_finds_all_stretches():
    rnd = random.Random(1)
    items = [[rnd.randint(0, 3) for _ in range(rnd.randint(0, 12))] for _ in range(6)]
    automaton = contamination.SuffixAutomaton(items)
    for _ in range(40):
        text = [rnd.randint(0, 4) for _ in range(rnd.randint(0, 15))]
        want = set()
        for i, t in enumerate(items):
            for a in range(len(text)):
                for b in range(len(t)):
                    n = 0
                    while a + n < len(text) and b + n < len(t) and text[a + n] == t[b + n]:
                        n += 1
                    if n >= 2 and not (a and b and text[a - 1] == t[b - 1]):
                        want.add((a + n, n, i, b + n - 1))
        assert set(automaton.matches(text, 2)) == want


def test_passages_are_cut_out(spark):
    item = "which of the blue lamps must the night porter carry to the old mill before the third bell rings twice"
    chinese = "在夜间维护期间备用节点向事故频道发送摘要并且需要可用空间"
    tags = " ".join(f"<b class=\"{'x' * 300}\">{w}</b>" for w in item.split())
    texts = [f"One. {item.upper()}! Two.", f"Start {tags} end", f"请注意，{chinese[:-2]}其他文字。", "Nothing here.", None, ""]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "id long, text string, removed_chars int")
    items = spark.createDataFrame([(1, item), (2, chinese), (3, None)], "item long, text string")
    found = {(r.id, r.item) for r in contamination.leaked_items(df, "id", "text", items, "item", "text").collect()}
    assert found == {(0, 1), (1, 1), (2, 2)}
    got = {r.id: (r.text, r.removed_chars) for r in contamination.without_leaks(df, "id", "text", items, "item", "text").collect()}
    assert got[0] == ("One.  Two.", len(item) + 1)
    assert got[1][0].startswith("Start") and got[1][0].endswith("end") and "porter" not in got[1][0]
    assert (got[3], got[4], got[5]) == (("Nothing here.", 0), (None, 0), ("", 0))
    assert chinese[:6] not in got[2][0]


def test_a_leak_within_the_stretch_of_another_item():
    a = "send the red lamp to the mill today"
    for b in ("please send the red lamp to the mill before noon", "go and send the red lamp to the mill", "send the red lamp to the mill before noon"):
        finder = contamination.LeakFinder([(1, a), (2, b)], 3, 10, 0.45)
        assert sorted((item, covered) for item, covered, *_ in finder.find(f"x {b} y")) == [(1, 7), (2, len(b.split()))]


def test_matches_are_all_that_can_not_grow():
    rnd = random.Random(3)
    for _ in range(40):
        items = [[rnd.randint(0, 2) for _ in range(rnd.randint(1, 14))] for _ in range(5)]
        text = [rnd.randint(-1, 2) for _ in range(25)]
        want = set()
        for i, t in enumerate(items):
            for a in range(len(text)):
                for b in range(len(t)):
                    n = 0
                    while a + n < len(text) and b + n < len(t) and text[a + n] == t[b + n]:
                        n += 1
                    if n >= 2 and not (a and b and text[a - 1] == t[b - 1]):
                        want.add((a + n, n, i, b + n - 1))
        got = list(contamination.SuffixAutomaton(items).matches(text, 2))
        assert len(got) == len(want) and set(got) == want


def test_language(spark):
    model = language.fit(
        [w for seed in language.SEEDS.values() for _, _, w in language.segments(seed)],
        [c for c, seed in enumerate(language.SEEDS.values()) for _ in language.segments(seed)],
    )
    texts = [
        (1, "The children went to the river because it was warm and they had time.", "fr"),
        (2, "Die Kinder sind an den Fluss gegangen, weil es warm war und sie Zeit hatten.", "German"),
        (3, "They had seen the house and went home. Die Frau hatte das Haus gesehen und ging nach Hause.", "en"),
        (4, "They had seen the sign “nicht öffnen” on the door of the house.", "en-GB"),
        (5, None, "en"), (6, "", None), (7, "4711 `ls -l`", None), (8, "این همان خانه‌ای است که در آن کتاب می‌خوانیم و برای شما نیست.", " "),
    ]
    df = spark.createDataFrame([(*r, 1) for r in texts], "id int, text string, language string, confidence int")
    labelled = language.label_languages(df, "id", "text", "language", model)
    got = {r.id: r.language for r in labelled.collect()}
    assert got == {1: "en", 2: "de", 3: "mixed", 4: "en", 5: None, 6: None, 7: None, 8: "fa"}
    assert sorted(map(tuple, language.wrong_labels(labelled, "id").collect())) == [(1, "en"), (3, "de"), (3, "en"), (8, "fa")]
    for r in labelled.where("language is not null").collect():
        assert 0 <= r.confidence <= 1 and r.segments


def test_statistics_of_plain_texts():
    text = "The door is open. Who left?\n- old nuts & bolts\nwe saw it -- twice"
    r = dict(zip(textstats.STATISTICS, textstats.statistics([text])[0]))
    words = "The door is open Who left old nuts bolts we saw it twice".split()
    assert r["word_count"] == len(words) and r["mean_word_length"] == pytest.approx(sum(map(len, words)) / len(words))
    assert r["symbol_ratio"] == pytest.approx(1 / len("".join(text.split())))
    assert r["punctuated_lines"] == pytest.approx(1 / 3) and r["common_words"] == pytest.approx(3 / 13)  # the, is, it
    assert r["item_share"] == pytest.approx(len("-oldnuts&bolts") / len("".join(text.split())))
    table = dict(zip(textstats.STATISTICS, textstats.statistics(["a\tb\tc\n1\t2\t3"])[0]))
    assert table["cell_share"] == 1 and table["marked_share"] == 0
    disguised = dict(zip(textstats.STATISTICS, textstats.statistics(["Ｔｈе do\u00ador is open. Who left?"])[0]))
    assert disguised["common_words"] == pytest.approx(2 / 6)


def test_statistics_do_not_depend_on_the_batch():
    rnd = random.Random(6)
    alphabet = list("ab. \n\t|,-*1é漢。ا‌�\x01😀!") + ["\u0301", "\u00ad", "the ", "\ud800"]
    texts = [None, "", " \n", "\u0301", "x" * 3000] + ["".join(rnd.choices(alphabet, k=rnd.randint(1, 60))) for _ in range(300)]
    whole = textstats.statistics(texts)
    alone = np.concatenate([textstats.statistics([t]) for t in texts])
    assert np.allclose(whole, alone) and np.isfinite(whole).all() and not whole[:4].any()


def test_prose_is_learned_from_several_statistics(spark, sf):
    df = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    x, y = quality.labelled_sample(df, "text", 6_000)
    model = quality.train(df, "text")
    held, truth = quality.holdout()
    found = model.probability(held) < 0.5
    assert len(truth) >= 200 and (found & (truth == 0)).sum() >= 0.97 * (truth == 0).sum() and (found & (truth == 1)).sum() <= 0.02 * (truth == 1).sum()
    used = {n[0] for tree in model.trees for n in tree if n[0] >= 0}
    assert len(used) >= 6
    cut = max(np.mean(((held[:, j] > t) == (truth == 1)) ^ flip) for j in used for t in np.unique(held[:, j]) for flip in (False, True))
    assert cut < np.mean(found == (truth == 0))  # no cut of one statistic does as well
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, " \n", 0.5), (4, "It rained all day, and the road to the mill was closed.", 0.5), (4, "a|b|c", 0.5)], "id long, text string, prose double")
    p = sorted((r.id, r.prose is None) for r in quality.text_quality(odd, "id", "text", model).collect())
    assert p == [(1, True), (2, True), (3, True), (4, False), (4, False)]


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("The door was open and nobody had seen who went out of the house. She would have told them about it.", 1),
        ("\n".join(f"- part ({n})" for n in range(9)), 0),
        ("\n".join(f"a{n}\tb\t{n}" for n in range(9)), 0),
        ("48 65 6c 6c 6f 20 77 6f 72 6c 64 21\n" * 5, 0),
        ("T h e d o o r w a s o p e n a n d n o b o d y k n e w", 0),
        ("Yes.", -1),
        ("", -1),
    ],
)
def test_weak_labels(text, label):
    assert weaklabels.weak_label(text) == label


@pytest.mark.parametrize(
    ("text", "count"),
    [
        ("ฉันชอบกินข้าว พ่อชอบวิ่ง", 2),
        ("แมวนอนหลับ หมาเห่าเสียงดัง", 2),
        ("เขาไปตลาด เพราะข้าวหมด", 1),
        ("今天很好了 我们走吧", 2),
        ("彼は来ました 私は帰ります", 2),
        ("他说：“好。”就业问题很多。", 2),
        ("他说：“好。”就走了。", 1),
        ("「はい。」と言いました。", 1),
        ("See Fig. 3 and Dr. Ray. It is 4.5 cm... or so. 1. First", 3),
        ('He said "' + "It is late. We must go now. " * 60 + '" and left. We stayed.', 2),
    ],
)
def test_gaps_and_lattices(text, count):
    assert len(sentences.sentence_spans(text)) == count


def test_cheapest_words_against_all_paths():
    words, rnd = frozenset(["ab", "abc", "c", "bca", "aa"]), random.Random(8)

    def cost(run, start=0, inside=False):
        if start == len(run):
            return 0.0
        ways = [lattice.WORD + cost(run, start + len(w)) for w in words if run.startswith(w, start)]
        step = lattice.CHARACTER + (0 if inside else lattice.UNKNOWN)
        return min([step + cost(run, start + 1, True), *ways])

    for _ in range(200):
        run = "".join(rnd.choices("abcd", k=rnd.randint(1, 9)))
        found = lattice.cheapest_words(run, words)
        assert "".join(found) == run
        paid = sum(lattice.WORD if w in words else lattice.UNKNOWN + lattice.CHARACTER * len(w) for w in found)
        assert paid <= cost(run) + 1e-9 or paid == pytest.approx(cost(run))
    for run in ("รีสตาร์ตบริการก่อน", "担当者は待ってください", "我们就业问题很多"):
        assert "".join(lattice.cheapest_words(run, lattice.thai_words() | lattice.thick_words())) == run


@pytest.mark.parametrize("held", [None, "", "aGVsbG8= 0\n", "no ranks here\n"])
def test_vocabulary_that_is_not_there_is_an_error(tmp_path, held):
    path = tmp_path / "ranks.tiktoken"
    if held is not None:
        path.write_text(held)
    with pytest.raises((OSError, ValueError)):
        lattice.vocabulary(str(path))


def test_vocabulary_has_whole_words_only(tmp_path):
    path = tmp_path / "ranks.tiktoken"
    tokens = ["漢字".encode(), " 世界".encode(), "中国人".encode()[:-1], "東京都".encode()[1:], b"hello"]
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    assert lattice.vocabulary(str(path)) == {"漢字", "世界"}


def test_no_sentences_without_the_vocabulary(tmp_path, monkeypatch):
    text = "他说：“走吧。”ということ很大。"
    caches = lattice.vocabulary, lattice.thick_words, sentences.carries_on, sentences.closes_clause
    for c in caches:
        c.cache_clear()
    with monkeypatch.context() as m:
        m.setattr(lattice, "BYTE_BPE_50K", str(tmp_path / "byte_bpe_50k.tiktoken"))
        with pytest.raises(FileNotFoundError):
            sentences.sentence_spans(text)
    assert sentences.sentence_spans(text) == [(0, 8), (8, 16)]
    assert sentences.sentence_spans("One text. Another one.") == [(0, 9), (10, 22)]


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.4) & (x[:, 1] < 0.7)).astype(float)
    model = boost(x, y)
    assert ((model.probability(x) > 0.5) == y).mean() > 0.97
    assert boost(x[:0], y[:0]).probability(x).std() == 0
