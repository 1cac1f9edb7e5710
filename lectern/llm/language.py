"""Language of documents and of the segments of mixed ones, by string kernels.

A segment is the set of its words, a word the set of its character n-grams of all lengths from 1 to ``LONGEST``, with
marks at both ends (blended spectrum, presence only). The kernel of two segments is the number of n-grams that their
words share, word by word, over the geometric mean of their sizes. One-versus-rest kernel ridge regression on
Nyström landmarks gives a score for each language. As the kernel is linear in the words' n-grams, the product of a
landmark's n-grams with the coefficients is formed once; words, and then segments, are scored by batched matrix products.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.skeleton import consistent

LANGUAGES = ("en", "fa", "de", "fr", "es", "ar")
MIXED = "mixed"
#: Longest n-gram.
LONGEST = 4
#: Words a segment needs before it counts as a sentence of its language.
LEAST_WORDS = 4
#: Lead of the best language over the next, as a share of probability, that a segment needs.
LEAST_LEAD = 0.35
#: Factor from scores to the exponents of the shares that decide; confidences have a factor of their own, fitted to held-out sentences.
SHARPNESS = 4.0
#: Factors that are tried for the confidences.
SHARPER = tuple(float(x) for x in np.round(np.geomspace(0.5, 32, 37), 3))
#: Words kept scored by a worker; when as many are held, the memory is emptied.
MEMORY = 400_000

# Codes and English names by which a label names a language.
NAMES = {
    "en": ("en", "eng", "english"),
    "fa": ("fa", "fas", "per", "pes", "prs", "persian", "farsi"),
    "de": ("de", "deu", "ger", "german"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish", "castilian"),
    "ar": ("ar", "ara", "arb", "arabic"),
}
BY_NAME = {name: code for code, names in NAMES.items() for name in names}

# A few plain sentences of each language, so that none lacks landmarks.
SEEDS = {
    "en": (
        "The door was open and nobody had seen who went out of the house. She would have told them about it. "
        "This is what they were waiting for, but there is not enough time. When it rains we stay at home with our books."
    ),
    "fa": (
        "در خانه باز بود و هیچ کس ندیده بود که چه کسی بیرون رفت. او می‌خواست این را به آنها بگوید. "
        "این همان چیزی است که برای آن صبر کرده‌اند اما زمان کافی نیست. وقتی باران می‌بارد ما در خانه می‌مانیم و کتاب می‌خوانیم."
    ),
    "de": (
        "Die Tür war offen und niemand hatte gesehen, wer aus dem Haus ging. Sie hätte es ihnen gesagt. "
        "Darauf haben sie gewartet, aber es ist nicht genug Zeit. Wenn es regnet, bleiben wir mit unseren Büchern zu Hause."
    ),
    "fr": (
        "La porte était ouverte et personne n'avait vu qui était sorti de la maison. Elle le leur aurait dit. "
        "C'est ce qu'ils attendaient, mais il n'y a pas assez de temps. Quand il pleut, nous restons chez nous avec nos livres."
    ),
    "es": (
        "La puerta estaba abierta y nadie había visto quién salió de la casa. Ella se lo habría dicho a ellos. "
        "Esto es lo que esperaban, pero no hay bastante tiempo. Cuando llueve nos quedamos en casa con nuestros libros."
    ),
    "ar": (
        "كان الباب مفتوحا ولم ير أحد من خرج من البيت. كانت تريد أن تقول لهم ذلك. "
        "هذا ما كانوا ينتظرونه ولكن ليس هناك وقت كاف. عندما ينزل المطر نبقى في البيت مع كتبنا التي نحبها."
    ),
}

NOT_PROSE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|https?://\S+|\S*[/\\@]\S*", re.S)
QUOTED = re.compile(r"“[^”\n]+”|„[^“”\n]+[“”]|«[^»\n]+»|\"[^\"\n]+\"|‹[^›\n]+›")
WHOLE = re.compile(r"[.!?؟۔。！？…]\W*\s+\S.*[.!?؟۔。！？…]\W*\Z", re.S)
SEGMENT = re.compile(r"[^\n]+?(?:[.!?؟۔。！？…]+[\"'”’»)\]]*(?=\s|$|[^\W\d_a-z])|$|(?=\n))")
WORD = re.compile(r"[^\W\d_](?:[^\s.,;:!?()\[\]{}\"«»“”„`…،؛؟/\\<>|=+*#~&0-9_-]*[^\W_])?")
UPPER = re.compile(r"[A-Z]{2,}|.[A-Z]")


def named_language(label: Column) -> Column:
    """The language that a stored label names, in whatever spelling, ``mixed``, or null where it says nothing known."""
    plain = F.lower(F.regexp_replace(label, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    first = F.split_part(F.regexp_replace(plain, "_", "-"), F.lit("-"), F.lit(1))
    table = F.create_map(*(F.lit(x) for pair in (BY_NAME | {MIXED: MIXED}).items() for x in pair))
    return table[first]


def segments(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, distinct words in order) of the sentences of a text.

    Code, commands, addresses and quotations of up to one sentence are blanked; words in capitals count as names.
    """
    if "`" in text or "/" in text or "@" in text or "\\" in text:
        text = NOT_PROSE.sub(lambda m: " " * len(m[0]), text)
    text = QUOTED.sub(lambda m: m[0] if WHOLE.search(m[0]) else " " * len(m[0]), text)
    out = []
    for m in SEGMENT.finditer(text):
        words = list(dict.fromkeys(w for w in WORD.findall(m[0]) if not UPPER.match(w)))
        if words:
            out.append((m.start(), m.end(), words))
    return out


def grams(word: str) -> set[str]:
    """All n-grams of the marked word in its consistent form."""
    w = f"<{consistent(word).lower()}>"
    return {w[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(w) - n + 1)}


@dataclass
class KernelModel:
    """Coefficients of the n-grams for each language."""

    languages: tuple[str, ...]
    number: dict[str, int]
    coefficients: np.ndarray  # n-grams × languages
    sharpness: float = SHARPNESS

    def word(self, word: str) -> np.ndarray:
        """Sum of the coefficients of a word's n-grams, then their number."""
        found = grams(word)
        at = [n for g in found if (n := self.number.get(g)) is not None]
        return np.r_[self.coefficients[at].sum(0), len(found)]


def _features(rows: Sequence[Sequence[str]], number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Count of every n-gram of the rows' words (rows × n-grams) and the rows' sizes."""
    out, sizes = np.zeros((len(rows), len(number)), dtype=np.float32), np.ones(len(rows))
    for i, words in enumerate(rows):
        size = 0
        for w in words:
            found = grams(w)
            size += len(found)
            for g in found:
                if (n := number.get(g)) is not None:
                    out[i, n] += 1
        sizes[i] = max(1, size)
    return out, sizes


def fit(
    rows: Sequence[Sequence[str]], labels: Sequence[int], landmarks: int = 300, ridge: float = 1e-2, rounds: int = 2
) -> KernelModel:
    """Kernel ridge regression on landmarks, taken from all languages in turn.

    After each round but the last, rows whose label the model contradicts are left out, since labels may be wrong.
    """
    y_all, keep = np.asarray(labels), np.arange(len(rows))
    for last in [False] * (rounds - 1) + [True]:
        y = y_all[keep]
        turn = np.concatenate([np.arange((y == c).sum()) for c in range(len(LANGUAGES))])
        order = np.concatenate([np.flatnonzero(y == c) for c in range(len(LANGUAGES))])[np.argsort(turn, kind="stable")]
        chosen = keep[order[:landmarks]]
        number: dict[str, int] = {}
        for i in chosen:
            for w in rows[i]:
                for g in grams(w):
                    number.setdefault(g, len(number))
        marks, mark_sizes = _features([rows[i] for i in chosen], number)
        own, own_sizes = _features([rows[i] for i in keep], number)
        k_nm = own @ marks.T / np.sqrt(np.outer(own_sizes, mark_sizes))
        k_mm = marks @ marks.T / np.sqrt(np.outer(mark_sizes, mark_sizes))
        target = np.where(y[:, None] == np.arange(len(LANGUAGES)), 1.0, -1.0)
        weight = 1.0 / np.maximum(1, np.bincount(y, minlength=len(LANGUAGES)))[y] * len(y) / len(LANGUAGES)
        a = (k_nm * weight[:, None]).T @ k_nm + ridge * len(y) * (k_mm + 1e-6 * np.eye(len(chosen)))
        alpha = np.linalg.solve(a, (k_nm * weight[:, None]).T @ target)
        if not last:
            keep = keep[(k_nm @ alpha).argmax(1) == y]
    coefficients = (marks / np.sqrt(mark_sizes)[:, None]).T @ alpha
    return KernelModel(LANGUAGES, number, coefficients.astype(np.float64))


def fitted_sharpness(rows: Sequence[Sequence[str]], labels: Sequence[int], landmarks: int) -> float:
    """The factor under which held-out labels are most likely: each half of the sentences is scored by a model of the other.

    Stored labels may be wrong, so the likelihood is that of a label that is wrong once in a hundred times.
    """
    found, wanted = [], []
    for half in (0, 1):
        model = fit([r for i, r in enumerate(rows) if i % 2 != half], [y for i, y in enumerate(labels) if i % 2 != half], landmarks, rounds=1)
        held = [i for i in range(len(rows)) if i % 2 == half and len(rows[i])]
        if held:
            found.append(Labeller(model).scores([list(rows[i]) for i in held]))
            wanted += [labels[i] for i in held]
    if not wanted:
        return SHARPNESS
    scores, y = np.concatenate(found), np.array(wanted)
    return max(SHARPER, key=lambda f: float(np.log(0.99 * _softmax(f * scores)[np.arange(len(y)), y] + 0.01 / len(LANGUAGES)).sum()))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(
    rows: DataFrame, text: str, label: str, key: str, sample_rows: int = 4_000, per_language: int = 300, landmarks: int = 300
) -> KernelModel:
    """Model from a bounded sample of labelled rows: about ``sample_rows`` of them, spread by a hash of the key, of which
    at most ``per_language`` sentences of each language are used, besides the seeds."""
    named = rows.select(F.col(text).alias("text"), named_language(F.col(label)).alias("language"), F.xxhash64(key).alias("at"))
    every = max(1, rows.count() // sample_rows)
    sample = named.where((F.pmod("at", F.lit(every)) == 0) & F.col("language").isin(*LANGUAGES) & F.col("text").isNotNull())
    taken = sample.orderBy("at", "text").limit(2 * sample_rows).toPandas()
    examples: list[list[str]] = []
    labels: list[int] = []
    for code, (name, seed) in enumerate(SEEDS.items()):
        found = [words for _, _, words in segments(seed)]
        for t in taken.loc[taken["language"] == name, "text"]:
            found += [words for _, _, words in segments(t) if len(words) >= LEAST_WORDS]
            if len(found) >= per_language:
                break
        examples += found[:per_language]
        labels += [code] * len(found[:per_language])
    model = fit(examples, labels, landmarks)
    model.sharpness = fitted_sharpness(examples, labels, landmarks)
    return model


class Labeller:
    """Scores segments by a model; keeps a bounded number of scored words."""

    def __init__(self, model: KernelModel):
        self.model = model
        self._empty()

    def _empty(self) -> None:
        self.number: dict[str, int] = {}
        self.known: list[np.ndarray] = []
        self.table = np.zeros((0, len(self.model.languages) + 1))

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        """Score of every language for every list of words (none of them empty)."""
        if len(self.number) > MEMORY:
            self._empty()
        number, known = self.number, self.known
        at = []
        for words in rows:
            for w in words:
                n = number.get(w)
                if n is None:
                    n = number[w] = len(known)
                    known.append(self.model.word(w))
                at.append(n)
        if len(known) > len(self.table):
            self.table = np.concatenate([self.table, np.stack(known[len(self.table) :])])
        starts = np.cumsum([0] + [len(words) for words in rows[:-1]])
        sums = np.add.reduceat(self.table[at], starts, axis=0)
        return sums[:, :-1] / np.sqrt(np.maximum(1, sums[:, -1:]))

    def label(self, texts: list[str]) -> list[tuple[str | None, float | None, list[tuple[int, int, str, float]]]]:
        """(language or mixed, confidence, segments as (start, end, language, confidence)) of each text."""
        split = [segments(t) for t in texts]
        rows = [words for parts in split for _, _, words in parts]
        scores = self.scores(rows) if rows else np.zeros((0, len(self.model.languages)))
        p, sure_of = (_softmax(f * scores) if rows else scores for f in (SHARPNESS, self.model.sharpness))
        best = p.argmax(1)
        ordered = np.sort(p, 1)
        lead = ordered[:, -1] - ordered[:, -2] if len(p) else np.zeros(0)
        sizes = np.array([len(w) for w in rows])
        sure = (lead >= LEAST_LEAD) & (sizes >= LEAST_WORDS)
        out, i = [], 0
        for parts in split:
            j = i + len(parts)
            out.append(self._whole(parts, p[i:j], sure_of[i:j], best[i:j], sure[i:j], sizes[i:j]))
            i = j
        return out

    def _whole(self, parts, p, sure_of, best, sure, sizes):
        if not parts:
            return None, None, []
        names = self.model.languages
        if sure.any():
            found = {int(b) for b in best[sure]}
            main = int(np.bincount(best[sure], weights=sizes[sure]).argmax())
        else:
            main = int((p * sizes[:, None]).sum(0).argmax())
            found = {main}
        merged: list[list] = []
        for (start, end, _), q, b, ok, n in zip(parts, sure_of, best, sure, sizes):
            code = int(b) if ok else merged[-1][2] if merged else None
            if merged and merged[-1][2] in (code, None):
                last = merged[-1]
                last[1], last[2] = end, code if last[2] is None else last[2]
                last[3], last[4] = last[3] + q * n, last[4] + n
            else:
                merged.append([start, end, code, q * n, n])
        spans = []
        for start, end, code, q, n in merged:
            code = main if code is None else code
            spans.append((start, end, names[code], float(q[code] / n)))
        if len(found) > 1:
            return MIXED, min(s[3] for s in spans), spans
        return names[main], float((sure_of[:, main] * sizes).sum() / sizes.sum()), spans


LABELLED = (
    "language string, confidence double, "
    "segments array<struct<char_start: int, char_end: int, language: string, confidence: double>>"
)


def label_languages(rows: DataFrame, key: str, text: str, label: str, model: KernelModel) -> DataFrame:
    """(key, label, language, confidence, segments) of every row; ``label`` is the stored one.

    The language is one of ``LANGUAGES``, ``mixed`` for a text with a whole sentence each of two or more, or null
    for a text without a word, which includes null and empty ones; segments of a text in one language are one. Rows
    are labelled where they are read, without a shuffle; repeated rows stay, further columns are dropped.
    """
    kinds = [rows.schema[c].dataType.simpleString() for c in (key, label)]
    held = rows.sparkSession.sparkContext.broadcast(model)  # bounded by the number of landmarks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(held.value)
        kind = pa.list_(pa.struct([("char_start", pa.int32()), ("char_end", pa.int32()), ("language", pa.string()), ("confidence", pa.float64())]))
        names = ("char_start", "char_end", "language", "confidence")
        for batch in batches:
            found = labeller.label([t or "" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([[dict(zip(names, s)) for s in f[2]] for f in found], kind),
                ],
                names=["key", "label", "language", "confidence", "segments"],
            )

    picked = rows.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(text).cast("string").alias("text"))
    return (
        picked.mapInArrow(run, f"key {kinds[0]}, label {kinds[1]}, {LABELLED}")
        .withColumnRenamed("key", key)
    )


def wrong_labels(labelled: DataFrame, key: str) -> DataFrame:
    """(key, language): one row for each language of every text whose stored label is absent or wrong; distinct."""
    wrong = labelled.where(
        F.col("language").isNotNull() & ~named_language(F.col("label")).eqNullSafe(F.col("language"))
    )
    return wrong.select(key, F.explode(F.array_distinct(F.col("segments.language"))).alias("language")).distinct()
