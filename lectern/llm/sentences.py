"""Sentence units of texts in many languages and scripts.

Every run of end marks is a node pair of a terminator lattice: the sentence ends there, or it goes on. Each way costs what the
evidence against it weighs (code, addresses, quotations, abbreviations, numbers, names, the word that follows), which may depend
on the way taken at the node before; the cheapest path gives the ends.

Scripts without spaces are cut into words by a dictionary word lattice. A gap of Thai, Chinese or Japanese without an end mark
ends a sentence when what stands before and behind it has the form of a full sentence, told by predicates, final particles and
opening words; after a quotation or a mark of omission the first word of the lattice tells whether the sentence goes on. Lao, Khmer
and Burmese have no dictionary here and end at their marks only.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.lattice import (
    CHINESE_CARRY_ON, CHINESE_FINAL, HAN, JAPANESE_CARRY_ON, JAPANESE_FINAL, KANA, THAI, THAI_FINAL, THAI_OPENING, THAI_PREDICATES,
    cheapest_words, thai_words, thick_words,
)

# Abbreviations after which the sentence goes on.
ABBREVIATIONS = frozenset(
    """mr mrs ms mx dr prof st rev gen col capt lt sgt hon fig figs no nos vol vols pp ch chap sec sect eq ed eds vs v cf
    viz e.g i.e approx ca est dept jan feb mar apr jun jul aug sep sept oct nov dec al ref tab max min resp
    hr fr frl nr abb tab s bd kap z.b d.h u.a i.d.r vgl bzw evtl ggf inkl zzgl tel str abs art o.g sog bspw mind ev dipl ing
    z d u i m mme mlle mm me env p env art cf fig boul av
    sr sra srta srs dra dres ud uds pág págs núm núms art arts cap p.ej ej ee aprox avda vol ndr
    डॉ श्री सुश्री प्रो د أ م ص ج""".split()
)
# Abbreviations that may also end a sentence.
MAY_END = frozenset("a.m p.m etc inc ltd co corp jr bros usw u.s u.k ff f pers uu std min go gb sek st d.c b.c u.s.w".split())
# Parts of company names behind such an abbreviation.
COMPANY = frozenset("KG GmbH Inc Ltd LLC AG SE OHG".split())
# Names of months, before which a short number with a point is a day.
MONTHS = frozenset(
    """januar jänner februar märz april mai juni juli august september oktober november dezember
    january february march may june july october december""".split()
)
ORDINAL_BEFORE = frozenset("am vom zum im der den dem des die das bis ab seit und".split())
# Words that carry a sentence on after a quotation or a mark of omission, in spaced scripts.
CARRY_ON = frozenset(
    """و سپس ولی اما که یا پس تا ثم اور پھر لیکن کہ گفت پرسید نوشت قال سأل کہا پوچھا
    और फिर लेकिन तथा कि किन्तु परन्तु ने""".split()
)

MARKS = re.compile(r"[.!?…؟۔。！？।॥｡]+")
STRONG = frozenset("۔؟。！？।॥｡")
OPAQUE = re.compile(r"`[^`\n]*`|\w+://\S+|\b[\w.-]+(?:/[\w.?=&-]+)+")
PARAGRAPH = re.compile(r"\n[ \t\r\f\v]*\n\s*")
ITEM = re.compile(r"\n[ \t]*(?=(?:\d{1,3}[.)]|[-*•])[ \t]+\S|#{1,6} )")
HEADING = re.compile(r"(?:\A|(?<=\n))#{1,6} [^\n]*\n")
PAIRS = {"“": "”", "„": "“”", "”": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", '"': '"'}
CLOSES = {c: [kind for kind, closers in PAIRS.items() if c in closers] for c in "".join(PAIRS.values())}
ENCLOSING = re.compile("[" + re.escape("".join(PAIRS) + "".join(PAIRS.values())) + "]")
BRACKETS = "（([【"
CLOSERS = "”“»›」』）)]】\"’'"
BEFORE_CLOSE = re.compile("[" + re.escape("   " + CLOSERS) + "]*")
ITEM_NUMBER = re.compile(r"\s*\d{1,3}\Z")


def _latin_like(char: str) -> bool:
    return char.islower() or char.isupper()


def enclosed(text: str, start: int, end: int) -> dict[int, int]:
    """Opening position → closing position of the outermost quotations and brackets; unclosed ones count for nothing.

    One pass with a stack for each kind of opening mark, however far apart the marks of a pair are.
    """
    marks = list(ENCLOSING.finditer(text, start, end))
    opened: dict[str, list[int]] = {kind: [] for kind in PAIRS}
    closing: dict[int, int] = {}
    for m in marks:
        i, c = m.start(), m[0]
        for kind in CLOSES.get(c, ()):
            if opened[kind]:
                closing[opened[kind].pop()] = i
        if c in PAIRS:
            opened[c].append(i)
    out, behind = {}, start
    for m in marks:
        i, c = m.start(), m[0]
        if i >= behind and i in closing and not (c == '"' and i > start and text[i - 1].isalnum()):
            out[i] = closing[i]
            behind = closing[i] + 1
    return out


@lru_cache(maxsize=20_000)
def full_clause(run: str) -> bool:
    """Whether a run of Thai has the form of a sentence: a predicate within it, or a final particle at its end."""
    words = cheapest_words(run, thai_words())
    return any(w in THAI_PREDICATES for w in words) or words[-1] in THAI_FINAL


@lru_cache(maxsize=20_000)
def opens_clause(run: str) -> bool:
    """Whether a run of Thai begins a sentence of its own rather than carrying one on."""
    return cheapest_words(run, thai_words())[0] not in THAI_OPENING


@lru_cache(maxsize=20_000)
def carries_on(run: str) -> bool:
    """Whether a run of Chinese or Japanese begins with a word that carries the sentence on."""
    return run[0] in "，、" or cheapest_words(run, thick_words())[0] in CHINESE_CARRY_ON | JAPANESE_CARRY_ON


@lru_cache(maxsize=20_000)
def closes_clause(run: str) -> bool:
    """Whether a run of Chinese or Japanese ends with a final particle."""
    return cheapest_words(run, thick_words())[-1] in CHINESE_FINAL | JAPANESE_FINAL


THAI_GAP = re.compile(rf"(?<=[{THAI}])[  ]+(?=[{THAI}])")
THAI_RUN = re.compile(rf"[{THAI}]+")
THICK = HAN + KANA
THICK_GAP = re.compile(rf"(?<=[{THICK}])[  　]+(?=[{THICK}])")
THICK_RUN = re.compile(rf"[，、]|[{THICK}]+")


def _thai_gaps(text: str, start: int, end: int) -> list[int]:
    gaps = [m for m in THAI_GAP.finditer(text, start, end)]
    out, begun = [], start
    for n, m in enumerate(gaps):
        after = text[m.end() : gaps[n + 1].start() if n + 1 < len(gaps) else end]
        before = THAI_RUN.findall(text[begun : m.start()])
        behind = THAI_RUN.findall(after)
        if any(map(full_clause, before)) and any(map(full_clause, behind)) and opens_clause(behind[0]):
            out.append(m.start())
            begun = m.end()
    return out


def _thick_gaps(text: str, start: int, end: int) -> list[int]:
    out = []
    for m in THICK_GAP.finditer(text, start, end):
        low = m.start()
        while low > start and THICK_RUN.match(text[low - 1]) and m.start() - low < 12:
            low -= 1
        behind = THICK_RUN.match(text, m.end(), end)
        if m.start() - low > 3 and closes_clause(text[low : m.start()]) and not carries_on(behind[0][:12]):
            out.append(m.start())
    return out


def _arabic(text: str) -> bool:
    return sum(text.count(c) for c in "ةيىكأإ") > sum(text.count(c) for c in "پچژگکی")


def _ends(text: str, start: int, end: int) -> list[int]:
    """Offsets behind which a sentence of the paragraph ends: the nodes of its terminator lattice on the cheapest path."""
    opaque = [(m.start(), m.end()) for m in OPAQUE.finditer(text, start, end)]
    inside = enclosed(text, start, end)
    spans = sorted(inside.items())
    nodes: list[tuple[re.Match, int, bool]] = []
    o = s = 0
    for m in MARKS.finditer(text, start, end):
        a, b = m.span()
        while o < len(opaque) and opaque[o][1] <= a:
            o += 1
        if o < len(opaque) and opaque[o][0] <= a and not (b >= opaque[o][1] and m[0][0] in "…" or b > opaque[o][1]):
            if b < opaque[o][1] or text[opaque[o][0]] == "`":
                continue
        while s < len(spans) and spans[s][1] < a:
            s += 1
        closed, e = False, b
        if s < len(spans) and spans[s][0] < a:
            close = spans[s][1]
            if BEFORE_CLOSE.match(text, b, close).end() < close:
                continue
            closed, e = True, close + 1
        while e < end and text[e] in CLOSERS and e not in inside:
            e, closed = e + 1, True
        nodes.append((m, e, closed))
    return _cheapest_ends(text, start, end, nodes)


def _cheapest_ends(text: str, start: int, end: int, nodes: list[tuple[re.Match, int, bool]]) -> list[int]:
    """Ends on the cheapest path: at every node the sentence ends or goes on."""
    costs, ways = (0.0, float("inf")), []  # ended at the node before (or nothing before), went on there
    begun = start
    for m, e, closed in nodes:
        after_end = _evidence(text, start, end, m, e, closed, begun)
        dominated = costs[1] >= costs[0] + abs(after_end)  # then no way through the other node is cheaper, whatever it weighs
        after_none = after_end if dominated else _evidence(text, start, end, m, e, closed, start)
        end_one, end_other = costs[0] - min(0.0, after_end), costs[1] - min(0.0, after_none)  # cost of ending
        on_one, on_other = costs[0] + max(0.0, after_end), costs[1] + max(0.0, after_none)  # cost of going on
        ways.append((int(end_other < end_one), int(on_other < on_one)))
        costs = (min(end_one, end_other), min(on_one, on_other))
        begun = e
    out, way = [], 0 if costs[0] <= costs[1] else 1
    for (_, e, _), before in zip(reversed(nodes), reversed(ways)):
        if way == 0:
            out.append(e)
        way = before[way]
    return out[::-1]


# Weights of evidence, for an end if positive.
SURE, STRONG_HINT, HINT = 4.0, 3.0, 2.0


def _evidence(text: str, start: int, end: int, m: re.Match, e: int, closed: bool, begun: int) -> float:
    """Weight for an end behind the mark, less that against it; ``begun`` is where the sentence began."""
    behind = text[e:end]
    rest = behind.lstrip()
    if not rest:
        return SURE
    gap = len(behind) - len(rest)
    mark, nxt = m[0], rest[0]
    if nxt in ",;:،؛，、；：)]）":
        return -SURE
    word = HEAD.match(rest)
    head = word[0] if word else ""
    omission = "…" in mark or len(mark) > 1 and set(mark) == {"."}
    if closed or omission:
        thick = THICK_RUN.match(rest)
        if nxt.islower() or head in CARRY_ON or thick and carries_on(thick[0][:12]):
            return -STRONG_HINT
        if closed and head.startswith("و") and len(head) > 1 and _arabic(text[start:end]):
            return -HINT
        if omission and not closed and not gap:
            return HINT if nxt.isupper() else -HINT
        return HINT
    if mark[-1] in STRONG or mark[0] in STRONG:
        return SURE
    before = text[begun : m.start()]
    if mark[0] != ".":
        if not gap:
            return -HINT if nxt.islower() or nxt.isdigit() or nxt in "=&_/" else HINT
        return -HINT if nxt.islower() else STRONG_HINT
    piece = "" if not before or before[-1].isspace() else before.rsplit(None, 1)[-1]
    token = TOKEN.search(piece)[0]
    if not gap:
        if nxt.islower() or nxt.isdigit() or nxt in "_/\\-=&@%º°" or not token:
            return -STRONG_HINT
        if nxt.isupper():
            return HINT if len(token) > 1 and not token[-1].isupper() or token[-1] in "0123456789`" else -HINT
        return HINT if nxt.isalpha() or nxt in "`\"“„«‹¿¡(（「" else -HINT
    bare = token.rstrip(".").lower()
    if ITEM_NUMBER.fullmatch(before) and (m.start() == start or before.strip() == token):
        return -SURE
    if bare in ABBREVIATIONS and not (bare in MAY_END and nxt.isupper()):
        return -STRONG_HINT
    if len(token) == 1 and token.isupper() and nxt.isupper() or nxt.islower():
        return -STRONG_HINT
    if bare in MAY_END:
        return HINT if head not in COMPANY and not nxt.isdigit() else -HINT
    if token.isdigit() and len(token) <= 2 and head:
        previous = re.search(r"(\w+)\s+\Z", before[: len(before) - len(token)])
        if head.lower() in MONTHS or previous and previous[1].lower() in ORDINAL_BEFORE and head[0].isupper():
            return -STRONG_HINT
    return STRONG_HINT


HEAD = re.compile(r"[^\W_]+")
TOKEN = re.compile(r"[^\s(\[{\"“„«‹「『（—–/]*\Z")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, from the first to the last visible character of each."""
    cuts = {0, len(text)}
    for m in PARAGRAPH.finditer(text):
        cuts |= {m.start(), m.end()}
    cuts |= {m.start() for m in ITEM.finditer(text)}
    for m in HEADING.finditer(text):
        cuts |= {m.start(), m.end()}
    bounds = sorted(cuts)
    for start, end in zip(bounds, bounds[1:]):
        cuts.update(_ends(text, start, end))
        if THAI_GAP.search(text, start, end):
            cuts.update(_thai_gaps(text, start, end))
        if THICK_GAP.search(text, start, end):
            cuts.update(_thick_gaps(text, start, end))
    bounds = sorted(cuts)
    out = []
    for start, end in zip(bounds, bounds[1:]):
        while start < end and _unseen(text[start]):
            start += 1
        while end > start and _unseen(text[end - 1]):
            end -= 1
        if start < end:
            out.append((start, end))
    return out


def _unseen(char: str) -> bool:
    return char.isspace() or unicodedata.category(char) in ("Cf", "Cc")


def split_sentences(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, char_start, char_end, sentence), one row per sentence; offsets count code points, the end is exclusive.

    Texts that are null, empty or without a visible character have no sentences. Rows are split where they are
    read, without a shuffle; repeated rows give repeated sentences, further columns are dropped. The rank file of
    ``lattice.vocabulary`` must be readable on every executor; where it is not, the first text that needs its words
    is an error.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                found = [(i, a, b, t[a:b]) for i, t in enumerate(texts) if t for a, b in sentence_spans(t)]
                if found:
                    row, starts, ends, sentences = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(row)), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(sentences, pa.string())],
                        names=["key", "char_start", "char_end", "sentence"],
                    )

    picked = rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(
        run, f"key {kind}, char_start int, char_end int, sentence string"
    ).withColumnRenamed("key", key)
