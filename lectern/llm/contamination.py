"""Evaluation texts that leaked into a corpus, by a generalised suffix automaton of the test items.

Test items are normalised and turned into word numbers; the automaton of all of them is small and is sent to every
worker. Corpus tokens are streamed through it: at each position it knows the longest stretch of words that ends there
and occurs in some item, and by the suffix links the shorter ones that occur in others. Stretches that can't grow further
at a place of an item are laid out per item and chained in the item's order; an item leaked when its chain covers enough
of it.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.skeleton import prototypes

#: Bytes of item text up to which the automaton is built in one piece, about 0.3 GB in a worker; more items are handled in
#: several passes, each with an automaton of its own.
BOUND = 1_000_000
#: Pieces of text kept normalised by a worker; when as many are held, the memory is emptied.
MEMORY = 400_000

MARKUP = re.compile(r"</?[A-Za-z][\w-]*(?:\s[^<>]*)?>")
MARKS = re.compile(r"[̀-ًͯ-ٰٟۖ-ۭـ]+")
UNSPACED = "぀-ヿ㐀-鿿豈-﫿ก-๛ກ-ໟက-႟ក-៿"
WORD = re.compile(rf"[{UNSPACED}]|[^\W_{UNSPACED}]+")
PIECE = re.compile(r"\S+")
DIGITS = {ord(c): str(unicodedata.digit(c)) for c in "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"}


def _fold() -> dict[int, str]:
    return prototypes() | DIGITS | {0x200C: " ", 0x200D: ""}


def normalised_words(text: str) -> list[str]:
    """Words without markup, case, accents, joiners, look-alike letters and kinds of digits.

    Full-width and invisible characters and look-alikes are settled by the skeleton. In scripts without spaces every
    character is a word.
    """
    if "<" in text:
        text = MARKUP.sub("", text)
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFD", text.translate(_FOLD)))
    return WORD.findall(text.lower())


_FOLD = _fold()


class SuffixAutomaton:
    """Smallest automaton of all stretches of several token sequences, with the places where each state occurs.

    States are numbered along the tree of suffix links, so that the places of a state are one range of flat arrays.
    """

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int, int]] = []
        for item, tokens in enumerate(sequences):
            last = 0
            for at, token in enumerate(tokens):
                last = self._extend(last, token)
                ends.append((last, item, at))
        self.sequences = sequences
        self._lay_out(np.array(ends, dtype=np.int64).reshape(-1, 3))
        self.ending: dict[tuple[int, int, int], list[tuple[int, int]]] = {}

    def _lay_out(self, ends: np.ndarray) -> None:
        links = np.array(self.link, dtype=np.int64)
        children = np.argsort(links, kind="stable")
        first = np.searchsorted(links[children], np.arange(len(links) + 1))
        number, after = np.zeros(len(links), dtype=np.int64), np.zeros(len(links), dtype=np.int64)
        count, stack = 0, [0]
        while stack:
            s = stack.pop()
            if s < 0:
                after[~s] = count
                continue
            number[s] = count
            count += 1
            stack.append(~s)
            stack.extend(children[first[s] : first[s + 1]].tolist())
        order = np.argsort(number[ends[:, 0]], kind="stable")
        self.items, self.lasts = ends[order, 1].astype(np.int32), ends[order, 2].astype(np.int32)
        spots = number[ends[order, 0]]
        self.low, self.high = np.searchsorted(spots, number), np.searchsorted(spots, after)

    def places(self, state: int) -> list[tuple[int, int]]:
        """(item, position of the last token) of all occurrences of a state."""
        part = slice(self.low[state], self.high[state])
        return list(zip(self.items[part].tolist(), self.lasts[part].tolist()))

    def _extend(self, last: int, token: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if token in nxt[last]:
            q = nxt[last][token]
            return q if length[q] == length[last] + 1 else self._split(last, token, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and token not in nxt[p]:
            nxt[p][token] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][token]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, token, q)
        return new

    def _split(self, p: int, token: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(token) == q:
            nxt[p][token] = copy
            p = link[p]
        return copy

    def matches(self, tokens: Sequence[int], least: int) -> Iterator[tuple[int, int, int, int]]:
        """(end, length, item, last) of every match of at least so many tokens with every place in every item, where it
        can grow neither to the left nor to the right at that place.

        A stretch of one item may hold a part of another item anywhere, so the suffix links are walked at each position.
        """
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        for at, token in enumerate(tokens):
            while state and token not in nxt[state]:
                state = link[state]
                size = length[state]
            if token not in nxt[state]:
                state = size = 0
                continue
            state = nxt[state][token]
            size += 1
            following = tokens[at + 1] if at + 1 < len(tokens) else -1
            s, n, longer = state, size, -1
            while n >= least:
                for item, last in self._ending(s, longer, following):
                    yield at + 1, n, item, last
                s, longer = link[s], s
                n = length[s]

    def _ending(self, state: int, longer: int, following: int) -> list[tuple[int, int]]:
        """Places of a state that are none of the longer state and aren't followed by the token; remembered."""
        key = (state, longer, following if following in self.next[state] else -1)
        held = self.ending.get(key)
        if held is None:
            known = set(self.places(longer)) if longer >= 0 else ()
            held = self.ending[key] = [
                (item, last)
                for item, last in self.places(state)
                if (item, last) not in known and (key[2] < 0 or self.sequences[item][last + 1 : last + 2] != [key[2]])
            ]
        return held


def chained(matches: list[tuple[int, int, int]], near: int) -> tuple[int, int, int]:
    """(covered words, first, last position) of the best chain of (start in text, start in item, length).

    In a chain both starts ascend, overlaps count once and two stretches are at most ``near`` words apart on both sides.
    """
    matches = sorted(set(matches))
    best: list[tuple[int, int]] = []
    low = 0
    for i, (a, b, n) in enumerate(matches):
        value, begun = n, a
        while low < i and matches[low][0] + matches[low][2] + near + n < a - near:
            low += 1
        for j in range(i - 1, low - 1, -1):
            c, d, m = matches[j]
            if c + m + near < a or d + m + near < b or d >= b:
                continue
            cut = max(0, c + m - a, d + m - b)
            if cut < n and best[j][0] + n - cut > value:
                value, begun = best[j][0] + n - cut, best[j][1]
        best.append((value, begun))
    i = max(range(len(best)), key=lambda k: best[k][0])
    return best[i][0], best[i][1], matches[i][0] + matches[i][2]


class LeakFinder:
    """Automaton and word numbers of the items, and the search in one text."""

    def __init__(self, items: Sequence[tuple[object, str]], least: int, near: int, share: float):
        self.least, self.near, self.share = least, near, share
        words = [normalised_words(t or "") for _, t in items]
        self.names = [name for name, _ in items]
        self.sizes = [len(w) for w in words]
        self.number: dict[str, int] = {}
        numbered = [[self.number.setdefault(w, len(self.number)) for w in ws] for ws in words]
        self.base = len(self.number) + 1
        self.known: dict[str, list[int]] = {}
        grams = {self._gram(t[i : i + 3]) for t in numbered for i in range(len(t) - 2)}
        self.grams = np.array(sorted(grams), dtype=np.int64)
        self.automaton = SuffixAutomaton(numbered)

    def _gram(self, three: Sequence[int]) -> int:
        a, b, c = three
        return (a * self.base + b) * self.base + c

    def tokens(self, text: str) -> list[int]:
        """Numbers of the normalised words of a text, -1 for words of no item.

        Normalisation never looks past white space, so each piece between is normalised once and remembered.
        """
        out: list[int] = []
        for piece in (MARKUP.sub("", text) if "<" in text else text).split():
            out += self._numbers(piece)
        return out

    def _numbers(self, piece: str) -> list[int]:
        words = self.known.get(piece)
        if words is None:
            if len(self.known) > MEMORY:
                self.known.clear()
            words = self.known[piece] = [self.number.get(w, -1) for w in normalised_words(piece)]
        return words

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """(start, end) in the text of the piece that holds each word of ``tokens``."""
        kept = [(0, 0)]  # (position in the text without markup, position in the text) behind each piece of markup
        plain, size, behind = [], 0, 0
        for m in MARKUP.finditer(text):
            plain.append(text[behind : m.start()])
            size += m.start() - behind
            behind = m.end()
            kept.append((size, behind))
        plain.append(text[behind:])
        starts = [k[0] for k in kept]
        home = lambda at: kept[i := bisect_right(starts, at) - 1][1] + at - kept[i][0]
        return [(home(m.start()), home(m.end() - 1) + 1) for m in PIECE.finditer("".join(plain)) for _ in self._numbers(m[0])]

    def find(self, text: str) -> list[tuple[object, int, float, int, int]]:
        """(item, covered words, share of the item, first and last word position in the text) of the leaked items."""
        return self._leaks(self.tokens(text))[0]

    def spans(self, text: str, longest: int) -> list[tuple[int, int]]:
        """(start, end) of the passages of leaked items and of all stretches of ``longest`` words or more, merged."""
        leaks, stretches = self._leaks(self.tokens(text))
        words = [(first, last) for *_, first, last in leaks] + [(a, a + n) for a, n in stretches if n >= longest]
        if not words:
            return []
        at = self.offsets(text)
        out: list[list[int]] = []
        for first, last in sorted(words):
            start, end = at[first][0], at[last - 1][1]
            if out and start <= out[-1][1]:
                out[-1][1] = max(out[-1][1], end)
            else:
                out.append([start, end])
        return [tuple(span) for span in out]

    def _leaks(self, tokens: list[int]) -> tuple[list[tuple[object, int, float, int, int]], set[tuple[int, int]]]:
        """Leaked items, and (start, length) of all stretches that were followed."""
        if len(tokens) < self.least:
            return [], set()
        t = np.array(tokens, dtype=np.int64)
        known = (t[:-2] >= 0) & (t[1:-1] >= 0) & (t[2:] >= 0)
        if not known.any() or not len(self.grams):
            return [], set()
        at = np.flatnonzero(known)
        three = (t[at] * self.base + t[at + 1]) * self.base + t[at + 2]
        place = np.minimum(np.searchsorted(self.grams, three), len(self.grams) - 1)
        hit = at[self.grams[place] == three]
        if not len(hit):
            return [], set()
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        breaks = np.flatnonzero(np.diff(hit) > 1) + 1
        for run in np.split(hit, breaks):  # every stretch of three words or more lies within one run
            start, end = int(run[0]), int(run[-1]) + 3
            for stop, size, item, last in self.automaton.matches(tokens[start:end], self.least):
                found[item].append((start + stop - size, last + 1 - size, size))
        out, stretches = [], {(a, n) for matches in found.values() for a, _, n in matches}
        for item, matches in found.items():
            if sum(n for _, _, n in matches) < self.share * self.sizes[item]:
                continue
            covered, first, last = chained(matches, self.near)
            if covered >= self.share * self.sizes[item]:
                out.append((self.names[item], covered, covered / self.sizes[item], first, last))
        return out, stretches


def leaked_items(
    corpus: DataFrame,
    key: str,
    text: str,
    items: DataFrame,
    item_key: str,
    item_text: str,
    least: int = 3,
    near: int = 10,
    share: float = 0.45,
) -> DataFrame:
    """(key, item key, covered, coverage, first_word, last_word): each text with each item whose stretches of at least
    ``least`` words, in the item's order and at most ``near`` words apart, cover at least ``share`` of its words.

    Null and empty texts and items never match; items with fewer than ``least`` words neither. Repeated rows of the
    corpus give repeated rows, repeated items count once. The items' size is checked before they are sent to the
    workers: beyond ``BOUND`` bytes they are split into several automata, each of which reads the corpus once.
    """
    kinds = [corpus.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()]
    picked = corpus.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where(F.length("text") > 0)
    out = None
    for finder in _finders(corpus, items, item_key, item_text, least, near, share):

        def run(batches: Iterator[pa.RecordBatch], finder=finder) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [
                    (i, *leak) for i, t in enumerate(batch.column(1).to_pylist()) for leak in finder.value.find(t)
                ]
                if rows:
                    i, item, covered, coverage, first, last = zip(*rows)
                    kind = pa.infer_type(item)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(i)), pa.array(item, kind), pa.array(covered, pa.int32()),
                         pa.array(coverage, pa.float64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())],
                        names=["key", "item", "covered", "coverage", "first_word", "last_word"],
                    )

        found = picked.mapInArrow(
            run, f"key {kinds[0]}, item {kinds[1]}, covered int, coverage double, first_word int, last_word int"
        )
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("key", key).withColumnRenamed("item", item_key)


def _finders(corpus: DataFrame, items: DataFrame, item_key: str, item_text: str, least: int, near: int, share: float) -> list:
    """Broadcast finders, each of at most about ``BOUND`` bytes of the items' text."""
    if least < 3:
        raise ValueError("least must be 3 or more")
    clean = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("text")).where(F.length("text") > 0).distinct()
    total = clean.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // BOUND))
    out = []
    for part in range(parts):
        mine = clean.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).orderBy("item", "text").collect()
        out.append(corpus.sparkSession.sparkContext.broadcast(LeakFinder([tuple(r) for r in mine], least, near, share)))
    return out


def without_leaks(
    corpus: DataFrame,
    key: str,
    text: str,
    items: DataFrame,
    item_key: str,
    item_text: str,
    least: int = 3,
    near: int = 10,
    share: float = 0.45,
    longest: int = 13,
) -> DataFrame:
    """(key, text, removed_chars): every text without the passages of items of which ``share`` or more of the words leaked, and
    without any stretch of ``longest`` words or more of an item.

    A passage goes from the first to the last of its words, with the marks that touch them. Null stays null and empty
    stays empty, with nothing removed; repeated rows stay, further columns are dropped.
    """
    kind = corpus.schema[key].dataType.simpleString()
    out = corpus.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.lit(0).alias("removed_chars"))
    for finder in _finders(corpus, items, item_key, item_text, least, near, share):

        def run(batches: Iterator[pa.RecordBatch], finder=finder) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, removed = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                for i, t in enumerate(texts):
                    spans = finder.value.spans(t, longest) if t else []
                    if spans:
                        behind = [0] + [end for _, end in spans]
                        texts[i] = "".join(t[a:b] for a, b in zip(behind, [start for start, _ in spans] + [len(t)]))
                        removed[i] += sum(end - start for start, end in spans)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], names=["key", "text", "removed_chars"])

        out = out.mapInArrow(run, f"key {kind}, text string, removed_chars int")
    return out.withColumnRenamed("key", key)
