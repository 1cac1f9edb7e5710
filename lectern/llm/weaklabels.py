"""Weak labels of texts: prose, junk or neither, by functions that vote on the text itself.

Each function looks at one kind of evidence that is no statistic of the model: repeated line shapes, strings of a machine, a
text that decodes once more, letters set apart, words in the order of a sentence. A function without a clear answer abstains,
and a text on which functions disagree, or of which too few speak, stays without a label.
"""

from __future__ import annotations

import re
from collections import Counter

from lectern.llm.skeleton import consistent
from lectern.llm.textstats import COMMON

FUNCTION_WORDS = frozenset(w for words in COMMON.values() for form in (words, consistent(words)) for w in form.split())
RUN = re.compile(r"[^\W\d_]+(?:[‌'’-][^\W\d_]+)*(?:,?[ \n]+[^\W\d_]+(?:[‌'’-][^\W\d_]+)*)+", re.U)
THICK_RUN = re.compile(r"[぀-ヿ㐀-鿿，、]{8,}")
MACHINE = re.compile(r"\b[0-9a-f]{2}(?: [0-9a-f]{2}){5,}\b|[A-Za-z0-9+/]{40,}={0,2}|\b\d{4}-\d\d-\d\d[T ]\d\d:\d\d|</?t[dr]>|^\s*[\w.-]+\s*[=:]\s*\S+\s*$|0x[0-9a-f]{4,}", re.M)
APART = re.compile(r"(?:\b\w ){6,}\w\b")
ITEM = re.compile(r"^\s*(?:[-*•+]|\d{1,3}[.)]|\[[ xX]?\])\s+(.*)$")
STOP = re.compile(r"[.!?؟۔。！？…](?:\W*$|\s)|[。！？]", re.M)

PROSE, JUNK, SILENT = 1, -1, 0


def _shape(line: str) -> str:
    return re.sub(r"\d+", "9", re.sub(r"[^\W\d_]+", "a", line.strip()))


def repeated_shapes(text: str) -> int:
    """Junk where most lines, with words and numbers made equal, repeat others and none of these ends like a sentence."""
    lines = [line for line in text.split("\n") if line.strip()]
    if len(lines) < 5:
        return SILENT
    open_lines = [line for line in lines if not STOP.search(line)]
    shapes = Counter(map(_shape, open_lines))
    again = sum(n for n in shapes.values() if n > 1)
    return JUNK if again > 0.6 * len(lines) and sum(map(len, open_lines)) > 0.7 * sum(map(len, lines)) and sum(map(len, open_lines)) < 60 * len(open_lines) else SILENT


def machine_strings(text: str) -> int:
    """Junk where strings as programs write them make up half of the text."""
    return JUNK if 2 * sum(len(m[0]) for m in MACHINE.finditer(text)) > len(text) else SILENT


def decodes_again(text: str) -> int:
    """Junk where the text is UTF-8 that was read in a one-byte code, as far as it goes."""
    tried = decoded = 0
    for word in text.split():
        if word.isascii():
            continue
        tried += 1
        for code in ("cp1252", "latin-1"):
            try:
                word.encode(code).decode("utf-8")
                decoded += 1
                break
            except UnicodeError:
                continue
    return JUNK if tried > 4 and decoded * 2 > tried else SILENT


def replaced_characters(text: str) -> int:
    """Junk where characters were lost: many marks of replacement or control characters."""
    return JUNK if sum(c == "�" or "\x7f" <= c < "\xa0" for c in text) * 12 > len(text) else SILENT


def letters_apart(text: str) -> int:
    """Junk where most of the text is single letters with spaces between."""
    return JUNK if 2 * sum(len(m[0]) for m in APART.finditer(text)) > len(text) else SILENT


def entries(text: str) -> int:
    """Junk where most of the text is items or names without the end of a sentence."""
    lines = [line for line in text.split("\n") if line.strip()]
    short = [line for line in lines if len(line) < 60 and not STOP.search(line)]
    if len(short) < 5:
        return SILENT
    return JUNK if 2 * sum(map(len, short)) > sum(map(len, lines)) and 4 * len(short) > 3 * len(lines) else SILENT


def columns(text: str) -> int:
    """Junk where most lines have the number of cells of the line before, three or more."""
    best = 0
    lines = [line for line in text.split("\n") if line.strip()]
    for cut in (r"\t", r"\s*\|\s*", r" {3,}", r",(?=\S)", r"</td>"):
        counts = [len(re.split(cut, line.strip())) for line in lines]
        best = max(best, sum(len(b) for b, m, n in zip(lines[1:], counts, counts[1:]) if m == n >= 3))
    return JUNK if len(lines) > 2 and 2 * best > len(text) else SILENT


def listed(text: str) -> int:
    """Junk where a long stretch is only names with commas between."""
    parts = re.split(r",\s", text)
    if len(parts) < 12:
        return SILENT
    return JUNK if len(text) / len(parts) < 26 and len(STOP.findall(text)) * 12 < len(parts) else SILENT


def shuffled(text: str) -> int:
    """Junk where words follow each other for long without any of a language's function words or an end."""
    words = text.split()
    if len(words) < 20 or THICK_RUN.search(text):
        return SILENT
    known = sum(w.strip(".,;:!?").lower() in FUNCTION_WORDS for w in words)
    return JUNK if known * 50 < len(words) and len(STOP.findall(text)) * 40 < len(words) else SILENT


def word_order(text: str) -> int:
    """Prose where runs of words of a sentence's length, function words among them or characters of an unspaced script, and
    each soon ended, make up most of the text."""
    good = sum(len(m[0]) for m in THICK_RUN.finditer(text))
    for m in RUN.finditer(text):
        words = m[0].lower().split()
        if len(words) >= 4 and any(w.strip(",") in FUNCTION_WORDS for w in words) and len(set(words)) * 3 > len(words) and len(m[0]) > 3 * len(words):
            good += len(m[0])
    stops = len(STOP.findall(text))
    return PROSE if good * 5 > 3 * len(text) and stops and len(text) < 260 * stops else SILENT


VOTERS = (repeated_shapes, machine_strings, decodes_again, replaced_characters, letters_apart, entries, columns, listed, shuffled, word_order)


def weak_label(text: str) -> int:
    """1 for prose, 0 for junk, -1 for a text without a label."""
    votes = {vote(text) for vote in VOTERS} - {SILENT}
    return -1 if len(votes) != 1 else int(votes == {PROSE})
