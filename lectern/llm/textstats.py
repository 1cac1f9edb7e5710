"""Statistics of texts, for a whole batch at a time.

The texts of a batch are laid end to end as code points. A table gives every character its classes and its folded form;
words, lines, segments and their counts then come from array operations over the batch, without a pass per text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from lectern.llm.skeleton import consistent, prototypes

# Common words of the corpus languages.
COMMON = {
    "en": "the a an of to in is and that it for on by be with as at this from or are not so before until",
    "fa": "و در به از که را این با است می‌شود برای تا هر آن یا نیز شود بر پس اگر",
    "de": "der die das und ist nicht den dem mit auf für ein eine zu von im nach bei bis wird",
    "fr": "le la les de des du et est une un en à que pour dans par sur ne pas au",
    "es": "el la los de y que en un una por con se del las para al no es lo su",
    "ar": "في من على إلى أن هذا التي الذي لا ما عن مع كل هو هي قبل بعد عند ثم إذا",
}
# Characters that do the work of common words in scripts without spaces.
COMMON_CHARS = "的了是在和并会请不有这与将被为从就がはをにのとでですますしも"

STATISTICS = (
    "word_count", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "broken_share", "single_letters",
    "digit_share", "item_share", "cell_share", "distinct_words", "words_per_line", "capital_words", "long_words",
    "case_changes", "marked_share", "words_per_mark", "wordy_share", "common_share", "log_chars",
)

LETTER, UPPER, DIGIT, SPACE, BREAK, END, SYMBOL, SPACELESS, BROKEN, CLOSER, DROPPED, BULLET, CELL, FREQUENT = (1 << i for i in range(14))
#: Code points from here on share one class.
PLANE = 0x10000
#: Letters of a word beyond which its hash is that of its first letters.
HASHED = 64
#: Code points handled at a time.
BLOCK = 200_000

# End marks, marks that may stand behind them, bullets, separators of cells, and plain punctuation.
END_MARKS = ".!?؟۔。！？…।॥"
CLOSERS = "\"'”’»)]`"
BULLETS = "-*•+"
PLAIN = ".,;:!?'\"()«»“”„‘’؟،؛。、！？：；（）「」…‌-_"
MOJIBAKE = "ÃÂØÙÛÐÑ"


def _classes(char: str) -> int:
    point, kind = ord(char), unicodedata.category(char)
    spaceless = 0x3040 <= point <= 0x30FF or 0x3400 <= point <= 0x9FFF or 0xF900 <= point <= 0xFAFF or 0x0E01 <= point <= 0x0E4E
    out = 0
    if char == "‌" or kind[0] == "L":
        out |= LETTER | (UPPER if kind == "Lu" else 0)
    elif kind in ("Mn", "Cf", "Mc"):
        return DROPPED
    if kind in ("Nd", "No", "Nl"):
        out |= DIGIT
    if char.isspace():
        out |= SPACE | (BREAK if char in "\n\v\f\x85  " else 0)
    elif char in END_MARKS:
        out |= END
    elif kind == "Cc" or char in MOJIBAKE or char == "�":
        out |= BROKEN
    if kind[0] in "PSC" and char not in PLAIN and not char.isspace():
        out |= SYMBOL
    for chars, flag in ((CLOSERS, CLOSER), (BULLETS, BULLET), ("|\t", CELL), (COMMON_CHARS, FREQUENT)):
        out |= flag if char in chars else 0
    return out | (SPACELESS if spaceless else 0)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes, folded character) of every code point of the first plane, and the hashes of the common words, sorted."""
    like = prototypes()
    classes, fold = np.zeros(PLANE + 1, dtype=np.uint16), np.arange(PLANE + 1, dtype=np.uint64)
    for point in range(PLANE):
        if 0xD800 <= point < 0xE000:
            continue
        char = chr(point)
        shown = like.get(point, char)
        classes[point] = _classes(shown[0]) if len(shown) == 1 and shown != " " else _classes(char)
        plain = unicodedata.normalize("NFD", shown.lower())
        fold[point] = ord(plain[0]) if plain else point
    classes[PLANE] = SYMBOL
    hashes = set()
    for words in COMMON.values():
        for word in words.split():
            points = np.array([ord(c) for c in unicodedata.normalize("NFD", consistent(word))], dtype=np.uint32)
            points = points[(classes[points] & LETTER) > 0]
            hashes.add(int((fold[points] * _powers()[: len(points)]).sum(dtype=np.uint64)))
    return classes, fold, np.array(sorted(hashes), dtype=np.uint64)


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(HASHED - 1, 0x9E3779B97F4A7C15, dtype=np.uint64)], dtype=np.uint64)


def _sums(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each stretch between the starts; stretches may be empty."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[np.r_[starts[1:], len(flags)]] - total[starts]


def _shares(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(1, whole)


def _block(texts: Sequence[str]) -> np.ndarray:
    table, fold, common_hashes = _tables()
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.minimum(points, PLANE)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    cls = table[points]
    if (dropped := (cls & DROPPED) > 0).any():
        keep = ~dropped
        points, cls, doc = points[keep], cls[keep], doc[keep]
    n, count = len(points), len(texts)
    starts = np.searchsorted(doc, np.arange(count))
    has = lambda flag: (cls & flag) > 0
    letter, space, digit, end, brk = has(LETTER), has(SPACE), has(DIGIT), has(END), has(BREAK)
    seen = ~space
    visible = _sums(seen, starts)
    per_doc = lambda flags: _sums(flags, starts)

    first_of_doc = np.zeros(n, dtype=bool)
    first_of_doc[starts[starts < n]] = True
    before = np.r_[False, letter[:-1]] & ~first_of_doc
    spaceless = has(SPACELESS)
    cut = letter & ~before
    at = np.flatnonzero(cut)  # first letter of every word
    inner = np.flatnonzero(letter)
    word = np.cumsum(cut[inner]) - 1  # number of the word of each letter
    length = np.bincount(word, minlength=len(at)) if len(at) else np.zeros(0, dtype=np.int64)
    place = inner - at[word] if len(at) else inner
    hashes = np.add.reduceat(fold[points[inner]] * np.where(place < HASHED, _powers()[np.minimum(place, HASHED - 1)], np.uint64(0)), np.r_[0, np.cumsum(length)[:-1]]) if len(at) else np.zeros(0, dtype=np.uint64)
    found = common_hashes[np.minimum(np.searchsorted(common_hashes, hashes), len(common_hashes) - 1)] == hashes
    word_doc = doc[at]
    words = np.bincount(word_doc, minlength=count)
    by_word = lambda weights: np.bincount(word_doc, weights=weights, minlength=count)

    change = np.zeros(n, dtype=bool)
    upper = has(UPPER)
    change[1:] = upper[1:] & letter[:-1] & ~upper[:-1] & ~first_of_doc[1:]
    all_upper = _sums(upper[inner], np.r_[0, np.cumsum(length)[:-1]]) == length if len(at) else np.zeros(0, dtype=bool)
    low = np.uint64(64 - max(1, count.bit_length()))
    pairs = np.sort(word_doc.astype(np.uint64) << low | hashes & ((np.uint64(1) << low) - np.uint64(1)))
    fresh = np.r_[True, pairs[1:] != pairs[:-1]] if len(pairs) else np.zeros(0, dtype=bool)
    distinct = np.bincount((pairs[fresh] >> low).astype(np.int64), minlength=count)

    # words of scripts without spaces are taken as two characters each
    thick = per_doc(spaceless)
    unspaced = thick * 3 > visible
    frequent = per_doc(has(FREQUENT))
    total_words = np.where(unspaced, np.maximum(1, thick // 2), words)

    # lines
    line_start = first_of_doc.copy()
    line_start[1:] |= brk[:-1]
    ls = np.flatnonzero(line_start)
    line_doc = doc[ls]
    in_line = lambda flags: _sums(flags, ls)
    line_seen = in_line(seen)
    full = line_seen > 0
    lines = np.bincount(line_doc[full], minlength=count)
    spots = np.flatnonzero(seen)
    cum = np.concatenate([[0], np.cumsum(seen)])
    head = spots[np.minimum(cum[ls], max(0, len(spots) - 1))] if len(spots) else ls
    line_end = np.r_[ls[1:], n]
    tail = spots[np.maximum(0, cum[line_end] - 1)] if len(spots) else ls
    closers = has(CLOSER) & ~end
    real = tail.copy()
    for _ in range(3):  # closing marks behind the end mark
        back = closers[real] & (real > head) & full
        real = np.where(back, real - 1, real)
    colon = points[np.minimum(tail, n - 1)] == ord(":") if n else np.zeros(0, dtype=bool)
    ends = (end[real] | colon) & full if n else full
    nxt = lambda i, d: np.minimum(i + d, n - 1)
    bullet = has(BULLET)
    closing = (points == ord(".")) | (points == ord(")"))
    item = (bullet[head] & space[nxt(head, 1)]) if n else full
    if n:
        numbered = np.zeros(len(head), dtype=bool)
        run = digit[head]
        for d in (1, 2, 3):
            numbered |= run & closing[nxt(head, d)] & space[nxt(head, d + 1)]
            run = run & digit[nxt(head, d)]
        item = (item | numbered | (points[head] == ord("[")) & (points[nxt(head, 2)] == ord("]"))) & full
    gap = np.zeros(n, dtype=bool)
    gap[2:] = space[2:] & space[1:-1] & space[:-2] & ~brk[2:] & ~brk[1:-1] & ~brk[:-2]
    comma = points == ord(",")
    tight = np.zeros(n, dtype=bool)
    tight[:-1] = comma[:-1] & ~space[1:]
    angle = points == ord("<")
    separators = in_line(has(CELL)) + in_line(gap) + 2 * (in_line(tight) > 1) + 2 * (in_line(angle) > 1)
    cells = (separators > 0) & ~ends & full
    line_share = lambda flags: _shares(np.bincount(line_doc, weights=line_seen * flags, minlength=count), visible)

    # segments: up to an end mark with a space or the end behind it, an item, a blank line, or a row of cells
    close = end.copy()
    close[:-1] &= space[1:] | spaceless[1:] | closers[1:] | first_of_doc[1:] | end[1:]
    wide = end & (points > 0x2000)
    close |= wide
    seg_start = first_of_doc.copy()
    seg_start[1:] |= close[:-1]
    hard = np.r_[False, (~full[:-1]) | cells[:-1]] | item | cells | ~full
    seg_start[ls[hard[: len(ls)]]] = True
    ss = np.flatnonzero(seg_start)
    seg_doc = doc[ss]
    seg_seen = _sums(seen, ss)
    seg_words = _sums(cut, ss) + _sums(spaceless, ss) // 2
    last = np.r_[ss[1:], n] - 1
    seg_closed = close[last] if n else np.zeros(0, dtype=bool)
    is_common = np.zeros(n, dtype=bool)
    is_common[at[found]] = True
    seg_common = _sums(is_common, ss) + _sums(has(FREQUENT), ss)
    seg_letters = _sums(letter, ss)
    seg_share = lambda flags: _shares(np.bincount(seg_doc, weights=seg_seen * flags, minlength=count), visible)
    marks = np.bincount(seg_doc, weights=seg_closed, minlength=count)

    out = np.stack(
        [
            np.where(words + thick > 0, total_words, 0),
            np.where(unspaced, 2.0, _shares(by_word(length), words)),
            _shares(per_doc(has(SYMBOL)), visible),
            _shares(np.bincount(line_doc, weights=ends, minlength=count), lines),
            np.where(unspaced, np.minimum(1.0, _shares(frequent, total_words)), _shares(by_word(found), words)),
            _shares(per_doc(has(BROKEN)), visible),
            np.where(unspaced, 0.0, _shares(by_word(length == 1), words)),
            _shares(per_doc(digit), visible),
            line_share(item),
            line_share(cells),
            np.where(unspaced, 1.0, _shares(distinct, words)),
            _shares(total_words, lines),
            _shares(by_word(all_upper & (length > 1)), words),
            _shares(by_word((length > 18) & ~spaceless[at]), words),
            _shares(per_doc(change), words),
            seg_share(seg_closed),
            _shares(total_words, marks + 1),
            seg_share((seg_words >= 4) & (seg_letters * 2 > seg_seen)),
            seg_share(seg_common > 0),
            np.log1p(visible),
        ],
        1,
    ).astype(np.float64)
    out[visible == 0] = 0.0
    return out


def statistics(texts: Sequence[str | None]) -> np.ndarray:
    """The values of ``STATISTICS``, a row for each text; all 0 for a text that is null or without a visible character."""
    out, at = [np.zeros((0, len(STATISTICS)))], 0
    plain = [t or "" for t in texts]
    while at < len(plain):
        stop, size = at, 0
        while stop < len(plain) and (stop == at or size + len(plain[stop]) <= BLOCK):
            size += len(plain[stop])
            stop += 1
        out.append(_block(plain[at:stop]))
        at = stop
    return np.concatenate(out)
