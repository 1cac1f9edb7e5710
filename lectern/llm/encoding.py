"""Encoding of a whole corpus with a public byte-level BPE vocabulary, by forced boundaries.

A pair of bytes that occurs inside no vocabulary token can never be merged over: between the two, every encoding has
a token boundary. Texts are cut at such places, each distinct fragment is encoded once by itself, and the ids are
concatenated. The cuts are restricted to places where the split into pre-tokens is the same for the fragments as
for the whole text:

* between two characters, never inside one;
* not behind white space, since a run of white space is split by what follows it;
* not before an apostrophe, since a contraction is recognised only where no symbol precedes it.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fragments kept encoded by a worker; when as many are held, the memory is emptied.
MEMORY = 300_000
#: Characters encoded at a time.
BLOCK = 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes → id from a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def joined_pairs(tokens: Iterable[bytes]) -> np.ndarray:
    """(256, 256) flags of the byte pairs that occur inside some token."""
    flags = np.zeros((256, 256), dtype=bool)
    for t in tokens:
        for a, b in zip(t, t[1:]):
            flags[a, b] = True
    return flags


class Encoder:
    """Forced-boundary encoder over one rank file."""

    def __init__(self, path: str):
        import tiktoken

        ranks = read_ranks(path)
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.certain = ~joined_pairs(ranks)
        self.first, self.last = self._edges()
        self.space = np.array([chr(c).isspace() for c in range(0x10000)])
        self.memory: dict[str, int] = {}
        self._empty()

    @staticmethod
    def _edges() -> tuple[np.ndarray, np.ndarray]:
        """First and last UTF-8 byte of every character of the basic plane; of a surrogate those of "?"."""
        c = np.arange(0x10000)
        first = np.select([c < 0x80, c < 0x800], [c, 0xC0 | c >> 6], 0xE0 | c >> 12)
        last = np.where(c < 0x80, c, 0x80 | c & 0x3F)
        lone = (c >= 0xD800) & (c < 0xE000)
        return np.where(lone, ord("?"), first).astype(np.uint8), np.where(lone, ord("?"), last).astype(np.uint8)

    def _empty(self) -> None:
        self.memory.clear()
        self.ids = array("i")  # of all remembered fragments, one behind the other
        self.ends = array("q", [0])  # where each of them ends, behind a 0

    def cuts(self, text: str) -> np.ndarray:
        """Offsets in the text, ascending, at which it may be cut without a change of the ids."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if len(points) < 2:
            return np.empty(0, dtype=np.int64)
        low = np.minimum(points, 0xFFFF)
        first, last = self.first[low], self.last[low]
        high = points > 0xFFFF
        if high.any():
            first = np.where(high, (0xF0 | points >> 18).astype(np.uint8), first)
            last = np.where(high, (0x80 | points & 0x3F).astype(np.uint8), last)
        ok = self.certain[last[:-1], first[1:]] & ~self.space[low[:-1]] & (points[1:] != 0x27)
        return np.flatnonzero(ok) + 1

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        if len(self.memory) > MEMORY:
            self._empty()
        whole = "".join(texts)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        at = np.union1d(self.cuts(whole), np.r_[0, ends])
        memory, ids, fragment_ends = self.memory, self.ids, self.ends
        numbers = np.empty(max(0, len(at) - 1), dtype=np.int64)
        stops = at.tolist()
        for i in range(len(stops) - 1):
            fragment = whole[stops[i] : stops[i + 1]]
            n = memory.get(fragment)
            if n is None:
                n = memory[fragment] = len(fragment_ends) - 1
                ids.extend(self.encoding.encode_ordinary(fragment))
                fragment_ends.append(len(ids))
            numbers[i] = n
        held = np.array(fragment_ends, dtype=np.int64)
        starts, counts = held[numbers], held[numbers + 1] - held[numbers]
        offset = np.cumsum(counts) - counts
        flat = np.frombuffer(ids, dtype=np.int32) if ids else np.empty(0, dtype=np.int32)
        out = flat[np.repeat(starts - offset, counts) + np.arange(counts.sum())]
        del flat  # a view would keep the array from growing
        total = np.r_[0, np.cumsum(counts)]
        bounds = total[np.searchsorted(at, ends)]
        return out, np.diff(np.r_[0, bounds])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a rank file, built once in a Python worker."""
    return Encoder(path)


def _blocks(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def encode_texts(rows: DataFrame, key: str, text: str, path: str = BYTE_BPE_50K) -> DataFrame:
    """(key, ids) of every row: ids by the vocabulary at path, without special tokens.

    A null or empty text has an empty list. Whatever looks like a special token is ordinary text. Null and repeated
    keys stay as they are, further columns are dropped. There is no shuffle: texts are encoded where they are read,
    in blocks of bounded size, and workers keep a bounded number of encoded fragments. The file must be
    readable at that path on every executor.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _blocks(texts, BLOCK):
                ids, counts = enc.encode(texts[a:b])
                offsets = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["key", "ids"])

    picked = rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
