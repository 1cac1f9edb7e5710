"""A compressed bitmap over 32-bit ordinals, in containers of 2**16 positions.

A container with up to ``SPARSE`` positions is a sorted array of 16-bit offsets; a fuller one is a bitset
of 8 KiB. Set operations work container by container and choose the smaller form for the result.
"""

from __future__ import annotations

import numpy as np

WIDTH = 1 << 16
SPARSE = 4096


def _bits(container: np.ndarray) -> np.ndarray:
    if container.dtype == np.uint8:
        return container
    flags = np.zeros(WIDTH, dtype=bool)
    flags[container] = True
    return np.packbits(flags, bitorder="little")


def _offsets(container: np.ndarray) -> np.ndarray:
    if container.dtype == np.uint16:
        return container
    return np.flatnonzero(np.unpackbits(container, bitorder="little")).astype(np.uint16)


def _shrink(bits: np.ndarray) -> np.ndarray | None:
    n = int(np.bitwise_count(bits).sum())
    if n == 0:
        return None
    return bits if n > SPARSE else _offsets(bits)


class Bitmap:
    """Immutable set of ordinals in [0, 2**32)."""

    def __init__(self, containers: dict[int, np.ndarray] | None = None):
        self.containers = containers or {}

    @classmethod
    def of(cls, ordinals: np.ndarray) -> Bitmap:
        """From ordinals in any order; repeated ones count once."""
        values = np.unique(np.asarray(ordinals, dtype=np.int64))
        if not len(values):
            return cls()
        if values[0] < 0 or values[-1] >= 1 << 32:
            raise ValueError("ordinals must lie in [0, 2**32)")
        high = values >> 16
        starts = np.flatnonzero(np.r_[True, high[1:] != high[:-1]])
        out = {}
        for key, part in zip(high[starts], np.split((values & 0xFFFF).astype(np.uint16), starts[1:])):
            out[int(key)] = part if len(part) <= SPARSE else _bits(part)
        return cls(out)

    def andnot(self, other: Bitmap) -> Bitmap:
        """The ordinals of this bitmap that the other lacks."""
        return self._combine(other, lambda a, b: a & ~b, keep=True)

    def and_(self, other: Bitmap) -> Bitmap:
        """The ordinals in both."""
        return self._combine(other, lambda a, b: a & b, keep=False)

    def _combine(self, other: Bitmap, op, keep: bool) -> Bitmap:
        out = {}
        for key, mine in self.containers.items():
            theirs = other.containers.get(key)
            if theirs is None:
                if keep:
                    out[key] = mine
            elif (found := _shrink(op(_bits(mine), _bits(theirs)))) is not None:
                out[key] = found
        return Bitmap(out)

    def ordinals(self) -> np.ndarray:
        """All ordinals, ascending."""
        parts = [_offsets(c).astype(np.int64) + (key << 16) for key, c in sorted(self.containers.items())]
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)

    def __len__(self) -> int:
        return sum(len(c) if c.dtype == np.uint16 else int(np.bitwise_count(c).sum()) for c in self.containers.values())

    def nbytes(self) -> int:
        """Bytes of all containers."""
        return sum(c.nbytes for c in self.containers.values())
