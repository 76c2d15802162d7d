"""Words of a text as 64-bit hashes and code points, without a Python object per word."""

from __future__ import annotations

from functools import cache

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 5
CHARACTERS = 1 << 18


@cache
def _folded() -> np.ndarray:
    """Lower-cased letter or digit of every code point, 0 for anything else."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        character = chr(code)
        if character.isalnum():
            low = character.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    size, inverse = CHARACTERS + 1, pow(BASE, -1, 1 << 64)
    out = []
    for base in (BASE, inverse):
        column = np.full(size, np.uint64(base & (2**64 - 1)), np.uint64)
        column[0] = 1
        out.append(np.multiply.accumulate(column))
    return out[0], out[1]


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    v = values ^ (values >> np.uint64(32))
    v = v * np.uint64(0xD6E8FEB86659FD93)
    v = v ^ (v >> np.uint64(29))
    v = v * np.uint64(0xC2B2AE3D27D4EB4F)
    return v ^ (v >> np.uint64(32))


def codes_of(text: str) -> np.ndarray:
    """Folded code points: letters and digits lower-cased, everything else 0."""
    return _folded()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]


class Words:
    """hashes, and begin and end of every word in `codes`."""

    def __init__(self, text: str):
        self.codes = codes_of(text)
        inside = self.codes != 0
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.begin, self.end = edges[0::2], edges[1::2]
        self.hashes = self._hashes()

    def _hashes(self) -> np.ndarray:
        """Polynomial of each word's code points, from sums over stretches of bounded length."""
        count = len(self.begin)
        out = np.zeros(count, np.uint64)
        powers, inverse = _powers()
        first = 0
        while first < count:
            origin = self.begin[first]
            last = max(first + 1, int(np.searchsorted(self.end, origin + CHARACTERS, side="right")))
            if self.end[first] - origin > CHARACTERS:
                out[first] = self._long(origin, self.end[first])
                first += 1
                continue
            part = mixed(self.codes[origin : self.end[last - 1]].astype(np.uint64))
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * powers[: len(part)], out=sums[1:])
            b, e = self.begin[first:last] - origin, self.end[first:last] - origin
            out[first:last] = (sums[e] - sums[b]) * inverse[b]
            first = last
        return mixed(out)

    def _long(self, begin: int, end: int) -> np.uint64:
        value, powers = np.uint64(0), _powers()[0]
        for at in range(begin, end, CHARACTERS):
            part = mixed(self.codes[at : min(end, at + CHARACTERS)].astype(np.uint64))
            value = mixed(np.array([value ^ (part * powers[: len(part)]).sum(dtype=np.uint64)]))[0]
        return value

    def __len__(self) -> int:
        return len(self.hashes)
