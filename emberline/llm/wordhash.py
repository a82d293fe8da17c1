"""Words of many texts at once as 64-bit hashes, by numpy over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of words that are runs of anything but blanks, and of words of a-z, 0-9 and all non-ASCII.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self):
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 1 << 16)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                powers = np.full(size, np.uint64(base & _MASK))
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))
        return self.up[:n], self.down[:n]


def bounded(batch, column: str = "text", chars: int = 2 << 20):
    """Slices of an Arrow batch whose texts add up to about ``chars`` bytes, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, low = np.cumsum(sizes, dtype=np.int64), 0
    while low < batch.num_rows:
        before = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + chars, side="right")))
        yield batch.slice(low, high - low)
        low = high


def worker_memory(name: tuple, make):
    """What ``make`` returns, kept in this worker process from one task to the next."""
    import sys
    import types

    held = sys.modules.setdefault("_emberline_worker_memory", types.ModuleType("_emberline_worker_memory")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def prefix_sums(data: np.ndarray, powers: Powers) -> np.ndarray:
    up, _ = powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[:-1], out=sums[1:])
    return sums


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit hashes of stretches of the bytes that ``sums`` was made from."""
    _, down = powers.upto(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of a list of texts: ``hashes`` and ``starts``/``ends`` in ``data``, in order of place.

    ``first[i]`` is the number of words before text i; there is one more entry, the total.
    """

    def __init__(self, texts: list[str | None], is_word: np.ndarray, powers: Powers):
        raw = [(t or "").encode() for t in texts]
        joined = b"\n".join(raw) + b"\n"
        self.data = _LOWER[np.frombuffer(joined, np.uint8)]
        inside = is_word[self.data]
        edges = np.flatnonzero(np.diff(inside, prepend=False))
        self.starts, self.ends = edges[0::2], edges[1::2]
        sizes = np.array([len(r) + 1 for r in raw], np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.starts, begins)
        self._powers, self._sums = powers, prefix_sums(self.data, powers)
        self.hashes = self.hash_of(self.starts, self.ends)

    def hash_of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of any stretches of the lower-cased bytes."""
        return stretch_hashes(self._sums, starts, ends, self._powers)
