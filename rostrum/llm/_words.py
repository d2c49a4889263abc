"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow batch.

A word is a run of bytes other than space, \\t, \\n, \\v, \\f and \\r, or than those of another table given. Words and sequences of words
get 64-bit polynomial hashes, from running sums, so that any stretch costs two look-ups."""
import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: What parts terms, in lower case: ASCII other than letters and digits.
BETWEEN = np.arange(256) < 128
BETWEEN[[*range(48, 58), *range(97, 123)]] = False
U = np.uint64
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values, one to one."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64, for i up to n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = 1 << (n + 1).bit_length()
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, U(b))
            p[0] = U(1)
            both.append(np.cumprod(p, dtype=U))
        have = _powers[base] = tuple(both)
    return have


def sums(values: np.ndarray, base: int) -> np.ndarray:
    """Running sums of values[i] * base ** i, from 0."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


def stretch(total: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, end) under ``sums``; the same wherever a stretch stands."""
    return mix(((total[end] - total[start]) * powers(base, len(total))[1][start]) ^ ((end - start).astype(U) * U(0xA0761D6478BD642F)))


class Words:
    """start, end: byte ranges of the words; first: each text's first word, and the number of words at the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE):
        n = len(data)
        solid = ~gaps[data]
        begin, last = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        edge = offsets[(offsets > 0) & (offsets < n)]
        begin[edge] |= solid[edge]
        last[edge - 1] |= solid[edge - 1]
        self.data = data
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """Of each word."""
        return stretch(sums(self.data.astype(U) + U(1), _P), _P, self.start, self.end)


def run_sums(hashes: np.ndarray) -> np.ndarray:
    return sums(hashes, _Q)


def runs(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the word sequences [start, end), from ``run_sums``."""
    return stretch(total, _Q, start, end)
