"""Vectorised hashes of words and n-grams over many texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE, _WORD = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 1 << 16), b, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers[0], _powers[1]


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of texts, with 64-bit hashes of their characters.

    Equal words have equal hashes; different ones collide with a probability near 2**-64."""

    def __init__(self, texts: list[str], lower_ascii: bool = False):
        joined = "\n".join(texts) + "\n"
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        if lower_ascii:
            cp = np.where((cp >= 65) & (cp <= 90), cp + np.uint32(32), cp)
        self.cp = cp
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.ends = np.cumsum(lengths)  # one past each text's closing line end
        self.starts = self.ends - lengths
        sep = (cp == 32) | ((cp >= 9) & (cp <= 13))
        word = ~sep
        edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0)))
        self.word_start, self.word_end = edge[0::2], edge[1::2]
        forward, self._back = _grow(len(cp) + 1)
        self._sums = np.zeros(len(cp) + 1, U)
        np.cumsum(mix(cp.astype(U) + U(1)) * forward[: len(cp)], out=self._sums[1:])
        self.hashes = self.span_hash(self.word_start, self.word_end)
        #: Index of each text's first word, and one past its last.
        self.first = np.searchsorted(self.word_start, self.starts)
        self.last = np.searchsorted(self.word_start, self.ends)
        self.n_words = self.last - self.first

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._back[start] + (end - start).astype(U))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of `size` words, and for each the number of its text; no run crosses texts."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        total = np.zeros(n, U)
        for j in range(size):
            total = total * _WORD + self.hashes[j : j + n]
        owner = np.repeat(np.arange(len(self.n_words)), self.n_words)
        inside = owner[:n] == owner[size - 1 :]
        return mix(total[inside]), owner[:n][inside]


def char_ngrams(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` code points within a text (its closing line end included), and the text of each; no run
    crosses texts, so that a text's runs don't hang on what stands beside it."""
    cp, n = words.cp, len(words.cp) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint32)
    for j in range(size):
        total = total * np.uint32(0x01000193) + cp[j : j + n]
    total = (total ^ (total >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    owner = np.repeat(np.arange(len(words.ends)), words.ends - words.starts)
    inside = owner[:n] == owner[size - 1 :]
    return (total ^ (total >> np.uint32(13)))[inside], owner[:n][inside]
