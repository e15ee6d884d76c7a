"""Word shingles of texts as 64-bit hashes, computed per Arrow batch with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B, _C = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
_S30, _S27, _S31 = (np.uint64(x) for x in (30, 27, 31))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _S30)) * _A
    x = (x ^ (x >> _S27)) * _B
    return x ^ (x >> _S31)


class WordHashes(dict):
    """Hashes of words, remembered; forgets everything once ``limit`` words are held."""

    limit = 1 << 18

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_cache = WordHashes()


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_cache.__getitem__, tokens), np.uint64, len(tokens))


def shingle_hashes(tokens: list[bytes], size: int, short: bool = True) -> np.ndarray:
    """Hash of every run of ``size`` words in order; with fewer words, of all of them if ``short``."""
    h = word_hashes(tokens)
    if len(h) < size:
        if not short or not len(h):
            return np.empty(0, np.uint64)
        size = len(h)
    out = mix(h[: len(h) - size + 1] + np.uint64(size))
    for k in range(1, size):
        out = mix(out * _C + h[k : len(h) - size + 1 + k])
    return out


def shingle_set(text: str | None, size: int, short: bool = True) -> np.ndarray:
    """Distinct shingle hashes of a text, ascending; empty for a text without words."""
    return np.unique(shingle_hashes(words(text), size, short))
