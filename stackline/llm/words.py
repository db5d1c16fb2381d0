"""Words of whole texts on bytes: bytes.split() parts at exactly U+0020 and U+0009 to U+000D."""

from __future__ import annotations

import numpy as np
import xxhash

SPACES = "\x20\t\n\x0b\x0c\r"
#: ASCII characters that are neither digits nor letters become spaces; bytes from 0x80 on stay.
_ALNUM = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def as_bytes(text: str | None) -> bytes:
    """UTF-8 of a text, null as empty; lone surrogates can't reach Spark strings, but are kept apart here."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def lowered_words(text: str | None) -> list[bytes]:
    """Words between white space, A-Z in lower case."""
    return as_bytes(text).lower().split()


def alnum_words(text: str | None) -> list[bytes]:
    """Words of ASCII letters and digits and all other characters from U+0080 on, A-Z in lower case."""
    return as_bytes(text).translate(_ALNUM).lower().split()


class WordHashes(dict):
    """64-bit hashes of words, kept for words already seen up to a bound."""

    def __init__(self, bound: int = 100_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.bound:
            self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit murmur hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, from the words' hashes; with fewer words, of the whole sequence."""
    n = len(words)
    size = min(size, n)
    if not n:
        return words
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : n - size + 1 + k]
        out ^= out >> np.uint64(32)
    return mixed(out)
