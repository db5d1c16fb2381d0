"""Token ids and offsets of whole texts from a byte-level BPE file, by chunks that can't merge.

The file's pre-tokeniser never joins a character that isn't white space to white space after
it. So a text parts before each space that follows such a character, and its tokens are those
of its chunks, one after the other. Chunks recur, so most are looked up.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

#: Chunks kept in each worker.
KEPT = 200_000
_CUT = re.compile(r"(?<=\S)(?= )")


class _Irregular(Exception):
    """A chunk that ends in white space and isn't the last."""


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class _Chunks(dict):
    """What the tokenizer makes of a chunk, as bytes; filled as chunks turn up."""

    def __init__(self, path: str, kept: int = KEPT):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        self.tokenizer.encode_special_tokens = True
        self.written = dict(enumerate(byte_characters()))

    def __missing__(self, chunk: str) -> bytes:
        if not chunk[-1:].strip():
            raise _Irregular
        # A comma or full stop after a letter is a token of its own.
        value = self.marked(chunk) if chunk[-1] in ",." and chunk[-2:-1].isalpha() else self.encoded(chunk)
        if len(self) < self.kept:
            self[chunk] = value
        return value

    def encoded(self, chunk: str) -> bytes:
        raise NotImplementedError

    def marked(self, chunk: str) -> bytes:
        raise NotImplementedError

    def of_chunks(self, text: str) -> tuple[list[str], list[bytes]]:
        """The chunks of a text, and what the tokenizer makes of each."""
        if "\0" in text:
            before, *parts = text.split(" ")
            chunks = [before, *(" " + p for p in parts)]
        else:  # the same, without a step for each word
            chunks = text.replace(" ", "\0 ").split("\0")
        first, more = chunks[0], len(chunks) > 1
        try:
            head = self.encoded(first) if not more or not first else self[first]
            if not more:
                return chunks, [head]
            return chunks, [head, *map(self.__getitem__, chunks[1:-1]), self.encoded(chunks[-1])]
        except _Irregular:
            chunks = _CUT.split(text)
            return chunks, list(map(self.encoded, chunks))


class ChunkTokens(_Chunks):
    """Little-endian 32-bit ids by chunk."""

    @classmethod
    @lru_cache(maxsize=4)
    def of(cls, path: str, kept: int = KEPT) -> ChunkTokens:
        return cls(path, kept)

    def encoded(self, chunk: str) -> bytes:
        if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):  # one pre-token
            found = [t.id for t in self.tokenizer.model.tokenize(chunk.encode().decode("latin-1").translate(self.written))]
        else:
            found = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return array("I", found).tobytes()

    def marked(self, chunk: str) -> bytes:
        return self[chunk[:-1]] + self[chunk[-1]]

    def ids(self, texts: Iterable) -> Iterator[bytes]:
        """Ids of each text as bytes; of null, none."""
        for x in texts:
            text = x.as_py() if hasattr(x, "as_py") else x
            yield b"".join(self.of_chunks(text)[1]) if text else b""


class ChunkOffsets(_Chunks):
    """Token starts and ends, in code points from the chunk's first, by chunk."""

    @classmethod
    @lru_cache(maxsize=4)
    def of(cls, path: str) -> ChunkOffsets:
        return cls(path)

    def encoded(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).offsets, "<i4").tobytes()

    def marked(self, chunk: str) -> bytes:
        return self[chunk[:-1]] + np.array([len(chunk) - 1, len(chunk)], "<i4").tobytes()

    def of_text(self, text: str) -> np.ndarray:
        """Rows (start, end) of the text's tokens."""
        chunks, spans = self.of_chunks(text)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        counts = np.fromiter(map(len, spans), np.int64, len(spans)) // 8
        found = np.frombuffer(b"".join(spans), "<i4").reshape(-1, 2).astype(np.int64)
        return found + np.repeat(np.cumsum(sizes) - sizes, counts)[:, None]
