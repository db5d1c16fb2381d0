"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

An item's windows are its runs of ``WINDOW`` words (one shorter run for a shorter item). A
window is found in a document only if all its shingles (pairs of neighbouring words; the word
of a one-word item) are there, so its necessary prefix is its rarest shingle, by counts over all
documents. Shingles of documents join these prefix shingles; the place of the shingle in the
window gives the only possible start, which must leave room for the whole window inside the
document; then all words are compared.

The benchmark is a query set. Its words go to the executors as numbers in flat arrays, windows as
places in them, so a window takes some 40 bytes. A block has at most ``BLOCK_WINDOWS`` windows,
but for a single longer item; a larger benchmark takes several passes, one block each, of which
the driver holds one at a time.

Defined cases: a null or empty text has no words and is never contaminated; a null or
wordless item has no window; a null item_id marks words but is not listed; repeated items
are listed once, repeated documents are judged each; an empty table gives none (documents)
or no hits (benchmark); other columns are ignored, or kept as they are by ``keep_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackline.llm.staging import staged
from stackline.llm.words import alnum_words, mixed

WINDOW = 13
BLOCK_WINDOWS = 1_000_000
#: Window starts compared at a time.
CANDIDATES = 200_000
N_WORDS, N_HIT, HITS, ITEMS = "__decontaminate_words", "__decontaminate_hit", "__decontaminate_mask", "__decontaminate_items"


class Windows:
    """Windows of a block of items as places in flat arrays, and which document shingles to look at."""

    def __init__(self, rows: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.word_ids: dict[bytes, int] = {}
        self.items = [item for item, _ in rows]
        words = [np.fromiter((self.word_ids.setdefault(w, len(self.word_ids) + 1) for w in alnum_words(text)), np.int32) for _, text in rows]
        self.flat = np.concatenate([np.zeros(0, np.int32), *words])
        lengths = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(lengths) - lengths
        # Codes of neighbouring words, sorted; across two items too, which no window takes.
        self.base = len(self.word_ids) + 1
        self.pairs, pair_at = np.unique(self.flat[:-1].astype(np.int64) * self.base + self.flat[1:], return_inverse=True)
        self.pair_at = pair_at.astype(np.int32)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        size_of = np.minimum(lengths, window)
        for size in np.unique(size_of[size_of > 0]):
            of = np.flatnonzero(size_of == size)
            each = lengths[of] - size + 1
            start = np.repeat(first[of] - np.cumsum(each) + each, each) + np.arange(each.sum())
            self.by_size[int(size)] = self._distinct(start, np.repeat(of, each).astype(np.int32), int(size))

    def _distinct(self, start: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of different windows, and the items of each: owners from one bound to the next."""
        code = np.zeros(len(start), np.uint64)
        for k in range(size):
            code = mixed(code + self.flat[start + k].astype(np.uint64))
        order = np.argsort(code, kind="stable")
        start, owner, code = start[order], owner[order], code[order]
        same = code[1:] == code[:-1]
        for k in range(size):  # codes alone don't make windows equal
            same &= self.flat[start[1:] + k] == self.flat[start[:-1] + k]
        bounds = np.flatnonzero(np.concatenate(([True], ~same, [True])))
        return start[bounds[:-1]].astype(np.int32), owner, bounds.astype(np.int32)

    def order(self, counts: np.ndarray) -> None:
        """Index each window by its rarest shingle; ties by shingle number. counts: by pair number, over all documents."""
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
        self.index = {}
        for size, (start, _, _) in self.by_size.items():
            offset, keys, n = np.zeros(len(start), np.int16), self.flat, self.base
            if size > 1:
                keys, n = self.pair_at, len(self.pairs)
                lowest = rank[keys[start]]
                for k in range(1, size - 1):
                    other = rank[keys[start + k]]
                    offset[other < lowest] = k
                    lowest = np.minimum(lowest, other)
            prefix = keys[start + offset]
            at = np.argsort(prefix, kind="stable").astype(np.int32)
            self.index[size] = (at, offset[at], np.searchsorted(prefix[at], np.arange(n + 1)).astype(np.int32))

    def ids(self, text: str | None) -> np.ndarray:
        words = alnum_words(text)
        return np.fromiter((self.word_ids.get(w, 0) for w in words), np.int32, len(words))

    def shingles(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that start a pair of the block, and the pairs' numbers."""
        places = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        codes = ids[places].astype(np.int64) * self.base + ids[places + 1]
        found = np.searchsorted(self.pairs, codes)
        known = self.pairs[np.minimum(found, max(0, len(self.pairs) - 1))] == codes if len(self.pairs) else np.zeros(len(codes), bool)
        return places[known], found[known]

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Which words are inside an occurring window, and the items of these windows."""
        n, edges, items = len(ids), np.zeros(len(ids) + 1, np.int64), set()
        pairs = self.shingles(ids)
        for size, (at, offset, first) in self.index.items():
            starts, owner, bounds = self.by_size[size]
            places, keys = pairs if size > 1 else (np.flatnonzero(ids), ids[ids > 0])
            each = first[keys + 1] - first[keys]
            places, keys, each = places[each > 0], keys[each > 0], each[each > 0]
            total = np.cumsum(each, dtype=np.int64)
            for part in np.split(np.arange(len(places)), np.searchsorted(total, np.arange(CANDIDATES, total[-1], CANDIDATES))) if len(places) else ():
                many = each[part]
                row = np.repeat(first[keys[part]] - np.cumsum(many) + many, many) + np.arange(many.sum())
                start = np.repeat(places[part], many) - offset[row]
                fits = (start >= 0) & (start + size <= n)
                row, start = at[row[fits]], start[fits]
                for k in range(size):
                    same = ids[start + k] == self.flat[starts[row] + k]
                    row, start = row[same], start[same]
                np.add.at(edges, start, 1)
                np.add.at(edges, start + size, -1)
                for w in np.unique(row):
                    items.update(self.items[i] for i in owner[bounds[w] : bounds[w + 1]])
        items.discard(None)
        return np.cumsum(edges[:-1]) > 0, items


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, limit: int) -> tuple[int, Iterator[Windows]]:
    """The number of blocks, and the blocks one at a time; repeated items are there once."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null").distinct()
    # a word takes two bytes or more with what parts it from the next
    most = items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    blocks = int(most // limit) + 1

    def read() -> Iterator[Windows]:
        for k in range(blocks):
            part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else items
            yield Windows([(r[0], r[1]) for r in part.collect()], window)  # about ``limit`` windows at most

    return blocks, read()


def _counts(documents: DataFrame, windows: Windows, text_col: str) -> np.ndarray:
    """How often the block's pairs of words are in all documents, by pair number."""
    kept = documents.sparkSession.sparkContext.broadcast(windows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept.value
        total = np.zeros(len(known.pairs), np.int64)
        for b in batches:
            for x in b.column(0):
                np.add.at(total, known.shingles(known.ids(x.as_py()))[1], 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["pair", "n"])

    out = np.zeros(len(windows.pairs), np.int64)
    for pair, n in documents.select(text_col).mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n")).toLocalIterator():  # at most as many rows as the block has pairs
        out[pair] = n
    kept.unpersist()
    return out


def marked(documents: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, limit: int = BLOCK_WINDOWS) -> DataFrame:
    """The columns ``keep`` with the figures N_WORDS, N_HIT and ITEMS of each row."""
    blocks, found = _blocks(benchmark, item_col, item_text, window, limit)
    columns = list(dict.fromkeys([*keep, text_col]))
    out = documents.select(columns)
    for k, windows in enumerate(found):
        windows.order(_counts(documents, windows, text_col))
        last = k + 1 == blocks
        out = _passed(out, windows, keep if last else columns, text_col, k == 0)
        if not last:
            out = staged(out, "decontaminate")
    return out.drop(HITS)


def _passed(df: DataFrame, windows: Windows, keep: list[str], text_col: str, first: bool) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(windows)
    at, places = df.columns.index(text_col), [df.columns.index(c) for c in keep]
    added = [(N_WORDS, T.LongType(), pa.int64()), (N_HIT, T.LongType(), pa.int64()), (HITS, T.BinaryType(), pa.binary()), (ITEMS, T.ArrayType(T.StringType()), pa.list_(pa.string()))]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            rows = []
            for i, x in enumerate(b.column(at)):
                ids = known.ids(x.as_py())
                hit, items = known.find(ids)
                if not first:
                    before = np.frombuffer(b.column(HITS)[i].as_py(), np.uint8)
                    hit |= np.unpackbits(before, count=len(ids)).astype(bool)
                    items |= set(b.column(ITEMS)[i].as_py())
                rows.append((len(ids), int(hit.sum()), np.packbits(hit).tobytes(), sorted(items)))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*(b.column(p) for p in places), *(pa.array(c, kind) for c, (_, _, kind) in zip(cols, added, strict=True))], names=[*keep, *(name for name, _, _ in added)])

    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(name, kind) for name, kind, _ in added)])
    return df.mapInArrow(find, schema)


def contaminated() -> Column:
    """A document word in twenty or more is inside an item's window."""
    return (F.col(N_HIT) > 0) & (20 * F.col(N_HIT) >= F.col(N_WORDS))


def contamination_report(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    found = marked(documents, benchmark, [id_col])
    return found.select(
        F.col(id_col).alias("doc_id"),
        F.col(N_WORDS).alias("n_words"),
        F.col(N_HIT).alias("n_hit"),
        F.size(ITEMS).cast("long").alias("n_items"),
        F.sha2(F.array_join(ITEMS, ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def keep_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that aren't contaminated, with all their columns."""
    return marked(documents, benchmark, documents.columns).where(~contaminated()).drop(N_WORDS, N_HIT, ITEMS)
