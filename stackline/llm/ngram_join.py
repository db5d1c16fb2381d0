"""N-gram Jaccard self-join of documents by PartEnum signatures.

Documents of equal shingle sets are one class; only classes are compared. Two sets whose
Jaccard similarity is at least the threshold have sizes within a factor and differ in at
most k shingles, where k follows from their sizes. For each band of sizes the domain of
shingles is dealt into parts, and each part into ``SECOND`` smaller ones. The signatures of a set
are what it holds of each subset of ``SECOND - SPOILED`` smaller parts of a part, as far as that isn't
empty. A differing shingle spoils the subsets that its smaller part is in, c of them, so sets that
link differ in at most k c signatures; with any common order of signatures they share one of
their first k c + 1. The order is that of a sketch of all shingles' frequencies, rarest first, so that
common passages are not compared. The few sets with no more than k c signatures also give each
shingle as a signature. Bands of larger sets have parts that aren't divided further (one subset, the
whole part): there two of three smaller parts need 2 k + 1 signatures for k + 1, by counting beyond
the disk that the join may use.

The sketch is a count-min sketch of two rows, as wide as the number of shingles asks for, up to a bound
for what is sent to executors. What chance adds to each counter on average is taken off, so that beyond
the bound rare shingles still count as rare, and only groups that are large indeed are dealt out.

In each group of sets with a signature in common, all are compared with the one whose
shingles are most common; links so found make components. Where a group still holds several
components, the pairs across them are compared too, in blocks of bounded size. So no link between
components is lost. Whole sets are read again from their texts and compared only for pairs that an exact bound
lets pass: each set has a histogram of its shingles, whose counters are kept modulo 16; the distances of two sets'
counters, taken the shorter way round, never add up to more than the shingles that differ.

Links are counted where asked for: as no link leaves a component, all pairs of its classes are
compared, in blocks of bounded size, and only the sums by class leave a task.

Defined cases: a null or empty text, or one without words, has an empty set and links with
nothing; fewer words than a shingle give one shingle; repeated rows are of one class, and so
of one component; a null doc_id takes part in no link and has a null component; an empty table gives
none; other columns are ignored, or kept as they are
by ``keep_one``.

Shingles are compared by 64-bit hashes. Classes have a 64-bit key and a second, independent hash
of the set: should keys of different sets ever be equal, which this shows, another seed is used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackline.llm.components import components
from stackline.llm.staging import removed, staged
from stackline.llm.words import WordHashes, lowered_words, mixed, shingle_hashes

SIZE = 5
#: Similarity in hundredths.
THRESHOLD = 75
#: Counters in a row of the frequency sketch at least and at most, as powers of 2; rows; slices of a row.
SKETCH_BITS, SKETCH_MOST, SKETCH_ROWS, SLICES = 20, 23, 2, 32
#: Shingles for each counter that a wider row is taken for, and bytes of text that make a shingle, about.
SKETCH_LOAD, SHINGLE_BYTES = 96, 6
#: Ratio of a band's bounds, and smallest parts for each shingle of its largest set.
BAND, PARTS = 4, 0.6
#: Smaller parts of a part, of which a subset leaves out some; in bands whose largest set has at most so many shingles.
SECOND, SPOILED, SUBSETS_UP_TO = 3, 1, 64
#: A signature expected in more sets than this is dealt over hashed groups.
GROUP = 20_000
#: Sets of a block where pairs across components are compared.
BLOCK = 1_500
#: Sets, and their shingles together, of a block where a component's links are counted.
LINK_BLOCK, LINK_SHINGLES = 1_000, 1_000_000
#: Pairs looked at together.
PAIRS = 200_000
#: Counters of a set's histogram, of four bits each, and how many are added for a first look.
HISTOGRAM, FOLD = 512, 4
#: Rows of ids that are sent to all executors at most (8 bytes each, or 16 with the class).
SENT_IDS = 2_000_000
_WORDS = WordHashes()


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles."""
    u = shingle_hashes(_WORDS.array(lowered_words(text)), size)
    u.sort()
    return u[np.concatenate(([True], u[1:] != u[:-1]))] if len(u) else u


def set_key(u: np.ndarray, seed: int) -> tuple[int, int]:
    data = u.tobytes()
    return tuple(int(np.int64(np.uint64(x))) if x < 1 << 63 else x - (1 << 64) for x in (xxhash.xxh3_64_intdigest(data, seed), xxhash.xxh64_intdigest(data, seed)))


def slots(u: np.ndarray, bits: int = SKETCH_BITS, row: int = 0) -> np.ndarray:
    return ((u >> np.uint64(64 - bits - 24 * row)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def commonness(u: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How common each shingle is by the sketch (``_sketch``): the least of its counters."""
    rows = np.atleast_2d(counts)
    bits = rows.shape[1].bit_length() - 1
    out = rows[0][slots(u, bits)]
    for r in range(1, len(rows)):
        out = np.minimum(out, rows[r][slots(u, bits, r)])
    return out


def sets_with(common: np.ndarray) -> np.ndarray:
    """How many sets a shingle of this commonness is expected in."""
    return (np.exp2(common / 8) - 1).astype(np.int64)


def most_different(a: int, b: int, threshold: int = THRESHOLD) -> int:
    """Shingles in one of two sets only, at most, for sets of these sizes that link."""
    # 100 i >= t (a + b - i), so i >= t (a + b) / (100 + t), and a + b - 2 i differ
    return a + b - 2 * -(-threshold * (a + b) // (100 + threshold))


def signatures(u: np.ndarray, counts: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, float]:
    """A set's signatures, how common the rarest shingle in each is, and how common the set's shingles are on average."""
    n = len(u)
    largest = 100 * n // threshold
    k = (n + largest) * (100 - threshold) // (100 + threshold)  # no partner differs in more
    if k < 1:  # only equal sets link
        return u[:0], u[:0].astype(np.int64), 0.0
    band = 0
    while BAND ** (band + 1) <= n:
        band += 1
    often = commonness(u, counts).astype(np.int64)
    out, common = [], []
    for tag in (band, band + 1) if largest >= BAND ** (band + 1) else (band,):
        second, spoiled = (SECOND, SPOILED) if BAND ** (tag + 1) <= SUBSETS_UP_TO else (1, 0)
        m = mixed(u + np.uint64(7919 * tag + 1))
        parts = int(PARTS * BAND ** (tag + 1)) // second + 1
        small = ((m >> np.uint64(32)) * np.uint64(parts * second)) >> np.uint64(32)
        order = np.argsort(small)
        small, m, f = small[order], m[order], often[order]
        sigs, rare, turns = [], [], small % np.uint64(second) if spoiled else None
        for which, subset in enumerate(combinations(range(second), second - spoiled)):
            part, held, of = small, m, f
            if spoiled:
                inside = np.logical_or.reduce([turns == np.uint64(j) for j in subset])
                part, held, of = small[inside] // np.uint64(second), m[inside], f[inside]
                if not len(part):
                    continue
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            sigs.append(mixed(np.add.reduceat(held, first) + (part[first] * np.uint64(8) + np.uint64(which)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(tag)))
            rare.append(np.minimum.reduceat(of, first))
        sig, of = np.concatenate(sigs), np.concatenate(rare)
        most = k * comb(second - 1, second - spoiled - 1)  # signatures that a partner doesn't have
        # rarest first, then by the signature's upper bits; all that tie with the last are taken
        order_key = (np.minimum(of, (1 << 20) - 1).astype(np.uint64) << np.uint64(44)) | (sig >> np.uint64(20))
        chosen = order_key <= np.partition(order_key, most)[most] if len(sig) > most else np.ones(len(sig), bool)
        out.append(sig[chosen])
        common.append(of[chosen])
        if len(sig) <= most:
            out.append(mixed(m + np.uint64(104729 * tag + 2)))
            common.append(f)
    return np.concatenate(out), np.concatenate(common), float(often.mean())


def histogram(u: np.ndarray) -> np.ndarray:
    """Counters whose absolute differences never add up to more than the shingles that differ."""
    return np.bincount((u & np.uint64(HISTOGRAM - 1)).astype(np.int64), minlength=HISTOGRAM)


def packed(u: np.ndarray) -> bytes:
    """A set's histogram modulo 16, two counters in a byte."""
    low, high = np.split((histogram(u) & 15).astype(np.uint8), 2)
    return (low | high << 4).tobytes()


def counters(histograms: list[bytes]) -> np.ndarray:
    """The counters modulo 16 of packed histograms, a row each."""
    pairs = np.frombuffer(b"".join(histograms), np.uint8).reshape(-1, HISTOGRAM // 2)
    return np.concatenate([pairs & 15, pairs >> 4], 1)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row, at most the shingles in one of two sets only: distances of counters modulo 16, the shorter way round."""
    d = (a - b) & 15
    return np.minimum(d, 16 - d).sum(1, dtype=np.int32)


def near(h: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Which of the pairs (x, y) of sets with these counters and sizes may link: first by sums of counters, then by all."""
    sizes = n[x] + n[y]
    most = sizes - 2 * -(-threshold * sizes // (100 + threshold))  # as most_different
    kept = np.arange(len(x))
    for bins in (h.reshape(len(h), -1, FOLD).sum(2, dtype=np.uint8) & 15, h):
        fits = [apart(bins[x[at]], bins[y[at]]) <= most[at] for at in np.split(kept, range(8_000, len(kept), 8_000))]
        kept = kept[np.concatenate(fits)]
    return kept


def links(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= threshold * (len(both) - common)


def sketch_bits(documents: DataFrame) -> int:
    """Width of the sketch's rows for this many shingles, as a power of 2."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(SKETCH_MOST, max(SKETCH_BITS, int(size / SHINGLE_BYTES / SKETCH_LOAD).bit_length()))


def _packed(counts: np.ndarray) -> bytes:
    """Counters in a byte each, and those above it by place."""
    high = np.flatnonzero(counts >= 255)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + high.astype("<u4").tobytes() + counts[high].astype("<u4").tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, width).astype(np.uint64)
    more = np.frombuffer(data, "<u4", offset=width).reshape(2, -1)
    out[more[0]] = more[1]
    return out


def _sets(documents: DataFrame, size: int, seed: int, bits: int) -> DataFrame:
    """A row for each document (doc_id, n, key, check, histogram), and each task's part of the sketch (slice, part, counts)."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sketch = ["doc_id", "n", "key", "check", "histogram", "slice", "part", "counts"], np.zeros((SKETCH_ROWS, 1 << bits), np.uint32)
        kinds, ids = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()], None
        one = np.uint32(1)
        for b in batches:
            ids, n, key, check, counted = b.column(0), [], [], [], []
            for x in b.column(1):
                u = shingle_set(x.as_py(), size)
                for r in range(SKETCH_ROWS):  # in place: no copies as wide as the sketch
                    np.add.at(sketch[r], slots(u, bits, r), one)
                k = set_key(u, seed)
                n.append(len(u)), key.append(k[0]), check.append(k[1]), counted.append(packed(u))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, t) for x, t in zip((n, key, check, counted), kinds, strict=False)), *(pa.nulls(len(n), t) for t in kinds[4:])], names=names)
        if ids is not None:
            part = TaskContext.get().partitionId()
            for k, x in enumerate(np.split(sketch.ravel(), SKETCH_ROWS * SLICES)):
                yield pa.RecordBatch.from_arrays([pa.nulls(1, ids.type), *(pa.nulls(1, t) for t in kinds[:4]), pa.array([k], kinds[4]), pa.array([part], kinds[5]), pa.array([_packed(x)], kinds[6])], names=names)

    return documents.select("doc_id", "text").mapInArrow(read, f"doc_id {kind}, n long, key long, check long, histogram binary, slice int, part int, counts binary")


def _sketch(parts: DataFrame, bits: int) -> np.ndarray:
    """The sum of the tasks' sketches, 64 at a time, then the sums likewise: per row and counter 8 times the logarithm of what
    is above the average that chance gives. A byte each, so two rows are 16 MB at most."""
    width = (1 << bits) // SLICES

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, key = np.zeros(width, np.uint64), None
        for b in batches:
            for data in b.column("counts"):
                total += _unpacked(data.as_py(), width)
            if b.num_rows:
                key = b.column("slice")[0].as_py(), b.column("part")[0].as_py()
        if key is not None:
            data = _packed(np.minimum(total, np.uint64(0xFFFFFFFF)))
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([data], pa.binary())], names=["slice", "part", "counts"])

    most = parts.agg(F.max("part")).first()[0]
    out = np.zeros(SKETCH_ROWS << bits, np.uint8)
    if most is None:
        return out.reshape(SKETCH_ROWS, -1)
    while True:
        most //= 64
        parts = parts.withColumn("part", F.floor(F.col("part") / 64).cast("int")).groupBy("slice", "part").applyInArrow(add, "slice int, part int, counts binary")
        if not most:
            break
    whole = np.zeros(SKETCH_ROWS << bits, np.float64)
    for slot, _, data in parts.collect():  # SKETCH_ROWS * SLICES rows
        whole[slot * width : (slot + 1) * width] = _unpacked(data, width)
    whole = whole.reshape(SKETCH_ROWS, -1)
    above = whole - whole.sum(1, keepdims=True) / whole.shape[1]
    return np.minimum(255, np.rint(8 * np.log2(1 + np.maximum(above, 0)))).astype(np.uint8)


def _signature_rows(documents: DataFrame, counts, size: int, seed: int, threshold: int) -> DataFrame:
    """(sig, salt, key, rank, n), once for each class in a task: rank tells how common a set's shingles are."""

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]

    def batch(cols: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(cols, kinds, strict=True)], names=["sig", "salt", "key", "rank", "n"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = counts.value, set()
        for b in batches:
            cols: list[list[np.ndarray]] = [[np.zeros(0, k.to_pandas_dtype())] for k in kinds]
            rows = 0
            for x in b.column(0):
                u = shingle_set(x.as_py(), size)
                k = set_key(u, seed)[0]
                if k in seen:
                    continue
                seen.add(k)
                s, common, mean = signatures(u, known, threshold)
                if not len(s):
                    continue
                expected = sets_with(common)
                salt = np.int64(k & 0xFFFFFF) % (expected // GROUP + 1) + (expected >= GROUP)
                rank = int(100 * mean)
                found = (s.view(np.int64), salt.astype(np.int32), np.full(len(s), k, np.int64), np.full(len(s), rank, np.int32), np.full(len(s), len(u), np.int32))
                for col, value in zip(cols, found, strict=True):
                    col.append(value)
                rows += len(s)
                if rows > 100_000:
                    yield batch(cols)
                    cols, rows = [[c[0]] for c in cols], 0
            yield batch(cols)

    return documents.select("text").mapInArrow(read, "sig long, salt int, key long, rank int, n int")


def _groups(rows: DataFrame) -> DataFrame:
    """Rows of sets that share a signature with another set, with their group's center; repeated rows once.

    Rows come sorted by group and are read in a stream; a group that spans batches is held.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            table = np.stack([np.asarray(c).astype(np.int64) for c in b.columns], 1)
            if held is not None:
                table = np.concatenate([held, table])
            if not len(table):
                continue
            last = (table[:, :2] == table[-1, :2]).all(1).argmax()
            held = table[last:]
            if last:
                yield from grouped(table[:last])
        if held is not None:
            yield from grouped(held)

    def grouped(t: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.concatenate(([True], (t[1:, :3] != t[:-1, :3]).any(1)))  # sorted by sig, salt, key
        t = t[new]
        first = np.flatnonzero(np.concatenate(([True], (t[1:, :2] != t[:-1, :2]).any(1))))
        sizes = np.diff(np.concatenate((first, [len(t)])))
        # the most common set is the center; of these, the last by key
        top = np.maximum.reduceat(t[:, 3], first)
        place = np.where(t[:, 3] == np.repeat(top, sizes), np.arange(len(t)), -1)
        center = np.maximum.reduceat(place, first)
        wanted = np.repeat((sizes > 1) | (t[first, 1] > 0), sizes)
        to = t[np.repeat(center, sizes)[wanted]]
        cols = [*t[wanted].T, to[:, 2], to[:, 4]]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(kind.to_pandas_dtype()), kind) for c, kind in zip(cols, kinds, strict=True)], names=["sig", "salt", "key", "rank", "n", "center", "center_n"])

    sent = rows.repartition("sig", "salt").sortWithinPartitions("sig", "salt", "key")
    return sent.mapInArrow(read, "sig long, salt int, key long, rank int, n int, center long, center_n int")


def _fits(a: str, b: str, threshold: int):
    """Whether sizes allow a link."""
    return (F.col(a) * 100 >= F.col(b) * threshold) & (F.col(b) * 100 >= F.col(a) * threshold)


def _near(pairs: DataFrame, histograms: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that their histograms allow to link."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.arange(b.num_rows)
            h = counters([*b.column(3).to_pylist(), *b.column(5).to_pylist()])
            n = np.concatenate([np.asarray(b.column(2)), np.asarray(b.column(4))])
            kept = b.take(pa.array(near(h, n, rows, rows + b.num_rows, threshold)))
            yield pa.RecordBatch.from_arrays(kept.columns[:2], names=["a", "b"])

    one, other = (histograms.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("histogram").alias(f"histogram_{x}")) for x in ("a", "b"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "n_a", "histogram_a", "n_b", "histogram_b").mapInArrow(look, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of linked sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask = [links(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), threshold) for x, y in zip(b.column(2), b.column(3), strict=True)]
            kept = b.filter(pa.array(mask, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[:2], names=["a", "b"])

    one, other = sets.select(F.col("key").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("key").alias("b"), F.col("set").alias("set_b"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "set_a", "set_b").mapInArrow(check, "a long, b long")


def _across(groups: DataFrame, labels: DataFrame, histograms: Callable[[DataFrame], DataFrame], threshold: int) -> DataFrame:
    """Pairs in one group but different components that the bounds allow."""
    of = F.coalesce("component", "key").alias("component")
    rows = staged(groups.join(labels, "key", "left").select("sig", "key", "n", "center", of), "open")
    # In a group of two, both were compared. Of groups with the same sets one is enough.
    same = [F.bit_xor(F.xxhash64("key")), F.sum(F.xxhash64("key", F.lit(1)) % (1 << 40))]
    several = rows.groupBy("sig").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("size"), *(x.alias(f"same{k}") for k, x in enumerate(same)))
    several = several.where("least <> most and size > 2").groupBy("size", "same0", "same1").agg(F.min("sig").alias("sig"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    # Each row goes to the pairs of blocks that its own is in.
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    dealt = rows.join(several.select("sig", blocks.alias("blocks")), "sig").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "n", "center", "component")
    dealt = staged(dealt, "dealt")
    dealt = dealt.join(histograms(dealt.select("key")).select("key", "histogram"), "key")
    names = ["sig", "i", "j", "own", "key", "n", "center", "component", "histogram"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = np.stack([np.asarray(c).astype(np.int64) for c in b.columns[:8]], 1)
            h = np.frombuffer(b"".join(b.column(8).to_pylist()), np.uint8).reshape(-1, HISTOGRAM // 2)
            if held is not None:
                t, h = np.concatenate([held[0], t]), np.concatenate([held[1], h])
            if not len(t):
                continue
            last = (t[:, :3] == t[-1, :3]).all(1).argmax()
            held = t[last:], h[last:]
            yield from compared(t[:last], h[:last])
        if held is not None:
            yield from compared(*held)

    def compared(t: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(t):
            return
        first = np.flatnonzero(np.concatenate(([True], (t[1:, :3] != t[:-1, :3]).any(1))))
        ends = np.repeat(np.append(first[1:], len(t)), np.diff(np.append(first, len(t))))
        later = ends - np.arange(len(t)) - 1  # rows of the group after each
        h, total = counters([h.tobytes()]), np.cumsum(later)
        for rows in np.split(np.arange(len(t)), np.searchsorted(total, np.arange(PAIRS, total[-1], PAIRS))):
            x = np.repeat(rows, later[rows])
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(later[rows]) - later[rows], later[rows])
            a, b = t[x], t[y]
            fits = (a[:, 7] != b[:, 7]) & (100 * a[:, 5] >= threshold * b[:, 5]) & (100 * b[:, 5] >= threshold * a[:, 5])
            fits &= (a[:, 4] != b[:, 6]) & (b[:, 4] != a[:, 6])  # else compared before
            fits &= (a[:, 1] == a[:, 2]) | (a[:, 3] != b[:, 3])  # within a block, or across two
            x, y = x[fits], y[fits]
            kept = near(h, t[:, 5], x, y, threshold)
            found = np.unique(np.sort(np.stack([t[x[kept], 4], t[y[kept], 4]], 1), 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    sent = dealt.select(names).repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return sent.mapInArrow(read, "a long, b long").distinct()


def _by_size(ids: DataFrame) -> DataFrame:
    """A staged table of ids, to be sent to all executors only up to SENT_IDS rows."""
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def _kept_texts(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is in ``ids``, a staged table."""
    return documents.join(_by_size(ids), "doc_id", "left_semi")


def classes(documents: DataFrame, size: int = SIZE, threshold: int = THRESHOLD, seed: int = 0) -> tuple[DataFrame, DataFrame, int]:
    """Documents with their class (doc_id, n, key), classes with their component (key, rep, component_id, leads: whether it is the component's first class), and the seed of the keys."""
    spark: SparkSession = documents.sparkSession
    documents = documents.select("doc_id", "text")
    with_id = documents.where("doc_id is not null")
    bits = sketch_bits(documents)
    read = staged(_sets(documents, size, seed, bits), "sets")
    rows = read.where("slice is null").select("doc_id", "n", "key", "check")
    found = rows.where("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("check").alias("c"), F.max("check").alias("d"), F.max("n").alias("n"))
    found = staged(found, "classes")
    if found.where("c <> d").limit(1).count():
        return classes(documents, size, threshold, seed + 1)
    counts = spark.sparkContext.broadcast(_sketch(read.where("slice is not null").select("slice", "part", "counts"), bits))
    # Copies give no signatures of their own; beyond SENT_IDS classes only those of one task are left out, as texts would have to be shuffled.
    reps = staged(found.where("n > 0").select(F.col("rep").alias("doc_id")).distinct(), "reps")
    signed = _kept_texts(with_id, reps) if reps.count() <= SENT_IDS else with_id
    groups = staged(_groups(_signature_rows(signed, counts, size, seed, threshold)), "groups")

    def histograms(keys: DataFrame) -> DataFrame:
        """(key, n, histogram) of these classes only; repeated rows of a document bring theirs once."""
        counted = read.where("slice is null").select("doc_id", "key", "n", "histogram")
        wanted = staged(keys.distinct().join(found, "key").select(F.col("rep").alias("doc_id"), "key"), "wanted")
        return counted.join(_by_size(wanted), ["doc_id", "key"]).groupBy("key").agg(F.first("n").alias("n"), F.first("histogram").alias("histogram"))

    def sides(of: DataFrame) -> DataFrame:
        return of.select(F.col("a").alias("key")).union(of.select("b"))

    def verified(candidates: DataFrame) -> DataFrame:
        """The candidates that are links, by whole sets, which are read again from the texts of these classes only."""
        ids = staged(sides(candidates).distinct().join(found, "key").select(F.col("rep").alias("doc_id")), "ids")
        sets = _set_rows(_kept_texts(with_id, ids), size, seed)
        out = staged(_verified(candidates, sets, threshold), "links")
        removed(spark, sets)
        return out

    # A salted group's centers are compared with the first of them by rank.
    top = groups.where("salt > 0 and key = center").groupBy("sig").agg(F.max(F.struct("rank", "key", "n")).alias("top"))
    over = groups.where("salt > 0 and key = center").join(top, "sig").select("key", "n", F.col("top.key").alias("center"), F.col("top.n").alias("center_n"))
    pairs = groups.select("key", "n", "center", "center_n").union(over).where(F.col("key") != F.col("center")).where(_fits("n", "center_n", threshold))
    pairs = staged(pairs.select(F.least("key", "center").alias("a"), F.greatest("key", "center").alias("b")).distinct(), "pairs")
    fitting = staged(_near(pairs, histograms(sides(pairs)), threshold), "fitting")
    linked = verified(fitting)
    labels = components(linked)
    across = staged(_across(groups, labels, histograms, threshold), "across")
    more = verified(across)
    if more.limit(1).count():
        labels = components(linked.union(more))
    for table in (groups, pairs, fitting, across):
        removed(spark, table)
    # A component's first class is that of the least document, of equal ones the least class.
    first = labels.join(found, "key").groupBy("component").agg(F.min(F.struct("rep", "key")).alias("first"))
    joined = labels.join(first, "component").select("key", "first")
    out = found.where("n > 0").join(joined, "key", "left").select("key", "rep", F.coalesce("first.rep", "rep").alias("component_id"), F.coalesce(F.col("first.key") == F.col("key"), F.lit(True)).alias("leads"))
    return rows, staged(out, "components"), seed


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Shingles in common of each set in ``a`` and each in ``b``; exact."""
    out = np.zeros((len(a), len(b)), np.float32)
    # Only shingles of more than one set count, a slice of them at a time.
    every, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    shared = np.bincount(at, minlength=len(every)) > 1
    place = (np.cumsum(shared) - 1)[at]
    row = np.repeat(np.arange(len(a) + len(b)), [len(u) for u in (*a, *b)])[shared[at]]
    place = place[shared[at]]
    order = np.argsort(place)
    row, place = row[order], place[order]
    width = 4096
    for start in range(0, int(shared.sum()), width):
        low, high = np.searchsorted(place, [start, start + width])
        x = np.zeros((len(a) + len(b), min(width, int(shared.sum()) - start)), np.float32)
        x[row[low:high], place[low:high] - start] = 1
        out += x[: len(a)] @ x[len(a) :].T
    return out.astype(np.int64)


def _link_counts(rows: DataFrame, found: DataFrame, sets: Callable[[DataFrame], DataFrame], threshold: int) -> DataFrame:
    """(key, n_links): for each class, the documents that a document of it links with, itself not counted."""
    copies = rows.where("doc_id is not null and n > 0").groupBy("key").agg(F.countDistinct("doc_id").alias("copies"), F.max("n").alias("n"))
    members = staged(found.select("key", "rep", F.xxhash64("component_id").alias("component")).join(copies, "key"), "members")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / LINK_BLOCK, F.sum("n") / LINK_SHINGLES)).cast("int").alias("blocks")
    several = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), blocks).where("size > 1")
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    dealt = staged(members.join(several, "component").withColumn("own", own), "dealt")
    texts = sets(dealt.select(F.col("rep").alias("doc_id")))
    # Each set goes to the pairs of blocks that its own is in.
    dealt = dealt.join(texts, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "copies", "set")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for b in batches:
            t = np.stack([np.asarray(c).astype(np.int64) for c in b.columns[:6]], 1)
            for x, data in zip(t, b.column(6), strict=True):
                if group is not None and (x[:3] != group).any():
                    yield counted(held)
                    held = []
                group = x[:3]
                held.append((x, np.frombuffer(data.as_py(), np.uint64)))
        if held:
            yield counted(held)

    def counted(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        t, u = np.stack([x for x, _ in held]), [s for _, s in held]
        n = np.array([len(x) for x in u])
        one, other = np.flatnonzero(t[:, 3] == t[:, 1]), np.flatnonzero(t[:, 3] == t[:, 2])
        common = common_counts([u[k] for k in one], [u[k] for k in other]) if len(one) and len(other) else np.zeros((len(one), len(other)), np.int64)
        linked = 100 * common >= threshold * (n[one][:, None] + n[other][None] - common)
        linked &= one[:, None] != other[None]
        total = np.zeros(len(t), np.int64)
        total[one] += linked @ t[other, 5]
        if t[0, 1] != t[0, 2]:
            total[other] += t[one, 5] @ linked
        return pa.RecordBatch.from_arrays([pa.array(t[:, 4]), pa.array(total)], names=["key", "more"])

    sent = dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    more = sent.mapInArrow(read, "key long, more long").groupBy("key").agg(F.sum("more").alias("more"))
    return members.join(more, "key", "left").select("key", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))


def _set_rows(documents: DataFrame, size: int, seed: int) -> DataFrame:
    """(key, set) of each document; repeated documents once."""

    def batch(found: dict[int, np.ndarray]) -> pa.RecordBatch:
        data = [u.tobytes() for u in found.values()]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(data, pa.binary())], names=["key", "set"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[int, np.ndarray] = {}
            held = 0
            for x in b.column(0):
                u = shingle_set(x.as_py(), size)
                found[set_key(u, seed)[0]] = u
                held += len(u)
                if held > 500_000:
                    yield batch(found)
                    found, held = {}, 0
            yield batch(found)

    out = staged(documents.select("text").mapInArrow(read, "key long, set binary"), "linkable")
    # A document id that is there twice brings its set twice: rare, and seen from the keys alone.
    if out.groupBy("key").count().where("count > 1").limit(1).count():
        out = staged(out.dropDuplicates(["key"]), "linkable")
    return out


def document_components(documents: DataFrame, size: int = SIZE, threshold: int = THRESHOLD, links: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of each document.

    With ``links`` also n_links, the other documents that it links with; repeated rows of a text are one.
    """
    rows, found, seed = classes(documents, size, threshold)
    counts = []
    if links:

        def sets(ids: DataFrame) -> DataFrame:
            return _set_rows(_kept_texts(documents.select("doc_id", "text").where("doc_id is not null"), staged(ids.distinct(), "ids")), size, seed)

        found = staged(found.join(_link_counts(rows, found, sets, threshold), "key", "left"), "counted")
        counts = [F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("n_links")).otherwise(F.lit(0)).alias("n_links")]
    # Both sides are scans with an exchange, so the adaptive join splits the rows of a frequent class.
    joined = rows.join(found, "key", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *counts)


def keep_one(documents: DataFrame, size: int = SIZE, threshold: int = THRESHOLD) -> DataFrame:
    """One row of each component, with all its columns: of its least doc_id, and where that has several texts in it, of the least class.

    Rows that link with nothing stay, also where another row has their doc_id; so do rows without words or without a doc_id.
    """
    id_of, verdict, key_of = "__ngram_join_id", "__ngram_join_stays", "__ngram_join_key"
    rows, found, seed = classes(documents, size, threshold)
    stays = (F.col("n") == 0) | (F.col("leads") & (F.col("doc_id") == F.col("rep")))
    told = rows.where("doc_id is not null").join(found, "key", "left").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"), F.max(stays).alias("stays"))
    told = staged(told, "told")
    # Ids that go, and ids that more than one row has, are few or many; either way they are joined by size.
    ids = told.groupBy("doc_id").agg(F.sum("rows").alias("rows"), F.max("stays").alias("stays"), F.max("n").alias("n"))
    marked = staged(ids.where("not stays or (rows > 1 and n > 0)").select(F.col("doc_id").alias(id_of), (F.col("stays") & (F.col("rows") > 1)).alias(verdict)), "marked")
    by_size = F.broadcast(marked) if marked.count() <= SENT_IDS else marked
    joined = documents.join(by_size, documents["doc_id"] == F.col(id_of), "left")
    single = joined.where(F.col(id_of).isNull()).select(*documents.columns)
    if not marked.where(verdict).limit(1).count():
        return single
    # Rows of an id that several have are told apart by their class.
    several = documents.join(F.broadcast(marked.where(verdict)) if marked.count() <= SENT_IDS else marked.where(verdict), documents["doc_id"] == F.col(id_of), "left_semi")
    kept = told.where("stays").select(F.col("doc_id").alias(id_of), F.col("key").alias(verdict), (F.col("n") == 0).alias("__ngram_join_empty"))
    with_key = _with_key(several, key_of, size, seed)
    kept_rows = with_key.join(kept, (with_key["doc_id"] == F.col(id_of)) & (F.col(key_of) == F.col(verdict)))
    empty = kept_rows.where("__ngram_join_empty").select(*documents.columns)
    others = kept_rows.where("not __ngram_join_empty").dropDuplicates(["doc_id", key_of]).select(*documents.columns)
    return single.unionByName(empty).unionByName(others)


def _with_key(documents: DataFrame, name: str, size: int, seed: int) -> DataFrame:
    """All columns of the rows, and their class."""
    at, schema = documents.columns.index("text"), T.StructType([*documents.schema, T.StructField(name, T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [set_key(shingle_set(x.as_py(), size), seed)[0] for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], names=[*b.schema.names, name])

    return documents.mapInArrow(read, schema)
