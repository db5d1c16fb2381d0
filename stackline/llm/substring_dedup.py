"""Repeated runs of words, found by a compressed FM-index for each shard of the text.

A window of 20 words is tied to the least hash among its runs of 4 words, its anchor. Windows
in a row with one anchor make a segment, and as equal windows have equal anchors, a segment need only
meet those of its anchor. So shards are made of anchors, not of documents, and the work grows with
the text and not with its square:

1. Segments are written with their hashes, not their words, and sorted by anchor, content, document
   and place. Ranges of that order are dealt out, so a frequent segment spreads over many tasks; what
   crosses the ends of ranges is settled from one row for each range. Segments whose anchor occurs
   once go. Of equal segments the first stands for all: the others repeat it wholly.
2. The words of the first ones are fetched from their documents. Each shard holds the segments of
   some anchors in an FM-index (``fm_index``). Backward search over its wavelet tree streams the segments in
   document order and gives matching statistics; at each place that matches a window's length, the
   interval in suffix order is the window itself, and where it holds several, all but the first
   in document order are reported.
3. Reported windows are united by document and cut out of the texts.

An anchor with more than HOT different segments (what stands around a very frequent passage) would make
a shard too large: its segments are cut into single windows, which meet by their hash as in 1.

Defined cases: null and empty texts have no words; documents of equal ids are ordered by a hash of
their texts, null ids come first; rows of equal id and text are one document, and each gets that
document's result; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackline.llm.fm_index import FMIndex
from stackline.llm.staging import removed, staged
from stackline.llm.words import WordHashes, mixed, shingle_hashes

WINDOW, ANCHOR = 20, 4
#: Segments of a shard, and different segments of an anchor above which they are cut into windows.
SHARD, HOT = 30_000, 20_000
#: Words that are cut into segments together, at least.
TOGETHER = 1 << 18
#: Parts that rows equal in all else are dealt into.
SALTS = 64
_ODD = 0x9E3779B97F4A7C15
SEGMENT = "anchor long, content long, doc long, twin long, start int, windows short, salt byte"
KEY = ["anchor", "content", "doc", "twin", "start"]
_ARROW = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()), ("twin", pa.int64()), ("start", pa.int32()), ("windows", pa.int16()), ("salt", pa.int8())])


def keyed(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, its order ``doc``, text and ``twin``, which tells documents of equal ids apart (0 where there are none)."""
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col)
    repeated = documents.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    twin = F.xxhash64(text) if repeated else F.lit(0).cast("long")
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("byte")
    return documents.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("doc"), twin.alias("twin"), F.encode(text, "utf-8").alias("text"), salt.alias("salt"))


def segments(hashes: np.ndarray, ends: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Anchor, content, first word and number of windows of each segment of several documents.

    ``hashes`` are those of all their words, ``ends`` where each document ends.
    """
    n = len(hashes)
    count, reach = n - window + 1, window - anchor + 1
    if count < 1:
        return (np.zeros(0, np.int64),) * 4
    # The order of anchors is that of the upper halves of their hashes, the leftmost first; so it depends on a window's words alone.
    runs = shingle_hashes(hashes, anchor)
    least = (runs & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(runs), dtype=np.uint64)
    span = 1
    while 2 * span <= reach:
        least, span = np.minimum(least[: len(least) - span], least[span:]), 2 * span
    least = np.minimum(least[:count], least[reach - span : reach - span + count])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    own = np.searchsorted(ends, np.arange(n), "right")  # the document of each word
    valid = own[:count] == own[window - 1 :]
    fresh = np.ones(count, bool)
    fresh[1:] = (place[1:] != place[:-1]) | (own[1:count] != own[: count - 1])
    first = np.flatnonzero(valid & fresh)
    group = np.cumsum(fresh)
    windows = np.bincount(group[valid], minlength=int(group[-1]) + 1)[group[first]]
    # Sums of hashes times powers, less what stands before, moved to a common power.
    power = np.full(n + 1, _ODD, np.uint64)
    power[0] = 1
    inverse = np.full(n + 1, pow(_ODD, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * np.cumprod(power)[:n], dtype=np.uint64)])
    last = first + windows + window - 1
    content = mixed((sums[last] - sums[first]) * np.cumprod(inverse)[first] + windows.astype(np.uint64))
    return runs[place[first]].view(np.int64), content.view(np.int64), first, windows


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Rows and their words, some at a time: at least TOGETHER words, but for the last of a batch."""
    for batch in batches:
        texts, at, held, n = batch.column("text"), 0, [], 0
        for k in range(len(batch)):
            held.append((texts[k].as_py() or b"").split())
            n += len(held[-1])
            if n >= TOGETHER or k + 1 == len(batch):
                yield batch.slice(at, len(held)), held
                at, held, n = k + 1, [], 0


def _cutting(window: int, anchor: int) -> Callable:
    def of(batches):
        hashes = WordHashes()
        for rows, words in _groups(batches):
            ends = np.cumsum([len(w) for w in words])
            found = segments(hashes.array([x for w in words for x in w]), ends, window, anchor)
            row = np.searchsorted(ends, found[2], "right")
            start = found[2] - np.concatenate([[0], ends])[row]
            kept = rows.select(["doc", "twin", "salt"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), kept["doc"], kept["twin"], pa.array(start.astype(np.int32)), pa.array(found[3].astype(np.int16)), kept["salt"]], schema=_ARROW)

    return of


def _marking(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted range with ``kind``: 0 the first of its content, 1 a later one, 2 the first again; 3 and 4
    repeat the range's first row and the first one of its last content. ``alone``: no neighbour has its anchor. Rows
    that are alone stay out unless they are at an end of the range."""
    part = TaskContext.get().partitionId()
    names = list(_ARROW.names)

    def table(columns, kind, alone):
        full = [pa.array(c, t) for c, t in zip(columns, _ARROW.types)]
        return pa.RecordBatch.from_arrays([*full, pa.array(kind, pa.int8()), pa.array(alone, pa.bool_()), pa.array(np.full(len(kind), part, np.int32))], [*names, "kind", "alone", "part"])

    held = None  # the last row, whose next one isn't known
    held_first = held_same = False
    lead = lead_row = None

    def settled(columns, first, same, shares_before, shares_after, is_start, is_end):
        alone = ~(shares_before | shares_after)
        keep = ~alone
        keep[0] |= is_start
        keep[-1] |= is_end
        kind = np.where(first, 0, np.where(same, 2, 1)).astype(np.int8)
        return table([c[keep] for c in columns], kind[keep], alone[keep])

    start, before_held = True, False
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(n).to_numpy() for n in names]
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
        else:
            lead_row = [c[:1] for c in columns]
        n = len(columns[0])
        other_anchor = columns[0][1:] != columns[0][:-1]
        other_content = other_anchor | (columns[1][1:] != columns[1][:-1])
        other_place = other_content.copy()
        for c in columns[2:5]:
            other_place |= c[1:] != c[:-1]
        index = np.arange(n)
        content_at = np.maximum.accumulate(np.where(np.append(True, other_content), index, 0))
        place_at = np.maximum.accumulate(np.where(np.append(True, other_place), index, 0))
        first = np.append(True, other_content)
        same = place_at == content_at  # at the place where its content began
        if held is not None:
            ongoing = content_at == 0
            first[0] = held_first
            if not (held_first or held_same):
                same[ongoing] = False
        else:
            lead = lead_row
        run = content_at[-1]
        if run > 0 or held is None:
            lead = [c[run : run + 1] for c in columns]
        shares_before = np.append(before_held if held is not None else False, ~other_anchor)
        if n > 1:
            yield settled([c[:-1] for c in columns], first[:-1], same[:-1], shares_before[:-1], ~other_anchor, start, False)
            start = False
        held, held_first, held_same, before_held = [c[-1:] for c in columns], bool(first[-1]), bool(same[-1]), bool(shares_before[-1])
    if held is not None:
        yield settled(held, np.array([held_first]), np.array([held_same]), np.array([before_held]), np.array([False]), start, True)
        yield table([np.concatenate([a, b]) for a, b in zip(lead_row, lead)], np.array([3, 4], np.int8), np.array([False, False]))


def first_of_equal(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows of SEGMENT, staged: the first of each content whose anchor has several rows, and all later ones.

    Rows are sorted over ranges, so those of one content may be in several. Of each range only its ends
    reach the driver, which finds for each what went before and comes after.
    """
    spark = rows.sparkSession
    order = [*KEY, "salt"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    marked = staged(ranges.mapInArrow(_marking, f"{SEGMENT}, kind byte, alone boolean, part int"), "segments_marked")
    ends: dict[int, dict] = {}
    for r in marked.where("kind >= 3").select("part", "kind", *KEY).collect():  # two rows a range
        ends.setdefault(r["part"], {})[r["kind"]] = tuple(r)[2:]
    known, before = [], None
    parts = sorted(ends)
    for k, part in enumerate(parts):
        after = ends[parts[k + 1]][3][0] if k + 1 < len(parts) else None
        known.append((part, *(before or (None,) * 5), after))
        lead, last = ends[part][3], ends[part][4]
        if not (before and lead[:2] == before[:2] == last[:2]):
            before = last
    edges = spark.createDataFrame(known, "part int, b_anchor long, b_content long, b_doc long, b_twin long, b_start int, a_anchor long")
    all_rows = marked.where("kind < 3").join(F.broadcast(edges), "part", "left")
    goes_on = F.col("anchor").eqNullSafe(F.col("b_anchor")) & F.col("content").eqNullSafe(F.col("b_content"))
    again = goes_on & (F.col("doc") == F.col("b_doc")) & (F.col("twin") == F.col("b_twin")) & (F.col("start") == F.col("b_start"))
    kind = F.when(again, 2).when(goes_on, 1).otherwise(F.col("kind"))
    alone = F.col("alone") & ~F.col("anchor").eqNullSafe(F.col("b_anchor")) & ~F.col("anchor").eqNullSafe(F.col("a_anchor"))
    settled = all_rows.select("anchor", "content", "doc", "twin", "start", "windows", kind.alias("kind"), alone.alias("alone")).where("not alone")
    return settled.where("kind = 0").drop("kind", "alone"), settled.where("kind = 1").drop("kind", "alone")


def _packing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = pa.array([pack.compress(t.as_py() or b"") for t in batch.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "doc", "twin")), packed], ["doc_id", "doc", "twin", "packed"])


def _packed(documents: DataFrame) -> DataFrame:
    """Documents with compressed texts, which is what moves."""
    return documents.select("doc_id", "doc", "twin", "text").mapInArrow(_packing, "doc_id long, doc long, twin long, packed binary")


def _fetching(window: int, single: bool) -> Callable:
    """Words of the segments asked of each document; ``single``: each of their windows, with the hash of its words."""

    def of(batches):
        unpack, hashes = zstandard.ZstdDecompressor(), WordHashes()
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("anchor", "content", "doc", "twin", "start", "windows", "salt", "words")}
            for doc, twin, packed, asked in zip(*(batch.column(n) for n in ("doc", "twin", "packed", "asked"))):
                words = unpack.decompress(packed.as_py()).split()
                of_windows = shingle_hashes(hashes.array(words), window).view(np.int64) if single else None
                for a in asked.as_py():
                    for start, n in [(a["start"] + k, 1) for k in range(a["windows"])] if single else [(a["start"], a["windows"])]:
                        content = int(of_windows[start]) if single else 0
                        row = (a["anchor"], content, doc.as_py(), twin.as_py(), start, n, start % SALTS, None if single else b" ".join(words[start : start + n + window - 1]))
                        for column, x in zip(out.values(), row):
                            column.append(x)
                if len(out["doc"]) >= 20_000:
                    yield _batch(out)
                    out = {n: [] for n in out}
            yield _batch(out)

    def _batch(out):
        return pa.RecordBatch.from_arrays([*(pa.array(out[f.name], f.type) for f in _ARROW), pa.array(out["words"], pa.binary())], [*_ARROW.names, "words"])

    return of


def _fetched(packed: DataFrame, asked: DataFrame, window: int, single: bool = False) -> DataFrame:
    by_doc = asked.groupBy("doc", "twin").agg(F.collect_list(F.struct("anchor", "start", "windows")).alias("asked"))
    return packed.join(by_doc, ["doc", "twin"]).select("doc", "twin", "packed", "asked").mapInArrow(_fetching(window, single), f"{SEGMENT}, words binary")


def repeated_in_shard(doc: np.ndarray, twin: np.ndarray, start: np.ndarray, words: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Of segments, those of an anchor all among them: doc, twin, first word and end of the windows that are also earlier.

    ``words`` are numbers of the words, from 1, of all segments one after the other.
    """
    order = np.lexsort((start, twin, doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (doc[order][1:] != doc[order][:-1]) | (twin[order][1:] != twin[order][:-1]) | (start[order][1:] != start[order][:-1])
    order = order[fresh]  # a document that is there twice is one
    if not len(order):
        return doc[:0], twin[:0], start[:0], start[:0]
    patterns = np.full((len(lengths), int(lengths.max())), -1)
    patterns[np.arange(patterns.shape[1]) < lengths[:, None]] = words
    doc, twin, start, lengths, patterns = doc[order], twin[order], start[order], lengths[order], patterns[order]
    index = FMIndex.of(patterns[patterns >= 0], lengths, int(words.max()) + 1, window)
    matched, low, high = index.matching_statistics(patterns, lengths)
    lane, at = np.nonzero((matched >= window) & (high - low > 1))
    own = np.cumsum(np.append(False, (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1])))
    stream = np.lexsort((start[lane] + at, own[lane]))  # documents in their order, and their windows
    lane, at = lane[stream], at[stream]
    again = np.ones(len(lane), bool)
    again[np.unique(low[lane, at], return_index=True)[1]] = False
    lane, first = lane[again], start[lane[again]] + at[again]
    return doc[lane], twin[lane], first, first + window


def repeated_windows(rows: list[tuple[int, int, int, list[bytes]]], window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """The same of rows (doc, twin, start, words)."""
    ids: dict[bytes, int] = {}
    words = np.array([ids.setdefault(w, len(ids) + 1) for r in rows for w in r[3]], np.int64)
    columns = [np.array([r[k] for r in rows], np.int64) for k in range(3)]
    found = repeated_in_shard(*columns, words, np.array([len(r[3]) for r in rows], np.int64), window)
    return list(zip(*(c.tolist() for c in found)))


def _indexing(window: int) -> Callable:
    def of(table: pa.Table) -> pa.Table:
        words = pc.split_pattern(table["words"].combine_chunks(), b" ")
        numbers = words.flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + 1
        found = repeated_in_shard(*(table[n].to_numpy().astype(np.int64) for n in ("doc", "twin", "start")), numbers, pc.list_value_length(words).to_numpy().astype(np.int64), window)
        return pa.table({n: pa.array(c, pa.int64() if n in ("doc", "twin") else pa.int32()) for n, c in zip(("doc", "twin", "start", "end"), found)})

    return of


def repeated_runs(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc, twin, start and end of runs of words covered by windows that also start earlier; ``documents`` as from ``keyed``."""
    rows = staged(documents.select("doc", "twin", "text", "salt").mapInArrow(_cutting(window, anchor), SEGMENT), "segments")
    firsts, later = first_of_equal(rows)
    removed(documents.sparkSession, rows)
    firsts = staged(firsts, "segments_first")
    packed = _packed(documents)
    often = staged(firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT), "anchors_hot").select("anchor")
    runs = later
    if often.limit(1).count():
        windows = staged(_fetched(packed, firsts.join(often, "anchor", "left_semi"), window, single=True).drop("words"), "windows_hot")
        runs = runs.unionByName(first_of_equal(windows)[1])
        firsts = staged(firsts.join(often, "anchor", "left_anti"), "segments_cold")
    shards = max(1, math.ceil(firsts.count() / SHARD))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    found = _fetched(packed, firsts, window).select(shard, "doc", "twin", "start", "words").groupBy("shard").applyInArrow(_indexing(window), "doc long, twin long, start int, end int")
    return runs.select("doc", "twin", "start", (F.col("start") + F.col("windows") + (window - 1)).cast("int").alias("end")).unionByName(found)


def _removing(digest: bool) -> Callable:
    def of(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            total, gone, kept = [], [], []
            for packed, runs in zip(batch.column("packed"), batch.column("runs")):
                words = unpack.decompress(packed.as_py()).split()
                total.append(len(words))
                if runs.is_valid:
                    marks = np.zeros(len(words) + 1, np.int64)
                    flat = runs.values
                    np.add.at(marks, flat.field("start").to_numpy(), 1)
                    np.add.at(marks, flat.field("end").to_numpy(), -1)
                    covered = np.cumsum(marks)[:-1] > 0
                    words = [w for w, c in zip(words, covered.tolist()) if not c]
                gone.append(total[-1] - len(words))
                left = b" ".join(words)
                kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return of


def deduplicated(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and ``kept``, the words left joined by spaces (``digest``: their SHA-256), of each row."""
    docs = keyed(documents, id_col, text_col)
    runs = repeated_runs(docs, window, anchor).groupBy("doc", "twin").agg(F.collect_set(F.struct("start", "end")).alias("runs"))
    joined = _packed(docs).join(runs, ["doc", "twin"], "left").select("doc_id", "packed", "runs")
    return joined.mapInArrow(_removing(digest), "doc_id long, n_words long, n_removed long, kept string")


def digests(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row."""
    return deduplicated(documents, window, digest=True).withColumnRenamed("kept", "kept_sha256")


SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS k FROM g),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM r, range(20) AS o(j) WHERE k > 1),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
