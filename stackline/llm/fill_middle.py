"""Fill-in-middle documents by secondary sort: pieces keyed by row and place in the output.

A text is cut into lines, two of whose ends part it into prefix, middle and suffix; ids alone decide
where, and which form the document takes. Each task emits the chunks of lines of its rows, each keyed by
row and place in the output, and ``repartitionAndSortWithinPartitions`` brings a row's pieces
together in that order. They stream through an incremental digest; no output is held whole.

Restoring reads the output alone: the stream is parted at its marks again, wherever pieces end,
and what stands between them is keyed by its place in the text. Sorted by that
key, in the partitions that rows already share, so without another shuffle, the pieces stream
through the second digest. A row is dealt by a number of its own, not by its id, so rows of equal
ids don't meet, and only a single text decides how much one row takes.

Defined cases: a null text is empty; an empty text has no line, and it, or one that holds a mark, is
plain; a null id is written ``null`` in what is hashed; repeated rows give a result each; an
empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED, FORMED, SUFFIX_FIRST = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Marks in the order of the output, by form; the text has its parts in the order of TEXT.
ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
TEXT = {PREFIX: 1, MIDDLE: 2, SUFFIX: 3}
#: Bytes of a piece at most, and of the texts whose pieces a task sorts, about.
PIECE, SORTED = 1 << 16, 32 << 20


class Cut(NamedTuple):
    """How a text is formed: its lines, its form, and the bytes before the middle and before the suffix."""

    n: int
    form: str
    middle: int
    suffix: int


def cut(doc_id: int | None, text: bytes, seed: int = SEED, formed: int = FORMED, suffix_first: int = SUFFIX_FIRST) -> Cut:
    n = text.count(b"\n") + (text[-1:] not in (b"", b"\n"))
    drawn = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    h = [int.from_bytes(drawn[4 * k : 4 * k + 4], "big") for k in range(4)]
    if not text or any(mark in text for mark in TEXT) or h[2] % 100 >= formed:
        return Cut(n, "plain", 0, 0)
    ends, at, found = sorted(x % (n + 1) for x in h[:2]), 0, []
    for lines in (ends[0], ends[1] - ends[0]):
        for _ in range(lines):
            at = text.find(b"\n", at) + 1 or len(text)
        found.append(at)
    return Cut(n, "spm" if h[3] % 100 < suffix_first else "psm", *found)


def chunks(text: bytes) -> Iterator[bytes]:
    """Runs of whole lines of up to PIECE bytes; a longer line is cut."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            end = text.rfind(b"\n", at, end) + 1 or end
        yield text[at:end]
        at = end


def output_pieces(text: bytes, how: Cut) -> Iterator[bytes]:
    """The output, in order."""
    if how.form == "plain":
        yield from chunks(text)
        return
    parts = {PREFIX: text[: how.middle], MIDDLE: text[how.middle : how.suffix], SUFFIX: text[how.suffix :]}
    for mark in ORDER[how.form]:
        yield mark
        yield from chunks(parts[mark])


def text_pieces(output: Iterable[bytes], form: str) -> Iterator[tuple[int, int, bytes]]:
    """(part, number, bytes) of an output's pieces: sorted, they are the text. Marks may be cut by the ends of pieces."""
    part, number, held, marks = 0, 0, b"", list(ORDER.get(form, ()))
    for piece in output:
        held += piece
        while marks and (at := held.find(marks[0])) >= 0:
            yield part, number, held[:at]
            part, number, held = TEXT[marks[0]], 0, held[at + len(marks.pop(0)) :]
        kept = min(len(held), len(marks[0]) - 1) if marks else 0
        yield part, number, held[: len(held) - kept]
        number, held = number + 1, held[len(held) - kept :]
    yield part, number, held


def _of_row(key: tuple[int, int, int]) -> int:
    """Where a row's pieces go: rows are numbered by partition, so the number is mixed."""
    return (key[0] * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 17


def _rows(documents: DataFrame, id_col: str, text_col: str) -> RDD:
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")).rdd


def _partitions(documents: DataFrame, text_col: str) -> int:
    """Those of the session, or as many as keep what a task sorts bounded."""
    total = documents.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // SORTED)


def sorted_outputs(documents: DataFrame, seed: int = SEED, formed: int = FORMED, suffix_first: int = SUFFIX_FIRST, id_col: str = "doc_id", text_col: str = "text") -> RDD:
    """((row, 0, 0), (doc_id, cut, prefix_chars, middle_chars)) and then ((row, 1, k), piece) of each row, in order."""

    def pieces(rows):
        for doc_id, text, row in rows:
            whole = (text or "").encode()
            how = cut(doc_id, whole, seed, formed, suffix_first)
            chars = (None, None) if how.form == "plain" else (len(whole[: how.middle].decode()), len(whole[how.middle : how.suffix].decode()))
            yield (row, 0, 0), (doc_id, *how[:2], *chars)
            for k, piece in enumerate(output_pieces(whole, how)):
                yield (row, 1, k), piece

    return _rows(documents, id_col, text_col).mapPartitions(pieces).repartitionAndSortWithinPartitions(_partitions(documents, text_col), _of_row)


def _by_row(records: Iterable) -> Iterator[tuple[int, tuple, Iterator[bytes]]]:
    for row, own in groupby(records, lambda r: r[0][0]):
        head = next(own)[1]
        yield row, head, (piece for _, piece in own)


def transform(documents: DataFrame, **how) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of each row."""

    def joined(records):
        for _, head, pieces in _by_row(records):
            yield (*head, b"".join(pieces).decode())

    made = sorted_outputs(documents, **how).mapPartitions(joined)
    return documents.sparkSession.createDataFrame(made, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string", verifySchema=False)


def restore(outputs: DataFrame, id_col: str = "doc_id", form_col: str = "form", output_col: str = "output") -> DataFrame:
    """doc_id and text of each row of outputs and forms."""

    def texts(rows):
        for doc_id, form, output in rows:
            yield doc_id, b"".join(x for *_, x in sorted(text_pieces(chunks((output or "").encode()), form))).decode()

    rows = outputs.select(F.col(id_col).alias("doc_id"), form_col, output_col).rdd
    return outputs.sparkSession.createDataFrame(rows.mapPartitions(texts), "doc_id long, text string", verifySchema=False)


def digests(documents: DataFrame, **how) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of each row."""

    def forth(records):
        for row, head, pieces in _by_row(records):
            digest = hashlib.sha256()

            def seen(own):
                for piece in own:
                    digest.update(piece)
                    yield piece

            for part, number, piece in text_pieces(seen(pieces), head[2]):
                if piece:
                    yield (row, 1 + part, number), piece
            yield (row, 0, 0), (*head, digest.hexdigest())

    def back(records):
        for _, head, pieces in _by_row(records):
            digest = hashlib.sha256()
            for piece in pieces:
                digest.update(piece)
            yield (*head, digest.hexdigest())

    outputs = sorted_outputs(documents, **how)
    # The partitioner is the outputs' own, so rows stay where they are and only the order changes.
    again = outputs.mapPartitions(forth, preservesPartitioning=True).repartitionAndSortWithinPartitions(outputs.getNumPartitions(), _of_row)
    return documents.sparkSession.createDataFrame(again.mapPartitions(back), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string", verifySchema=False)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents),
x AS (SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM p
"""
