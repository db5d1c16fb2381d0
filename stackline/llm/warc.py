"""WARC archives: records written with segments and chunked bodies, and read back whole.

A response's HTTP message is cut into segments of ``SEGMENT`` bytes: the first is the response
record, the others are continuation records that name its identifier as their origin. Its
body has chunked transfer framing. Equal payloads are stored once; the others are revisit
records that name the identifier of the response of the largest page, by which the reader
resolves them: their length comes from that response, and its digest must be the one they state.

Archives are written by the text writer, one record a line, where the line's end is the
blank lines after a record. They are read by splitting at the version lines of WARC 1.0 and 1.1; a
payload that holds such a line is put together again by the record's stated length. ``read_records``
takes any record type and other tools' identifiers; archives are gzipped, so each is read by one task.

Defined cases: a null html is an empty payload; a null url has no target header; a null
page_id is always a response; repeated rows of a page and payload have one identifier and are
counted each; an empty table gives an empty archive; other columns are ignored. A page with a
missing or wrong segment, length or digest is an error, as is a revisit of a response that isn't
there.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackline.llm.staging import shared_path, staged

VERSION = b"WARC/1.1\r\n"
#: What parts the records of both versions.
MARK = b"WARC/1."
END = "\r\n\r\n"
SEGMENT = 64 * 1024
CHUNK = 16 * 1024
RECORDS_PER_FILE = 20_000
#: Groups of equal payloads up to which they are sent to all executors (some 60 bytes each).
SENT_GROUPS = 200_000
MIN_PAYLOAD = 0
SEGMENTED = "application/http;msgtype=response"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing of a body."""
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The body in chunked framing; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";", 1)[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where it should")
        out.append(data[at : at + size])
        at += size + 2


def record(fields: dict[str, str], block: bytes) -> bytes:
    """A record without the blank lines after it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields.items(), ("Content-Length", str(len(block)))])
    return VERSION + head.encode() + b"\r\n" + block


def identifier(page_id: int | None, payload: bytes) -> str:
    """A page's record identifier: the same wherever the page with this payload is written or referred to."""
    return f"<urn:page:{'' if page_id is None else page_id}:{hashlib.sha1(payload).hexdigest()}>"


def records_of(page_id: int | None, url: str | None, payload: bytes, response: int | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """A page's records. response: the page that a revisit refers to, None for a response."""
    ident = identifier(page_id, payload)
    fields = {"WARC-Type": "response" if response is None else "revisit", "WARC-Record-ID": ident, "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": SEGMENTED, "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}"}
    if url is not None:
        fields["WARC-Target-URI"] = quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    if response is not None:
        fields |= {"WARC-Refers-To": identifier(response, payload), "WARC-Profile": PROFILE}
        yield record(fields, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield record(fields, block)
        return
    for k, at in enumerate(range(0, len(block), segment)):
        more = {"WARC-Segment-Number": str(k + 1)}
        if k:
            more |= {"WARC-Type": "continuation", "WARC-Record-ID": f"{ident[:-1]}-{k + 1}>", "WARC-Date": fields["WARC-Date"], "WARC-Segment-Origin-ID": ident}
            if at + segment >= len(block):
                more["WARC-Segment-Total-Length"] = str(len(block))
        yield record(more if k else fields | more, block[at : at + segment])


def write_archives(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD, segment: int = SEGMENT, sent_groups: int = SENT_GROUPS) -> None:
    """Write each page's records to gzipped archives under ``path``."""
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    groups = base.where(F.octet_length("payload") >= min_payload).groupBy("digest").agg(F.max("page_id").alias("chosen"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "chosen")
    if groups.count() <= sent_groups:
        groups = F.broadcast(groups)
    else:  # both sides then have an exchange of their own, so the adaptive join splits a frequent payload's rows
        groups = staged(groups, "payloads")
    joined = base.join(groups, "digest", "left").select("page_id", "url", "payload", F.when(F.col("chosen") != F.col("page_id"), F.col("chosen")).alias("response"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for page, url, payload, response in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = list(records_of(page, url, payload, response, segment))
                out += found
                size += sum(map(len, found))
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    joined.mapInArrow(write, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _fields(head: bytes) -> dict[bytes, bytes]:
    """Header fields by name in lower case; a line that starts with white space goes on with the one before."""
    out, name = {}, None
    for line in head.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and name:
            out[name] += b" " + line.strip()
        elif b":" in line:
            name, value = line.split(b":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def split_records(rows: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Fields and block of each record, from (file, bytes between marks) in file order."""
    parts, name, have, need, fields, start = [], None, 0, 0, {}, 0

    def ended() -> None:
        if parts:
            raise ValueError(f"{name} ends inside a record")

    for file, row in rows:
        if file != name:
            ended()
            name = file
            if row[1:3] != b"\r\n":
                continue  # what stands before the first mark
        parts.append(MARK + row if parts else row)
        have += len(parts[-1])
        if not need:
            whole = b"".join(parts)
            end = whole.find(b"\r\n\r\n")
            if end < 0:
                parts = [whole]
                continue
            fields, start = _fields(whole[3:end]), end + 4
            need = start + int(fields[b"content-length"])
            parts, have = [whole], len(whole)
        if have >= need:
            yield fields, b"".join(parts)[start:need]
            parts, have, need = [], 0, 0
    ended()


def payload_of(message: bytes) -> tuple[bytes, dict[bytes, bytes]]:
    """An HTTP message's body, without its framing, and its headers."""
    head, _, body = message.partition(b"\r\n\r\n")
    headers = _fields(head.partition(b"\r\n")[2])
    return (unchunked(body) if headers.get(b"transfer-encoding", b"").lower() == b"chunked" else body), headers


_OUT = "record_id string, record_type string, target string, payload_bytes long, payload_digest string, refers_to string"
_KINDS = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
_NAMES = ["record_id", "record_type", "target", "payload_bytes", "payload_digest", "refers_to"]


def _row(fields: dict[bytes, bytes], block: bytes) -> tuple:
    """The columns of ``read_records`` for a whole record; a stated digest must be that of the payload."""
    said = lambda name: fields[name].decode("utf-8", "replace") if name in fields else None
    kind, stated = said(b"warc-type"), said(b"warc-payload-digest")
    http = fields.get(b"content-type", b"").lower().startswith(b"application/http")
    body, headers = payload_of(block) if http else (block, {})
    if kind == "revisit":  # its payload is elsewhere; what it states is compared with that
        length, digest = headers.get(b"content-length"), stated and stated.removeprefix("sha1:")
        return said(b"warc-record-id"), kind, said(b"warc-target-uri"), length and int(length), digest, said(b"warc-refers-to")
    digest = base32_sha1(body)
    if stated and stated.startswith("sha1:") and stated != f"sha1:{digest}":
        raise ValueError(f"{said(b'warc-record-id')} has another digest than stated")
    return said(b"warc-record-id"), kind, said(b"warc-target-uri"), len(body), digest, None


def read_records(spark: SparkSession, path: str, missing_responses: bool = False) -> DataFrame:
    """record_id, record_type, target, payload_bytes, payload_digest and refers_to of each record, segments joined.

    A revisit has the length and digest of the response that it refers to. With ``missing_responses`` one
    whose response is elsewhere keeps what it states; else it is an error.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str, bytes]]:
            for b in batches:
                for file, value in zip(b.column(0), b.column(1), strict=True):
                    yield file.as_py(), value.as_py()

        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 10
            kinds = [*_KINDS, pa.string(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[*_NAMES, "origin", "segment", "total", "block"])

        for fields, block in split_records(rows()):
            if b"warc-segment-number" not in fields:
                out.append((*_row(fields, block), None, 0, None, None))
            else:
                total, number = fields.get(b"warc-segment-total-length"), int(fields[b"warc-segment-number"])
                if number == 1:  # the first keeps its fields with it
                    block = b"".join(b"%b: %b\r\n" % x for x in fields.items()) + b"\r\n" + block
                out.append((*[None] * 6, fields.get(b"warc-segment-origin-id", fields[b"warc-record-id"]).decode(), number, total and int(total), block))
                size += len(block)
            if size > 8_000_000 or len(out) > 20_000:
                yield batch()
                out, size = [], 0
        yield batch()

    def join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for copies, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts.sort(key=lambda p: p["segment"])
                if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] is None:
                    raise ValueError("a segment is missing")
                if any(p["copies"] != copies or p["low"] != p["high"] for p in parts):
                    raise ValueError("segments of one identifier differ")
                head, _, first = parts[0]["block"].partition(b"\r\n\r\n")
                message = first + b"".join(p["block"] for p in parts[1:])
                if len(message) != parts[-1]["total"]:
                    raise ValueError("segments have another length than stated")
                out.append((*_row(_fields(head), message), copies))
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [*_KINDS, pa.int64()], strict=True)], names=[*_NAMES, "copies"])

    # One file is one partition, in order: gzip can't be split.
    lines = spark.read.option("lineSep", MARK.decode()).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    parsed = staged(lines.mapInArrow(parse, f"{_OUT}, origin string, segment int, total long, block binary"), "records")
    whole = parsed.where("segment = 0").select(*_NAMES)
    # Repeated records are counted before their segments come together.
    check = F.xxhash64("block")
    each = parsed.where("segment > 0").groupBy("origin", "segment").agg(F.count(F.lit(1)).alias("copies"), F.max("total").alias("total"), F.first("block").alias("block"), F.min(check).alias("low"), F.max(check).alias("high"))
    together = each.groupBy("origin").agg(F.max("copies").alias("copies"), F.collect_list(F.struct("segment", "copies", "total", "block", "low", "high")).alias("parts"))
    joined = together.select("copies", "parts").mapInArrow(join_segments, f"{_OUT}, copies long")
    found = whole.unionByName(joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*_NAMES))
    found = staged(found, "whole_records")
    # Revisits of one response are one row before they meet it, and are split by the adaptive join after.
    kept = found.where("record_type = 'response'").groupBy(F.col("record_id").alias("to")).agg(F.first("payload_bytes").alias("to_bytes"), F.first("payload_digest").alias("to_digest"))
    met = found.where("record_type = 'revisit'").join(kept, F.col("refers_to") == F.col("to"), "left")
    agrees = F.coalesce(F.col("payload_digest") == F.col("to_digest"), F.lit(True)) & F.coalesce(F.col("payload_bytes") == F.col("to_bytes"), F.lit(True))
    alone = F.lit(missing_responses) & F.col("to").isNull()
    right = F.when(alone, F.col("payload_bytes")).when(F.col("to").isNotNull() & agrees, F.col("to_bytes")).otherwise(F.raise_error(F.concat(F.lit("no response with its length and digest for the revisit "), F.coalesce("record_id", F.lit("")))).cast("long"))
    resolved = met.select("record_id", "record_type", "target", right.alias("payload_bytes"), F.when(alone, F.col("payload_digest")).otherwise(F.col("to_digest")).alias("payload_digest"), "refers_to")
    return found.where("record_type is null or record_type <> 'revisit'").unionByName(resolved)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (a page) of each page in archives of ``write_archives``."""
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d*):", 1).try_cast("long")
    found = read_records(spark, path).where("record_type in ('response', 'revisit')")
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def archive_round_trip(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages, path, segment=segment)
    return read_archives(pages.sparkSession, path)
