"""Secret scans: patterns find candidates, structure confirms them.

Three base kinds are reported wherever their pattern fits. Further candidates (base64 and
hex runs, three-part tokens, armoured and one-line keys) are decoded first and reported
only if what they hold parses, wherever in a run of letters it starts and however its lines are broken or escaped: the fields of a private key at their places, with nested
lengths that fill it exactly; a length-prefixed private key file; an encrypted key's headers
and whole cipher blocks; or a signed token's JSON header and payload. Certificates, signatures,
digests and public keys have other fields and aren't reported.

Spans are in code points, end exclusive; a base span is its whole match. Defined cases: a
null or empty text has no spans; equal starts are ordered by the order of KINDS; repeated
rows are scanned each; an empty table gives none; other columns are ignored, or kept as
they are by ``redact``.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "token", "key", "der", "sshkey")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]{8,})(?![A-Za-z0-9_-])")
#: Where a line is broken: at its end, as an escape of two characters or four, and before what mails quote with.
_BREAK = r"[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t>]*"
_ARMOUR = re.compile(rf"-----BEGIN ([A-Z ]*)PRIVATE KEY-----((?:{_BREAK}[A-Za-z0-9-]+: (?:(?!\\[rn])[^\r\n])*)*)((?:[A-Za-z0-9+/=\s>]|\\[rn]){{16,}}?)-----END \1PRIVATE KEY-----", re.ASCII)
_CIPHER = re.compile(r"Proc-Type: *4,ENCRYPTED\s+DEK-Info: *([A-Z0-9-]+),([0-9A-Fa-f]+)", re.ASCII)
#: Where a key may start in base64, inside a run too: a sequence's tag and length, or the mark of a key file.
_STARTS = re.compile(r"M[A-I]|b3BlbnNzaC1rZXktdjEA")
_JSON = re.compile(r"(?=e[yw])")
_PIECE, _JOIN, _PADDING = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(_BREAK), re.compile(r"=*")
#: Bytes of a key at most, and of what decides whether it is worth reading whole.
LARGEST, HEAD = 1 << 14, 12
_HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")
_OPENSSH = b"openssh-key-v1\x00"

INTEGER, OCTETS, OBJECT, SEQUENCE = 0x02, 0x04, 0x06, 0x30
#: Encoded object identifiers (PKCS#5 and PKCS#12 schemes) that start an encrypted key's algorithm.
_ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def decoded(text: str) -> bytes | None:
    """Base64 of either alphabet, with or without its padding; None if it isn't."""
    text = re.sub(r"\\[rn]|[\s>]", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of the elements of a tag-length-value encoding that fill ``data``; None if they don't."""
    at, out = 0, []
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            more = size & 0x7F
            if not 1 <= more <= 4 or at + more > len(data):
                return None
            size, at = int.from_bytes(data[at : at + more], "big"), at + more
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def nested(data: bytes, depth: int = 12) -> bool:
    """Whether lengths fill ``data`` at every level of constructed elements."""
    found = elements(data)
    return bool(found) and all(not tag & 0x20 or not inner or (depth > 0 and nested(inner, depth - 1)) for tag, inner in found)


def is_der_key(data: bytes | None) -> bool:
    """One sequence with the fields of a private key, each at its place, and all lengths exact.

    PKCS#1: version and eight numbers or more. DSA: version and five numbers of fitting sizes. PKCS#8: version, an
    algorithm that starts with an identifier, octets. SEC1: version 1 and octets, then tagged
    parts only. Encrypted PKCS#8: an encryption scheme with parameters, and octets.
    """
    if not data or data[0] != SEQUENCE or not nested(data):
        return False
    outer = elements(data)
    if len(outer) != 1:
        return False
    fields = elements(outer[0][1])
    tags = [tag for tag, _ in fields]
    if tags == [SEQUENCE, OCTETS]:
        scheme = elements(fields[0][1])
        return [tag for tag, _ in scheme] == [OBJECT, SEQUENCE] and scheme[0][1].startswith(_ENCRYPTION) and len(fields[1][1]) >= 16
    if len(fields) < 2 or tags[0] != INTEGER or fields[0][1] not in (b"\x00", b"\x01"):
        return False
    numbers = next((k for k, tag in enumerate(tags) if tag != INTEGER), len(tags))
    if numbers >= 9:
        return tags[numbers:] in ([], [SEQUENCE])
    if numbers == len(tags) == 6:
        p, q, *rest = (int.from_bytes(x, "big") for _, x in fields[1:])
        size = lambda n: -(-n.bit_length() // 8)
        return fields[0][1] == b"\x00" and 64 <= size(p) <= 513 and size(q) in (20, 28, 32) and all(n > 1 and size(n) <= size(top) for n, top in zip(rest, (p, p, q), strict=True))
    if tags[1:3] == [SEQUENCE, OCTETS]:
        algorithm = elements(fields[1][1])
        return bool(algorithm) and algorithm[0][0] == OBJECT and len(fields[2][1]) >= 16 and all(tag & 0x80 for tag in tags[3:])
    return fields[0][1] == b"\x01" and tags[1] == OCTETS and 16 <= len(fields[1][1]) <= 72 and all(tag & 0x80 for tag in tags[2:])


def _strings(data: bytes, n: int | None = None) -> tuple[list[bytes], bytes] | None:
    """``n`` length-prefixed fields, or as many as there are, and what follows them; None if a length doesn't hold."""
    out = []
    while len(out) != n and (data or n):
        size = int.from_bytes(data[:4], "big")
        if len(data) < 4 + size or len(data) < 4:
            return None
        out.append(data[4 : 4 + size])
        data = data[4 + size :]
    return out, data


def ssh_size(data: bytes | None) -> int:
    """Bytes of the private key file that ``data`` starts with, or 0: cipher, derivation, public keys as counted, and a private part whose check numbers agree where it isn't encrypted."""
    if not data or not data.startswith(_OPENSSH):
        return 0
    head = _strings(data[len(_OPENSSH) :], 3)
    if head is None or len(head[1]) < 4:
        return 0
    keys = int.from_bytes(head[1][:4], "big")
    rest = _strings(head[1][4:], keys + 1) if 1 <= keys <= 64 else None
    if rest is None:
        return 0
    public, private = rest[0][:-1], rest[0][-1]
    if any((named := _strings(k)) is None or len(named[0]) < 2 for k in public) or len(private) < 16:
        return 0
    return len(data) - len(rest[1]) if head[0][0] != b"none" or private[:4] == private[4:8] else 0


def is_ssh_key(data: bytes | None) -> bool:
    return bool(data) and ssh_size(data) == len(data)


def is_encrypted_armour(headers: str, data: bytes | None) -> bool:
    """Headers that name a cipher and its start value, before whole blocks of that cipher."""
    found = _CIPHER.search(headers)
    return bool(found and data) and len(found[2]) in (16, 32) and len(data) % (len(found[2]) // 2) == 0


def is_signed_token(header: str, payload: str, signature: str) -> bool:
    """A JSON header with an algorithm, before a JSON payload and a signature that decodes."""
    try:
        first, second = (json.loads((decoded(x) or b"").decode("utf-8")) for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(first, dict) and isinstance(first.get("alg"), str) and isinstance(second, dict) and bool(decoded(signature))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    out = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]


def _letters(text: str, at: int, most: int) -> tuple[str, list[tuple[int, int]]]:
    """Up to ``most`` characters of base64 from a place on, over breaks of lines, and (letters so far, end in the text) of each line."""
    out, n, ends = [], 0, []
    while n < most and (piece := _PIECE.match(text, at, at + most - n)):
        out.append(piece[0])
        n, at = n + len(piece[0]), piece.end()
        ends.append((n, at))
        if not (join := _JOIN.match(text, at)):
            break
        at = join.end()
    return "".join(out), ends


def _end(ends: list[tuple[int, int]], letters: int, text: str) -> int | None:
    """Where the first ``letters`` characters end in the text, with the padding that follows; None if others follow in their line."""
    n, at = next(e for e in ends if e[0] >= letters)
    at -= n - letters
    return None if _PIECE.match(text, at) else _PADDING.match(text, at).end()


def embedded_keys(text: str) -> Iterator[tuple[int, str, int]]:
    """Keys in base64 of either alphabet, wherever in a run of letters they start and however their lines are broken."""
    at = 0
    while m := _STARTS.search(text, at):
        start, at = m.start(), m.start() + 1
        if m[0][0] == "b":
            letters, ends = _letters(text, start, LARGEST * 4 // 3)
            size, kind = ssh_size(decoded(letters[: len(letters) & ~3]) or b"") or ssh_size(decoded(letters)), "sshkey"
        else:
            letters, ends = _letters(text, start, HEAD * 4 // 3)
            head = (decoded(letters) or b"") if len(letters) == HEAD * 4 // 3 else b""
            more = head[1] & 0x7F if head and head[1] & 0x80 else 0
            size, kind = (2 + more + int.from_bytes(head[2 : 2 + more], "big") if more else 2 + head[1]) if head and more <= 4 else 0, "der"
            if not 32 < size <= LARGEST or head[2 + more] not in (INTEGER, SEQUENCE):
                continue
            wanted = -(-size * 4 // 3)
            letters, ends = _letters(text, start, wanted)
            size = size if len(letters) == wanted and is_der_key((decoded(letters) or b"")[:size]) else 0
        if size and (end := _end(ends, -(-size * 4 // 3), text)):
            yield start, kind, end
            at = end


def signed_tokens(text: str) -> Iterator[tuple[int, str, int]]:
    """Signed tokens; what stands joined before one isn't part of it."""
    at = 0
    while m := _TOKEN.search(text, at):
        starts = [0, *(x.start() for x in _JSON.finditer(m[1]) if x.start())]
        found = next((k for k in starts if is_signed_token(m[1][k:], m[2], m[3])), None)
        at = m.start(2) if found is None else m.end()
        if found is not None:
            yield m.start() + found, "token", m.end()


def confirmed_spans(text: str) -> list[tuple[int, str, int]]:
    """Candidates whose decoded form has the structure of a secret."""
    out = []
    if "." in text:
        out += signed_tokens(text)
    if "-----BEGIN" in text:
        out += [(m.start(), "key", m.end()) for m in _ARMOUR.finditer(text) if is_der_key(data := decoded(m[3])) or is_ssh_key(data) or is_encrypted_armour(m[2], data)]
    inside = [(a, b) for a, _, b in out]
    for start, kind, end in embedded_keys(text):
        if not any(a <= start and end <= b for a, b in inside):
            out.append((start, kind, end))
    for m in _HEX_ANY.finditer(text):
        data = binascii.unhexlify(m[0])
        if is_der_key(data):
            out.append((m.start(), "der", m.end()))
        elif is_ssh_key(data):
            out.append((m.start(), "sshkey", m.end()))
    return out


def ordered(spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def rendered(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in ordered(spans))


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the spans as an array of (kind, start, end), by start."""
    kind = documents.schema[id_col].dataType.simpleString()
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, k, e in ordered(base_spans(t) + confirmed_spans(t))] for t in (x.as_py() or "" for x in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, item)], names=["doc_id", "spans"])

    return documents.select(id_col, text_col).mapInArrow(find, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redacted(text: str) -> str:
    """The text with each run of spans replaced by ``[kind]`` of its first."""
    out, at = [], 0
    for start, kind, end in ordered(base_spans(text) + confirmed_spans(text)):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows with secrets cut out of their text, and the text's length put right where there is such a column."""
    at = documents.columns.index(text_col)
    schema = documents.schema
    length = next((i for i, f in enumerate(schema) if f.name == length_col and isinstance(f.dataType, (T.LongType, T.IntegerType))), None)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(at).to_pylist()
            new = [x and redacted(x) for x in old]
            cols = list(b.columns)
            cols[at] = pa.array(new, b.schema.field(at).type)
            if length is not None:
                sizes = b.column(length).to_pylist()
                cols[length] = pa.array([len(y) if y != x else n for x, y, n in zip(old, new, sizes, strict=True)], b.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return documents.mapInArrow(clean, schema)


def digests(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *map(count, BASE), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
