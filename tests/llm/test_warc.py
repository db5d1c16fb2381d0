import base64
import hashlib
import random

import pytest

from stackline.llm import warc as w


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)


def test_round_trip(spark):
    rng = random.Random(1)
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nWARC/1.1\r\n" * 3
    htmls = [None, "", tricky, "é" * 70_000, "日" * 200_000 + tricky, "x" * w.SEGMENT, tricky * 2000, tricky * 60_000, *["".join(rng.choice("ab\r\né0") for _ in range(rng.randint(0, 3000))) for _ in range(60)]]
    rows = [(i, None if i % 5 == 0 else f"http://x/é?{i}\n", h) for i, h in enumerate(htmls)]
    rows += [(100 + i, "u", htmls[i]) for i in range(12)] + [(200, "u", tricky), (5, "u", htmls[5]), (111, "u", htmls[7])]
    want = []
    newest = {}
    for i, _, h in rows:
        newest[h or ""] = max(i, newest.get(h or "", -1))
    for i, _, h in rows:
        data = (h or "").encode()
        to = newest[h or ""]
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to == i else "revisit", None if to == i else to))
    for segment, sent in ((w.SEGMENT, w.SENT_GROUPS), (100, 0)):
        path = w.shared_path(spark, "warc")
        w.write_archives(pages(spark, rows if segment > 100 else [r for r in rows if len(r[2] or "") < 5000]), path, segment=segment, sent_groups=sent)
        got = sorted(map(str, map(tuple, w.read_archives(spark, path).collect())))
        assert got == sorted(str(x) for x in want if segment > 100 or x[1] < 5000 or len(dict((r[0], r[2] or "") for r in rows)[x[0]]) < 5000)


def test_min_payload_and_empty(spark):
    path = w.shared_path(spark, "warc")
    w.write_archives(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), path, min_payload=3)
    assert sorted((r["page_id"], r["record_type"]) for r in w.read_archives(spark, path).collect()) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]
    assert w.archive_round_trip(pages(spark, [(1, "u", "a")]).where("page_id < 0")).collect() == []


def test_framing():
    rng = random.Random(3)
    for n in (0, 1, 15, 16, 17, 1000):
        body = bytes(rng.randrange(256) for _ in range(n))
        assert w.unchunked(w.chunked(body, 16)) == body
    assert w.unchunked(b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        w.unchunked(b"2\r\nabc\r\n0\r\n\r\n")


def archive(spark, tmp_path, data):
    import gzip

    path = tmp_path / "a.warc.gz"
    path.write_bytes(gzip.compress(data[: len(data) // 2]) + gzip.compress(data[len(data) // 2 :]))
    return {r["record_id"]: r.asDict() for r in w.read_records(spark, str(path), missing_responses=True).collect()}


def test_revisits_name_identifiers_that_are_there(spark):
    path = w.shared_path(spark, "warc")
    w.write_archives(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "x" * 200_000), (4, "u", "x" * 200_000)]), path)
    found = w.read_records(spark, path).collect()
    ids = {r["record_id"]: r for r in found}
    revisits = [r for r in found if r["record_type"] == "revisit"]
    assert len(revisits) == 2 and all(ids[r["refers_to"]]["record_type"] == "response" and ids[r["refers_to"]]["payload_digest"] == r["payload_digest"] and ids[r["refers_to"]]["payload_bytes"] == r["payload_bytes"] for r in revisits)


def test_archives_of_other_tools(spark, tmp_path):
    def made(version, fields, block):
        return b"WARC/1.%d\r\n" % version + b"".join(b"%b:%b\r\n" % x for x in fields) + b"Content-Length:%d\r\n\r\n" % len(block) + block + b"\r\n\r\n"

    body = b"see WARC/1.0 and WARC/1.1\r\n" * 50
    http = b"HTTP/1.1 200 OK\r\nTransfer-encoding:Chunked\r\nX-Long: a\r\n  b\r\n\r\n" + w.chunked(body, 33)
    data = made(0, [(b"WARC-Type", b"warcinfo"), (b"WARC-Record-ID", b"<i:0>"), (b"Content-Type", b"application/warc-fields")], b"software: x\r\n")
    data += made(0, [(b"WARC-Type", b"request"), (b"WARC-Record-ID", b"<i:1>"), (b"Content-Type", b"application/http; msgtype=request")], b"GET / HTTP/1.1\r\nHost: x\r\n\r\n")
    data += made(1, [(b"WARC-Type", b" response"), (b"WARC-Record-ID", b" <i:2>"), (b"WARC-Target-URI", b"http://x/"), (b"Content-Type", b"application/http; msgtype=response")], http)
    data += made(0, [(b"WARC-Type", b"revisit"), (b"WARC-Record-ID", b"<i:3>"), (b"WARC-Refers-To", b"<i:2>"), (b"Content-Type", b"application/http")], b"HTTP/1.1 200 OK\r\n\r\n")
    data += made(0, [(b"warc-type", b"metadata"), (b"warc-record-id", b"<i:4>")], b"")
    data += made(1, [(b"WARC-Type", b"revisit"), (b"WARC-Record-ID", b"<i:5>"), (b"WARC-Refers-To", b"<i:gone>")], b"")
    out = archive(spark, tmp_path, data)
    assert [(k, out[k]["record_type"], out[k]["payload_bytes"]) for k in sorted(out)] == [("<i:0>", "warcinfo", 13), ("<i:1>", "request", 0), ("<i:2>", "response", len(body)), ("<i:3>", "revisit", len(body)), ("<i:4>", "metadata", 0), ("<i:5>", "revisit", None)]
    assert out["<i:3>"]["payload_digest"] == out["<i:2>"]["payload_digest"] == w.base32_sha1(body) and out["<i:2>"]["target"] == "http://x/"


def test_damage_is_an_error(spark, tmp_path):
    import gzip

    whole = b"".join(x + b"\r\n\r\n" for i, to in ((1, 2), (2, None)) for x in w.records_of(i, "u", b"y" * 300, to, 100))
    for old, new in ((b"yyy", b"yzy"), (b"Segment-Number: 3", b"Segment-Number: 9"), (b"Total-Length: ", b"Total-Length: 1"), (b"WARC-Refers-To: <urn:page:2:", b"WARC-Refers-To: <urn:page:7:")):
        path = tmp_path / f"{len(new)}{old[-2:].hex()}.warc.gz"
        path.write_bytes(gzip.compress(whole.replace(old, new, 1)))
        with pytest.raises(Exception):
            w.read_archives(spark, str(path)).collect()
    path = tmp_path / "whole.warc.gz"
    path.write_bytes(gzip.compress(whole))
    assert sorted(tuple(r) for r in w.read_archives(spark, str(path)).select("page_id", "payload_bytes", "refers_to").collect()) == [(1, 300, 2), (2, 300, None)]


def test_a_payload_of_many_marks_is_read_in_one_pass():
    row = [("f", b"1\r\nContent-Length: 7000000\r\n\r\n")] + [("f", b"x" * 63)] * 100_000
    fields, block = next(w.split_records(iter([("f", b""), *row[:1], *row[1:]])))
    assert len(block) == 7_000_000
