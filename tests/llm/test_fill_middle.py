import hashlib
import re

import pytest

from stackline.llm import fill_middle
from stackline.llm.fill_middle import chunks, text_pieces


def by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, hexes = len(units), hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexes[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text):
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 50:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def texts(prose):
    odd = [None, "", "\n", "\n\n\nx", "<", "<P", "a<P>b\n", "x\n<M>", ">\n>S>\nM><\n<", "é ü\r\nö\x85\n\U0001f600", "no end", "<S\n>\nP>\n"]
    long = ["\n".join(prose(30, k) for k in range(400)), "y" * 200_000, ("z" * 70_000 + "\n") * 3, "\n" * 70_000]
    return [*odd, *long, *(prose(12, k).replace(" ", "\n") for k in range(40))]


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_outputs_and_restored_texts(spark, make, prose, monkeypatch, piece):
    monkeypatch.setattr(fill_middle, "PIECE", piece)
    all_texts = [t for t in texts(prose) if piece > 1000 or t is None or len(t) < 2000]
    rows = [(k, t) for k, t in enumerate(all_texts)] + [(None, "of no id\nb\n"), (3, "same id\nother text"), (3, all_texts[3])]
    want = sorted((repr((*(w := by_hand(i, t))[:5], sha(w[5]), sha(t))) for i, t in rows))
    # The driver's PIECE doesn't reach the workers; what pieces are is tested below for each size.
    assert sorted(repr(tuple(r)) for r in fill_middle.digests(make(rows, "output")).collect()) == want
    made = fill_middle.transform(make(rows))
    assert sorted(repr(tuple(r)) for r in made.collect()) == sorted(repr(by_hand(i, t)) for i, t in rows)
    assert sorted(repr(tuple(r)) for r in fill_middle.restore(made).collect()) == sorted(repr((i, t or "")) for i, t in rows)


@pytest.mark.parametrize("piece", [1, 2, 3, 5, 64])
def test_marks_cut_by_pieces(prose, monkeypatch, piece):
    monkeypatch.setattr(fill_middle, "PIECE", piece)
    for k, text in enumerate(t for t in texts(prose) if t and len(t) < 2000):
        _, _, form, _, _, output = by_hand(k, text)
        data = output.encode()
        assert b"".join(chunks(data)) == data and max(map(len, chunks(data))) <= piece
        assert b"".join(x for *_, x in sorted(text_pieces(chunks(data), form))).decode() == text


def test_second_sort_moves_nothing(spark, make):
    rows = fill_middle.sorted_outputs(make([(k, "a\nb\n" * 9) for k in range(50)]))
    again = rows.mapPartitions(lambda x: x, preservesPartitioning=True)
    assert again.partitioner == rows.partitioner and again.partitionBy(again.getNumPartitions(), fill_middle._of_row) is again


def test_empty_table(make):
    assert fill_middle.digests(make([])).count() == 0 and fill_middle.transform(make([])).count() == 0
