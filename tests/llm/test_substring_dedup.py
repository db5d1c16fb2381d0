import hashlib
import random
import re

import numpy as np
import pytest

from stackline.llm import substring_dedup
from stackline.llm.substring_dedup import repeated_windows, segments
from stackline.llm.words import WordHashes


def by_hand(rows, window=20):
    """Rows of (doc_id, text) in any order; equal rows are one document."""
    docs = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc_id, text] = (doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return sorted(repr(out[r]) for r in rows)


def corpus(prose):
    rng = random.Random(4)
    base = [prose(90, k) for k in range(12)]
    passage, line = prose(70, 99), " ".join(f"w{k}" for k in range(22))
    texts = [None, "", "one", "\n \t", "a " * 19, "a " * 60, "a b " * 40, line, line + " x", line, "\x1c\x85 " + line]
    for k in range(60):
        words = rng.choice(base).split()
        words[rng.randrange(len(words))] = f"changed{k}"
        texts.append(" ".join(words))
    texts += [f"{prose(15, 500 + k)} {passage} {prose(15, 900 + k)}" for k in range(40)]
    texts += [base[0]] * 5 + [passage + " " + passage, "é ü\n" * 30]
    rng.shuffle(texts)
    return list(enumerate(texts))


def got(df):
    return sorted(repr(tuple(r)) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


@pytest.mark.parametrize("hot,shard", [(20_000, 30_000), (3, 10), (1, 30_000)])
def test_equals_plain_windows(spark, make, prose, monkeypatch, hot, shard):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SHARD", shard)
    rows = corpus(prose)
    rows += [rows[20], rows[20], (None, prose(60, 1)), (None, prose(60, 1))]
    assert got(substring_dedup.digests(make(rows, "runs"))) == by_hand(rows)


def test_ranges_smaller_than_a_group(spark, make, prose):
    rows = [(k, prose(40, 1)) for k in range(90)] + [(100 + k, prose(40, 1) + f" {k}") for k in range(30)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        assert got(substring_dedup.digests(make(rows))) == by_hand(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ids_that_differ_in_text_only(spark, make, prose):
    rows = [(1, prose(50, 1)), (1, prose(50, 1) + " end"), (2, prose(50, 1))]
    found = [tuple(r)[:3] for r in substring_dedup.digests(make(rows)).collect()]
    assert sorted(f[0] for f in found) == [1, 1, 2] and sum(f[2] == 0 for f in found) == 1  # which of the two comes first is by hash
    assert (2, 50, 50) in found


def test_kept_texts_and_empty_tables(make, prose):
    rows = [(1, prose(30, 1)), (2, prose(30, 1) + "\nnew words")]
    kept = {r["doc_id"]: r["kept"] for r in substring_dedup.deduplicated(make(rows)).collect()}
    assert kept == {1: " ".join(prose(30, 1).split()), 2: "new words"}
    assert substring_dedup.digests(make([])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_segments_hold_each_window_once(seed):
    rng = random.Random(seed)
    docs = [[rng.choice([b"a", b"b", b"c", b"%d" % rng.randrange(50)]) for _ in range(rng.choice([0, 3, 19, 20, 21, 200]))] for _ in range(30)]
    ends = np.cumsum([len(d) for d in docs])
    anchor, content, first, windows = segments(WordHashes().array([w for d in docs for w in d]), ends)
    words = [w for d in docs for w in d]
    covered = [i for f, n in zip(first.tolist(), windows.tolist()) for i in range(f, f + n)]
    starts = np.append(0, ends[:-1])
    assert covered == [i for s, e in zip(starts.tolist(), ends.tolist()) for i in range(s, e - 19)]
    by_window, by_content = {}, {}
    for a, c, f, n in zip(anchor.tolist(), content.tolist(), first.tolist(), windows.tolist()):
        for i in range(f, f + n):
            assert by_window.setdefault(tuple(words[i : i + 20]), a) == a
        assert by_content.setdefault((a, c), words[f : f + n + 19]) == words[f : f + n + 19]
    assert len(by_content) == len({tuple(w) for w in by_content.values()})


def test_windows_of_a_shard():
    a, b = [b"%d" % k for k in range(9)], [b"x", b"1", b"2", b"3", b"y"]
    rows = [(2, 0, 5, a), (1, 0, 0, b), (2, 0, 5, a), (3, 0, 1, a[:4])]
    assert sorted(repeated_windows(rows, 3)) == [(2, 0, 6, 9), (3, 0, 1, 4), (3, 0, 2, 5)]
