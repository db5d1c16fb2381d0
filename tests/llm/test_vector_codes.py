import hashlib
import math
import random

import numpy as np
import pytest

from stackline.llm import vector_codes
from stackline.llm.vector_codes import distinct_rows, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, parts=4, entries=256, rounds=4):
    """Plain whole-number k-means of parts; rows of (vec_id, vector, label)."""
    kept = [(i, [math.floor(float(np.float32(x)) * 1024) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // parts
    cut = [[r[1][p * size : (p + 1) * size] for p in range(parts)] for r in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def near(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = [near(p, c[p])[1] for c in cut]
            for k in range(len(books[p])):
                mine = [c[p] for c, o in zip(cut, own) if o == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [[near(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    by_label = {}
    for r, e in zip(kept, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    return sorted((r[0], "".join(f"{k:02x}" for _, k in f), e, by_label[r[2]], sha) for r, f, e in zip(kept, found, errors))


def drawn(n, dims, seed, values=None):
    rng = random.Random(seed)
    return [(i, [rng.choice(values) if values else rng.gauss(0, 0.2) for _ in range(dims)], rng.choice([None, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("values", [None, [0.0, 0.25, -0.5]])
def test_codes_equal_plain_k_means(spark, monkeypatch, values):
    monkeypatch.setattr(vector_codes, "ENTRIES", 16)
    rows = drawn(90, 8, 3, values) + [(1000 + k, [0.5] * 8, 7) for k in range(40)]
    odd = [(None, None, 1), (7, [None] * 8, 1), (8, [float("nan")] * 8, 1), (9, [float("inf")] + [0.0] * 7, None)]
    rows += [(3, list(rows[3][1]), 2), (3, list(rows[3][1]), 2)]  # repeated ids and rows
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in vector_codes.compress(df, entries=16).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == by_hand(rows + odd, entries=16)


def test_walk_gives_the_lowest_nearest_entry():
    rng = np.random.default_rng(5)
    for spread in (2, 5, 1000):
        rows = rng.integers(-spread, spread, (700, 5))
        book = rng.integers(-spread, spread, (30, 5))
        leaves, which, times = distinct_rows(rows)
        assert (leaves[which] == rows).all() and times.sum() == len(rows)
        assert sorted(map(tuple, leaves.tolist())) == list(map(tuple, leaves.tolist()))
        entry, distance = nearest(leaves, book)
        full = ((leaves[:, None] - book[None]) ** 2).sum(2)
        assert (entry == full.argmin(1)).all() and (distance == full.min(1)).all()


def test_deep_common_prefixes_need_no_recursion():
    rows = np.zeros((3, 5000), np.int64)
    rows[1, -1], rows[2, -1] = 1, 2
    entry, distance = nearest(rows, np.zeros((2, 5000), np.int64))
    assert entry.tolist() == [0, 0, 0] and distance.tolist() == [0, 1, 4]


def test_odd_tables(spark):
    columns = {"vec_id", "code", "error", "label_error", "codebooks_sha256"}
    empty = vector_codes.compress(spark.createDataFrame([], SCHEMA + ", code string"))
    assert set(empty.columns) == columns and empty.count() == 0
    one = vector_codes.compress(spark.createDataFrame([(5, [3e38, -3e38, 0.1, 0.2], None, "x")], SCHEMA + ", code string"))
    assert [tuple(r)[:4] for r in one.collect()] == [(5, "00000000", 0, 0)]
    uneven = vector_codes.compress(spark.createDataFrame([(1, [0.1] * 6, 1), (2, [0.1] * 5, 1), (3, [], 1)], SCHEMA))
    assert [r["vec_id"] for r in uneven.collect()] == [1]
