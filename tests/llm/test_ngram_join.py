import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackline.llm import ngram_join as g
from stackline.llm.components import components


def shingles(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    comp = {i: i for i, _ in rows}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                comp[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


def changed(text, n, rng):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows(prose):
    rng = random.Random(3)
    texts = [None, "", "  ", "One two", "one TWO", "a b c d e", "a b c d e f", "a b c d e f g", "a b c d e f g h", "b c d e f g h i"]
    passage = prose(60, 99)
    for k in range(25):  # families of copies, near copies and copies of these
        base = prose(rng.choice([8, 15, 40, 120, 400]), k)
        for _ in range(rng.randint(1, 5)):
            near = changed(base, rng.randint(0, max(1, len(base.split()) // 20)), rng)
            texts += [base, near, changed(near, max(1, len(base.split()) // 30), rng)]
    texts += [passage + " " + prose(rng.randint(5, 120), 500 + k) for k in range(60)]
    chain = prose(200, 77).split()
    texts += [" ".join(chain[k * 8 : k * 8 + 110]) for k in range(9)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)]


def test_components_match_brute_force(make, rows):
    out = sorted(map(tuple, g.document_components(make(rows, "component_id")).collect()))
    assert out == brute(rows)


def test_salted_groups_and_blocks_lose_nothing(make, rows, monkeypatch):
    # The same, where every frequent signature is dealt over groups and every block is small.
    monkeypatch.setattr(g, "BLOCK", 3)
    out = sorted(map(tuple, g.document_components(make(rows)).collect()))
    assert out == brute(rows)


def noted_signatures(monkeypatch, what):
    """A list that gets ``what`` of each table of signatures."""
    seen, whole = [], g._groups
    monkeypatch.setattr(g, "_groups", lambda x: seen.append(x.agg(what).first()[0]) or whole(x))
    return seen


@pytest.mark.parametrize("sent", [2_000_000, 0])
def test_copies_give_signatures_once(make, monkeypatch, sent):
    monkeypatch.setattr(g, "SENT_IDS", sent)
    seen = noted_signatures(monkeypatch, F.count(F.lit(1)) / F.countDistinct("sig", "key"))
    text = " ".join(f"x{k}" for k in range(60))
    copies = [(k, text) for k in range(200)] + [(200 + k, changed(text, 1, random.Random(k))) for k in range(3)]
    assert sorted(map(tuple, g.document_components(make(copies)).collect())) == brute(copies)
    assert seen[0] == 1 if sent else seen[0] <= 3  # make() deals rows over three tasks


def test_groups_dealt_by_salt_lose_nothing(make, rows, monkeypatch):
    monkeypatch.setattr(g, "GROUP", 5)
    monkeypatch.setattr(g, "BLOCK", 3)
    seen = noted_signatures(monkeypatch, F.max("salt"))
    assert sorted(map(tuple, g.document_components(make(rows)).collect())) == brute(rows)
    assert seen[0] > 0


def link_counts(rows):
    """For each row, the ids of other rows that it links with, counted."""
    sets = [(i, shingles(t)) for i, t in rows]
    return {i: len({j for j, b in sets if j != i and a and b and 100 * len(a & b) >= 75 * len(a | b)}) for i, a in sets}


@pytest.mark.parametrize("block", [3, 1000])
def test_links_are_counted_within_components(make, rows, monkeypatch, block):
    monkeypatch.setattr(g, "LINK_BLOCK", block)
    rng = random.Random(8)
    base = changed(" ".join(f"x{k}" for k in range(150)), 1, rng)
    more = [(1000 + k, changed(base, 1 + k % 3, rng)) for k in range(25)]  # near copies of one text, most of them linked with each other
    more += [(1100 + k, more[0][1]) for k in range(3)]
    out = {r["doc_id"]: r for r in g.document_components(make([*rows, *more, more[1]]), links=True).collect()}
    want = link_counts([*rows, *more])
    assert {i: r["n_links"] for i, r in out.items()} == want and max(want.values()) > 20
    assert sorted((i, r["n_shingles"], r["component_id"]) for i, r in out.items()) == brute([*rows, *more])


def test_one_of_each_group_stays(make, rows):
    want = {i for i, _, c in brute(rows) if i == c}
    docs = make([*rows, rows[5], *rows[:3]], "__x")
    kept = g.keep_one(docs).collect()
    ids = [r["doc_id"] for r in kept]
    empty = {i for i, t in rows if not (t or "").strip()}
    assert set(ids) == want and all(ids.count(i) == 1 for i in want - empty)


def test_repeated_ids_of_different_texts_keep_what_is_nobodys_copy(make, prose):
    a, b, c, d = (prose(60, 300 + k) for k in range(4))
    near = lambda t: t + " more"
    rows = [(5, a), (5, b), (3, c), (7, c), (7, d)]
    rows += [(15, e := prose(60, 310)), (15, near(e)), (16, e)]
    rows += [(25, f := prose(60, 311)), (25, f), (25, h := prose(60, 312)), (24, near(h))]
    rows += [(31, ""), (31, ""), (31, i := prose(60, 313)), (32, i), (None, i), (None, i)]
    docs = make(rows, "key")
    kept = g.keep_one(docs)
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert kept.columns == docs.columns
    assert len([t for k, t in got if k == 15]) == 1  # either of two linked texts of one id
    assert sorted((str(k), t) for k, t in got if k != 15) == sorted((str(k), t) for k, t in [(3, c), (5, a), (5, b), (7, d), (24, near(h)), (25, f), (None, i), (None, i), (31, ""), (31, ""), (31, i)])


def test_a_very_long_word(make, prose):
    rows = [(1, "x" * 3_000_000 + " " + prose(80, 1)), (2, "x" * 3_000_000 + " " + prose(80, 1)), (3, "y" * 2_000_000)]
    assert sorted(map(tuple, g.document_components(make(rows)).collect())) == brute(rows)


def test_null_ids_and_empty_table(make):
    docs = make([(None, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e f")])
    assert sorted((str(r[0]), r[1], r[2]) for r in g.document_components(docs).collect()) == [("2", 2, 2), ("3", 2, 2), ("None", 2, None)]
    assert len(g.keep_one(docs).collect()) == 2
    assert g.document_components(docs.where("doc_id = 9")).collect() == [] and g.keep_one(docs.where("doc_id = 9")).collect() == []


@pytest.mark.parametrize("subsets", [0, 64, 10**9])
@pytest.mark.parametrize("second", [2, 3, 5])
def test_linked_sets_share_a_signature(monkeypatch, subsets, second):
    """Any two sets that link share a signature, whatever the order by counts and the subsets."""
    monkeypatch.setattr(g, "SUBSETS_UP_TO", subsets)
    monkeypatch.setattr(g, "SECOND", second)
    monkeypatch.setattr(g, "SPOILED", 1 if second < 5 else 2)
    rng = np.random.default_rng(5)
    counts = rng.integers(1, 50, 1 << g.SKETCH_BITS)
    linked = 0
    for _ in range(2500):
        n = int(rng.choice([2, 3, 4, 5, 6, 9, 14, 15, 16, 17, 30, 60, 63, 64, 100, 250]))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        gone, new = int(rng.integers(0, n // 5 + 2)), int(rng.integers(0, n // 4 + 2))
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, new, dtype=np.uint64)]))
        a = np.unique(a)
        if len(b) and g.links(a, b) and a.tobytes() != b.tobytes():
            linked += 1
            assert np.intersect1d(g.signatures(a, counts)[0], g.signatures(b, counts)[0]).size
            assert np.abs(g.histogram(a).astype(int) - g.histogram(b)).sum() <= g.most_different(len(a), len(b))
    assert linked > 600


@pytest.mark.parametrize("subsets", [0, 10**9])
def test_subsets_in_all_bands_or_none(make, rows, monkeypatch, subsets):
    monkeypatch.setattr(g, "SUBSETS_UP_TO", subsets)
    assert sorted(map(tuple, g.document_components(make(rows)).collect())) == brute(rows)


def test_packed_histograms_bound_what_differs():
    rng = np.random.default_rng(5)
    sets, pairs = [], []
    for n, differ in ((1, 0), (40, 9), (900, 200), (900, 700), (20_000, 4_000), (200_000, 60_000), (200_000, 5)):
        a = np.unique(rng.integers(0, 1 << 63, n, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        b = np.unique(np.concatenate([a[differ:], rng.integers(0, 1 << 63, differ, np.int64).astype(np.uint64)]))
        pairs.append((len(sets), len(sets) + 1))
        sets += [a, b]
    h, n = g.counters([g.packed(u) for u in sets]), np.array([len(u) for u in sets])
    x, y = np.array(pairs).T
    differing = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in pairs])
    assert (g.apart(h[x], h[y]) <= differing).all()
    assert (g.apart(h[x], h[y]) == g.apart(h[y], h[x])).all()
    kept = set(g.near(h, n, x, y).tolist())
    assert kept >= {k for k, (a, b) in enumerate(pairs) if g.links(sets[a], sets[b])}
    assert 3 not in kept  # 700 of 900 differ
    assert not len(g.near(h, n, x[:0], y[:0]))
    for k in (2, 6):  # counters far apart in value, close modulo 16
        assert np.abs(g.histogram(sets[2 * k]) - g.histogram(sets[2 * k + 1])).sum() <= differing[k]


def test_sketch_counts(make, prose):
    rows = [(k, "a common passage of seven words here " + prose(30, k)) for k in range(300)]
    docs = make(rows)
    bits = g.sketch_bits(docs)
    parts = g._sets(docs.select("doc_id", "text"), g.SIZE, 0, bits).where("slice is not null").select("slice", "part", "counts")
    counts = g._sketch(parts, bits)
    common = g.sets_with(g.commonness(g.shingle_set("a common passage of seven"), counts))
    assert bits == g.SKETCH_BITS and counts.shape == (g.SKETCH_ROWS, 1 << bits) and counts.dtype == np.uint8 and 270 < common[0] < 330
    assert (g.sets_with(g.commonness(g.shingle_set(prose(30, 5)), counts)) <= 2).all()
    some = np.arange(1000, dtype=np.uint64) * np.uint64(7)
    assert (g._unpacked(g._packed(some), 1000) == some).all()


def test_components_of_links(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    out = {r["key"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert out == {x: find(x) for x in parent if any(a != b and x in (a, b) for a, b in links)}
