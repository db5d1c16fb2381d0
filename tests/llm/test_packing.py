import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from stackline.llm import packing as p
from stackline.llm import token_counts as tc
from stackline.llm.queries import TOKENIZER
from stackline.llm.tokens import ChunkOffsets, ChunkTokens


@pytest.fixture(scope="module")
def whole():
    found = Tokenizer.from_file(TOKENIZER)
    found.encode_special_tokens = True
    return lambda text: found.encode(text or "", add_special_tokens=False)


def odd_texts():
    rng = random.Random(4)
    fixed = ["", " ", "a  b", "a\n b", " \n a", " a  b", "x <|endoftext|> y", "é  ç", "don't  we'll", "\t", "a.\u00a0 b,", "it's. ok, , .", "日本, 語。x"]
    return fixed + ["".join(rng.choice(" \n\tab'sé😀1,. ") for _ in range(rng.randint(1, 40))) for _ in range(400)]


def test_chunks_give_the_whole_texts_tokens(whole):
    ids, offsets = ChunkTokens(TOKENIZER), ChunkOffsets(TOKENIZER)
    for text in odd_texts():
        assert np.frombuffer(next(ids.ids([text])), "<u4").tolist() == whole(text).ids
        if text:
            assert [tuple(x) for x in offsets.of_text(text)] == whole(text).offsets


def test_pieces_and_places(make, prose, whole):
    texts = [None, "", *odd_texts()[:20], prose(5000, 1), *[prose(3 + 29 * k, k) for k in range(40)]]
    rows = [*enumerate(texts), (30, texts[30])]
    out = p.pack_documents(make(rows, "offset"), TOKENIZER).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for k, found in by_doc.items():
        ids = np.array([*whole(texts[k]).ids, 0], "<u4")
        for r in found:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        assert sum(r["length"] for r in found) == len(ids) * (2 if k == 30 else 1)
        assert k == 30 or len(found) == math.ceil(len(ids) / 2048)
        assert all(r["length"] == 2048 or r["piece"] == 0 for r in found)
    for found in by_seq.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(by_seq) <= math.ceil(sum(r["length"] for r in out) / 2048) + 1
    assert p.pack_documents(make([(1, "x")]).where("doc_id < 0"), TOKENIZER).collect() == []


def test_plan_uses_every_length_and_is_near_the_bound():
    rng = random.Random(1)
    for least, most, n in ((1, 2048, 3000), (700, 1100, 500), (1, 60, 5000), (1025, 2048, 200)):
        histogram = Counter(rng.randint(least, most) for _ in range(n))
        planned = p.plan(histogram)
        used = Counter()
        for chosen, times in planned:
            assert sum(chosen) <= 2048
            for x in chosen:
                used[x] += times
        assert used == histogram
        large = sum(c for x, c in histogram.items() if x > 1024)
        bound = max(large, math.ceil(sum(x * c for x, c in histogram.items()) / 2048))
        if least < 700:
            assert sum(t for _, t in planned) <= bound * 1.01 + 1


def test_no_other_filling_wastes_less():
    # Only the one odd length fills the room, and it isn't among the longest.
    left = {**{n: 1 for n in range(400, 1600, 2)}, 401: 1}
    assert sum(p.filling(2047, left, sorted(left, reverse=True))) == 2047
    rng = random.Random(6)
    for _ in range(150):
        left = Counter(rng.choice([rng.randint(3, 60), 2 * rng.randint(50, 300)]) for _ in range(rng.randint(1, 40)))
        room, sums = rng.randint(50, 1500), {0}
        for n in left.elements():
            sums |= {x + n for x in sums if x + n <= room}
        lengths = [n for n in sorted(left, reverse=True) if n <= room]
        for chosen in (p.filling(room, left, lengths, 5), p.fullest(room, left, lengths)):
            assert sum(chosen) == max(sums) and not Counter(chosen) - left and chosen == sorted(chosen, reverse=True)


def fewest(items, size):
    """By trying every set of items for the sequence of the first one left."""
    best = {0: 0}

    def of(left):
        if left not in best:
            first = left & -left
            rest, best[left] = left ^ first, len(items)
            some = rest
            while True:
                if sum(items[i] for i in range(len(items)) if (some | first) >> i & 1) <= size:
                    best[left] = min(best[left], 1 + of(rest ^ some))
                if not some:
                    break
                some = (some - 1) & rest
        return best[left]

    return of((1 << len(items)) - 1)


def used(planned):
    out = Counter()
    for chosen, times in planned:
        assert times > 0
        for n in chosen:
            out[n] += times
    return out


def test_search_finds_the_fewest_sequences():
    rng = random.Random(9)
    above = 0
    for k in range(250):
        size = rng.choice([20, 50, 100])
        items = [rng.randint(1, size if k % 2 else size // 2) for _ in range(rng.randint(1, 9))]
        items = [*items, *items[: rng.randint(0, 2)]]
        if k % 5 == 0:  # three full sequences cut in three or four
            cuts = [sorted(rng.sample(range(1, size), rng.choice([2, 2, 3]))) for _ in range(3)]
            items = [b - a for c in cuts for a, b in zip([0, *c], [*c, size], strict=True)]
        histogram, best = Counter(items), fewest(items, size)
        found = p.packing(histogram, size)
        assert used(found.plan) == histogram and all(sum(c) <= size for c, _ in found.plan)
        assert found.sequences == best and found.proven and p.lower_bound(histogram, size) <= best
        first = p.best_fit(histogram, size)
        assert used(first) == histogram and all(sum(c) <= size for c, _ in first)
        above += sum(t for _, t in first) > best
    assert above > 3


def test_perfect_triples_and_the_budget():
    rng = random.Random(12)
    for _ in range(150):
        items = []
        for _ in range(5):
            a = rng.randint(520, 900)
            b = rng.randint(500, 1500 - a)
            items += [a, b, 2048 - a - b]
        found = p.packing(Counter(items))
        assert found.sequences == 5 and found.proven and used(found.plan) == Counter(items)
    stopped = p.packing(Counter(rng.randint(300, 1100) for _ in range(300)), nodes=50)
    assert not stopped.proven and stopped.bound <= stopped.sequences


def test_fillings_are_undominated_and_ordered():
    left = Counter([9, 7, 5, 5, 4, 3, 2])
    lengths = sorted(left, reverse=True)
    got = list(p.completions(left, lengths, 10, 10))
    kept = [c for c in got if c is not None]
    every = {()}
    for n in left.elements():
        every |= {tuple(sorted((*c, n), reverse=True)) for c in list(every) if sum(c) + n <= 10 and c.count(n) < left[n]}
    assert len(got) == len(every) and [sum(c) for c in kept] == sorted((sum(c) for c in kept), reverse=True)

    def replaced(c):
        spare = left - Counter(c)
        subsets = {()}
        for n in c:
            subsets |= {(*x, n) for x in subsets}
        return any(sum(x) + (len(x) == 1) <= n and sum(c) - sum(x) + n <= 10 for n in spare for x in subsets)

    assert set(kept) == {c for c in every if not replaced(c)}


def test_section_tokens(make, prose, whole):
    texts = [None, "", "a\nb", "one\n\n two  three\n", "x\n\n\ny", prose(4000, 2).replace(".", ".\n"), "é\n日本\n"]
    out = tc.section_tokens(make([*enumerate(texts), (2, "a\nb")], "tokens"), TOKENIZER).collect()
    by_doc = defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
    for k, found in by_doc.items():
        times = 2 if k == 2 else 1
        text = "src0\nen\n" + (texts[k] or "")
        enc = whole(text)
        assert {r["doc_tokens"] for r in found} == {len(enc.ids)} and sum(r["tokens"] for r in found) == times * len(enc.ids)
        assert len(found) == times * (2 + len((texts[k] or "").split("\n")))
        for r in found if len(text) < 3000 else ():  # brute force: the section with most of the token's code points, the earlier one if equal
            mine = 0
            bounds = sorted({(x["start"], x["end"]) for x in found})
            for a, b in enc.offsets:
                over = [max(0, min(b, e) - max(a, s)) for s, e in bounds]
                best = over.index(max(over)) if max(over) else max(i for i, (s, e) in enumerate(bounds) if s <= a)
                mine += bounds[best] == (r["start"], r["end"])
            assert r["tokens"] == mine


def test_rules_for_crossing_tokens():
    spans, edges = np.array([[0, 2], [2, 7], [7, 9]]), np.array([0, 3, 5, 9])
    for rule, want in (("first", [2, 0, 1]), ("largest", [1, 1, 1]), ("split", [1.2, 0.4, 1.4])):
        held, crossing = tc.attributed(spans, edges, rule)
        assert np.allclose(held, want) and crossing.tolist() == [1, 1, 1]


def test_states_that_differ_are_kept_apart():
    """Sets of equal count and sum are different states: sequences were lost, and packings called proven, where they met as one."""
    lengths = [411, 823, 814, 876, 367, 805, 503, 1036, 509, 657, 453, 938, 659, 1034, 355]
    found = p.packing({n: lengths.count(n) for n in lengths})
    assert (found.sequences, found.proven) == (5, True)
    rng = random.Random(11)
    for k in range(2000):
        cut = []
        for _ in range(rng.randint(4, 8)):
            a = rng.randint(300, 1000)
            b = rng.randint(300, 2048 - a - 300)
            cut += [a, b, 2048 - a - b]
        found = p.packing({n: cut.count(n) for n in cut})
        assert found.sequences * 2048 == sum(cut) or not found.proven, (k, cut)


def test_ids_do_not_depend_on_chunks_kept():
    import public_tokenizers

    from stackline.llm.tokens import ChunkTokens

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one two, three.", "a\0 b \0c", " lead", "two  spaces and  more", "", None, "x", "tail "]
    few, many = ChunkTokens.of(path, 1), ChunkTokens.of(path, 1000)
    want = [few.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for made in (few, many):
        assert [[int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b), 4)] for b in made.ids(texts)] == want
