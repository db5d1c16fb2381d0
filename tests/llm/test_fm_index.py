import numpy as np
import pytest

from stackline.llm.fm_index import FMIndex, WaveletTree, canonical_codes, code_lengths, suffix_array


@pytest.mark.parametrize("symbols", [1, 2, 5, 300])
def test_ranks_of_the_wavelet_tree(symbols):
    rng = np.random.default_rng(symbols)
    text = np.minimum(rng.geometric(0.02, 700) - 1, symbols - 1)
    tree = WaveletTree(text, symbols)
    for s in np.unique(text):
        at = np.arange(len(text) + 1)
        assert (tree.rank(np.full(len(at), s), at) == np.concatenate([[0], np.cumsum(text == s)])).all()


def test_frequent_symbols_have_short_codes():
    counts = np.array([500, 0, 1, 1, 90, 7])
    lengths = code_lengths(counts)
    assert lengths[0] == 1 and lengths[1] == 0 and lengths[2] == max(lengths)
    written = sorted(f"{c:0{n}b}" for c, n in zip(canonical_codes(lengths), lengths) if n)
    assert not any(b.startswith(a) for a, b in zip(written, written[1:]))


@pytest.mark.parametrize("symbols", [1, 2, 40, 1 << 40])
def test_suffixes_in_order(symbols):
    text = np.random.default_rng(symbols % 97).integers(0, symbols, 400)
    assert suffix_array(text).tolist() == sorted(range(400), key=lambda i: text[i:].tolist())


@pytest.mark.parametrize("symbols,threshold", [(2, 6), (3, 4), (30, 3), (4, 20)])
def test_matching_statistics(symbols, threshold):
    rng = np.random.default_rng(symbols)
    sequences = [rng.integers(1, symbols + 1, rng.integers(1, 60)) for _ in range(25)]
    sequences += [sequences[3], sequences[4][5:], np.full(50, 1)]
    index = FMIndex(sequences, symbols + 1, threshold)
    windows = {}
    for s in sequences:
        for i in range(len(s)):
            for n in range(1, threshold + 1):
                if i + n <= len(s):
                    windows[tuple(s[i : i + n].tolist())] = windows.get(tuple(s[i : i + n].tolist()), 0) + 1
    asked = sequences[:6] + [rng.integers(1, symbols + 1, 40) for _ in range(10)] + [np.array([1, -1, 1, 1])]
    lengths = np.array([len(s) for s in asked])
    matrix = np.full((len(asked), lengths.max()), -1)
    for row, s in zip(matrix, asked):
        row[: len(s)] = s
    matched, low, high = index.matching_statistics(matrix, lengths)
    seen = {}
    for k, s in enumerate(asked):
        for i in range(len(s)):
            most = max((n for n in range(1, min(threshold, len(s) - i) + 1) if tuple(s[i : i + n].tolist()) in windows), default=0)
            assert matched[k, i] == most
            if most:
                word = tuple(s[i : i + most].tolist())
                assert high[k, i] - low[k, i] == windows[word]
                assert seen.setdefault(word, low[k, i]) == low[k, i]


def test_empty_index():
    index = FMIndex([], 1, 5)
    assert index.size == 0
