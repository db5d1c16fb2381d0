import hashlib
import re

from stackline.llm import decontaminate as d


def words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(text, items):
    w, hit, names = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(13, len(b))
        wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                if item is not None:
                    names.add(str(item))
    said = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(w), len(hit), len(names), said, bool(hit) and 20 * len(hit) >= len(w)


def data(prose):
    items = [(1, prose(40, 1)), (2, prose(13, 2)), (3, "Short one, É!"), (4, None), (5, "..."), (10, prose(40, 1)), (None, prose(20, 3)), (2, prose(13, 2)), (7, "the the the the the the the the the the the the the the the the")]
    texts = [None, "", "..", prose(50, 9), items[0][1], "x " + items[1][1].upper() + " y", "a short ONE é b", prose(600, 8) + " " + " ".join(items[0][1].split()[5:18]), " ".join(items[0][1].split()[5:17]), items[6][1], "the " * 5000, prose(20_000, 5) + items[0][1], items[1][1] + items[0][1]]
    return items, [*enumerate(texts), (4, texts[4])]


def test_brute_force_one_block_and_many(spark, make, prose):
    items, rows = data(prose)
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), make(rows, "n_hit")
    want = sorted((i, *brute(t, items)) for i, t in rows)
    assert sorted(map(tuple, d.contamination_report(docs, bench).collect())) == want
    found = d.marked(docs, bench, ["doc_id"], limit=300)  # several blocks
    assert sorted((r["doc_id"], r[d.N_WORDS], r[d.N_HIT], len(r[d.ITEMS])) for r in found.collect()) == [x[:4] for x in want]
    kept = d.keep_documents(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(x[0] for x in want if not x[5]) and kept.columns == docs.columns


def test_empty_tables(spark, make, prose):
    items, rows = data(prose)
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), make(rows)
    assert d.contamination_report(docs.where("doc_id < 0"), bench).collect() == []
    none = d.contamination_report(docs, bench.where("item_id < 0")).collect()
    assert len(none) == len(rows) and not any(r["n_hit"] or r["contaminated"] for r in none)
