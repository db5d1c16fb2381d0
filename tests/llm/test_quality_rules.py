import re
from collections import Counter

from stackline.llm import quality_rules as q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(wins)
    inside = {k for i, w in enumerate(wins) if often[w] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_figures_and_cases(make, prose):
    texts = [None, "", " \n\t", "one", "a b c a b c a b", "x\nx\n\n \nx", prose(300, 1), prose(60, 2) + "\n" + prose(60, 2), "é\u00a0ü " * 60, "#a *b " * 40, "WORD! " * 80, prose(30_000, 3)]
    rows = list(enumerate(texts)) + [(6, texts[6])]
    out = q.quality_report(make(rows, "kept")).collect()
    assert len(out) == len(rows)
    for r in out:
        d = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == d
        assert r["base_failed"] == (d[0] < 50 or 100 * d[4] > 50 * d[0])
        assert not (r["kept"] and r["base_failed"])
    kept = {r["doc_id"] for r in out if r["kept"]}
    assert 6 in kept and 11 in kept and not kept & {0, 1, 2, 3, 9, 10}


def test_order_never_changes_the_verdict(make, prose):
    docs = make([(i, prose(20 + 10 * i, i) + "!#" * (i % 40)) for i in range(40)])
    names = list(q.RULES)
    one = {r["doc_id"]: r["kept"] for r in q.quality_report(docs, names).collect()}
    assert one == {r["doc_id"]: r["kept"] for r in q.quality_report(docs, names[::-1]).collect()}
    assert sorted(q.rule_order(docs)) == sorted(names)
    assert {r["doc_id"] for r in q.keep_documents(docs).collect()} == {k for k, v in one.items() if v}


def test_cascade_counts_only_what_rules_ask_for(make, prose):
    d = q.Text(prose(20, 1))
    assert q.rejected_by(d, ["few_words", "repeats", *q.RULES]) == "few_words" and set(d.__dict__) == {"text", "words"}
    junk = q.Text("#$% " * 100)
    assert q.rejected_by(junk, ["symbols", "few_words", "repeats"]) == "symbols" and "n_repeat_words" not in junk.__dict__
    # A costly rule that rejects little goes behind a cheap one that rejects much, and rules see what is left by those before.
    slow = lambda d: bool(sorted(d.text * 300)) and d.text.startswith("b")
    docs = make([(k, ("a" if k % 2 else "b" if k % 8 else "c") * 30) for k in range(4000)])
    order = q.cascade_order(docs, {"slow": slow, "cheap": lambda d: d.text[0] == "a", "none": lambda d: False})
    assert order.index("cheap") < order.index("slow")


def test_reasons(make, prose):
    rows = [(1, prose(20, 1)), (2, "one two three " * 40), (3, "#$% " + prose(60, 2).replace(" ", " #$% ")), (4, prose(100, 3)), (5, None)]
    for order in (list(q.RULES), list(q.RULES)[::-1]):
        out = {r["doc_id"]: r["rejected_by"] for r in q.quality_report(make(rows), order, reason=True).collect()}
        assert out[1] == out[5] == "few_words" and out[2] == "repeats" and out[3] in q.RULES and out[4] is None


def test_empty_table_and_columns(make):
    empty = make([(1, "x")], "words").where("doc_id < 0")
    assert q.quality_report(empty).collect() == [] and q.keep_documents(empty).columns == empty.columns
