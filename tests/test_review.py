import os

import pytest
from pyspark.sql import functions as F

from stackline.functions import shared, surface
from stackline.functions.signature import open_ended, signature
from stackline.functions.codes import chronology, year
from stackline.operators import audit, convert, detect, exposure, parse, preview, roles, rules
from stackline.plans import holdings
from stackline.sources import marc

STATEMENTS = [
    "v. 1 no. 2 (Jan 1990)", "v. 3 no. 4 (Feb 1991)", "v.1(1990)-v.4(1995)", "v. 7 (1990)-", "v. 1 nos. 3, 5 (1990)", "1990: 3 (5 [Jan])", "12 ?", "v.1(1990), v.2(1992)",
    "Vol. 3, no. 5 (1990)", "1990", "no. 5", "v. 2 (Late 1990)", "text only", "(1990) 5: 7-9", "v. 1 no. 2 (Jan & Feb 1990)", None, " ",
]


@pytest.fixture(scope="module")
def stmts(spark):
    return spark.createDataFrame([(x,) for x in STATEMENTS], "stmt string").repartition(3)


def test_only_whole_values_are_announced(spark):
    fields = lambda *pairs: [[{"code": c, "value": v} for c, v in pairs]]
    rows = [
        ("v. 1 no. 7 (1990)", fields(("b", "7"), ("i", "1990")), ["unplaceable:e1:9"], "loss"),
        ("v. 1 no. 7 (1990)", fields(("b", "7"), ("i", "1990")), ["caption_conflict:e2:12"], "loss"),
        ("v. 1 no. 7 (1990)", fields(("b", "7"), ("i", "1990")), ["unplaceable:e1:1"], "warn"),
        ("v. 1 no. 7 (1990)", fields(("b", "7"), ("i", "1990")), ["unplaceable:e1:1-2"], "warn"),
        ("v. 1 no. 7 (1990)", fields(("b", "7"), ("i", "1990")), ["segment_skipped"], "loss"),
        ("v. 1 (Jan & Feb 1990)", fields(("a", "1")), ["uncodeable:year:Jan & Feb 1990"], "warn"),
        ("v. 1 (1990)", fields(("a", "1"), ("i", "1990")), [], "ok"),
    ]
    df = spark.createDataFrame([(*r[:3], "ok") for r in rows], "stmt string, f863 array<array<struct<code:string,value:string>>>, warnings array<string>, status string")
    got = sorted((r["stmt"], r["warnings"], r["verdict"]) for r in audit.conserved(df).collect())
    assert got == sorted((r[0], r[2], r[3]) for r in rows)
    said = df.select(F.explode(audit.structured(F.array(*map(F.lit, ("unplaceable:e1:9", "not_encoded:a:b", "marker_ignored"))))).alias("w")).select("w.*").distinct().collect()
    assert sorted(map(str, map(tuple, said))) == sorted(map(str, [("unplaceable", "e1", "9"), ("not_encoded", None, "a:b"), ("marker_ignored", None, None)]))


def test_ends_of_ranges(spark):
    texts = {
        "v. 3 no. 5 (1990)-v. 6 no. 5 (1995)": "a 3-6|b 5|i 1990-1995",
        "v. 43 no. 6 (1990)-v. 43 no. 7 (1995)": "a 43|b 6-7|i 1990-1995",
        "v. 1 (1990)-v. 55 no. 3 (1995)": "a 1-55|i 1990-1995",
        "v. 3 no. 1 (1990)-v. 5 no. 4 (Dec 1995)": "a 3-5|b 1-4|i 1990-1995|j 12",
        "v. 2 (Late 1990)": "a 2|i 1990|j Late",
    }
    declared = "a v.|b no.|i (year)|j (month)"
    pairs = lambda c: F.transform(F.split(c, r"\|"), lambda x: F.struct(F.substring(x, 1, 1).alias("code"), F.substring(x, 3, 99).alias("value")))
    df = spark.createDataFrame(list(texts.items()), "stmt string, w string")
    written = parse.parse_distinct(df).join(df.select("stmt", pairs(F.col("w")).alias("v863"), pairs(F.lit(declared)).alias("declared")), "stmt")
    got = {r["stmt"]: r for r in audit.endpoints(written.withColumn("warnings", F.array(F.lit("unplaceable:e2:3")))).collect()}
    first, same, end, phantom, prose = (got[x] for x in texts)
    assert first["collapsed"] == ["$b 5-5"] and same["collapsed"] == [] and first["undeclared"] == ["j"]
    assert end["end_only"] == ["$b 3"] and end["end_only_silent"] == [] and end["undeclared"] == ["b", "j"]
    assert phantom["phantom"] == ["$j 12"] and phantom["collapsed"] == [] and prose["prose"] == ["$j Late"] and prose["phantom"] == []
    # What the converter itself writes has none of this but captions that stay empty and ends that it warns of.
    own = convert.values(parse.parse_distinct(df)).withColumn("declared", convert.caption_field())
    for r in audit.endpoints(own).collect():
        assert r["collapsed"] == r["phantom"] == r["prose"] == r["end_only_silent"] == []


def test_drift_joins_null_keys_and_passes_known_ones(spark):
    kind = "file string, line int, verdict string"
    a = spark.createDataFrame([("f", 1, "ok"), ("f", 2, "warn"), (None, 3, "loss"), ("f", 4, "known"), ("f", 5, "ok"), ("f", None, "fail"), ("g", 1, "warn")], kind)
    b = spark.createDataFrame([("f", 1, "loss"), ("f", 2, "ok"), (None, 3, "loss"), ("f", 4, "fail"), ("f", 6, "ok"), ("f", None, "fail"), ("g", 1, "loss")], kind)
    got = {(r["file"], r["line"]): r["drift"] for r in audit.drift(a, b, ["file", "line"]).collect()}
    assert got == {("f", 1): "broken", ("f", 2): "fixed", (None, 3): "unchanged", ("f", 4): "unchanged", ("f", 5): "gone", ("f", 6): "new", ("f", None): "unchanged", ("g", 1): "changed"}
    assert audit.drift(a.limit(0), b.limit(0), ["file", "line"]).count() == 0


def test_partial_fits_equal_all_pairs(spark, stmts):
    found = exposure.exposed(stmts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    patterns = detect.patterns(stmts).where("pattern is not null")
    pairs = detect.members(stmts).select("stmt").crossJoin(patterns.select("signature", "pattern", "statements")).where("not stmt rlike pattern")
    part = F.expr("regexp_extract(stmt, concat('(?is)(', regexp_replace(pattern, '^\\\\(\\\\?is\\\\)\\\\^|\\\\$$', ''), ')'), 1)")
    each = pairs.withColumn("matched", part).where("matched <> ''").select("stmt", F.struct((F.length("matched") / F.length("stmt")).alias("s"), (-F.col("statements")).alias("n"), "signature", "matched").alias("b"))
    want = {r["stmt"]: (r["b"]["signature"], r["b"]["matched"]) for r in each.groupBy("stmt").agg(F.min("b").alias("b")).collect()}
    assert {r["stmt"]: (r["signature"], r["matched"]) for r in found.collect()} == want and len(want) > 8
    assert exposure.exposed(stmts.limit(0)).count() == 0


def test_families_of_clusters_are_components(spark, monkeypatch):
    rows = [("s1", "x", "c1"), ("s2", "x", "c2"), ("s3", "y", "c2"), ("s4", "y", "c4"), ("s5", "z", "c5")]
    df = spark.createDataFrame(rows, "signature string, label string, coarse string").withColumn("statements", F.lit(1))
    monkeypatch.setattr(detect, "labels", lambda statements, column: statements)
    assert {r["signature"]: r["family"] for r in detect.confusable(df).collect()} == {"s1": "s1", "s2": "s1", "s3": "s1", "s4": "s1", "s5": "s5"}


def test_statistics_and_annotations(spark, stmts):
    got = {(r["scope"], r["key"]): r for r in detect.statistics(stmts).collect()}
    whole = got["all", None]
    assert whole["statements"] == 15 and whole["clusters"] == sum(r["clusters"] for k, r in got.items() if k[0] == "shape") and whole["imperfect"] == 0
    shape = next(r for (scope, _), r in got.items() if scope == "shape" and r["clusters"] == 2)
    assert shape["statements"] == 3  # months joined by a sign are the shape of single months
    placed = stmts.withColumn("rec", F.lit(1)).withColumn("pos", F.monotonically_increasing_id())
    out = detect.annotated(placed, ["rec", "pos"], spark.createDataFrame([("NUMBER|UNKNOWN", "reading")], "signature string, decides string"), k=1)
    by = {r["signature"]: r for r in out.collect()}
    months = next(r for r in by.values() if r["statements"] == 2)
    assert months["examples"] == ["v. 1 no. 2 (Jan 1990)"] and [(v["group"], v["values"]) for v in months["values"]] == [("startvol", ["1"]), ("startiss", ["2"]), ("startmonth", ["Feb"]), ("startyear", ["1990"])]
    assert by["NUMBER|UNKNOWN"]["needs_decision"] and not months["needs_decision"]
    many = spark.createDataFrame([("k", f"x{i:03}", i % 7) for i in range(300)] + [("j", "y", 1)], "key string, x string, n int")
    top = [(r["key"], r["x"]) for r in detect.top(many, ["key"], [F.desc("n"), F.col("x")], 3).orderBy("key", "turn").collect()]
    assert top == [("j", "y"), ("k", "x006"), ("k", "x013"), ("k", "x020")]


def test_preview_equals_a_full_run(spark, stmts):
    library, _ = rules.loaded(holdings.PATTERNS)
    roles = [{"group": "startvol", "boundary": "start", "kind": "enum", "level": 1}]
    more, _ = rules.loaded([{"id": f"p{k}", "regex": rf"never {k} (?<startvol>\d+)", "roles": roles} for k in range(70)])
    for patterns in (library, [*more, *library], []):
        kept = preview.fits(stmts, patterns)
        full = {r["stmt"]: r["source"] for r in rules.sourced(stmts.distinct(), patterns).collect()}
        assert {r["stmt"]: r["source"] for r in preview.winners(kept, patterns).collect()} == full
        candidate = {"id": "new", "label": "new", "regex": r"v\. ?(?<startvol>\d+).*", "skip": False, "roles": roles}
        for place in (0, len(patterns)):
            after = {r["stmt"]: r["source"] for r in rules.sourced(stmts.distinct(), [*patterns[:place], candidate, *patterns[place:]]).collect()}
            changes = preview.changed(kept, patterns, candidate, place)
            assert {r["stmt"]: (r["before"], r["after"]) for r in changes.collect()} == {s: (full[s], after[s]) for s in full if full[s] != after[s]}
    rows = spark.createDataFrame([(1, "v. 1 (1990)"), (1, "12 ?"), (2, "12 ?"), (3, "v. 1 (1990)"), (3, "v. 1 (1990)")], "rec int, stmt string")
    touched = preview.records_changed(rows, preview.changed(preview.fits(rows, library), library, candidate))
    assert {r["rec"]: r["statements"] for r in touched.collect()} == {1: 1, 3: 2}


def test_records_kept_separate_are_numbered_strictly(spark):
    rows = spark.createDataFrame([(r, k, s) for r in (1, 2, 3, 4) for k, s in enumerate(["v. 1 (1990)", "v. 2 (Jan 1991)", "v. 3 (1992)"])], "rec int, k int, stmt string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "rec int")
    out = preview.records(rows, ["k"], chosen=ids(1, 2, 4, 4, 9), skipped=ids(4), separate=ids(2, 3))
    links = {}
    for r in out.orderBy("rec", "k").collect():
        links.setdefault((r["rec"], r["separate"]), []).append((r["link"], r["first_seq"]))
    assert links == {(1, False): [(1, 1), (1, 2), (1, 3)], (2, True): [(1, 1), (2, 1), (3, 1)]}
    plan = preview.page(rows, ids(1), ids(2))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "LeftAnti" in plan
    assert preview.records(rows, ["k"]).where("separate").count() == 0


def test_ingest_refuses_before_it_keeps_anything(spark, tmp_path):
    sub = lambda v: [{"code": "a", "value": v}]
    fields = lambda k: [{"pos": 0, "tag": "001", "data": str(k), "ind1": None, "ind2": None, "subfields": []}, *({"pos": 0, "tag": "866", "data": None, "ind1": " ", "ind2": "0", "subfields": sub(s)} for s in (f"v. {k} (1990)", f"v. {k + 1} (1991)"))]
    schema = "rec_idx int, leader string, fields array<struct<pos:int,tag:string,data:string,ind1:string,ind2:string,subfields:array<struct<code:string,value:string>>>>"
    marc.write_marc(spark.createDataFrame([(k, "00000nas a2200000 a 4500", fields(k)) for k in range(30)], schema), f"file://{tmp_path}/good")
    assert marc.ingest(spark, f"file://{tmp_path}/good", f"file://{tmp_path}/in") == {"records": 30, "fields": 60, "statements": 60}
    assert sorted(os.listdir(tmp_path)) == ["good", "in"]
    assert spark.read.parquet(f"file://{tmp_path}/in/statements").count() == 60 and spark.read.parquet(f"file://{tmp_path}/in/records").count() == 30
    with pytest.raises(FileExistsError):
        marc.ingest(spark, f"file://{tmp_path}/good", f"file://{tmp_path}/in")
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "good").glob("part-*")))
    records = raw.split(b"\x1d")
    records[3] = records[3][:12] + b"9" + records[3][13:]
    (tmp_path / "bad.mrc").write_bytes(b"\x1d".join(records))
    with pytest.raises(ValueError, match="by place: 4"):
        marc.ingest(spark, f"file://{tmp_path}/bad.mrc", f"file://{tmp_path}/out")
    assert sorted(os.listdir(tmp_path)) == ["bad.mrc", "good", "in"]


def test_functions_of_sql_equal_the_columns(spark, stmts):
    surface.register(spark)
    stmts.createOrReplaceTempView("review_statements")
    got = {r[0]: tuple(r)[1:] for r in spark.sql("SELECT stmt, holdings_signature(stmt), holdings_open(stmt) FROM review_statements").collect()}
    want = {r[0]: tuple(r)[1:] for r in stmts.select("stmt", signature(F.col("stmt")), open_ended(F.col("stmt"))).collect()}
    assert got == want
    tokens = spark.sql("SELECT t.* FROM review_statements, LATERAL holdings_tokens(stmt) AS t WHERE stmt = 'v. 7 (1990)-' ORDER BY place")
    assert [(r["kind"], r["text"]) for r in tokens.collect()] == [("VOL_CAP", "v."), ("NUMBER", "7"), ("PAREN_OPEN", "("), ("YEAR", "1990"), ("PAREN_CLOSE", ")"), ("SEP_HYPHEN", "-")]
    assert "Python" not in tokens._jdf.queryExecution().executedPlan().toString()
    words = spark.createDataFrame([("1996/97",), ("1999/00",), ("1990",), ("Jan.",), ("Late",)], "w string")
    assert [tuple(r) for r in words.selectExpr("w", "holdings_year(w)", "holdings_chronology(w)").collect()] == [tuple(r) for r in words.select("w", year(F.col("w")), chronology(F.col("w"))).collect()]


def test_partial_fits_leave_all_rows_behind(spark, stmts, tmp_path):
    at = str(tmp_path / "rows")
    stmts.write.parquet(at)
    rows = spark.read.parquet(at)
    assert rows.inputFiles()
    # What is asked of different statements must not be asked of every row.
    assert not [f for f in exposure.exposed(rows).inputFiles() if at in f]


def test_annotated_clusters_leave_rows_behind_that_hold_no_first_place(spark, tmp_path):
    texts = ["v. 1 (1990)", "v. 2 (1991)", " v. 3 (1992)", "1 ?", "2 ?", "no. 5"]
    rows = [(None if k == 3 else k, k % 2, texts[k % 6]) for k in range(60, 0, -1)]
    spark.createDataFrame(rows, "rec int, pos int, stmt string").write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    members = detect.members(df, head="rec")
    assert not [f for f in members.inputFiles() if str(tmp_path / "rows") in f]
    decided = roles.decides(members, parse.parse_distinct(members))
    want = {}
    for rec, pos, stmt in rows:  # null goes first
        key, place = stmt.strip()[0].replace("2", "1") + stmt[-1], (rec is not None, rec or 0, pos)
        want[key] = min(want.get(key, place), place)
    out = detect.annotated(df, ["rec", "pos"], decided, found=members)
    got = {e["examples"][0].strip()[0].replace("2", "1") + e["examples"][0][-1]: (e["first"]["rec"] is not None, e["first"]["rec"] or 0, e["first"]["pos"]) for e in out.collect()}
    assert got == want and sum(r["statements"] for r in out.collect()) == 60
    assert not [f for part in (out, decided) for f in part.inputFiles() if str(tmp_path / "rows") in f]


def test_members_are_counted_before_texts_are_trimmed(spark, monkeypatch):
    rows = [(5, "v. 1"), (3, " v. 1"), (None, "v. 1\t"), (2, "v. 2"), (4, "v. 2"), (1, None), (1, " "), (1, "")]
    df, seen = spark.createDataFrame(rows * 3, "rec int, stmt string").repartition(3), []
    monkeypatch.setattr(detect, "settled", lambda df: seen.append(df) or shared.settled(df))
    found = detect.members(df, head="rec")
    assert {r["stmt"]: (r["copies"], r["least"], r["headless"]) for r in found.collect()} == {"v. 1": (9, 3, True), "v. 2": (6, 2, False)}
    assert {r["stmt"]: r["copies"] for r in detect.members(df).collect()} == {"v. 1": 9, "v. 2": 6}
    # Nothing but a count and the least place is asked of every row.
    for plan in (x._jdf.queryExecution().optimizedPlan().toString() for x in seen):
        assert "regexp" not in plan[plan.rindex("Aggregate [") :] and "regexp" in plan, plan


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_decided_clusters_make_each_row_s_text_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(detect, "settled", lambda df: seen.append(df) or shared.settled(df))
    out = holdings.clusters_decide(spark, "/root/testdata/sf0.001")
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.rindex("Aggregate [") :].count(" nos. ") == 1, plan
    assert len(seen) == 1 and not [f for f in out.inputFiles() if "lineitem" in f]
