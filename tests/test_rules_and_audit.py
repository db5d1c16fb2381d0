"""Signatures, the pattern library and audits."""

import pytest
from pyspark.sql import functions as F

from stackline.functions.signature import coarse, kinds_of, label, range_separator, signature
from stackline.operators import audit, convert, parse, rules
from stackline.plans.holdings import PATTERNS


def test_signatures(spark):
    want = {
        "1799": "NUMBER", "1800": "YEAR", "2099": "YEAR", "2100": "NUMBER", "Nov. 3": "CHRON|NUMBER", "innov": "UNKNOWN", "no. 3": "ISS_CAP|NUMBER", "v.1-2": "VOL_CAP|NUMBER|SEP_HYPHEN|NUMBER",
        "v. 1-2 (1990)- v. 3": "VOL_CAP|NUMBER|PAREN_OPEN|YEAR|PAREN_CLOSE|SEP_HYPHEN|VOL_CAP|NUMBER", "some free text": "UNKNOWN", "": "", "1996/97": "YEAR",
    }
    out = {r["s"]: r["g"] for r in spark.createDataFrame([(k,) for k in want], "s string").select("s", signature(F.col("s")).alias("g")).collect()}
    assert out == want


def test_captions_share_a_signature(spark):
    rows = spark.createDataFrame([(x,) for x in ("v. 1 no. 2", "vol. 1 issue 2", "Volume 1 number 2")], "s string").select(signature(F.col("s"))).distinct()
    assert rows.count() == 1


def test_labels(spark):
    want = {
        "v. 7-9 (2001-2003)": ("VOL-VOL(YEAR-YEAR)", None), "v. 2 no. 1 (1988)-v. 4 no. 6 (1990)": ("VOLISS(YEAR) \u2014 VOLISS(YEAR)", 8), "1950-1962": ("YEAR \u2014 YEAR", 2),
        "v. 9 (2004)-": ("VOL(YEAR)\u2013", None), "12-14": ("#-#", None), "v. 3-5-8": ("VOL-VOL-VOL", None), "v. 1 (1970)-3 (1972)": ("VOL(YEAR) \u2014 #(YEAR)", 6), "lacking v. 6": ("\u2039text\u203aVOL", None),
        "(v. 1-v. 2)": ("(VOL-VOL)", None), ")-v. 2": (")-VOL", None), "-": ("\u2013", None), "-v. 2": (" \u2014 VOL", 1), "": ("", None), None: (None, None),
    }
    read = spark.createDataFrame([(k,) for k in want], "s string").withColumn("g", signature(F.col("s")))
    out = {r["s"]: (r["label"], r["at"]) for r in read.select("s", label(F.col("g")).alias("label"), range_separator(kinds_of(F.col("g"))).alias("at")).collect()}
    assert out == want
    cut = read.where("s = '1950-1962'").select(label(F.col("g"), 6).alias("x")).first()[0]
    assert cut == "YEAR \u2014"


def test_coarse_signatures(spark):
    want = {"MON|YEAR": "CHRON|YEAR", "SEASON|UNKNOWN|SEASON|YEAR": "CHRON|YEAR", "CHRON|UNKNOWN|MON|UNKNOWN|SEASON": "CHRON", "CHRON|UNKNOWN|YEAR": "CHRON|UNKNOWN|YEAR", "UNKNOWN|CHRON": "UNKNOWN|CHRON", "": "", None: None}
    out = {r["g"]: r["c"] for r in spark.createDataFrame([(k,) for k in want], "g string").select("g", coarse(F.col("g")).alias("c")).collect()}
    assert out == want


def test_validation():
    ok = PATTERNS[0]
    assert rules.validated(ok) == [] and rules.validated(PATTERNS[2]) == []
    for change, said in (({"regex": ""}, "no regex"), ({"regex": "(?<a>" + "x" * 4000 + ")"}, "regex too long"), ({"regex": "(?<a>("}, "compile"), ({"regex": "abc"}, "no named groups"), ({"roles": ok["roles"][:-1]}, "no role for"), ({"roles": [*ok["roles"], ok["roles"][0]]}, "duplicate role"), ({"roles": [{"group": "zz", "boundary": "start", "kind": "year"}]}, "unknown group"), ({**PATTERNS[2], "skip": False}, "undecided")):
        assert any(said in w for w in rules.validated({**ok, **change})), said
    assert rules.validated("x") == ["no regex"]


def test_library_round_trip_and_order():
    good, bad = rules.loaded([PATTERNS[1], {"regex": ""}, PATTERNS[0], PATTERNS[0]])
    assert [p["id"] for p in good] == ["months", "monthsx", "any"] and [k for k, _ in bad] == [1]
    assert rules.imported(rules.exported(good))[0] == good and rules.imported([PATTERNS[0]])[0][0]["id"] == "months"
    with pytest.raises(ValueError, match="schema"):
        rules.imported({"schema": 9, "patterns": []})


def test_first_that_fits(spark):
    good, _ = rules.loaded(PATTERNS)
    df = spark.createDataFrame([(x,) for x in ("v. 1 no. 2 (Feb 1990)", "v.1(1990)-v.2(1991)", "12 ?", "else", None)], "stmt string")
    out = {r["stmt"]: (r["source"], r["skipped"]) for r in rules.sourced(df, good).collect()}
    assert out == {"v. 1 no. 2 (Feb 1990)": ("months", False), "v.1(1990)-v.2(1991)": ("any", False), "12 ?": ("bare", True), "else": ("parser", False), None: ("parser", False)}
    said = {r["source"]: r["source_label"] for r in rules.labelled(rules.sourced(df, good), good).collect()}
    assert said["months"] == "months" and said["parser"] == "read by the parser"
    assert rules.sourced(df, good, fallback=False).where("source = 'unmatched'").count() == 2
    got = rules.captured(rules.sourced(df, good), good).where("source = 'months'").first()["start"]
    assert [(x["caption"], x["value"]) for x in got["levels"]] == [("v.", "1"), ("no.", "2")] and got["year"] == "1990" and got["month"] == "02"


def test_audit(spark):
    df = spark.createDataFrame([(x,) for x in ("v. 1 no. 2 (Feb 1990)", "v. 2 - v. 30 no. 5 (1930-1958)", "77", "junk", "v. 3 (Winter 1989/90)")], "stmt string")
    out = {r["stmt"]: r["verdict"] for r in audit.conserved(convert.convert_statements(parse.parse_distinct(df))).collect()}
    assert out == {"v. 1 no. 2 (Feb 1990)": "ok", "v. 2 - v. 30 no. 5 (1930-1958)": "warn", "77": "review", "junk": "fail", "v. 3 (Winter 1989/90)": "ok"}


def role(group, kind, boundary="start", **more):
    return {"group": group, "boundary": boundary, "kind": kind, **more}


def fields_of(spark, texts, patterns, fallback=True):
    good, bad = rules.loaded(patterns)
    assert not bad
    found = rules.applied(spark.createDataFrame([(x,) for x in texts], "stmt string"), good, fallback)
    done = {r["stmt"]: r for r in convert.convert_statements(found).collect()}
    source = {r["stmt"]: r["source"] for r in found.select("stmt", "source").distinct().collect()}
    return {k: (source[k], [" ".join(f"${x['code']} {x['value']}" for x in f) for f in r["f863"]], r) for k, r in done.items()}


def test_ranges_from_captures_where_the_parser_refuses(spark):
    part = {"regex": r"band (?<startvol>\d+)(?: bis (?<endvol>\d+))? ?(?<startmonth>[A-Z][a-z]+)? ?(?<startyear>\d{4})(?: x(?<other>\d))?", "id": "band", "roles": [role("startvol", "enum", level=2, caption="Bd."), role("endvol", "enum", "end", level=2, caption="Bd."), role("startmonth", "month"), role("startyear", "year"), role("other", "ignore")]}
    out = fields_of(spark, ["Band 3 Feb 1990", "BAND 3 bis 5 1990", "band 3 1990 x7", "band 4 Late Summer 1991", "band 9 1992 / v.1(1993)", "band 9 1992 / junk", "v. 1 (1990)"], [part])
    assert out["Band 3 Feb 1990"][:2] == ("band", ["$b 3 $i 1990 $j 02"]) and out["BAND 3 bis 5 1990"][:2] == ("band", ["$b 3-5 $i 1990"])
    assert [x["value"] for x in out["Band 3 Feb 1990"][2]["f853"]] == ["(*)", "Bd.", "(year)", "(month)"]
    assert "not_encoded:7" in out["band 3 1990 x7"][2]["warnings"]
    assert out["v. 1 (1990)"][0] == "parser" and out["band 4 Late Summer 1991"][0] == "parser"  # the pattern has room for one word
    qualified = {**part, "regex": r"band (?<startvol>\d+) \w+ (?<startmonth>[A-Z][a-z]+) (?<startyear>\d{4})", "roles": [role("startvol", "enum", level=1, caption="Bd."), role("startmonth", "month"), role("startyear", "year")]}
    late = fields_of(spark, ["band 4 Late Summer 1991"], [qualified])["band 4 Late Summer 1991"]
    assert late[1] == ["$a 4 $i 1991"] and late[2]["flagged"]


def test_claims_fallback_and_captions(spark):
    any_volume = {"id": "vols", "regex": r"v\.\s*(?<startvol>\d+)\s*\((?<startyear>\d{4})\)", "roles": [role("startvol", "enum", level=1, caption="v."), role("startyear", "year")], "priority": 1}
    leave = {"id": "leave", "regex": r"v\. 9 \((?<startyear>\d{4})\)", "roles": [role("startyear", "unresolved")], "skip": True, "priority": 5}
    texts = ["v. 9 (1990)", "v. 9 (1990), v. 9 (1991)", "v. 9 (1990), v. 8 (1991)", "v. 1 (1990) / other", "v. 7 nos. 1, 3 (1980)"]
    out = fields_of(spark, texts, [any_volume, leave])
    assert [out[x][0] for x in texts] == ["skipped", "skipped", "vols", "vols", "parser"] and out[texts[0]][1] == [] and len(out[texts[2]][1]) == 2
    strict = fields_of(spark, texts, [any_volume, leave], fallback=False)
    assert [strict[x][0] for x in texts] == ["skipped", "skipped", "vols", "unmatched", "unmatched"]
    block = {"id": "block", "regex": r"(?<startyear>\d{4}): (?<startvol>\d+) \((?<startiss>\d+)\)", "roles": [role("startyear", "year"), role("startvol", "enum", level=1, caption="vol."), role("startiss", "enum", level=2, caption="no.")]}
    said = fields_of(spark, ["1990: 3 (4)"], [block])["1990: 3 (4)"]
    assert said[0] == "block" and [x["value"] for x in said[2]["f853"]][:2] == ["vol.", "no."] and said[1] == ["$a 3 $b 4 $i 1990"]


def test_java_decides_what_compiles_and_ends_are_kept(spark):
    assert rules.compiles(r"(?<a>\p{Lu}+)") and not rules.compiles(r"(?<a>x)(?<a>y)") and not rules.compiles(r"(?P<a>x)")
    good, bad = rules.loaded([{"regex": r"(?<startvol>\d+) \$", "roles": [role("startvol", "enum")]}, {"regex": r"^(?<startvol>\d+)$", "roles": [role("startvol", "enum")]}])
    assert not bad and [r["source"] for r in rules.sourced(spark.createDataFrame([("5 $",), ("5",)], "stmt string"), good).orderBy("stmt").collect()] == ["p2", "p1"]
    full = {r["stmt"]: (r["full"], r["partial"], r["groups"]) for r in rules.tested(spark.createDataFrame([("V. 5",), ("x v. 5",), (None,)], "stmt string"), r"v\. (?<n>\d+)").collect()}
    assert full == {"V. 5": (True, False, {"n": "5"}), "x v. 5": (False, True, None), None: (False, False, None)}


def test_older_levels_and_joined_libraries():
    old = {"id": "a", "regex": r"(?<x>\d+) (?<y>\d+)", "roles": [{"group": "x", "boundary": "start", "level": "vol"}, {"group": "y", "boundary": "start", "level": "issue"}]}
    good, bad = rules.loaded([old])
    assert not bad and [(r["kind"], r["level"], r["caption"]) for r in good[0]["roles"]] == [("enum", 1, "v."), ("enum", 2, "no.")]
    both, bad = rules.joined(good, rules.exported([*good, PATTERNS[0]]))
    assert sorted(p["id"] for p in both) == ["a", "ax", "months"] and not bad


def test_roles_and_decisions(spark):
    from stackline.operators import roles

    df = spark.createDataFrame([("p", ["startnum", "startiss", "endiss", "endiss2", "startyear", "odd"])], "signature string, groups array<string>")
    out = [(r["group"], r["boundary"], r["kind"], r["level"], r["caption"], r["suggested"]) for r in roles.inferred(df).orderBy("place").collect()]
    assert out == [("startnum", "start", "enum", 1, "v.", True), ("startiss", "start", "enum", 2, "no.", False), ("endiss", "end", "enum", 1, "no.", False), ("endiss2", "start", "ignore", None, None, False), ("startyear", "start", "year", None, None, False), ("odd", "start", "unresolved", None, None, False)]
    decided = spark.createDataFrame([("p", "startiss", "start", "enum", 1, "iss."), ("p", "gone", "start", "year", None, None)], "signature string, group string, boundary string, kind string, level int, caption string")
    new = {r["group"]: (r["level"], r["caption"]) for r in roles.merged(roles.inferred(df), decided).collect()}
    assert new["startiss"] == (1, "iss.") and new["startnum"] == (2, "v.") and "gone" not in new
