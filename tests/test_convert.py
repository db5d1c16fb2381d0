"""Worked statements and the fields they give."""

import pytest

from stackline.operators import convert, parse

GOLDEN = {
    "v.2:no.1(1980:Feb.)-v.6:no.3(1984:Nov.)": ["$a 2-6 $b 1-3 $i 1980-1984 $j 02-11"],
    "v.8(1991)-": ["$a 8- $i 1991-"],
    "v. 3 no. 2-v. 5 no. 2 (1970-1972)": ["$a 3-5 $b 2-2 $i 1970-1972"],
    "v. 9 no. 1 - v. 9 no. 4 (2001)": ["$a 9 $b 1-4 $i 2001"],
    "v. 5 no. 1-2-v. 8 no. 1-2 (1970-1973)": ["$a 5-8 $b 1-2 $i 1970-1973"],
    "v. 4 no. 1 - v. 5 no. 1 (Feb 1960 - Feb 1961)": ["$a 4-5 $b 1-1 $i 1960-1961 $j 02-02"],
    "v. 4 - v. 9 (1980 - Oct 1985)": ["$a 4-9 $i 1980-1985"],
    "v. 2 no. 1 (Fall 2000)-v. 6 no. 1 (2004)": ["$a 2-6 $b 1-1 $i 2000-2004"],
    "v. 2 no. 1 (1990)-v. 6 no. 4 (March 1994)": ["$a 2-6 $b 1-4 $i 1990-1994"],
    "v. 2 - v. 30 no. 5 (1930-1958)": ["$a 2-30 $i 1930-1958"],
    "v.2:no.1-v.4:no.3(1990-1992)": ["$a 2-4 $b 1-3 $i 1990-1992"],
    "v. 8 no. 2-no. 5 (1990)": ["$a 8 $b 2-5 $i 1990"],
    "v. 30-32 no. 4 (1990)": ["$a 30-32 $i 1990"],
    "v. 30-32 nos. 2-5 (1990-1992)": ["$a 30-32 $b 2-5 $i 1990-1992"],
    "v. 7 nos. 1, 3 (Feb, Apr 1920)": ["$a 7 $b 1 $i 1920 $j 02 $w g", "$a 7 $b 3 $i 1920 $j 04"],
    "v. 7 nos. 1, 2 (Jan, Feb 1920)": ["$a 7 $b 1 $i 1920 $j 01", "$a 7 $b 2 $i 1920 $j 02"],
    "v. 7 nos. 1, 3 (1980-1990)": ["$a 7 $b 1 $w g", "$a 7 $b 3"],
    "v. 7 nos. 1, 3, 5 (Jan, Mar 1920)": [],
    "4,7,9 (1981, 1983, 1985)": ["$a 4 $i 1981 $w g", "$a 7 $i 1983 $w g", "$a 9 $i 1985"],
    "77": [],
    "1985: 3 (4-9 [Feb 2-Mar 7])": ["$a 3 $b 4-9 $i 1985 $j 02-03 $k 2-7"],
    "v. 3 no. 4 (Winter 1989/90)": ["$a 3 $b 4 $i 1989/1990 $j 24"],
    "v. 2 (1990), no. 4 (1995)": ["$a 2 $i 1990", "$i 1995"],
    "v. 4 (1990 Shopping Guide)": ["$a 4 $i 1990"],
    "v. 19 nos. 1, 3, 5, 7-12 (Jan, Mar, May, Jul-Dec 1915)": ["$a 19 $b 1 $i 1915 $j 01 $w g", "$a 19 $b 3 $i 1915 $j 03 $w g", "$a 19 $b 5 $i 1915 $j 05 $w g", "$a 19 $b 7-12 $i 1915 $j 07-12"],
    "1999?": ["$i 1999"],
    "": [],
}
WARNED = {"v. 4 - v. 9 (1980 - Oct 1985)", "v. 2 no. 1 (Fall 2000)-v. 6 no. 1 (2004)", "v. 2 no. 1 (1990)-v. 6 no. 4 (March 1994)", "v. 2 - v. 30 no. 5 (1930-1958)", "v. 30-32 no. 4 (1990)", "v. 7 nos. 1, 3 (1980-1990)", "v. 2 (1990), no. 4 (1995)", "v. 4 (1990 Shopping Guide)", "1999?"}


@pytest.fixture(scope="module")
def converted(spark):
    df = spark.createDataFrame([(t,) for t in [*GOLDEN, None, "77"]], "stmt string")
    return {r["stmt"]: r for r in convert.convert_statements(parse.parse_distinct(df)).collect()}


def shown(fields):
    return " ".join(f"${x['code']} {x['value']}" for x in fields)


def test_golden_values(converted):
    assert {k: [shown(f) for f in converted[k]["f863"]] for k in GOLDEN} == GOLDEN


def test_warnings_and_status(converted):
    assert {k for k in GOLDEN if converted[k]["warnings"]} == WARNED
    assert converted["77"]["status"] == "review" and converted[""]["status"] == "failed" and converted[None]["status"] == "failed"
    assert [k for k in GOLDEN if converted[k]["flagged"]] == ["v. 4 (1990 Shopping Guide)"]


def test_captions(converted):
    assert shown(converted["v.2:no.1(1980:Feb.)-v.6:no.3(1984:Nov.)"]["f853"]) == "$a v. $b no. $i (year) $j (month)"
    assert shown(converted["v. 3 no. 4 (Winter 1989/90)"]["f853"]) == "$a v. $b no. $i (year) $j (season)"
    assert shown(converted["4,7,9 (1981, 1983, 1985)"]["f853"]) == "$a (*) $i (year)"
    assert converted["77"]["f853"] is None


def test_spacing_makes_no_difference(spark):
    tight = ["v.1(1990)-v.4(1993)", "v.2:no.1-v.4:no.3(1990-1992)"]
    df = spark.createDataFrame([(x,) for t in tight for x in (t, t.replace("-v", " - v"))], "stmt string")
    rows = {r["stmt"]: [shown(f) for f in r["f863"]] for r in convert.convert_statements(parse.parse_distinct(df)).collect()}
    assert all(rows[t] == rows[t.replace("-v", " - v")] for t in tight)


def test_convention_is_checked():
    with pytest.raises(ValueError):
        convert.Convention(("a", "i"))
    with pytest.raises(ValueError):
        convert.Convention(("z",))


def test_a_designation_heads_the_numbers_after_it(spark):
    want = {
        "Series 1, v. 6 no. 1 (Summer/Fall 1992)": ["$a 1 $b 6 $c 1 $i 1992 $j 22/23"], "v. 1, v. 5 (1994)": ["$a 1", "$a 5 $i 1994"], "ser. 2, v. 1 (1990), ser. 2, v. 3 (1992)": ["$a 2 $b 1 $i 1990", "$a 2 $b 3 $i 1992"],
        "Series 1 / v. 6 (1992)": ["$a 1", "$b 6 $i 1992"], "no. 3, v. 5 no. 2 (1990)": ["$a 3", "$i 1990"],
    }
    df = spark.createDataFrame([(x,) for x in want], "stmt string")
    cut = {r["stmt"]: r["s"] for r in df.select("stmt", parse.segments(df["stmt"]).alias("s")).collect()}
    assert cut["Series 1, v. 6 no. 1 (Summer/Fall 1992)"] == ["Series 1, v. 6 no. 1 (Summer/Fall 1992)"] and cut["v. 1, v. 5 (1994)"] == ["v. 1", "v. 5 (1994)"]
    assert cut["ser. 2, v. 1 (1990), ser. 2, v. 3 (1992)"] == ["ser. 2, v. 1 (1990)", "ser. 2, v. 3 (1992)"] and len(cut["Series 1 / v. 6 (1992)"]) == 2 and len(cut["no. 3, v. 5 no. 2 (1990)"]) == 2
    rows = {r["stmt"]: [shown(f) for f in r["f863"]] for r in convert.convert_statements(parse.parse_distinct(df)).collect()}
    assert {k: rows[k] for k in list(want)[:3]} == {k: want[k] for k in list(want)[:3]}


def test_conventions_are_overlaid(spark):
    new, said = convert.overlaid(convert.STANDARD, {"vol": "c", "year": "A", "month": "zz", "week": "l"}, ["1", ""])
    assert new.enum == ("c", "b", "d", "e", "f")
    assert new.indicators == ("1", " ") and new.chron == {"year": "a", "month": "j", "day": "k"}
    assert "unknown level week" in said and "month can't be in zz" in said
    kept, said = convert.overlaid(convert.STANDARD, {"enum": ["a", "i"]})
    assert kept == convert.STANDARD and len(said) == 1
    for wrong in ({"enum": []}, {"enum": ["a", "a"]}, {"enum": ["n"]}):
        assert convert.overlaid(convert.STANDARD, wrong)[0].enum == convert.STANDARD.enum
    assert convert.overlaid(convert.HOUSE, {"day": "k"}) == (convert.HOUSE, ["unknown level day"])
    assert convert.overlaid(convert.STANDARD, {"enum": {"e1": "c", "e9": "d"}})[1] == ["no level e9", "room for 5 levels"]
    assert convert.overlaid(convert.STANDARD, None, 5)[1] == ["indicators can't be 5"]
    assert [convert.level_of(x) for x in ("e1", "E3", "vol", "part", 0, 2, "2", True, -1, "e0", "x", None)] == [0, 2, 0, 2, 0, 2, 2, None, None, None, None, None]
    df = spark.createDataFrame([("v. 3 no. 4 (Feb-Mar 1990)",), ("v. 3 (Winter 1989/90)",)], "stmt string")
    rows = {r["stmt"]: r for r in convert.convert_statements(parse.parse_distinct(df), convert.HOUSE, {"e1": "Bd.", "season": "(Zeit)"}).collect()}
    assert shown(rows["v. 3 no. 4 (Feb-Mar 1990)"]["f863"][0]) == "$a 1990 $b 3 $c 4 $i Feb-Mar"
    assert shown(rows["v. 3 no. 4 (Feb-Mar 1990)"]["f853"]) == "$a (year) $b Bd. $c no. $i (month)"
    assert shown(rows["v. 3 (Winter 1989/90)"]["f863"][0]) == "$a 1989/1990 $b 3 $i Winter" and shown(rows["v. 3 (Winter 1989/90)"]["f853"]).endswith("$i (Zeit)")
