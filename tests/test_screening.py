import itertools
import random
import re
import time

import pytest

from stackline.functions.expressions import Unreadable, group_names, moves
from stackline.operators import library, rules, screen
from stackline.plans import holdings


def verdicts(spark, expressions):
    return {r["regex"]: (r["verdict"], r["witness"]) for r in screen.screened(spark.createDataFrame([(x,) for x in expressions], "regex string")).collect()}


SLOW = [r"(?<startvol>(\d|\d\d|\d+)+)x", r"^(\s*\w+)*$", r"(\d+)+", r"(a*)*", r"(a{3}|a)+x", r"(abc|ab|cab)+x", r"(x+x+)+y", r"(\w+\s?)*", r"(?i:[a-c]|B)+z", r"(.*,)*x", r"(?:(?:ab)*(?:ab)*)*c", r"([^,]+|\w)*;", r"(a|a?)+b"]
FINE = [r"v\.(?<vol>\d+)\((?<year>\d{4})\)", r"(v|v\.|vol)+ \d", r"(\d+,)*\d+", r"(?:(?:no|nos|n)\.? ?(?<i>\d+),? ?)+", r"(?:a|b)*c", r".*.*x", r"\Q(a+)+\E", r"[(a+)+]", r"(?<a>\d{1,4})(?:/\d{2})?", "", r"((ab)+c)+", r"[^\]]+\]", r"(?:[a-z&&[^aeiou]]|[aeiou])+"]


def test_repeats_of_repeats_are_refused_and_others_kept(spark):
    found = verdicts(spark, [*SLOW, *FINE, "(", "[a", "a{2", "*", r"\x", None])
    assert {x: found[x][0] for x in SLOW} == dict.fromkeys(SLOW, "exponential") and {x: found[x][0] for x in FINE} == dict.fromkeys(FINE, "ok")
    assert all(found[x] == ("unreadable", None) for x in ("(", "[a", "a{2", "*", r"\x")) and found[None] == (None, None)
    assert screen.screened(spark.createDataFrame([], "regex string")).count() == 0


def test_witnesses_take_ever_longer(spark):
    """Each further turn of the witness multiplies the engine's time."""
    found = verdicts(spark, SLOW)
    for regex in (r"^(\s*\w+)*$", r"(\d+)+", r"(x+x+)+y", r"(a|a?)+b"):
        compiled, took = re.compile(regex, re.IGNORECASE), []
        for turns in (5, 10):
            began = time.perf_counter()
            compiled.fullmatch(found[regex][1] * turns + "!")
            took.append(time.perf_counter() - began)
        assert took[1] > 4 * took[0], (regex, took)


def ambiguous(regex, most=6):
    """Whether a word of up to ``most`` characters leads from a place to itself in two ways, by counting all ways."""
    steps = {}
    for _, a, b, shown, _, ways in moves(regex):
        steps.setdefault(shown, {}).setdefault(a, {})[b] = ways
    places = {a for s in steps.values() for a in s}
    for n in range(1, most + 1):
        for word in itertools.product(sorted(steps), repeat=n):
            for p in places:
                at = {p: 1}
                for c in word:
                    to = {}
                    for a, k in at.items():
                        for b, w in steps[c].get(a, {}).items():
                            to[b] = to.get(b, 0) + k * w
                    at = to
                if at.get(p, 0) > 1:
                    return True
    return False


def test_verdicts_equal_counted_ways(spark):
    rng = random.Random(3)

    def made(depth):
        if depth == 0:
            return rng.choice(["a", "b", "ab", "[ab]", "a?"])
        kind = rng.randrange(4)
        if kind == 0:
            return f"(?:{made(depth - 1)}|{made(depth - 1)})"
        if kind == 1:
            return made(depth - 1) + made(depth - 1)
        return f"(?:{made(depth - 1)}){rng.choice(['*', '+', '?', '{2}', '{1,3}'])}"

    expressions = {x for x in (made(3) for _ in range(150)) if len(x) < 40}
    found = verdicts(spark, expressions)
    for x in expressions:
        assert (found[x][0] == "exponential") == ambiguous(x), x


def test_groups_by_number():
    assert group_names(r"v\. [(]?(?<startvol>\d+) [(](?<startyear>\d{4})\)(x)(?:y)(?=z)(?<!q)\((\\(a))\Q(\E[\](](?<b>c)") == ["startvol", "startyear", None, None, None, "b"]
    for wrong in ("(?<a", "(?<", "[z-a]", "a{3,2}", "(?%a)", "a)", "\\"):
        with pytest.raises((Unreadable, ValueError)):
            moves(wrong)


ROLES = [{"group": "startvol", "boundary": "start", "kind": "enum", "level": 1}, {"group": "startyear", "boundary": "start", "kind": "year"}]


def test_brackets_in_classes_and_escapes_shift_no_group(spark):
    regex = r"v\. [(]?(?<startvol>\d+) \\?[(](?<startyear>\d{4})\)"
    good, bad = rules.loaded([{"id": "a", "regex": regex, "roles": ROLES}])
    assert bad == []
    rows = spark.createDataFrame([("v. 3 (1990)",), ("v. (3 (1990)",), (None,)], "stmt string")
    out = [(r["stmt"], r["start"]["levels"][0]["value"], r["start"]["year"]) for r in rules.captured(rules.sourced(rows, good), good).collect() if r["start"]]
    assert sorted(out) == [("v. (3 (1990)", "3", "1990"), ("v. 3 (1990)", "3", "1990")]


def test_slow_expressions_are_loaded_and_tested_nowhere(spark):
    slow = {"id": "s", "regex": r"(?<startvol>(\d|\d\d|\d+)+)x", "roles": ROLES[:1]}
    good, bad = rules.loaded([slow, *holdings.PATTERNS])
    assert [k for k, _ in bad] == [0] and "for ever" in bad[0][1][0] and len(good) == len(holdings.PATTERNS)
    with pytest.raises(ValueError, match="nothing was tested"):
        rules.tested(spark.createDataFrame([("1",)], "stmt string"), slow["regex"])


def test_library_is_replaced_whole_or_not_at_all(spark, tmp_path):
    kept = library.Library(spark, f"file://{tmp_path}/library")
    assert kept.number() == 0 and kept.patterns() == [] and kept.table().count() == 0
    assert kept.replace(holdings.PATTERNS) == 1
    first = [p["id"] for p in kept.patterns()]
    with pytest.raises(library.Refused, match="pattern 2"):
        kept.replace([holdings.PATTERNS[0], {"id": "s", "regex": r"(?<startvol>(\d+)+)x", "roles": ROLES[:1]}])
    assert kept.number() == 1 and [p["id"] for p in kept.patterns()] == first
    # Two writers that both saw version 1: one of them is told.
    one, other = (library.Library(spark, f"file://{tmp_path}/library") for _ in range(2))
    assert one.replace(holdings.PATTERNS[:1], expected=1) == 2
    with pytest.raises(library.Conflict):
        other.replace(holdings.PATTERNS[1:], expected=1)
    with pytest.raises(library.Conflict):
        other._publish(2, "version-late")
    assert [p["id"] for p in kept.patterns()] == [holdings.PATTERNS[0]["id"]] and [p["id"] for p in kept.patterns(1)] == first
    # A writer that died while publishing leaves an empty file, which is passed over.
    (tmp_path / "library" / "published" / "00000003").touch()
    assert kept.number() == 2 and kept.replace(holdings.PATTERNS) == 4
    said = {r["change"] for r in library.changes(kept.table(2), kept.table(4)).collect()}
    assert said <= {"new", "moved", "kept"} and "new" in said
    assert {r["verdict"] for r in kept.table().collect()} == {"ok"}
