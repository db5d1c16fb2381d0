"""A library of reviewed patterns: validation, order, the first that fits, and ranges from it.

A pattern is a dict: ``id``, ``label``, ``regex`` (Java, named groups, case ignored), ``roles`` (group to
``boundary``, ``kind``, ``level`` from 1, ``caption``), ``priority``, ``split``, ``skip``. At most 200 are kept, so
the library is a small table whose size is known; statements are only compared with it.

``sourced`` and ``captured`` take a statement as a whole. ``applied`` also cuts it into its pieces: a
pattern applies where it fits one piece (all pieces, where the parser may not read the others), a
piece of several runs is the parser's, a pattern to skip claims what it fits and writes nothing, and
where the parser reads the statement its ranges hold, with the pattern's captions where it states none.

Defined cases: invalid patterns, and those whose expression may take for ever (``screen``), are reported and left out; equal ids get a new one; equal
priorities keep their order; a statement that no pattern fits has source ``parser``, or
``unmatched`` where the parser isn't asked; a capture that isn't encoded is warned of; a null or
blank statement is unmatched by all.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackline.functions.codes import CHRONOLOGY_CODES, bound, chronology, year
from stackline.functions.expressions import group_names
from stackline.operators import parse, screen
from stackline.operators.parse import BOUNDARY_TYPE, LEVELS_TYPE

SCHEMA_VERSION, MOST_PATTERNS, MOST_CHARACTERS = 1, 200, 4000
BOUNDARIES, KINDS = ("start", "end"), ("enum", "year", "month", "day", "ignore", "unresolved")
#: Kind and caption by the word that older libraries have in place of a kind.
OLDER_LEVELS = {"vol": ("enum", "v."), "issue": ("enum", "no."), "part": ("enum", "pt."), "year": ("year", None), "month": ("month", None), "day": ("day", None), "ignore": ("ignore", None), "unresolved": ("unresolved", None)}
RANGE_TYPE = f"struct<start:{BOUNDARY_TYPE},finish:{BOUNDARY_TYPE},open_ended:boolean,gap_after:boolean,warnings:array<string>>"


def whole(regex: str) -> str:
    """The expression for a whole text, as the executors run it."""
    return f"^(?i:{regex})$"


def compiles(regex: str) -> bool:
    """Whether the engine that runs it, Java's, takes an expression; no other is asked, so a session must be there."""
    context = SparkContext._active_spark_context
    if context is None:
        raise RuntimeError("expressions are checked by the session's engine, and there is no session")
    try:
        context._jvm.java.util.regex.Pattern.compile(whole(regex))
    except IllegalArgumentException:  # what a syntax error of an expression is
        return False
    return True


def with_levels(roles: list[dict]) -> list[dict]:
    """Roles with kinds of older libraries put into today's, and unset levels of each boundary numbered in order."""
    out = []
    for role in roles:
        role = dict(role)
        if not role.get("kind") and isinstance(role.get("level"), str):
            role["kind"], said = OLDER_LEVELS.get(role.pop("level").strip().lower(), ("unresolved", None))
            role["caption"] = role.get("caption") or said
        out.append(role)
    for side in BOUNDARIES:
        mine = [r for r in out if r.get("kind") == "enum" and r.get("boundary", "start") == side]
        taken = {r["level"] for r in mine if r.get("level") is not None}
        for role in mine:
            if role.get("level") is None:
                role["level"] = next(k for k in range(1, len(mine) + len(taken) + 1) if k not in taken)
                taken.add(role["level"])
    return out


def validated(pattern: dict, slow: dict[str, str] | None = None) -> list[str]:
    """What is wrong with a pattern; nothing if it can be used. ``slow``: expressions that may take for ever, with a witness."""
    if not isinstance(pattern, dict) or not isinstance(pattern.get("regex"), str) or not pattern["regex"]:
        return ["no regex"]
    regex, wrong = pattern["regex"], []
    if len(regex) > MOST_CHARACTERS:
        wrong.append("regex too long")
    if not compiles(regex):
        wrong.append("regex doesn't compile")
    elif regex in (slow or {}):
        wrong.append(f"regex may take for ever: {slow[regex]!r} repeated is read in ever more ways")
    groups = [g for g in group_names(regex) if g]
    if not groups:
        wrong.append("no named groups")
    roles = pattern.get("roles", [])
    if not isinstance(roles, list):
        return [*wrong, "roles must be a list"]
    taken, skip = set(), bool(pattern.get("skip"))
    for role in roles:
        if role.get("group") not in groups:
            wrong.append(f"unknown group {role.get('group')}")
        if role.get("boundary") not in BOUNDARIES or role.get("kind") not in KINDS:
            wrong.append(f"bad role for {role.get('group')}")
        if role.get("kind") == "unresolved" and not skip:
            wrong.append(f"undecided group {role.get('group')}")
        slot = (role.get("boundary"), role.get("kind"), role.get("level") if role.get("kind") == "enum" else None)
        if role.get("kind") in KINDS[:4]:
            if slot in taken:
                wrong.append(f"two roles for {slot}")
            taken.add(slot)
    named = [r.get("group") for r in roles]
    wrong += [f"duplicate role {g}" for g in sorted({g for g in named if g and named.count(g) > 1})]
    if not skip:
        wrong += [f"no role for {g}" for g in groups if g not in named]
        if not taken:
            wrong.append("nothing to encode")
    return wrong


def loaded(patterns: Iterable[dict]) -> tuple[list[dict], list[tuple[int, list[str]]]]:
    """Valid patterns in order of use, and what is wrong with the others by place."""
    good, bad, ids, patterns = [], [], set(), list(patterns)
    asked = {p["regex"] for p in patterns if isinstance(p, dict) and isinstance(p.get("regex"), str) and len(p["regex"]) <= MOST_CHARACTERS}
    slow = screen.refused(SparkSession.active(), asked) if asked else {}
    for k, p in enumerate(patterns):
        if isinstance(p, dict) and isinstance(p.get("roles"), list) and all(isinstance(r, dict) for r in p["roles"]):
            p = {**p, "roles": with_levels(p["roles"])}
        wrong = validated(p, slow)
        if wrong or len(good) == MOST_PATTERNS:
            bad.append((k, wrong or ["library is full"]))
            continue
        name = str(p.get("id") or f"p{k + 1}")
        while name in ids:
            name += "x"
        ids.add(name)
        good.append({"label": name, "priority": 0, "skip": False, "split": True, "roles": [], **p, "id": name})
    return sorted(good, key=lambda p: -p["priority"]), bad


def exported(patterns: list[dict]) -> str:
    return json.dumps({"schema": SCHEMA_VERSION, "patterns": patterns}, ensure_ascii=False)


def imported(document: str | bytes | dict | list) -> tuple[list[dict], list[tuple[int, list[str]]]]:
    """Patterns of a document, or of a bare list; another schema version is refused."""
    data = json.loads(document) if isinstance(document, (str, bytes)) else document
    if isinstance(data, dict):
        if data.get("schema") != SCHEMA_VERSION:
            raise ValueError(f"unknown schema version {data.get('schema')}")
        data = data.get("patterns", [])
    return loaded(data)


def joined(existing: list[dict], document: str | bytes | dict | list) -> tuple[list[dict], list[tuple[int, list[str]]]]:
    """The patterns there are and those of a document, all validated again; an id that is there already is given anew."""
    incoming, bad = imported(document)
    good, more = loaded([*existing, *incoming])
    return good, bad + more


def fitting(text: Column, patterns: list[dict]) -> Column:
    """Places of the patterns that fit the whole of a text."""
    return F.array_compact(F.array(*(F.when(text.rlike(whole(p["regex"])), F.lit(k)) for k, p in enumerate(patterns)))) if patterns else F.array().cast("array<int>")


def sourced(statements: DataFrame, patterns: list[dict], fallback: bool = True, column: str = "stmt") -> DataFrame:
    """``source`` of each statement: the id of the first pattern that fits the whole of it, in one pass."""
    source = None
    for p in patterns:
        fits = F.trim(F.col(column)).rlike(whole(p["regex"]))
        source = F.when(fits, F.lit(p["id"])) if source is None else source.when(fits, F.lit(p["id"]))
    rest = F.lit("parser" if fallback else "unmatched")
    skipped = F.array(*(F.lit(p["id"]) for p in patterns if p["skip"])) if any(p["skip"] for p in patterns) else F.array().cast("array<string>")
    out = statements.withColumn("source", source.otherwise(rest) if source is not None else rest)
    return out.withColumn("skipped", F.array_contains(skipped, F.col("source")))


def _capture(text: Column, p: dict, group: str) -> Column:
    """What a group holds of the whole text; null where it is empty."""
    at = group_names(p["regex"]).index(group) + 1
    got = F.trim(F.regexp_extract(text, whole(p["regex"]), at))
    return F.when(got != "", got)


def _qualified(text: Column, value: Column, last: bool) -> Column:
    """A month or season with the word right before it, which makes it no code; but not with a month that a hyphen joins to it."""
    at = F.position(value, text) if not last else F.length(text) - F.position(F.reverse(value), F.reverse(text)) - F.length(value) + 2
    before = text.substr(F.lit(1), at.cast("int") - 1)
    word, hyphen = (F.regexp_extract(before, r"([A-Za-z][A-Za-z.'’]*)(-?)\s*$", k) for k in (1, 2))
    month = F.array(*map(F.lit, CHRONOLOGY_CODES))
    alone = (word == "") | ((hyphen == "-") & F.array_contains(month, F.lower(F.regexp_replace(word, r"\.$", ""))))
    return F.when(alone, value).otherwise(F.concat(word, hyphen, F.lit(" "), value))


def _boundary(text: Column, p: dict, side: str) -> Column:
    """The captures of one side; null if the pattern has no such roles or they hold nothing."""
    roles = {(r["kind"], r.get("level") if r["kind"] == "enum" else None): r for r in p["roles"] if r["boundary"] == side and r["kind"] in KINDS[:4]}
    none = F.lit(None).cast("string")
    if not roles:
        return F.lit(None).cast(BOUNDARY_TYPE)
    deepest = max((int(k) for kind, k in roles if kind == "enum"), default=0)
    level = lambda k: (roles.get(("enum", k)) or {}).get("caption")
    value = lambda kind, k=None: _capture(text, p, roles[kind, k]["group"]) if (kind, k) in roles else none
    levels = [F.struct(F.when(value("enum", k).isNotNull(), F.lit(level(k)).cast("string")).alias("caption"), value("enum", k).alias("value")) for k in range(1, deepest + 1)]
    month, day = (F.when(value(kind).isNotNull(), _qualified(text, value(kind), side == "end")) if (kind, None) in roles else none for kind in ("month", "day"))
    made = F.struct((F.array(*levels) if levels else F.array().cast(LEVELS_TYPE)).alias("levels"), year(value("year")).alias("year"), chronology(month).alias("month"), day.alias("day")).cast(BOUNDARY_TYPE)
    some = F.coalesce(*(value(kind, k) for kind, k in roles)).isNotNull()
    return F.when(some, made)


def _range(text: Column, p: dict) -> Column:
    """The range that a pattern's captures give, with a warning for each that isn't encoded."""
    start, finish = _boundary(text, p, "start"), _boundary(text, p, "end")
    ignored = [F.when(_capture(text, p, r["group"]).isNotNull(), F.concat(F.lit("not_encoded:"), _capture(text, p, r["group"]))) for r in p["roles"] if r["kind"] not in KINDS[:4]]
    empty = F.struct(F.array().cast(LEVELS_TYPE).alias("levels"), *(F.lit(None).cast("string").alias(c) for c in ("year", "month", "day"))).cast(BOUNDARY_TYPE)
    made = F.struct(F.coalesce(start, empty).alias("start"), finish.alias("finish"), text.rlike(r"-\s*$").alias("open_ended"), F.lit(False).alias("gap_after"), (F.array_compact(F.array(*ignored)) if ignored else F.array().cast("array<string>")).alias("warnings"))
    return F.when(start.isNotNull() | finish.isNotNull(), made.cast(RANGE_TYPE))


def captured(sources: DataFrame, patterns: list[dict], column: str = "stmt") -> DataFrame:
    """``start`` and ``finish`` from the captures of each statement's pattern; null for other sources."""
    text, out = F.trim(F.col(column)), {}
    for name, side in (("start", "start"), ("finish", "end")):
        column_of = F.lit(None).cast(BOUNDARY_TYPE)
        for p in patterns:
            if not p["skip"]:
                column_of = F.when(F.col("source") == p["id"], _boundary(text, p, side)).otherwise(column_of)
        out[name] = column_of
    return sources.withColumns(out)


def read_texts(texts: DataFrame, patterns: list[dict]) -> DataFrame:
    """Per distinct ``text`` the parser's ranges in order, its status, whether it holds several runs, and the patterns that fit."""
    rows = parse.ranges(texts.select("text").distinct(), "text")
    entry = F.when(F.col("pos").isNotNull(), F.struct("pos", F.struct("start", "finish", "open_ended", "gap_after", "warnings").cast(RANGE_TYPE).alias("r")))
    by_pos = lambda x, y: F.when(x["pos"] < y["pos"], -1).when(x["pos"] > y["pos"], 1).otherwise(0)
    each = rows.groupBy(F.col("stmt").alias("text")).agg(F.transform(F.array_sort(F.collect_list(entry), by_pos), lambda x: x["r"]).alias("ranges"), F.max("status").alias("status"))
    several = F.coalesce(parse.is_list(F.col("text")), F.lit(False)) | (F.size("ranges") > 1)
    return each.select("text", "ranges", "status", several.alias("several"), fitting(F.col("text"), patterns).alias("fits"))


def applied(statements: DataFrame, patterns: list[dict], fallback: bool = True, column: str = "stmt") -> DataFrame:
    """Ranges of each distinct statement as ``parse.ranges`` gives them, with ``source``: a pattern's id, parser, skipped or unmatched."""
    base = statements.select(F.col(column).alias("stmt"), F.trim(F.coalesce(F.col(column), F.lit(""))).alias("text")).distinct()
    cut = F.when(F.coalesce(parse.is_list(F.col("text")), F.lit(False)), F.array("text")).otherwise(parse.top_level(F.col("text")))
    pieces = base.select("text", F.posexplode(cut).alias("nth", "piece"))
    known = read_texts(base.select("text").union(pieces.select("piece")), patterns)
    met = pieces.join(known.withColumnRenamed("text", "piece"), "piece")
    # a statement has few pieces
    together = met.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("nth", F.struct("piece", "ranges", "several", "fits").alias("p")))).alias("pieces"))
    own = F.transform("pieces", lambda x: F.when(x["p"]["several"], F.array().cast("array<int>")).otherwise(x["p"]["fits"]))
    raw = F.transform("pieces", lambda x: x["p"]["fits"])
    every = lambda lists: F.aggregate(lists, lists[0], lambda a, x: F.array_intersect(a, x))
    some = lambda lists: F.array_distinct(F.flatten(lists))
    numbers = lambda choose: F.array(*(F.lit(k) for k, p in enumerate(patterns) if choose(p))).cast("array<int>")
    joined_rows = base.join(together, "text").join(known.select("text", F.col("ranges").alias("_ranges"), F.col("status").alias("_status"), F.col("several").alias("_several"), F.col("fits").alias("_fits")), "text")
    alone = F.when(F.col("_several"), F.array().cast("array<int>")).otherwise(F.col("_fits"))
    claims = F.concat(
        F.array_intersect(every(raw), numbers(lambda p: p["skip"] and p["split"])),
        F.array_intersect("_fits", numbers(lambda p: p["skip"] and not p["split"])),
        F.array_intersect(some(own) if fallback else every(own), numbers(lambda p: not p["skip"] and p["split"])),
        F.array_intersect(alone, numbers(lambda p: not p["skip"] and not p["split"])),
    )
    told = bound(joined_rows, "_which", F.array_min(claims))
    which = F.col("_which")

    def of_pattern(make, otherwise: Column) -> Column:
        out = otherwise
        for k, p in enumerate(patterns):
            if not p["skip"]:
                out = F.when(which == k, make(p)).otherwise(out)
        return out

    nothing = F.array().cast(f"array<{RANGE_TYPE}>")

    def built(p: dict) -> Column:
        def of(x: Column) -> Column:
            fits = F.array_contains(x["p"]["fits"], which) & ~x["p"]["several"]
            read = F.transform(x["p"]["ranges"], lambda r: r.withField("warnings", F.concat(r["warnings"], F.array(F.concat(F.lit("read_by_parser:"), x["p"]["piece"])))))
            return F.when(fits, F.array_compact(F.array(_range(x["p"]["piece"], p)))).otherwise(read)

        return F.flatten(F.transform("pieces", of)) if p["split"] else F.array_compact(F.array(_range(F.col("text"), p)))

    def captioned(p: dict) -> Column:
        """The parser's ranges, with the pattern's captions where a level has none."""

        def side(boundary: Column, name: str) -> Column:
            words = {int(r["level"]): r["caption"] for r in p["roles"] if r["kind"] == "enum" and r["boundary"] == name and r.get("caption")}
            if not words:
                return boundary
            said = F.array(*(F.lit(words.get(k)).cast("string") for k in range(1, max(words) + 1)))
            levels = F.transform(boundary["levels"], lambda x, i: F.struct(F.coalesce(x["caption"], F.when(i < F.size(said), F.get(said, i))).alias("caption"), x["value"].alias("value")))
            return F.when(boundary.isNotNull(), boundary.withField("levels", levels))

        return F.transform("_ranges", lambda r: r.withField("start", side(r["start"], "start")).withField("finish", side(r["finish"], "end")))

    over = F.array_min(F.array_intersect("_fits", numbers(lambda p: not p["skip"])))
    labels = F.array(*(F.lit(p["label"]) for p in patterns)).cast("array<string>")
    passed = F.when(F.col("_several") & over.isNotNull(), F.array(F.concat(F.lit("passed_over:"), F.get(labels, over)))).otherwise(F.array().cast("array<string>"))
    by_parser = F.transform("_ranges", lambda r, i: r.withField("warnings", F.when(i == 0, F.concat(r["warnings"], passed)).otherwise(r["warnings"]))) if fallback else nothing
    from_pattern = of_pattern(lambda p: F.when(F.size("_ranges") > 0, captioned(p)).otherwise(built(p)), nothing)
    skips = F.array_contains(numbers(lambda p: p["skip"]), which)
    told = bound(told, "_out", F.when(which.isNull(), by_parser).when(skips, nothing).otherwise(from_pattern))
    ids = F.array(*(F.lit(p["id"]) for p in patterns)).cast("array<string>")
    source = F.when(which.isNull(), F.lit("parser" if fallback else "unmatched")).when(skips, "skipped").otherwise(F.get(ids, which))
    status = F.when(F.size("_out") > 0, "ok").when(which.isNull() & F.lit(fallback), F.col("_status")).otherwise("failed")
    return told.select("stmt", source.alias("source"), status.alias("status"), F.posexplode_outer("_out").alias("pos", "r")).select("stmt", "source", "pos", *(F.col(f"r.{c}").alias(c) for c in ("start", "finish")), *(F.coalesce(f"r.{c}", F.lit(False)).alias(c) for c in ("open_ended", "gap_after")), F.coalesce("r.warnings", F.array().cast("array<string>")).alias("warnings"), "status")


def tested(statements: DataFrame, regex: str, column: str = "stmt", most: int = 500) -> DataFrame:
    """How a pattern that isn't in the library fits each statement (its first ``most`` characters): full, partial, and the groups of a full fit.

    Only for looking at a pattern; a conversion always reads whole statements. One that may take for ever isn't run.
    """
    if slow := screen.refused(statements.sparkSession, [regex]):
        raise ValueError(f"regex may take for ever: {slow[regex]!r} repeated is read in ever more ways, so nothing was tested; a repeat without another inside it mends that")
    text = F.substring(F.trim(F.col(column)), 1, most)
    full = F.coalesce(text.rlike(whole(regex)), F.lit(False))
    groups = F.create_map(*(x for g in group_names(regex) if g for x in (F.lit(g), F.coalesce(_capture(text, {"regex": regex}, g), F.lit("")))))
    return statements.select(F.col(column).alias("stmt"), full.alias("full"), (~full & F.coalesce(text.rlike(f"(?i:{regex})"), F.lit(False))).alias("partial"), F.when(full, groups).alias("groups"))


def by_source(sources: DataFrame) -> DataFrame:
    """Statements of each source, most first."""
    return sources.groupBy("source").agg(F.count(F.lit(1)).alias("statements")).orderBy(F.desc("statements"), "source")


def labelled(sources: DataFrame, patterns: list[dict]) -> DataFrame:
    """``source_label``: a pattern's label, or what a source that is no pattern means; null for an unknown one."""
    said = {**{p["id"]: p["label"] for p in patterns}, "parser": "read by the parser", "unmatched": "left as it is, no pattern fits", "skipped": "left as it is, to be skipped"}
    return sources.withColumn("source_label", F.create_map(*(F.lit(x) for pair in said.items() for x in pair))[F.col("source")])
