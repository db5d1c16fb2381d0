"""Ranges to caption (853) and value (863) fields, in built-in expressions.

``values`` gives each range its coded values by one rule for every hierarchy, most
significant level first; ``convert_statements`` adds the statement's captions. Fields are
arrays of (code, value), sorted by code.

Defined cases: a level without a value gives no subfield; a statement that is held for
review or failed gives no field; where every value of a range was dropped, the range is held.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackline.functions.codes import bound, chronology_text, codeable
from stackline.operators.parse import BOUNDARY_TYPE

CHRONOLOGY = ("year", "month", "day")
FIELD = "array<struct<code:string,value:string>>"
#: Subfields of an 853 that hold captions.
LETTERS = "abcdefghijklm"
#: Deeper statements are flagged.
PLAUSIBLE_DEPTH = 3


@dataclass(frozen=True)
class Convention:
    """Which subfield each level has, and the indicators of an 853."""

    enum: tuple[str, ...] = ("a", "b", "c", "d", "e", "f")
    chron: dict[str, str] = field(default_factory=lambda: {"year": "i", "month": "j", "day": "k"})
    indicators: tuple[str, str] = ("3", "1")
    frequency: str = ""
    continuity: str = ""
    chron_as_text: bool = False

    def __post_init__(self):
        used = [*self.enum, *self.chron.values()]
        if len(set(used)) < len(used) or not set(used) <= set(LETTERS):
            raise ValueError("subfields must be different letters from a to m")


STANDARD = Convention()
HOUSE = Convention(("b", "c", "d", "e", "f"), {"year": "a", "month": "i"}, ("2", "0"), chron_as_text=True)
PRESETS = {"standard": STANDARD, "house": HOUSE}
#: Levels by the words that older settings have for them.
OLDER_NAMES = {"vol": 0, "issue": 1, "part": 2}


def level_of(name: object) -> int | None:
    """The enumeration level, from 0, that a setting names: a number, ``e1`` for the first, or an older word; else null."""
    if isinstance(name, str):
        name = name.strip().lower()
        found = re.fullmatch(r"(e?)([0-9]+)", name)
        name = OLDER_NAMES.get(name) if found is None else int(found[2]) - len(found[1])
    return name if isinstance(name, int) and not isinstance(name, bool) and name >= 0 else None


def overlaid(base: Convention = STANDARD, subfields: dict | None = None, indicators: object = None, chron_as_text: bool | None = None) -> tuple[Convention, list[str]]:
    """A convention with wishes laid over it, and what is said of those that don't hold; these leave it as it was.

    subfields: letters by chronology level, by enumeration level (``level_of``), or a sequence as ``enum``.
    Enumeration is settled first. A level without a wish whose letter another level now has goes.
    """
    letter = lambda x: str(x or "").strip().lower()
    usable = lambda x: len(x) == 1 and x in LETTERS
    said: list[str] = []
    asked = dict(subfields or {})
    sequence = asked.pop("enum", None)
    levels = {k: v for k, v in asked.items() if k not in base.chron and level_of(k) is not None}
    said += [f"unknown level {k}" for k in asked if k not in base.chron and k not in levels]
    if isinstance(sequence, dict):
        levels, sequence = {**levels, **sequence}, None
    elif sequence is not None and levels:
        said.append("levels beside a whole sequence")
    enum = list(base.enum)
    if sequence is not None:
        enum = [letter(x) for x in (sequence if isinstance(sequence, (list, tuple)) else [sequence])]
    elif levels:
        room = lambda k: level_of(k) is not None and level_of(k) < len(base.enum)
        said += [f"no level {k}" for k in levels if not room(k)]
        wanted = {level_of(k): letter(v) for k, v in levels.items() if room(k)}
        enum = [wanted.get(i, x) for i, x in enumerate(base.enum) if i in wanted or x not in wanted.values()]
        if len(enum) < len(base.enum):
            said.append(f"room for {len(enum)} levels")
    if not enum or not all(map(usable, enum)) or len(set(enum)) < len(enum) or set(enum) & set(base.chron.values()):
        said.append(f"enumeration can't be in {' '.join(enum)}")
        enum = list(base.enum)
    chron = dict(base.chron)
    for level in (k for k in asked if k in chron):
        x = letter(asked[level])
        if not usable(x) or x in enum or any(x == y for k, y in chron.items() if k != level):
            said.append(f"{level} can't be in {x}")
        else:
            chron[level] = x
    marks = base.indicators
    if indicators is not None:
        try:
            first, second = list(indicators)[:2]
            marks = tuple(str(x).strip()[:1] or " " for x in (first, second))
        except (TypeError, ValueError):
            said.append(f"indicators can't be {indicators}")
    return replace(base, enum=tuple(enum), chron=chron, indicators=marks, chron_as_text=base.chron_as_text if chron_as_text is None else bool(chron_as_text)), said


def hierarchy(levels: Column, has_finish: Column, open_ended: Column) -> Column:
    """(name, value, warning) of each level of ``levels``, an array of (name, start, finish, blocked, coded), in order.

    A level below one that is written as a range pairs with it: equal ends are written twice,
    and what only one boundary states is dropped.
    """
    says = lambda side: F.exists(levels, lambda x: x[side].isNotNull())
    some_start, some_finish = says("start"), says("finish")

    def step(state: Column, x: Column) -> Column:
        a, b, above = x["start"], F.when(~x["blocked"], x["finish"]), state["ranged"]
        lone = F.coalesce(a, b)
        silent = F.when(a.isNull(), some_start).otherwise(some_finish)
        value = (
            F.when(a.isNull() & b.isNull(), F.lit(None).cast("string"))
            .when(~x["coded"], F.lit(None).cast("string"))
            .when(~has_finish & above & ~a.contains("-"), F.lit(None).cast("string"))
            .when(~has_finish, F.concat(a, F.when(open_ended, "-").otherwise("")))
            .when(a != b, F.concat_ws("-", a, b))
            .when(a == b, F.when(above & ~a.contains("-"), F.concat_ws("-", a, b)).otherwise(a))
            .when(silent & above, F.lit(None).cast("string"))
            .otherwise(lone)
        )
        why = F.when(~x["coded"], "uncodeable").when(~has_finish, "unpairable").otherwise("unplaceable")
        warning = F.when(lone.isNotNull() & value.isNull(), F.concat_ws(":", why, x["name"], lone)).when(x["blocked"] & x["finish"].isNotNull(), F.concat_ws(":", F.lit("caption_conflict"), x["name"], x["finish"]))
        return F.struct((above | F.coalesce(value.rlike("-."), F.lit(False))).alias("ranged"), F.concat(state["out"], F.array(F.struct(x["name"].alias("name"), value.alias("value"), warning.alias("warning")))).alias("out"))

    nothing = F.struct(F.lit(False).alias("ranged"), F.array().cast("array<struct<name:string,value:string,warning:string>>").alias("out"))
    return F.aggregate(levels, nothing, step, lambda s: s["out"])


def captions(parsed: DataFrame) -> DataFrame:
    """Each range with its statement's ``captions``: per level the first one stated, to the greatest depth; and chronology stated."""
    both = F.concat(F.array("start"), F.when(F.col("finish").isNotNull(), F.array("finish")).otherwise(F.array().cast(f"array<{BOUNDARY_TYPE}>")))
    w = Window.partitionBy("stmt")
    told = parsed.withColumn("_b", both).withColumn("_all", F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct(F.col("pos").alias("p"), F.col("_b").alias("b")))).over(w), lambda x, y: F.when(x["p"] < y["p"], -1).when(x["p"] > y["p"], 1).otherwise(0)), lambda x: x["b"]))
    told = bound(told, "_flat", F.flatten("_all")).withColumn("depth", F.coalesce(F.array_max(F.transform("_flat", lambda b: F.size(b["levels"]))), F.lit(0)))
    first = lambda i: F.get(F.filter(F.transform("_flat", lambda b: F.get(b["levels"], i)["caption"]), lambda c: c.isNotNull()), F.lit(0))
    told = told.withColumn("captions", F.when(F.col("depth") > 0, F.transform(F.sequence(F.lit(0), F.col("depth") - 1), lambda i: first(i))).otherwise(F.array().cast("array<string>")))

    def some(k: str) -> Column:
        return F.exists("_flat", lambda b: b[k].isNotNull())

    told = told.withColumns({f"has_{k}": some(k) for k in CHRONOLOGY})
    seasons = F.exists("_flat", lambda b: F.exists(F.split(F.coalesce(b["month"], F.lit("")), "[-/]"), lambda m: m.isin("21", "22", "23", "24")))
    return told.withColumn("season", seasons).drop("_b", "_all", "_flat")


def values(parsed: DataFrame, convention: Convention = STANDARD) -> DataFrame:
    """Each range with ``v863``, its sorted (code, value) pairs, ``warnings`` and ``flagged``."""
    told = captions(parsed)
    size = F.greatest(F.size("start.levels"), F.coalesce(F.size("finish.levels"), F.lit(0)))

    def level(i: Column) -> Column:
        s, f = F.get("start.levels", i), F.get("finish.levels", i)
        said, own = F.get("captions", i), F.coalesce(s["caption"], f["caption"])
        blocked = F.coalesce(s["caption"] != f["caption"], F.lit(False))
        against = F.coalesce(own != said, F.lit(False)) | (i >= len(convention.enum))
        return F.struct(F.concat(F.lit("e"), (i + 1).cast("string")).alias("name"), s["value"].alias("start"), f["value"].alias("finish"), blocked.alias("blocked"), (~against).alias("coded"))

    enum = F.when(F.coalesce(size, F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), level)).otherwise(F.array().cast("array<struct<name:string,start:string,finish:string,blocked:boolean,coded:boolean>>"))

    def point(k: str) -> Column:
        s, f = F.col(f"start.{k}"), F.col(f"finish.{k}")
        fits = F.coalesce(codeable(k, s), F.lit(True)) & F.coalesce(codeable(k, f), F.lit(True)) if k in convention.chron else F.lit(False)
        return F.struct(F.lit(k).alias("name"), s.alias("start"), f.alias("finish"), F.lit(False).alias("blocked"), fits.alias("coded"))

    has = F.col("finish").isNotNull()
    told = bound(bound(told, "_e", hierarchy(enum, has, F.col("open_ended"))), "_c", hierarchy(F.array(*map(point, CHRONOLOGY)), has, F.col("open_ended")))
    all_codes = F.create_map(*(F.lit(x) for i, c in enumerate(convention.enum) for x in (f"e{i + 1}", c)), *(F.lit(x) for k, c in convention.chron.items() for x in (k, c)))
    written = lambda x: F.when(x["name"] == "month", chronology_text(x["value"])).otherwise(x["value"]) if convention.chron_as_text else x["value"]
    coded = F.transform(F.filter(F.concat("_e", "_c"), lambda x: x["value"].isNotNull()), lambda x: F.struct(all_codes[x["name"]].alias("code"), written(x).alias("value")))
    gap = F.when(F.col("gap_after") & (F.size(coded) > 0), F.array(F.struct(F.lit("w").alias("code"), F.lit("g").alias("value")))).otherwise(F.array().cast(FIELD))
    warned = F.array_distinct(F.concat("warnings", F.array_compact(F.transform(F.concat("_e", "_c"), lambda x: x["warning"]))))
    deep = F.when(F.col("depth") > PLAUSIBLE_DEPTH, F.array(F.lit("implausible_depth"))).otherwise(F.array().cast("array<string>"))
    ok = F.col("pos").isNotNull()
    out = told.withColumn("v863", F.when(ok, F.concat(F.array_sort(coded), gap)).otherwise(F.array().cast(FIELD))).withColumn("warnings", F.when(ok, F.concat(warned, deep)).otherwise(F.col("warnings")))
    return out.withColumn("flagged", F.exists("warnings", lambda w: w.startswith("uncodeable:year") | w.startswith("uncodeable:month") | w.startswith("uncodeable:day") | (w == "implausible_depth"))).drop("_e", "_c")


def caption_field(convention: Convention = STANDARD, words: dict | None = None) -> Column:
    """The 853's (code, value) pairs, from ``captions`` and the chronology stated; ``words``, by level, hold before what is stated."""
    words = {k if k in ("year", "month", "season", "day") else level_of(k): v for k, v in (words or {}).items() if v}
    own = F.array(*(F.lit(words.get(i)).cast("string") for i in range(len(convention.enum))))
    codes = F.array(*map(F.lit, convention.enum))
    enum = F.filter(F.transform("captions", lambda c, i: F.struct(F.get(codes, i).alias("code"), F.coalesce(F.get(own, i), c, F.lit("(*)")).alias("value"))), lambda x: x["code"].isNotNull())
    if convention.continuity:
        enum = F.when(F.size(enum) > 0, F.concat(enum, F.array(F.struct(F.lit("v").alias("code"), F.lit(convention.continuity).alias("value"))))).otherwise(enum)
    name = lambda k: F.lit(words.get(k, f"({k})"))
    named = {"year": name("year"), "month": F.when(F.col("season"), name("season")).otherwise(name("month")), "day": name("day")}
    chron = F.array_compact(F.array(*(F.when(F.col(f"has_{k}"), F.struct(F.lit(c).alias("code"), named[k].alias("value"))) for k, c in convention.chron.items())))
    before = F.filter(chron, lambda x: x["code"] < convention.enum[0])
    after = F.filter(chron, lambda x: x["code"] >= convention.enum[0])
    last = F.array(F.struct(F.lit("w").alias("code"), F.lit(convention.frequency).alias("value"))) if convention.frequency else F.array().cast(FIELD)
    return F.concat(F.array_sort(before), enum, F.array_sort(after), last)


def display(tag: str, indicators: tuple[str, str], fields: Column, link: Column | None = None) -> Column:
    """``TAG ii $8 link $c value ...`` with blank indicators as #."""
    shown = F.array_join(F.transform(fields, lambda x: F.concat(F.lit("$"), x["code"], F.lit(" "), x["value"])), " ")
    head = f"{tag} {''.join(indicators).replace(' ', '#')}"
    return F.concat_ws(" ", F.lit(head), *([F.concat(F.lit("$8 "), link)] if link is not None else []), shown)


def convert_statements(parsed: DataFrame, convention: Convention = STANDARD, words: dict | None = None) -> DataFrame:
    """A row for each statement: ``f853``, the array ``f863`` of value fields in order, ``warnings``, ``flagged``, ``status``."""
    told = values(parsed, convention).withColumn("_853", caption_field(convention, words))
    order = lambda x, y: F.when(x["pos"] < y["pos"], -1).when(x["pos"] > y["pos"], 1).otherwise(0)
    rows = told.groupBy("stmt").agg(
        F.max("_853").alias("f853"),
        F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "v863"))), order).alias("_r"),
        F.array_sort(F.collect_list(F.struct(F.coalesce("pos", F.lit(0)).alias("pos"), "warnings")), order).alias("_w"),
        F.max("flagged").alias("flagged"),
        F.max("status").alias("status"),
    )
    kept = F.filter(F.transform("_r", lambda x: x["v863"]), lambda v: F.size(v) > 0)
    out = rows.withColumn("f863", kept).withColumn("warnings", F.array_distinct(F.flatten(F.transform("_w", lambda x: x["warnings"]))))
    return out.withColumn("status", F.when((F.col("status") == "ok") & (F.size("f863") == 0), "review").otherwise(F.col("status"))).withColumn("f853", F.when(F.size("f863") > 0, F.col("f853"))).drop("_r", "_w")
