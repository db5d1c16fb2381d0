"""Holdings statements to ranges, in built-in expressions.

A statement is cut into segments, a segment that lists items into its items, and each of
these into a start and an end, in built-in expressions. A statement's ranges come together again to be
numbered, which shuffles by statement. Parse distinct statements (``parse_distinct``) and join back.

Output of ``ranges``: a row for each range, with its place ``pos`` in the statement, ``start``
and ``finish`` (levels and chronology), ``open_ended``, ``gap_after`` and ``warnings``; and for a
statement without one, a single row with ``pos`` null and ``status`` review or failed.
Null and blank statements fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackline.functions.codes import CAPTION, NUMBER, VOLUME_CAPTION, YEAR, bound, caption, chronology, let, trimmed, year
from stackline.functions.shared import distinct

#: Not inside round brackets.
OUTSIDE = r"(?![^(]*\))"
SEGMENT = rf"(?i)(?:(?<=\))\s*[,;]\s*|\s*[,;]\s*(?={VOLUME_CAPTION}\s*\d)|[,;]\s*(?=\d{{4}}\s*(?:$|-))){OUTSIDE}"
SLASH = rf"\s+/\s+{OUTSIDE}"
#: Captioned numbers and nothing else; the numbers at the head of a text.
DESIGNATION = rf"(?i)^(?:{CAPTION}\s*{NUMBER}(?:[\s:,]+(?={CAPTION}\s*\d)|$))+$"
HEAD = rf"(?i)^(?:(?:{CAPTION})?\s*{NUMBER}[\s:,]*)+"
LIST = rf"(?i)^((?:{CAPTION}\s*{NUMBER}[\s:,]+(?={CAPTION}\s*\d))*)({CAPTION})?\s*({NUMBER}(?:\s*,\s*{NUMBER})+)\s*(?:\(([^()]*)\))?\s*(-?)$"
#: Start and end: at a hyphen after a bracket, or between a digit and a letter; or two years.
SPLIT = rf"^(.*?(?<=\)))\s*-\s*{OUTSIDE}(.+)$"
SPLIT_LETTER = rf"^(.*?\d)\s*-\s*(?=[A-Za-z]){OUTSIDE}(.+)$"
UNIT = rf"(?i)^((?:(?:{CAPTION})?\s*{NUMBER}(?:(?:\s*[:,]\s*|\s+){CAPTION}\s*{NUMBER})*)?)\s*(?:\(([^()]*)\))?$"
LEVEL = rf"(?i)((?:{CAPTION})?)\s*({NUMBER})"
BLOCK = r"(?i)^\s*[NM]?\s*(?:\d{4}|\?)\s*:"
BLOCK_GROUP = rf"(?i)(\d{{4}}|\?)\s*:?\s*(?:{VOLUME_CAPTION})?\s*(\d*)\s*\(([^()]*)\)"
WORD = r"[A-Za-z./ ]*[A-Za-z.]"

LEVELS_TYPE = "array<struct<caption:string,value:string>>"
BOUNDARY_TYPE = f"struct<levels:{LEVELS_TYPE},year:string,month:string,day:string>"


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _or_null(text: Column) -> Column:
    return F.when(text != "", text)


def _captions(text: Column) -> Column:
    return F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(LEVEL), F.lit(1)), lambda w: caption(w)))


def _heads(before: Column, after: Column) -> Column:
    """Whether ``before`` only names what ``after`` is part of, as a series does: both have captions, and none in common."""
    left, right = _captions(before), _captions(F.regexp_extract(after, HEAD, 0))
    return F.coalesce(before.rlike(DESIGNATION) & (F.size(right) > 0) & ~F.arrays_overlap(left, right), F.lit(False))


def segments(statement: Column) -> Column:
    """A statement's segments; separators inside brackets, in lists and after a designation don't count."""
    cut = lambda text, mark: F.filter(F.transform(F.split(text, mark), trimmed), lambda x: x != "")

    def step(told: Column, x: Column) -> Column:
        last = F.get(told, F.size(told) - 1)
        return F.when(_heads(last, x), F.concat(F.slice(told, F.lit(1), F.size(told) - 1), F.array(F.concat_ws(", ", last, x)))).otherwise(F.concat(told, F.array(x)))

    marked = F.regexp_replace(F.regexp_replace(statement, SEGMENT, "\u0002"), SLASH, "\u0001")
    return F.flatten(F.transform(cut(marked, "\u0001"), lambda part: F.aggregate(cut(part, "\u0002"), F.array().cast("array<string>"), step)))


def top_level(statement: Column) -> Column:
    """Pieces between any comma, semicolon or spaced slash outside brackets; the whole if none is left."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(statement, r"(?:\s*[,;]\s*|\s+/\s+)(?![^(]*\))(?![^\[]*\])", "\u0001"), "\u0001"), trimmed), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(statement))


def is_list(segment: Column) -> Column:
    """A segment whose items can be told apart: its chronology has as many parts, or one year, or none to give."""
    items, chron = F.size(F.split(F.regexp_extract(segment, LIST, 3), ",")), F.regexp_extract(segment, LIST, 4)
    parts = F.size(F.split(chron, ","))
    return segment.rlike(LIST) & ((chron == "") | (parts == items) | (parts == 1))


def _single(text: Column) -> Column:
    """Year, month and day of one point in time."""
    forms = [
        ("^$", None, None, None),
        (rf"^({YEAR})$", 1, None, None),
        (rf"^({WORD})\s+(\d{{1,2}}),?\s+({YEAR})$", 3, 1, 2),
        (rf"^({YEAR})[:,\s]\s*({WORD})\s+(\d{{1,2}})$", 1, 2, 3),
        (rf"^({YEAR})[:,\s]\s*(\S.*)$", 1, 2, None),
        (rf"^({WORD})[,\s]+({YEAR})$", 2, 1, None),
        (rf"^({WORD})\s+(\d{{1,2}})$", None, 1, 2),
        (rf"^({WORD})$", None, 1, None),
    ]

    def parts(t: Column) -> Column:
        out = None
        for pattern, *at in forms:
            found = F.struct(*((_or_null(F.trim(F.regexp_extract(t, pattern, k))) if k else _null()).alias(n) for n, k in zip(("y", "m", "d"), at, strict=True)))
            out = F.when(t.rlike(pattern), found) if out is None else out.when(t.rlike(pattern), found)
        return out.otherwise(F.struct(t.alias("y"), _null().alias("m"), _null().alias("d")))

    return let(let(F.trim(text), parts), lambda x: F.struct(year(x["y"]).alias("year"), chronology(x["m"]).alias("month"), F.regexp_replace(x["d"], "^0", "").alias("day")))


def _chronology(text: Column) -> Column:
    """Year, month, day and warnings of what stands in brackets: one point, or two with a hyphen."""

    def joined(points: Column) -> Column:
        a, b, two = points[0], F.get(points, F.lit(1)), F.size(points) == 2
        both = lambda k: F.when(~two, a[k]).when(a[k].isNotNull() & b[k].isNotNull(), F.concat_ws("-", a[k], b[k]))
        lone = lambda k: F.when(two & (a[k].isNull() != b[k].isNull()), F.concat_ws(":", F.lit("one_ended"), F.lit(k), F.coalesce(a[k], b[k])))
        years = F.when(a["year"].isNull(), b["year"]).when(b["year"].isNull() | (a["year"] == b["year"]), a["year"]).otherwise(F.concat_ws("-", a["year"], b["year"]))
        return F.struct(years.alias("year"), both("month").alias("month"), both("day").alias("day"), F.array_compact(F.array(lone("month"), lone("day"))).alias("warnings"))

    return let(F.transform(F.split(F.coalesce(text, F.lit("")), r"\s*-\s*", 2), _single), joined)


def _levels(text: Column) -> Column:
    words, values = F.regexp_extract_all(text, F.lit(LEVEL), F.lit(1)), F.regexp_extract_all(text, F.lit(LEVEL), F.lit(2))
    return F.transform(values, lambda v, i: F.struct(caption(F.get(words, i)).alias("caption"), v.alias("value")))


def _boundary(levels: Column, chron: Column) -> Column:
    return F.struct(levels.alias("levels"), chron["year"].alias("year"), chron["month"].alias("month"), chron["day"].alias("day"))


def _units(df: DataFrame) -> DataFrame:
    """start and finish from ``a`` and ``b``; ``bare`` allows one number without a caption."""
    for side in ("a", "b"):
        text = F.trim(side)
        df = df.withColumn(f"_{side}y", text.rlike(rf"^{YEAR}$")).withColumn(f"_{side}l", F.when(F.col(f"_{side}y"), "").otherwise(F.regexp_extract(text, UNIT, 1)))
        df = bound(df, f"_{side}c", _chronology(F.when(F.col(f"_{side}y"), text).otherwise(F.regexp_extract(text, UNIT, 2))))
        alone = F.col(f"_{side}l").rlike(rf"^{NUMBER}$") & ~F.col("bare")
        df = df.withColumn(f"_{side}ok", F.when(F.col(side).isNull(), True).otherwise((text != "") & (F.col(f"_{side}y") | (text.rlike(UNIT) & ~alone))))
        df = df.withColumn(f"_{side}b", _boundary(_levels(F.col(f"_{side}l")), F.col(f"_{side}c")))
    warned = F.concat(F.col("_ac.warnings"), F.when(F.col("b").isNull(), F.array().cast("array<string>")).otherwise(F.col("_bc.warnings")))
    out = df.withColumn("ok", F.col("_aok") & F.col("_bok")).withColumn("start", F.col("_ab")).withColumn("finish", F.when(F.col("b").isNotNull(), F.col("_bb"))).withColumn("warnings", F.concat("warnings", warned))
    return out.drop(*(f"_{s}{k}" for s in "ab" for k in ("y", "l", "c", "ok", "b")))


def _aligned(start: Column, finish: Column) -> tuple[Column, Column]:
    """Levels of both sides, where captions differ and one place alone fits, the shorter side moved down."""

    def fits(long: Column, short: Column, k: Column) -> Column:
        return F.forall(F.transform(short, lambda x, i: F.coalesce(x["caption"] == F.get(long, i + k)["caption"], F.lit(True))), lambda x: x)

    def moved(long: Column, short: Column) -> Column:
        room = F.size(long) - F.size(short)
        places = F.filter(F.sequence(F.lit(0), F.greatest(room, F.lit(0))), lambda k: fits(long, short, k))
        empty = F.struct(_null().alias("caption"), _null().alias("value"))
        shift = (room > 0) & (F.size(short) > 0) & ~fits(long, short, F.lit(0)) & (F.size(places) == 1)
        return F.when(shift, F.concat(F.array_repeat(empty, F.get(places, F.lit(0))), short)).otherwise(short)

    return moved(finish, start), moved(start, finish)


def ranges(statements: DataFrame, column: str = "stmt") -> DataFrame:
    """Ranges of each row's statement; rows aren't deduplicated. Keeps the statement only."""
    text = F.trim(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"^\s+|\s+$", ""))
    base = statements.select(F.col(column).alias("stmt"), text.alias("text"))
    blocks = base.where(F.col("text").rlike(BLOCK)).transform(_block_ranges)
    plain = base.where(~F.col("text").rlike(BLOCK)).transform(_plain_ranges)
    return plain.unionByName(blocks)


def parse_distinct(statements: DataFrame, column: str = "stmt") -> DataFrame:
    """Ranges of each distinct statement, once."""
    return ranges(distinct(statements, column), column)


def _plain_ranges(base: DataFrame) -> DataFrame:
    cut = base.select("stmt", "text", F.posexplode_outer(segments(F.col("text"))).alias("seg", "segment"))
    listed = F.coalesce(is_list(F.col("segment")), F.lit(False))
    chron = F.regexp_extract("segment", LIST, 4)
    items = F.transform(F.split(F.regexp_extract("segment", LIST, 3), ","), trimmed)
    parts = F.transform(F.split(chron, ","), trimmed)
    own = lambda p: _or_null(F.regexp_extract(p, rf"({YEAR})\s*$|^({YEAR})", 1))
    later = lambda i: F.get(F.filter(F.transform(F.slice(parts, i + 1, F.size(parts)), own), lambda y: y.isNotNull()), F.lit(0))
    carried = F.transform(parts, lambda p, i: F.when(own(p).isNotNull() | p.rlike(rf"^{YEAR}"), p).otherwise(F.concat_ws(" ", p, later(i))))
    per_item = F.when(F.size(parts) == F.size(items), carried).when(parts[0].rlike(rf"^{YEAR}$"), F.array_repeat(parts[0], F.size(items))).otherwise(F.array_repeat(F.lit(""), F.size(items)))
    dropped = (chron != "") & (F.size(parts) == 1) & (F.size(items) > 1) & ~parts[0].rlike(rf"^{YEAR}$")
    word = F.regexp_replace(F.regexp_extract("segment", LIST, 2), r"(?i)s(\.?)$", "$1")
    long = F.transform(items, lambda v, i: F.concat(F.regexp_extract("segment", LIST, 1), F.lit(" "), word, F.lit(" "), v, F.when(F.get(per_item, i) != "", F.concat(F.lit(" ("), F.get(per_item, i), F.lit(")"))).otherwise("")))
    ends = lambda v: F.regexp_extract(v, r"(\d+)[A-Za-z]?$", 1).try_cast("int")
    begins = lambda v: F.regexp_extract(v, r"^(\d+)", 1).try_cast("int")
    gaps = F.transform(items, lambda v, i: (i + 1 < F.size(items)) & F.coalesce(begins(F.get(items, i + 1)) != ends(v) + 1, F.lit(False)))
    open_list = F.regexp_extract("segment", LIST, 5) == "-"
    last = lambda i: i + 1 == F.size(items)
    entry = lambda t, i: F.struct(t.alias("text"), F.get(gaps, i).alias("gap"), (open_list & last(i)).alias("open"), F.lit(True).alias("bare"), F.when(dropped, F.array(F.concat(F.lit("undistributable:"), chron))).otherwise(F.array().cast("array<string>")).alias("warnings"))
    whole = F.array(F.struct(F.regexp_replace("segment", r"\s*-\s*$", "").alias("text"), F.lit(False).alias("gap"), F.col("segment").rlike(r"-\s*$").alias("open"), F.lit(False).alias("bare"), F.array().cast("array<string>").alias("warnings")))
    each = cut.select("*", F.posexplode(F.when(listed, F.transform(long, entry)).otherwise(whole)).alias("nth", "item"))
    each = each.select("stmt", "text", "seg", "nth", F.trim("item.text").alias("unit"), F.col("item.gap").alias("gap_after"), F.col("item.open").alias("open_ended"), F.col("item.bare").alias("bare"), F.col("item.warnings").alias("warnings"), listed.alias("listed"))
    years = rf"^({YEAR})\s*-\s*({YEAR})$"
    pattern = lambda k: F.when(F.col("unit").rlike(SPLIT), F.regexp_extract("unit", SPLIT, k)).when(F.col("unit").rlike(SPLIT_LETTER), F.regexp_extract("unit", SPLIT_LETTER, k)).when(F.col("unit").rlike(years), F.regexp_extract("unit", years, k))
    each = each.withColumn("b", pattern(2)).withColumn("a", F.coalesce(pattern(1), "unit"))
    read = _units(each)
    s, f = _aligned(F.col("start.levels"), F.coalesce("finish.levels", F.array().cast(LEVELS_TYPE)))
    read = read.withColumn("_s", s).withColumn("_f", f)
    read = read.withColumn("start", F.col("start").withField("levels", F.col("_s"))).withColumn("finish", F.when(F.col("finish").isNotNull(), F.col("finish").withField("levels", F.col("_f"))))
    row = F.struct("listed", "ok", "start", "finish", "open_ended", "gap_after", "warnings")
    # A statement's ranges come together to be numbered; a list with an unreadable item gives none.
    together = read.groupBy("stmt", "text").agg(F.sort_array(F.collect_list(F.struct("seg", "nth", row.alias("r")))).alias("all"))
    bad = F.transform(F.filter("all", lambda x: ~x["r"]["ok"] & x["r"]["listed"]), lambda x: x["seg"])
    good = F.filter("all", lambda x: x["r"]["ok"] & ~F.array_contains(bad, x["seg"]))
    skipped = F.size("all") > F.size("good")
    found = bound(together, "good", good).withColumn("skipped", skipped)
    uncertain = F.col("text").rlike(r"^\d{4}\s*\?$")
    review = F.col("text").rlike(r"^\d+\s*\??$")
    none = F.array().cast("array<string>")
    empty = F.array().cast(LEVELS_TYPE)
    lone_year = F.struct(empty.alias("levels"), F.regexp_extract("text", r"^(\d{4})", 1).alias("year"), _null().alias("month"), _null().alias("day"))
    rows = found.select("stmt", "text", "skipped", F.posexplode_outer("good").alias("pos", "g"))
    has = F.col("pos").isNotNull()
    return rows.select(
        "stmt",
        F.when(has, F.col("pos")).when(uncertain, 0).alias("pos"),
        F.when(has, F.col("g.r.start")).when(uncertain, lone_year).alias("start"),
        F.col("g.r.finish").alias("finish"),
        F.coalesce("g.r.open_ended", F.lit(False)).alias("open_ended"),
        F.coalesce("g.r.gap_after", F.lit(False)).alias("gap_after"),
        F.when(has, F.concat("g.r.warnings", F.when(F.col("skipped") & (F.col("pos") == 0), F.array(F.lit("segment_skipped"))).otherwise(none))).when(uncertain, F.array(F.lit("uncertain_year"))).otherwise(none).alias("warnings"),
        F.when(has | uncertain, "ok").when(review, "review").otherwise("failed").alias("status"),
    )


def _block_ranges(base: DataFrame) -> DataFrame:
    """Blocks: a year, an upper number, and items with a lower number and months or days."""
    get = lambda k: F.regexp_extract_all("text", F.lit(BLOCK_GROUP), F.lit(k))
    blocks = base.select("stmt", "text", F.posexplode_outer(F.arrays_zip(get(1).alias("year"), get(2).alias("upper"), get(3).alias("body"))).alias("k", "block"))
    items = F.transform(F.split("block.body", r",(?![^\[]*\])"), trimmed)
    rows = blocks.select("stmt", "text", "k", F.col("block.year").alias("y"), F.col("block.upper").alias("upper"), F.posexplode_outer(items).alias("i", "item"))
    shape = rf"^({NUMBER})?\s*(?:\[([^\]]*)\])?$"
    rows = rows.withColumn("lower", F.regexp_extract("item", shape, 1)).withColumn("chron", _chronology(F.regexp_extract("item", shape, 2)))
    some = F.max((F.col("upper") != "").cast("int")).over(Window.partitionBy("stmt")) == 1
    level = lambda v: F.struct(_null().alias("caption"), _or_null(v).alias("value"))
    rows = rows.withColumn("levels", F.when(some, F.array(level(F.col("upper")), level(F.col("lower")))).otherwise(F.array(level(F.col("lower")))))
    ok = F.col("item").isNotNull() & F.col("item").rlike(shape) & (F.col("item") != "")
    pos = F.row_number().over(Window.partitionBy("stmt").orderBy(F.when(ok, 0).otherwise(1), "k", "i")) - 1
    notes = F.array_compact(F.array(F.when(F.col("text").rlike(r"(?i)^\s*[NM]\s*[\d?]"), F.lit("marker_ignored")), F.when(F.col("y") == "?", F.lit("year_unknown"))))
    start = F.struct("levels", F.when(F.col("y") != "?", F.col("y")).alias("year"), F.col("chron.month").alias("month"), F.col("chron.day").alias("day"))
    kept = rows.withColumn("pos", F.when(ok, pos)).withColumn("first", pos == 0).where("pos is not null or first")
    return kept.select(
        "stmt", "pos", F.when(ok, start).alias("start"), _null(BOUNDARY_TYPE).alias("finish"), F.lit(False).alias("open_ended"), F.lit(False).alias("gap_after"), F.concat(notes, F.coalesce("chron.warnings", F.array().cast("array<string>"))).alias("warnings"), F.when(ok, "ok").otherwise("failed").alias("status")
    )

