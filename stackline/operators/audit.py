"""Audits of a conversion: what a statement states against what its fields hold.

A value is announced only if a warning names that value, whole; what a warning says beside it, such as the name of
a level, announces nothing. Beside the values themselves, the ends of ranges are audited: what only the end states, equal
ends written once below a level that ranges, an end written as the start, prose where a code belongs, and captions that no
value fills. Runs are kept as snapshots, and two of them compared.

Defined cases: repeated numbers count once; a statement that failed or is held is not a loss; in comparing, null keys are
equal to each other, and a row that one run lacks is new or gone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackline.functions.codes import chronology
from stackline.operators import convert

#: Kinds of warnings that name a level before the value, and those that name the value alone.
_OF_LEVELS, _OF_VALUES = ("uncodeable", "unpairable", "unplaceable", "caption_conflict", "one_ended"), ("undistributable", "not_encoded", "read_by_parser")


def structured(warnings: Column) -> Column:
    """(kind, level, value) of each warning; what it doesn't name is null."""

    def read(w: Column) -> Column:
        kind = F.substring_index(w, ":", 1)
        at = lambda n: F.get(F.split(w, ":", n), F.lit(n - 1))
        levelled = kind.isin(*_OF_LEVELS)
        return F.struct(kind.alias("kind"), F.when(levelled, F.get(F.split(w, ":", 3), F.lit(1))).alias("level"), F.when(levelled, at(3)).when(kind.isin(*_OF_VALUES), at(2)).alias("value"))

    return F.transform(warnings, read)


def _short(x: Column) -> Column:
    return F.regexp_replace(x, r"^0+(?=\d)", "")


def values_in(text: Column) -> Column:
    """Numbers, and codes of words for months and seasons, that a text names."""
    numbers = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))
    words = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z]{3,})"), F.lit(1)), chronology_of), lambda x: x.rlike(r"^\d\d$"))
    return F.array_distinct(F.transform(F.concat(numbers, words), _short))


def announced(warnings: Column) -> Column:
    """The values that warnings name."""
    named = F.filter(F.transform(structured(warnings), lambda w: w["value"]), lambda v: v.isNotNull())
    return F.array_distinct(F.flatten(F.transform(named, lambda v: values_in(v))))


def conserved(converted: DataFrame) -> DataFrame:
    """stated, emitted and missing values of each statement, and its status: fail, review, loss, warn or ok."""
    values = F.flatten(F.transform("f863", lambda f: F.flatten(F.transform(f, lambda s: F.regexp_extract_all(s["value"], F.lit(r"(\d+)"), F.lit(1))))))
    stated, emitted = values_in(F.col("stmt")), F.array_distinct(F.transform(values, _short))
    # the second half of a split year is written whole
    missing = F.filter(F.array_except("stated", "emitted"), lambda x: ~F.exists("emitted", lambda y: (F.length(y) == 4) & (F.length(x) <= 2) & y.endswith(F.lpad(x, 2, "0"))))
    out = converted.withColumn("stated", stated).withColumn("emitted", emitted).withColumn("missing", missing)
    unannounced = F.size(F.array_except("missing", announced(F.col("warnings")))) > 0
    verdict = F.when(F.col("status") == "failed", "fail").when(F.col("status") == "review", "review").when(unannounced, "loss").when(F.size("warnings") > 0, "warn").otherwise("ok")
    return out.withColumn("verdict", verdict)


def chronology_of(word):
    """The code of one word, or the word."""
    return chronology(word)


def tally(audited: DataFrame) -> DataFrame:
    return audited.groupBy("verdict").agg(F.count(F.lit(1)).alias("statements")).orderBy("verdict")


def review_index(linked: DataFrame) -> DataFrame:
    """Per record how many statements were converted, held and flagged."""
    count = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).alias(name)
    return linked.groupBy("rec").agg(count(F.size("f863") > 0, "converted"), count(F.col("status") == "review", "held"), count(F.col("flagged"), "flagged"), F.count(F.lit(1)).alias("statements"))


def endpoints(written: DataFrame, convention: convert.Convention = convert.STANDARD) -> DataFrame:
    """What is wrong with each range's written field, as arrays of texts: undeclared, end_only, end_only_silent, prose, collapsed, phantom.

    written: the parser's columns of each range, ``declared`` (code, value) of its 853, ``v863`` (code, value) and ``warnings``.
    """
    none = F.array().cast("array<string>")
    codes = F.transform("v863", lambda x: x["code"])
    value = lambda c: F.get(F.filter("v863", lambda x: x["code"] == c), F.lit(0))["value"]
    letters = F.array(*map(F.lit, convention.enum))
    depth = F.greatest(F.size("start.levels"), F.coalesce(F.size("finish.levels"), F.lit(0)))
    said = announced(F.col("warnings"))
    level = lambda side, i: F.get(f"{side}.levels", i)["value"]
    entry = lambda i: F.struct(F.get(letters, i).alias("code"), level("start", i).alias("a"), level("finish", i).alias("b"))
    enum = F.when(F.coalesce(depth, F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), F.greatest(depth - 1, F.lit(0))), entry)).otherwise(F.array().cast("array<struct<code:string,a:string,b:string>>"))
    chron = F.array(*(F.struct(F.lit(convention.chron[k]).alias("code"), F.col(f"start.{k}").alias("a"), F.col(f"finish.{k}").alias("b")) for k in ("year", "month") if k in convention.chron))
    ended = F.filter(enum, lambda x: x["a"].isNull() & x["b"].isNotNull() & x["code"].isNotNull() & ~F.array_contains(codes, x["code"]))
    shown = lambda x: F.concat(F.lit("$"), x["code"], F.lit(" "), x["b"])
    silent = F.filter(ended, lambda x: F.size(F.array_except(values_in(x["b"]), said)) > 0)

    def folded(levels: Column) -> Column:
        """Equal ends written once below a level that ranges."""

        def step(state: Column, x: Column) -> Column:
            both = x["a"].isNotNull() & x["b"].isNotNull()
            once = both & (x["a"] == x["b"]) & state["ranged"] & ~x["a"].contains("-") & (value(x["code"]) == x["a"])
            return F.struct((state["ranged"] | (both & (x["a"] != x["b"]))).alias("ranged"), F.when(F.coalesce(once, F.lit(False)), F.array_append(state["out"], F.concat(F.lit("$"), x["code"], F.lit(" "), x["a"], F.lit("-"), x["b"]))).otherwise(state["out"]).alias("out"))

        return F.aggregate(levels, F.struct(F.lit(False).alias("ranged"), none.alias("out")), step, lambda s: s["out"])

    coded = F.transform(F.filter("declared", lambda x: F.lower(F.trim(x["value"])).isin("(month)", "(season)")), lambda x: x["code"])
    prose = F.filter("v863", lambda x: F.array_contains(coded, x["code"]) & x["value"].rlike("[A-Za-z]"))

    def invented(k: str, other: str) -> Column:
        c = convention.chron.get(k)
        if c is None:
            return F.lit(None).cast("string")
        is_end = F.col(f"start.{k}").isNull() & F.col(f"start.{other}").isNotNull() & (value(F.lit(c)) == F.col(f"finish.{k}"))
        return F.when(is_end, F.concat(F.lit(f"${c} "), F.col(f"finish.{k}")))

    ranged = F.col("finish").isNotNull()
    return written.select(
        "stmt", "pos",
        F.array_except(F.transform("declared", lambda x: x["code"]), codes).alias("undeclared"),
        F.when(ranged, F.transform(ended, shown)).otherwise(none).alias("end_only"),
        F.when(ranged, F.transform(silent, shown)).otherwise(none).alias("end_only_silent"),
        F.transform(prose, lambda x: F.concat(F.lit("$"), x["code"], F.lit(" "), x["value"])).alias("prose"),
        F.when(ranged, F.concat(folded(enum), folded(chron))).otherwise(none).alias("collapsed"),
        F.when(ranged, F.array_compact(F.array(invented("year", "month"), invented("month", "year")))).otherwise(none).alias("phantom"),
    )


def drift(before: DataFrame, after: DataFrame, keys: list[str], verdict: str = "verdict") -> DataFrame:
    """keys, before, after and ``drift`` of two runs: new, gone, fixed (ok now), broken (no longer ok), changed or unchanged.

    A verdict ``known`` is a judgement and no prediction, so it never drifts.
    """
    a, b = before.select(*keys, F.col(verdict).alias("before"), F.lit(True).alias("_a")).alias("a"), after.select(*keys, F.col(verdict).alias("after"), F.lit(True).alias("_b")).alias("b")
    met = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    same = F.col("before").eqNullSafe(F.col("after")) | (F.col("before") == "known")
    what = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(F.coalesce(same, F.lit(False)), "unchanged").when(F.col("after") == "ok", "fixed").when(F.col("before") == "ok", "broken").otherwise("changed")
    return met.select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys), "before", "after", what.alias("drift"))
