"""What a change would do, seen before it is made.

A candidate pattern is tried alone: what the library's patterns fit is kept for each distinct statement as one number
whose bits are the patterns (``fits``), so the library isn't run again, and only statements whose winner changes, and the
records that hold them, go on. A page of records is cut out by joins before anything is parsed, and records that are kept
separate are numbered strictly, all others with runs that grow.

Defined cases: equal statements are judged once; a candidate goes before all others (``place`` 0) unless a place is
given; records in no set go on as they are; a record that is both chosen and skipped is skipped; null statements are
unmatched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackline.functions.shared import settled
from stackline.operators import convert, number, parse
from stackline.operators.rules import whole

#: Patterns of which a number holds the bits.
WIDTH = 63


def fits(statements: DataFrame, patterns: list[dict], column: str = "stmt") -> DataFrame:
    """stmt, and ``fits``, an array of numbers whose bits say which patterns fit the whole of it, in order of use."""
    text = F.trim(F.col(column))

    def bits(some: list[dict]) -> Column:
        out = F.lit(0).cast("long")
        for k, p in enumerate(some):
            out = out.bitwiseOR(F.when(F.coalesce(text.rlike(whole(p["regex"])), F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
        return out

    parts = [bits(patterns[k : k + WIDTH]) for k in range(0, len(patterns), WIDTH)]
    return statements.select(column).distinct().select(F.col(column).alias("stmt"), (F.array(*parts) if parts else F.array().cast("array<bigint>")).alias("fits"))


def first(held: Column) -> Column:
    """The place of the first pattern among the bits; null if none fits."""
    lowest = F.transform(held, lambda x, i: F.when(x != 0, i * WIDTH + F.bit_count(x.bitwiseAND(-x) - 1)))
    return F.array_min(F.array_compact(lowest))


def winners(kept: DataFrame, patterns: list[dict]) -> DataFrame:
    """stmt and ``source``, the id of the pattern that reads it, or ``parser``."""
    ids = F.array(*(F.lit(p["id"]) for p in patterns)).cast("array<string>")
    return kept.select("stmt", F.coalesce(F.get(ids, first(F.col("fits"))), F.lit("parser")).alias("source"))


def changed(kept: DataFrame, patterns: list[dict], candidate: dict, place: int = 0) -> DataFrame:
    """stmt, before and after of each statement that the candidate would take, at ``place`` among the patterns."""
    ids = F.array(*(F.lit(p["id"]) for p in patterns)).cast("array<string>")
    taken = F.coalesce(F.trim("stmt").rlike(whole(candidate["regex"])), F.lit(False))
    told = kept.withColumn("_first", first(F.col("fits")))
    return told.where(taken & (F.col("_first").isNull() | (F.col("_first") >= place))).select("stmt", F.coalesce(F.get(ids, F.col("_first")), F.lit("parser")).alias("before"), F.lit(candidate["id"]).alias("after"))


def records_changed(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Per record how many of its statements change hands, and from how many sources; other records aren't touched. rows: rec, stmt."""
    met = rows.select("rec", "stmt").join(changes, "stmt")
    return met.groupBy("rec").agg(F.count(F.lit(1)).alias("statements"), F.count_distinct("before").alias("sources"), F.max("after").alias("after"))


def page(rows: DataFrame, chosen: DataFrame | None = None, skipped: DataFrame | None = None) -> DataFrame:
    """The rows of the records asked for, before anything is read."""
    rows = rows if chosen is None else rows.join(chosen.select("rec").distinct(), "rec", "left_semi")
    return rows if skipped is None else rows.join(skipped.select("rec").distinct(), "rec", "left_anti")


def records(rows: DataFrame, order: list[str], chosen: DataFrame | None = None, skipped: DataFrame | None = None, separate: DataFrame | None = None, convention: convert.Convention = convert.STANDARD) -> DataFrame:
    """rec, order, stmt, f863, link, first_seq, run_853 and ``separate`` of each statement with fields. rows: rec, order, stmt."""
    asked = page(rows, chosen, skipped).select("rec", *order, "stmt")
    fields = settled(convert.convert_statements(parse.parse_distinct(asked), convention).select("stmt", "f853", "f863"))
    shown = ["rec", *order, "stmt", "f863", F.col("link").cast("long").alias("link"), F.col("first_seq").cast("long").alias("first_seq"), "run_853"]
    if separate is None:
        return number.merged(asked, order, fields=fields).select(*shown, F.lit(False).alias("separate"))
    apart = separate.select("rec").distinct()
    strict = number.numbered(asked.join(apart, "rec", "left_semi"), order, fields).select(*shown, F.lit(True).alias("separate"))
    return strict.unionByName(number.merged(asked.join(apart, "rec", "left_anti"), order, fields=fields).select(*shown, F.lit(False).alias("separate")))
