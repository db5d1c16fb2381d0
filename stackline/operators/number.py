"""Links and sequences of a record's statements: gaps and islands over statement order.

Statements without fields neither join nor break a run. With ``merge=False`` a run is a
stretch of equal patterns, a window. With ``merge=True`` a statement also joins when its pattern
and the run's fullest so far agree where both speak and one holds the other's captions; as
that compares with what has built up, which no window does, the sorted statements of a record
are read in one pass that keeps the open run alone.

Defined cases: ties in order go by statement; a record without fields gives no row; order columns
may have any name.

Where a table of fields by statement is given, rows move with a pattern and a number of fields alone, and the fields come
back by statement when all is numbered.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _slim(rows: DataFrame, fields: DataFrame, pattern: str, n: str) -> DataFrame:
    """The rows whose statement has fields, with its 853 as JSON and how many 863s there are."""
    return rows.join(fields.where(F.size("f863") > 0).select("stmt", F.to_json("f853").alias(pattern), F.size("f863").alias(n)), "stmt")


def numbered(converted: DataFrame, order: list[str], fields: DataFrame | None = None) -> DataFrame:
    """``link`` and ``run_853`` of each statement, strict: a new link wherever the pattern changes. Keys: rec, then ``order``.

    fields: stmt (once each), f853 and f863, where ``converted`` has none.
    """
    w = Window.partitionBy("rec").orderBy(*order)
    if fields is None:
        kept = converted.where(F.size("f863") > 0).withColumns({"_pattern": F.to_json(F.struct("f853")), "_n": F.size("f863")})
    else:
        kept = _slim(converted, fields, "_pattern", "_n")
    changed = kept.withColumn("_new", F.coalesce(F.col("_pattern") != F.lag("_pattern").over(w), F.lit(True)).cast("int"))
    linked = changed.withColumn("link", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    before = Window.partitionBy("rec", "link").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    told = linked.withColumn("first_seq", F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1).drop("_pattern", "_n")
    return (told if fields is None else told.join(fields.select("stmt", "f853", "f863"), "stmt")).withColumn("run_853", F.col("f853"))


def existing(records: DataFrame) -> DataFrame:
    """rec, pos, link, enum_codes and year, month, day codes of each 853 that a record has (rec, fields)."""
    each = records.select("rec", F.explode("fields").alias("f")).where("f.tag = '853'")
    subs = F.filter("f.subfields", lambda x: x["code"].rlike("^[a-m]$"))
    is_chron = lambda x: F.lower(F.trim(x["value"])).isin("(year)", "(month)", "(season)", "(day)")
    code = lambda *names: F.get(F.filter(subs, lambda x: F.lower(F.trim(x["value"])).isin(*names)), F.lit(0))["code"]
    eight = F.get(F.filter("f.subfields", lambda x: x["code"] == "8"), F.lit(0))["value"]
    link = F.when(eight.rlike(r"^\d+"), F.regexp_extract(eight, r"^(\d+)", 1).try_cast("int"))
    enum = F.array_sort(F.transform(F.filter(subs, lambda x: ~is_chron(x)), lambda x: x["code"]))
    return each.select("rec", F.col("f.pos").alias("pos"), link.alias("link"), enum.alias("enum_codes"), code("(year)").alias("year"), code("(month)", "(season)").alias("month"), code("(day)").alias("day")).where("link is not null")


def conformed(converted: DataFrame, has: DataFrame, order: list[str], enum: tuple[str, ...], chron: dict[str, str]) -> DataFrame:
    """Statements with ``conform``, the link of the first 853 of their record that declares all they need, and their values in its codes.

    A record has few 853s, so the join by record stays small. enum, chron: the convention that ``f863`` is in.
    """
    codes = F.array_distinct(F.flatten(F.transform("f863", lambda f: F.transform(f, lambda x: x["code"]))))
    depth = F.coalesce(F.array_max(F.transform(codes, lambda c: F.array_position(F.array(*map(F.lit, enum)), c))), F.lit(0))
    needs = {k: F.array_contains(codes, c) for k, c in chron.items()}
    covers = F.size("enum_codes") >= depth
    for k, need in needs.items():
        covers &= ~need | F.col(f"h.{k}").isNotNull()
    joined = converted.alias("c").join(has.alias("h"), (F.col("c.rec") == F.col("h.rec")) & (F.size("f863") > 0) & covers, "left")
    entry = F.struct(F.col("h.pos").alias("p"), F.col("h.link").alias("link"), F.col("h.enum_codes").alias("enum_codes"), *(F.col(f"h.{k}").alias(k) for k in ("year", "month", "day")))
    keys = ["rec", *order, "stmt"]
    first = joined.groupBy(*(F.col(f"c.{k}").alias(k) for k in keys)).agg(F.first("c.f853").alias("f853"), F.first("c.f863").alias("f863"), F.min(F.when(F.col("h.link").isNotNull(), entry)).alias("to"))

    def recoded(x):
        new = F.when(F.lit(False), F.lit(""))
        for k, c in enumerate(enum):
            new = new.when(x["code"] == c, F.get("to.enum_codes", F.lit(k)))
        for k, c in chron.items():
            new = new.when(x["code"] == c, F.col(f"to.{k}"))
        return F.struct(new.otherwise(x["code"]).alias("code"), x["value"].alias("value"))

    changed = F.transform("f863", lambda f: F.transform(f, recoded))
    return first.select(*keys, "f853", F.when(F.col("to").isNotNull(), changed).otherwise(F.col("f863")).alias("f863"), F.col("to.link").alias("conform"))


def _nth_free(n: Column, used: Column) -> Column:
    """The nth positive number that isn't among the few ``used``."""
    return F.aggregate(F.array_sort(used), n, lambda x, u: F.when(u <= x, x + 1).otherwise(x))


@lru_cache(maxsize=100_000)
def _meets(full: str, pattern: str) -> tuple[bool, bool]:
    """Whether a pattern joins a run with this fullest one, and whether it is itself fuller. Both as JSON; records share few."""
    a, b = ({x["code"]: x["value"] for x in json.loads(p)} for p in (full, pattern))
    return all(b[c] == v for c, v in a.items() if c in b) and (a.keys() <= b.keys() or b.keys() <= a.keys()), len(b) > len(a)


def merged(converted: DataFrame, order: list[str], taken: str | None = None, fields: DataFrame | None = None) -> DataFrame:
    """A row for each statement with fields: ``link``, ``run_853`` (its run's fullest), ``first_seq``, ``merged``.

    taken: a column of links that the record has already, which new runs leave out. A column
    ``conform`` gives a statement its link; it then ends the run before it. fields: stmt (once each), f853 and f863, where
    ``converted`` has none.
    """
    own = lambda name: f"__number_{name}"
    conform = F.col("conform").cast("int") if "conform" in converted.columns else F.lit(None).cast("int")
    had = F.transform(F.filter(F.col(taken), lambda x: x.rlike(r"^\d+$")), lambda x: x.try_cast("int")) if taken else F.array().cast("array<int>")
    extra = [conform.alias(own("conform")), had.alias(own("had"))]
    if fields is None:
        rows = converted.where(F.size("f863") > 0).select("rec", *order, "stmt", "f853", "f863", *extra, F.size("f863").alias(own("n")), F.to_json("f853").alias(own("pattern")))
    else:
        rows = _slim(converted, fields, own("pattern"), own("n")).select("rec", *order, "stmt", *extra, own("n"), own("pattern"))
    schema = T.StructType([*rows.schema, T.StructField(own("run"), T.IntegerType()), T.StructField(own("seq"), T.LongType()), T.StructField(own("subset"), T.BooleanType())])
    places = [rows.columns.index(c) for c in ("rec", own("conform"), own("n"), own("pattern"))]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rec, run, seq, full = None, 0, 1, None  # full: the open run's fullest pattern; None where no run is open
        for b in batches:
            runs, seqs, subsets = [], [], []
            for key, to, n, pattern in zip(*(b.column(k).to_pylist() for k in places), strict=True):
                if key != rec:
                    rec, run, full = key, 0, None
                if to is not None:
                    full = None
                    runs.append(0), seqs.append(0), subsets.append(False)
                    continue
                joins, fuller = _meets(full, pattern) if full is not None else (False, False)
                subsets.append(joins and full != pattern)
                if not joins:
                    run, seq = run + 1, 1
                full = pattern if fuller or not joins else full
                runs.append(run), seqs.append(seq)
                seq += n
            added = [pa.array(runs, pa.int32()), pa.array(seqs, pa.int64()), pa.array(subsets, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=schema.names)

    seen = rows.repartition("rec").sortWithinPartitions("rec", *order, "stmt").mapInArrow(step, schema)
    by_run, by_rec = Window.partitionBy("rec", own("run")), Window.partitionBy("rec")
    before = Window.partitionBy("rec", own("conform")).orderBy(*order, "stmt").rowsBetween(Window.unboundedPreceding, -1)
    is_own = F.col(own("conform")).isNull()
    used = F.array_distinct(F.concat(F.flatten(F.collect_set(own("had")).over(by_rec)), F.collect_set(own("conform")).over(by_rec)))
    if fields is None:
        full = F.max(F.struct(F.size("f853").alias("s"), "f853")).over(by_run)["f853"]
    else:
        told = F.from_json(own("pattern"), fields.schema["f853"].dataType)
        full = F.from_json(F.max(F.struct(F.size(told).alias("s"), F.col(own("pattern")).alias("f"))).over(by_run)["f"], fields.schema["f853"].dataType)
    told = seen.withColumn(own("used"), used).withColumn(own("full"), full).withColumn(own("any"), F.max(own("subset")).over(by_run)).withColumn(own("before"), F.coalesce(F.sum(own("n")).over(before), F.lit(0)) + 1)
    told = told if fields is None else told.join(fields.select("stmt", "f863"), "stmt")
    return told.select(
        "rec", *order, "stmt", "f863",
        F.when(is_own, _nth_free(F.col(own("run")), F.col(own("used")))).otherwise(F.col(own("conform"))).alias("link"),
        F.when(is_own, F.col(own("seq"))).otherwise(F.col(own("before"))).cast("int").alias("first_seq"),
        F.when(is_own, F.col(own("full"))).alias("run_853"), (is_own & F.col(own("any"))).alias("merged"), (~is_own).alias("conformed"),
    )


def fields(linked: DataFrame) -> DataFrame:
    """A row for each 863: rec, link, seq, fields."""
    out = linked.select("rec", "link", "first_seq", F.posexplode("f863").alias("k", "field"))
    return out.select("rec", "link", (F.col("first_seq") + F.col("k")).alias("seq"), "field")
