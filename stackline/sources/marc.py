"""MARC 21 records in ISO 2709: a scan and a sink in built-in expressions.

Files are split at the record terminator, so a large file is read by many tasks. Lengths
and offsets of the directory are bytes, so slices are taken from binary. A record whose
lengths don't hold is kept in its place as ``unreadable``.

A record's key is its file and its place in it (``key``): places repeat from file to file. A table without
``file`` is of one file.

Defined cases: bytes that aren't UTF-8 are replaced; an empty file gives none; control
fields have ``data``, others ``ind1``, ``ind2`` and ``subfields``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from stackline.functions.codes import bound, let
from stackline.functions.shared import file_system

END_RECORD, END_FIELD, SUBFIELD = "\x1d", "\x1e", "\x1f"
SUBFIELDS = "array<struct<code:string,value:string>>"


def read_marc(spark: SparkSession, path: str) -> DataFrame:
    """file, rec_idx (place in the file), leader, fields, raw, unreadable."""
    lines = spark.read.option("lineSep", END_RECORD).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("raw"))
    # Numbered when blank ones are gone, so the records of a split have numbers one after the other.
    lines = lines.where(F.trim(F.regexp_replace(F.col("raw").cast("string"), r"[\r\n]", "")) != "").withColumn("row", F.monotonically_increasing_id())
    text = lambda start, size: F.substring(F.col("raw"), start, size).cast("string")
    number = lambda t: F.when(t.rlike(r"^\d+$"), t.try_cast("int"))
    size, base = number(text(1, 5)), number(text(13, 5))
    # What several columns mention is bound, so that it is read once a record.
    out = bound(lines, "_h", F.struct(text(1, 24).alias("leader"), base.alias("base"), size.alias("size")))
    out = out.select("*", "_h.*").drop("_h").withColumn("entries", ((F.col("base") - 25) / 12).cast("int"))
    framed = (F.col("size") == F.octet_length("raw") + 1) & (F.col("base") >= 25) & ((F.col("base") - 25) % 12 == 0)
    framed &= F.hex(F.expr("substring(raw, base, 1)")) == "1E"
    out = bound(out, "framed", F.coalesce(framed, F.lit(False)))
    listing = F.expr("substring(raw, 25, base - 25)").cast("string")
    # Numbers of a damaged directory give null, which shows below.
    at = lambda e, i, start, size: e.substr(i * 12 + start, F.lit(size))
    parsed = lambda e: F.transform(F.sequence(F.lit(0), F.greatest(F.col("entries") - 1, F.lit(0))), lambda i: F.struct(i.alias("pos"), at(e, i, 1, 3).alias("tag"), number(at(e, i, 4, 4)).alias("length"), number(at(e, i, 8, 5)).alias("start")))
    out = bound(out, "directory", F.when(F.col("framed") & (F.col("entries") > 0), let(listing, parsed)))
    whole = F.forall("directory", lambda e: F.coalesce(F.col("base") + e["start"] + e["length"] <= F.octet_length("raw") + 1, F.lit(False)))
    out = bound(out, "unreadable", ~F.coalesce(F.col("framed") & (whole | (F.col("entries") == 0)), F.lit(False)))

    def field(e: Column) -> Column:
        return let(F.regexp_replace(F.make_valid_utf8(F.substring(F.col("raw"), F.col("base") + e["start"] + 1, e["length"]).cast("string")), f"{END_FIELD}$", ""), lambda body: named(e, body))

    def named(e: Column, body: Column) -> Column:
        control = e["tag"] < "010"
        parts = let(F.split(body, SUBFIELD), lambda p: F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))))
        subs = F.transform(parts, lambda p: F.struct(F.substring(p, 1, 1).alias("code"), p.substr(F.lit(2), F.length(p)).alias("value")))
        return F.struct(e["pos"].alias("pos"), e["tag"].alias("tag"), F.when(control, body).alias("data"), F.when(~control, F.substring(body, 1, 1)).alias("ind1"), F.when(~control, F.substring(body, 2, 1)).alias("ind2"), F.when(~control, subs).otherwise(F.array().cast(SUBFIELDS)).alias("subfields"))

    out = bound(out, "fields", F.when(~F.col("unreadable"), F.transform("directory", field)))
    return out.select("file", "block", "row", "leader", "fields", F.concat("raw", F.lit(END_RECORD).cast("binary")).alias("raw"), "unreadable")


def with_index(records: DataFrame) -> DataFrame:
    """rec_idx: a record's place in its file, from the sizes of the splits before its own. ``row`` numbers a split's records without gaps, so none are sorted."""
    sizes = records.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("least"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).alias("shift"))
    # A row for each split.
    return records.join(F.broadcast(starts), ["file", "block"]).withColumn("rec_idx", F.col("row") + F.col("shift")).drop("shift", "block", "row")


def key(records: DataFrame) -> list[str]:
    """The columns that tell a record from all others."""
    return [c for c in ("file", "rec_idx") if c in records.columns]


def refuse_unreadable(records: DataFrame, shown: int = 10) -> DataFrame:
    """The records, or an error that names the first unreadable places, counted from one, by file where there are several."""
    bad = records.where("unreadable").select(*key(records)).orderBy(*key(records)).limit(shown).collect()
    if bad:
        several = "file" in records.columns and records.select("file").distinct().limit(2).count() > 1
        names = [f"{r['file'].rsplit('/', 1)[-1]}:{r['rec_idx'] + 1}" if several else str(r["rec_idx"] + 1) for r in bad]
        raise ValueError(f"records that can't be read, by place: {', '.join(names)}")
    return records


def ingest(spark: SparkSession, path: str, out: str, shown: int = 10) -> dict[str, int]:
    """Read files of records once into the new folder ``out`` (``records``, ``statements``), or refuse them and leave nothing.

    Records are counted and tested while they are written to a folder beside ``out``, which gets its name only if all
    can be read. Places of unreadable ones are told from what was written. Returns records and statements.
    """
    staging = f"{out.rstrip('/')}-{uuid.uuid4().hex}"
    files, target = file_system(spark, out)
    if files.exists(target):
        raise FileExistsError(out)
    seen = Observation("ingest")
    has_866 = F.size(F.filter("fields", lambda f: f["tag"] == "866"))
    read = read_marc(spark, path).observe(seen, F.count(F.lit(1)).alias("records"), F.count_if("unreadable").alias("unreadable"), F.coalesce(F.sum(F.greatest(has_866, F.lit(0))), F.lit(0)).alias("fields"))
    try:
        read.write.parquet(f"{staging}/read")
        told = seen.get
        written = with_index(spark.read.parquet(f"{staging}/read"))
        if told["unreadable"]:
            refuse_unreadable(written, shown)
        written.write.parquet(f"{staging}/records")
        found = Observation("statements")
        statements(spark.read.parquet(f"{staging}/records")).observe(found, F.count(F.lit(1)).alias("n")).write.parquet(f"{staging}/statements")
        files.delete(file_system(spark, f"{staging}/read")[1], True)
        if not files.rename(file_system(spark, staging)[1], target):
            raise FileExistsError(out)
    except BaseException:
        files.delete(file_system(spark, staging)[1], True)
        raise
    return {"records": told["records"], "fields": told["fields"], "statements": found.get["n"]}


def chosen(records: DataFrame, places: DataFrame, kept: bool = True) -> DataFrame:
    """The records at ``places`` (the key; repeats and places that aren't there don't count), or all but these."""
    keys = key(records)
    return records.join(places.select(*keys).distinct(), keys, "left_semi" if kept else "left_anti")


def page(records: DataFrame, offset: int = 0, limit: int = 50, most: int = 200) -> DataFrame:
    """``limit`` records in order of their key, from ``offset``; for looking at them."""
    return records.orderBy(*key(records)).offset(max(0, offset)).limit(max(1, min(limit, most)))


def values(tag: str, codes: str) -> Column:
    """Values of the first field ``tag``'s subfields ``codes``, in order."""
    subs = F.get(F.filter("fields", lambda f: f["tag"] == tag), F.lit(0))["subfields"]
    return F.transform(F.filter(subs, lambda s: s["code"].isin(*codes)), lambda s: s["value"])


def summary(records: DataFrame) -> DataFrame:
    """The key, control number, title, issn, location and which holdings fields there are."""
    has = lambda tag: F.coalesce(F.exists("fields", lambda f: f["tag"] == tag), F.lit(False))
    title = F.regexp_replace(F.trim(F.array_join(values("245", "ab"), " ")), r"[ /:]+$", "")
    named = F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(F.concat(F.lit("Record "), (F.col("rec_idx") + 1).cast("string")))
    control = F.get(F.filter("fields", lambda f: f["tag"] == "001"), F.lit(0))["data"]
    return records.select(*key(records), control.alias("control"), named.alias("title"), F.coalesce(F.get(values("022", "a"), F.lit(0)), F.lit("")).alias("issn"), F.coalesce(F.array_join(values("852", "bc"), " > "), F.lit("")).alias("location"), has("866").alias("has_866"), has("853").alias("has_853"), has("863").alias("has_863"), "unreadable")


def statements(records: DataFrame) -> DataFrame:
    """The key, pos, stmt of each 866's first $a; blank ones are left out."""
    each = records.select(*key(records), F.explode("fields").alias("f")).where("f.tag = '866'")
    first = F.get(F.filter("f.subfields", lambda s: s["code"] == "a"), F.lit(0))["value"]
    return each.select(*key(records), F.col("f.pos").alias("pos"), F.trim(first).alias("stmt")).where("stmt <> ''")


def origins(pieces: DataFrame, order: list[str], piece: str = "piece") -> DataFrame:
    """The first place, by ``order``, of each different piece; the least of each task meet, so no place list is gathered."""
    return pieces.groupBy(piece).agg(F.min(F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("times")).select(piece, "times", "first.*")


def matched_sources(records: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of ``texts`` (the key, nth, text) with ``pos``, the 866 of their record with that statement.

    A record's equal statements are claimed one after the other; an edited text has no place.
    """
    keys = key(records)
    has = statements(records).withColumn("_turn", F.row_number().over(Window.partitionBy(*keys, "stmt").orderBy("pos")))
    wanted = texts.withColumn("_text", F.trim(F.coalesce("text", F.lit(""))))
    wanted = wanted.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys, "_text").orderBy("nth")))
    return wanted.join(has.withColumnRenamed("stmt", "_text"), [*keys, "_text", "_turn"], "left").select(*texts.columns, "pos")


def without_converted(records: DataFrame, converted: DataFrame) -> DataFrame:
    """Records without the 866s whose own statement gave 863 fields. converted: the key, pos, f863."""
    keys = key(records)
    done = converted.where((F.size("f863") > 0) & F.col("pos").isNotNull()).groupBy(*keys).agg(F.collect_set("pos").alias("_done"))
    joined = records.join(done, keys, "left")
    kept = F.filter("fields", lambda f: ~((f["tag"] == "866") & F.array_contains("_done", f["pos"])))
    fields = F.when(F.col("_done").isNull(), F.col("fields")).otherwise(F.transform(kept, lambda f, i: f.withField("pos", i)))
    return joined.withColumn("fields", fields).select(*records.columns)


def to_raw(fields: Column, leader: Column) -> Column:
    """A record's bytes from its fields; lengths and offsets are put right."""
    body = lambda f: F.concat(F.when(f["tag"] < "010", F.coalesce(f["data"], F.lit(""))).otherwise(F.concat(F.coalesce(f["ind1"], F.lit(" ")), F.coalesce(f["ind2"], F.lit(" ")), F.array_join(F.transform(f["subfields"], lambda s: F.concat(F.lit(SUBFIELD), s["code"], s["value"])), ""))), F.lit(END_FIELD))

    def step(state: Column, x: Column) -> Column:
        size = F.octet_length(x["body"])
        entry = F.concat(x["tag"], F.lpad(size.cast("string"), 4, "0"), F.lpad(state["at"].cast("string"), 5, "0"))
        return F.struct((state["at"] + size).alias("at"), F.concat(state["listing"], F.coalesce(entry, F.lit(""))).alias("listing"))

    def framed(parts: Column, told: Column) -> Column:
        base = F.lit(25) + F.size(parts) * 12
        head = F.concat(F.lpad((base + told["at"] + 1).cast("string"), 5, "0"), F.substring(leader, 6, 7), F.lpad(base.cast("string"), 5, "0"), F.substring(leader, 18, 7))
        return F.concat(head, told["listing"], F.lit(END_FIELD), F.array_join(F.transform(parts, lambda x: x["body"]), ""))

    # Each body is written once, and one pass tells where it starts.
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("listing"))
    bodies = F.transform(fields, lambda f: F.struct(f["tag"].alias("tag"), body(f).alias("body")))
    return let(bodies, lambda parts: let(F.aggregate(parts, start, step), lambda told: framed(parts, told)))


def write_marc(records: DataFrame, path: str) -> None:
    """Write records (the key, leader, fields) as files of records, in order of the key over the files."""
    rows = records.select(*key(records), to_raw(F.col("fields"), F.col("leader")).alias("value"))
    rows.orderBy(*key(records)).select("value").write.option("lineSep", END_RECORD).text(path)


def apply_conversion(records: DataFrame, fields_853: DataFrame, fields_863: DataFrame) -> DataFrame:
    """Records with new 853 and 863 fields; older ones of the same links go, so applying twice changes nothing.

    fields_853: the key, link, fields. fields_863: the key, link, seq, fields.
    """
    keys = key(records)
    make = lambda tag, i1, i2, eight: F.struct(F.lit(0).alias("pos"), F.lit(tag).alias("tag"), F.lit(None).cast("string").alias("data"), F.lit(i1).alias("ind1"), F.lit(i2).alias("ind2"), F.concat(F.array(F.struct(F.lit("8").alias("code"), eight.alias("value"))), F.col("fields")).alias("subfields"))
    link = F.col("link").cast("string")
    a = fields_853.select(*keys, "link", F.lit(0).alias("seq"), make("853", "3", "1", link).alias("f"))
    b = fields_863.select(*keys, "link", "seq", make("863", "4", "0", F.concat(link, F.lit("."), F.col("seq").cast("string"))).alias("f"))
    new = a.unionByName(b).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("f.tag").alias("tag"), "link", "seq", "f"))).alias("_new"), F.collect_set(link).alias("_links"))
    eight = lambda f: F.coalesce(F.regexp_extract(F.get(F.filter(f["subfields"], lambda s: s["code"] == "8"), F.lit(0))["value"], r"^(\d+)", 1), F.lit(""))
    joined = records.join(new, keys, "left")
    kept = F.filter("fields", lambda f: ~(f["tag"].isin("853", "863") & F.array_contains("_links", eight(f))))
    out = F.when(F.col("_new").isNull(), F.col("fields")).otherwise(F.concat(kept, F.transform("_new", lambda x: x["f"])))
    return joined.withColumn("fields", F.transform(out, lambda f, i: f.withField("pos", i))).drop("_new", "_links")
