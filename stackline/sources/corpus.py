"""Statements for review in text files, with sections, counts and tags.

A line starting with # is a comment, ``[section: name]`` heads the lines below it, and any other
line is a statement with an optional note after a #: ``[x3]`` says how often it occurs, ``loss:D2``
what is known of it.

Files are read in splits. A line's number and section come from its own split, and from a row
for each split before it, so that no file is one task's.

Defined cases: blank lines and lines with a note alone are left out; without a heading the section is
null; without a count it is 1; without a tag both its parts are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SECTION = r"^\s*\[section:\s*([^\]]+)\]\s*$"
TAG = r"\b(loss|fail|warn|known):(D[0-9]+)\b"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), section, stmt, occurrences, status, defect."""
    text = F.col("value")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = lines.withColumn("heading", F.when(text.rlike(SECTION), F.trim(F.regexp_extract(text, SECTION, 1))))
    headed = F.max(F.when(F.col("heading").isNotNull(), F.struct("row", "heading")))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), headed.alias("last"))
    splits = splits.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_lines"), F.last("last.heading", ignorenulls=True).over(before).alias("_section"))
    own = Window.partitionBy("file", "block").orderBy("row")
    told = lines.withColumn("_own", F.row_number().over(own)).withColumn("_heading", F.last("heading", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    told = told.join(splits, ["file", "block"])
    note = F.regexp_extract(text, r"^[^#]*#(.*)$", 1)
    tag = lambda k: F.when(note.rlike(TAG), F.regexp_extract(note, TAG, k))
    stmt = F.regexp_replace(F.regexp_extract(text, r"^([^#]*)", 1), r"^\s+|\s+$", "")
    rows = told.select(
        "file",
        (F.col("_lines") + F.col("_own")).alias("line"),
        F.coalesce("_heading", "_section").alias("section"),
        stmt.alias("stmt"),
        F.coalesce(F.regexp_extract(note, r"\[x([0-9]+)\]", 1).try_cast("long"), F.lit(1)).alias("occurrences"),
        tag(1).alias("status"),
        tag(2).alias("defect"),
        "heading",
    )
    return rows.where("heading is null and stmt <> ''").drop("heading")
