"""Ranks within keys, without gathering the rows of a frequent key."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackline.llm.staging import staged

def ranked(df: DataFrame, keys: list[str], order: list[str], rank: str) -> DataFrame:
    """``df`` with a rank for each row among those of equal keys, from 0.

    Rows of a key are dealt over as many parts as the root of the row count, whose sizes are
    added up before; so no part holds all rows of a frequent key, nor a key's list of parts
    many entries. Rows go by part, then by ``order``. A row's place in the table takes part in
    the dealing, so rows that are equal in all columns are dealt too; as places differ from plan
    to plan, the parts are staged.
    """
    parts = max(1, math.isqrt(df.count()))
    place = F.monotonically_increasing_id()
    dealt = staged(df.withColumn("_part", F.pmod(F.xxhash64(*order, place), F.lit(parts)).cast("int")), "ranked")
    sizes = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*keys, "_part").orderBy(*order)
    return dealt.withColumn("_own", F.row_number().over(inner) - 1).join(starts, [*keys, "_part"]).withColumn(rank, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")
