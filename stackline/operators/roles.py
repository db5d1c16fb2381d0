"""Roles of a pattern's groups: what each captured value means, for a person to confirm.

A group's name tells its kind. Of the groups of one kind and caption in a pattern the first is the
start, the second the end, and later ones are ignored. Levels are numbered in the order of the
groups, around those that were set before.

Defined cases: a name that isn't one of ``detect.patterns`` is unresolved; a lone number just before
an issue is offered as a volume; a pattern without groups gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kind and caption by the word in a group's name.
KIND_OF = {"vol": ("enum", "v."), "iss": ("enum", "no."), "part": ("enum", "pt."), "year": ("year", None), "month": ("month", None), "day": ("day", None)}
ENCODED = ("enum", "year", "month", "day")


def slot(group: Column) -> Column:
    """The word between ``start`` or ``end`` and a number; empty for other names."""
    return F.regexp_extract(group, r"^(?:start|end)([a-z]+)\d*$", 1)


def inferred(patterns: DataFrame, pattern: str = "signature", groups: str = "groups") -> DataFrame:
    """A row for each group: place, group, boundary, kind, level (from 1), caption, suggested."""
    each = patterns.select(pattern, F.posexplode(groups).alias("place", "group"))
    w = Window.partitionBy(pattern).orderBy("place")
    word, after = slot(F.col("group")), F.lead(slot(F.col("group"))).over(w)
    table = F.create_map(*(F.lit(x) for name, (kind, _) in KIND_OF.items() for x in (name, kind)))
    words = F.create_map(*(F.lit(x) for name, (_, said) in KIND_OF.items() if said for x in (name, said)))
    lone = F.coalesce((word == "num") & (after == "iss"), F.lit(False))
    each = each.withColumns({"kind": F.when(lone, "enum").otherwise(F.coalesce(table[word], F.lit("unresolved"))), "caption": F.when(lone, "v.").otherwise(words[word]), "suggested": lone})
    turn = F.row_number().over(Window.partitionBy(pattern, "kind", "caption").orderBy("place"))
    known = F.col("kind").isin(*ENCODED)
    each = each.withColumn("_turn", turn).withColumn("boundary", F.when(known & (F.col("_turn") == 2), "end").otherwise("start"))
    each = each.withColumn("kind", F.when(known & (F.col("_turn") > 2), "ignore").otherwise(F.col("kind"))).withColumn("caption", F.when(F.col("kind") == "enum", F.col("caption")))
    return leveled(each.withColumn("level", F.lit(None).cast("int")).drop("_turn"), pattern)


def leveled(roles: DataFrame, pattern: str = "signature") -> DataFrame:
    """Unset levels of each boundary filled with the least free numbers, in the order of places."""
    unset = (F.col("kind") == "enum") & F.col("level").isNull()
    both = Window.partitionBy(pattern, "boundary")
    taken = F.array_sort(F.collect_set(F.when(F.col("kind") == "enum", F.col("level"))).over(both))
    turn = F.row_number().over(Window.partitionBy(pattern, "boundary", unset).orderBy("place"))
    out = roles.withColumn("_taken", taken).withColumn("_turn", turn)
    free = F.aggregate("_taken", F.col("_turn"), lambda n, x: F.when(x <= n, n + 1).otherwise(n))
    return out.withColumn("level", F.when(unset, free).otherwise(F.col("level"))).select(pattern, "place", "group", "boundary", "kind", "level", "caption", "suggested")


def merged(new: DataFrame, decided: DataFrame, pattern: str = "signature") -> DataFrame:
    """Roles of a changed pattern: decisions for groups that are still there hold, the others are inferred."""
    had = decided.select(pattern, "group", *(F.col(c).alias(f"_{c}") for c in ("boundary", "kind", "level", "caption")), F.lit(True).alias("_had"))
    joined = new.join(had, [pattern, "group"], "left")
    held = lambda c: F.when(F.col("_had"), F.col(f"_{c}")).otherwise(F.col(c) if c != "level" else F.lit(None).cast("int")).alias(c)
    out = joined.select(pattern, "place", "group", *(held(c) for c in ("boundary", "kind", "level", "caption")), (F.col("suggested") & F.col("_had").isNull()).alias("suggested"))
    return leveled(out, pattern)


def decides(members: DataFrame, texts: DataFrame) -> DataFrame:
    """What confirming a cluster's pattern would decide: the reading, where the parser refuses a member; a caption, where a level lacks one; or nothing.

    members: signature, stmt. texts: the parser's ranges of each statement (``parse.parse_distinct``).
    """
    bare = F.exists(F.concat("start.levels", F.coalesce("finish.levels", F.slice("start.levels", 1, 0))), lambda x: x["value"].isNotNull() & x["caption"].isNull())
    each = texts.groupBy("stmt").agg(F.max(F.col("pos").isNull()).alias("refused"), F.max(F.coalesce(bare, F.lit(False))).alias("bare"))
    found = members.join(each, "stmt").groupBy("signature").agg(F.max("refused").alias("refused"), F.max("bare").alias("bare"))
    return found.select("signature", F.when(F.col("refused"), "reading").when(F.col("bare"), "caption").otherwise("nothing").alias("decides"))
