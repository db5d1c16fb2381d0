"""Expressions that may take for ever, told from their form.

Matching goes back over every way of reading a text. Where a loop reads one text in two ways, the ways double with
each further turn, so a text that fails in the end is never done with. Each expression becomes its loops' moves
(``functions.expressions``); the product of a loop with itself is a join of moves that read the same
class of characters. From two equal places, pairs of different ones are followed until both meet again:
then a word was read in two ways from a place to itself, and that word, repeated, is the witness. A move
that can be made in two ways, as in a repeat of a repeat, is a witness by itself.

All expressions of a table go through the same joins. A round follows a pair one character further and
leaves out pairs that were met before, so there are as many rounds as the longest such word has characters.

Only what doubles is refused. Loops one after the other (``.*.*x``) take a power of the text's length, and are kept.
Defined cases: a null expression is null; one that can't be read is ``unreadable``; equal expressions are
judged once; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackline.functions.expressions import Unreadable, moves
from stackline.functions.shared import settled

OK, EXPONENTIAL, UNREADABLE = "ok", "exponential", "unreadable"
_MOVES = "regex string, loop int, a int, b int, shown string, kind int, ways int"


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["regex", "loop", "a", "b", "shown", "kind", "ways"]
    for frame in frames:
        rows: list[tuple] = []
        for regex in frame["regex"]:
            try:
                rows += [(regex, *m) for m in moves(regex)]
            except (Unreadable, RecursionError):
                rows.append((regex, -1, -1, -1, "", -1, 0))
        yield pd.DataFrame(rows, columns=columns)


def screened(expressions: DataFrame, column: str = "regex") -> DataFrame:
    """regex, verdict and witness of each distinct expression."""
    distinct = expressions.select(F.col(column).alias("regex")).distinct()
    all_moves = settled(distinct.where("regex is not null").mapInPandas(_read, _MOVES))
    loops = all_moves.where("loop >= 0")
    double = loops.where("ways > 1").groupBy("regex").agg(F.min("shown").alias("word"))
    # Two expressions never meet; in one, moves meet by loop and by what they read.
    same = ["regex", "loop", "kind"]
    one, other = loops.select(*same, "a", "b", "shown"), loops.select(*same, F.col("a").alias("c"), F.col("b").alias("d"))
    # Order doesn't matter in a pair, so it is kept with the lesser place first.
    parted = one.join(other, [*same]).where("a = c and b < d").groupBy("regex", "loop", F.col("b").alias("p"), F.col("d").alias("q")).agg(F.min("shown").alias("word"))
    pair = ["regex", "loop", "p", "q"]
    # One table has all pairs met so far and the round in which each was; a round is a step of one character.
    met, turn = settled(parted.join(double, "regex", "left_anti").withColumn("turn", F.lit(0))), 0
    while met.where(F.col("turn") == turn).limit(1).count():
        frontier = met.where(f"turn = {turn} and p <> q").join(met.where("p = q").select("regex").distinct(), "regex", "left_anti")
        went = frontier.join(one.withColumnRenamed("a", "p"), ["regex", "loop", "p"]).select("regex", "loop", "q", "kind", F.col("b").alias("to"), F.concat("word", "shown").alias("word"))
        both = went.join(other.withColumnRenamed("c", "q"), ["regex", "loop", "kind", "q"]).select("regex", "loop", F.least("to", "d").alias("p"), F.greatest("to", "d").alias("q"), "word")
        turn += 1
        reached = both.groupBy(*pair).agg(F.min("word").alias("word")).join(met.select(*pair), pair, "left_anti").withColumn("turn", F.lit(turn))
        met = settled(met.unionByName(reached))
    found = double.unionByName(met.where("p = q").select("regex", "word"))
    bad = all_moves.where("loop < 0").select("regex", F.lit(UNREADABLE).alias("_bad")).distinct()
    witness = found.groupBy("regex").agg(F.min("word").alias("witness"))
    judged = distinct.join(bad, "regex", "left").join(witness, "regex", "left")
    verdict = F.when(F.col("regex").isNotNull(), F.coalesce("_bad", F.when(F.col("witness").isNotNull(), EXPONENTIAL).otherwise(OK)))
    return judged.select("regex", verdict.alias("verdict"), "witness")


_KNOWN: dict[str, str | None] = {}


def refused(spark: SparkSession, expressions: Iterable[str]) -> dict[str, str]:
    """Witnesses of those expressions that may take for ever. A library's expressions are few, and each is judged once in a process."""
    asked = set(expressions)
    new = sorted(asked - _KNOWN.keys())
    if new:
        _KNOWN.update((r["regex"], r["witness"]) for r in screened(spark.createDataFrame([(x,) for x in new], "regex string")).collect())
    return {x: _KNOWN[x] for x in asked if _KNOWN.get(x) is not None}
