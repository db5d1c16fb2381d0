"""Statements that another cluster's pattern fits in part, by an index of what a pattern requires.

A partial fit would drop what is outside it. Every pattern against every statement is no join by a key, so each
pattern tells what any text it fits must hold: with white space gone and letters and digits each one sign, the
signs its pieces begin with and the pairs where one piece meets the next. Statements are indexed by the signs and
pairs they hold. A pattern is looked up by the one of its requirements that fewest statements have, and only where all
hold does its expression run.

Defined cases: a pattern of unknown text alone requires nothing and meets all statements; a pattern that fits a statement
whole isn't partial there; of equal shares the larger cluster's, then the lesser signature's, is shown; null and blank
statements are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackline.functions.codes import let
from stackline.functions.shared import settled
from stackline.functions.signature import kinds_of
from stackline.operators import detect

#: What a token's text begins and ends with, as signs (d digit, a letter); a kind that isn't there is open.
_BEGINS = {"V": "a", "P": "a", "I": "a", "C": "a", "Y": "d", "N": "d"}
_ENDS = {"Y": "d"}


def signs(text: Column) -> Column:
    """A text without white space, letters as a and digits as d."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\s+", ""), "[A-Za-z]", "a"), r"\d", "d")


def held(text: Column) -> Column:
    """All signs and pairs of signs of a text, and the empty one."""

    def parts(of: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(of), F.lit(1)))
        return F.array_distinct(F.concat(F.array(F.lit("")), F.transform(places, lambda i: of.substr(i, F.lit(1))), F.transform(places, lambda i: of.substr(i, F.lit(2)))))

    return let(signs(text), parts)


def required(signature: Column) -> Column:
    """What any text that a signature's pattern fits must hold."""
    table = lambda d: F.create_map(*(F.lit(x) for pair in {**{s: s for s in "():-,"}, **d}.items() for x in pair))
    letters = F.split(kinds_of(signature), "")
    pair = lambda x, i: F.concat(table(_ENDS)[x], table(_BEGINS)[F.get(letters, i + 1)])
    return F.array_distinct(F.concat(F.array(F.lit("")), F.array_compact(F.transform(letters, lambda x: table(_BEGINS)[x])), F.array_compact(F.transform(letters, pair))))


def candidates(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """stmt with each pattern that may fit a part of it. texts: stmt. patterns: signature, pattern, statements."""
    # Settled, as the explode's filter on what is held would else be asked of every statement that ``texts`` are made of.
    index = settled(texts.select("stmt", held(F.col("stmt")).alias("held")))
    each = index.select("stmt", "held", F.explode("held").alias("key"))
    common = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    wanted = patterns.where("pattern is not null").select("signature", "pattern", "statements", required(F.col("signature")).alias("required"))
    by = wanted.select("signature", F.explode("required").alias("key")).join(common, "key", "left")
    rarest = by.groupBy("signature").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key"))["key"].alias("key"))
    met = each.join(wanted.join(rarest, "signature"), "key")
    return met.where(F.size(F.array_except("required", "held")) == 0).select("stmt", "signature", "pattern", "statements")


def exposed(statements: DataFrame, column: str = "stmt") -> DataFrame:
    """stmt, signature, statements (the cluster's size), share, matched and discarded of the least partial fit of each statement."""
    found = detect.members(statements, column)
    met = candidates(found.select("stmt"), detect.patterns_of(found))
    inner = F.regexp_replace("pattern", r"^\(\?is\)\^|\$$", "")
    tried = met.where(~F.expr("stmt rlike pattern")).withColumn("_part", F.concat(F.lit("(?is)("), inner, F.lit(")"))).withColumn("matched", F.expr("regexp_extract(stmt, _part, 1)")).where("matched <> ''")
    share = (F.length("matched") / F.length("stmt")).alias("share")
    best = tried.select("stmt", F.struct(share, (-F.col("statements")).alias("size"), "signature", "matched").alias("b")).groupBy("stmt").agg(F.min("b").alias("b"))
    at = F.position("b.matched", F.col("stmt"))
    rest = F.concat(F.substring("stmt", F.lit(1), at - 1), F.lit(" … "), F.substring("stmt", at + F.length("b.matched"), F.length("stmt")))
    return best.select("stmt", "b.signature", (-F.col("b.size")).alias("statements"), "b.share", "b.matched", F.regexp_replace(rest, "^[ …]+|[ …]+$", "").alias("discarded"))
