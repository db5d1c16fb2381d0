"""Clusters of statements by signature, with a pattern that each cluster's members match.

Members are distinct statements with their counts. A cluster's pattern comes from what its
members have at each place: captions as alternatives, values as named groups, unknown text
as a bounded wildcard. Places are aggregated, so no task gathers a cluster's members.

Defined cases: null and blank statements are left out; ties in size go by the least statement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackline.functions.codes import bound
from stackline.functions.shared import settled, spread
from stackline.functions.signature import KINDS, coarse, compact, label, letters, names
from stackline.functions.signature import tokens as token_texts

#: Tokens, and characters of a pattern, beyond which a cluster gets none.
MOST_TOKENS, MOST_PATTERN = 40, 4000


def members(statements: DataFrame, column: str = "stmt", head: str | None = None) -> DataFrame:
    """Distinct statements with ``copies``, ``signature``, ``letters``; all statements are read here, once, and only members go on.

    head: a column whose least value is kept as ``least``, and whether it is null anywhere as ``headless``.
    """
    rows = statements.select(F.col(column).alias("_raw"), *([F.col(head).alias("_head")] if head else [])).groupBy("_raw")
    raw = rows.agg(F.count(F.lit(1)).alias("_n"), *([F.min("_head").alias("_least"), F.count("_head").alias("_heads")] if head else []))
    # Rows are counted by their texts as they stand: a trim or a filter would go below the aggregation, where every row pays for it. It stays above an explode.
    text = bound(raw, "stmt", F.regexp_replace("_raw", r"^\s+|\s+$", "")).where("stmt <> ''")
    found = text.groupBy("stmt").agg(F.sum("_n").alias("copies"), *([F.min("_least").alias("least"), F.max(F.col("_heads") < F.col("_n")).alias("headless")] if head else []))
    also = [c for c in ("least", "headless") if head]
    # An explode keeps the letters from being read again wherever they are mentioned.
    # Dealt by a hash, as the optimizer leaves out a second exchange by the same key, and then few tasks read all letters.
    lettered = spread(found, F.xxhash64("stmt")).select("stmt", "copies", *also, F.explode(F.array(letters(F.col("stmt")))).alias("kinds"))
    return settled(lettered.select("stmt", "copies", names(F.col("kinds")).alias("signature"), "kinds", *also))


def clusters(statements: DataFrame, column: str = "stmt") -> DataFrame:
    """signature, statements, distinct statements and an example, largest first."""
    return _clusters(members(statements, column))


def _clusters(found: DataFrame) -> DataFrame:
    sizes = found.groupBy("signature").agg(F.sum("copies").alias("statements"), F.count(F.lit(1)).alias("distinct_statements"), F.min("stmt").alias("example"))
    return sizes.orderBy(F.desc("statements"), "example")


def labels(statements: DataFrame, column: str = "stmt") -> DataFrame:
    """Each cluster with its ``label``, its ``coarse`` signature, and how many clusters share that."""
    return _labels(members(statements, column))


def _labels(found: DataFrame) -> DataFrame:
    found = _clusters(found).withColumn("label", label(F.col("signature"))).withColumn("coarse", coarse(F.col("signature")))
    # The window is over clusters, not statements.
    return found.withColumn("clusters", F.count(F.lit(1)).over(Window.partitionBy("coarse")))


def tokens(member: DataFrame) -> DataFrame:
    """A row for each token of a member: place, letter, text; numbers with hyphens and unknown runs are one token."""
    divided = F.col("kinds").rlike(r"\)S*-|-S*[VIP]")
    runs = F.when(divided, F.regexp_extract_all("kinds", F.lit(r"(N(?:S*-S*N)+|U(?:[US]*U)?|S|.)"), F.lit(1))).otherwise(F.regexp_extract_all("kinds", F.lit(r"(U(?:[US]*U)?|S|.)"), F.lit(1)))
    started = F.aggregate(F.col("runs"), F.array(F.lit(1)), lambda ends, x: F.array_append(ends, F.element_at(ends, -1) + F.length(x)))
    # Tokens, runs of letters and where each starts are bound by explodes, once a statement.
    each = member.select("*", F.explode(F.array(F.struct(F.transform(token_texts(F.col("stmt")), lambda t: t["text"]).alias("raw"), runs.alias("runs")))).alias("_t"))
    each = each.select("signature", "stmt", "copies", "_t.raw", "_t.runs")
    each = each.select("*", F.explode(F.array(started)).alias("starts"))
    spans = F.transform("runs", lambda x, i: F.struct(F.substring(x, 1, 1).alias("letter"), F.array_join(F.slice("raw", F.get("starts", i), F.length(x)), "").alias("text")))
    return each.select("signature", "stmt", "copies", F.posexplode(F.filter(spans, lambda x: x["letter"] != "S")).alias("place", "token")).select("signature", "stmt", "copies", "place", "token.letter", "token.text")


def top(df: DataFrame, keys: list[str], order: list[Column], k: int, salts: int = 64) -> DataFrame:
    """The first ``k`` rows of each key by ``order``: the first of each part of a key's rows, and then of these; no task ranks all rows of a frequent key."""
    part = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if df.schema[c].dataType.typeName() in ("string", "long", "integer")]), F.lit(salts))
    some = df.withColumn("_part", part).withColumn("_turn", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))).where(F.col("_turn") <= k)
    return some.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_turn") <= k).drop("_part").withColumnRenamed("_turn", "turn")


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.\[\](){}*+?^$|/-])", r"\\$1")


def _named(places: DataFrame) -> DataFrame:
    """Places of a signature's tokens (signature, place, letter) with ``group``, the name of the value there."""
    w = Window.partitionBy("signature").orderBy("place")
    governing = F.last(F.when(F.col("letter").isin("V", "P", "I"), F.col("letter")).when(F.col("letter") == "(", F.lit("")), ignorenulls=True).over(w)
    value = F.when(F.col("letter") == "N", F.when(governing == "V", "vol").when(governing == "I", "iss").when(governing == "P", "part").otherwise("num")).when(F.col("letter") == "Y", "year").when(F.col("letter") == "C", "month")
    named = places.withColumn("value", value)
    turn = F.when(F.col("value").isNotNull(), F.row_number().over(Window.partitionBy("signature", "value").orderBy("place")))
    return named.withColumn("turn", turn).withColumn("group", F.when(F.col("turn") == 1, F.concat(F.lit("start"), "value")).when(F.col("turn") == 2, F.concat(F.lit("end"), "value")).when(F.col("turn") > 2, F.concat(F.lit("end"), "value", (F.col("turn") - 1).cast("string"))))


def patterns(statements: DataFrame, column: str = "stmt") -> DataFrame:
    """signature, pattern (Java named groups), groups, statements, and why a cluster has no pattern."""
    return patterns_of(members(statements, column))


def patterns_of(found: DataFrame) -> DataFrame:
    """``patterns`` of members that are there already."""
    sizes = found.groupBy("signature").agg(F.sum("copies").alias("statements"), F.count(F.lit(1)).alias("distinct_statements"), F.max(F.length(compact(F.col("kinds")))).alias("n_tokens"))
    simple = found.where(F.length(compact(F.col("kinds"))) <= MOST_TOKENS)
    # At each place few forms are seen: captions and separators are grouped in lower case before they are gathered.
    form = F.when(F.col("letter").isin("V", "P", "I"), F.lower("text"))
    places = tokens(simple).groupBy("signature", "place", "letter", form.alias("form")).agg(F.max(F.length("text")).alias("longest"))
    places = places.groupBy("signature", "place", "letter").agg(F.sort_array(F.collect_set("form")).alias("forms"), F.max("longest").alias("longest"))
    named = _named(places)
    by_letter = {letter: pattern for letter, _, pattern in KINDS}
    of_value = F.when(F.col("letter") == "N", F.lit(r"\d+[A-Za-z]?(?:\s*[-/]\s*\d+[A-Za-z]?)*"))
    for letter in ("Y", "C"):
        of_value = of_value.when(F.col("letter") == letter, F.lit(by_letter[letter]))
    longest_first = F.array_sort("forms", lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    piece = (
        F.when(F.col("letter").isin("V", "P", "I"), F.concat(F.lit("(?:"), F.array_join(F.transform(longest_first, _escaped), "|"), F.lit(")")))
        .when(F.col("group").isNotNull(), F.concat(F.lit("(?<"), "group", F.lit(">"), of_value, F.lit(")")))
        .when(F.col("letter") == "U", F.concat(F.lit(".{1,"), (F.ceil(F.col("longest") / 8) * 8).cast("string"), F.lit("}?")))
        .otherwise(F.concat(F.lit("\\"), F.col("letter")))
    )
    ordered = named.withColumn("piece", piece).groupBy("signature").agg(F.sort_array(F.collect_list(F.struct("place", "piece", "group"))).alias("p"))
    joined = ordered.select("signature", F.concat(F.lit("(?is)^"), F.array_join(F.transform("p", lambda x: x["piece"]), r"\s*"), F.lit("$")).alias("pattern"), F.filter(F.transform("p", lambda x: x["group"]), lambda g: g.isNotNull()).alias("groups"))
    out = sizes.join(joined, "signature", "left")
    long = F.length("pattern") > MOST_PATTERN
    return out.select("signature", "statements", "distinct_statements", F.when(~long, F.col("pattern")).alias("pattern"), F.when(~long, F.col("groups")).alias("groups"), F.when(F.col("pattern").isNull(), "too_many_tokens").when(long, "pattern_too_long").alias("declined"))


def match_rates(statements: DataFrame, column: str = "stmt") -> DataFrame:
    """How many of each cluster's statements its pattern matches whole."""
    found = members(statements, column)
    return _match_rates(found, patterns_of(found))


def _match_rates(found: DataFrame, made: DataFrame) -> DataFrame:
    each = found.select("signature", "stmt", "copies").join(made.select("signature", "pattern"), "signature").where("pattern is not null")
    return each.groupBy("signature").agg(F.sum(F.when(F.expr("stmt rlike pattern"), F.col("copies")).otherwise(0)).alias("matched"), F.sum("copies").alias("statements"), F.round(F.sum(F.when(F.expr("stmt rlike pattern"), F.col("copies")).otherwise(0)) / F.sum("copies"), 4).alias("match_rate"))


def annotated(statements: DataFrame, order: list[str], decided: DataFrame, column: str = "stmt", k: int = 3, found: DataFrame | None = None) -> DataFrame:
    """One row for each cluster: examples, values of each group, where it occurs first, and whether it needs a decision.

    order: the columns that place a statement. decided: signature, decides (``roles.decides``). At most ``k`` examples, and
    values of each group, most frequent first. found: the statements' members with ``head`` the first of ``order``, where they are there already.
    """
    found = members(statements, column, order[0]) if found is None else found
    by = [F.desc("copies"), F.col("stmt")]
    examples = top(found.select("signature", "stmt", "copies"), ["signature"], by, k).groupBy("signature").agg(F.sort_array(F.collect_list(F.struct("turn", "stmt"))).alias("_e"))
    each = tokens(found)
    groups = _named(each.select("signature", "place", "letter").distinct()).where("group is not null").select("signature", "place", "group")
    counted = each.groupBy("signature", "place", "text").agg(F.sum("copies").alias("copies")).join(groups, ["signature", "place"])
    best = top(counted.select("signature", "place", "group", "text", "copies"), ["signature", "place"], [F.desc("copies"), F.col("text")], k)
    values = best.groupBy("signature", "place", "group").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("_v"))
    values = values.groupBy("signature").agg(F.sort_array(F.collect_list(F.struct("place", F.col("group"), F.transform("_v", lambda x: x["text"]).alias("values")))).alias("_g"))
    text = F.regexp_replace(F.col(column), r"^\s+|\s+$", "")
    # A cluster's first place is where the first order column is least, so other rows are left out before their text is looked at.
    least = found.groupBy("signature").agg(F.min("least").alias("_least"), F.max("headless").alias("_none"))
    least = settled(least.select(F.when(~F.col("_none"), F.col("_least")).alias("_least")).distinct())
    some = settled(statements.select(*order, column).join(least, F.col(order[0]).eqNullSafe(F.col("_least")), "left_semi"))
    some = some.select(F.struct(*order).alias("first"), text.alias("stmt")).join(found.select("stmt", "signature"), "stmt")
    where = some.groupBy("signature").agg(F.min("first").alias("first")).join(found.groupBy("signature").agg(F.sum("copies").alias("statements")), "signature")
    out = where.join(examples, "signature").join(values, "signature", "left").join(decided, "signature", "left")
    shown = F.transform("_g", lambda g: F.struct(g["group"].alias("group"), g["values"].alias("values")))
    return out.select("signature", "statements", F.transform("_e", lambda e: e["stmt"]).alias("examples"), shown.alias("values"), "first", F.coalesce("decides", F.lit("nothing")).alias("decides"), (F.coalesce("decides", F.lit("nothing")) != "nothing").alias("needs_decision"))


def statistics(statements: DataFrame, column: str = "stmt") -> DataFrame:
    """``scope`` (all, shape or label), ``key``, and how many clusters, single ones, declined ones, ones that miss members, and statements there are.

    All scopes come from one pass over the clusters. A shape is a coarse signature: one with several clusters is split. A label
    with several clusters can't be told from their labels.
    """
    found = members(statements, column)
    made = settled(patterns_of(found))
    told = _labels(found).select("signature", "label", "coarse", "statements")
    rates = _match_rates(found, made).select("signature", "match_rate")
    declined = made.select("signature", F.col("declined").isNotNull().alias("declined"))
    each = told.join(declined, "signature", "left").join(rates, "signature", "left")
    return statements.sparkSession.sql(
        """
        SELECT CASE WHEN grouping(coarse) = 0 THEN 'shape' WHEN grouping(label) = 0 THEN 'label' ELSE 'all' END AS scope, coalesce(coarse, label) AS key, count(*) AS clusters,
            count_if(statements = 1) AS singletons, count_if(declined) AS declined, count_if(match_rate < 1) AS imperfect, sum(statements) AS statements
        FROM {each} GROUP BY GROUPING SETS ((), (coarse), (label))""",
        each=each,
    )


def confusable(statements: DataFrame, column: str = "stmt") -> DataFrame:
    """signature and ``family``, the least signature of all clusters it is tied to by equal labels or shapes, over any number of steps.

    Families are components of the graph of clusters with labels and shapes; each round takes the least family over a label and over a shape.
    """
    at = settled(labels(statements, column).select("signature", "label", "coarse", F.col("signature").alias("family")))
    while True:
        by_label, by_shape = (at.groupBy(c).agg(F.min("family").alias(f"_{c}")) for c in ("label", "coarse"))
        new = settled(at.join(by_label, "label").join(by_shape, "coarse").select("signature", "label", "coarse", F.least("_label", "_coarse").alias("family"), (F.least("_label", "_coarse") != F.col("family")).alias("_moved")))
        if not new.where("_moved").limit(1).count():
            return at.select("signature", "family")
        at = new.drop("_moved")
