"""Queries over rendered statements, and what DuckDB finds from the columns they were made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackline.functions import shared
from stackline.functions.signature import open_ended
from stackline.operators import audit, convert, detect, number, parse, roles, rules
from stackline.plans import rendered
from stackline.sources import marc

ORDER = ["v", "p", "s", "d", "i"]
PATTERNS = [
    {"id": "months", "regex": r"v\. (?<startvol>\d+) no\. (?<startiss>\d+) \((?<startmonth>[A-Z][a-z]{2}) (?<startyear>\d{4})\)", "priority": 5, "roles": [{"group": "startvol", "boundary": "start", "kind": "enum", "level": 1, "caption": "v."}, {"group": "startiss", "boundary": "start", "kind": "enum", "level": 2, "caption": "no."}, {"group": "startmonth", "boundary": "start", "kind": "month"}, {"group": "startyear", "boundary": "start", "kind": "year"}]},
    {"id": "any", "regex": r"v\..*\((?<startyear>\d{4})\)-?", "priority": 1, "roles": [{"group": "startyear", "boundary": "start", "kind": "year"}]},
    {"id": "bare", "regex": r"(?<startnum>\d+) \?", "priority": 9, "skip": True, "roles": [{"group": "startnum", "boundary": "start", "kind": "unresolved"}]},
]


#: With a pattern for even numbers before the one that leaves all lone numbers as they are.
APPLIED = [*PATTERNS, {"id": "even", "regex": r"(?<startvol>\d*[02468]) \?", "priority": 12, "roles": [{"group": "startvol", "boundary": "start", "kind": "enum", "level": 1, "caption": "v."}]}]


def _shown(fields):
    return F.array_join(F.transform(fields, lambda x: F.concat(F.lit("$"), x["code"], F.lit(" "), x["value"])), " ")


def _converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct statement's fields, once."""
    return convert.convert_statements(parse.parse_distinct(rendered.statements(spark, sf_dir)))


def holdings_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.clusters(rendered.statements(spark, sf_dir)).select("signature", "statements", "distinct_statements")


def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.labels(rendered.statements(spark, sf_dir)).select("signature", "label", "coarse", "clusters", "statements")


def holdings_match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.match_rates(rendered.statements(spark, sf_dir)).select("signature", "matched", "statements", F.col("match_rate").cast("double").alias("match_rate"))


def holdings_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = rendered.statements(spark, sf_dir).select("stmt").distinct()
    return texts.select("stmt", F.posexplode(parse.segments(F.col("stmt"))).alias("pos", "segment")).withColumn("pos", F.col("pos").cast("long"))


def holdings_top_level_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = rendered.statements(spark, sf_dir).select("stmt").distinct()
    return texts.select("stmt", F.posexplode(parse.top_level(F.col("stmt"))).alias("pos", "piece")).withColumn("pos", F.col("pos").cast("long"))


def holdings_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("stmt")
    flags = {"open_statements": open_ended(text), "lists": parse.is_list(text), "blocks": text.rlike(parse.BLOCK)}
    return rendered.statements(spark, sf_dir).groupBy("family").agg(F.count(F.lit(1)).alias("statements"), *(F.count_if(c).alias(n) for n, c in flags.items()))


def holdings_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parse.parse_distinct(rendered.statements(spark, sf_dir)).where("pos is not null")
    value = lambda side, k: F.get(f"{side}.levels", F.lit(k))["value"]
    return found.select("stmt", F.col("pos").cast("long").alias("pos"), value("start", 0).alias("e1"), value("start", 1).alias("e2"), F.col("start.year").alias("y1"), F.col("start.month").alias("m1"), value("finish", 0).alias("f1"), F.col("finish.year").alias("y2"), "open_ended", "gap_after")


def holdings_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(spark, sf_dir).select("stmt", F.posexplode("f863").alias("k", "f")).select("stmt", F.col("k").cast("long").alias("pos"), _shown(F.col("f")).alias("f863"))


def holdings_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(spark, sf_dir).where("f853 is not null").groupBy(_shown(F.col("f853")).alias("f853")).agg(F.count(F.lit(1)).alias("statements"))


def _numbering(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows to be numbered, and each statement's fields with their number."""
    fields = shared.settled(_converted(spark, sf_dir).select("stmt", "f853", "f863", F.size("f863").alias("n")))
    return rendered.statements(spark, sf_dir).select("rec", *ORDER, "stmt"), fields


def record_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fields = _numbering(spark, sf_dir)
    # A run's rows go to its sums with a number and a short text, as these are sorted.
    out = number.numbered(rows, ORDER, fields).select("rec", "link", "stmt").join(fields.select("stmt", "n", _shown(F.col("f853")).alias("f853")), "stmt")
    return out.groupBy("rec", F.col("link").cast("long").alias("link")).agg(F.max("f853").alias("f853"), F.sum("n").alias("fields"), F.count(F.lit(1)).alias("statements"))


def record_links_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fields = _numbering(spark, sf_dir)
    out = number.merged(rows, ORDER, fields=fields).select("rec", "link", "stmt", "run_853", "merged").join(fields.select("stmt", "n"), "stmt")
    runs = out.groupBy("rec", F.col("link").cast("long").alias("link")).agg(F.max("run_853").alias("f853"), F.sum("n").alias("fields"), F.max("merged").alias("merged"))
    return runs.withColumn("f853", _shown(F.col("f853")))


def record_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.review_index(rendered.statements(spark, sf_dir).select("rec", "stmt").join(shared.settled(_converted(spark, sf_dir).select("stmt", "f863", "status", "flagged")), "stmt"))


def holdings_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.tally(audit.conserved(_converted(spark, sf_dir)))


def rules_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = rules.loaded(PATTERNS)
    return rules.by_source(rules.sourced(rendered.statements(spark, sf_dir), good))


def rules_captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = rules.loaded(PATTERNS)
    found = rules.captured(rules.sourced(rendered.statements(spark, sf_dir).select("stmt").distinct(), good), good).where("source = 'months'")
    value = lambda k: F.get("start.levels", F.lit(k))["value"]
    return found.select("stmt", value(0).alias("e1"), value(1).alias("e2"), F.col("start.year").alias("y1"), F.col("start.month").alias("m1"))


def rules_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct statement's source and the fields that it gives."""
    good, _ = rules.loaded(APPLIED)
    found = rules.applied(rendered.statements(spark, sf_dir), good)
    sources = found.groupBy("stmt").agg(F.max("source").alias("source"))
    done = convert.convert_statements(found).join(sources, "stmt")
    return done.select("stmt", "source", F.size("f863").cast("long").alias("fields"), _shown(F.get("f863", F.lit(0))).alias("f863"), F.exists("warnings", lambda w: w.startswith("passed_over")).alias("passed_over"))


def roles_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = roles.inferred(detect.patterns(rendered.statements(spark, sf_dir)))
    return found.select("signature", F.col("place").cast("long").alias("place"), F.col("group").alias("group_name"), "boundary", "kind", F.col("level").cast("long").alias("level"), "caption", "suggested")


def clusters_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.members(rendered.statements(spark, sf_dir))
    return roles.decides(found, parse.parse_distinct(found))


def statement_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place of each piece of a statement."""
    rows = rendered.statements(spark, sf_dir)
    whole = F.coalesce(parse.is_list(F.col("stmt")), F.lit(False))
    pieces = rows.select("rec", *ORDER, F.posexplode(F.when(whole, F.array("stmt")).otherwise(parse.top_level(F.col("stmt")))).alias("nth", "piece"))
    return marc.origins(pieces, ["rec", *ORDER, "nth"]).select("piece", "times", "rec", "v")


def free_text_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many whole documents pass the test for block statements (``parse.BLOCK``), which free text shouldn't."""
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("text").alias("stmt"))
    return lines.select(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("stmt").rlike(parse.BLOCK)).alias("blocks"))


QUERIES = (
    holdings_clusters, cluster_labels, holdings_match_rates, holdings_segments, holdings_top_level_pieces, holdings_predicates, holdings_ranges, holdings_values, holdings_captions,
    record_links, record_links_merged, record_review, holdings_audit, rules_by_source, rules_captured, rules_applied, roles_inferred, clusters_decide, statement_origins, free_text_statements,
)

_S = f"WITH s AS ({rendered.SQL})"
_D = f"WITH s AS ({rendered.SQL}), d AS (SELECT DISTINCT ON (stmt) family, v, i, y, m, stmt FROM s)"
_PAREN = "PAREN_OPEN|{}|PAREN_CLOSE"
_SIGNATURE = {
    "A": "VOL_CAP|NUMBER|ISS_CAP|NUMBER|" + _PAREN.format("CHRON|YEAR"),
    "B": "VOL_CAP|NUMBER|" + _PAREN.format("YEAR") + "|SEP_HYPHEN|VOL_CAP|NUMBER|" + _PAREN.format("YEAR"),
    "C": "VOL_CAP|NUMBER|" + _PAREN.format("YEAR") + "|SEP_HYPHEN",
    "D": "VOL_CAP|NUMBER|ISS_CAP|UNKNOWN|NUMBER|SEP_COMMA|NUMBER|" + _PAREN.format("YEAR"),
    "E": "YEAR|SEP_COLON|NUMBER|" + _PAREN.format("NUMBER|UNKNOWN|CHRON|UNKNOWN"),
    "F": "VOL_CAP|NUMBER|ISS_CAP|NUMBER|" + _PAREN.format("CHRON|YEAR"),
    "G": "NUMBER|UNKNOWN",
    "H": "VOL_CAP|NUMBER|" + _PAREN.format("YEAR") + "|SEP_COMMA|VOL_CAP|NUMBER|" + _PAREN.format("YEAR"),
}
_LABEL = {"A": "VOLISS(CHRONYEAR)", "B": "VOL(YEAR) \u2014 VOL(YEAR)", "C": "VOL(YEAR)\u2013", "D": "VOLISS\u2039text\u203a#,#(YEAR)", "E": "YEAR:#(#\u2039text\u203aCHRON\u2039text\u203a)", "F": "VOLISS(CHRONYEAR)", "G": "#\u2039text\u203a", "H": "VOL(YEAR),VOL(YEAR)"}
_CASE = lambda table: "CASE family " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"
_MM = "lpad(CAST(m AS VARCHAR), 2, '0')"
_VALUES = f"""
SELECT stmt, 0 AS pos, CASE family WHEN 'A' THEN concat('$a ', v, ' $b ', i, ' $i ', y, ' $j ', {_MM}) WHEN 'B' THEN concat('$a ', v, '-', v + 3, ' $i ', y, '-', y + 5)
    WHEN 'C' THEN concat('$a ', v, '- $i ', y, '-') WHEN 'D' THEN concat('$a ', v, ' $b ', i, ' $i ', y, ' $w g') WHEN 'E' THEN concat('$a ', v, ' $b ', i, ' $i ', y, ' $j ', {_MM})
    WHEN 'F' THEN concat('$a ', v, ' $b ', i, ' $i ', y, '/', y + 1, ' $j ', {rendered.SEASON_CODE}) ELSE concat('$a ', v, ' $i ', y) END AS f863 FROM d WHERE family <> 'G'
UNION ALL SELECT stmt, 1, CASE family WHEN 'D' THEN concat('$a ', v, ' $b ', i + 2, ' $i ', y) ELSE concat('$a ', v + 1, ' $i ', y + 2) END FROM d WHERE family IN ('D', 'H')"""
_F853 = {"A": "$a v. $b no. $i (year) $j (month)", "B": "$a v. $i (year)", "C": "$a v. $i (year)", "D": "$a v. $b no. $i (year)", "E": "$a (*) $b (*) $i (year) $j (month)", "F": "$a v. $b no. $i (year) $j (season)", "H": "$a v. $i (year)"}
_TEXT = "CAST({} AS VARCHAR)"
_ROLES = {
    "startvol": "'start', 'enum', 1, 'v.'", "startiss": "'start', 'enum', 2, 'no.'", "endvol": "'end', 'enum', 1, 'v.'", "endiss": "'end', 'enum', 1, 'no.'", "startyear": "'start', 'year', NULL, NULL",
    "endyear": "'end', 'year', NULL, NULL", "startmonth": "'start', 'month', NULL, NULL", "startnum": "'start', 'unresolved', NULL, NULL", "endnum": "'start', 'unresolved', NULL, NULL",
}
_GROUPS = {"A": "startvol startiss startmonth startyear", "B": "startvol startyear endvol endyear", "C": "startvol startyear", "D": "startvol startiss endiss startyear", "E": "startyear startnum endnum startmonth", "G": "startnum", "H": "startvol startyear endvol endyear"}
_ROLE_ROWS = ", ".join(f"('{_SIGNATURE[f]}', {k}, '{g}', {_ROLES[g]})" for f, groups in _GROUPS.items() for k, g in enumerate(groups.split()))

ORACLE = {
    "holdings_clusters": f"{_S} SELECT {_CASE(_SIGNATURE)} AS signature, count(*) AS statements, count(DISTINCT stmt) AS distinct_statements FROM s GROUP BY 1",
    "cluster_labels": f"{_S} SELECT {_CASE(_SIGNATURE)} AS signature, {_CASE(_LABEL)} AS label, {_CASE(_SIGNATURE)} AS coarse, CAST(1 AS BIGINT) AS clusters, count(*) AS statements FROM s GROUP BY 1, 2, 3",
    "holdings_match_rates": f"{_S} SELECT {_CASE(_SIGNATURE)} AS signature, count(*) AS matched, count(*) AS statements, CAST(1 AS DOUBLE) AS match_rate FROM s GROUP BY 1",
    "holdings_segments": f"{_D} SELECT stmt, CAST(k AS BIGINT) AS pos, CASE WHEN family <> 'H' THEN stmt ELSE string_split(stmt, ', ')[k + 1] END AS segment FROM d, (SELECT unnest([0, 1]) AS k) WHERE k = 0 OR family = 'H'",
    "holdings_top_level_pieces": f"{_D} SELECT stmt, CAST(k AS BIGINT) AS pos, CASE WHEN family NOT IN ('D', 'H') THEN stmt ELSE string_split(stmt, ', ')[k + 1] END AS piece FROM d, (SELECT unnest([0, 1]) AS k) WHERE k = 0 OR family IN ('D', 'H')",
    "holdings_predicates": f"{_S} SELECT family, count(*) AS statements, CAST(count(*) FILTER (family = 'C') AS BIGINT) AS open_statements, count(*) FILTER (family = 'D') AS lists, count(*) FILTER (family = 'E') AS blocks FROM s GROUP BY family",
    "holdings_ranges": f"""{_D} SELECT stmt, CAST(0 AS BIGINT) AS pos, {_TEXT.format('v')} AS e1, CASE WHEN family IN ('A', 'D', 'E', 'F') THEN {_TEXT.format('i')} END AS e2, CASE family WHEN 'F' THEN concat(y, '/', y + 1) ELSE {_TEXT.format('y')} END AS y1,
        CASE WHEN family IN ('A', 'E') THEN {_MM} WHEN family = 'F' THEN {rendered.SEASON_CODE} END AS m1, CASE WHEN family = 'B' THEN {_TEXT.format('v + 3')} END AS f1, CASE WHEN family = 'B' THEN {_TEXT.format('y + 5')} END AS y2, family = 'C' AS open_ended, family = 'D' AS gap_after FROM d WHERE family <> 'G'
        UNION ALL SELECT stmt, 1, CASE family WHEN 'D' THEN {_TEXT.format('v')} ELSE {_TEXT.format('v + 1')} END, CASE family WHEN 'D' THEN {_TEXT.format('i + 2')} END, CASE family WHEN 'D' THEN {_TEXT.format('y')} ELSE {_TEXT.format('y + 2')} END, NULL, NULL, NULL, FALSE, FALSE FROM d WHERE family IN ('D', 'H')""",
    "holdings_values": f"{_D} SELECT stmt, CAST(pos AS BIGINT) AS pos, f863 FROM ({_VALUES})",
    "holdings_captions": f"{_D} SELECT {_CASE(_F853)} AS f853, count(*) AS statements FROM d WHERE family <> 'G' GROUP BY 1",
    "record_links": f"""{_S}, f AS (SELECT *, {_CASE(_F853)} AS f853, CASE WHEN family IN ('D', 'H') THEN 2 ELSE 1 END AS n FROM s WHERE family <> 'G'),
        c AS (SELECT *, CASE WHEN f853 = lag(f853) OVER (PARTITION BY rec ORDER BY v, p, s, d, i) THEN 0 ELSE 1 END AS new FROM f),
        l AS (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY v, p, s, d, i ROWS UNBOUNDED PRECEDING) AS link FROM c)
        SELECT rec, CAST(link AS BIGINT) AS link, max(f853) AS f853, CAST(sum(n) AS BIGINT) AS fields, count(*) AS statements FROM l GROUP BY rec, link""",
    "record_review": f"{_S} SELECT rec, count(*) FILTER (family <> 'G') AS converted, count(*) FILTER (family = 'G') AS held, CAST(0 AS BIGINT) AS flagged, count(*) AS statements FROM s GROUP BY rec",
    "holdings_audit": f"{_D} SELECT CASE WHEN family = 'G' THEN 'review' ELSE 'ok' END AS verdict, count(*) AS statements FROM d GROUP BY 1",
    "rules_by_source": f"{_S} SELECT CASE family WHEN 'A' THEN 'months' WHEN 'G' THEN 'bare' WHEN 'B' THEN 'any' WHEN 'C' THEN 'any' WHEN 'D' THEN 'any' WHEN 'H' THEN 'any' ELSE 'parser' END AS source, count(*) AS statements FROM s GROUP BY 1",
    "rules_captured": f"{_D} SELECT stmt, {_TEXT.format('v')} AS e1, {_TEXT.format('i')} AS e2, {_TEXT.format('y')} AS y1, {_MM} AS m1 FROM d WHERE family = 'A'",
    "rules_applied": f"""{_D}, x AS (SELECT stmt, min(f863) FILTER (pos = 0) AS f863, count(*) AS n FROM ({_VALUES}) GROUP BY stmt)
        SELECT d.stmt, CASE WHEN family = 'A' THEN 'months' WHEN family IN ('B', 'C', 'H') THEN 'any' WHEN family = 'G' AND i % 2 = 0 THEN 'even' WHEN family = 'G' THEN 'skipped' ELSE 'parser' END AS source,
        CASE WHEN family = 'G' THEN CAST(i % 2 = 0 AS BIGINT) ELSE n END AS fields, CASE WHEN family = 'G' AND i % 2 = 0 THEN concat('$a ', i) ELSE f863 END AS f863, family = 'D' AS passed_over FROM d LEFT JOIN x USING (stmt)""",
    "roles_inferred": f"""{_S}, g AS (SELECT DISTINCT {_CASE(_SIGNATURE)} AS signature FROM s), r AS (SELECT * FROM (VALUES {_ROLE_ROWS}) AS t(signature, place, group_name, boundary, kind, level, caption))
        SELECT signature, CAST(place AS BIGINT) AS place, group_name, boundary, kind, CAST(level AS BIGINT) AS level, caption, FALSE AS suggested FROM r JOIN g USING (signature)""",
    "clusters_decide": f"{_S} SELECT {_CASE(_SIGNATURE)} AS signature, CASE max(family) WHEN 'G' THEN 'reading' WHEN 'E' THEN 'caption' ELSE 'nothing' END AS decides FROM s GROUP BY 1",
    "statement_origins": f"""{_S}, e AS (SELECT *, unnest(CASE WHEN family = 'H' THEN string_split(stmt, ', ') ELSE [stmt] END) AS piece, unnest(CASE WHEN family = 'H' THEN [0, 1] ELSE [0] END) AS nth FROM s),
        o AS (SELECT piece, rec, v, count(*) OVER (PARTITION BY piece) AS times, row_number() OVER (PARTITION BY piece ORDER BY rec, v, p, s, d, i, nth) AS turn FROM e) SELECT piece, times, rec, v FROM o WHERE turn = 1""",
    "free_text_statements": r"SELECT count(*) AS documents, count(*) FILTER (regexp_matches(text, '(?i)^\s*[NM]?\s*(?:\d{4}|\?)\s*:')) AS blocks FROM documents",
}
