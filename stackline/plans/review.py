"""Queries of the audits, previews and screenings, over rendered statements; and what DuckDB finds from the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackline.functions import shared, surface
from stackline.operators import audit, convert, detect, exposure, parse, preview, roles, rules, screen
from stackline.plans import rendered
from stackline.plans.holdings import _CASE, _F853, _S, _SIGNATURE, ORDER, PATTERNS, _shown
from stackline.sources import marc

#: Expressions as users write them; valid in both dialects, so without backslashes.
EXPRESSION = """CASE family
    WHEN 'A' THEN '(?<startvol>([0-9]|[0-9][0-9])+)x'
    WHEN 'B' THEN concat('v[.] (?<startvol>[0-9]{1,', i, '}) [(](?<startyear>[0-9]{4})[)]')
    WHEN 'C' THEN '^([ ]*[a-z]+)*$'
    WHEN 'D' THEN '(?<a>([a-z]+[0-9]*)+)'
    WHEN 'E' THEN 'v[.](?<a>[0-9]+)(?:, v[.](?<b>[0-9]+))*'
    WHEN 'F' THEN '(v|v[.]|vol)+ [0-9]'
    WHEN 'G' THEN '(?:(?:nos|no|n)[.]? ?(?<i>[0-9]+),? ?)+'
    ELSE concat('(a{', i % 9 + 2, '}|a)+x') END"""
CANDIDATE = {"id": "open", "regex": r"v\. (?<startvol>\d+) \((?<startyear>\d{4})\)-"}
#: What each family's writer left in the fields: declared captions, and values.
WRITTEN = {
    "A": ("'a v.|b no.|i (year)|j (month)'", "concat('a ', v, '|b ', i, '|i ', y, '|j 07')"),
    "J": ("'a v.|b no.|i (year)|j (month)'", "concat('a ', v, '|b ', i, '|i ', y, '|j Spring issue')"),
    "K": ("'a v.|b no.|i (year)'", "concat('a ', v, '-', v + 2, '|b ', i, '|i ', y, '-', y + 5)"),
    "L": ("'a v.|i (year)'", "concat('a ', v, '|i ', y)"),
    "M": ("'a v.|b no.|i (year)'", "concat('a ', v, '-', v + 3, '|i ', y, '-', y + 5)"),
    "N": ("'a v.|b no.|i (year)|j (month)'", "concat('a ', v, '-', v + 2, '|b 1-4|i ', y, '-', y + 5, '|j 12')"),
    "P": ("'a v.|i (year)|j (month)'", "concat('a ', v, '|i ', y, '|j Late')"),
}


def expressions_screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct expression's verdict, and how many ask for it."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("CAST(l_quantity AS INT) AS i", "substr('ABCDEFGH', CAST((l_orderkey + l_linenumber) % 8 AS INT) + 1, 1) AS family").selectExpr(f"{EXPRESSION} AS regex")
    counted = rows.groupBy("regex").agg(F.count(F.lit(1)).alias("asked"))
    return counted.join(screen.screened(counted), "regex").select("regex", "verdict", "asked")


def partial_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.exposed(rendered.statements(spark, sf_dir)).select("stmt", "matched", F.round("share", 6).alias("share"))


def audit_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each odd statement's verdict and how many of its values no field holds."""
    done = audit.conserved(convert.convert_statements(parse.parse_distinct(rendered.odd_statements(spark, sf_dir))))
    return done.select("stmt", "verdict", F.exists("missing", lambda x: F.length(x) == 3).alias("lost_reference"))


def audit_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with fields that some writer left, by statement."""
    rows = rendered.odd_statements(spark, sf_dir)
    case = lambda k: "CASE family " + " ".join(f"WHEN '{f}' THEN {w[k]}" for f, w in WRITTEN.items()) + " END"
    pairs = lambda text: F.transform(F.split(text, r"\|"), lambda x: F.struct(F.substring(x, 1, 1).alias("code"), F.substring(x, 3, 99).alias("value")))
    left = rows.where("family <> 'Q'").select("stmt", F.expr(case(0)).alias("d"), F.expr(case(1)).alias("w")).distinct().select("stmt", pairs(F.col("d")).alias("declared"), pairs(F.col("w")).alias("v863"))
    found = audit.endpoints(parse.parse_distinct(rows).where("pos = 0").withColumn("warnings", F.array().cast("array<string>")).join(left, "stmt"))
    return found.select("stmt", *(F.array_join(c, "; ").alias(c) for c in ("undeclared", "end_only", "end_only_silent", "prose", "collapsed", "phantom")))


def audit_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over holdings that changed meanwhile: returned items are new, items not yet shipped are gone, others have another statement."""
    before, after = (rendered.odd_statements(spark, sf_dir, shift).where(f"flag <> '{gone}'") for shift, gone in ((0, "R"), (1, "N")))
    each = before.select("stmt").union(after.select("stmt"))
    verdict = shared.settled(audit.conserved(convert.convert_statements(parse.parse_distinct(each))).select("stmt", "verdict"))
    runs = [rows.select("rec", "v", "stmt").join(verdict, "stmt") for rows in (before, after)]
    return audit.drift(*runs, keys=["rec", "v"]).groupBy("drift", "before", "after").agg(F.count(F.lit(1)).alias("statements"))


def detector_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.statistics(rendered.odd_statements(spark, sf_dir))


def clusters_confusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.confusable(rendered.odd_statements(spark, sf_dir))


def clusters_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rendered.statements(spark, sf_dir)
    members = detect.members(rows, head="rec")
    decided = roles.decides(members, parse.parse_distinct(members))
    found = detect.annotated(rows, ["rec", *ORDER], decided, found=members)
    first = F.get("values", F.lit(0))
    return found.select("signature", "statements", F.array_join("examples", " | ").alias("examples"), first["group"].alias("first_group"), F.array_join(first["values"], " ").alias("first_values"), F.col("first.rec").alias("rec"), F.col("first.v").alias("v"), "decides", "needs_decision")


def pattern_previewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that a candidate pattern would change."""
    rows, (library, _) = rendered.statements(spark, sf_dir), rules.loaded(PATTERNS)
    kept = shared.settled(preview.fits(rows, library))
    return preview.records_changed(rows, preview.changed(kept, library, CANDIDATE))


def record_previewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of finished and open orders' records, the open ones kept separate and urgent ones skipped."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("rec"), "o_orderstatus", "o_orderpriority")
    out = preview.records(rendered.statements(spark, sf_dir), ORDER, orders.where("o_orderstatus <> 'P'"), orders.where("o_orderpriority = '1-URGENT'"), orders.where("o_orderstatus = 'O'"))
    runs = out.groupBy("rec", "link", "separate").agg(F.max("run_853").alias("f853"), F.sum(F.size("f863")).alias("fields"), F.count(F.lit(1)).alias("statements"))
    return runs.withColumn("f853", _shown(F.col("f853")))


def signatures_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures and tokens by the SQL functions alone."""
    surface.register(spark)
    rows = rendered.statements(spark, sf_dir)
    texts = rows.groupBy("stmt").agg(F.count(F.lit(1)).alias("n"))
    each = spark.sql("SELECT stmt, n, kind FROM {texts}, LATERAL holdings_tokens(stmt)", texts=texts).groupBy("stmt", "n").agg(F.count("kind").alias("tokens"))
    return each.select(F.expr("holdings_signature(stmt)").alias("signature"), "n", "tokens").groupBy("signature").agg(F.sum(F.col("n") * F.col("tokens")).alias("tokens"), F.count(F.lit(1)).alias("distinct_statements"))


def records_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records made of the statements, written as MARC, read in by the entry point, and counted."""
    rows = rendered.statements(spark, sf_dir)
    none, sub = F.lit(None).cast("string"), lambda x: F.array(F.struct(F.lit("a").alias("code"), x.alias("value")))
    field = lambda tag, data, subs: F.struct(F.lit(0).alias("pos"), F.lit(tag).alias("tag"), data.alias("data"), F.lit(" ").alias("ind1"), F.lit("0").alias("ind2"), subs.alias("subfields"))
    held = rows.groupBy("rec").agg(F.sort_array(F.collect_list(F.struct(*ORDER, "stmt"))).alias("s"))  # an order has seven lines at most
    fields = F.concat(F.array(field("001", F.col("rec").cast("string"), F.array().cast(marc.SUBFIELDS)), field("245", none, sub(F.concat(F.lit("Serial "), F.col("rec"))))), F.transform("s", lambda x: field("866", none, sub(x["stmt"]))))
    records = held.select(F.col("rec").alias("rec_idx"), fields.alias("fields"), F.lit("00000nas a2200000 a 4500").alias("leader"))
    at = shared.path(spark, "marc")
    marc.write_marc(records, f"{at}/files")
    marc.ingest(spark, f"{at}/files", f"{at}/in")
    read = spark.read.parquet(f"{at}/in/records")
    told = marc.summary(read).select("file", "rec_idx", F.col("control").cast("long").alias("rec"), "title")
    return spark.read.parquet(f"{at}/in/statements").join(told, ["file", "rec_idx"]).groupBy("rec").agg(F.max("title").alias("title"), F.count(F.lit(1)).alias("statements"), F.min("stmt").alias("least"), F.min("pos").cast("long").alias("first_pos"))


QUERIES = (
    expressions_screened, partial_fits, audit_losses, audit_endpoints, audit_drift, detector_statistics, clusters_confusable, clusters_annotated, pattern_previewed, record_previewed, signatures_by_sql, records_ingested,
)

_O = f"WITH s AS ({rendered.odd_sql()})"
_PAREN = "PAREN_OPEN|{}|PAREN_CLOSE"
_ODD_SIGNATURE = {
    "A": "VOL_CAP|NUMBER|ISS_CAP|NUMBER|" + _PAREN.format("CHRON|YEAR"),
    "J": "VOL_CAP|NUMBER|ISS_CAP|NUMBER|" + _PAREN.format("CHRON|UNKNOWN|CHRON|YEAR"),
    "K": "VOL_CAP|NUMBER|ISS_CAP|NUMBER|" + _PAREN.format("YEAR") + "|SEP_HYPHEN|VOL_CAP|NUMBER|ISS_CAP|NUMBER|" + _PAREN.format("YEAR"),
    "L": "VOL_CAP|NUMBER|" + _PAREN.format("YEAR") + "|SEP_COMMA|UNKNOWN|NUMBER",
    "M": "VOL_CAP|NUMBER|" + _PAREN.format("YEAR") + "|SEP_HYPHEN|VOL_CAP|NUMBER|ISS_CAP|NUMBER|" + _PAREN.format("YEAR"),
    "N": "VOL_CAP|NUMBER|ISS_CAP|NUMBER|" + _PAREN.format("YEAR") + "|SEP_HYPHEN|VOL_CAP|NUMBER|ISS_CAP|NUMBER|" + _PAREN.format("CHRON|YEAR"),
    "P": "VOL_CAP|NUMBER|" + _PAREN.format("UNKNOWN|YEAR"),
    "Q": "VOL_CAP|NUMBER|" + _PAREN.format("YEAR") + "|UNKNOWN|NUMBER",
}
_TEXT = "‹text›"
_ODD_LABEL = {"A": "VOLISS(CHRONYEAR)", "J": f"VOLISS(CHRON{_TEXT}CHRONYEAR)", "K": "VOLISS(YEAR) — VOLISS(YEAR)", "L": f"VOL(YEAR),{_TEXT}#", "M": "VOL(YEAR) — VOLISS(YEAR)", "N": "VOLISS(YEAR) — VOLISS(CHRONYEAR)", "P": f"VOL({_TEXT}YEAR)", "Q": f"VOL(YEAR){_TEXT}#"}
_VERDICT = {"A": "ok", "J": "warn", "K": "ok", "L": "loss", "M": "warn", "N": "warn", "P": "warn", "Q": "fail"}
_PART = {"A": "concat(v, ' n')", "B": "concat(v, '(')", "C": "concat(v, ' (')", "D": "concat(v, ' n')", "E": "concat(y, ':')", "F": "concat(v, ' n')", "H": "concat(v, '(')"}
_WRONG = {  # of each family: undeclared, end_only, end_only_silent, prose, collapsed, phantom
    "A": ("''",) * 6, "J": ("''", "''", "''", "'$j Spring issue'", "''", "''"), "K": ("''", "''", "''", "''", "concat('$b ', i, '-', i)", "''"), "L": ("''",) * 6,
    "M": ("'b'", "concat('$b ', i)", "concat('$b ', i)", "''", "''", "''"), "N": ("''", "''", "''", "''", "''", "'$j 12'"), "P": ("''", "''", "''", "'$j Late'", "''", "''"),
}
_wrong = lambda k: "CASE family " + " ".join(f"WHEN '{f}' THEN {w[k]}" for f, w in _WRONG.items()) + " END"
_COARSE = {**_ODD_SIGNATURE, "J": _ODD_SIGNATURE["A"]}
_CLUSTERS = f"{_O}, c AS (SELECT {_CASE(_ODD_SIGNATURE)} AS signature, {_CASE(_ODD_LABEL)} AS label, {_CASE(_COARSE)} AS coarse, count(*) AS statements FROM s GROUP BY 1, 2, 3)"
_FIRST = {**{f: ("startvol", "v") for f in "ABCDFH"}, "E": ("startyear", "y"), "G": ("startnum", "i")}
#: Runs that grow, record by record: a statement joins where one of the two patterns holds the other.
_MERGED = f"""f AS (SELECT *, {_CASE(_F853)} AS p853, CASE WHEN family IN ('D', 'H') THEN 2 ELSE 1 END AS n FROM rows WHERE family <> 'G'),
    o AS (SELECT rec, n, p853, [x for x in string_split(p853, '$') if x <> ''] AS p, row_number() OVER (PARTITION BY rec ORDER BY v, p, s, d, i) AS k FROM f),
    g AS (SELECT rec, k, n, p853, [trim(x) for x in p] AS p FROM o),
    r AS (SELECT rec, k, n, p853 AS own, p AS own_p, p AS most, 1 AS link, false AS subset FROM g WHERE k = 1
        UNION ALL SELECT g.rec, g.k, g.n, g.p853, g.p, CASE WHEN meets THEN CASE WHEN len(g.p) > len(q.most) THEN g.p ELSE q.most END ELSE g.p END, CASE WHEN meets THEN q.link ELSE q.link + 1 END, meets AND list_sort(g.p) <> list_sort(q.most)
        FROM (SELECT r.*, nxt.p AS next_p, len(list_distinct(list_concat(r.most, nxt.p))) = greatest(len(r.most), len(nxt.p)) AS meets FROM r JOIN g AS nxt ON nxt.rec = r.rec AND nxt.k = r.k + 1) AS q JOIN g ON g.rec = q.rec AND g.k = q.k + 1),
    m AS (SELECT rec, link, arg_max(own, len(own_p)) AS f853, CAST(sum(n) AS BIGINT) AS fields, count(*) AS statements, bool_or(subset) AS merged FROM r GROUP BY rec, link)"""
MERGED_LINKS = f"WITH RECURSIVE rows AS ({rendered.SQL}), {_MERGED} SELECT rec, CAST(link AS BIGINT) AS link, f853, fields, merged FROM m"

ORACLE = {
    "expressions_screened": f"WITH s AS (SELECT {rendered.COLUMNS} FROM lineitem) SELECT {EXPRESSION} AS regex, CASE WHEN family IN ('A', 'C', 'D', 'H') THEN 'exponential' ELSE 'ok' END AS verdict, count(*) AS asked FROM s GROUP BY 1, 2",
    "partial_fits": f"{_S}, d AS (SELECT DISTINCT stmt, CASE family {' '.join(f'WHEN {k!r} THEN {x}' for k, x in _PART.items())} END AS matched FROM s WHERE family <> 'G') SELECT stmt, matched, round(length(matched) / length(stmt), 6) AS share FROM d",
    "audit_losses": f"{_O} SELECT DISTINCT stmt, {_CASE(_VERDICT)} AS verdict, family = 'L' OR (family = 'Q' AND i >= 100) AS lost_reference FROM s",
    "audit_endpoints": f"{_O} SELECT DISTINCT stmt, {', '.join(f'{_wrong(k)} AS {c}' for k, c in enumerate(('undeclared', 'end_only', 'end_only_silent', 'prose', 'collapsed', 'phantom')))} FROM s WHERE family <> 'Q'",
    "audit_drift": f"""WITH a AS ({rendered.odd_sql(0)}), b AS ({rendered.odd_sql(1)}), x AS (SELECT rec, v, {_CASE(_VERDICT)} AS before FROM a WHERE flag <> 'R'), y AS (SELECT rec, v, {_CASE(_VERDICT)} AS after FROM b WHERE flag <> 'N')
        SELECT CASE WHEN before IS NULL THEN 'new' WHEN after IS NULL THEN 'gone' WHEN before = after THEN 'unchanged' WHEN after = 'ok' THEN 'fixed' WHEN before = 'ok' THEN 'broken' ELSE 'changed' END AS drift, before, after, count(*) AS statements FROM x FULL JOIN y USING (rec, v) GROUP BY 1, 2, 3""",
    "detector_statistics": f"""{_CLUSTERS} SELECT CASE WHEN grouping(coarse) = 0 THEN 'shape' WHEN grouping(label) = 0 THEN 'label' ELSE 'all' END AS scope, coalesce(coarse, label) AS key, count(*) AS clusters, count(*) FILTER (statements = 1) AS singletons,
        CAST(0 AS BIGINT) AS declined, CAST(0 AS BIGINT) AS imperfect, CAST(sum(statements) AS BIGINT) AS statements FROM c GROUP BY GROUPING SETS ((), (coarse), (label))""",
    "clusters_confusable": f"{_CLUSTERS} SELECT signature, min(signature) OVER (PARTITION BY coarse) AS family FROM c",
    "clusters_annotated": f"""{_S}, t AS (SELECT *, {_CASE(_SIGNATURE)} AS signature, CASE family WHEN 'E' THEN 'startyear' WHEN 'G' THEN 'startnum' ELSE 'startvol' END AS g, CAST(CASE family WHEN 'E' THEN y WHEN 'G' THEN i ELSE v END AS VARCHAR) AS x FROM s),
        e AS (SELECT signature, stmt, count(*) AS n FROM t GROUP BY 1, 2), e3 AS (SELECT signature, string_agg(stmt, ' | ' ORDER BY n DESC, stmt) AS examples FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY signature ORDER BY n DESC, stmt) <= 3) GROUP BY 1),
        w AS (SELECT signature, g, x, count(*) AS n FROM t GROUP BY 1, 2, 3), w3 AS (SELECT signature, g, string_agg(x, ' ' ORDER BY n DESC, x) AS first_values FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY signature ORDER BY n DESC, x) <= 3) GROUP BY 1, 2),
        o AS (SELECT signature, rec, v, count(*) OVER (PARTITION BY signature) AS statements, CASE family WHEN 'G' THEN 'reading' WHEN 'E' THEN 'caption' ELSE 'nothing' END AS decides FROM t QUALIFY row_number() OVER (PARTITION BY signature ORDER BY rec, v) = 1)
        SELECT signature, statements, examples, g AS first_group, first_values, rec, v, decides, decides <> 'nothing' AS needs_decision FROM o JOIN e3 USING (signature) JOIN w3 USING (signature)""",
    "pattern_previewed": f"{_S} SELECT rec, count(*) AS statements, CAST(1 AS BIGINT) AS sources, 'open' AS after FROM s WHERE family = 'C' GROUP BY rec",
    "record_previewed": f"""WITH RECURSIVE whole AS ({rendered.SQL}), asked AS (SELECT o_orderkey AS rec, o_orderstatus = 'O' AS separate FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT'),
        rows AS (SELECT whole.* FROM whole JOIN asked USING (rec) WHERE NOT separate), {_MERGED},
        z AS (SELECT whole.*, {_CASE(_F853)} AS f853, CASE WHEN family IN ('D', 'H') THEN 2 ELSE 1 END AS n FROM whole JOIN asked USING (rec) WHERE separate AND family <> 'G'),
        c AS (SELECT *, CASE WHEN f853 = lag(f853) OVER (PARTITION BY rec ORDER BY v, p, s, d, i) THEN 0 ELSE 1 END AS new FROM z),
        l AS (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY v, p, s, d, i ROWS UNBOUNDED PRECEDING) AS link FROM c)
        SELECT rec, CAST(link AS BIGINT) AS link, false AS separate, f853, fields, statements FROM m
        UNION ALL SELECT rec, CAST(link AS BIGINT), true, max(f853), CAST(sum(n) AS BIGINT), count(*) FROM l GROUP BY rec, link""",
    "signatures_by_sql": f"{_S} SELECT {_CASE(_SIGNATURE)} AS signature, CAST(sum(CASE family WHEN 'A' THEN 8 WHEN 'B' THEN 11 WHEN 'C' THEN 6 WHEN 'D' THEN 11 WHEN 'E' THEN 9 WHEN 'F' THEN 8 WHEN 'G' THEN 2 ELSE 11 END) AS BIGINT) AS tokens, count(DISTINCT stmt) AS distinct_statements FROM s GROUP BY 1",
    "records_ingested": f"{_S} SELECT rec, concat('Serial ', rec) AS title, count(*) AS statements, min(stmt) AS least, CAST(2 AS BIGINT) AS first_pos FROM s GROUP BY rec",
    "record_links_merged": MERGED_LINKS,
}
