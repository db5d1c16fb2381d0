"""Holdings statements rendered from ``lineitem``; the same text in Spark and DuckDB SQL.

The tables hold no bibliographic records. Statements of eight families are put together
from columns, so what parsing should give back is known from these columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FAMILIES = "ABCDEFGH"
_MONTH = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * m - 2, 3)"
_SEASON = "CASE WHEN m <= 3 THEN 'Spring' WHEN m <= 6 THEN 'Summer' WHEN m <= 9 THEN 'Fall' ELSE 'Winter' END"
SEASON_CODE = "CASE WHEN m <= 3 THEN '21' WHEN m <= 6 THEN '22' WHEN m <= 9 THEN '23' ELSE '24' END"

#: Columns that a statement is made of; valid in both dialects.
COLUMNS = "l_orderkey AS rec, l_linenumber AS v, CAST(l_quantity AS INT) AS i, year(l_shipdate) AS y, month(l_shipdate) AS m, l_partkey AS p, l_suppkey AS s, l_shipdate AS d, substr('ABCDEFGH', CAST((l_orderkey + l_linenumber) % 8 AS INT) + 1, 1) AS family"
TEXT = f"""CASE family
    WHEN 'A' THEN concat('v. ', v, ' no. ', i, ' (', {_MONTH}, ' ', y, ')')
    WHEN 'B' THEN concat('v.', v, '(', y, ')-v.', v + 3, '(', y + 5, ')')
    WHEN 'C' THEN concat('v. ', v, ' (', y, ')-')
    WHEN 'D' THEN concat('v. ', v, ' nos. ', i, ', ', i + 2, ' (', y, ')')
    WHEN 'E' THEN concat(y, ': ', v, ' (', i, ' [', {_MONTH}, '])')
    WHEN 'F' THEN concat('v. ', v, ' no. ', i, ' (', {_SEASON}, ' ', y, '/', lpad(CAST((y + 1) % 100 AS VARCHAR(4)), 2, '0'), ')')
    WHEN 'G' THEN concat(i, ' ?')
    ELSE concat('v.', v, '(', y, '), v.', v + 1, '(', y + 2, ')') END"""
SQL = f"SELECT *, {TEXT} AS stmt FROM (SELECT {COLUMNS} FROM lineitem)"


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql(SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=lineitem)


#: Families in which something is lost, dropped or can't be read, besides one (A) in which nothing is.
ODD = "AJKLMNPQ"
ODD_COLUMNS = COLUMNS.replace("substr('ABCDEFGH', CAST((l_orderkey + l_linenumber) % 8", f"substr('{ODD}', CAST((l_orderkey + l_linenumber + {{shift}}) % 8")
NEXT_MONTH = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * (m % 12) + 1, 3)"
ODD_TEXT = f"""CASE family
    WHEN 'A' THEN concat('v. ', v, ' no. ', i, ' (', {_MONTH}, ' ', y, ')')
    WHEN 'J' THEN concat('v. ', v, ' no. ', i, ' (', {_MONTH}, ' & ', {NEXT_MONTH}, ' ', y, ')')
    WHEN 'K' THEN concat('v. ', v, ' no. ', i, ' (', y, ')-v. ', v + 2, ' no. ', i, ' (', y + 5, ')')
    WHEN 'L' THEN concat('v. ', v, ' (', y, '), see ', i + 100)
    WHEN 'M' THEN concat('v. ', v, ' (', y, ')-v. ', v + 3, ' no. ', i, ' (', y + 5, ')')
    WHEN 'N' THEN concat('v. ', v, ' no. 1 (', y, ')-v. ', v + 2, ' no. 4 (Dec ', y + 5, ')')
    WHEN 'P' THEN concat('v. ', v, ' (Late ', y, ')')
    ELSE concat('v. ', v, ' (', y, ') + index ', i) END"""


def odd_sql(shift: int = 0, more: str = "") -> str:
    return f"SELECT *, {ODD_TEXT} AS stmt FROM (SELECT {ODD_COLUMNS.format(shift=shift)}, l_returnflag AS flag{more} FROM lineitem)"


def odd_statements(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql(odd_sql(shift).replace("FROM lineitem", "FROM {lineitem}"), lineitem=lineitem)
