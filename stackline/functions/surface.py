"""Functions for SQL whose bodies are built-in expressions, so queries that use them run without Python.

``register`` makes them for a session: ``holdings_signature``, ``holdings_open``, ``holdings_year``,
``holdings_chronology``, and the table function ``holdings_tokens`` (place, kind, text), to be joined laterally.
All give null, or no row, for a null statement.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from stackline.functions.codes import CHRONOLOGY_CODES
from stackline.functions.signature import KINDS, TOKEN

_LETTERS = "".join(letter for letter, _, _ in KINDS)
_NAMES = "map(" + ", ".join(f"'{letter}', '{kind}'" for letter, kind, _ in KINDS) + ")"
_CODES = "map(" + ", ".join(f"'{word}', '{code}'" for word, code in CHRONOLOGY_CODES.items()) + ")"
#: Every match replaced by its groups, of which one isn't empty, as in ``signature.tokens``.
_MARKED = f"filter(split(regexp_replace(trim(stmt), r'{TOKEN}', concat('\\u0001', " + ", '\\u0002', ".join(f"'${k + 1}'" for k in range(len(KINDS))) + ")), '\\u0001'), t -> t <> '')"
_TOKENS = f"transform({_MARKED}, t -> struct(substring('{_LETTERS}', length(t) - length(ltrim('\\u0002', t)) + 1, 1) AS letter, trim(BOTH '\\u0002' FROM t) AS text))"
_KINDS = f"array_join(transform({_TOKENS}, t -> t.letter), '')"
_MERGED = "translate(regexp_replace(CASE WHEN rlike(k, r'\\)S*-|-S*[VIP]') THEN regexp_replace(k, r'N(?:S*-S*N)+', 'N') ELSE k END, r'U(?:[US]*U)?', 'U'), 'S', '')"

FUNCTIONS = {
    "holdings_signature(stmt STRING) RETURNS STRING": f"array_join(transform(split(transform(array({_KINDS}), k -> {_MERGED})[0], ''), x -> {_NAMES}[x]), '|')",
    "holdings_open(stmt STRING) RETURNS BOOLEAN": r"rlike(stmt, r'-\s*$')",
    "holdings_year(year STRING) RETURNS STRING": "CASE WHEN rlike(year, r'^\\d{4}/\\d{2}$') THEN concat(left(year, 5), CAST(CAST(left(year, 2) AS INT) + CASE WHEN CAST(right(year, 2) AS INT) < CAST(substring(year, 3, 2) AS INT) THEN 1 ELSE 0 END AS STRING), right(year, 2)) ELSE year END",
    "holdings_chronology(word STRING) RETURNS STRING": f"coalesce({_CODES}[lower(regexp_replace(trim(word), r'\\.$', ''))], trim(word))",
}
TABLES = {"holdings_tokens(stmt STRING) RETURNS TABLE (place INT, kind STRING, text STRING)": f"SELECT pos + 1, {_NAMES}[t.letter], t.text FROM (SELECT posexplode({_TOKENS}) AS (pos, t)) WHERE t.letter <> 'S'"}


def register(spark: SparkSession) -> None:
    for head, body in {**FUNCTIONS, **TABLES}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
