"""URL filters: longest-fitting host and path rules, then a weighted vocabulary.

An Aho-Corasick automaton finds all terms in one pass over a lower-cased url. A hit counts
only between boundaries (start, end, or a character that is neither a-z nor 0-9). One strict
term blocks; so do two or more distinct soft ones whose weights reach the limit. The vocabulary
is rows of (term, weight, class), from a tuple or a table; terms are lowered as urls are.

Defined cases: a null url, or one without ``://``, has an empty host and path; its text
is still searched (null as empty). Of equally long rules none can tie, as one rule has one
verdict. Of a term that is there twice the strict row holds, else the greater weight; an empty
vocabulary blocks nothing; a term without letters or digits, a weight below 1 or another class
is an error. Repeated rows are judged each; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

STRICT, SOFT = "strict", "soft"
#: The default vocabulary: one strict hit is enough; soft terms weigh 1 (said of much else too) to 3.
STRICT_TERMS = (
    "casino", "casinos", "cheap-pills", "escort", "escorts", "hentai", "milf", "porn", "porno", "pornhub", "slots", "spam-farm",
    "sportsbook", "torrent", "torrents", "viagra", "cialis", "xxx", "xvideos", "warez-site",
)
SOFT_TERMS = (
    ("adult", 2), ("bet", 2), ("bets", 2), ("betting", 3), ("bonus", 2), ("cams", 2), ("cheap", 2), ("crack", 2), ("cracked", 2), ("deals", 2),
    ("download", 1), ("erotic", 3), ("free", 2), ("gambling", 3), ("hot", 2), ("jackpot", 3), ("keygen", 3), ("loan", 1), ("loans", 1), ("naked", 3),
    ("nude", 3), ("online", 1), ("payday", 2), ("pharmacy", 1), ("pills", 2), ("poker", 2), ("promo", 1), ("replica", 2), ("serial", 1), ("sex", 2),
    ("sexy", 2), ("spam", 2), ("vip", 1), ("warez", 2), ("win", 2), ("xx", 2),
)
SOFT_LIMIT, SOFT_TERMS_LEAST = 4, 2
VOCABULARY = (*((term, SOFT_LIMIT, STRICT) for term in STRICT_TERMS), *((term, n, SOFT) for term, n in SOFT_TERMS))
#: Terms that a vocabulary may have; it goes to all executors.
MOST_TERMS = 500_000

#: Host suffix and path prefix, written as ``host/path``, with the verdict.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#``; path: from there up to ``?`` or ``#``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = rest.split("?", 1)[0].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


class RuleTable:
    """Rules by host; a url looks up each suffix of its host's labels."""

    def __init__(self, rules: tuple[tuple[str, str], ...] = RULES):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        labels = host.split(".") if host else []
        fits = [(len(rule), rule, verdict) for k in range(len(labels)) for start, rule, verdict in self.by_host.get(".".join(labels[k:]), ()) if path.startswith(start)]
        return max(fits)[1:] if fits else None


class Vocabulary:
    """Terms with weight and class, and the automaton that finds them."""

    def __init__(self, rows: Iterable[tuple[str, int, str]], limit: int = SOFT_LIMIT):
        self.limit, self.terms = limit, {}
        for term, value, kind in rows:
            term = term.strip().translate(_LOWER)
            if not _WORD.intersection(term):
                raise ValueError(f"no letters or digits in the term {term!r}")
            if kind not in (STRICT, SOFT) or value < 1:
                raise ValueError(f"weight {value!r} or class {kind!r} of {term!r}")
            entry = (kind == STRICT, limit if kind == STRICT else int(value))
            self.terms[term] = max(self.terms.get(term, entry), entry)
        self.automaton = ahocorasick.Automaton()
        for term, entry in self.terms.items():
            self.automaton.add_word(term, (term, entry))
        if self.terms:
            self.automaton.make_automaton()

    def hits(self, url: str | None) -> dict[str, tuple[bool, int]]:
        """The distinct terms that stand between boundaries, with (strict, weight)."""
        text, found = (url or "").translate(_LOWER), {}
        for end, (term, entry) in self.automaton.iter(text) if self.terms else ():
            start = end - len(term)
            if (start < 0 or text[start] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
                found[term] = entry
        return found

    def judge(self, url: str | None) -> tuple[str, int]:
        """Verdict and weight of a url."""
        found = self.hits(url)
        total = sum(value for _, value in found.values())
        return "block" if any(s for s, _ in found.values()) or (len(found) >= SOFT_TERMS_LEAST and total >= self.limit) else "allow", total


def vocabulary(strict: Iterable[str], soft: Iterable[str | tuple[str, int]], limit: int) -> Vocabulary:
    """A vocabulary of strict terms and of soft ones, alone (weight 1) or with their weights."""
    return Vocabulary([*((t, limit, STRICT) for t in strict), *((t, 1, SOFT) if isinstance(t, str) else (*t, SOFT) for t in soft)], limit)


def vocabulary_of(table: DataFrame, limit: int = SOFT_LIMIT) -> Vocabulary:
    """A vocabulary from rows (term, weight, class) of a table of at most ``MOST_TERMS``."""
    rows = [(r[0], r[1], r[2]) for r in table.select("term", "weight", "class").limit(MOST_TERMS + 1).collect()]
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return Vocabulary(rows, limit)


def weight(url: str | None, terms: Vocabulary) -> int:
    """Sum of the weights of the distinct terms that stand between boundaries."""
    return terms.judge(url)[1]


def judge_urls(
    pages: DataFrame,
    rules: tuple[tuple[str, str], ...] = RULES,
    terms: Iterable[tuple[str, int, str]] | DataFrame = VOCABULARY,
    soft_limit: int = SOFT_LIMIT,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Host, path, fitting rule, verdict and vocabulary weight of each page's url."""
    kind = pages.schema[id_col].dataType.simpleString()
    words = vocabulary_of(terms, soft_limit) if isinstance(terms, DataFrame) else Vocabulary(terms, soft_limit)
    sent = pages.sparkSession.sparkContext.broadcast([(t, n, STRICT if strict else SOFT) for t, (strict, n) in words.terms.items()])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = RuleTable(rules), Vocabulary(sent.value, soft_limit)
        for b in batches:
            rows = []
            for url in b.column(1).to_pylist():
                host, path = host_and_path(url)
                rule, (verdict, total) = table.longest(host, path), known.judge(url)
                rows.append((host, path, rule and rule[0], rule[1] if rule else verdict, total))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.string()] * 4 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["page_id", "host", "path", "rule", "verdict", "weight"])

    return pages.select(id_col, url_col).mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string, weight long")


def sql() -> str:
    """The same on DuckDB."""
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hit = lambda term: f"CAST(regexp_matches(low, '(^|[^a-z0-9]){term}($|[^a-z0-9])') AS BIGINT)"
    total = " + ".join(f"{value} * {hit(term)}" for term, value, _ in VOCABULARY)
    strict = " + ".join(hit(term) for term in STRICT_TERMS)
    soft = " + ".join(hit(term) for term, _ in SOFT_TERMS)
    ranked = sorted(RULES, key=lambda r: -len(r[0]))

    def fits(rule: str) -> str:
        host, _, path = rule.partition("/")
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"

    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in ranked)
    verdict = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES)
    return f"""
WITH a AS (SELECT page_id, {low} AS low,
    CASE WHEN contains(url, '://') THEN regexp_replace(substr(url, instr(url, '://') + 3), '(?s)[?#].*$', '') ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM a),
c AS (SELECT page_id, host, path, CASE {rule} END AS rule, {total} AS weight, {strict} AS strict, {soft} AS soft FROM b)
SELECT page_id, host, path, rule, CASE rule {verdict} ELSE CASE WHEN strict > 0 OR (soft >= {SOFT_TERMS_LEAST} AND weight >= {SOFT_LIMIT}) THEN 'block' ELSE 'allow' END END AS verdict, CAST(weight AS BIGINT) AS weight FROM c"""
