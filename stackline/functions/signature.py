"""Tokens of a statement and its structural signature, in built-in expressions.

Each alternative of one expression is a kind of token, and the first that fits wins. A
statement's kinds are first one letter each, so that runs are merged by replacing text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackline.functions.codes import CHRONOLOGY_CODES, let

#: Months and seasons by name; seasons' abbreviations are words of other kinds, too.
_MONTHS = "|".join(sorted((w for w, code in CHRONOLOGY_CODES.items() if code < "13" or len(w) > 4 or w == "fall"), key=len, reverse=True))
#: Letter, kind and pattern, in the order in which they are tried.
KINDS = (
    ("V", "VOL_CAP", r"\bv(?:ol(?:ume)?)?s?\.?"),
    ("P", "PT_CAP", r"\b(?:part|pt)\.?(?![A-Za-z])"),
    ("Y", "YEAR", r"\b(?:18|19|20)\d\d(?:/\d{2}(?:\d{2})?)?(?!\d)"),
    ("C", "CHRON", rf"\b(?:{_MONTHS})\b\.?(?:/(?:{_MONTHS})\b\.?)*"),
    ("I", "ISS_CAP", r"\b(?:issue|iss|number|num|nr|no)\.?(?![A-Za-z])|\bno\.?(?=s)"),
    ("N", "NUMBER", r"\d+[A-Za-z]?(?:/\d+[A-Za-z]?)*"),
    ("(", "PAREN_OPEN", r"\("),
    (")", "PAREN_CLOSE", r"\)"),
    (":", "SEP_COLON", r":"),
    ("-", "SEP_HYPHEN", r"-"),
    (",", "SEP_COMMA", r","),
    ("S", "SPACE", r"\s+"),
    ("U", "UNKNOWN", r"."),
)
TOKEN = "(?is)" + "|".join(f"({pattern})" for _, _, pattern in KINDS)


_NEXT, _ELSE = "\u0001", "\u0002"


def tokens(statement: Column) -> Column:
    """(letter, text) of each token, from one pass: every match is replaced by its groups, of which one isn't empty."""
    plain = F.translate(statement, _NEXT + _ELSE, "\u001a\u001a")
    marked = F.regexp_replace(plain, TOKEN, _NEXT + _ELSE.join(f"${k + 1}" for k in range(len(KINDS))))
    names = F.lit("".join(letter for letter, _, _ in KINDS))

    def read(t: Column) -> Column:
        before = F.length(t) - F.length(F.ltrim(t, F.lit(_ELSE)))
        return F.struct(F.substring(names, before + 1, F.lit(1)).alias("letter"), F.trim(t, F.lit(_ELSE)).alias("text"))

    return F.transform(F.filter(F.split(marked, _NEXT), lambda t: t != ""), read)


def letters(statement: Column) -> Column:
    """One letter for each token. All patterns are tried together, as boundaries depend on the neighbours."""
    return F.array_join(F.transform(tokens(statement), lambda t: t["letter"]), "")


def compact(kinds: Column) -> Column:
    """Numbers with hyphens as one where another hyphen divides the statement; runs of unknown text as one; no spaces."""
    divided = kinds.rlike(r"\)S*-|-S*[VIP]")
    merged = F.when(divided, F.regexp_replace(kinds, r"N(?:S*-S*N)+", "N")).otherwise(kinds)
    return F.translate(F.regexp_replace(merged, r"U(?:[US]*U)?", "U"), "S", "")


def signature(statement: Column) -> Column:
    """Names of the kinds of tokens joined by ``|``; of a null statement, null."""
    return names(letters(F.trim(statement)))


def names(kinds: Column) -> Column:
    """The names of a statement's letters, merged, joined by ``|``."""
    said = F.create_map(*(F.lit(x) for letter, kind, _ in KINDS for x in (letter, kind)))
    return F.array_join(F.transform(F.split(let(kinds, compact), ""), lambda x: said[x]), "|")


def open_ended(statement: Column) -> Column:
    return statement.rlike(r"-\s*$")


def kinds_of(signature: Column) -> Column:
    """The letters of a signature's kinds; of the empty signature, none."""
    letter = F.create_map(*(F.lit(x) for letter, kind, _ in KINDS for x in (kind, letter)))
    return F.array_join(F.transform(F.split(signature, r"\|"), lambda x: letter[x]), "")


def range_separator(kinds: Column) -> Column:
    """Place, from 1, of the first hyphen between the start and the end of a range; null where there is none.

    It is outside parentheses, isn't the last token, and follows a parenthesis, precedes a caption or is between two
    years. Other hyphens join values of one level.
    """
    depth = lambda before: F.length(F.translate(before, ")", "")) - F.length(F.translate(before, "(", ""))

    def divides(i: Column) -> Column:
        around = F.concat(F.when(i == 1, F.lit("^")).otherwise(kinds.substr(i - 1, F.lit(1))), kinds.substr(i, F.lit(2)))
        return around.rlike(r"\)-.|.-[VIP]|Y-Y") & (depth(F.left(kinds, i - 1)) == 0)

    return F.get(F.filter(F.sequence(F.lit(1), F.greatest(F.length(kinds), F.lit(1))), divides), F.lit(0))


#: What a label shows for a letter; ``=`` stands for the separator of a range and ``~`` for the hyphen of an open one.
_SHOWN = {"V": "VOL", "I": "ISS", "P": "PT", "Y": "YEAR", "C": "CHRON", "U": "\u2039text\u203a", "=": " \u2014 ", "~": "\u2013", "(": "(", ")": ")", ":": ":", ",": ",", "-": "-"}


def label(signature: Column, most: int = 80) -> Column:
    """A signature as a cataloguer reads it: ``VOL(YEAR) \u2014 VOL(YEAR)``.

    A caption stands for its number, too. A number after a hyphen is of the caption before it in that side of the range;
    other numbers are ``#``. Beyond ``most`` characters the rest is cut off; the empty signature's label is empty.
    """
    shown = F.create_map(*(F.lit(x) for pair in _SHOWN.items() for x in pair))
    none = F.lit(None).cast("string")

    def step(state: Column, x: Column) -> Column:
        captioned = state["last"].isin("V", "I", "P")
        number = F.when(captioned, "").when((state["last"] == "-") & state["caption"].isNotNull(), state["caption"]).otherwise("#")
        text = F.when(x == "N", number).otherwise(shown[x])
        caption = F.when(x.isin("V", "I", "P"), shown[x]).when(x != "=", state["caption"])
        return F.struct(x.alias("last"), caption.alias("caption"), F.concat(state["text"], text).alias("text"))

    def marked(kinds: Column) -> Column:
        at = range_separator(kinds)
        divided = F.when(at.isNull(), kinds).otherwise(F.concat(F.left(kinds, at - 1), F.lit("="), kinds.substr(at + 1, F.length(kinds))))
        return F.regexp_replace(divided, "-$", "~")

    start = F.struct(none.alias("last"), none.alias("caption"), F.lit("").alias("text"))
    read = let(kinds_of(signature), lambda k: F.aggregate(F.regexp_extract_all(marked(k), F.lit("(.)"), F.lit(1)), start, step)["text"])
    return F.left(read, F.lit(most))


def coarse(signature: Column) -> Column:
    """The signature in which months and seasons are one kind, and values of it with free text (a slash) between them are one."""
    one = F.regexp_replace(signature, r"(?<![^|])(?:MON|SEASON)(?![^|])", "CHRON")
    return F.regexp_replace(one, r"(?<![^|])CHRON(?:\|UNKNOWN\|CHRON)+(?![^|])", "CHRON")
