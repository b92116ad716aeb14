"""Text functions as column expressions; all stay in the JVM but Unicode composition, for which Spark has no function."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Units after a number that make it a quantity, as regular expressions.
UNITS = (
    "%", "percent", "pp", "tco2e", "tco2", "co2e", "mtco2e", "ktco2e", "mt", "kt", "tonnes?", "tons?", "kg", "lbs?", "pounds?",
    "mwh", "gwh", "twh", "kwh", "mw", "gw", "kw", "gj", "tj", "mj", "btu", "m3", "m³", "ml", "megalit(?:er|re)s?",
    "lit(?:er|re)s?", "gallons?", "acres?", "hectares?", "km", "miles?", "usd", "eur", "chf", "gbp",
    "million", "billion", "trillion", "thousand", "bn", "mn",
)
# Characters that join two words, beside ASCII white space: hyphen, apostrophes, dashes, ampersand.
JOINERS = "-'‐‑‒–—―’&"

# What counts as a number, a word, a year and a token.
NUMBER = r"\d[\d,]*(?:\.\d+)?"
WORD = r"[a-z][a-z'-]*+"
YEAR = r"\b(?:19|20)\d{2}\b"
TOKEN = "[a-z0-9_]+"
BARRIER = "@"
# Single characters, not ranges: those below 256 are looked up in one table, while each range is a test of its own.
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789_"
_JOINED = r" \t\n\r\f\x0B" + JOINERS.replace("-", r"\-").replace("‐‑‒–—―", "‐-―")
# Any character but the printable ones of ASCII: one look-up turns most characters of a text away.
_ODD = "[^" + re.sub(r"(\W)", r"\\\1", "".join(map(chr, range(33, 127)))) + "]"
SHORT_DOC = 2000


def quantity_pattern(fixed: bool = False) -> str:
    """A number with a unit, or a dollar sign before a number.

    After a unit a word must end, which '%' never does before a blank or a stop: so '45% of' is no quantity. With
    fixed, a percent sign needs nothing after it.
    """
    ends = "(?:" + "|".join(UNITS) + r")\b"
    return rf"\b{NUMBER}\s?(?:{ends}{'|%' if fixed else ''})|\$\s?{NUMBER}"


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition; the one function here that leaves the JVM."""

    @F.pandas_udf("string")
    def composed(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return composed(text)


def normalise(text: Column, composed: bool = True) -> Column:
    """Composed, words rejoined over line ends, straight apostrophes, single blanks, lower case. Null stays null."""
    t = nfkc(text) if composed else text
    # few texts have a hyphen at the end of a line, and to look for that alone is quicker
    t = F.when(t.rlike(r"(?U)-\s*\n"), F.regexp_replace(t, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")).otherwise(t)
    # a single blank stays as it is, so that only what changes is found: longer runs, and those that begin otherwise
    blanks = rf"(?U){_ODD}(?:(?<= )\s++|(?<=[^\S ])\s*+)"
    return F.lower(F.regexp_replace(F.replace(t, F.lit("’"), F.lit("'")), blanks, " "))


def word_count(normal: Column) -> Column:
    """Words never are empty, so that the pieces between them are one more: to count these is quicker than to list the words."""
    return (F.array_size(F.split(normal, WORD)) - 1).cast("long")


def page_word_count(text: Column) -> Column:
    """Words of text that has not been brought to lower case."""
    return F.regexp_count(text, F.lit(r"[A-Za-z][A-Za-z'-]*")).cast("long")


def quantity_count(normal: Column, fixed: bool = False) -> Column:
    # to look for how one may begin is quicker than to try every place for a border of words
    return F.regexp_count(normal, F.lit(rf"(?=[0123456789$])(?:{quantity_pattern(fixed)})")).cast("long")


def year_count(normal: Column) -> Column:
    return F.regexp_count(normal, F.lit(f"(?=[12]){YEAR}")).cast("long")


def tokens(normal: Column) -> Column:
    """Runs of letters, digits and underscores, with one barrier for each gap between two of them that holds anything but joiners.

    A gap is written as a barrier from its first character on that joins nothing; what then divides tokens is no part of
    the array. Nothing that has no end is tried twice, so that a text without letters is linear as well.
    """
    inner = F.regexp_extract(normal, f"(?s)^[^{_LETTERS}]*+(.*[{_LETTERS}])", 1)  # no barrier at either end
    marked = F.regexp_replace(inner, f"(?=[^{_LETTERS} ])[^{_LETTERS}{_JOINED}][^{_LETTERS}]*+", f" {BARRIER} ")
    return F.array_remove(F.split(marked, f"[^{_LETTERS}{BARRIER}]++"), "")


def runs(normal: Column, words: list[str], wildcards: list[str]) -> Column:
    """The stretches of text whose tokens all are among words, or fit one of wildcards, and between which joiners alone stand.

    Each begins with the character before its first token. Loops are possessive: Java does not recurse for them, and a
    stretch may be as long as the text.
    """
    ends = f"(?![{_LETTERS}])"
    known = "|".join([x for x in (_shared(words), *("[a-z0-9]*".join(map(re.escape, w.split("*"))) for w in wildcards)) if x])
    known = f"(?:{known}){ends}"
    return F.regexp_extract_all(F.concat(F.lit(" "), normal), F.lit(f"[^{_LETTERS}]{known}(?:[{_JOINED}]++{known})*+"), F.lit(0))


def _shared(words: list[str]) -> str:
    """A pattern of the words in which equal beginnings stand once, so that a token is read once however many words there are."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        tails = [re.escape(c) + written(n) for c, n in node.items() if c]
        if not tails:
            return ""
        one = len(tails) == 1 and "" not in node
        return tails[0] if one else f"(?:{'|'.join(tails)})" + ("?" if "" in node else "")

    return written(tree)


def per_thousand(hits: Column, words: Column) -> Column:
    """Hits per 1,000 words to three places; 0 where there are no words."""
    return F.when(words > 0, F.round(F.lit(1000.0) * hits / words, 3)).otherwise(F.lit(0.0))


def ratio(hits: Column, substance: Column, places: int) -> Column:
    """Hits per hard number; null where there is none."""
    return F.round(hits.cast("double") / F.nullif(substance, F.lit(0)), places)


def short_doc(words: Column) -> Column:
    return (words < SHORT_DOC).cast("int")


def hex_pairs(pairs: Column) -> Column:
    """'slot:count' in hexadecimal for an array of (slot, n), slots ascending."""
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(F.lower(F.hex(p["slot"])), F.lit(":"), F.lower(F.hex(p["n"])))), ",")


def censored_years(value: Column) -> Column:
    """(years, censored) of '37' or '> 140'; both null where there is neither."""
    digits = F.regexp_extract(value, r"(\d+)", 1)
    years = digits.try_cast("int")
    return F.struct(years.alias("years"), F.when(years.isNotNull(), F.trim(value).startswith(">")).alias("censored"))


def lexicon_key(lexicon: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of a lexicon's joined text."""
    return F.substring(F.sha2(lexicon, 256), 1, 16)
