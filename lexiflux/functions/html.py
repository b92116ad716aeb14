"""From captured pages to clean text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lexiflux.functions.text import page_word_count
from lexiflux.plans.cluster import ship

# Elements whose content is not prose.
DROP_TAGS = ("script", "style", "noscript", "svg", "nav", "header", "footer", "form", "iframe", "template", "button", "select", "option")
# Parts of a class, id, role or aria-label that mark site furniture.
DROP_MARKS = ("cookie", "consent", "gdpr", "banner", "modal", "popup", "newsletter", "breadcrumb", "site-?nav", "main-?nav", "menu", "skip-?link", "social", "share")
# Patterns of lines that are site furniture.
BOILERPLATE = (
    r"\bcookies?\b", r"\bconsent\b", "privacy (policy|preference|notice|statement)", "accept all",
    "manage (your )?(preferences|settings)", r"\bgdpr\b", "opt[- ]out", "do not sell",
    "all rights reserved", "terms of (use|service)", "site ?map", "skip to (main )?content",
    "sign ?in", "log ?in", "subscribe", "follow us", "back to top", "©", r"\bcopyright\b",
    "javascript", "enable js", "browser (is )?(not )?supported",
    "more options", "by visiting our website", "web domains", "for advertising",
)
MIN_WORDS = 150
_MARK = re.compile("|".join(DROP_MARKS), re.I)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class _Prose(HTMLParser):
    """Text nodes outside dropped elements; an element's end tag closes what was left open inside it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        marked = any(k in ("class", "id", "role", "aria-label") and v and _MARK.search(v) for k, v in attrs)
        if tag not in _VOID:
            self.open.append((tag, tag in DROP_TAGS or marked or bool(self.open and self.open[-1][1])))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][1]) and data.strip():
            self.found.append(data.strip())


def html_text(html: str) -> str:
    """Text nodes of a page, one line each."""
    p = _Prose()
    p.feed(html)
    p.close()
    return "\n".join(p.found)


def page_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text: each page parsed; null pages have null text."""
    ship(pages.sparkSession)
    place = pages.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [None if h is None else html_text(h) for h in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*b.schema.names, "text"])

    return pages.mapInArrow(run, StructType([*pages.schema.fields, StructField("text", StringType())]))


def stripped(html: Column) -> Column:
    """The text of a page by patterns alone: dropped elements, comments and tags go, the commonest entities are read.

    Unlike the parser it ends an element at its first end tag of the same name.
    """
    t = html
    for tag in DROP_TAGS:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "\n")
    t = F.regexp_replace(F.regexp_replace(t, "(?s)<!--.*?-->", "\n"), "(?s)<[^>]*>", "\n")
    for entity, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(c))
    return t


def clean_lines(text: Column) -> Column:
    """Lines without blanks around them, without empty ones and without site furniture."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$", "")))
    return F.filter(lines, lambda x: (x != "") & ~x.rlike("(?i)" + "|".join(BOILERPLATE)))


def without_navigation(pages: DataFrame, key: str, lines: str, most: int = 2, words: int = 4) -> DataFrame:
    """key, text, n_words: from its third occurrence on, in any case of letters, a line of up to four words goes."""
    each = pages.select(key, F.posexplode_outer(lines).alias("pos", "line"))
    again = Window.partitionBy(key, F.lower("line")).orderBy("pos")
    each = each.withColumn("nth", F.row_number().over(again)).where(F.col("line").isNull() | ~((F.col("nth") > most) & (page_word_count(F.col("line")) <= words)))
    # a page is one group, of its own lines
    kept = each.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("pos", "line")))).alias("kept"))
    text = F.array_join(F.transform("kept", lambda x: x["line"]), "\n")
    return kept.select(key, text.alias("text")).withColumn("n_words", page_word_count(F.col("text")))


def min_words(pages: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """pages with too_short: pages of fewer words are reported, not scored."""
    return pages.withColumn("too_short", (F.col("n_words") < least).cast("int"))


def sniffed(content: Column) -> Column:
    """'pdf' or 'html', by a file's first bytes."""
    head = F.ltrim(F.regexp_replace(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), r"^\s+", ""))
    return F.when(head.startswith("%PDF"), "pdf").otherwise("html")
