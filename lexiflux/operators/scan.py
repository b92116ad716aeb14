"""A second way to find terms, which shares nothing with the token stream: regular expressions over normalised text.

It is slow, and is there to check the other. Commas in patterns count here, letters beyond ASCII belong to words, and a
pattern may be any regular expression. Spans are of characters; overlaps are resolved like those of tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflux.operators.lexicon import PatternError, Term, parser
from lexiflux.operators.tally import COUNTS, as_counts
from lexiflux.plans.cluster import ship


def finders(terms: list[Term]) -> list[re.Pattern]:
    """A pattern between word borders for each term, in the terms' order."""
    out = []
    for t in terms:
        try:
            out.append(re.compile(rf"\b(?:{t.pattern})\b"))
        except re.error as e:
            raise PatternError(f"{t.label}: {e}") from e
    return out


def _joined(patterns: list[re.Pattern]) -> tuple[re.Pattern | None, list[int]]:
    """A pattern that matches wherever one of several terms stands, so that a text is searched once for all of them, and these terms.

    Terms with groups, flags or an empty match are left out: they have another meaning in a larger pattern, or begin
    twice in one place.
    """
    plain = [i for i, p in enumerate(patterns) if not p.groups and p.flags == re.UNICODE and parser.parse(p.pattern).getwidth()[0] > 0]
    return (re.compile(r"(?=" + "|".join(f"(?:{patterns[i].pattern})" for i in plain) + ")") if plain else None), plain


def _found(text: str, patterns: list[re.Pattern], joined: tuple[re.Pattern | None, list[int]]) -> Iterator[tuple[int, int, int]]:
    """(start, end, term) of each term's own matches, which may overlap those of other terms."""
    anywhere, plain = joined
    if anywhere:
        upto = dict.fromkeys(plain, 0)
        for at in anywhere.finditer(text):
            start = at.start()
            for term in plain:
                if upto[term] <= start and (m := patterns[term].match(text, start)):
                    upto[term] = m.end()
                    yield start, m.end(), term
    for term, p in enumerate(patterns):
        if term not in plain:
            for m in p.finditer(text):
                if m.end() > m.start():
                    yield m.start(), m.end(), term


def scanned_spans(docs: DataFrame, terms: list[Term]) -> DataFrame:
    """doc_id, start, end, len, term_id over docs (doc_id, norm); a null text has none. Which of overlapping spans counts is for overlap.resolve to say."""
    ship(docs.sparkSession)
    patterns = finders(terms)
    joined = _joined(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, spans = [], []
            for i, t in enumerate(b.column(1)):
                for start, end, term in _found(t.as_py() or "", patterns, joined):
                    rows.append(i)
                    spans.append((start, end, end - start, term))
            columns = zip(*spans, strict=True) if spans else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int32()) for x in columns)], ["doc_id", "start", "end", "len", "term_id"])

    return docs.select("doc_id", "norm").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, start int, end int, len int, term_id int")


def scanned_counts(spark: SparkSession, normal: Column, terms: list[Term]) -> Column:
    """term_id and n of the scanned terms that resolution keeps, as tally.tally has them; overlaps are resolved where a text is scanned."""
    ship(spark)
    patterns = finders(terms)
    joined = _joined(patterns)

    @F.arrow_udf(COUNTS)
    def counted(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            n: dict[int, int] = {}
            upto = 0
            for start, end, term in sorted(_found(t.as_py() or "", patterns, joined), key=lambda s: (s[0], -s[1], s[2])):
                if start >= upto:
                    upto = end
                    n[term] = n.get(term, 0) + 1
            rows.append(n)
        return as_counts(rows)

    return counted(normal)


def agreement(indexed: DataFrame, scanned: DataFrame) -> DataFrame:
    """doc_id, n_indexed, n_scanned: hits of a document by either way, from counts (doc_id, term_id, n) of both."""
    total = lambda df, name: df.groupBy("doc_id").agg(F.sum("n").alias(name))
    both = total(indexed, "n_indexed").join(total(scanned, "n_scanned"), "doc_id", "full")
    return both.fillna(0, ["n_indexed", "n_scanned"])
