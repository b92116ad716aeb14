"""Substring dedup by hashing units: lines, cut further where a sentence ends within a line.

Passages are often pasted into the middle of a line, where whole lines find nothing in common; a sentence's end is
therefore a line's end too. A unit of at least min_words words is normalised and digested; the first row, by id and
then by hash of text, that has a digest owns it, and the owner's first occurrence is kept. All others are repeats.

A single short sentence repeats by chance, a passage does not: repeats go, with their offsets in the original text
retained, where a run of them has at least min_run words. Shorter units than min_words are too common to be repeats of
anything; they go where they lie between repeats of one run, and so a passage leaves nothing of itself behind.

Each digest travels once from a document, sums to its owner in tasks first, and then to its owner alone: a line that a
third of all documents share makes one row there. No occurrence is ever joined to its group.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflux.llm.common import in_parts, ship, texts

MIN_WORDS = 5
#: Words that a run of repeats has at least, if it is removed.
MIN_RUN = 15
_END = re.compile(r"\n|(?<=[.!?])[ \t]+")


def units(text: str) -> list[tuple[int, int]]:
    """Start and end of each unit, in code points; a unit holds the white space that ends it, and units fill the text."""
    ends = [m.end() for m in _END.finditer(text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return list(zip([0, *ends], ends))


def digest(unit: str, min_words: int = MIN_WORDS) -> tuple[int, tuple[int, int] | None]:
    """Words of a unit, and 128 bits of it in lower case with single spaces; None for a unit of fewer words than min_words."""
    words = unit.lower().encode("utf-8", "surrogatepass").split()
    bits = struct.unpack("<qq", hashlib.md5(b" ".join(words), usedforsecurity=False).digest()) if len(words) >= min_words else None
    return len(words), bits


def _owners(documents: DataFrame, min_words: int) -> DataFrame:
    """doc_id, hash, own: the first halves of the digests that the rows of this id and hash of text own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            ends, one, two = [0], [], []
            for t in b.column(1):
                t = t.as_py()
                for d in {d for s, e in units(t) if (d := digest(t[s:e], min_words)[1])}:
                    one.append(d[0])
                    two.append(d[1])
                ends.append(len(one))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.ListArray.from_arrays(ends, pa.array(one, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(two, pa.int64()))], ["doc_id", "hash", "a", "b"])

    hashed = texts(documents).withColumn("hash", F.xxhash64("text"))
    found = hashed.mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, hash long, a array<long>, b array<long>")
    each = found.select("doc_id", "hash", F.explode(F.arrays_zip("a", "b")).alias("d")).select("doc_id", "hash", "d.a", "d.b")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "hash")).alias("owner")
    return each.groupBy("a", "b").agg(first).groupBy("owner.doc_id", "owner.hash").agg(F.collect_list("a").alias("own"))


def _with_own(documents: DataFrame, min_words: int) -> DataFrame:
    """documents, all columns, with __lexiflux_own."""
    owners = _owners(documents, min_words).select(F.col("doc_id").alias("__lexiflux_id"), F.col("hash").alias("__lexiflux_hash"), F.col("own").alias("__lexiflux_own"))
    hashed = documents.withColumn("__lexiflux_text", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = hashed["doc_id"].eqNullSafe(owners["__lexiflux_id"]) & (hashed["__lexiflux_text"] == owners["__lexiflux_hash"])
    return hashed.join(owners, same, "left").select(*(hashed[c] for c in documents.columns), "__lexiflux_own")


def dedup_units(documents: DataFrame, min_words: int = MIN_WORDS, min_run: int = MIN_RUN) -> DataFrame:
    """doc_id, text, n_units, n_removed, removed (spans of the original text) for each row of documents; text is what is left.

    Units rank by doc_id (null ids last), then by hash of the text, then by place. Rows equal in id and text count as one
    document: each keeps the first occurrence of what they own. Null texts count as empty and stay so; a text of which
    nothing is left is empty, its row stays. Extra columns are ignored. An empty table gives no rows.
    """
    ship(documents.sparkSession)
    rows = _with_own(texts(documents), min_words)
    kind = dict(documents.dtypes)["doc_id"]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            left, n, gone, spans = [], [], [], []
            for t, own in zip(b.column(1), b.column(2), strict=True):
                t, own = t.as_py(), set(own.as_py() or ())
                kept, out = _sift(t, own, min_words, min_run)
                left.append("".join(t[s:e] for s, e in kept))
                n.append(len(kept) + len(out))
                gone.append(len(out))
                spans.append([{"start": s, "end": e} for s, e in out])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(left, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(span))], ["doc_id", "text", "n_units", "n_removed", "removed"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string, n_units long, n_removed long, removed array<struct<start: long, end: long>>")


def _sift(text: str, own: set[int], min_words: int, min_run: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans of a text that stay and spans that go, given what its document owns; own loses what is met."""
    kept: list[tuple[int, int]] = []
    gone: list[tuple[int, int]] = []
    run: list[tuple[int, int]] = []  # from a repeat on, up to what breaks the run
    upto, words, upto_words = 0, 0, 0  # the run's units and words up to its last repeat, and all its words

    def close() -> None:
        nonlocal run, upto, words, upto_words
        if upto_words >= min_run:
            gone.extend(run[:upto])
            kept.extend(run[upto:])
        else:
            kept.extend(run)
        run, upto, words, upto_words = [], 0, 0, 0

    for s, e in units(text):
        n, d = digest(text[s:e], min_words)
        if d is not None and d[0] not in own:
            run.append((s, e))
            words += n
            upto, upto_words = len(run), words
        elif d is None and run:
            run.append((s, e))
            words += n
        else:
            own.discard(d and d[0])
            close()
            kept.append((s, e))
    close()
    return kept, gone


def clean(documents: DataFrame, min_words: int = MIN_WORDS, min_run: int = MIN_RUN) -> DataFrame:
    """The rows of documents, with all their columns, after removal; n_chars, where it is a column, is that of the text left.

    Null texts stay null. Ranks, repeated rows and null ids are as in dedup_units; an empty table stays empty.
    """
    ship(documents.sparkSession)
    rows = _with_own(documents, min_words)
    place, last = documents.columns.index("text"), len(documents.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            out = []
            for t, own in zip(b.column(place), b.column(last), strict=True):
                t = t.as_py()
                out.append(None if t is None else "".join(t[s:e] for s, e in _sift(t, set(own.as_py() or ()), min_words, min_run)[0]))
            columns = [pa.array(out, pa.string()) if i == place else b.column(i) for i in range(last)]
            yield pa.RecordBatch.from_arrays(columns, documents_columns)

    documents_columns = documents.columns
    out = rows.mapInArrow(run, documents.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(documents.dtypes)["n_chars"])) if "n_chars" in documents.columns else out


ORACLE = r"""
WITH cut AS (
  SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?][ \t]+|\n)', '\1' || chr(1), 'g'), chr(1))) AS unit,
         generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '([.!?][ \t]+|\n)', '\1' || chr(1), 'g'), chr(1)), 1) AS pos FROM documents),
normal AS (
  SELECT doc_id, pos, unit, trim(regexp_replace(lower(unit), '[ \t\n\r\f\v]+', ' ', 'g')) AS norm FROM cut WHERE unit <> ''),
ranked AS (
  SELECT *, CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END AS n_words, row_number() OVER (PARTITION BY norm ORDER BY doc_id, pos) AS k,
         sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM normal),
told AS (SELECT *, n_words >= 5 AND k > 1 AS again, n_words >= 5 AND k = 1 AS breaks FROM ranked),
grouped AS (SELECT *, sum(CAST(breaks AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM told),
ended AS (SELECT *, min(pos) FILTER (again) OVER w AS first, max(pos) FILTER (again) OVER w AS last FROM grouped WINDOW w AS (PARTITION BY doc_id, run)),
summed_run AS (SELECT *, sum(n_words) FILTER (pos BETWEEN first AND last) OVER (PARTITION BY doc_id, run) AS run_words FROM ended),
judged AS (SELECT *, coalesce(pos BETWEEN first AND last AND run_words >= 15, false) AS gone FROM summed_run),
summed AS (
  SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(CAST(upto - length(unit) AS BIGINT) || '-' || CAST(upto AS BIGINT), ',' ORDER BY pos) FILTER (gone), '') AS removed,
         coalesce(string_agg(unit, '' ORDER BY pos) FILTER (NOT gone), '') AS text FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.text, '') AS text, coalesce(s.n_units, 0) AS n_units, coalesce(s.n_removed, 0) AS n_removed, coalesce(s.removed, '') AS removed
FROM documents d LEFT JOIN summed s USING (doc_id)
"""
