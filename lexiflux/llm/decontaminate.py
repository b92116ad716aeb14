"""Benchmark decontamination by pigeonhole edit matching.

A test item of m words may differ from a passage by e edits of words. Cut into e + 1 pieces, at least one piece must
then occur in the passage unchanged. An automaton finds all pieces of a block of items in one pass over a text; around
each hit, Myers' bit-parallel algorithm, with words as symbols, finds the least edit distance between the whole item and
any passage there.

Items are few and texts many: the items are the stated query set, taken in blocks of bounded size, each of which is
sent to all tasks. Texts are not shuffled.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflux.llm.common import in_parts, ship, texts

#: Edits of words allowed for each word of an item, rounded down.
BUDGET = 0.2
#: Characters of items in one block; a longer benchmark takes several passes over the texts.
BLOCK_CHARS = 16_000_000
_WORD = re.compile(r"\w+")


def normal(text: str | None) -> str:
    """Words in lower case with one space before and after each."""
    return " " + " ".join(_WORD.findall((text or "").lower())) + " "


def pieces(words: list[str], budget: float = BUDGET) -> list[tuple[int, list[str]]]:
    """Offset and words of e + 1 pieces of nearly equal length, for e edits."""
    n = int(budget * len(words)) + 1
    cuts = [len(words) * i // n for i in range(n + 1)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """Least edit distance of the pattern to any run of the text, and the end of the first such run."""
    m = len(pattern)
    at: dict[str, int] = {}
    for i, w in enumerate(pattern):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, d = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text, 1):
        eq = at.get(w, 0)
        x = eq | down
        h = (((eq & up) + up) ^ up) | eq
        plus, minus = (down | ~(h | up)) & full, up & h
        if plus & top:
            d += 1
        elif minus & top:
            d -= 1
        plus = (plus << 1) & full  # a run may begin anywhere: nothing is carried in
        minus = (minus << 1) & full
        up, down = (minus | ~(x | plus)) & full, plus & x
        if d < best:
            best, end = d, j
    return best, end


class Block:
    """An automaton over the pieces of some items: (item_id, words)."""

    def __init__(self, items: list[tuple[int, list[str]]], budget: float = BUDGET):
        import ahocorasick

        self.items = items
        self.limit = [int(budget * len(words)) for _, words in items]
        of: dict[str, list[tuple[int, int]]] = {}
        for n, (_, words) in enumerate(items):
            for offset, piece in pieces(words, budget):
                of.setdefault(" " + " ".join(piece) + " ", []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for s, places in of.items():
            self.automaton.add_word(s, (len(s), places))
        if of:
            self.automaton.make_automaton()
        self.some = bool(of)

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(place of the item in the block, distance, word of the text at which the passage ends) for each item within its limit."""
        s = normal(text)
        found = list(self.automaton.iter(s)) if self.some else []
        if not found:
            return []
        words = s.split()
        starts, at = [], 0
        for w in words:
            starts.append(at)
            at += len(w) + 1
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (size, places) in found:
            p = bisect_left(starts, end + 1 - size)
            for n, offset in places:
                e, m = self.limit[n], len(self.items[n][1])
                lo, hi = max(0, p - offset - e), min(len(words), p - offset + m + e)
                own = windows.setdefault(n, [])
                if own and lo <= own[-1][1]:  # hits come in order, so windows that meet are one
                    own[-1] = (min(own[-1][0], lo), max(own[-1][1], hi))
                else:
                    own.append((lo, hi))
        out = []
        for n, own in windows.items():
            d, end = min((d, lo + end) for lo, hi in own for d, end in [myers(self.items[n][1], words[lo:hi])])
            if d <= self.limit[n]:
                out.append((n, d, end))
        return out


_BLOCKS: dict[str, Block] = {}


def _block_of(key: str, items: list[tuple[int, list[str]]], budget: float) -> Block:
    """The automaton of a block, which key names; a worker builds it once and keeps the last."""
    if key not in _BLOCKS:
        _BLOCKS.clear()
        _BLOCKS[key] = Block(items, budget)
    return _BLOCKS[key]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, list[str]]]]:
    block, size = [], 0
    for r in benchmark.select("item_id", "text").orderBy(F.col("item_id").asc_nulls_last(), "text").toLocalIterator():
        words = normal(r["text"]).split()
        if words:
            block.append((r["item_id"], words))
            size += sum(map(len, words))
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(documents: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """doc_id, item_id, distance, n_item_words, end_word: each row of documents with each item of which it holds a passage.

    A passage is a run of words at most floor(budget * words of the item) edits of words away from the whole item, in
    lower case and without punctuation; end_word is the text's word after the best one, the first of equals. Null and
    empty texts hold nothing, items without words match nothing. Repeated rows give repeated results, items of equal id
    one each, with the length of their own. Extra columns are ignored.
    """
    spark = documents.sparkSession
    ship(spark)
    kinds = dict(documents.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, distance long, n_item_words long, end_word long"
    out = None
    for items in _blocks(benchmark):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            block = _block_of(key, sent.value, budget)
            for b in in_parts(batches):
                rows, found = [], []
                for i, t in enumerate(b.column(1)):
                    for n, d, end in block.matches(t.as_py()):
                        item, words = block.items[n]
                        rows.append(i)
                        found.append((item, d, len(words), end))
                item, d, m, end = zip(*found, strict=True) if found else [()] * 4
                item_type = pa.int64() if kinds[1] == "bigint" else pa.int32() if kinds[1] == "int" else pa.string()
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(item, item_type), *(pa.array(x, pa.int64()) for x in (d, m, end))], ["doc_id", "item_id", "distance", "n_item_words", "end_word"])

        part = texts(documents).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(documents: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The rows of documents, with all their columns, that hold no item's passage; nothing is shuffled.

    Null and empty texts hold nothing and stay; repeated rows are judged each for itself; an item without words is no
    passage, so an empty benchmark keeps all rows.
    """
    ship(documents.sparkSession)
    place = documents.columns.index("text")
    for items in _blocks(benchmark):
        sent = documents.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            block = _block_of(key, sent.value, budget)
            for b in in_parts(batches):
                yield b.filter(pa.array([not block.matches(t.as_py() or "") for t in b.column(place)], pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
