"""Token counts by trie-shared dynamic programming.

The distinct pre-tokens of a text go into a trie. A node stands for a prefix and stores the best unigram score of any
segmentation of that prefix and the number of pieces in it, both worked out once from its ancestors, so that words with
a common beginning share the work. The count stored at a pre-token's terminal node is what every later occurrence adds.

A trie lives with the Python worker and is bounded: beyond max_nodes it starts afresh, which costs time and changes no
result. Nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lexiflux.llm.common import in_parts, ship, texts

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MAX_NODES = 600_000
#: One word with the space before it, or one white space that stands before no word.
PRETOKEN = re.compile(r" ?\S+|\s")


def piece_scores(path: str = VOCABULARY) -> dict[str, float]:
    """Unigram log-probabilities of a public vocabulary's pieces.

    No public unigram model is at hand, and tokenizers are not trained here. The vocabulary lists its pieces by
    frequency, so their scores follow Zipf's law: -log(rank) - log(H), where H makes the probabilities sum to one.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    norm = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    return {p: -math.log(r) - norm for r, p in enumerate(pieces, 1)}


class Pieces:
    """Which pieces end at a character, given what stands before: states are beginnings of pieces, found as texts need them."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.starts = {p[:i] for p in scores for i in range(len(p) + 1)}
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self.states, self.texts, self.ends, self.steps = {"": 0}, [""], [[]], {}

    def step(self, state: int, c: str) -> int:
        s = self.texts[state] + c
        while s not in self.starts and s:
            s = s[1:]
        to = self.states.get(s)
        if to is None:
            to = self.states[s] = len(self.texts)
            self.texts.append(s)
            self.ends.append([(-n, lp, 1) for n in range(1, len(s) + 1) if (lp := self.scores.get(s[-n:])) is not None])
        if c not in self.scores:  # no piece: one unknown for each of its bytes
            n_bytes = len(c.encode("utf-8", "surrogatepass"))
            if s:
                self.ends[to] = [e for e in self.ends[to] if e[2] == 1] + [(-1, self.unknown * n_bytes, n_bytes)]
            else:
                return -n_bytes
        self.steps[state << 21 | ord(c)] = to
        return to


class Trie:
    """Best scores and piece counts of prefixes. A character that no piece covers costs one unknown per UTF-8 byte."""

    def __init__(self, pieces: Pieces, max_nodes: int = MAX_NODES):
        self.automaton, self.max_nodes = pieces, max_nodes
        self.terminal: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.pieces, self.state = [0.0], [0], [0]

    def count(self, pretoken: str) -> int:
        """The pieces of the best segmentation, from the terminal counts if the pre-token has been inserted."""
        n = self.terminal.get(pretoken)
        if n is None:
            if len(self.terminal) >= 2 * self.max_nodes:
                self.terminal.clear()
            if len(self.best) + len(pretoken) > self.max_nodes:
                self.clear()
            n = self.terminal[pretoken] = self.pieces[self.insert(pretoken)]
        return n

    def insert(self, pretoken: str) -> int:
        """The terminal node; nodes that exist are walked, the others are scored from their ancestors."""
        s = pretoken.replace(" ", "▁")
        child, best, pieces, states = self.child, self.best, self.pieces, self.state
        get, ends, step = self.automaton.steps.get, self.automaton.ends, self.automaton.step
        path, node, depth = [0], 0, 0
        for c in s:
            to = child.get(node << 21 | ord(c))
            if to is None:
                break
            node = to
            path.append(node)
            depth += 1
        state = states[node]
        for c in s[depth:]:
            to = get(state << 21 | ord(c))
            if to is None:
                to = step(state, c)
            if to < 0:  # the empty state after a character that no piece has
                top, n, to = best[node] - to * self.automaton.unknown, pieces[node] - to, 0
            else:
                top, n = -1e300, 0
                for back, lp, k in ends[to]:
                    x = best[path[back]] + lp
                    if x > top:
                        top, n = x, pieces[path[back]] + k
            new = len(best)
            child[node << 21 | ord(c)] = new
            best.append(top)
            pieces.append(n)
            states.append(to)
            node, state = new, to
            path.append(new)
        return node


_TRIES: dict[tuple, Trie] = {}


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, max_nodes: int = MAX_NODES) -> DataFrame:
    """doc_id, n_pretokens, n_tokens: one row per row of documents.

    Null and empty texts have no tokens. Repeated rows and ids are counted each for itself; extra columns are ignored.
    The driver reads the vocabulary and sends its scores, one per piece, to the workers.
    """
    spark = documents.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(piece_scores(vocabulary))
    key = (vocabulary, max_nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _TRIES.get(key) or _TRIES.setdefault(key, Trie(Pieces(sent.value), max_nodes))
        for b in in_parts(batches):
            words, tokens = [], []
            for t in b.column(1):
                found = PRETOKEN.findall(t.as_py())
                try:
                    n = sum(map(trie.terminal.__getitem__, found))
                except KeyError:
                    n = sum(map(trie.count, found))
                words.append(len(found))
                tokens.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    kind = dict(documents.dtypes)["doc_id"]
    return texts(documents).mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long")
