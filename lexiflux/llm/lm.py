"""LM scoring: a log-bilinear model of word sequences, trained in numpy by noise-contrastive estimation.

Symbols are the end of a text, the commonest words, and classes of all other words. The score of a symbol after two
others is bilinear: (r1[w1] + r2[w2]) . q[w] + b[w]. Because it is a sum of two terms, the normaliser of every pair of
context symbols is one product of two matrices, and a normalised log-probability is a product of two vectors and one look-up. A
word of a class has the class's probability times its own share in the class, smoothed like the base model.

Every training text takes part: word counts are exact over the corpus, and each task trains on its own texts from a
common start, after which parameters are averaged by weight of positions, symbol by symbol, in a shuffle. Counts of the
HEAD commonest words are sent to the workers, a bounded table; all other words are joined to their counts.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflux.llm.common import ship, stored, texts

#: Symbols at most, of which so many are classes of rarer words; a word's class is the CRC of its first bytes. Symbols
#: grow with the vocabulary up to there: each worker holds a table of their pairs, 64 MB, and another while it is made.
SYMBOLS, CLASSES, CLASS_BYTES = 4096, 128, 3
HEAD = 200_000
DIMENSION, NOISE, BATCH, RATE = 24, 128, 1024, 0.2
#: Distinct words that a task counts before it passes them on.
FLUSH = 500_000
#: Symbols whose parameters travel together and whose pairs are normalised at once, and tasks whose parameters are averaged at once.
BLOCK, GROUP = 256, 64
#: Texts that are cut into words at once.
SLICE = 500
#: Tokens whose vectors are gathered at once.
STEP = 8192
END = 0


def words_of(text: str) -> list[bytes]:
    """Tokens without the end: A-Z in lower case, cut at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_counts(training: DataFrame) -> DataFrame:
    """word, c over all texts of training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "c"])
            counts.clear()
            return b

        for b in batches:
            for t in b.column(0):
                counts.update(words_of(t.as_py()))
                if len(counts) >= FLUSH:
                    yield out()
        yield out()

    return training.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What the workers know of the training counts."""

    words: list[bytes]  # the commonest first
    counts: np.ndarray
    n_texts: int
    n_tokens: int  # with ends
    n_distinct: int  # with the end
    class_tokens: np.ndarray
    class_words: np.ndarray
    symbols: int = SYMBOLS
    classes: int = CLASSES
    index: dict[bytes, int] = field(default_factory=dict, repr=False)

    @property
    def short(self) -> int:
        return min(len(self.words), self.symbols - self.classes - 1)

    def ready(self) -> Vocabulary:
        """With the tables that look-ups need; built where they are used."""
        if not self.index:
            self.index = {w: i for i, w in enumerate(self.words)}
            n, k = len(self.words), self.short
            self.symbol = np.concatenate([np.arange(1, k + 1), [self.class_of(w) for w in self.words[k:]], [0]]).astype(np.int32)
            self.log_count = np.append(np.log10(self.counts + 1.0), 0.0)
            self.in_class = np.append(np.arange(n) >= k, True)
        return self

    def class_of(self, word: bytes) -> int:
        return 1 + self.short + zlib.crc32(word[:CLASS_BYTES]) % self.classes

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Places among the head's words (the last place for others), symbols, and the other words."""
        get, none = self.index.get, len(self.words)
        place = np.fromiter(map(get, words, repeat(none)), np.int32, len(words))
        symbol = self.symbol[place]
        rare = np.flatnonzero(place == none)
        tail = [words[i] for i in rare]
        symbol[rare] = [self.class_of(w) for w in tail]
        return place, symbol, tail

    def unigram(self) -> np.ndarray:
        n = np.concatenate([[self.n_texts], self.counts[: self.short], self.class_tokens]) + 1.0
        return n / n.sum()


def vocabulary(counts: DataFrame, n_texts: int, head: int = HEAD, symbols: int = SYMBOLS, classes: int = CLASSES) -> Vocabulary:
    """From a stored table of counts; at most head words and one row per class reach the driver.

    The head are the words over the least count that at most head words exceed: a histogram of counts finds it.
    """
    often = counts.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    upto = often.withColumn("n", F.sum("n").over(Window.orderBy(F.col("c").desc())))  # one row for each different count
    least = upto.where(F.col("n") <= head).agg(F.min("c")).first()[0]
    rows = counts.where(F.col("c") >= least).collect() if least is not None else []
    rows = sorted((-r["c"], bytes(r["word"])) for r in rows)
    words, c = [w for _, w in rows], np.array([-k for k, _ in rows], np.int64)
    by = counts.groupBy((F.crc32(F.substring("word", 1, CLASS_BYTES)) % classes).alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    n, v = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    for r in by:
        n[r["k"]], v[r["k"]] = r["n"], r["v"]
    out = Vocabulary(words, c, n_texts, int(n.sum()) + n_texts, int(v.sum()) + (n_texts > 0), n, v, symbols, classes)
    for w, k in zip(words[: out.short], c, strict=False):
        i = zlib.crc32(w[:CLASS_BYTES]) % classes
        n[i] -= k
        v[i] -= 1
    return out


class Noise:
    """Draws noise by a distribution over symbols; what a step needs of it is made once."""

    def __init__(self, p: np.ndarray):
        self.p = p
        self.upto = np.cumsum(p)
        self.upto /= self.upto[-1]
        self.log = np.log(NOISE * p).astype(np.float32)

    def sample(self, rng: np.random.Generator) -> np.ndarray:
        return np.searchsorted(self.upto, rng.random(NOISE), side="right")


def _share(z: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-z)), in place; z far below 0 gives 0."""
    np.negative(z, out=z)
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
    z += 1
    return np.reciprocal(z, out=z)


def _runs(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ones among symbols under n, an order that brings equal ones together, and where each begins in it."""
    order = np.argsort(at.astype(np.min_scalar_type(n)), kind="stable")
    own = at[order]
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return own[starts], order, starts


@dataclass
class LogBilinear:
    r1: np.ndarray
    r2: np.ndarray
    q: np.ndarray
    b: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)
    drawn: Noise | None = field(default=None, repr=False)

    @classmethod
    def start(cls, unigram: np.ndarray, dimension: int = DIMENSION) -> LogBilinear:
        """The unigram model in single precision, with small vectors that are the same everywhere."""
        rng = np.random.default_rng(0)
        n = len(unigram)
        return cls(*(rng.normal(0, 0.1, (n, dimension)).astype(np.float32) for _ in range(3)), np.log(unigram).astype(np.float32))

    def train(self, c2: np.ndarray, c1: np.ndarray, target: np.ndarray, noise: np.ndarray, rng: np.random.Generator, grown: list[np.ndarray], rate: float = RATE) -> None:
        """One step of noise-contrastive estimation with AdaGrad. c1 stands before the target, c2 before c1; the batch shares its noise."""
        if self.drawn is None or self.drawn.p is not noise:
            self.drawn = Noise(noise)
        sampled, log_noise = self.drawn.sample(rng), self.drawn.log
        h = self.r1[c1] + self.r2[c2]
        qt, qs = self.q[target], self.q[sampled]
        up = _share(log_noise[target] - np.einsum("ij,ij->i", h, qt) - self.b[target])  # 1 - P(data)
        down = h @ qs.T  # P(data) of noise, in place: the largest array of a step
        down += self.b[sampled] - log_noise[sampled]
        down = _share(down)
        gh = up[:, None] * qt
        gh -= down @ qs

        def step(p: np.ndarray, a: np.ndarray, on: np.ndarray, g: np.ndarray) -> None:
            ahead = a[on] + g * g
            a[on] = ahead
            p[on] += rate * g / np.sqrt(ahead + 1e-8)

        for p, a, c in ((self.r1, grown[0], c1), (self.r2, grown[1], c2)):
            on, order, starts = _runs(c, len(p))
            step(p, a, on, np.add.reduceat(gh[order], starts))
        on, order, starts = _runs(np.concatenate([target, sampled]), len(self.q))
        step(self.q, grown[2], on, np.add.reduceat(np.concatenate([up[:, None] * h, -(down.T @ h)])[order], starts))
        step(self.b, grown[3], on, np.add.reduceat(np.concatenate([up, -down.sum(0)])[order], starts))

    def logits(self, c2: np.ndarray, c1: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The score of each target after its context, so many at once that what is gathered for them stays small."""
        out = np.empty(len(target))
        for i in range(0, len(target), STEP):
            k = slice(i, i + STEP)
            out[k] = np.einsum("ij,ij->i", self.r1[c1[k]] + self.r2[c2[k]], self.q[target[k]]) + self.b[target[k]]
        return out

    def normalisers(self) -> np.ndarray:
        """Log-normalisers of all pairs of context symbols (last, last but one): one table, and another while it is made."""
        n = len(self.b)
        e2, m2, z = np.empty((n, n), np.float32), np.empty(n), np.empty((n, n), np.float32)
        blocks = [slice(i, i + BLOCK) for i in range(0, n, BLOCK)]
        for k in blocks:
            s2 = self.r2[k] @ self.q.T
            m2[k] = s2.max(1)
            e2[k] = np.exp(s2 - m2[k, None])
        for k in blocks:
            s1 = self.r1[k] @ self.q.T + self.b
            m1 = s1.max(1)
            z[k] = np.log(np.maximum(np.exp(s1 - m1[:, None]).astype(np.float32) @ e2.T, 1e-37)) + m1[:, None] + m2
        return z

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all symbols: scores after the last and after the last but one, and normalisers; for vocabularies that are small."""
        return self.r1 @ self.q.T + self.b, self.r2 @ self.q.T, self.normalisers()


def contexts(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a run of texts, each closed by END at index ends: the symbols one and two places before, END before a text's first."""
    c1, c2 = np.empty_like(symbols), np.empty_like(symbols)
    c1[0], c1[1:] = END, symbols[:-1]
    c2[:2], c2[2:] = END, symbols[:-2]
    c2[ends[:-1] + 1] = END  # of a first token; two places before a second one there is an end already
    return c2, c1


def _joined(vocab: Vocabulary, ts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]], np.ndarray]:
    """Places, symbols, other words by text, and indices of ends of a run of texts."""
    places, symbols, tails, size = [], [], [], []
    none = len(vocab.words)
    for t in ts:
        p, s, tail = vocab.encode(words_of(t))
        places += [p, [none]]
        symbols += [s, [END]]
        tails.append(tail)
        size.append(len(p) + 1)
    return np.concatenate(places).astype(np.int64), np.concatenate(symbols).astype(np.int64), tails, np.cumsum(size) - 1


def train(training: DataFrame, vocab: Vocabulary, dimension: int = DIMENSION) -> LogBilinear:
    """Parameters averaged over tasks, each of which trains on all its texts; one row per block of symbols reaches the driver.

    The same split of the texts into tasks gives the same parameters; another split gives others, of much the same quality.
    """
    start = LogBilinear.start(vocab.unigram(), dimension)
    sent = training.sparkSession.sparkContext.broadcast((vocab, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, start = sent.value
        vocab.ready()
        model = LogBilinear(*(x.copy() for x in (start.r1, start.r2, start.q, start.b)))
        noise, grown = vocab.unigram(), [np.zeros_like(x) for x in (model.r1, model.r2, model.q, model.b)]
        rng, seen = np.random.default_rng(1), 0
        for t in (b.column(0).slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            ts = t.to_pylist()
            _, symbols, _, ends = _joined(vocab, ts)
            c2, c1 = contexts(symbols, ends)
            at = rng.permutation(len(symbols))
            for i in range(0, len(at), BATCH):
                part = at[i : i + BATCH]
                model.train(c2[part], c1[part], symbols[part], noise, rng, grown)
            seen += len(at)
        if seen:
            rows = np.concatenate([model.r1, model.r2, model.q, model.b[:, None]], 1)
            parts = [rows[i : i + BLOCK].ravel() for i in range(0, len(rows), BLOCK)]
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(rows.ravel())), pa.array([float(seen)] * len(parts))], ["block", "v", "n"])

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("task")  # sums of one order, whatever the shuffle's
        v = np.average(np.stack(pdf.v.to_numpy()), axis=0, weights=pdf.n)
        return pd.DataFrame({"block": [pdf.block.iloc[0]], "v": [v], "n": [pdf.n.sum()], "task": [pdf.task.iloc[0] // GROUP]})

    parts = training.select("text").mapInArrow(run, "block long, v array<float>, n double")
    # a block of symbols has one row from each task; tasks meet in groups of GROUP, and these in groups again
    schema = "block long, v array<double>, n double, task long"
    parts = parts.withColumn("task", F.spark_partition_id().cast("long"))
    for _ in range(2):
        parts = parts.groupBy("block", F.floor(F.col("task") / GROUP)).applyInPandas(average, schema)
    rows = sorted(parts.groupBy("block").applyInPandas(average, schema).collect())
    if not rows:
        return start
    d = dimension
    v = np.concatenate([np.array(r["v"]).reshape(-1, 3 * d + 1) for r in rows])
    return LogBilinear(v[:, :d], v[:, d : 2 * d], v[:, 2 * d : 3 * d], v[:, 3 * d])


_KEPT: dict[str, np.ndarray] = {}


def _normalisers_of(model: LogBilinear) -> np.ndarray:
    """A worker keeps the normalisers of the model it used last."""
    if model.key not in _KEPT:
        _KEPT.clear()
        _KEPT[model.key] = model.normalisers()
    return _KEPT[model.key]


def score_texts(ts: list[str], vocab: Vocabulary, model: LogBilinear) -> tuple[list, ...]:
    """For each text: tokens, known tokens and sum of log10(c + 1) among head and end, model's log10 but for the counts of other words, those words."""
    vocab.ready()
    z = _normalisers_of(model)
    places, symbols, tails, ends = _joined(vocab, ts)
    c2, c1 = contexts(symbols, ends)
    logp = (model.logits(c2, c1, symbols) - z[c1, c2]) / np.log(10)
    is_end = np.zeros(len(symbols), bool)
    is_end[ends] = True
    within = vocab.in_class[places] & ~is_end
    share = np.log10(vocab.class_tokens + vocab.class_words + 1.0)
    log_count = vocab.log_count[places]
    logp[within] += log_count[within] - share[symbols[within] - 1 - vocab.short]
    base = np.where(is_end, np.log10(vocab.n_texts + 1.0), log_count)
    known = np.where(is_end, vocab.n_texts > 0, places < len(vocab.words))
    first = np.concatenate([[0], ends[:-1] + 1])
    return np.diff(ends, prepend=-1), np.add.reduceat(known.astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(logp, first), tails


def lm_scores(documents: DataFrame, held_out: Column, head: int = HEAD, symbols: int = SYMBOLS, classes: int = CLASSES, dimension: int = DIMENSION) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of documents.

    held_out is a condition on doc_id: such rows are scored and not learnt from. Null and empty texts are one token, the
    end. Repeated rows count and are scored each for itself. With nothing to learn from, every count is 0. Extra
    columns are ignored.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = texts(documents).withColumn("held_out", held_out)
    training = docs.where(~F.col("held_out"))
    counts = stored(word_counts(training))
    vocab = vocabulary(counts, training.count(), head, symbols, classes)
    model = train(training, vocab, dimension)
    sent = spark.sparkContext.broadcast((vocab, model))
    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, part double, tail array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model = sent.value
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                n, known, base, logp, tails = score_texts([t.as_py() for t in part.column(1)], vocab, model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(logp), pa.array(tails, pa.list_(pa.binary()))], ["doc_id", "held_out", "n_tokens", "known", "base", "part", "tail"])

    rows = stored(docs.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()))
    # the stored row numbers are fixed; a word without a count adds nothing, so the join may be inner
    tail = rows.select("_row", F.explode("tail").alias("word")).join(counts, "word").groupBy("_row").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("_log"), F.count(F.lit(1)).alias("_n"))
    rows = rows.drop("tail").join(tail, "_row", "left")
    log, n = F.coalesce("_log", F.lit(0.0)), F.coalesce("_n", F.lit(0))
    return rows.select("doc_id", "held_out", "n_tokens", (F.col("known") + n).alias("n_known"), F.lit(vocab.n_tokens).cast("long").alias("train_tokens"),
                       (F.col("base") + log - F.col("n_tokens") * float(np.log10(vocab.n_tokens + vocab.n_distinct + 1))).alias("base_score"), (F.col("part") + log).alias("score"))
