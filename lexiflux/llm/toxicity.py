"""Toxicity: a logistic classifier with counterfactual regularisation.

Features are the words of a text and their beginnings, each counted as present or not. Where a labelled sentence names
a group or a person by gender, its identity term is swapped for the others of its set, and training penalises the
squared change of the score, so that a mere mention carries no weight. Scores are sums over features, so that the
change of a swap is that of the few features that it takes away or brings; equal swaps are counted, not kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflux.llm.common import in_parts, one_label, ship, texts

#: Identity terms that may replace one another, in English, German, French and Spanish. Fixed values; callers may give other sets.
IDENTITY_SETS = (
    ("he", "she"), ("him", "her"), ("himself", "herself"),
    ("men", "women", "boys", "girls"),
    ("man", "woman", "boy", "girl"),
    ("male", "female", "transgender"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("black", "white", "asian", "latino", "arab"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("old", "young", "elderly"),
    ("blind", "deaf", "disabled"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("er", "sie"), ("ihm", "ihr"), ("mann", "frau", "junge", "mädchen"), ("männer", "frauen", "jungen"),
    ("schwul", "lesbisch", "bisexuell"), ("schwarz", "weiß", "asiatisch"),
    ("christ", "moslem", "jude", "hindu"), ("christen", "muslime", "juden", "hindus"),
    ("flüchtling", "ausländer", "einheimischer"), ("flüchtlinge", "einwanderer", "ausländer", "einheimische"),
    ("il", "elle"), ("lui", "elle"), ("homme", "femme", "garçon", "fille"), ("hommes", "femmes", "garçons", "filles"),
    ("gai", "lesbienne", "bisexuel"), ("noir", "blanc", "asiatique", "arabe"),
    ("chrétien", "musulman", "juif", "hindou"), ("chrétiens", "musulmans", "juifs", "hindous"),
    ("immigré", "réfugié", "étranger"), ("immigrés", "réfugiés", "étrangers"),
    ("él", "ella"), ("hombre", "mujer", "chico", "chica"), ("hombres", "mujeres", "chicos", "chicas"),
    ("gay", "lesbiana", "bisexual"), ("negro", "blanco", "asiático", "árabe"),
    ("cristiano", "musulmán", "judío", "hindú"), ("cristianos", "musulmanes", "judíos", "hindúes"),
    ("inmigrante", "refugiado", "extranjero"), ("inmigrantes", "refugiados", "extranjeros"),
)
#: At most so many labelled rows of each class are learnt from, those with the smallest hash of their id.
MAX_ROWS = 4000
#: Least gains in log-likelihood of a feature that is used, of which rows held out of the training rows choose one: less
#: may be chance. One row in FOLDS is held out for it.
GAINS, FOLDS = (3.0, 4.5, 6.0), 5
STEMS = (4, 5, 6, 7)
#: Different words whose features a task remembers before it forgets them all.
CACHE = 100_000
THRESHOLD = 0.3
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def features_of(word: str) -> list[str]:
    """The word itself and its beginnings, which are marked."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


def counterfactuals(text: str, sets: tuple = IDENTITY_SETS) -> Counter:
    """How often a swap takes some features from a sentence and brings others: ((taken), (brought)), both in order.

    Every identity term of every sentence is swapped for each other term of its sets.
    """
    of: dict[str, set[str]] = {}
    for s in sets:
        for t in s:
            of.setdefault(t, set()).update(x for x in s if x != t)
    out: Counter = Counter()
    for sentence in _SENTENCE.findall(text.lower()):
        words = set(_WORD.findall(sentence))
        for term in words & of.keys():
            rest = {f for w in words - {term} for f in features_of(w)}
            taken = set(features_of(term)) - rest
            for other in of[term] - words:
                brought = set(features_of(other)) - rest
                out[tuple(sorted(taken - brought)), tuple(sorted(brought - taken))] += 1
    return out


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    n_swaps: int = 0  # swapped terms of labelled sentences that training took account of
    min_gain: float = 0.0

    def logit(self, words: set[str], cache: dict[str, tuple[str, ...]]) -> float:
        """cache holds, for words seen before, those of their features that have a weight."""
        found = set()
        for w in words:
            own = cache.get(w)
            if own is None:
                own = cache[w] = tuple(f for f in features_of(w) if f in self.weights)
            if own:
                found.update(own)
        return self.bias + sum(map(self.weights.__getitem__, sorted(found)))


class Scorer:
    """Scores texts by a model; the features of at most CACHE different words are kept."""

    def __init__(self, model: Model):
        self.model, self.cache = model, {}

    def __call__(self, column: pa.Array) -> np.ndarray:
        z = []
        for t in column:
            z.append(self.model.logit(set(_WORD.findall((t.as_py() or "").lower())), self.cache))
            if len(self.cache) > CACHE:
                self.cache.clear()
        return 1 / (1 + np.exp(-np.clip(np.array(z, float), -700, 700)))


class Index:
    """Numbers for features; the numbers of a word's features are kept, so that a word is cut up once."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.of: dict[str, tuple[int, ...]] = {}

    def __call__(self, words: set[str]) -> np.ndarray:
        for w in words:
            if w not in self.of:
                self.of[w] = tuple(self.ids.setdefault(f, len(self.ids)) for f in features_of(w))
        return np.unique(np.fromiter((i for w in words for i in self.of[w]), np.int32))

    def features(self, names: list[str]) -> np.ndarray:
        return np.array([self.ids.setdefault(f, len(self.ids)) for f in names], np.int32)


def gains(rows: list[tuple[np.ndarray, int]], n: int) -> np.ndarray:
    """The gain in log-likelihood of each of n features as the one predictor of the label."""
    y = np.array([label for _, label in rows], float)
    n1, n0 = max(y.sum(), 1e-9), max(len(y) - y.sum(), 1e-9)
    df = np.zeros((2, n))
    for ids, label in rows:
        df[label, ids] += 1
    a, b = df[1], df[0]

    def loglik(hits: np.ndarray, n: float, p: np.ndarray) -> np.ndarray:
        return hits * np.log(np.maximum(p, 1e-12)) + (n - hits) * np.log(np.maximum(1 - p, 1e-12))

    both = (a + b) / (n1 + n0)
    return loglik(a, n1, a / n1) + loglik(b, n0, b / n0) - loglik(a, n1, both) - loglik(b, n0, both)


def _sparse(sets: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the features that have a place."""
    own = [x[x >= 0] for x in (place[ids] for ids in sets)]
    return np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate([*own, np.zeros(0, int)]).astype(int)


def _weights(y: np.ndarray, prior: float) -> np.ndarray:
    """Weights of rows that give the classes the shares of the prior."""
    return np.where(y == 1, prior / max(y.sum(), 1e-9), (1 - prior) / max(len(y) - y.sum(), 1e-9))


def _descend(rows: list, swaps: list, chosen: np.ndarray, n: int, prior: float, l2: float, fairness: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights of the chosen features and bias by full-batch training with momentum."""
    place = np.full(n, -1)
    place[chosen] = np.arange(len(chosen))
    y = np.array([label for _, label in rows], float)
    r, c = _sparse([ids for ids, _ in rows], place)
    (r0, c0), (r1, c1) = _sparse([s[0] for s in swaps], place), _sparse([s[1] for s in swaps], place)
    times = np.array([s[2] for s in swaps], float)
    weight = _weights(y, prior)

    def unfair(w: np.ndarray) -> np.ndarray:
        change = times * (np.bincount(r0, w[c0], len(swaps)) - np.bincount(r1, w[c1], len(swaps)))
        return 2 * fairness / times.sum() * (np.bincount(c0, change[r0], len(w)) - np.bincount(c1, change[r1], len(w)))

    w, bias = np.zeros(len(chosen)), float(np.log(prior / (1 - prior)))
    # the steepest curvature, by power iteration, bounds the rate at which momentum stays stable
    v, steepest = np.ones(len(chosen)), 1e-9
    for _ in range(20 if len(chosen) and len(y) else 0):
        v = v / max(np.linalg.norm(v), 1e-12)
        v = 0.25 * np.bincount(c, (weight * np.bincount(r, v[c], len(y)))[r], len(v)) + (unfair(v) if swaps else 0)
        steepest = max(steepest, float(np.linalg.norm(v)))
    vw, vb, rate = np.zeros_like(w), 0.0, min(0.5, 1.5 / steepest)
    for _ in range(steps if len(chosen) and 0 < y.sum() < len(y) else 0):
        z = bias + np.bincount(r, w[c], len(y))
        e = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        g = np.bincount(c, e[r], len(w)) + l2 * w
        if swaps:
            g += unfair(w)
        vw, vb = 0.9 * vw - rate * g, 0.9 * vb - 0.2 * rate * e.sum()
        w, bias = w + vw, bias + vb
    return w, float(bias)


def _loss(rows: list, chosen: np.ndarray, n: int, w: np.ndarray, bias: float, prior: float) -> float:
    place = np.full(n, -1)
    place[chosen] = np.arange(len(chosen))
    y = np.array([label for _, label in rows], float)
    r, c = _sparse([ids for ids, _ in rows], place)
    z = np.clip(bias + np.bincount(r, w[c], len(y)), -50, 50)
    return float((_weights(y, prior) * np.log1p(np.exp(np.where(y == 1, -z, z)))).sum())


def fit(rows: list[tuple[np.ndarray, int]], swaps: list[tuple[np.ndarray, np.ndarray, int]], names: list[str], prior: float, l2: float = 1e-4, fairness: float = 0.2, steps: int = 400, least: tuple = GAINS) -> Model:
    """rows: feature numbers and label; swaps: features that a swap takes and brings, and how often it occurs.

    All features are used whose gain is large enough; how large, of the values in least, is chosen by the loss of one row
    in FOLDS after training on the others. prior is the share of label 1 among all labelled rows, of which rows may be a
    stratified sample: classes are weighed back to it.
    """
    n, prior = len(names), min(max(prior, 1e-4), 1 - 1e-4)
    best = least[0]
    apart, rest = rows[::FOLDS], [x for i, x in enumerate(rows) if i % FOLDS]
    if len(least) > 1 and all(len({label for _, label in part}) == 2 for part in (apart, rest)):
        gain, losses = gains(rest, n), []
        for x in least:
            chosen = np.flatnonzero(gain >= x)
            losses.append((_loss(apart, chosen, n, *_descend(rest, swaps, chosen, n, prior, l2, fairness, steps // 2), prior), -x))
        best = -min(losses)[1]
    chosen = np.flatnonzero(gains(rows, n) >= best) if rows else np.zeros(0, int)
    w, bias = _descend(rows, swaps, chosen, n, prior, l2, fairness, steps)
    return Model({names[i]: float(x) for i, x in zip(chosen, w, strict=True) if x}, bias, sum(s[2] for s in swaps), best)


def train(documents: DataFrame, labels: DataFrame, held_out: Column, column: str = "toxic", max_rows: int = MAX_ROWS, sets: tuple = IDENTITY_SETS) -> Model:
    """Learns from at most max_rows labelled rows of each class outside held_out; the words of these alone reach the driver."""
    known = one_label(labels, column).where(~held_out)
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    key = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("y = 1").orderBy(*key).limit(max_rows).unionByName(known.where("y = 0").orderBy(*key).limit(max_rows))
    sets_sent = tuple(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            words, swaps = [], []
            for t in b.column(1):
                t = t.as_py()
                words.append(" ".join(sorted(set(_WORD.findall(t.lower())))))
                swaps.append([f"{n}\t{' '.join(x)}\t{' '.join(y)}" for (x, y), n in counterfactuals(t, sets_sent).items()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.string()), pa.array(swaps, pa.list_(pa.string()))], ["y", "words", "swaps"])

    # at most 2 * max_rows ids and labels are broadcast
    sample = texts(documents).join(F.broadcast(chosen), "doc_id").select("y", "text", "doc_id").mapInArrow(run, "y int, words string, swaps array<string>")
    rows, swaps, index = [], Counter(), Index()
    for x in sorted(sample.collect(), key=lambda x: (x["words"], x["y"])):
        rows.append((index(x["words"].split()), int(x["y"] > 0)))
        for s in x["swaps"]:
            times, taken, brought = s.split("\t")
            swaps[taken, brought] += int(times)
    sides = [(index.features(taken.split()), index.features(brought.split()), times) for (taken, brought), times in sorted(swaps.items())]
    return fit(rows, sides, list(index.ids), sum(v for y, v in n.items() if y > 0) / max(sum(n.values()), 1))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row, by its whole text."""
    ship(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)  # a weight for each feature of a bounded number of labelled rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Scorer(sent.value)
        for b in in_parts(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of(b.column(1)))], ["doc_id", "score"])

    return texts(documents).mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, score double")


def toxicity(documents: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of documents.

    held_out is a condition on doc_id: labels of rows that meet it are not learnt from. A score depends on the text
    alone. Null and empty texts get the score of a text without known words; repeated rows get equal scores; of
    repeated labels the largest counts; without labels of both classes every score is the prior.
    """
    ship(documents.sparkSession)
    scored = score(documents, train(documents, labels, held_out)).withColumn("held_out", held_out)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents, with all their columns, whose text scores below the threshold; nothing is shuffled.

    Null and empty texts have the score of a text without known words. Repeated rows are judged alike; an empty table
    stays empty.
    """
    ship(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Scorer(sent.value)
        for b in in_parts(batches):
            yield b.filter(pa.array(of(b.column(place)) < threshold))

    return documents.mapInArrow(run, documents.schema)
