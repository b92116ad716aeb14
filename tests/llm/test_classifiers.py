import random
from collections import Counter

import numpy as np
import pytest

from conftest import prose  # noqa: I001
from lexiflux.llm import quality as Q
from lexiflux.llm import toxicity as X
from lexiflux.llm.common import fold
from pyspark.sql import functions as F

LABELS = "doc_id long, quality int, toxic int"


def test_discriminant_against_direct_densities():
    rng = np.random.default_rng(0)
    x = [rng.normal(0, 1, (200, 14)), rng.normal(0.7, 2, (300, 14))]
    n, s, p = np.array([200.0, 300.0]), np.stack([a.sum(0) for a in x]), np.stack([a.T @ a for a in x])
    m = Q.Discriminant.fit(n, s, p)
    new = rng.normal(0.3, 1.5, (50, 14))
    logs = []
    for c in (0, 1):
        cov = np.cov(x[c].T, bias=True)
        cov = (1 - Q.SHRINK) * cov + Q.SHRINK * np.diag(np.diag(cov)) + Q.RIDGE * np.eye(14)
        d = new - x[c].mean(0)
        logs.append(np.log((n[c] + 1) / 502) - 0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]))
    assert np.allclose(m.scores(new), 1 / (1 + np.exp(logs[0] - logs[1])))


def junk(rng, n):
    w = prose(rng, n).split()
    return rng.choice([lambda: " ".join(x.upper() + "!!" for x in w), lambda: " | ".join(w), lambda: " ".join([w[0]] * n)])()


def test_quality_on_held_out_rows(spark, frame):
    rng = random.Random(2)
    rows = [(i, junk(rng, 60) if i % 4 == 0 else prose(rng, rng.randint(20, 200))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)] + [(None, 1, None), (3, None, None)], LABELS)
    got = Q.quality(frame(rows), labels, fold(3) == 1).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 400 and 90 < len(held) < 180
    assert sum(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held) >= 0.95 * len(held)


@pytest.mark.parametrize("f", [Q.quality, X.toxicity])
def test_odd_rows(spark, frame, odd, f):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (3, 0, 0), (5, 1, 1), (8, None, None)], LABELS)
    got = f(frame(odd), labels, F.lit(False)).collect()
    assert len(got) == len(odd) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert f(frame([]), labels, F.lit(False)).collect() == []
    none = f(frame(odd[:3]), labels.limit(0), F.lit(False)).collect()
    assert len({r["score"] for r in none}) == 1


def toxic_rows(n):
    rng = random.Random(3)
    bad = ["scumbag", "vermin", "idiotic"]
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(10, 80)).split()
        toxic = int(i % 5 == 0)
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
            if i % 10 == 0:  # insults name one group more often than clean texts do
                words.insert(rng.randrange(len(words)), "muslim")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, frame):
    rows, labels = toxic_rows(500)
    docs, labels = frame(rows), spark.createDataFrame(labels, LABELS)
    held = [r for r in X.toxicity(docs, labels, fold(4) == 2).collect() if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held) >= 0.97 * len(held)
    model = X.train(docs, labels, F.lit(False))
    kept = {r["doc_id"] for r in X.reject(docs, model).collect()}
    assert X.reject(docs, model).columns == docs.columns
    assert sum((i in kept) == (i % 5 != 0) for i, _ in rows) >= 490


def test_mentions_weigh_less_with_the_penalty():
    rows, labels = toxic_rows(500)
    sets = [(set(X._WORD.findall(t.lower())), y) for (_, t), (_, _, y) in zip(rows, labels, strict=True)]
    swaps = sum((X.counterfactuals(t) for _, t in rows), Counter())
    weights = []
    for fairness in (0.0, 5.0):
        index = X.Index()
        data = [(index(w), y) for w, y in sets]
        pairs = [(index.features(a), index.features(b), n) for (a, b), n in swaps.items()]
        m = X.fit(data, pairs, list(index.ids), 0.2, fairness=fairness)
        weights.append(m.logit({"muslim"}, {}) - m.logit({"christian"}, {}))
    assert swaps and weights[0] > 0.3 and abs(weights[1]) < 0.5 * weights[0]


def test_counterfactuals():
    got = X.counterfactuals("A gay person. Nothing here.", (("gay", "lesbian", "queer"),))
    assert got == {(("gay",), ("lesbian", "lesb*", "lesbi*", "lesbia*", "lesbian*")): 1, (("gay",), ("queer", "quee*", "queer*")): 1} or all(a == ("gay",) for a, _ in got) and sum(got.values()) == 2
    # by brute force: the features of the sentence with and without the swap
    rng = random.Random(4)
    text = ". ".join(" ".join(rng.choice(["men", "women", "mental", "er", "sie", "the", "womens", "x"]) for _ in range(4)) for _ in range(60))
    want = Counter()
    for sentence in text.split(". "):
        words = set(sentence.split())
        for term in words:
            others = {o for s in X.IDENTITY_SETS if term in s for o in s if o != term} - words
            for other in others:
                before, after = ({f for w in ws for f in X.features_of(w)} for ws in (words, words - {term} | {other}))
                want[tuple(sorted(before - after)), tuple(sorted(after - before))] += 1
    assert X.counterfactuals(text) == want and sum(want.values()) > 100


def test_fit_against_scaled_gradients():
    """At the minimum, which long training reaches, the gradient of the whole objective is 0: recomputed here row by row."""
    rng = np.random.default_rng(2)
    names = [f"f{i}" for i in range(12)]
    rows = [(np.flatnonzero(rng.random(12) < 0.3), int(rng.random() < 0.4)) for _ in range(200)]
    rows = [(ids, int(y or 3 in ids and rng.random() < 0.7)) for ids, y in rows]
    swaps = [(np.array([3]), np.array([4, 5]), 7), (np.array([6]), np.array([], int), 2)]
    m = X.fit(rows, swaps, names, 0.3, l2=0.01, fairness=0.2, steps=20_000, least=(0.0,))
    w = np.array([m.weights.get(x, 0.0) for x in names])
    n1 = sum(y for _, y in rows)
    g, gb = 0.01 * w, 0.0
    for ids, y in rows:
        e = (0.3 / n1 if y else 0.7 / (len(rows) - n1)) * (1 / (1 + np.exp(-(m.bias + w[ids].sum()))) - y)
        g[ids] += e
        gb += e
    for a, b, n in swaps:
        change = 2 * 0.2 / 9 * n * (w[a].sum() - w[b].sum())
        g[a] += change
        g[b] -= change
    assert np.abs(g).max() < 1e-6 and abs(gb) < 1e-6 and m.n_swaps == 9


def test_swaps_on_rows_like_the_drivers(spark, frame):
    """Rows of invented words among real function words, in which pronouns are the identity terms."""
    rng = random.Random(6)
    rows = [(i, " ".join([*prose(rng, 30).split(), "er" if i % 2 else "il", *prose(rng, 5).split(), "idiot" if i % 4 == 0 else "he"])) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], LABELS)
    model = X.train(frame(rows), labels, F.lit(False))
    assert model.n_swaps >= 200 and model.min_gain in X.GAINS
    assert abs(model.weights.get("he", 0) - model.weights.get("she", 0)) < 0.5 * model.weights["idiot"]
