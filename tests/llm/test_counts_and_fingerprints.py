import hashlib
import random

import pytest
from pyspark.sql import functions as F

from conftest import prose  # noqa: I001
from lexiflux.llm import fingerprints as W
from lexiflux.llm import tokencount as T


def best(scores, s, unknown):
    """Pieces of the best segmentation by plain dynamic programming."""
    at = [(0.0, 0)]
    for end in range(1, len(s) + 1):
        options = [(at[a][0] + scores[s[a:end]], at[a][1] + 1) for a in range(end) if s[a:end] in scores]
        if s[end - 1] not in scores:
            n = len(s[end - 1].encode())
            options.append((at[-1][0] + unknown * n, at[-1][1] + n))
        at.append(max(options, key=lambda x: x[0]))
    return at[-1][1]


def test_trie_against_plain_dynamic_programming():
    rng = random.Random(1)
    scores = {"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 5))): -rng.random() * 9 for _ in range(80)} | {"a": -4.3, "b": -5.1}
    scores.pop("c", None)
    pieces = T.Pieces(scores)
    for most in (10_000, 30):  # a trie that starts afresh all the time counts the same
        trie = T.Trie(pieces, most)
        for _ in range(2000):
            w = "".join(rng.choice("abcd é") for _ in range(rng.randint(1, 12)))
            assert trie.count(w) == best(scores, w.replace(" ", "▁"), pieces.unknown), w


def test_token_counts(spark, frame, odd):
    scores = T.piece_scores()
    pieces = T.Pieces(scores)
    trie = T.Trie(pieces)
    got = sorted(map(tuple, T.token_counts(frame(odd)).collect()), key=repr)
    want = sorted(((i, len(T.PRETOKEN.findall(t or "")), sum(map(trie.count, T.PRETOKEN.findall(t or "")))) for i, t in odd), key=repr)
    assert got == want and dict((i, n) for i, _, n in got)[3] == 0
    assert T.token_counts(frame([])).collect() == []


def slow_winnow(h, w):
    picked = []
    for i in range(max(1, len(h) - w + 1)):
        window = h[i : i + w]
        j = max(x for x in range(len(window)) if window[x] == min(window)) + i
        if not picked or picked[-1] != j:
            picked.append(j)
    return picked if len(h) else []


def test_winnow(rng):
    for _ in range(60):
        t = "".join(rng.choice("ab") for _ in range(rng.randint(0, 90)))
        k, w = rng.randint(1, 6), rng.randint(1, 9)
        h = W.gram_hashes(t, k)
        assert W.winnow(h, w)[0].tolist() == slow_winnow(h.tolist(), w)
        assert len(h) == (len(t) - min(k, len(t)) + 1 if t else 0)


def test_match_guarantee(rng):
    for _ in range(30):
        shared = prose(rng, 30)[: W.K + W.W - 1]
        a, b = prose(rng, 40) + shared + prose(rng, 40), prose(rng, 20) + shared + prose(rng, 60)
        assert {h for h, _ in W.decode(W.fingerprint(a)[0])} & {h for h, _ in W.decode(W.fingerprint(b)[0])}


def neighbours(rows, placed=False):
    rows = rows if placed else sorted(rows, key=lambda r: r[0])
    for i, (doc_id, t) in enumerate(rows):
        n = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        (f, s), (fe, se), (_, sn) = W.fingerprint(t), W.fingerprint(e), W.fingerprint(n)
        yield (doc_id, len(t), hashlib.sha256(e.encode()).hexdigest(), f, fe, W.likeness(s, se), W.likeness(s, sn))


@pytest.mark.parametrize("run", [7, 2000])
def test_neighbours(frame, rng, monkeypatch, run):
    monkeypatch.setattr(W, "RUN", run)
    rows = [(i * 37 % 101, prose(rng, rng.randint(0, 90))) for i in range(101)]
    got = sorted(map(tuple, W.neighbours(frame(rows)).collect()))
    assert got == sorted(neighbours(rows))


@pytest.mark.parametrize("run", [5, 2000])
def test_neighbours_of_ids_with_many_rows(frame, rng, monkeypatch, run):
    """Null ids and one id hold two thirds of the rows; equal ids go by the hash of the text, and null ids come last."""
    monkeypatch.setattr(W, "RUN", run)
    rows = [((None, 40, i)[i % 3], f"{i} {prose(rng, rng.randint(0, 40))}") for i in range(120)]
    docs = frame(rows)
    placed = [(r["doc_id"], r["text"]) for r in docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).collect()]
    assert sorted(map(repr, map(tuple, W.neighbours(docs).collect()))) == sorted(map(repr, neighbours(placed, placed=True)))
    runs = [r["count"] for r in W._in_runs(docs).where("guest = 0").groupBy("run").count().collect()]
    assert sum(runs) == len(rows) and max(runs) < (6 * run if run < 100 else len(rows) + 1)


def test_neighbours_of_odd_rows(frame, odd):
    got = W.neighbours(frame(odd)).collect()
    assert sorted((r["doc_id"], r["n_chars"]) for r in got if r["doc_id"] is not None) == sorted((i, len(t or "")) for i, t in odd if i is not None)
    assert len(got) == len(odd)
    assert all(r["fingerprint"] == W.fingerprint(next(t or "" for i, t in odd if i == r["doc_id"]))[0] for r in got if r["doc_id"] not in (None, 6))
    assert W.neighbours(frame([])).collect() == []
    [one] = W.neighbours(frame([(1, "abcd")])).collect()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert [r["fingerprint"] for r in W.fingerprints(frame([(1, None), (2, "")])).collect()] == ["", ""]
