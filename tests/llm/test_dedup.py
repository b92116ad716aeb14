import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from conftest import prose  # noqa: I001
from lexiflux.llm import neardup as N
from lexiflux.llm import substrings as S
from lexiflux.llm.hashing import shingles, word_hashes


def classes(rows, least=0.8, k=5):
    """doc_id -> class by all pairs."""
    words = [(i, tuple(re.findall(r"\w+", (t or "").lower()))) for i, t in rows]
    sets = [Counter(w[j : j + k] for j in range(max(1, len(w) - k + 1))) if w else Counter() for _, w in words]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if words[a][1] == words[b][1] or (c := sum((sets[a] & sets[b]).values())) and c / (sum(sets[a].values()) + sum(sets[b].values()) - c) >= least:
                top[find(a)] = find(b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        out += [(rows[i][0], min(ids) if ids else None, len({words[i][1] for i in g}), len(g)) for i in g]
    return sorted(out, key=repr)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = prose(rng, 1)
    return " ".join(w)


def corpus(rng):
    rows = [(i, prose(rng, rng.randint(5, 120))) for i in range(60)]
    base = prose(rng, 150)
    for n in range(40):  # one large group of copies with more and fewer edits
        rows.append((100 + n, edited(rng, base, n % 8)))
    chain = prose(rng, 200)
    for n in range(12):  # each a copy of the one before
        chain = edited(rng, chain, 2)
        rows.append((200 + n, chain))
    rows += [(300 + n, rows[3][1]) for n in range(30)] + [(400, rows[3][1].upper() + "!")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [N.BLOCK, 5])
def test_near_duplicates_against_all_pairs(frame, rng, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rows = corpus(rng)
    got = sorted((tuple(r) for r in N.near_duplicates(frame(rows)).collect()), key=repr)
    assert got == classes(rows)


def test_odd_rows(frame, odd):
    assert sorted((tuple(r) for r in N.near_duplicates(frame(odd)).collect()), key=repr) == classes(odd)
    assert N.near_duplicates(frame([])).collect() == []
    assert [tuple(r) for r in N.near_duplicates(frame([(None, "a b")])).collect()] == [(None, None, 1, 1)]


def test_one_of_each_group_stays(frame, rng, odd):
    rows = corpus(rng)
    docs = frame(rows)
    kept = N.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c, _, _ in classes(rows)})
    # ids 1 and 8 share a class, so do texts without words; the two texts of id 6 are two classes
    assert sorted(r["doc_id"] for r in N.representatives(frame(odd)).collect()) == [1, 2, 5, 6, 6, 7]


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    ids = rng.integers(1, 2**63, 400).astype(np.uint64)
    ids.sort()
    a, b = rng.integers(1, 5, 400), rng.integers(1, 5, 400)
    b[:60] = 0
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    sig = N.signatures([(ids, a), (ids[b > 0], b[b > 0])], 4000)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.04
    real = N.signatures([(ids, a * 0.5), (ids[b > 0], b[b > 0] * 0.5)], 4000)
    assert abs((real[0] == real[1]).mean() - true) < 0.04
    assert (sig != 0).all() and not N.signatures([(ids[:0], a[:0])], 10).any()


def test_word_hashes(rng):
    t = "Hello, wörld! hello 42_x — HELLO"
    h = word_hashes(t)
    assert len(h) == 5 and h[0] == h[2] and len(set(h.tolist())) == 4 or len(h) == 6
    assert len(shingles(word_hashes("a b"))) == 1 and len(shingles(word_hashes(""))) == 0
    assert word_hashes("x" * 10 + " abc").tolist()[1] == word_hashes("abc").tolist()[0]


def _hash(t):
    """The hash of a text by which rows of one id rank."""
    h = xxhash.xxh64_intdigest((t or "").encode(), 42)
    return h - (1 << 64 if h >> 63 else 0)


def sifted(rows, least=S.MIN_WORDS, least_run=S.MIN_RUN):
    """What is left of each row: repeats are marked, then runs of R (repeat) and s (short) units go that begin and end with R."""
    owner = {}
    norm = lambda u: " ".join(u.lower().split())
    cut = lambda t: re.findall(r"[^\n]*?(?:[.!?][ \t]+|\n)|[^\n]+", t or "")
    late = lambda r: (r[0] is None, r[0] or 0, _hash(r[1]))
    for r in sorted(rows, key=late):
        for u in cut(r[1]):
            if len(u.split()) >= least:
                owner.setdefault(norm(u), late(r))
    out = []
    for r in rows:
        seen, marks, parts = set(), "", cut(r[1])
        for u in parts:
            first = owner.get(norm(u)) == late(r) and norm(u) not in seen
            seen.add(norm(u))
            marks += "s" if len(u.split()) < least else "k" if first else "R"
        for m in re.finditer("R(?:[Rs]*R)?", marks):
            if sum(len(u.split()) for u in parts[m.start() : m.end()]) >= least_run:
                marks = marks[: m.start()] + "-" * (m.end() - m.start()) + marks[m.end() :]
        out.append((r[0], "".join(u for u, k in zip(parts, marks, strict=True) if k != "-")))
    return sorted(out, key=repr)


def test_substring_dedup(frame, rng, odd):
    passage = prose(rng, 70)
    rows = [(i, prose(rng, 50)) for i in range(30)]
    rows += [(40 + i, prose(rng, 20) + " " + passage + " " + prose(rng, 20)) for i in range(8)] + [(60, rows[2][1]), (61, (rows[4][1] + "\n") * 3)]
    for case in (rows, odd):
        got = S.dedup_units(frame(case)).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sifted(case)
        for r in got:
            if r["doc_id"] not in (None, 1, 6):
                t = next(t or "" for i, t in case if i == r["doc_id"])
                spans, at, left = r["removed"], 0, []
                for s in spans:
                    left.append(t[at : s["start"]])
                    at = s["end"]
                assert "".join(left) + t[at:] == r["text"] and len(spans) == r["n_removed"]
    assert S.dedup_units(frame([])).collect() == []
    cleaned = S.clean(frame(odd))
    assert sorted(((r["doc_id"], r["text"] or "") for r in cleaned.collect()), key=repr) == sifted(odd)
    assert cleaned.columns == frame(odd).columns and all(r["n_chars"] == len(r["text"]) for r in cleaned.collect() if r["text"] is not None)
