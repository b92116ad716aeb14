import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from conftest import prose  # noqa: I001
from lexiflux.llm import decontaminate as D
from lexiflux.llm import lm as L
from lexiflux.llm import mixing as M
from lexiflux.llm import quotes as Q
from lexiflux.llm.common import fold


def distance(p, t):
    """Least edits of p to any run of t, by the full table."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers(rng):
    for _ in range(1500):
        p = [rng.choice("abc") for _ in range(rng.randint(1, 80))]
        t = [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        assert D.myers(p, t)[0] == distance(p, t)


def test_decontamination_against_all_pairs(spark, frame, rng, monkeypatch, odd):
    items = [(i, prose(rng, rng.randint(3, 60))) for i in range(25)] + [(25, "der " * 12), (26, None), (27, "?!")]
    rows = []
    for i in range(120):
        words = prose(rng, rng.randint(0, 120)).split()
        if i % 3 == 0:
            own = items[rng.randrange(26)][1].upper().split()
            for _ in range(rng.randrange(max(1, len(own) // 3))):
                own[rng.randrange(len(own))] = prose(rng, 1)
            words[len(words) // 2 : len(words) // 2] = own
        rows.append((i, " ".join(words)))
    rows += [(200, "der " * 500), (201, None), (202, "")]
    want = set()
    for i, t in rows:
        for n, b in items:
            p = D.normal(b).split()
            if p and (d := distance(p, D.normal(t).split())) <= int(D.BUDGET * len(p)):
                want.add((i, n, d))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (D.BLOCK_CHARS, 300):
        monkeypatch.setattr(D, "BLOCK_CHARS", size)
        assert {(r["doc_id"], r["item_id"], r["distance"]) for r in D.contaminated(frame(rows), bench).collect()} == want
    assert len(want) >= 25
    kept = D.clean(frame(rows), bench)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - {i for i, _, _ in want}
    assert kept.columns == frame(rows).columns
    assert D.contaminated(frame(odd), bench.limit(0)).collect() == [] and D.contaminated(frame([]), bench).collect() == []
    assert D.clean(frame(odd), bench).count() == len(odd)
    twice = spark.createDataFrame([(1, "one two three four"), (1, "five six seven eight nine ten eleven")], "item_id long, text string")
    both = D.contaminated(frame([(7, "one two three four, and five six seven eight nine ten eleven")]), twice).collect()
    assert sorted((r["n_item_words"], r["distance"], r["end_word"]) for r in both) == [(4, 0, 4), (7, 0, 12)]


def test_lm_counts_against_brute_force(frame, rng, odd):
    rows = [(i, prose(rng, rng.randint(0, 80))) for i in range(150)] + odd
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    c, ends = Counter(), 0
    for i, t in rows:
        if not held(i):
            c.update(L.words_of(t or ""))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    want = []
    for i, t in rows:
        counts = [c[w] for w in L.words_of(t or "")] + [ends]
        want.append((i, held(i), len(counts), sum(x > 0 for x in counts), n, round(sum(math.log10((x + 1) / (n + v + 1)) for x in counts), 6)))
    for head in (20, 10_000):
        got = L.lm_scores(frame(rows), fold(7) == 2, head=head, symbols=64, classes=8, dimension=8).collect()
        assert sorted(((*r[:5], round(r[5], 6)) for r in got), key=repr) == sorted(want, key=repr)
        assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)
    assert L.lm_scores(frame([]), fold(7) == 2).collect() == []


def test_lm_is_normalised_and_learns():
    rng = np.random.default_rng(3)
    after = rng.permutation(40)
    s = [0]
    for _ in range(20_000):  # mostly a fixed successor
        s.append(int(after[s[-1]]) if rng.random() < 0.8 else int(rng.integers(40)))
    s = np.array(s)
    unigram = np.bincount(s, minlength=40) / len(s)
    m = L.LogBilinear.start(unigram, 16)
    grown = [np.zeros_like(x) for x in (m.r1, m.r2, m.q, m.b)]
    for _ in range(3):
        for i in range(2, len(s) - 200, 200):
            at = np.arange(i, i + 200)
            m.train(s[at - 2], s[at - 1], s[at], unigram, rng, grown)
    s1, s2, z = m.tables()
    p = np.exp(s1[:, None, :] + s2[None, :, :] - z[:, :, None])
    assert np.allclose(p.sum(2), 1, atol=1e-3)
    logp = s1[s[1:-1], s[2:]] + s2[s[:-2], s[2:]] - z[s[1:-1], s[:-2]]
    assert logp.mean() > np.log(unigram[s[2:]]).mean() + 1


def test_lm_learns_from_every_position(frame, rng):
    docs = frame([(i, prose(rng, rng.randint(1, 60))) for i in range(40)]).coalesce(1).cache()
    ts = [r["text"] for r in docs.collect()]
    counts = L.word_counts(docs).cache()
    vocab = L.vocabulary(counts, len(ts), symbols=64, classes=8)
    got = L.train(docs, vocab, 8)
    vocab.ready()
    _, symbols, _, ends = L._joined(vocab, ts)
    c2, c1 = L.contexts(symbols, ends)
    want, gen = L.LogBilinear.start(vocab.unigram(), 8), np.random.default_rng(1)
    at = gen.permutation(len(symbols))
    grown = [np.zeros_like(x) for x in (want.r1, want.r2, want.q, want.b)]
    for i in range(0, len(at), L.BATCH):
        part = at[i : i + L.BATCH]
        want.train(c2[part], c1[part], symbols[part], vocab.unigram(), gen, grown)
    assert all(np.allclose(getattr(got, x), getattr(want, x)) for x in ("r1", "r2", "q", "b"))


def test_lm_score_from_the_parameters(frame, rng, odd):
    """Each token's probability by a softmax over all symbols, and a word's share in its class by its counts."""
    ts = [prose(rng, rng.randint(0, 60)) for _ in range(30)] + [t or "" for _, t in odd if not t or len(t) < 1000]
    docs = frame(list(enumerate(ts)))
    counts = {r["word"]: r["c"] for r in L.word_counts(docs).collect()}
    vocab = L.vocabulary(L.word_counts(docs).cache(), len(ts), head=40, symbols=24, classes=4)
    model = L.train(docs, vocab, 8)
    n, known, base, part, tails = L.score_texts(ts, vocab, model)
    head = {bytes(w): i for i, w in enumerate(vocab.words)}
    for k, t in enumerate(ts):
        words, score = L.words_of(t), 0.0
        symbols = [1 + head[w] if head.get(w, 99) < vocab.short else vocab.class_of(w) for w in words] + [0]
        for i, s in enumerate(symbols):
            before, last = symbols[i - 2] if i > 1 else 0, symbols[i - 1] if i else 0
            z = (model.r1[last] + model.r2[before]) @ model.q.T + model.b
            score += (z[s] - z.max() - np.log(np.exp(z - z.max()).sum())) / np.log(10)
            if s > vocab.short:
                own = {w: c for w, c in counts.items() if vocab.class_of(w) == s and head.get(w, 99) >= vocab.short}
                score += math.log10((counts[words[i]] + 1) / (sum(own.values()) + len(own) + 1))
        assert n[k] == len(symbols) and abs(part[k] + sum(math.log10(counts[w] + 1) for w in tails[k]) - score) < 1e-3 * len(symbols)


def test_lm_symbols_grow_with_the_vocabulary(spark):
    for n, own in ((50, 50), (3000, 3000), (9000, L.SYMBOLS - L.CLASSES - 1)):
        counts = spark.createDataFrame([(b"w%d" % i, 1 + n // (i + 1)) for i in range(n)], "word binary, c long").cache()
        vocab = L.vocabulary(counts, 10)
        assert vocab.short == own and len(vocab.unigram()) == 1 + own + L.CLASSES


def test_lm_beats_its_base_on_held_out_texts(frame):
    rng = random.Random(8)
    sides = [[prose(rng, 1).strip(".") + x for _ in range(60)] for x in "ab"]  # two languages
    rows = [(i, " ".join(rng.choice(sides[i % 2]) for _ in range(60))) for i in range(400)]
    got = [r for r in L.lm_scores(frame(rows), fold(7) == 2, symbols=128, classes=8).collect() if r["held_out"]]
    assert len(got) > 30 and sum(r["score"] for r in got) > 0.97 * sum(r["base_score"] for r in got)


def mixed(rows):
    c = duckdb.connect()
    c.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if rows:
        c.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return c.sql(M.ORACLE).fetchall()


@pytest.mark.parametrize("case", ["usual", "odd", "capped", "empty", "wordless"])
def test_mixing(frame, rng, odd, case):
    rows = {
        "usual": [(i, prose(rng, rng.randint(0, 50)), f"s{i % 7}") for i in range(300)],
        "odd": [(i, t, s) for (i, t), s in zip(odd, [None, None, "b", "a", "é", "a", None, "b", "b", "", "", "z", "z"], strict=True)],
        "capped": [(i, prose(rng, 3 if i % 10 else 2000), "big" if i % 10 == 0 else f"s{i % 10}") for i in range(200)],
        "empty": [],
        "wordless": [(1, None, "a"), (2, " ", None)],
    }[case]
    got = sorted((tuple(r) for r in M.mix(frame(rows)).collect()), key=repr)
    assert got == sorted(((*r[:6], None if r[6] is None else int(r[6])) for r in mixed(rows)), key=repr)
    assert all(0 <= r[5] <= 3 * r[2] for r in got)
    by = Counter()
    for r in got:
        by[r[1]] += r[5]
    for r in got:
        assert abs(by[r[1]] - r[4]) <= 1 and r[4] <= 3 * r[3]
    places = [r["position"] for r in M.in_order(M.mix(frame(rows))).collect() if r["position"] is not None]
    assert places == sorted(places)


def test_mixing_places_every_repeat(frame, rng):
    rows = [(i, prose(rng, 3 + i % 4 if i % 10 else 400), "big" if i % 10 == 0 else f"s{i % 10}") for i in range(120)]
    got = {r["doc_id"]: r for r in M.schedule(frame(rows)).collect()}
    size = {i: len(t.split()) for i, t, _ in rows}
    total, names = sum(size.values()), sorted({s for _, _, s in rows})
    quota = {r["source"]: math.floor(r["target"] + 0.5) for r in got.values()}
    sign = {s: 1 - 2 * (k % 2) for k, s in enumerate(names)}
    mean = sum(quota[s] * sign[s] for s in names) / sum(quota.values())
    for name in names:
        queue = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i, _, s in rows if s == name)
        slope, at, want = M.LEAN * (sign[name] - mean), 0, {i: [] for _, i in queue}
        for _, i in queue * M.MAX_REPEATS:
            if (n := min(size[i], quota[name] - at)) > 0:
                want[i].append((at, n))
            at += size[i]
        demand = lambda t: quota[name] * ((1 - slope) * t + slope * t * t)  # noqa: B023, E731
        for i, due in want.items():
            r = got[i]
            assert [x["taken"] for x in r["repeats"]] == [n for _, n in due] and r["taken"] == sum(n for _, n in due)
            assert r["position"] == (r["repeats"][0]["position"] if due else None)
            for x, (at_word, _) in zip(r["repeats"], due, strict=True):
                assert demand(x["position"] / total) <= at_word + 1e-6 and demand((x["position"] + 1) / total) >= at_word - 1e-6
    assert max(len(r["repeats"]) for r in got.values()) == 3
    assert M.mix(frame(rows)).columns == ["doc_id", "source", "size", "source_size", "target", "taken", "position"]


def test_quotes(spark):
    deep = "line of talk\n" * 3
    rows = [
        (1, 0, "user", "Hello there, friend.\nHow is it?"), (1, 1, "assistant", "Fine thanks"), (1, 2, "user", "> hello  THERE friend\n>> deep\nI asked"), (1, 3, "user", None),
        (1, 9, "user", "> Fine thanks\n> unknown line\n\nGood"), (1, 10, "user", "> not said"), (2, 5, "user", "> Hello there, friend."), (2, 5, "user", "> Hello there, friend."),
        (3, 2000, "user", "late > no quote"), (3, 1, "user", deep), (3, 3001, None, "> " + deep.replace("\n", "\n> ")), (None, None, None, "> x"), (None, 1, "a", ""), (4, None, "user", "odd"),
        (5, 0, "a", "The first word of all."), (5, 1, "b", "A second one!"), (5, 2, "a", "> changed by the mailer\n>> The first word of all.\nand mine"), (5, 3, "b", ">> A second one\n> The first word of all\nyes"),
        (5, 4, "a", "> and mine\nno"), (5, 5, "b", "nothing quoted"), (5, 6, "a", "> A second one!\n" + "long talk " * 20_000),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, content string, k long")
    got = [tuple(r) for r in Q.link_quotes(df).collect()]
    assert len(got) == len(rows)
    by = {(r[0], r[1]): r for r in got}
    assert by[1, 2][3:8] == ("I asked", 0, True, 2, 2)
    assert by[1, 3][3:8] == ("", 2, False, 0, 0)
    assert by[1, 9][3:8] == ("Good", 1, True, 1, 1)
    # a deeper quote counts where no shallower one is known; replies stand by their parents
    assert [by[5, t][4] for t in range(7)] == [None, 0, 0, 0, 2, 4, 1]
    assert [r[1] for r in got if r[0] == 5] == [0, 1, 2, 3, 6, 4, 5] and [r[8] for r in got if r[0] == 5] == list(range(7))
    assert by[1, 10][4:6] == (9, False) and by[1, 0][4] is None
    assert by[2, 5][4] is None and by[3, 2000][4] == 1 and by[3, 3001][4:6] == (1, True) and by[3, 2000][3] == "late > no quote"
    assert by[4, None][4] is None and by[None, 1][4] is None
    assert [r[:2] for r in got if r[0] == 1] == [(1, t) for t in (0, 1, 2, 9, 3, 10)]  # 9 replies to 1, 3 to 2
    assert Q.link_quotes(df.limit(0)).collect() == []
    c = duckdb.connect()
    c.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(map(tuple, Q.render(Q.link_quotes(df)).collect()), key=repr) == sorted(c.sql(Q.ORACLE).fetchall(), key=repr)
    assert Q.render(Q.link_quotes(df)).where("conv_id = 1 AND turn = 1").first()["chat"] == "<|assistant|>\nFine thanks\n"
