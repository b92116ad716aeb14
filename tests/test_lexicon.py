import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiflux.functions import text as X
from lexiflux.operators import kwic, lexicon, match, overlap, scan, sparse
from lexiflux.operators.lexicon import PatternError, Term, compile_terms, expand, plain_words, terms_frame, with_added

P = Term


def docs(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return df.select("doc_id", F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("symbol"), X.tokens(X.normalise(F.col("text"))).alias("toks"))


def found(spark, terms, *texts, raw=False):
    d = docs(spark, *texts)
    s = match.spans(d, compile_terms(terms, match.vocabulary(d)))
    s = s if raw else overlap.resolve(s)
    return sorted((r["doc_id"], r["start"], r["len"], r["term_id"]) for r in s.collect())


def test_expand():
    assert sorted(expand("(?:in|on) the?").strings) == ["in th", "in the", "on th", "on the"]
    assert sorted(expand("gr[ae]y[0-2]?").strings) == sorted(f"gr{a}y{n}" for a in "ae" for n in ["", "0", "1", "2"])
    e = expand(r"\b(?<!the )purpose(?! of)\b")
    assert (e.strings, e.before, e.after) == (["purpose"], ["the "], [" of"])
    assert len(expand("(?:a|b)(?:c|d)(?:e|f)").strings) == 8


@pytest.mark.parametrize("bad", ["a+", "[^a]", r"\d", "(?=x)a", "a{2}", "a.", "(", r"(a)\1", "[a-z]" * 3])
def test_rejected(bad):
    with pytest.raises(PatternError):
        expand(bad)


def test_plain():
    assert plain_words("Strive|aspire to") == [["strive", "aspire"], ["to"]]
    with pytest.raises(PatternError):
        expand("[a-z][a-z][a-z]")


def test_overlaps(spark):
    assert found(spark, [P("a", "puffery", "focused on"), P("b", "puffery", "on track to")], "focused on track to") == [(0, 0, 2, 0)]
    assert found(spark, [P("a", "puffery", "sustainable"), P("b", "hedge", "sustainable future")], "a sustainable future") == [(0, 1, 2, 1)]
    assert found(spark, [P("a", "puffery", "bold ambition"), P("b", "hedge", "bold ambition")], "bold ambition") == [(0, 0, 2, 0)]
    better = [P("a", "puffery", "(?:a )?(?:better|new) future")]
    assert len(found(spark, better, "a better future", raw=True)) == 2 and len(found(spark, better, "a better future")) == 1
    assert found(spark, [P("a", "puffery", "people(?:,| and)? planet")], "people, planet", "people and planet") == [(1, 0, 3, 0)]


def test_lookarounds(spark):
    term = [P("p", "puffery", "(?<!the )purpose(?! of)")]
    assert found(spark, term, "for the purpose", "purpose of", "our purpose", "the. purpose", "purpose") == [(2, 1, 1, 0), (3, 2, 1, 0), (4, 0, 1, 0)]


def test_wildcards(spark):
    assert found(spark, [P("s", "puffery", "steward*", "plain")], "steward stewards steward_x") == [(0, 0, 1, 0), (0, 1, 1, 0)]
    assert found(spark, [P("s", "puffery", "strive|aspire to", "plain")], "strive to aspire to") == [(0, 0, 2, 0), (0, 2, 2, 0)]
    c = compile_terms([P("x", "puffery", "a+"), P("y", "puffery", "y")])
    assert list(c.errors) == [0] and len(c.places) == 1


def greedy(spans):
    out, upto = [], -1
    for s in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if s[0] >= upto:
            out.append(s)
            upto = s[0] + s[1]
    return out


def test_islands_are_greedy(spark):
    rng = random.Random(3)
    rows, want = [], []
    for doc in range(40):
        spans = {(rng.randrange(30), rng.randint(1, 5), rng.randrange(6)) for _ in range(rng.randrange(25))}
        rows += [(doc, s, s + n, n, t) for s, n, t in spans]
        want += [(doc, *s) for s in greedy(spans)]
    got = overlap.resolve(spark.createDataFrame(rows, "doc_id long, start int, end int, len int, term_id int")).collect()
    assert sorted((r["doc_id"], r["start"], r["len"], r["term_id"]) for r in got) == sorted(want)


def test_concordance_and_added(spark):
    d = docs(spark, "one of the best. of the rest", "of the")
    s = match.spans(d, compile_terms([P("q", "puffery", "of the", "plain")]))
    rows = {(r["doc_id"], r["start"]): r for r in kwic.concordance(s, d, 10).collect()}
    assert rows[0, 1]["before"] == "one" and rows[0, 1]["after"] == "best · of the rest" and rows[1, 0]["before"] == ""
    assert len(kwic.concordance(s, d, 2).collect()) == 2
    with pytest.raises(ValueError):
        kwic.concordance(s, d, 0)
    terms = with_added([P("the", "puffery", "the")], ["the*", " "])
    raw = match.spans(d, compile_terms(terms, match.vocabulary(d)))
    [row] = sparse.added_word_stats(raw, overlap.resolve(raw), terms_frame(spark, terms)).collect()
    assert (row["corpus_hits"], row["new_hits"], row["already_counted"]) == (3, 0, 3)
    assert Counter(t.extra for t in terms) == {False: 1, True: 1}


def test_scan(spark):
    terms = [P("a", "puffery", "people(?:,| and)? planet"), P("b", "hedge", "the"), P("c", "hedge", "of the"), P("d", "corporate", "(?<!of )the best")]
    d = spark.createDataFrame([(0, "people, planet of the best"), (1, "thé the best"), (2, None), (3, "")], "doc_id long, norm string")
    got = overlap.resolve(scan.scanned_spans(d, terms)).collect()
    assert sorted((r["doc_id"], r["start"], r["term_id"]) for r in got) == [(0, 0, 0), (0, 15, 2), (1, 4, 3)]
    with pytest.raises(PatternError):
        scan.finders([P("x", "puffery", "(")])
    many = [P(f"t{i}", "puffery", f"w{i}") for i in range(200)]
    found = scan.scanned_spans(spark.createDataFrame([(0, "w7 w70 w199 w200")], "doc_id long, norm string"), many).collect()
    assert sorted((r["start"], r["len"], r["term_id"]) for r in found) == [(0, 2, 7), (3, 3, 70), (7, 4, 199)]


def test_a_wildcard_that_fits_too_much_is_reported(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "MAX_WILDCARD", 3)
    d = docs(spark, "the then there these thus of them")
    terms = with_added([P("of", "puffery", "of")], ["th*", "the*n|of"])
    compiled = compile_terms(terms, match.vocabulary(d))
    raw = match.spans(d, compiled)
    got = {r["term"]: tuple(r)[1:] for r in sparse.added_word_stats(raw, overlap.resolve(raw), terms_frame(spark, terms), compiled.errors).collect()}
    assert got == {"th*": (0, 0, 0, "fits more than 3 words"), "the*n|of": (2, 1, 1, None)}
    assert [r["words"] for r in raw.where("term_id = 2").orderBy("start").collect()] == [["then"], ["of"]]


def test_tokens_at_the_edges(spark):
    texts = ["", " ", "...", "-a-", "a", "; a ;b-;-c.", "a&;&b", "é", "aéb", None, "@a@ @", "x -, y -- z"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", X.tokens(F.col("s")).alias("t")).collect()
    assert [r["t"] for r in sorted(rows)] == [[], [], [], ["a"], ["a"], ["a", "@", "b", "@", "c"], ["a", "@", "b"], [], ["a", "@", "b"], None, ["a"], ["x", "@", "y", "z"]]


def test_wildcards_that_fit_any_number_of_words(spark, monkeypatch):
    d = docs(spark, "the then there. these of thus of the thing_x thing things", "of them with the", None, "")
    terms = [P("the", "puffery", "the"), P("w", "hedge", "the|th*|t*e th*|of", "plain"), P("x", "hedge", "of th*|the", "plain"), P("y", "hedge", "*s", "plain")]
    listed = compile_terms(terms, match.vocabulary(d))
    monkeypatch.setattr(lexicon, "MAX_WILDCARD", 1)  # no limit holds for words that are not listed
    kept = compile_terms(terms)
    assert not kept.errors and not any("*" in tok for _, _, _, tok, _ in kept.places)
    got = sorted(map(tuple, match.spans(d, kept).drop("words").collect()))
    assert got == sorted(map(tuple, match.spans(d, listed).drop("words").collect())) and len(got) == 13
    assert compile_terms([P("only", "hedge", "th*", "plain")]).places == []
    only = match.spans(d, compile_terms([P("only", "hedge", "th*", "plain")]))
    assert only.count() == 10


def test_a_term_that_cannot_be_used_raises_in_queries():
    from lexiflux.plans import catalogue

    with pytest.raises(PatternError, match="x: "):
        catalogue.raw_spans(None, None, [P("x", "puffery", "a+")])


def test_words_by_company_without_shuffling_tokens(spark):
    d = docs(spark, "the plan plan the", "plan the plan", "other plan").withColumn("doc_kind", F.when(F.col("doc_id") == 1, "page").otherwise(F.when(F.col("doc_id") == 0, "main")))
    used = d.where("doc_id <> 1").select("doc_id", "symbol", "doc_kind")  # the last has no kind
    slot = spark.createDataFrame([("s0", 0), ("s2", 1)], "symbol string, slot long")
    kept = match.spans(d, compile_terms([P("p", "puffery", "plan the")]))
    out = sparse.word_vectors(d, kept, used, slot)
    assert sorted(map(tuple, out.collect())) == [("plan", "0:2,1:1", "0:1,1:1", 1)]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sparse.word_vectors(d, kept, used, slot)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert re.search(r"BroadcastHashJoin \[symbol#", plan)


def test_only_tokens_that_may_begin_a_term_get_their_neighbours(spark, monkeypatch):
    d = docs(spark, "one of the best of them", "that the of that. thing_x things the", None, "")
    terms = [P("a", "puffery", "(?<!of )that|of the"), P("b", "hedge", "the"), P("c", "hedge", "thing*", "plain"), P("e", "hedge", "best of(?! the)")]
    got = match.spans(d, compile_terms(terms))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Filter \(isnotnull\(t0#\d+\) AND [^\n]*\n[^\n]*Generate posexplode\(toks", plan) and "arrays_zip" not in plan
    want = sorted(map(str, got.collect()))
    assert len(want) == 7
    monkeypatch.setattr(match, "MAX_HEADS", 2)  # beginnings of words stand for them then
    assert sorted(map(str, match.spans(d, compile_terms(terms)).collect())) == want


def test_counts_do_not_shuffle_the_words_of_spans(spark):
    from lexiflux.plans import catalogue

    plan = catalogue.counted(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "AS words" not in plan


def test_one_span_of_each_start_is_gathered(spark):
    rows = [(0, 0, n, n, t) for n in (1, 2, 3) for t in range(5)] + [(0, 2, 4, 2, 0), (0, 3, 4, 1, 7), (0, 3, 4, 1, 7)]
    kept = overlap.resolve(spark.createDataFrame(rows, "doc_id long, start int, end int, len int, term_id int"))
    assert sorted((r["start"], r["len"], r["term_id"]) for r in kept.collect()) == [(0, 3, 0), (3, 1, 7)]
    assert "_same" in kept._jdf.queryExecution().optimizedPlan().toString()


def test_terms_are_counted_in_one_pass_as_spans_are_resolved(spark):
    from lexiflux.operators import score, tally

    rng = random.Random(11)
    words = ["the", "of", "and", "in", "that", "thing", "things", "thing_x", "other", "x", "th", "3", "_"]
    gaps = [" ", " ", " ", "  ", "-", "'", "’", " & ", ", ", ".", " @ ", "\n", "-\n", "—", "é", " é ", "\t", " "]
    texts = ["".join(w + rng.choice(gaps) for w in rng.choices(words, k=rng.randint(0, 40))) for _ in range(300)]
    texts += ["the " * 30_000, "of the-" * 9_000 + "that", "", None, " the", "the", "@the@", "é the"]
    terms = [
        P("a", "puffery", "the"), P("b", "hedge", "of the|and"), P("c", "hedge", "of the"), P("d", "puffery", "(?<!of )(?<!and in )that(?! the)(?! of that)"), P("e", "hedge", "that"),
        P("f", "hedge", "thing*", "plain"), P("g", "hedge", "the|th* *ing", "plain"), P("h", "hedge", "the of and"), P("i", "hedge", "of|th* that|thing*", "plain"), P("j", "hedge", "(?:in )?things?"),
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", X.normalise(F.col("text"), composed=False).alias("norm"))
    for some in (terms, terms[:5], terms[5:7], [P("o", "hedge", "nothing")]):
        compiled = compile_terms(some)
        want = score.counts(overlap.resolve(match.spans(d.select("doc_id", X.tokens(F.col("norm")).alias("toks")), compiled)))
        got = tally.unfolded(d.select("doc_id", tally.tally(spark, F.col("norm"), compiled).alias("terms")))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    twice = tally.unfolded(d.where("norm = 'the'").union(d.where("norm = 'the'")).select("doc_id", tally.tally(spark, F.col("norm"), compile_terms(terms)).alias("terms")))
    assert [r["n"] for r in twice.collect()] == [2]


def test_terms_are_counted_without_a_row_for_each_token_and_texts_read_once(spark):
    from lexiflux.plans import catalogue

    data = "/root/testdata/sf0.001"
    plan = catalogue.counted(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "Window" not in plan and plan.count("Scan parquet") == 1
    for name in ("doc_scores", "company_top_terms", "sources_all", "term_density_by_source", "doc_full_rows", "company_all_terms", "scan_agreement"):
        plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "text#" not in plan, name  # what the pass over the texts found is kept


def test_scanning_for_all_terms_at_once_finds_what_each_finds(spark):
    from lexiflux.operators import score

    rng = random.Random(5)
    texts = ["".join(rng.choice(["the", "of", "and", "a", "aa", "that"]) + rng.choice([" ", " ", ", ", "-", "é"]) for _ in range(rng.randint(0, 30))) for _ in range(200)] + ["", None]
    terms = [P("a", "hedge", "the"), P("b", "hedge", "(?<!of )that|of the"), P("c", "hedge", "a|"), P("d", "hedge", r"(a)\1"), P("e", "hedge", "(?i:THE) (?:of|and the)"), P("f", "hedge", "the.{0,9}the"), P("g", "hedge", "a+(?= )")]
    patterns = scan.finders(terms)
    joined = scan._joined(patterns)
    assert joined[1] == [0, 1, 4, 5, 6]
    for t in texts:
        each = [(m.start(), m.end(), i) for i, p in enumerate(patterns) for m in p.finditer(t or "") if m.end() > m.start()]
        assert sorted(scan._found(t or "", patterns, joined)) == sorted(each)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, norm string")
    want = score.counts(overlap.resolve(scan.scanned_spans(d, terms)))
    got = d.select("doc_id", F.explode(scan.scanned_counts(spark, F.col("norm"), terms)).alias("c")).select("doc_id", "c.*")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_texts_of_one_row_group_are_dealt_out(spark, tmp_path):
    from lexiflux.plans import catalogue

    rows = [(None if i % 2 else i, f"of the {i}", "en", "src7", 8) for i in range(2000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.coalesce(1).write.parquet(f"{tmp_path}/one/documents.parquet")
    d.repartition(8).write.parquet(f"{tmp_path}/many/documents.parquet")
    texts = catalogue.documents(spark, f"{tmp_path}/one")
    held = [r["count"] for r in texts.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 2000 and max(held) <= 2000 / 4
    even = catalogue.documents(spark, f"{tmp_path}/many")
    assert "Exchange" not in even._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, texts.collect())) == sorted(map(str, even.collect()))
    docs, hits = catalogue.stats_and_counts(spark, f"{tmp_path}/one")
    assert docs.count() == 2000 and hits.agg(F.sum("n")).first()[0] == 1000  # a document without an id has no text
    assert "Exchange" not in catalogue.names(spark, f"{tmp_path}/one")._jdf.queryExecution().executedPlan().toString()
