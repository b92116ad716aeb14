import json
import re

from pyspark.sql import functions as F

from lexiflux import cli
from lexiflux.operators.lexicon import Term, compile_terms
from lexiflux.sources import readers, sinks
from lexiflux.streaming import incremental

import pytest

LEXICON = "label\ttier\tweight\tpattern\tsyntax\nthe\tpuffery\t1.0\tthe\t\n#no\tpuffery\t1\tx\t\nbold*\thedge\t2\tbold*\tplain\n"


@pytest.fixture
def corpus(tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir()
    two.mkdir()
    (one / "AA__main_1.txt").write_text("The bold plan. The bolder plan, " + "word " * 30)
    (two / "AA__main_1.txt").write_text("other")
    (two / "BB__page_0.txt").write_text("the page of 5 tonnes in 2021")
    (tmp_path / "lex.tsv").write_text(LEXICON)
    (tmp_path / "companies.csv").write_text("symbol,company,website,sector\r\nAA,Alpha,alpha.com,X\r\nBB,Beta,,Y\r\nAA,Alpha Two,alpha.com,X\r\n")
    return tmp_path


def test_readers(spark, corpus):
    rows = {r["file"]: r for r in readers.text_folders(spark, [str(corpus / "one"), str(corpus / "two")]).collect()}
    assert len(rows) == 2 and rows["AA__main_1.txt"]["text"].startswith("The bold")
    assert (rows["BB__page_0.txt"]["symbol"], rows["BB__page_0.txt"]["doc_kind"], rows["BB__page_0.txt"]["doc_num"]) == ("BB", "page", "0")
    assert [(t.label, t.syntax, t.weight) for t in readers.lexicon(spark, str(corpus / "lex.tsv"))] == [("the", "regex", 1.0), ("bold*", "plain", 2.0)]
    assert {r["symbol"]: r["company"] for r in readers.companies(spark, str(corpus / "companies.csv")).collect()} == {"AA": "Alpha Two", "BB": "Beta"}
    assert {r["company"] for r in readers.companies(spark, str(corpus / "companies.csv"), last=False).collect()} == {"Alpha", "Beta"}


def test_command_line(spark, corpus, capsys):
    base = ["--index", str(corpus / "index"), "--lexicon", str(corpus / "lex.tsv"), "--companies", str(corpus / "companies.csv")]
    cli.main([*base, "build", "--txt-dir", str(corpus / "one"), "--txt-dir", str(corpus / "two")], spark)
    capsys.readouterr()
    run = lambda *a: (cli.main([*base, *a], spark), json.loads(capsys.readouterr().out))[1]
    board = run("board", "--min-words", "1", "--json", "--add", "plan")
    assert {r["symbol"]: r["buzzword_hits"] for r in board["rows"]} == {"AA": 6, "BB": 1}
    assert board["added"] == [{"term": "plan", "corpus_hits": 2, "new_hits": 2, "already_counted": 0}]
    assert run("lookup", "alpha two", "--min-words", "1", "--json")["company"][0]["rank"] == 2
    found = run("find", "bold*", "--json")
    assert found["total_hits"] == 2 and found["examples"][0]["hit"] in ("bold", "bolder")
    assert [t["n"] for t in run("terms", "--json")["tiers"]] == [1, 1, 0, 0]
    cli.main([*base, "export", str(corpus / "out"), "--by", "report"], spark)
    assert spark.read.csv(str(corpus / "out"), header=True).count() == 2
    with pytest.raises(SystemExit):
        cli.main([*base, "find", "(", "--regex"], spark)


def test_sinks(spark, corpus):
    rows = spark.createDataFrame([("a", ["x", "y"])], "k string, v array<string>")
    sinks.write_csv(rows, str(corpus / "csv"))
    assert spark.read.csv(str(corpus / "csv"), header=True).collect()[0]["v"] == "x; y"
    sinks.write_lexicon(spark, [Term("a", "hedge", "(?:a|b) c")], str(corpus / "lexicon"))
    assert readers.lexicon(spark, str(corpus / "lexicon"))[0].pattern == "(?:a|b) c"
    c = spark.createDataFrame([("A", "Alpha", 10, 1, 0), ("B", "Beta", 20, 2, 1)], "symbol string, company string, words long, substance long, slot long")
    t = spark.createDataFrame([(0, "the", "puffery", 1.0, "0:1")], "term_id int, label string, tier string, weight double, c string")
    w = spark.createDataFrame([("plan", "0:2", None, 0), ("bold", "0:2", "0:1", 1)], "token string, c string, n string, overlap long")
    sinks.page_script(c, t, w, str(corpus / "js"), "PAGE", "2020-01-01")
    text = "".join(p.read_text() for p in (corpus / "js").glob("part-*"))
    payload = json.loads(re.fullmatch(r"window.PAGE = (.*);\n?", text)[1])
    assert payload["companies"] == ["A", "B"] and payload["overlap"] == {"bold": 1} and payload["vocab"]["bold"]["n"] == "0:1"


def test_cache_and_stream(spark, corpus):
    docs = spark.createDataFrame([("a.txt", "x y"), ("b.txt", "z")], "file string, text string")
    seen = []

    def score(d):
        seen.append(d.count())
        return d.select("file", F.length("text").alias("n"))

    assert sinks.cached_scores(docs.limit(1), "lex", str(corpus / "cache"), score).count() == 1
    assert sinks.cached_scores(docs, "lex", str(corpus / "cache"), score).count() == 2
    assert sinks.cached_scores(docs, "other", str(corpus / "cache"), score).count() == 2
    assert seen == [1, 1, 2]
    spark.createDataFrame([(1, "the plan"), (2, "no")], "doc_id long, text string").write.parquet(str(corpus / "in"))
    q = incremental.stream(spark, str(corpus / "in"), str(corpus / "scored"), str(corpus / "state"), compile_terms([Term("the", "puffery", "the")]))
    q.awaitTermination(60)
    assert {r["doc_id"]: r["hits"] for r in spark.read.parquet(str(corpus / "scored")).collect()} == {1: 1, 2: 0}
