import pytest

from lexiflux.functions import html as H
from lexiflux.operators import company, score
from pyspark.sql import functions as F

DOCS = [(0, "A", "page", 10), (1, "A", "main", 20), (2, "B", "page", 30), (3, "C", "data", 40), (4, "C", "", 5)]


@pytest.mark.parametrize(("policy", "ids"), [("auto", [1, 2, 3, 4]), ("reports", [1, 3, 4]), ("pages", [0, 2]), ("main", [1]), ("all", [0, 1, 2, 3, 4]), ("other", [1, 2, 3, 4])])
def test_policy(spark, policy, ids):
    d = spark.createDataFrame(DOCS, "doc_id long, symbol string, doc_kind string, n_words long")
    assert sorted(r["doc_id"] for r in company.chosen(d, policy).collect()) == ids


def test_percentile_and_quintiles(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 2.0)], "doc_id long, buzzwords_per_1000_words double")
    assert [r["density_percentile"] for r in score.percentile(rows).orderBy("doc_id").collect()] == [0.0, 50.0, 100.0]
    assert [r["density_percentile"] for r in score.percentile(rows.limit(1)).collect()] == [0.0]
    assert score.percentile(rows.limit(0)).collect() == []
    c = spark.createDataFrame([(f"s{i:02}", float(i)) for i in range(12)], "symbol string, buzzwords_per_1000_words double")
    assert [r["quintile"] for r in company.quintiles(c).orderBy("symbol").collect()] == [1, 1, 1, 2, 2, 2, 3, 3, 4, 4, 5, 5]


def test_resolve_and_board(spark):
    c = spark.createDataFrame([("AAPL", "Apple", "apple.com"), ("NKE", "Nike", "nike.com"), ("BAC", "Bank of X", None)], "symbol string, company string, website string")
    got = {r["query"]: (r["symbol"], r["fit"]) for r in company.resolve(c, ["nike.com", "aapl", "bank of", "ppl", "zzz"]).collect()}
    assert got == {"nike.com": ("NKE", 1), "aapl": ("AAPL", 0), "bank of": ("BAC", 4), "ppl": ("AAPL", 5)}
    rows = spark.createDataFrame([("a", 3000, None), ("b", 3000, 1.5), ("c", 10, 9.0)], "symbol string, total_words long, buzzwords_per_substance_hit double")
    assert [r["symbol"] for r in company.board(rows, "buzzwords_per_substance_hit").collect()] == ["b", "a"]
    assert [r["symbol"] for r in company.board(rows, "buzzwords_per_substance_hit", reverse=True).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        company.board(rows, "nothing")


def test_pages(spark):
    assert H.html_text('<nav>Menu</nav><div class="shareholder">x</div><p>Hello <b>world</b></p><script>x</script>&amp;') == "Hello\nworld\n&"
    d = spark.createDataFrame([(1, "Menu\nMenu\n menu \nMenu\nAccept all cookies\nProse of five words here\n\nProse of five words here\nProse of five words here"), (2, None), (3, "")], "page_id long, t string")
    got = {r["page_id"]: r["text"] for r in H.without_navigation(d.select("page_id", H.clean_lines(F.col("t")).alias("lines")), "page_id", "lines").collect()}
    assert got[1].split("\n") == ["Menu", "Menu"] + ["Prose of five words here"] * 3
    assert got[2] == "" and got[3] == ""
    b = spark.createDataFrame([(bytearray(b"  %PDF-1.7"),), (bytearray(b"<html>"),)], "c binary")
    assert [r[0] for r in b.select(H.sniffed(F.col("c"))).collect()] == ["pdf", "html"]
    parsed = H.page_text(spark.createDataFrame([(1, "<p>a</p>"), (2, None)], "page_id long, html string"))
    assert [r["text"] for r in parsed.orderBy("page_id").collect()] == ["a", None]


def test_documents_are_not_dealt_by_company(spark):
    from lexiflux.operators.lexicon import Term, terms_frame

    docs = spark.createDataFrame(
        [(1, "a", "main", 10, 1, 0), (2, "a", "page", 20, 1, 0), (3, "b", "page", 30, 0, 0), (4, None, "main", 40, 0, 0), (5, None, "page", 50, 0, 0), (6, "c", None, 60, 0, 0), (7, "d", "data", 70, 0, 0), (8, "d", "page", 80, 0, 0), (9, "d", None, 90, 0, 0)],
        "doc_id long, symbol string, doc_kind string, n_words long, quantity_hits long, year_hits long",
    )
    counted = spark.createDataFrame([(i, 0, i) for i in (1, 2, 3, 4, 5, 6, 8, 9)], "doc_id long, term_id int, n long")
    terms = terms_frame(spark, [Term("t", "puffery", "t")])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, named = company.rollup(docs, counted, terms), company.all_terms(docs, counted, terms)
        for df in (rows, named):
            plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
            depth = [len(x) - len(x.lstrip(" :+-")) for x in plan]
            for i, x in enumerate(plan):
                if "Exchange hashpartitioning(symbol" in x:
                    below = next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))
                    assert any("Aggregate" in y for y in plan[i + 1 : below]), x
        got = {r["symbol"]: (r["n_docs"], r["doc_kinds"], r["total_words"], r["buzzword_hits"], r["top_terms"]) for r in rows.collect()}
        # a company's pages do not count beside a report, even one without hits; nor does what has no kind
        assert got == {"a": (1, "main", 10, 1, "t:1"), "b": (1, "page", 30, 3, "t:3"), None: (2, "main; page", 90, 0, ""), "c": (1, "", 60, 6, "t:6"), "d": (1, "data", 70, 0, "")}
        assert dict(map(tuple, named.collect())) == {"a": "t:1", "b": "t:3", None: "", "c": "t:6", "d": ""}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
