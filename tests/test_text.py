import pytest
from pyspark.sql import functions as F

from lexiflux.functions import text as X

MICRO = [
    ("net-zero", ["net", "zero"]), ("net zero", ["net", "zero"]), ("positive. Impact", ["positive", "@", "impact"]), ("don't", ["don", "t"]), ("DE&I", ["de", "i"]),
    ("FY24ESG a_b", ["fy24esg", "a_b"]), ("café culture", ["caf", "@", "culture"]), ("...hi...", ["hi"]), ("x -, y", ["x", "@", "y"]), ("", []), ("?!.", []), ("sustain-\nability", ["sustainability"]),
]


def one(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["x"] for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_tokens(spark):
    got = one(spark, X.tokens(X.normalise(F.col("t"))), *(t for t, _ in MICRO))
    assert got == [x for _, x in MICRO]
    assert one(spark, X.tokens(X.normalise(F.col("t"))), None) == [None]


@pytest.mark.parametrize(("text", "compat", "fixed"), [("12 kg", 1, 1), ("$ 5", 1, 1), ("45% of", 0, 1), ("45%.", 0, 1), ("5%x", 1, 1), ("1,200.5 tonnes", 1, 1), ("none", 0, 0)])
def test_quantities(spark, text, compat, fixed):
    n = X.normalise(F.col("t"))
    assert one(spark, X.quantity_count(n), text) == [compat]
    assert one(spark, X.quantity_count(n, True), text) == [fixed]


def test_counts_and_ratios(spark):
    n = X.normalise(F.col("t"))
    assert one(spark, X.year_count(n), "in 2021, FY2021, 1899") == [1]
    assert one(spark, X.word_count(n), "Page 12 we're 3rd-party") == [3]
    assert one(spark, X.nfkc(F.col("t")), "ﬁn", None) == ["fin", None]
    df = spark.createDataFrame([(5, 0), (5, 200)], "h long, w long")
    assert [r[0] for r in df.select(X.per_thousand(F.col("h"), F.col("w"))).collect()] == [0.0, 25.0]
    assert [r[0] for r in df.select(X.ratio(F.col("h"), F.col("w"), 3)).collect()] == [None, 0.025]
    assert [tuple(r) for r in one(spark, X.censored_years(F.col("t")), "37", "> 140", "", None)] == [(37, False), (140, True), (None, None), (None, None)]
    assert len(one(spark, X.lexicon_key(F.col("t")), "a")[0]) == 16


def test_tokens_of_odd_texts(spark):
    texts = ["‐a‒b―c’d", "a‖b", "a b", "—!a!—", "漢字" * 3000, "漢 a 字", "a" * 50_000 + "!" * 50_000, "x\x0by", "a‖―b", "@", "a @ b", "a-\nb-\nc", "a-b\nc - \n d"]
    got = one(spark, X.tokens(X.normalise(F.col("t"))), *texts)
    assert got == [["a", "b", "c", "d"], ["a", "@", "b"], ["a", "b"], ["a"], [], ["a"], ["a" * 50_000], ["x", "y"], ["a", "@", "b"], [], ["a", "@", "b"], ["ab", "c"], ["a", "b", "c", "d"]]


def test_classes_of_tokens_have_no_ranges_below_256():
    assert "a-z" not in X._LETTERS and set(X._LETTERS) == set("_0123456789abcdefghijklmnopqrstuvwxyz")


def test_blanks_and_counts_as_by_the_plain_patterns(spark):
    blanks = [" ", "\t", "\n", "\x0b", "\f", "\r", "\x85", "\xa0", " ", " ", " ", " ", "　"]
    texts = ["", " ", "  ", *(f"A{b}b" for b in blanks), *(f"{b} x{b}{b}y {b}" for b in blanks), "\x1cé ​ Z", "12 kg$ 5 of 2021 20211 it's -a- '", None]
    n = X.normalise(F.col("t"), composed=False)
    assert one(spark, n, *texts) == one(spark, F.lower(F.regexp_replace("t", r"(?U)\s+", " ")), *texts)
    for counted, pattern in ((X.word_count, "[a-z][a-z'-]*"), (X.quantity_count, X.quantity_pattern()), (X.year_count, X.YEAR)):
        assert one(spark, counted(F.col("t")), *texts) == one(spark, F.regexp_count("t", F.lit(pattern)).cast("long"), *texts)


def test_words_are_counted_without_a_list_of_them(spark):
    plan = spark.createDataFrame([("a b",)], "t string").select(X.word_count(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
