"""Writers: lexicons, result tables, JSON, the page's script, the score cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflux.functions.text import lexicon_key
from lexiflux.operators.lexicon import TIERS, Term, terms_frame


def write_lexicon(spark, terms: list[Term], path: str) -> None:
    """label, tier, weight, pattern, syntax, by tabs, in the terms' order; one file, for a lexicon is short."""
    rows = terms_frame(spark, terms).orderBy("term_id").select("label", "tier", "weight", "pattern", "syntax")
    rows.coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True, quote="")


def write_csv(rows: DataFrame, path: str) -> None:
    """A result table with a header; arrays become lists by '; '."""
    flat = [F.array_join(c, "; ").alias(c) if kind == "array<string>" else F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").csv(path, header=True)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def data_uri(content, kind: str = "image/svg+xml"):
    """A binary column as a data URI."""
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(content))


def page_script(companies: DataFrame, terms: DataFrame, words: DataFrame, path: str, name: str = "LEXIFLUX", built: str = "", art: list[str] | None = None) -> None:
    """Writes `window.NAME = {...};` for a page that scores in the browser.

    companies: symbol, company, words, substance, slot; terms: term_id, label, tier, weight, c; words: token, c, n,
    overlap. A browser loads the file whole, so it is put together as one row; terms and words are sorted before.
    """
    listed = lambda df, c, by: df.agg(F.array_sort(F.collect_list(F.struct(by, c))).alias("x")).select(F.transform("x", lambda s: s[c]).alias(c))
    one = companies.sparkSession.range(1).select(F.lit(built).alias("built"), F.array(*map(F.lit, art or [])).cast("array<string>").alias("art"), F.array(*map(F.lit, TIERS)).alias("tiers"))
    for c, to in (("symbol", "companies"), ("company", "names"), ("words", "words"), ("substance", "substance")):
        one = one.crossJoin(listed(companies, c, "slot").withColumnRenamed(c, to))  # one row with one row
    t = terms.select("term_id", F.struct("label", "tier", "weight", "c").alias("terms"))
    one = one.crossJoin(listed(t, "terms", "term_id"))
    one = one.crossJoin(words.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", F.struct("c", "n"))))).alias("vocab")))
    one = one.crossJoin(words.where("overlap > 0").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "overlap")))).alias("overlap")))
    one.select(F.concat(F.lit(f"window.{name} = "), F.to_json(F.struct("*")), F.lit(";")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def cached_scores(docs: DataFrame, lexicon: str, path: str, score) -> DataFrame:
    """Scores of docs (file, ...) with a cache under path by the lexicon's key.

    Files that the cache has for this lexicon are not scored again; another lexicon starts a cache of its own. score
    maps a DataFrame of documents to rows with a file. New rows are appended before all are read back.
    """
    spark = docs.sparkSession
    key = spark.range(1).select(lexicon_key(F.lit(lexicon)).alias("k")).first()["k"]
    own = f"{path}/lexicon_key={key}"
    try:
        known = spark.read.parquet(own).select("file")
    except Exception as e:  # nothing cached yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        known = None
    todo = docs if known is None else docs.join(known, "file", "left_anti")
    score(todo).write.mode("append").parquet(own)
    return spark.read.parquet(own).join(docs.select("file"), "file", "left_semi")
