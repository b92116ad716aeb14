"""Readers. All paths go to Spark's own readers, so that any store they can open will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiflux.functions.html import sniffed
from lexiflux.operators.lexicon import TIERS, PatternError, Term

COMPANY_SCHEMA = "symbol string, company string, website string, sector string"
YEARS_COLUMNS = ("Years to 0 Profit (All)", "Years to 0 Profit (CO2 only)", "Years to 0 Profit (Water only)", "Years to 0 Profit (Electricity only)")


def text_folders(spark: SparkSession, folders: list[str]) -> DataFrame:
    """file, text, symbol, doc_kind, doc_num of every *.txt; where two folders have a file of one name the first folder's counts.

    A folder that is missing is an error of the reader. Bytes that are not UTF-8 become replacement characters.
    """
    found = None
    for rank, folder in enumerate(folders):
        t = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
        t = t.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.decode("content", "UTF-8").alias("text"), F.lit(rank).alias("_rank"))
        found = t if found is None else found.unionByName(t)
    first = found.groupBy("file").agg(F.min("_rank").alias("_rank"))
    return found.join(first, ["file", "_rank"]).drop("_rank").transform(with_identity)


def with_identity(docs: DataFrame) -> DataFrame:
    """docs (file) with symbol, doc_kind, doc_num of names like SYMBOL__kind_num.txt; parts that are missing are empty."""
    stem = F.regexp_replace("file", r"\.txt$", "")
    part = lambda i: F.regexp_extract(stem, r"^(.*?)(?:__([^_]*)(?:_(.*))?)?$", i)
    return docs.withColumns({"symbol": part(1), "doc_kind": part(2), "doc_num": part(3)})


def lexicon_rows(spark: SparkSession, path: str) -> DataFrame:
    """label, tier, weight, pattern, syntax, row of a tab-separated lexicon; rows without label or with '#' before it are skipped."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE")
    syntax = F.coalesce(F.nullif(F.trim("syntax"), F.lit("")), F.lit("regex")) if "syntax" in raw.columns else F.lit("regex")
    weight = F.coalesce(F.col("weight").try_cast("double"), F.lit(1.0)) if "weight" in raw.columns else F.lit(1.0)
    rows = raw.withColumn("row", F.monotonically_increasing_id())
    return rows.select("label", "tier", weight.alias("weight"), "pattern", syntax.alias("syntax"), "row").where("label IS NOT NULL AND label <> '' AND NOT label LIKE '#%'")


def lexicon(spark: SparkSession, path: str) -> list[Term]:
    """A lexicon's terms in order of the file. It comes to the driver, where patterns are expanded."""
    return [Term(r["label"], r["tier"], r["pattern"], r["syntax"], r["weight"]) for r in lexicon_rows(spark, path).orderBy("row").collect()]


def strict_lexicon(spark: SparkSession, path: str) -> list[Term]:
    """The same for the scan, which takes every pattern as a regular expression; raises on what it cannot take."""
    terms = [Term(t.label, t.tier, t.pattern.lower(), "regex", t.weight) for t in _checked(lexicon(spark, path))]
    if not terms:
        raise PatternError("the lexicon has no terms")
    return terms


def _checked(terms: list[Term]) -> list[Term]:
    import re

    for t in terms:
        if t.tier not in TIERS:
            raise PatternError(f"{t.label}: no such tier: {t.tier}")
        if re.search(r"\\[A-Z]", t.pattern):
            raise PatternError(f"{t.label}: an escape with a capital letter would change its sense in lower case")
    return terms


def companies(spark: SparkSession, path: str, last: bool = True) -> DataFrame:
    """symbol, company, website, sector; of rows with one symbol the last (or first) of the file."""
    raw = spark.read.csv(path, header=True)
    name = "symbol" if "symbol" in raw.columns else "Symbol"
    blank = F.lit("").cast("string")
    columns = {c.lower(): c for c in raw.columns}
    rows = raw.select(F.col(name).alias("symbol"), *((F.regexp_replace(F.col(columns[c]), "\r$", "") if c in columns else blank).alias(c) for c in ("company", "website", "sector")))
    rows = rows.where("symbol IS NOT NULL AND symbol <> ''").withColumn("_row", F.monotonically_increasing_id())
    pick = F.max_by if last else F.min_by
    return rows.groupBy("symbol").agg(*(pick(F.coalesce(c, F.lit("")), "_row").alias(c) for c in ("company", "website", "sector")))


def impact_years(spark: SparkSession, path: str) -> DataFrame:
    """ticker, company, and (years, censored) for each of the four columns; '> 140' is 140, censored."""
    from lexiflux.functions.text import censored_years

    raw = spark.read.csv(path, header=True)
    names = ("years_all", "years_co2", "years_water", "years_electricity")
    return raw.select(F.col(raw.columns[0]).alias("ticker"), F.col(raw.columns[1]).alias("company"), *(censored_years(F.col(f"`{c}`")).alias(n) for c, n in zip(raw.columns[2:6], names, strict=True)))


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """stem, file, slot, kind, content of page captures; of a stem's .htm and .html the later name counts. kind is read from the bytes."""
    raw = spark.read.format("binaryFile").load(folder).withColumn("file", F.element_at(F.split("path", "/"), -1))
    raw = raw.where(F.col("file").rlike(r"(?i)\.(html?|pdf)$"))
    slot = F.when(F.lower("file").endswith(".pdf"), "pdf").otherwise("html")
    rows = raw.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("stem"), "file", slot.alias("slot"), sniffed(F.col("content")).alias("kind"), "content")
    order = Window.partitionBy("stem", "slot").orderBy(F.col("file").desc())
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def missing_texts(pdfs: DataFrame, texts: DataFrame) -> DataFrame:
    """The captures (file) without a text (file) of the same stem."""
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    return pdfs.withColumn("_stem", stem).join(texts.select(stem.alias("_stem")), "_stem", "left_anti").drop("_stem")
