"""Finding terms in token streams."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflux.operators.lexicon import Compiled, fitting

# Fixed value: how many first words, or beginnings of them, a token is compared with before the join.
MAX_HEADS = 500


def spans(docs: DataFrame, compiled: Compiled, key: str = "doc_id", tokens: str = "toks") -> DataFrame:
    """key, start, end, len, term_id, words: every occurrence of every variant, overlaps included; places count from 0 in a document.

    Each token is a row for as long as it takes to see whether it can begin a term; only one that can gets the tokens
    around it, as many as the longest variant has words. The token array is read where it lies: explosion, filter and
    look-up are one generated step, so that it is not copied for a row. The lexicon's places are broadcast: they are a
    driver-side list. The first word is joined, the others only filter what it left. A token that fits a wildcard is kept
    beside those that are joined, so that no list of fitting words is made. words, the tokens of the span, travel with it.
    The generator is the outer one: of the other Spark would infer a filter on the size of the array, and make the tokens
    a second time for it.
    """
    spark = docs.sparkSession
    n_before = max((len(s) for ss in compiled.before.values() for s in ss), default=0)
    n_after = max((len(s) for ss in compiled.after.values() for s in ss), default=0)
    wide = compiled.longest + n_after
    begun = docs.select(key, F.col(tokens).alias("_toks"), F.posexplode_outer(tokens).alias("start", "t0")).where(F.col("t0").isNotNull() & _may_begin(F.col("t0"), compiled))
    rows = begun.select(
        key, "start", "t0", *(F.get("_toks", F.col("start") + i).alias(f"t{i}") for i in range(1, wide)),
        *(F.get("_toks", F.col("start") - i).alias(f"b{i}") for i in range(1, n_before + 1)),
    )
    places = spark.createDataFrame(compiled.places, "term_id int, variant int, pos int, tok string, len int")
    hits = _starts(rows, compiled)
    for i in range(1, compiled.longest):
        other = places.where(F.col("pos") == i).select("variant", F.col("tok").alias(f"t{i}"), F.lit(True).alias("fits"))
        fits = F.expr(f"len <= {i} OR fits")
        for _, variant, pos, alternatives, _ in compiled.patterns:
            if pos == i:
                fits = fits | ((F.col("variant") == variant) & fitting(F.col(f"t{i}"), alternatives))
        hits = hits.join(F.broadcast(other), ["variant", f"t{i}"], "left").where(fits).drop("fits")
    for side, seqs in (("before", compiled.before), ("after", compiled.after)):
        for term, forbidden in seqs.items():
            for s in forbidden:
                if side == "before":
                    meets = [F.col(f"b{len(s) - i}") == w for i, w in enumerate(s)]
                else:
                    next_ = F.array(*(F.col(f"t{i}") for i in range(wide)))
                    meets = [F.get(next_, F.col("len") + i) == w for i, w in enumerate(s)]
                together = meets[0]
                for m in meets[1:]:
                    together = together & m
                hits = hits.where((F.col("term_id") != term) | ~F.coalesce(together, F.lit(False)))
    words = F.slice(F.array(*(F.col(f"t{i}") for i in range(compiled.longest))), F.lit(1), F.col("len"))
    return hits.select(key, "start", (F.col("start") + F.col("len")).alias("end"), "len", "term_id", words.alias("words"))


def _may_begin(token: Column, compiled: Compiled) -> Column:
    """False only of tokens that begin no variant. Of more than MAX_HEADS first words their beginnings are compared; the join decides."""
    words = {tok for _, _, pos, tok, _ in compiled.places if pos == 0}
    for n in (max(map(len, words), default=1), 4, 3, 2, 1):
        heads = sorted({w[:n] for w in words})
        if len(heads) <= MAX_HEADS:
            break
    fits = [fitting(token, alternatives) for _, _, pos, alternatives, _ in compiled.patterns if pos == 0]
    return reduce(or_, fits, (token if set(heads) == words else F.substring(token, 1, n)).isin(heads))


def _starts(rows: DataFrame, compiled: Compiled) -> DataFrame:
    """rows with term_id, variant and len of every variant that their token t0 may begin."""
    spark, patterns = rows.sparkSession, [p for p in compiled.patterns if p[2] == 0]
    ids = "array<struct<term_id: int, variant: int, len: int>>"
    listed: dict[str, list[tuple[int, int, int]]] = {}
    for term, variant, pos, tok, n in compiled.places:
        if pos == 0:
            listed.setdefault(tok, []).append((term, variant, n))
    begun = rows.join(F.broadcast(spark.createDataFrame(list(listed.items()), f"t0 string, listed {ids}")), "t0", "left" if patterns else "inner")
    both = F.col("listed")
    if patterns:
        fits = [fitting(F.col("t0"), alternatives) for *_, alternatives, _ in patterns]
        begun = begun.where(reduce(or_, fits, F.col("listed").isNotNull()))
        own = [F.when(f, F.struct(F.lit(term), F.lit(variant), F.lit(n))) for f, (term, variant, _, _, n) in zip(fits, patterns, strict=True)]
        both = F.concat(F.coalesce("listed", F.array().cast(ids)), F.array(*own).cast(ids))
    # a pattern that a token does not fit is null; to drop it from the array would take Spark out of the generated step
    return begun.select(*rows.columns, F.explode_outer(both).alias("_begun")).where("_begun IS NOT NULL").select(*rows.columns, "_begun.*")


def vocabulary(docs: DataFrame, tokens: str = "toks") -> DataFrame:
    """token, corpus_freq; barriers have a row as well."""
    return docs.select(F.explode_outer(tokens).alias("token")).where("token IS NOT NULL").groupBy("token").agg(F.count(F.lit(1)).alias("corpus_freq"))
