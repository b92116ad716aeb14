import inspect
import math
import os
import re

import corpus_pipeline as P
import pytest
from lexiflux.llm import decontaminate, queries, toxicity
from lexiflux.llm import substrings as S
from pyspark.sql import functions as F

from test_dedup import classes, sifted

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@needs_data
def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = P.stored(stage(spark, docs, DATA))
        after = docs.collect()
        if name != "mixing":
            assert docs.columns == columns
        ids = {r["doc_id"] for r in after}
        if name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
            model = toxicity.train(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"), F.lit(False))
            words = {i: set(re.findall(r"\w+", t.lower())) for i, t in before}
            bad = {i for i, w in words.items() if 1 / (1 + math.exp(-model.logit(w, {}))) >= toxicity.THRESHOLD}
            assert ids == words.keys() - bad
            assert sum((i in ids) == (not y) for i, y in labels.items()) >= 0.9 * len(labels)  # 11 toxic rows to learn from
        elif name == "near_duplicates":
            assert ids == {c for _, c, _, _ in classes(before)}
        elif name == "substring_dedup":
            assert sorted((r["doc_id"], r["text"]) for r in after) == sorted(sifted(before))
            assert len(after) == len(before) and S.MIN_WORDS > 0
        elif name == "decontamination":
            items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            exact = {i for i, t in before if any(b in decontaminate.normal(t) for b in items)}
            assert not ids & exact and len(before) - len(ids) <= len(exact) + 1
        else:
            assert ids == {i for i, _ in before}
    assert P.run(spark, DATA).count() == len(after)


@needs_data
def test_stages_on_odd_rows(spark, frame, odd):
    """Nulls, empty and very long texts, repeated rows and ids, columns with clashing names; and no rows at all."""
    docs, empty = frame(odd), frame([])
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs, empty = P.stored(stage(spark, docs, DATA)), P.stored(stage(spark, empty, DATA))
        after = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert docs.columns == columns == empty.columns and empty.isEmpty()
        if name == "near_duplicates":
            # one row of each class: ids 1 and 8 share one, so do texts without words; the two texts of id 6 are two
            assert sorted(i for i, _ in after) == [1, 2, 5, 6, 6, 7] and set(after) <= set(before)
        elif name == "substring_dedup":
            assert sorted(((i, t or "") for i, t in after), key=repr) == sifted(before)
        else:  # nothing toxic, no passage of the benchmark
            assert sorted(after, key=repr) == sorted(before, key=repr)
    mixed = P.mix_sources(spark, docs, DATA).collect()
    assert sorted(r["doc_id"] for r in mixed) == [1, 2, 5, 6, 6, 7] and P.mix_sources(spark, empty, DATA).collect() == []


@needs_data
def test_queries_have_the_contract_columns(spark):
    want = {
        "op2_quality": "doc_id held_out score predicted",
        "op4_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        "op6_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op7_toxicity": "doc_id held_out score predicted",
    }
    found = queries.queries()
    assert [int(k[2:].split("_")[0]) for k in found] == list(range(1, 11))
    for k, columns in want.items():
        assert found[k](spark, DATA).columns == columns.split()
    assert set(columns.split()) and {"doc_id", "size", "source_size", "target", "taken"} <= set(found["op9_mixing"](spark, DATA).columns)


@needs_data
def test_last_stage_places_every_repeat(spark):
    rows = P.mix_sources(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA).collect()
    assert all(sum(x["taken"] for x in r["repeats"]) == r["taken"] for r in rows)
    assert any(len(r["repeats"]) > 1 for r in rows)


def test_mixing_is_native():
    from lexiflux.llm import mixing

    assert not any(x in inspect.getsource(mixing) for x in ("udf", "mapIn", "applyIn", ".rdd", "toPandas", "collect("))
