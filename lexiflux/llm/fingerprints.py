"""Document fingerprints by winnowing.

Rolling k-gram hashes over code points; in every window of w consecutive hashes the smallest is chosen, the rightmost
among equals, and its position is kept. Two texts that share a stretch of at least w + k - 1 code points share a
fingerprint in it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflux.llm.common import in_parts, ship, texts

K, W = 16, 33
#: Neighbouring documents are compared in runs of about so many, and in so many runs at most; null ids in as many again.
RUN, MOST_RUNS = 2000, 10_000
_BASE, _M1, _M2 = 0x9E3779B97F4A7C15 | 1, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def gram_hashes(text: str, k: int = K) -> np.ndarray:
    """32-bit hashes of all k-grams, by position; a shorter text is one gram, an empty one none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n, k = len(codes), min(k, len(text))
    if not n:
        return np.zeros(0, np.uint64)
    h = np.zeros(n - k + 1, np.uint64)
    base = np.uint64(_BASE)
    for i in range(k):
        h *= base
        h += codes[i : n - k + 1 + i]
    h ^= h >> np.uint64(30)
    h *= np.uint64(_M1)
    h ^= h >> np.uint64(27)
    h *= np.uint64(_M2)
    return h >> np.uint64(32)


def winnow(hashes: np.ndarray, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Chosen (positions, hashes) in ascending order of position; fewer hashes than a window are one window."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), hashes
    low = np.uint64(0xFFFFFFFF)
    keys = (hashes << np.uint64(32)) | (low - np.arange(n, dtype=np.uint64))  # of equal hashes the rightmost is least
    width, m = min(w, n), keys
    span = 1
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[: n - width + 1], m[width - span :])
    keep = np.ones(len(m), bool)
    keep[1:] = m[1:] != m[:-1]
    m = m[keep]
    return (low - (m & low)).astype(np.int64), m >> np.uint64(32)


def fingerprint(text: str, k: int = K, w: int = W) -> tuple[str, np.ndarray]:
    """The fingerprint as text (base64 of pairs of 32-bit hash and position) and its set of hashes."""
    at, h = winnow(gram_hashes(text, k), w)
    pairs = np.empty((len(at), 2), "<u4")
    pairs[:, 0], pairs[:, 1] = h, at
    return base64.b64encode(pairs.tobytes()).decode(), np.unique(h)


def decode(fp: str) -> list[tuple[int, int]]:
    """(hash, position) pairs of a fingerprint."""
    return [tuple(x) for x in np.frombuffer(base64.b64decode(fp), "<u4").reshape(-1, 2).tolist()]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted hash sets; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(documents: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, n_chars, n_grams, fingerprint for each row; null and empty texts have an empty fingerprint."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            ts = b.column(1).to_pylist()
            fps = [fingerprint(t, k, w)[0] for t in ts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in ts], pa.int64()), pa.array(fps, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    kind = dict(documents.dtypes)["doc_id"]
    return texts(documents).mapInArrow(run, f"doc_id {kind}, n_chars long, fingerprint string")


def _in_runs(documents: DataFrame) -> DataFrame:
    """Rows dealt by runs of neighbouring ids and sorted in them; each run ends with a guest, the first row after it.

    Only ids are read to find the bounds of the runs and the first id of each; both lists are bounded by MOST_RUNS. An
    id, or null, with the rows of several runs is cut by the hash of the text into as many, for which these rows are read
    once more. The texts are shuffled once.
    """
    ids = documents.select(F.col("doc_id").cast("double").alias("d"))
    n, known = ids.agg(F.count(F.lit(1)), F.count("d")).first()
    n_runs = max(1, min(MOST_RUNS, known // RUN))
    raw = ids.agg(F.percentile_approx("d", [i / n_runs for i in range(1, n_runs)] or [0.5], 10 * MOST_RUNS)).first()[0] or []
    value, times = np.unique(np.array(raw, float), return_counts=True)
    hot = {float(v): int(t) for v, t in zip(value, times, strict=True) if t > 1}
    cuts = np.unique(np.concatenate([value, np.nextafter(np.array(list(hot), float), np.inf)]))
    pieces = np.ones(len(cuts) + 2, np.int64)  # of each stretch between cuts, the last that of null ids
    for v, t in hot.items():
        pieces[np.searchsorted(cuts, v, side="right")] = t
    pieces[-1] = max(1, min(MOST_RUNS, (n - known) // RUN))
    base = np.cumsum(pieces) - pieces

    @F.pandas_udf("int")
    def run_of(d: pd.Series, h: pd.Series) -> pd.Series:
        at = np.where(d.isna(), len(cuts) + 1, np.searchsorted(cuts, d.fillna(0).to_numpy(float), side="right"))
        share = (h.to_numpy(np.int64) >> 32) + (1 << 31)  # 32 bits that ascend with the hash
        return pd.Series(base[at] + (share * pieces[at] >> 32)).astype("int32")

    d = F.col("doc_id").cast("double")
    hashed = texts(documents).withColumn("_h", F.xxhash64("text"))
    cut = F.col("d").isin(list(hot)) | (F.col("d").isNull() & F.lit(bool(pieces[-1] > 1)))
    whole = ids.where(~F.coalesce(cut, F.lit(False))).groupBy(run_of("d", F.lit(0).cast("long")).alias("r")).agg(F.min("d").alias("d"))
    firsts = [(r["r"], (r["d"], None)) for r in whole.collect()]
    if pieces.max() > 1:
        parts = hashed.select(d.alias("d"), "_h").where(cut).groupBy(run_of("d", "_h").alias("r")).agg(F.min(F.struct("d", "_h")).alias("x"))
        firsts += [(r["r"], (r["x"]["d"], r["x"]["_h"])) for r in parts.collect()]
    firsts.sort(key=lambda x: x[0])
    before = {key: firsts[i - 1][0] for i, (_, key) in enumerate(firsts)}

    @F.pandas_udf("int")
    def guest_in(d: pd.Series, h: pd.Series) -> pd.Series:
        keys = ((None if pd.isna(x) else x, y) for x, y in zip(d, h, strict=True))
        return pd.Series([before.get((x, None), before.get((x, y), -1)) for x, y in keys], dtype="int32")

    rows = hashed.withColumn("_run", run_of(d, "_h")).withColumn("_guest_in", guest_in(d, "_h"))
    places = F.array(F.struct(F.col("_run").alias("run"), F.lit(0).alias("guest")), F.struct(F.col("_guest_in").alias("run"), F.lit(1).alias("guest")))
    rows = rows.select("doc_id", "text", "_h", F.explode(F.filter(places, lambda x: x["run"] >= 0)).alias("_at"))
    rows = rows.select("doc_id", "text", F.col("_at.run").alias("run"), F.col("_at.guest").alias("guest"), "_h")
    return rows.repartition("run").sortWithinPartitions("run", "guest", F.col("doc_id").asc_nulls_last(), "_h")


def neighbours(documents: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Each document's fingerprint against that of an edited text of its own and that of the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row. The edited
    text has its last floor(n_chars / 2) code points replaced by the first as many of the next document (ascending
    doc_id, null ids last, equal ids by a hash of the text; after the last comes the first). Null texts count as empty.
    """
    ship(documents.sparkSession)
    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next is awaited: run, id as Arrow has it, text, fingerprint
        for b in in_parts(batches):
            ids, out = [], []
            runs, guests = b.column(2).to_pylist(), b.column(3).to_pylist()
            for i in range(b.num_rows):
                if guests[i] and held is None:
                    continue
                text = b.column(1)[i].as_py()
                own = fingerprint(text, k, w)
                if held is not None and held[0] == runs[i]:
                    _, doc_id, t, (fp, hashes) = held
                    half = len(t) // 2
                    edited = t[: len(t) - half] + text[:half]
                    efp, ehashes = fingerprint(edited, k, w)
                    ids.append(doc_id)
                    out.append((len(t), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fp, efp, likeness(hashes, ehashes), likeness(hashes, own[1])))
                held = None if guests[i] else (runs[i], b.column(0)[i].as_py(), text, own)
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return _in_runs(documents).mapInArrow(run, schema)
