"""Near-duplicates by DartMinHash signatures and a banded join.

Texts with the same words are one node, whatever their number. A node's shingles, with their counts as weights, are
regions at which hashed darts are thrown: over each unit of an element's weight the darts are a Poisson process along
the rank axis, the same in every text that has the element; a dart also names one of k coordinates, and the earliest
dart of a coordinate is its signature value. A text whose first throw leaves a coordinate empty throws further.

Nodes that share a band meet in a bucket, but no pairs are made of a bucket. First a node is held against one other
alone, by the exact weighted Jaccard similarity: of the leaders of its buckets the one that it meets in most of them.
Links form components, and buckets of one component are done. Those that hold more are compared in full, so that no
link between components is lost: small buckets by their pairs, crowded ones block by block, of which only links that
join components come out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflux.llm.common import in_parts, ship, spent, stored, texts
from lexiflux.llm.hashing import mix64, shingles, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
#: Cells whose darts are thrown at once.
CHUNK = 400_000
#: Rows and bytes of text that are signed at once.
SIGNED = 4096, 8_000_000
#: Members of an open bucket whose pairs are made; a bucket of more is compared in blocks.
SMALL = 8
#: A group of exact copies is hot from this share of all rows on, so at most 5,000 of them are.
HOT = 1 / 5000
#: Nodes of a crowded bucket that are compared with one another at once, twice over.
BLOCK = 256
_STEP = np.uint64(0xD1B54A32D192ED03)


def weigh(words: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text, ascending, and their counts."""
    return np.unique(shingles(words, size), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: the sum of the smaller weights over the sum of the larger ones; two empty sets are alike."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least, total = float(np.minimum(a[1][i], b[1][j]).sum()), float(a[1].sum() + b[1].sum())
    return least / (total - least) if total else 1.0


def _throw(cells: np.ndarray, share: np.ndarray, owner: np.ndarray, horizon: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Earliest dart per owner and coordinate, up to the owner's rank horizon: values and ranks (infinite where none).

    share is the part of a cell's unit of weight that its element fills; a dart beyond it misses.
    """
    best, value = np.full(len(horizon) * k, np.inf), np.zeros(len(horizon) * k, np.uint64)
    rank, seed = np.zeros(len(cells)), cells
    while len(cells):
        seed = mix64(seed + _STEP)
        rank = rank - np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        near = rank <= horizon[owner]
        cells, share, owner, rank, seed = cells[near], share[near], owner[near], rank[near], seed[near]
        dart = mix64(seed ^ cells)
        hit = ((mix64(dart) >> np.uint64(11)).astype(np.float64) * 2.0**-53) < share
        slot = owner[hit] * k + (dart[hit] % np.uint64(k)).astype(np.int64)
        np.minimum.at(best, slot, rank[hit])
        won = best[slot] == rank[hit]
        value[slot[won]] = dart[hit][won]
    return value.reshape(-1, k), best.reshape(-1, k)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = BANDS * ROWS) -> np.ndarray:
    """One row of k dart values for each weighted set (element hashes, positive weights); zeros for an empty set."""
    out = np.zeros((len(sets), k), np.uint64)
    darts = k * np.log(k) + 2 * k
    wanted = np.array([i for i, s in enumerate(sets) if len(s[0])], np.int64)
    horizons = {int(i): darts / float(sets[i][1].sum()) for i in wanted}
    while len(wanted):
        again = []
        size = np.cumsum([np.ceil(sets[i][1]).sum() for i in wanted])
        for part in np.split(wanted, np.unique(np.searchsorted(size, np.arange(CHUNK, size[-1], CHUNK)))):
            if not len(part):
                continue
            cells, share, owner = [], [], []
            for n, i in enumerate(part):
                ids, weights = sets[i]
                units = np.ceil(weights).astype(np.int64)
                level = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
                cells.append(np.repeat(ids, units) + level.astype(np.uint64) * _STEP)
                share.append(np.minimum(np.repeat(weights, units) - level, 1.0))
                owner.append(np.full(len(level), n))
            value, rank = _throw(mix64(np.concatenate(cells)), np.concatenate(share), np.concatenate(owner), np.array([horizons[int(i)] for i in part]), k)
            out[part] = value
            again += [int(i) for i, full in zip(part, np.isfinite(rank).all(1), strict=True) if not full]
        for i in again:
            horizons[i] *= 2
        wanted = np.array(again, np.int64)
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """64-bit keys of the bands of each signature."""
    parts = signature.reshape(-1, bands, rows)
    h = np.zeros(parts.shape[:2], np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _STEP
    for r in range(rows):
        h = mix64(h ^ parts[:, :, r]) + _STEP
    return h.view(np.int64)


def signed(documents: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, hash (of the text), node (digest of its words), keys (of its bands; none for a text without words) for each row."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches, *SIGNED):
            nodes, sets = [], []
            for t in b.column(1):
                words = word_hashes(t.as_py())
                nodes.append(hashlib.md5(words.tobytes(), usedforsecurity=False).digest())
                sets.append(weigh(words))
            keys = band_keys(signatures(sets, bands * rows), bands, rows)
            full = np.array([len(s[0]) > 0 for s in sets], bool)
            ends = np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(keys[full].ravel()))], ["doc_id", "hash", "node", "keys"])

    hashed = texts(documents).withColumn("hash", F.xxhash64("text"))
    return hashed.mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, hash long, node binary, keys array<long>")


def _verified(pairs: DataFrame, of: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough. of: id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for b in in_parts(batches):
            keep = []
            for i in range(b.num_rows):
                if (a := b.column(0)[i].as_py()) != last:
                    last, left = a, weigh(word_hashes(b.column(2)[i].as_py()))
                keep.append(similarity(left, weigh(word_hashes(b.column(3)[i].as_py()))) >= least)
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(of.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(of.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of the links (a, b): the least node that links lead to.

    Labels fall to the least among neighbours and then to the label's own label, until none changes. A node with very
    many links is summed in tasks first, and the joins on it are of a kind that can be split. Tables are stored, so that
    the sizes of small ones are known and these are joined where the others are.
    """
    ends = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = stored(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = ends.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        lower = stored(labels.join(near, "node").select("node", F.least("node", "root", "m").alias("root"), F.col("root").alias("old")))
        nexts = stored(lower.join(lower.select(F.col("node").alias("root"), F.col("root").alias("further")), "root").select("node", F.least("root", "further").alias("root"), "old"))
        same = nexts.where(F.col("root") != F.col("old")).isEmpty()
        spent(labels, lower)
        labels = nexts
        if same:
            spent(ends)
            return labels.select("node", "root")


def _rooted(rows: DataFrame, labels: DataFrame | None, node: str = "id", root: str = "root") -> DataFrame:
    """rows with the root of each node: its label's, or itself where it has none."""
    if labels is None:
        return rows.withColumn(root, F.col(node))
    return rows.join(labels.select(F.col("node").alias(node), F.col("root").alias("_label")), node, "left").withColumn(root, F.coalesce("_label", node)).drop("_label")


def _roots(nodes: DataFrame, documents: DataFrame, repeats: bool, least: float) -> DataFrame | None:
    """node, root of all nodes that have a link; None if there are no links at all. nodes: id, row, keys."""
    members = nodes.select("id", F.explode("keys").alias("key"))
    leaders = members.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").drop("hi")
    shared = stored(members.join(leaders, "key"))
    of = stored(_texts_of(documents, nodes, shared.select("id").distinct(), repeats))
    # the leader that a node meets in most of its buckets is likeliest to be like it
    tested = stored(shared.where("lo <> id").groupBy("id").agg(F.mode("lo", True).alias("a")).select("a", F.col("id").alias("b")))
    links = stored(_verified(tested, of, least))
    labels = None if links.isEmpty() else components(links)
    placed = _rooted(shared.select("key", "id"), labels)
    ends = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("set")).where("lo <> hi")
    # bands with the same nodes are looked at once
    ends = ends.groupBy("set", "n").agg(F.min("key").alias("key")).select("key", "n")
    open_ = stored(placed.join(ends, "key"))
    spent(shared, links)
    if not open_.isEmpty():
        few = open_.where(F.col("n") <= SMALL).select("key", "id", "root")
        other = few.select("key", F.col("id").alias("to"), F.col("root").alias("to_root"))
        pairs = few.join(other, "key").where("id < to AND root <> to_root").select(F.col("id").alias("a"), F.col("to").alias("b")).distinct()
        found = _verified(pairs.join(tested, ["a", "b"], "left_anti"), of, least).unionByName(_within(open_.where(F.col("n") > SMALL), of, least))
        # components that there are count as one node each
        found = _rooted(_rooted(found, labels, "a", "a_root"), labels, "b", "b_root").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
        more = stored(found.distinct())
        if not more.isEmpty():
            joined = components(more)
            if labels is None:
                labels = joined
            else:
                known = _rooted(labels.select(F.col("root").alias("_old"), F.col("node").alias("_node")), joined, "_old")
                alone = joined.join(labels.select("node"), "node", "left_anti")
                labels = stored(known.select(F.col("_node").alias("node"), "root").unionByName(alone.select("node", "root")))
        spent(more)
    spent(open_, of, tested)
    return labels


def _within(members: DataFrame, of: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that join different components of a bucket. members: key, n (of the bucket), id, root; of: id, text.

    A bucket is cut into blocks of about BLOCK nodes, and every two of its blocks are compared by matrix products in a
    task of their own; only links that join what was apart come out, fewer than the nodes of the two blocks.
    """
    n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = members.withColumn("block", F.pmod(F.xxhash64("id"), n_blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "root").join(of, "id")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, group = list(pdf.id), list(pdf.root)
        sets = [weigh(word_hashes(t)) for t in pdf.text]
        # unit cells of weight, so that the smaller weights' sum is the number of common cells
        cells = [np.repeat(ids, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64) * _STEP for ids, n in sets]
        size = np.array([len(c) for c in cells], float)
        row = np.repeat(np.arange(len(cells)), size.astype(int))
        _, column, times = np.unique(np.concatenate(cells), return_inverse=True, return_counts=True)
        shared = times[column] > 1
        row, column = row[shared], (np.cumsum(times > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common, width = np.zeros((len(cells), len(cells)), np.float32), 4096
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [first, first + width])
            part = np.zeros((len(cells), width), np.float32)
            part[row[a:b], column[a:b] - first] = 1
            common += part @ part.T
        i, j = np.nonzero(np.triu(common >= least * (size[:, None] + size[None, :] - common) - 1e-3, 1))
        top = {g: g for g in group}

        def find(g: int) -> int:
            while top[g] != g:
                g = top[g]
            return g

        links = []
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            g, h = find(group[x]), find(group[y])
            if g != h and similarity(sets[x], sets[y]) >= least:
                top[max(g, h)] = min(g, h)
                links.append((nodes[x], nodes[y]))
        return pd.DataFrame(links, columns=["a", "b"])

    return rows.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")


def _texts_of(documents: DataFrame, nodes: DataFrame, wanted: DataFrame, repeats: bool) -> DataFrame:
    """id, text of the wanted nodes (id): the text of the row that stands for each. repeats: whether any row occurs twice."""
    rows = nodes.select("id", F.col("row.doc_id").alias("_doc"), F.col("row.hash").alias("_hash")).join(wanted, "id", "left_semi")
    docs = texts(documents).withColumn("_text_hash", F.xxhash64("text"))
    found = docs.join(rows, docs["doc_id"].eqNullSafe(rows["_doc"]) & (docs["_text_hash"] == rows["_hash"])).select("id", "text")
    return found.dropDuplicates(["id"]) if repeats else found


def _classes(documents: DataFrame, least: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame, bool]:
    """Rows (doc_id, hash, node), nodes (node, n, root, row, class_id, n_texts, n_rows), both durable, and whether any row occurs twice.

    A row stands for a node, and a node's row for its class, by the smallest id (null ids last), then the smallest hash.
    """
    all_ = stored(signed(documents, bands, rows))
    row = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "hash")
    nodes = all_.groupBy("node").agg(F.min(row).alias("row"), F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys"))
    nodes = stored(nodes.withColumn("id", F.monotonically_increasing_id()))  # fixed, once stored
    own = stored(all_.drop("keys"))
    spent(all_)
    repeats = not own.groupBy("doc_id", "hash").count().where("count > 1").isEmpty()
    roots = _roots(nodes, documents, repeats, least)
    classes = nodes.select("id", "node", "row", "n")
    classes = _rooted(classes, roots)
    by_root = classes.groupBy("root").agg(F.min("row").alias("head"), F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("n_rows"))
    classes = classes.join(by_root, "root").select("node", "n", "root", F.col("head.doc_id").alias("class_id"), "head", "n_texts", "n_rows")
    out = stored(classes)
    spent(nodes)
    return own, out, repeats


def near_duplicates(documents: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id, n_texts, n_rows for each row of documents.

    class_id is the smallest doc_id of the class: rows that links of a weighted similarity of at least `least` on
    shingles of five words join, through any number of steps. n_texts counts the class's different texts (as sequences
    of words), n_rows its rows. Null and empty texts, and all others without words, are one class. Repeated rows are in
    the same class. Null ids come after all others: a class of null ids alone has a null class_id. Extra columns are
    ignored, whatever their names. Texts of any length are taken whole; an empty table gives no rows.
    """
    own, classes, _ = _classes(documents, least, bands, rows)
    hot = F.col("n") >= max(1000, int(own.count() * HOT))
    found = classes.select("node", "n", "class_id", "n_texts", "n_rows")
    # at most 1 / HOT groups are hot; their rows are met where they are
    heavy = F.broadcast(found.where(hot).drop("n"))
    out = own.join(heavy, "node").unionByName(own.join(heavy.select("node"), "node", "left_anti").join(found.where(~hot).drop("n"), "node"))
    return out.select("doc_id", "class_id", "n_texts", "n_rows")


def representatives(documents: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row of each class, with all its columns: that of the smallest id (null ids last; of equal ids the smallest hash of text).

    Of rows that repeat, one is taken. Null and empty texts are one class, of which one row stays. An empty table stays
    empty.
    """
    _, classes, repeats = _classes(documents, least, bands, rows)
    heads = classes.select(F.col("head.doc_id").alias("__lexiflux_id"), F.col("head.hash").alias("__lexiflux_hash")).distinct()
    rows_ = documents.withColumn("__lexiflux_text", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = rows_["doc_id"].eqNullSafe(heads["__lexiflux_id"]) & (rows_["__lexiflux_text"] == heads["__lexiflux_hash"])
    kept = rows_.join(heads, same, "left_semi")
    if repeats:
        kept = kept.dropDuplicates(["doc_id", "__lexiflux_text"])
    return kept.drop("__lexiflux_text")
