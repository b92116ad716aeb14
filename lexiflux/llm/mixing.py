"""Mixing sources to target weights: a time-varying curriculum, with DataFrame functions alone.

Every source has a share of the mix and a weight schedule over training time. Integrating the schedule gives the
cumulative demand for its words; inverting that demand gives each document the moment at which its words are due.
Documents of a source queue in a hashed order. The queue is summed in two levels (hash buckets, then within a
bucket), so that a source with a third of all rows spreads over as many tasks as there are buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflux.llm.common import WORD, durable

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: How far a source's density leans to the start or the end of training, before centring.
LEAN = 0.4


def _targets(by_source: DataFrame, weights: tuple[int, ...], max_repeats: int, lean: float) -> DataFrame:
    """by_source (_src, source, source_size) with target, slope and total.

    Water filling: in the order of cap over weight the sources that stop at their cap come first; the rest share what
    is left in proportion to their weights. One row per source, so windows without partitions are small here.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = by_source.withColumn("_rank", rank)
    s = s.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("_cap", F.col("source_size") * max_repeats)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("_pos", F.row_number().over(order))
    s = s.withColumn("total", F.sum("source_size").over(everything))
    level = (F.col("total") - F.coalesce(F.sum("_cap").over(before), F.lit(0))).cast("double") / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0))).cast("double")
    s = s.withColumn("_level", level)
    s = s.withColumn("_free", F.col("_cap").cast("double") > F.col("_level") * F.col("_w"))
    s = s.withColumn("_first", F.min(F.when(F.col("_free"), F.col("_pos"))).over(everything))
    s = s.withColumn("_level", F.min(F.when(F.col("_pos") == F.col("_first"), F.col("_level"))).over(everything))
    s = s.withColumn("target", F.when(F.col("_first").isNull() | (F.col("_pos") < F.col("_first")), F.col("_cap").cast("double")).otherwise(F.col("_level") * F.col("_w")))
    s = s.withColumn("_quota", F.round("target").cast("long"))
    sign = F.when(F.col("_rank") % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
    # the schedule's slopes, weighted by share, cancel: at every moment the shares sum to one
    s = s.withColumn("_sign", sign).withColumn("_mean", F.sum(F.col("_quota") * F.col("_sign")).over(everything).cast("double") / F.greatest(F.sum("_quota").over(everything), F.lit(1)).cast("double"))
    return s.select("_src", "source_size", "target", "_quota", (F.lit(lean) * (F.col("_sign") - F.col("_mean"))).alias("_slope"), "total")


def due(offset: Column, quota: Column, slope: Column) -> Column:
    """The time in [0, 1] at which cumulative demand reaches offset: D(t) = quota * ((1 - slope) t + slope t^2), inverted."""
    y = offset.cast("double") / quota.cast("double")
    return F.lit(2.0) * y / ((F.lit(1.0) - slope) + F.sqrt((F.lit(1.0) - slope) * (F.lit(1.0) - slope) + F.lit(4.0) * slope * y))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, lean: float = LEAN) -> DataFrame:
    """schedule() without repeats: one row per row of documents, with the position of its first repeat alone."""
    return schedule(documents, weights, max_repeats, lean).drop("repeats")


def schedule(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, lean: float = LEAN) -> DataFrame:
    """One row per row of documents: doc_id, source, size, source_size, target, taken, position, repeats.

    size counts words (null text: 0). taken is how many words of the row the mix takes over all repeats, at most
    max_repeats times its size; a source's taken words sum to its rounded target. position is the word of the mix at
    which the row is first due, null where nothing is taken. repeats has position and taken of each time that the row is
    due, in order; it is empty where nothing is taken. Sources in code-point order, a null source last, take the
    weights in turn. Rows with equal ids queue side by side and are counted each for itself; a null id queues as
    'null'. Extra columns are ignored. Reruns agree: the queue's order is the MD5 of the id.
    """
    sized = documents.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = sized.withColumn("_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = sized.withColumn("_src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("_bucket", F.substring("_key", 1, 3))
    sized = durable(sized)
    buckets = sized.groupBy("_src", "_bucket").agg(F.sum("size").alias("_sum"))
    by_source = sized.groupBy("_src").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    earlier = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    buckets = buckets.join(_targets(by_source, weights, max_repeats, lean), "_src")
    within = Window.partitionBy("_src", "_bucket").orderBy("_key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.join(buckets, ["_src", "_bucket"])
    rows = rows.withColumn("_at", F.col("_before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    offsets = [F.col("_at") + F.col("source_size") * e for e in range(max_repeats)]
    each = [F.greatest(F.lit(0), F.least(F.col("size"), F.col("_quota") - at)).cast("long") for at in offsets]
    rows = rows.withColumn("taken", sum(each, F.lit(0)).cast("long"))
    positions = [F.floor(F.col("total").cast("double") * due(at, F.col("_quota"), F.col("_slope"))).cast("long") for at in offsets]
    repeats = F.array(*(F.when(n > 0, F.struct(p.alias("position"), n.alias("taken"))) for p, n in zip(positions, each, strict=True)))
    position = F.when(F.col("taken") > 0, positions[0])
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", position.alias("position"), F.array_compact(repeats).alias("repeats"))


def in_order(mixed: DataFrame) -> DataFrame:
    """The mix range-sorted by position; rows of which nothing is taken come last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last())


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS r
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 3 AS cap,
         CASE WHEN r % 2 = 0 THEN 1 ELSE -1 END AS sign FROM ranked),
placed AS (
  SELECT *, row_number() OVER o AS pos, sum(source_size) OVER () AS total,
         CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS lev
  FROM weighed WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, r)),
free AS (SELECT min(pos) AS first FROM placed WHERE CAST(cap AS DOUBLE) > lev * w),
aimed AS (
  SELECT p.*, CASE WHEN f.first IS NULL OR p.pos < f.first THEN CAST(p.cap AS DOUBLE) ELSE q.lev * p.w END AS target
  FROM placed p CROSS JOIN free f LEFT JOIN placed q ON q.pos = f.first),
leaning AS (
  SELECT *, CAST(round(target) AS BIGINT) AS quota FROM aimed),
final AS (
  SELECT *, 0.4::DOUBLE * (sign - CAST(sum(quota * sign) OVER () AS DOUBLE) / CAST(greatest(sum(quota) OVER (), 1) AS DOUBLE)) AS slope FROM leaning),
queued AS (
  SELECT s.doc_id, s.source, s.size, f.source_size, f.target, f.quota, f.slope, f.total,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id NULLS LAST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_word
  FROM sized s JOIN final f ON s.source IS NOT DISTINCT FROM f.source),
counted AS (
  SELECT *, greatest(0, least(size, quota - at_word)) + greatest(0, least(size, quota - (at_word + source_size)))
            + greatest(0, least(size, quota - (at_word + 2 * source_size))) AS took FROM queued)
SELECT doc_id, source, size, source_size, target, CAST(took AS BIGINT) AS taken,
       CAST(CASE WHEN took > 0 THEN floor(CAST(total AS DOUBLE) * (2.0::DOUBLE * (CAST(at_word AS DOUBLE) / CAST(quota AS DOUBLE))
            / ((1.0::DOUBLE - slope) + sqrt((1.0::DOUBLE - slope) * (1.0::DOUBLE - slope)
            + 4.0::DOUBLE * slope * (CAST(at_word AS DOUBLE) / CAST(quota AS DOUBLE)))))) END AS BIGINT) AS position
FROM counted
"""
