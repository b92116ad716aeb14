"""Chat formatting by quotation linking.

A message's lines are parsed into quote levels (the leading '>' marks). Each quoted passage, a run of lines of one
level, is normalised and hashed, as is what every message says itself: whole, and line by line. A passage's hash is
joined to the messages of its conversation that said it before. Of the levels at which something is found the shallowest
counts, and there the latest message is what this one replies to; deeper quotes are of older messages. A message that
quotes nothing known replies to the one before it.

The output is the conversations in order of reply, one row per message, without quotes: the replies to a message stand
together, in the order of the messages that they reply to. It is linear in the messages whatever one conversation holds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflux.llm.common import durable, in_parts, ship
from lexiflux.plans.places import ranked

#: Turns of a conversation that are ordered in one task; longer conversations are ordered in such parts.
PART = 1024
_MARKS = re.compile(r"^(?:[ \t]*>)+ ?")


def parse(text: str) -> list[tuple[int, str]]:
    """Level and content of each line; level 0 is what the message says itself."""
    out = []
    for line in text.split("\n"):
        m = _MARKS.match(line)
        out.append((m[0].count(">"), line[m.end() :]) if m else (0, line))
    return out


def normal(s: str) -> str:
    """Lower case, words and figures alone, single spaces: what mailers rewrap or repunctuate stays equal."""
    return " ".join(re.findall(r"\w+", s.lower()))


def key(s: str) -> int | None:
    """64 bits of the normal form; None where nothing is left of it."""
    n = normal(s)
    return int.from_bytes(hashlib.blake2b(n.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) if n else None


def passages(lines: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Runs of equal quote level above 0, in order: level and joined content."""
    out: list[tuple[int, list[str]]] = []
    previous = 0
    for level, content in lines:
        if level and level == previous:
            out[-1][1].append(content)
        elif level:
            out.append((level, [content]))
        previous = level
    return [(level, "\n".join(x)) for level, x in out]


def dissect(text: str) -> tuple[str, list[int], list[dict], int, int]:
    """Own content, keys said, keys quoted with the shallowest level of each, number of quoted passages, deepest level."""
    lines = parse(text)
    own = "\n".join(c for level, c in lines if not level).strip("\n")
    said = {k for s in (own, *own.split("\n"), *own.split("\n\n")) if (k := key(s)) is not None}
    quoted = passages(lines)
    links: dict[int, int] = {}
    for level, s in quoted:
        for x in (s, *s.split("\n")):
            if (k := key(x)) is not None:
                links[k] = min(level, links.get(k, level))
    return own, sorted(said), [{"k": k, "level": v} for k, v in sorted(links.items())], len(quoted), max((level for level, _ in quoted), default=0)


def link_quotes(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, content, parent_turn, by_quote, n_quotes, depth, place for each row, in order of place within a conversation.

    parent_turn is the largest earlier turn whose message said a quoted passage or one of its lines, at the shallowest
    level of quotes for which there is such a turn, else the turn before; null for a first turn. place counts from 0 in
    a conversation by parent_turn, then by turn: a parent stands before its replies, which stand together. content is
    the message without quotes. Null texts count as empty, messages that are only quotes have empty content. Messages of
    equal turns are kept each, none is the parent of another; rows that are equal altogether have places next to one
    another. Rows with a null conversation share one, those with a null turn come last in theirs and are no one's
    parent. Texts of any length are taken whole. Extra columns are ignored; an empty table gives no rows.
    """
    ship(conversations.sparkSession)
    types = dict(conversations.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            own, said, links, n, depth = zip(*(dissect(t.as_py()) for t in b.column(3)), strict=True) if b.num_rows else [()] * 5
            longs, link = pa.list_(pa.int64()), pa.list_(pa.struct([("k", pa.int64()), ("level", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(own, pa.string()), pa.array(said, longs), pa.array(links, link), pa.array(n, pa.int64()), pa.array(depth, pa.int64())], ["conv_id", "turn", "role", "content", "said", "links", "n_quotes", "depth"])

    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = durable(rows.mapInArrow(run, f"conv_id {types['conv_id']}, turn {types['turn']}, role {types['role']}, content string, said array<long>, links array<struct<k: long, level: long>>, n_quotes long, depth long"))
    rows = rows.withColumn("_conv", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")))
    # who said a passage: of equal sayings in a conversation each turn counts once
    asked = rows.where(F.size("links") > 0).select("_conv", "turn", F.explode("links").alias("x")).groupBy("_conv", "turn", F.col("x.k").alias("k")).agg(F.min("x.level").alias("level"))
    wanted = asked.select("_conv", "k").distinct()
    said = rows.where(F.col("turn").isNotNull()).select("_conv", F.col("turn").alias("said_turn"), F.explode("said").alias("k"))
    said = said.join(wanted, ["_conv", "k"], "left_semi").distinct()
    # the latest saying before each question, by one sorted pass over sayings and questions of a passage
    both = said.select("_conv", "k", F.col("said_turn").alias("turn"), F.lit(None).cast("long").alias("level")).unionByName(asked.where("turn IS NOT NULL").select("_conv", "k", "turn", "level"))
    earlier = Window.partitionBy("_conv", "k").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    quoted = both.withColumn("p", F.max(F.when(F.col("level").isNull(), F.col("turn"))).over(earlier)).where("level IS NOT NULL AND p IS NOT NULL")
    quoted = quoted.groupBy("_conv", "turn").agg(F.min(F.struct("level", (-F.col("p")).alias("p"))).alias("x")).select("_conv", "turn", (-F.col("x.p")).alias("_quoted"))
    # the turn before: within a part of the conversation, or the last of the parts before it
    turns = rows.where(F.col("turn").isNotNull()).groupBy("_conv", "turn").agg(F.lit(1).alias("one")).withColumn("_part", F.floor(F.col("turn") / PART))
    parts = turns.groupBy("_conv", "_part").agg(F.max("turn").alias("last"))
    parts = parts.withColumn("_carried", F.lag("last").over(Window.partitionBy("_conv").orderBy("_part"))).drop("last")
    before = F.lag("turn").over(Window.partitionBy("_conv", "_part").orderBy("turn"))
    turns = turns.join(parts, ["_conv", "_part"]).withColumn("_before", F.coalesce(before, "_carried")).select("_conv", "turn", "_before")
    parents = turns.join(quoted, ["_conv", "turn"], "left")
    out = rows.join(parents, ["_conv", "turn"], "left")
    out = out.select("conv_id", "_conv", "turn", "role", "content", F.coalesce("_quoted", "_before").alias("parent_turn"), F.col("_quoted").isNotNull().alias("by_quote"), "n_quotes", "depth")
    order = [F.col("conv_id").asc_nulls_last(), F.col("turn").isNull(), F.col("parent_turn").asc_nulls_first(), F.col("turn"), *(F.col(c).asc_nulls_first() for c in ("role", "content", "n_quotes", "depth"))]
    placed = ranked(out, *order)
    first = placed.groupBy("_conv").agg(F.min("place").alias("_first"))
    placed = placed.join(first, "_conv").withColumn("place", F.col("place") - F.col("_first"))
    return placed.select("conv_id", "turn", "role", "content", "parent_turn", "by_quote", "n_quotes", "depth", "place").orderBy(F.col("conv_id").asc_nulls_last(), "place")


def render(linked: DataFrame, template: str = "<|{role}|>\n{content}\n") -> DataFrame:
    """linked with chat: the message in the template's form."""
    head, rest = template.split("{role}")
    middle, tail = rest.split("{content}")
    return linked.withColumn("chat", F.concat(F.lit(head), F.coalesce("role", F.lit("")), F.lit(middle), "content", F.lit(tail)))


ORACLE = r"""
WITH rows AS (SELECT row_number() OVER () AS id, conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS conv, turn, role, coalesce(text, '') AS text FROM conversations),
raw AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM rows),
marked AS (SELECT *, regexp_extract(line, '^(?:[ \t]*>)+ ?') AS mark FROM raw),
lines AS (SELECT id, i, length(mark) - length(replace(mark, '>', '')) AS level, substr(line, length(mark) + 1) AS content FROM marked),
own AS (SELECT id, trim(coalesce(string_agg(content, chr(10) ORDER BY i) FILTER (level = 0), ''), chr(10)) AS content, max(level) AS depth FROM lines GROUP BY id),
runs AS (SELECT *, sum(CASE WHEN level = coalesce(before, -1) THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY i) AS run FROM (SELECT *, lag(level) OVER (PARTITION BY id ORDER BY i) AS before FROM lines)),
passages AS (SELECT id, run, level, string_agg(content, chr(10) ORDER BY i) AS content FROM runs WHERE level > 0 GROUP BY ALL),
saying AS (SELECT id, content AS s FROM own UNION ALL SELECT id, unnest(string_split(content, chr(10))) FROM own UNION ALL SELECT id, unnest(string_split(content, chr(10) || chr(10))) FROM own),
asking AS (SELECT id, level, content AS s FROM passages UNION ALL SELECT id, level, unnest(string_split(content, chr(10))) FROM passages),
said AS (SELECT DISTINCT conv, turn, array_to_string(regexp_extract_all(lower(s), '[\p{L}\p{N}_]+'), ' ') AS k FROM saying JOIN rows USING (id) WHERE turn IS NOT NULL),
asked AS (SELECT DISTINCT conv, turn, level, array_to_string(regexp_extract_all(lower(s), '[\p{L}\p{N}_]+'), ' ') AS k FROM asking JOIN rows USING (id)),
found AS (SELECT a.conv, a.turn, a.level, max(s.turn) AS parent FROM asked a JOIN said s ON a.conv = s.conv AND a.k = s.k AND s.turn < a.turn WHERE a.k <> '' GROUP BY ALL),
quoted AS (SELECT conv, turn, arg_min(parent, level) AS parent FROM found GROUP BY ALL),
turns AS (SELECT conv, turn, lag(turn) OVER (PARTITION BY conv ORDER BY turn) AS before FROM (SELECT DISTINCT conv, turn FROM rows WHERE turn IS NOT NULL))
SELECT r.conv_id, r.turn, r.role, o.content, coalesce(q.parent, t.before) AS parent_turn, q.parent IS NOT NULL AS by_quote,
  coalesce(p.n, 0) AS n_quotes, o.depth,
  row_number() OVER (PARTITION BY r.conv ORDER BY r.turn IS NULL, coalesce(q.parent, t.before) NULLS FIRST, r.turn, r.role NULLS FIRST, o.content, coalesce(p.n, 0), o.depth) - 1 AS place,
  '<|' || coalesce(r.role, '') || '|>' || chr(10) || o.content || chr(10) AS chat
FROM rows r JOIN own o USING (id) LEFT JOIN (SELECT id, count(*) AS n FROM passages GROUP BY id) p USING (id) LEFT JOIN turns t ON t.conv = r.conv AND t.turn = r.turn LEFT JOIN quoted q ON q.conv = r.conv AND q.turn = r.turn
"""
