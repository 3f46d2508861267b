"""Multi-party chat formatting by perspective rotation (operator 1).

For every participant of a conversation the dialogue is rendered once with that speaker as assistant and the others
as named users; system turns stay system turns. A message renders as ``<|role|>`` or ``<|user name=speaker|>``, a line
end, its text and ``<|end|>`` with a line end. The assistant's text and end mark are trained on: ``mask`` lists their
[start, end) code-point spans in the rendered part. In texts and names a backslash is doubled and ``<|`` becomes
``<\\|``, so a text cannot forge a turn.

A dialogue is rendered in parts of ``part_turns`` messages, one row for each participant and part, in order; joined
they are the whole dialogue. So a conversation of any length never sits in one task: places come from range-sorted
messages (a conversation's start is looked up by range), only a part's bounded messages are gathered, and the
participants meet the parts of a conversation in lanes of ``LANE`` parts.

Defined results: turns in order of (turn, role, text), null turns last; a null role is the speaker ``unknown``; a null
text is empty; a null conv_id is a conversation of its own; repeated turns are messages of their own; a conversation
of system turns only has no perspective and gives no rows; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.llm.common import freeze, with_place

END = "<|end|>\n"
LANE = 64


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def rotate(turns: DataFrame, part_turns: int = 256) -> DataFrame:
    """(conv_id, participant, part, n_messages, n_trained, rendered, mask) of ``turns(conv_id, turn, role, text)``."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    ranked = with_place(rows, order, "turns")
    ranges = freeze(ranked.groupBy("conv_id", "pid").agg(F.count("*").alias("n"), F.min("at").alias("first")), "turns-ranges")
    # messages of the conversation in earlier ranges; all but the first range of a conversation start with it
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    starts = ranges.select(F.col("conv_id").alias("c1"), F.col("pid").alias("p1"), (F.col("first") - earlier).alias("start")).hint("merge")
    placed = ranked.join(starts, (F.col("pid") == F.col("p1")) & F.col("conv_id").eqNullSafe(F.col("c1"))).withColumn("place", F.col("at") - F.col("start"))
    message = F.struct("place", "role", escaped(F.col("role")).alias("name"), escaped(F.col("text")).alias("text"))
    parts = placed.groupBy("conv_id", F.floor(F.col("place") / part_turns).cast("int").alias("part")).agg(F.sort_array(F.collect_list(message)).alias("messages"))
    parts = parts.withColumn("lane", F.floor(F.col("part") / LANE).cast("int"))
    people = ranked.where("role <> 'system'").select(F.col("conv_id").alias("c2"), F.col("role").alias("participant")).distinct()
    sizes = ranges.groupBy(F.col("conv_id").alias("c3")).agg(F.floor((F.sum("n") - 1) / (part_turns * LANE)).cast("int").alias("last"))
    people = people.join(sizes.hint("merge"), F.col("c2").eqNullSafe(F.col("c3"))).select("c2", "participant", F.explode(F.sequence(F.lit(0), "last")).alias("l2"))
    views = parts.join(people.hint("merge"), F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("lane") == F.col("l2")))

    def header(m: Column) -> Column:
        named = F.concat(F.lit("<|user name="), m["name"], F.lit("|>\n"))
        return F.when(m["role"] == F.col("participant"), "<|assistant|>\n").when(m["role"] == "system", "<|system|>\n").otherwise(named)

    # running code-point offsets: (end so far, spans of the assistant's texts)
    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(header(m))
        end = start + F.length(m["text"]) + len(END)
        own = m["role"] == F.col("participant")
        span = F.concat(start.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(own, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    spans = F.aggregate("messages", zero, step)["spans"]
    rendered = F.array_join(F.transform("messages", lambda m: F.concat(header(m), m["text"], F.lit(END))), "")
    return views.select(
        "conv_id",
        "participant",
        "part",
        F.size("messages").cast("long").alias("n_messages"),
        F.size(F.filter("messages", lambda m: m["role"] == F.col("participant"))).cast("long").alias("n_trained"),
        rendered.alias("rendered"),
        F.array_join(spans, ",").alias("mask"),
    )


def op1_perspective_rotation(spark, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = r"""
WITH m AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS txt,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS place
  FROM conversations),
e AS (
  SELECT conv_id, role, place, CAST(floor(place / 256) AS INTEGER) AS part,
         replace(replace(txt, '\', '\\'), '<|', '<\|') AS txt, replace(replace(role, '\', '\\'), '<|', '<\|') AS nm
  FROM m),
p AS (SELECT DISTINCT conv_id, role AS participant FROM m WHERE role <> 'system'),
h AS (
  SELECT e.conv_id, participant, part, place, role = participant AS own, txt,
         CASE WHEN role = participant THEN '<|assistant|>' || chr(10) WHEN role = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || nm || '|>' || chr(10) END AS head
  FROM e JOIN p ON e.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (
  SELECT *, head || txt || '<|end|>' || chr(10) AS seg,
         sum(length(head) + length(txt) + 8) OVER (PARTITION BY conv_id, participant, part ORDER BY place) AS upto
  FROM h)
SELECT conv_id, participant, part, count(*) AS n_messages, count(*) FILTER (own) AS n_trained,
       string_agg(seg, '' ORDER BY place) AS rendered,
       coalesce(string_agg(CAST(upto - length(txt) - 8 AS BIGINT) || '-' || CAST(upto AS BIGINT), ',' ORDER BY place) FILTER (own), '') AS mask
FROM s GROUP BY conv_id, participant, part
"""
