"""Preference formatting: pairs of a chosen and a rejected conversation as one prompt and two masked completions.

The longest common prefix of turns (same role and text) is rendered once, as the prompt; the turns after it are the
completions. Of a completion, the loss falls on the text and end marker of assistant turns; its spans are given as
``start-end`` code point offsets, joined by commas. DataFrame functions only.

Defined cases: a null role is ``unknown``, a null text empty; what could begin a marker in a text or a role, or end one in a
role, is broken up by a space so that it can't pass for one; rows of a conversation that repeat (same turn, role and text) count once; turns go by number, nulls first, then
role and text. Equal conversations have an empty completion each. A missing side is a conversation without turns. Rows
without a conversation id belong to no conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "<|end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to conv_id, turns: array of (role, text) in order."""
    role = F.replace(F.replace(F.coalesce(F.col("role"), F.lit("unknown")), F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >")).alias("role")
    text = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text")
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), role, text).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("t"))
    return whole.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def common_turns(chosen: Column, rejected: Column) -> Column:
    """How many turns at the start are the same."""
    same = F.zip_with(chosen, rejected, lambda a, b: a.eqNullSafe(b))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def loss_spans(turns: Column) -> Column:
    """Offsets of what assistant turns add, within their rendering."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(_head(t))
        end = begin + F.length(t["text"]) + len(END)
        span = F.when(t["role"] == "assistant", F.array(F.concat_ws("-", begin.cast("string"), end.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], span).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step, lambda acc: acc["spans"]), ",")


def preference_format(pairs: DataFrame) -> DataFrame:
    """(chosen, rejected: arrays of (role, text), further columns) to these columns, common_turns, prompt and completions with spans."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    keys = [c for c in pairs.columns if c not in ("chosen", "rejected")]
    both = pairs.select(*keys, F.coalesce("chosen", none).alias("chosen"), F.coalesce("rejected", none).alias("rejected"))
    cut = both.withColumn("common_turns", common_turns(F.col("chosen"), F.col("rejected")))

    def rest(side: str) -> Column:
        return F.slice(F.col(side), F.col("common_turns") + 1, F.greatest(F.lit(0), F.size(side) - F.col("common_turns")))

    parts = cut.select(*keys, "common_turns", F.slice("chosen", F.lit(1), F.col("common_turns")).alias("p"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return parts.select(*keys, "common_turns", rendered(F.col("p")).alias("prompt"), rendered(F.col("c")).alias("chosen_completion"), loss_spans(F.col("c")).alias("chosen_loss"), rendered(F.col("r")).alias("rejected_completion"), loss_spans(F.col("r")).alias("rejected_loss"))


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Each conversation as chosen, and as rejected the same one with the last turn of its neighbour (id with the lowest
    bit flipped) in place of its own last turn; without a neighbour, just without its last turn."""
    whole = conversations(turns)
    last = whole.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.slice("turns", -1, 1).alias("other"))
    pairs = whole.join(last, "conv_id", "left")
    none = F.array().cast("array<struct<role:string,text:string>>")
    short = F.slice("turns", F.lit(1), F.size("turns") - 1)
    return pairs.select("conv_id", F.col("turns").alias("chosen"), F.concat(short, F.coalesce("other", none)).alias("rejected"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_format(neighbour_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


_RENDER = "array_to_string(list_transform({0}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '')"
_SPANS = """array_to_string(list_transform(list_filter(range(1, len({0}) + 1), lambda i: {0}[i].role = 'assistant'),
  lambda i: CAST(coalesce(list_sum(list_transform({0}[1:i-1], lambda t: length(t.role) + length(t.text) + 13)), 0) + length({0}[i].role) + 5 AS VARCHAR) || '-' ||
       CAST(list_sum(list_transform({0}[1:i], lambda t: length(t.role) + length(t.text) + 13)) AS VARCHAR)), ',')"""
ORACLE = f"""
WITH d AS (
  SELECT DISTINCT conv_id, turn, replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '|>', '| >') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), w AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS t FROM d GROUP BY conv_id
), p AS (
  SELECT w.conv_id, w.t AS c, list_concat(w.t[1:len(w.t)-1], coalesce(o.t[len(o.t):len(o.t)], [])) AS r
  FROM w LEFT JOIN w o ON o.conv_id = xor(w.conv_id, 1)
), n AS (
  SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(c), len(r)) + 1), lambda i: c[i] IS DISTINCT FROM r[i])) - 1, greatest(len(c), len(r))) AS k FROM p
), s AS (
  SELECT conv_id, CAST(k AS INTEGER) AS common_turns, c[1:k] AS p, c[k+1:len(c)] AS c, r[k+1:len(r)] AS r FROM n
)
SELECT conv_id, common_turns, {_RENDER.format("p")} AS prompt, {_RENDER.format("c")} AS chosen_completion, {_SPANS.format("c")} AS chosen_loss,
       {_RENDER.format("r")} AS rejected_completion, {_SPANS.format("r")} AS rejected_loss
FROM s
"""
