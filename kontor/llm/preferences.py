"""Preference formatting (operator 5). DataFrame functions only.

A pair is two conversations on one request, a chosen and a rejected one. The longest prefix of turns that both share is
rendered once, as the prompt; what follows is rendered as two completions. Each completion has its mask: the spans, in
code points of the completion, that are trained on, which are the assistant's texts with their end marks.

Scale: the turns of a conversation meet in one shuffle and stay one row, as the rendered conversation has to be one row
anyway; chosen and rejected meet by pair. Prefix, rendering and masks are array functions within the row.

Defined results: turns are ordered by number, then role, then text, null first; a null role or text renders as empty and equals
another null, not an empty one; pairs that do not differ have empty completions and no spans; a pair with only one side
is none, and so are turns with a null conversation, which belong to none; columns other than those named are not read;
empty tables give an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kontor.llm import scratch
from kontor.llm.fingerprints import ranges

HEAD, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def conversations(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turns array<struct<role, text>>) in order."""
    rows = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    found = turns.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_list(rows)).alias("turns"))
    return found.select("key", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """The length of the longest common prefix of two arrays of turns."""
    longest = F.greatest(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(1), longest), lambda i: (i <= F.size(a)) & (i <= F.size(b)) & F.get(a, i - 1).eqNullSafe(F.get(b, i - 1)))
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(longest == 0, 0).when(first == 0, longest).otherwise(first - 1)


def _shown(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), _shown(t["role"]), F.lit(MIDDLE), _shown(t["text"]), F.lit(END))), "")


def mask(turns: Column, trained: str = TRAINED) -> Column:
    """array<struct<start: int, end: int>>: the spans of the rendered turns that are trained on."""
    span = "struct<start: int, end: int>"

    def step(so_far: Column, t: Column) -> Column:
        start = so_far["at"] + F.lit(len(HEAD) + len(MIDDLE)) + F.length(_shown(t["role"]))
        end = start + F.length(_shown(t["text"])) + F.lit(len(END))
        own = F.when(t["role"] == trained, F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast(f"array<{span}>"))
        return F.struct(end.alias("at"), F.concat(so_far["spans"], own).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans"))
    return F.aggregate(turns, start, step, lambda done: done["spans"])


def formatted(pairs: DataFrame) -> DataFrame:
    """From (key, chosen, rejected: arrays of turns): key, prompt, prompt_turns, chosen, rejected, chosen_mask, rejected_mask."""
    both = pairs.withColumn("prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    rest = {side: F.slice(side, F.col("prompt_turns") + 1, F.greatest(F.size(side), F.lit(1))) for side in ("chosen", "rejected")}
    return both.select(
        "key",
        rendered(F.slice("chosen", F.lit(1), F.col("prompt_turns"))).alias("prompt"),
        "prompt_turns",
        *(rendered(x).alias(side) for side, x in rest.items()),
        *(mask(x).alias(f"{side}_mask") for side, x in rest.items()),
    )


def preference_rows(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Formats the pairs of two tables of turns (conv_id, turn, role, text) that share a conv_id."""
    a, b = (conversations(x).withColumnRenamed("turns", side) for x, side in ((chosen, "chosen"), (rejected, "rejected")))
    return formatted(a.join(b, "key"))


def variants(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, chosen, rejected) of a table without preferences, from every conversation with an answer (keys are whole numbers).

    Chosen is the whole conversation. Rejected leaves it at one of its answers, the (key mod number of answers)-th from 0,
    and goes on as the answered conversation with the next greater key does from its first answer on; after the last key
    comes the first. So what both share ends at any turn, and later if turns happen to be equal.
    """
    rows = conversations(turns, key)
    places = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.get("turns", i - 1)["role"].eqNullSafe(F.lit(TRAINED)))
    rows = scratch.written(rows.withColumn("answers", places).where(F.size("answers") > 0), "conversations")
    bucket, _ = ranges(rows.select("key"), "key")
    order = rows.select("key", bucket.alias("range"))
    firsts = order.groupBy("range").agg(F.min("key").alias("first"))
    up = Window.orderBy("range")
    beyond = firsts.select("range", F.coalesce(F.lead("first").over(up), F.first("first").over(up)).alias("beyond"))
    order = order.withColumn("after", F.lead("key").over(Window.partitionBy("range").orderBy("key"))).join(beyond, "range").select("key", F.coalesce("after", "beyond").alias("after"))
    tails = rows.select(F.col("key").alias("after"), F.slice("turns", F.get("answers", F.lit(0)), F.size("turns")).alias("tail"))
    at = F.get("answers", F.pmod(F.col("key"), F.size("answers")).cast("int"))
    return rows.join(order, "key").join(tails, "after").select("key", F.col("turns").alias("chosen"), F.concat(F.slice("turns", F.lit(1), at - 1), "tail").alias("rejected"))


def _spelt(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = formatted(variants(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    masks = [_spelt(F.col(f"{side}_mask")).alias(f"{side}_mask") for side in ("chosen", "rejected")]
    return found.select(F.col("key").alias("conv_id"), "prompt", "prompt_turns", "chosen", "rejected", *masks)


def _rendered_sql(turns: str) -> str:
    return f"array_to_string(list_transform({turns}, lambda t: '<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)), '')"


def _mask_sql(turns: str) -> str:
    size = "length(coalesce(t.role, '')) + length(coalesce(t.text, '')) + 13"
    before = f"coalesce(list_sum(list_transform({turns}[1:i - 1], lambda t: {size})), 0)"
    own = f"list_filter(range(1, len({turns}) + 1), lambda i: {turns}[i].role = 'assistant')"
    return f"array_to_string(list_transform({own}, lambda i: CAST(CAST({before} + 14 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST({before} + 22 + length(coalesce({turns}[i].text, '')) AS BIGINT) AS VARCHAR)), ',')"


OP5_SQL = f"""
WITH talks AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), answered AS (
  SELECT *, list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant') AS answers FROM talks
), chained AS (
  SELECT *, coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS after FROM answered WHERE len(answers) > 0
), pairs AS (
  SELECT a.conv_id, a.turns AS chosen, list_concat(a.turns[1:a.answers[a.conv_id % len(a.answers) + 1] - 1], b.turns[b.answers[1]:]) AS rejected
  FROM chained a JOIN chained b ON b.conv_id = a.after
), shared AS (
  SELECT *, CAST(coalesce(list_min(list_filter(range(1, greatest(len(chosen), len(rejected)) + 1), lambda i: i > len(chosen) OR i > len(rejected) OR chosen[i] IS DISTINCT FROM rejected[i])) - 1, len(chosen)) AS INTEGER) AS prompt_turns
  FROM pairs
), cut AS (
  SELECT conv_id, prompt_turns, chosen[1:prompt_turns] AS prompt, chosen[prompt_turns + 1:] AS chosen, rejected[prompt_turns + 1:] AS rejected FROM shared
)
SELECT conv_id, {_rendered_sql("prompt")} AS prompt, prompt_turns, {_rendered_sql("chosen")} AS chosen, {_rendered_sql("rejected")} AS rejected,
       {_mask_sql("chosen")} AS chosen_mask, {_mask_sql("rejected")} AS rejected_mask
FROM cut
"""
