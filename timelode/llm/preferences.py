"""Preference formatting: a chosen and a rejected conversation as one prompt and two masked completions.

The prompt is the longest common prefix of turns, rendered once; what differs is rendered as the two
completions. A completion's mask gives, in characters, runs of length and flag: 1 where a model is trained,
that is on the text and end mark of assistant turns, and 0 on headers and all other turns.

Built-in functions only. Cases: null roles and texts count as empty; turns are ordered by number, then role
and text, repeated rows stay; a pair without one of its sides gives no row; equal conversations give a
prompt and two empty completions; rows without a conversation id belong to no pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timelode.llm._common import table

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"


def _header(turn: Column) -> Column:
    return F.concat(F.lit(START), turn.role, F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn.text, F.lit(END))


def rendered(turns: Column) -> Column:
    """The text of an array of (role, text) turns."""
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(_header(t), _body(t))))


def mask(turns: Column) -> Column:
    """The loss mask of rendered(turns) as runs `length:flag`."""
    run = lambda t: F.concat(F.length(_header(t)), F.lit(":0,"), F.length(_body(t)), F.lit(":"), (t.role == TRAINED).cast("int"))
    return F.concat_ws(",", F.transform(turns, run))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """pair_id, common_turns, prompt, chosen, rejected and their masks, of pairs (pair_id, chosen, rejected) of arrays of (role, text) turns."""
    clean = lambda c: F.transform(F.coalesce(F.col(c), F.array()), lambda t: F.struct(F.coalesce(t.role, F.lit("")).alias("role"), F.coalesce(t.text, F.lit("")).alias("text")))
    both = pairs.select("pair_id", clean("chosen").alias("c"), clean("rejected").alias("r"))
    differs = F.array_position(F.zip_with("c", "r", lambda a, b: a.eqNullSafe(b)), False)
    both = both.withColumn("n", F.when(differs > 0, differs - 1).otherwise(F.size("c")).cast("int"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    return both.select(
        "pair_id",
        F.col("n").alias("common_turns"),
        rendered(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        rendered(rest("c")).alias("chosen"),
        rendered(rest("r")).alias("rejected"),
        mask(rest("c")).alias("chosen_mask"),
        mask(rest("r")).alias("rejected_mask"),
    )


def paired(conversations: DataFrame) -> DataFrame:
    """Neighbouring conversations as pairs: the even id is chosen, the next odd one rejected."""
    turn = F.struct((F.col("conv_id") % 2 != 0).alias("odd"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).groupBy(F.shiftright("conv_id", 1).alias("pair_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    side = lambda odd: F.filter("turns", lambda t: t.odd == F.lit(odd))
    return rows.select("pair_id", side(False).alias("chosen"), side(True).alias("rejected")).filter((F.size("chosen") > 0) & (F.size("rejected") > 0))


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All neighbouring conversations as preference pairs."""
    return format_preferences(paired(table(spark, sf_dir, "conversations")))


QUERIES = {"op3_preferences": op3_preferences}
_HEAD, _BODY = f"'{START}' || t.role || chr(10)", f"t.text || '{END[:-1]}' || chr(10)"
_TEXT = f"coalesce(array_to_string(list_transform({{}}, lambda t: {_HEAD} || {_BODY}), ''), '')"
_MASK = f"coalesce(array_to_string(list_transform({{}}, lambda t: length({_HEAD}) || ':0,' || length({_BODY}) || ':' || CAST(t.role = '{TRAINED}' AS INT)), ','), '')"
ORACLES = {
    "op3_preferences": f"""
        WITH s AS (
            SELECT conv_id >> 1 AS pair_id, conv_id & 1 AS odd,
                   list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1, 2),
        p AS (SELECT a.pair_id, a.l AS c, b.l AS r FROM s a JOIN s b ON a.pair_id = b.pair_id AND a.odd = 0 AND b.odd = 1),
        n AS (SELECT *, list_position(list_transform(range(1, greatest(len(c), len(r)) + 2), lambda i: coalesce(c[i] = r[i], false)), false) - 1 AS n FROM p)
        SELECT pair_id, CAST(n AS INT) AS common_turns,
               {_TEXT.format("c[1:n]")} AS prompt, {_TEXT.format("c[n+1:]")} AS chosen, {_TEXT.format("r[n+1:]")} AS rejected,
               {_MASK.format("c[n+1:]")} AS chosen_mask, {_MASK.format("r[n+1:]")} AS rejected_mask
        FROM n""",
}
