"""Preference formatting: the common prompt of two conversations and their two completions.

The longest common prefix of turns (same role and text) is rendered once as the prompt; what
follows on either side is rendered as its completion. In a completion only assistant turns
are trained on: the mask lists their character ranges, headers left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The template of a turn.
HEAD, TAIL, AFTER = "<|im_start|>", "<|im_end|>", "\n"
TRAINED = "assistant"


def render(turns: Column) -> Column:
    """Turns (role, text) in the chat template; no turns give an empty text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), t["role"], F.lit(AFTER), t["text"], F.lit(TAIL + AFTER))), "")


def mask(turns: Column) -> Column:
    """start:end of each trained reply in the rendered turns, end mark included, comma-joined."""
    step = lambda state, t: F.struct(
        (state["at"] + F.length(t["role"]) + F.length(t["text"]) + len(HEAD + AFTER + TAIL + AFTER)).alias("at"),
        F.when(
            t["role"] == TRAINED,
            F.concat(state["spans"], F.array(F.concat_ws(":", state["at"] + F.length(t["role"]) + len(HEAD + AFTER), state["at"] + F.length(t["role"]) + F.length(t["text"]) + len(HEAD + AFTER + TAIL)))),
        ).otherwise(state["spans"]).alias("spans"),
    )
    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")), step, lambda s: F.array_join(s["spans"], ","))


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turns): each conversation's turns by number, then role and text.

    Null roles and texts are empty; turns without a number come first; a turn that repeats
    whole counts once. Rows without a conversation id belong to none and are left out. A
    conversation is rendered as a whole, so its turns meet in one row. An empty table gives no
    rows; other columns are not read.
    """
    one = F.struct(F.col(turn_col).alias("n"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    grouped = turns.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_set(one)).alias("t"))
    return grouped.select("id", F.expr("transform(t, x -> struct(x.role, x.text))").alias("turns"))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pairs with columns chosen and rejected (arrays of role and text) gain n_prompt_turns,
    prompt, chosen_text, rejected_text, chosen_mask and rejected_mask.

    Two equal conversations have empty completions; without a common turn the prompt is
    empty. A null side counts as no turns.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    sides = pairs.withColumns({c: F.coalesce(c, none) for c in ("chosen", "rejected")})
    differ = F.expr("filter(sequence(0, least(size(chosen), size(rejected))), i -> i = least(size(chosen), size(rejected)) or get(chosen, i) <> get(rejected, i))")
    sides = sides.withColumn("n_prompt_turns", F.get(differ, F.lit(0)))
    rest = {c: F.expr(f"slice({c}, n_prompt_turns + 1, size({c}))") for c in ("chosen", "rejected")}
    return sides.select(
        "*",
        render(F.expr("slice(chosen, 1, n_prompt_turns)")).alias("prompt"),
        *[render(rest[c]).alias(f"{c}_text") for c in rest],
        *[mask(rest[c]).alias(f"{c}_mask") for c in rest],
    )


def borrowed_replies(convs: DataFrame) -> DataFrame:
    """(id, chosen, rejected): a pair for each conversation where the table has no preferences.

    chosen is the conversation; rejected is the same with its last assistant turn replaced by
    the last assistant turn of the conversation whose id is one higher, or cut there where
    no such turn exists. A conversation without an assistant turn is rejected by itself.
    """
    at = F.expr(f"aggregate(transform(turns, (t, i) -> if(t.role = '{TRAINED}', i, -1)), -1, (a, x) -> greatest(a, x))")
    own = convs.select("id", F.col("turns").alias("chosen"), at.alias("at"))
    donor = own.where("at >= 0").select((F.col("id") - 1).alias("id"), F.slice(F.col("chosen"), F.col("at") + 1, F.lit(1)).alias("reply"))
    kept = F.expr("slice(chosen, 1, at)")
    none = F.array().cast("array<struct<role:string,text:string>>")
    rejected = F.when(F.col("at") < 0, F.col("chosen")).otherwise(F.concat(kept, F.coalesce("reply", none), F.expr("slice(chosen, at + 2, size(chosen))")))
    return own.join(donor, "id", "left").select("id", "chosen", F.when((F.col("at") >= 0) & F.col("reply").isNull(), kept).otherwise(rejected).alias("rejected"))
