"""Preference formatting on DataFrame operations alone: common turns once as prompt, then paired masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import IntegralType

#: Chat markup: what stands before a role, between role and text, and after the text.
MARKUP = ("<|im_start|>", "\n", "<|im_end|>\n")


def preference_pairs(turns: DataFrame, markup: tuple[str, str, str] = MARKUP, trained: str = "assistant") -> DataFrame:
    """(pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask) of every pair.

    `turns` has (pair_id, side, turn, role, text), side being `chosen` or `rejected`. Turns are equal if role and text are
    (nulls count as empty, and as equal). The longest common prefix of turns is rendered as prompt; the rest of each side
    is its completion. A mask lists the spans [start, end) of its completion, in code points, that are trained on: text and
    end mark of the turns with role `trained`. Repeated (side, turn) rows are ordered by role and text; a side without
    turns has an empty completion; other columns aren't read; an empty table gives an empty result. A pair's turns meet in
    one row, since they are one training example; nothing else is gathered.
    """
    begin, middle, end = markup
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("pair_id", "side", "turn", role.alias("role"), text.alias("text")).repartition("pair_id")
    head = F.concat(F.lit(begin), "role", F.lit(middle))
    order = W.partitionBy("pair_id", "side").orderBy("turn", "role", "text")
    rows = rows.withColumn("head", F.length(head)).withColumn("long", F.col("head") + F.length("text") + len(end))
    rows = rows.withColumn("k", F.row_number().over(order)).withColumn("at", F.coalesce(F.sum("long").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    turn = F.struct("k", "role", "text", "at", "head", "long")
    sides = rows.groupBy("pair_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == s, turn))).alias(f"{s}_turns") for s in ("chosen", "rejected")])
    same = F.zip_with("chosen_turns", "rejected_turns", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first = F.array_position(same, False)
    sides = sides.withColumn("n_common", F.when(first > 0, first - 1).otherwise(F.size("chosen_turns")).cast("int"))

    def render(part: Column) -> Column:
        return F.array_join(F.transform(part, lambda t: F.concat(F.lit(begin), t["role"], F.lit(middle), t["text"], F.lit(end))), "")

    def rest(side: str) -> Column:
        return F.filter(f"{side}_turns", lambda t: t["k"] > F.col("n_common"))

    def mask(side: str) -> Column:
        start = F.coalesce(F.try_element_at(f"{side}_turns", F.col("n_common") + 1)["at"], F.lit(0))
        own = F.filter(rest(side), lambda t: t["role"] == trained)
        return F.transform(own, lambda t: F.struct((t["at"] + t["head"] - start).alias("start"), (t["at"] + t["long"] - start).alias("end")))

    prompt = render(F.filter("chosen_turns", lambda t: t["k"] <= F.col("n_common")))
    return sides.select("pair_id", "n_common", prompt.alias("prompt"), render(rest("chosen")).alias("chosen"), render(rest("rejected")).alias("rejected"), mask("chosen").alias("chosen_mask"), mask("rejected").alias("rejected_mask"))


def mismatched_pairs(conversations: DataFrame, buckets: int = 4096) -> DataFrame:
    """Turns of preference pairs made from every conversation: chosen is the conversation, rejected the same with the last
    turn's text taken from another one (without it, the last turn is missing).

    The other is the conversation whose id differs in the lowest bit where ids are whole numbers; else the next one in the
    order of hashes within one of `buckets` parts of their range. A null id is a conversation of its own without another;
    repeated rows are repeated turns; of rows that tie for the last turn all are exchanged; an empty table gives an empty result.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.select(F.col("conv_id").alias("id"), turn.alias("t"))
    ends = rows.groupBy("id").agg(F.max("t").alias("last"))
    if isinstance(rows.schema["id"].dataType, IntegralType):
        others = ends.select(F.col("id").bitwiseXOR(F.lit(1)).alias("for"), F.col("last.text").alias("other"))
    else:
        near = W.partitionBy(F.pmod(F.xxhash64("id"), F.lit(buckets))).orderBy(F.xxhash64("id", F.lit(1)), "id")
        others = ends.where("id IS NOT NULL").select(F.col("id").alias("for"), F.lead("last.text").over(near).alias("other"))
    ends = ends.join(others, ends.id == others["for"], "left").select(F.col("id").alias("of"), "last", "other")
    both = rows.join(ends, rows.id.eqNullSafe(ends.of)).select(F.col("id").alias("pair_id"), "t.*", (F.col("t") == F.col("last")).alias("is_last"), "other")
    chosen = both.select("pair_id", F.lit("chosen").alias("side"), "turn", "role", "text")
    rejected = both.where("NOT is_last OR other IS NOT NULL").select("pair_id", F.lit("rejected").alias("side"), "turn", "role", F.when(F.col("is_last"), F.col("other")).otherwise(F.col("text")).alias("text"))
    return chosen.unionByName(rejected)
