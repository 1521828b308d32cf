"""Relational chat formatting, in Spark expressions only.

The turns of a conversation are collected as structs and sorted; neighbours of one role are merged into a run; runs are joined
with the template's control strings:

    user        [INST] text [/INST]
    assistant   <s> text </s>
    other roles <<SYS:role>> text <</SYS>>

Texts merged into a run are parted by <|next|>. Every control string begins with < or [, and inside texts %, < and [ become
%25, %3C and %5B, so no text can hold a control string and the way back is exact.

A conversation is one output string, so its turns meet in one row; each step over them is linear in their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.frames import once, table

# The control strings of the template.
USER = ("[INST] ", " [/INST]")
ASSISTANT = ("<s> ", " </s>")
OTHER = ("<<SYS:", ">> ", " <</SYS>>")
NEXT = "<|next|>"
OPENING = r"(?=\[INST\] |<s> |<<SYS:)"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit("["), F.lit("%5B"))


def unescaped(text: Column) -> Column:
    """% comes last: an escaped % is followed by 25, so the others can't be mistaken."""
    return F.replace(F.replace(F.replace(F.replace(text, F.lit("%3E"), F.lit(">")), F.lit("%3C"), F.lit("<")), F.lit("%5B"), F.lit("[")), F.lit("%25"), F.lit("%"))


def _runs(turns: Column) -> Column:
    """Sorted (turn, role, text) structs to (role, texts) structs, one for each stretch of turns of one role."""
    def cut(turns: Column) -> Column:
        def bodies(texts: Column) -> Column:
            def merged(starts: Column) -> Column:
                def run(at: Column, k: Column) -> Column:
                    end = F.coalesce(F.get(starts, k + 1), F.size(texts))
                    return F.struct(F.get(turns, at)["role"].alias("role"), F.slice(texts, at + 1, end - at).alias("texts"))
                return F.transform(starts, run)
            places = F.sequence(F.lit(0), F.size(turns) - 1)
            return once(F.filter(places, lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"])), merged)
        return once(F.transform(turns, lambda t: escaped(t["text"])), bodies)
    return once(turns, cut)


def _opening(role: Column) -> Column:
    return F.when(role == "user", USER[0]).when(role == "assistant", ASSISTANT[0]) \
        .otherwise(F.concat(F.lit(OTHER[0]), F.replace(escaped(role), F.lit(">"), F.lit("%3E")), F.lit(OTHER[1])))


def _closing(role: Column) -> Column:
    return F.when(role == "user", USER[1]).when(role == "assistant", ASSISTANT[1]).otherwise(OTHER[2])


def format_chats(turns: DataFrame) -> DataFrame:
    """Per conv_id: n_turns, formatted, and loss_mask, a run-length code over formatted's code points: for each text, in
    order, how many to skip, to take and to skip again.

    The mask takes the assistant's texts, still escaped, and no control string. Turns go by turn, then role, then text (null turns first), so ties and repeated rows all stay, in a fixed order. A null text or role is empty.
    Rows without a conv_id are one conversation. Other columns are ignored.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(
        F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    runs = rows.groupBy("conv_id").agg(F.collect_list("t").alias("turns")) \
        .select("conv_id", F.size("turns").cast("long").alias("n_turns"), _runs(F.sort_array("turns")).alias("runs"))
    text = F.array_join(F.transform("runs", lambda r: F.concat(_opening(r["role"]), F.array_join(r["texts"], NEXT), _closing(r["role"]))), "")

    def masked(r: Column) -> Column:
        def part(body: Column, k: Column) -> Column:
            before = F.when(k == 0, F.length(_opening(r["role"]))).otherwise(len(NEXT))
            after = F.when(k == F.size(r["texts"]) - 1, F.length(_closing(r["role"]))).otherwise(0)
            taken = F.when(r["role"] == "assistant", F.length(body)).otherwise(0)
            return F.struct((before + F.length(body) - taken).alias("skip"), taken.alias("take"), after.alias("after"))
        return F.transform(r["texts"], part)
    return runs.select("conv_id", "n_turns", text.alias("formatted"), F.flatten(F.transform("runs", masked)).alias("loss_mask"))


def read_chats(chats: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): role and text structs parsed from formatted alone."""
    def parsed(piece: Column) -> Column:
        def inner(opening: Column | int, closing: str) -> Column:
            return F.substring(piece, opening + 1, F.length(piece) - opening - len(closing))
        named = F.substring_index(piece, ">> ", 1)  # <<SYS:role
        role = F.when(piece.startswith(USER[0]), "user").when(piece.startswith(ASSISTANT[0]), "assistant") \
            .otherwise(unescaped(F.substring(named, len(OTHER[0]) + 1, F.length(named))))
        body = F.when(piece.startswith(USER[0]), inner(F.lit(len(USER[0])), USER[1])).when(piece.startswith(ASSISTANT[0]), inner(F.lit(len(ASSISTANT[0])), ASSISTANT[1])) \
            .otherwise(inner(F.length(named) + len(OTHER[1]), OTHER[2]))
        return F.transform(F.split(body, r"<\|next\|>"), lambda text: F.struct(role.alias("role"), unescaped(text).alias("text")))
    pieces = F.filter(F.split("formatted", OPENING), lambda piece: piece != "")
    mask = ["loss_mask"] if "loss_mask" in chats.columns else []
    return chats.select("conv_id", "formatted", *mask, F.flatten(F.transform(pieces, parsed)).alias("turns"))


def learnt_text(formatted: Column, loss_mask: Column) -> Column:
    """The text under the mask, unescaped: formatted's code points beside one flag each, so that it takes one pass."""
    def flags(run: Column) -> Column:
        return F.concat(*[F.array_repeat(F.lit(name == "take"), run[name].cast("int")) for name in ("skip", "take", "after")])
    taken = F.zip_with(F.split(formatted, ""), F.flatten(F.transform(loss_mask, flags)), lambda c, flag: F.when(flag, c).otherwise(""))
    return unescaped(F.array_join(taken, ""))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text"))
                                                     for k, role in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    chats = format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more))
    read = read_chats(chats)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = learnt_text(F.col("formatted"), F.col("loss_mask"))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), learnt.alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars")) \
        .select("conv_id", "n_turns", "turns_sha256", F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
     f AS (SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens,
                  length(replace(replace(replace(text, '%', '%25'), '<', '%3C'), '[', '%5B')) AS n,
                  length(replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '[', '%5B'), '>', '%3E')) AS nr
           FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + CASE WHEN NOT opens THEN 8 WHEN role = 'user' THEN 15 WHEN role = 'assistant' THEN 9 ELSE 18 + nr END) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

QUERIES = {"op10_chat_formatting": op10_chat_formatting}
ORACLES = {"op10_chat_formatting": SQL}
