"""Operator 3: chat formatting with a grammar round trip, in DataFrame functions only.

The template writes a turn as `[INST] role [/INST]text</s>`, one after the other. The parser splits
at `</s>`, reads the role up to the first ` [/INST]` and undoes escapes. The steps:

0. render without escapes, parse, compare each conversation with its source;
1. where they differ, escape the turns that don't survive a round trip of their own or that hold
   one of the control strings, parse and compare again;
2. where they still differ, escape every turn. `&`, `<` and `[` are then written as entities, so
   that no control string can be left, and parsing restores the source whatever it was.

Control strings inside texts are always escaped, also where the parser would cope with them.
A conversation that is not restored by step 2 (there is none) raises an error.

Defined cases: a null text or role counts as empty; turns are ordered by turn (null first), then
role, then text; repeated rows are repeated turns; rows with a null conv_id form one conversation;
a conversation is one row and so is bounded by what a row can hold, but takes time about in proportion to its
turns and texts; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import let, starts

# The template's marks, strings that chat models treat as control tokens, escapes.
OPEN, CLOSE, END = "[INST] ", " [/INST]", "</s>"
CONTROL = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
ENTITIES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;")]

TURN = "struct<role:string,text:string>"


def escape(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def has_control(text: Column) -> Column:
    found = F.lit(False)
    for mark in CONTROL:
        found = found | F.contains(text, F.lit(mark))
    return found


def render_turn(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE), turn["text"], F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render_turn), "")


def raw_turns(formatted: Column) -> Column:
    """Roles and texts as written, escapes included; what stands after the last end mark, or before
    an opening mark, makes a turn that no source has."""

    def read(x: Column) -> Column:
        part = x["p"]
        at = F.instr(part, CLOSE)
        fits = F.startswith(part, F.lit(OPEN)) & (at > 0) & ~x["last"]
        role = F.when(fits, F.substring(part, F.lit(len(OPEN) + 1), at - len(OPEN) - 1))
        text = F.when(fits, F.substring(part, at + len(CLOSE), F.length(part)))
        return F.struct(role.alias("role"), text.alias("text"))

    # the last part is what follows the last end mark: nothing, in well-formed text
    tagged = lambda cut: F.transform(cut, lambda p, i: F.struct(p.alias("p"), (i == F.size(cut) - 1).alias("last")))
    return F.transform(F.filter(let(F.split(formatted, r"</s>", -1), tagged), lambda x: ~(x["last"] & (x["p"] == ""))), read)


def parse(formatted: Column) -> Column:
    return F.transform(raw_turns(formatted), lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))


def escaped(turns: Column, when) -> Column:
    def one(t: Column) -> Column:
        hit = when(t)
        return F.struct(F.when(hit, escape(t["role"])).otherwise(t["role"]).alias("role"), F.when(hit, escape(t["text"])).otherwise(t["text"]).alias("text"))

    return F.transform(turns, one)


def conflicts(turn: Column) -> Column:
    """A turn that has a control string, or that does not survive a round trip of its own."""
    alone = parse(render_turn(turn))
    survives = (F.size(alone) == 1) & (F.element_at(alone, 1) == F.struct(turn["role"].alias("role"), turn["text"].alias("text")))
    return has_control(turn["text"]) | has_control(turn["role"]) | ~survives


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, turns (the source), formatted (the rendered text), rounds
    (0, 1 or 2: how far escaping went) and parsed (what the parser reads back, equal to turns)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("ordered"))
    source = grouped.select("conv_id", F.transform("ordered", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    same = lambda text: F.coalesce(parse(F.col(text)) == F.col("turns"), F.lit(False))
    any_control = F.exists("turns", lambda t: has_control(t["text"]) | has_control(t["role"]))
    first = source.withColumn("r0", render(F.col("turns")))
    second = first.withColumn("ok0", same("r0") & ~any_control).withColumn("r1", F.when(~F.col("ok0"), render(escaped(F.col("turns"), conflicts))))
    third = second.withColumn("ok1", same("r1")).withColumn("r2", F.when(~F.col("ok0") & ~F.col("ok1"), render(escaped(F.col("turns"), lambda t: F.lit(True)))))
    done = third.select(
        "conv_id", "turns", F.coalesce(F.when(F.col("ok0"), F.col("r0")), F.when(F.col("ok1"), F.col("r1")), F.col("r2")).alias("formatted"),
        F.when(F.col("ok0"), 0).when(F.col("ok1"), 1).otherwise(2).alias("rounds"),
    )
    read = done.withColumn("parsed", parse(F.col("formatted")))
    checked = F.when(F.col("parsed") == F.col("turns"), F.col("parsed")).otherwise(F.raise_error(F.lit("a conversation was not restored")).cast(f"array<{TURN}>"))
    return read.withColumn("parsed", checked)


def loss_texts(parsed: Column) -> Column:
    """The texts under the loss mask: the assistant's, in order."""
    return F.transform(F.filter(parsed, lambda t: t["role"] == "assistant"), lambda t: t["text"])


def loss_spans(formatted: Column) -> Column:
    """Where the loss mask is set in the formatted text: start and end (exclusive, code points) of
    each assistant text as written, escapes included."""
    sizes = F.transform(raw_turns(formatted), lambda t: F.struct(t["role"].alias("role"), (F.length(t["role"]) + len(OPEN) + len(CLOSE)).alias("head"), F.length(t["text"]).alias("n")))

    def placed(turns: Column) -> Column:
        spans = lambda at: F.transform(turns, lambda t, i: F.struct(t["role"].alias("role"), (F.get(at, i) + t["head"]).alias("start"), (F.get(at, i) + t["head"] + t["n"]).alias("stop")))
        return let(starts(F.transform(turns, lambda t: t["head"] + t["n"] + len(END))), spans)

    return F.transform(F.filter(let(sizes, placed), lambda s: s["role"] == "assistant"), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))


def report(conversations: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted text: turns, digests, length and what stands
    under the loss mask: the assistant's texts as parsed, which are the texts at loss_spans unescaped."""
    own = conversations.select("conv_id", "turn", "role", "text")
    done = format_chats(own)
    masked = F.array_join(loss_texts(F.col("parsed")), "")
    told = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.withColumn("masked", masked).select(
        "conv_id", F.size("parsed").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = """
WITH source AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, regexp_matches(role || chr(1) || text, '\\[INST\\]|\\[/INST\\]|<s>|</s>|<<SYS>>|<</SYS>>|<\\|im_start\\|>|<\\|im_end\\|>|<\\|endoftext\\|>|&amp;|&lt;|&lsqb;') AS hit FROM source
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(19 + CASE WHEN hit THEN length(replace(replace(replace(role || text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')) ELSE length(role || text) END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
