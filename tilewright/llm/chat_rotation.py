"""Perspective rotation of dialogues with any number of speakers (operator 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators.ordered import number_rows

PART_TURNS = 256  # turns of a dialogue in one training text
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"  # this role gives instructions and is nobody's perspective


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """Each dialogue once for every speaker: conv, speaker, part, n_turns, n_targets, text, masks.

    The speaker's turns are rendered as assistant, the others as user with their name, system
    turns as system. `masks` lists the character spans (start, end) of the text that are to be
    learnt: what the speaker says, with the closing mark. Every part holds `part_turns` turns
    in order; a dialogue of any length is the sequence of its parts, and part 0 is all of a
    shorter one, so no task ever holds more than a part. Speakers are those of the whole
    dialogue; a part in which one is silent has no masks.

    Turns are in order of (turn, role, text), null turns last. A null role is the speaker
    `unknown`, a null text an empty one. Rows without a conversation key belong to no dialogue
    and give nothing; a dialogue of system turns only has no speaker and gives nothing;
    repeated rows are repeated turns; an empty table gives none; other columns are not read.
    Built-in functions only.
    """
    rows = turns.select(
        F.col(conv).alias("_c"),
        F.coalesce(F.col(turn).cast("bigint"), F.lit((1 << 62))).alias("_t"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("_r"),
        F.coalesce(F.col(text), F.lit("")).alias("_x"),
    ).filter("_c is not null")
    numbered = number_rows(rows, ["_c"], ["_t", "_r", "_x"], "_n", hot=True)
    parts = (
        numbered.withColumn("part", F.floor((F.col("_n") - 1) / part_turns).cast("bigint"))
        .groupBy("_c", "part")
        .agg(F.array_sort(F.collect_list(F.struct("_n", "_r", "_x"))).alias("_l"))
    )
    speakers = rows.filter(F.col("_r") != SYSTEM).select("_c", F.col("_r").alias("speaker")).distinct()
    each = parts.join(speakers, "_c")

    def head(t):
        return F.when(t["_r"] == SYSTEM, F.lit(f"{OPEN}system\n")).when(t["_r"] == F.col("speaker"), F.lit(f"{OPEN}assistant\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), t["_r"], F.lit("\n")))

    said = F.transform("_l", lambda t: F.struct(head(t).alias("head"), F.concat(t["_x"], F.lit(CLOSE)).alias("body"), (t["_r"] == F.col("speaker")).alias("own")))
    each = each.withColumn("_s", said)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(state, t):
        low = state["at"] + F.length(t["head"])
        high = low + F.length(t["body"])
        one = F.array(F.struct(low.alias("start"), high.alias("end")))
        return F.struct(high.alias("at"), F.when(t["own"], F.concat(state["spans"], one)).otherwise(state["spans"]).alias("spans"))

    return each.select(
        F.col("_c").alias(conv),
        "speaker",
        "part",
        F.size("_s").cast("bigint").alias("n_turns"),
        F.size(F.filter("_s", lambda t: t["own"])).cast("bigint").alias("n_targets"),
        F.array_join(F.transform("_s", lambda t: F.concat(t["head"], t["body"])), "").alias("text"),
        F.aggregate("_s", start, step, lambda s: s["spans"]).alias("masks"),
    )


ORACLE = f"""
with rows as (
  select conv_id, coalesce(role, 'unknown') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls last, coalesce(role, 'unknown'), coalesce(text, '')) - 1 as n
  from conversations where conv_id is not null
), speakers as (select distinct conv_id, role as speaker from rows where role <> '{SYSTEM}'),
said as (
  select r.conv_id, s.speaker, r.n // {PART_TURNS} as part, r.n, r.role = s.speaker as own,
         case when r.role = '{SYSTEM}' then '{OPEN}system' when r.role = s.speaker then '{OPEN}assistant' else '{OPEN}user name=' || r.role end || chr(10) as head,
         r.text || '<|im_end|>' || chr(10) as body
  from rows r join speakers s using (conv_id)
), placed as (
  select *, sum(length(head) + length(body)) over (partition by conv_id, speaker, part order by n) as high from said
)
select conv_id, speaker, part, count(*) as n_turns, count(*) filter (own) as n_targets,
       string_agg(head || body, '' order by n) as text,
       coalesce(string_agg((high - length(body))::bigint::varchar || '-' || high::bigint::varchar, ',' order by n) filter (own), '') as masks
from placed group by conv_id, speaker, part
"""
