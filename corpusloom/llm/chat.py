"""Multi-party perspective rotation of dialogues, with DataFrame functions only.

For every participant of a conversation the dialogue is rendered once with
that speaker as the assistant; the others become users named after their role,
and system turns stay. The rendering is returned in segments, one row per
message, with the code-point offsets at which it lies in its dialogue and the
part that a loss mask covers (the speaker's own words and the end mark). The
concatenation of a dialogue's segments in order of ``start`` is its text, so
a conversation of any length is never gathered in one row or task: offsets
are running sums over chunks of turns, and running sums inside a chunk.

Marks can't be forged: ``<|`` in a text is written ``<||`` and ``|`` in a
speaker's name ``||``, which a reader turns back.

Defined cases: a null text is empty; a null role is the participant
``unknown``; a null conversation id is a conversation; repeated turns stay,
ordered by role and text; conversations without participants (system turns
only) give no rows; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import read_table

CHUNK_TURNS = 4_096
END = "<|end|>\n"


def _header(perspective: Column, role: Column) -> Column:
    return (
        F.when(role == "system", F.lit("<|system|>\n"))
        .when(role == perspective, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), F.replace(role, F.lit("|"), F.lit("||")), F.lit("|>\n")))
    )


def _chunk_starts(rows: DataFrame) -> DataFrame:
    """(_key, _chunk, perspective, _before): where each chunk of turns begins in each rendering.

    Only lengths are grouped and joined here, no text. A rendering's length is
    that of the dialogue with all speakers named, less what the perspective's
    own headers save.
    """
    per = rows.groupBy("_key", "_chunk", "speaker").agg(F.count("*").alias("_n"), F.sum(F.length("text") + len(END)).alias("_text"))
    # a null perspective owns no message, so every speaker is named
    per = per.withColumn("_named", F.length(_header(F.lit(None).cast("string"), F.col("speaker"))))
    chunks = per.groupBy("_key", "_chunk").agg(F.sum(F.col("_text") + F.col("_n") * F.col("_named")).alias("_all"))
    people = per.where("speaker <> 'system'").select("_key", F.col("speaker").alias("perspective")).distinct()
    saved = per.select("_key", "_chunk", F.col("speaker").alias("perspective"), (F.col("_n") * (F.col("_named") - F.length(F.lit("<|assistant|>\n")))).alias("_saved"))
    sizes = chunks.join(people, "_key").join(saved, ["_key", "_chunk", "perspective"], "left").withColumn("_size", F.col("_all") - F.coalesce("_saved", F.lit(0)))
    before = Window.partitionBy("_key", "perspective").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_key", "_chunk", "perspective", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))


def rotated(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, speaker, role, segment, start, end, mask_start, mask_end.

    Texts are shuffled once, by conversation and chunk; the offsets within a
    chunk are running sums on that partitioning.
    """
    rows = turns.select(
        "conv_id", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null")).alias("_key"),
        F.coalesce(F.floor(F.col("turn") / CHUNK_TURNS).cast("long"), F.lit(-(2**63))).alias("_chunk"),  # null turns come first
        "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("<||")).alias("text"),
    )
    out = rows.join(_chunk_starts(rows).hint("merge"), ["_key", "_chunk"])
    head = _header(F.col("perspective"), F.col("speaker"))
    size = (F.length(head) + F.length("text") + len(END)).cast("long")
    inside = Window.partitionBy("_key", "_chunk", "perspective").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns({"_head": F.length(head).cast("long"), "_size": size})
    out = out.withColumn("start", (F.col("_before") + F.coalesce(F.sum("_size").over(inside), F.lit(0))).cast("long"))
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == "system", "system").when(own, "assistant").otherwise("user")
    end = F.col("start") + F.col("_size")
    return out.select(
        "conv_id", "perspective", "turn", "speaker", role.alias("role"), F.concat(head, F.col("text"), F.lit(END)).alias("segment"), "start", end.alias("end"),
        F.when(own, F.col("start") + F.col("_head")).alias("mask_start"), F.when(own, end).alias("mask_end"),
    )


def op7_chat_rotation(spark, sf_dir: str) -> DataFrame:
    return rotated(read_table(spark, sf_dir, "conversations"))


ORACLE = """
with r as (select conv_id, turn, coalesce(role, 'unknown') as speaker, replace(coalesce(text, ''), '<|', '<||') as text from conversations),
p as (select distinct conv_id, speaker as perspective from r where speaker <> 'system'),
s as (
  select r.conv_id, perspective, turn, speaker, text,
    case when speaker = 'system' then '<|system|>' when speaker = perspective then '<|assistant|>' else '<|user name=' || replace(speaker, '|', '||') || '|>' end || chr(10) as head
  from r join p on r.conv_id is not distinct from p.conv_id),
t as (select *, head || text || '<|end|>' || chr(10) as segment from s),
o as (
  select *, coalesce(sum(length(segment)) over (partition by conv_id, perspective order by turn nulls first, speaker, text rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from t)
select conv_id, perspective, turn, speaker, case when speaker = 'system' then 'system' when speaker = perspective then 'assistant' else 'user' end as role,
  segment, start, start + length(segment) as "end",
  case when speaker = perspective then start + length(head) end as mask_start, case when speaker = perspective then start + length(segment) end as mask_end
from o
"""
