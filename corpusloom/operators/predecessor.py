"""Predecessor lookups as interval joins and values filled in from cell to cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import filled

#: Positions of a cell that an interval join meets in: each is compared with every head of its cell, which may hold as many heads.
CELL = 16


def head_of(asked: DataFrame, head: DataFrame) -> DataFrame:
    """``asked`` (doc_id, idx, …) with the columns of the head whose interval [start, next_start) holds idx.

    Both sides meet on (doc_id, idx div CELL); a head is copied to each cell
    it reaches, so a long document isn't one join key.
    """
    h = head.select(F.col("doc_id").alias("_d"), "head_id", F.col("start").alias("head_start"), F.coalesce(F.col("next_start"), F.col("start") + 1).alias("_end"), "pos", "len", "smaller")
    h = h.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("head_start") / CELL), F.floor((F.col("_end") - 1) / CELL))))
    a = asked.withColumn("_c", F.floor(F.col("idx") / CELL))
    met = a.join(h, (a["doc_id"] == h["_d"]) & (a["_c"] == h["_cell"]) & (F.col("idx") >= F.col("head_start")) & (F.col("idx") < F.col("_end")))
    return met.drop("_d", "_cell", "_c", "_end")


def pred_succ(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """For (doc_id, q): the largest key <= q and the least key >= q of (doc_id, key); null if none."""
    rows = keys.select("doc_id", F.col("key").alias("_at"), F.lit(None).cast("long").alias("q"), F.col("key")).union(
        asked.select("doc_id", F.col("q").alias("_at"), "q", F.lit(None).cast("long").alias("key")))
    rows = filled(rows, ["doc_id"], "_at", {"pred": F.col("key")})
    rows = filled(rows, ["doc_id"], "_at", {"succ": F.col("key")}, back=True)
    return rows.where("q is not null").select("doc_id", "q", "pred", "succ")


def next_heads(head: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, head_id, next_head_id, offset, next_isa): the head that holds the position after each head's match."""
    asked = head.where("not is_end").select("doc_id", F.col("head_id").alias("from_head"), (F.col("start") + F.col("len")).alias("idx"))
    met = head_of(asked, head).withColumn("offset", F.col("idx") - F.col("head_start"))
    isa = index.select(F.col("pos").alias("_p"), F.col("rank").alias("next_isa"))
    met = met.join(isa, (F.col("pos") + F.col("offset")) == F.col("_p"))
    return met.select("doc_id", F.col("from_head").alias("head_id"), F.col("head_id").alias("next_head_id"), "offset", "next_isa")
