"""Matching statistics of a collection against one reference, heads, and statistics of heads.

For every position the match is the neighbouring reference suffix in sorted
order that shares more symbols; the successor wins ties (``smaller`` is then
true). Neighbours are found by windows inside buckets of the first symbols,
and buckets without a reference suffix on one side take it from the nearest
bucket that has one. Suffixes are compared as strings, which suits documents of
up to some thousand symbols; :func:`corpusloom.operators.ranking.doubled` ranks
longer ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import lcp, substr0
from ..storage import stored
from .ranking import CELL, bucket_rank, carried, common_prefixes, doubled, filled, numbered, running, sparse_start
from .refindex import with_plcp_max
from .symbols import Texts, next_place, of_texts, positions

BUCKET_SYMBOLS = 2


def suffixes(collection: DataFrame) -> DataFrame:
    """(doc_id, idx, s): every suffix of every document."""
    n = F.length("text")
    rows = collection.where(n > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    return rows.select("doc_id", F.col("i").cast("long").alias("idx"), substr0(F.col("text"), F.col("i")).alias("s"))


def matching_statistics(collection: DataFrame, reference: DataFrame) -> DataFrame:
    """(doc_id, idx, pos, len, smaller) of every symbol of the collection; ``reference`` is one row (ref_id, text)."""
    own = suffixes(reference.select(F.col("ref_id").alias("doc_id"), "text")).withColumn("src", F.lit(0))
    rows = own.union(suffixes(collection).withColumn("src", F.lit(1))).withColumn("_b", F.left("s", F.lit(BUCKET_SYMBOLS)))
    ref = F.when(F.col("src") == 0, F.struct("s", "idx"))
    span = Window.unboundedPreceding, -1
    up = Window.partitionBy("_b").orderBy("s", F.desc("src"), "doc_id", "idx").rowsBetween(*span)
    # a running last over the reversed order is linear; a first over following rows is not
    down = Window.partitionBy("_b").orderBy(F.desc("s"), "src", F.desc("doc_id"), F.desc("idx")).rowsBetween(*span)
    rows = rows.withColumns({"_p": F.last(ref, ignorenulls=True).over(up), "_n": F.last(ref, ignorenulls=True).over(down)}).where("src = 1")
    edges = own.union(suffixes(collection).withColumn("src", F.lit(1))).groupBy(F.left("s", F.lit(BUCKET_SYMBOLS)).alias("_b")).agg(F.min(ref).alias("_lo"), F.max(ref).alias("_hi"))
    order = Window.orderBy("_b").rowsBetween(*span)
    back = Window.orderBy(F.desc("_b")).rowsBetween(*span)
    edges = edges.select("_b", F.last("_hi", ignorenulls=True).over(order).alias("_pb"), F.last("_lo", ignorenulls=True).over(back).alias("_nb"))
    rows = rows.join(edges, "_b").withColumns({"_p": F.coalesce("_p", "_pb"), "_n": F.coalesce("_n", "_nb")})
    rows = rows.withColumns({"_lp": F.coalesce(lcp(F.col("s"), F.col("_p.s")), F.lit(-1)), "_ln": F.coalesce(lcp(F.col("s"), F.col("_n.s")), F.lit(-1))})
    after = F.col("_ln") >= F.col("_lp")
    return rows.select(
        "doc_id", "idx", F.when(after, F.col("_n.idx")).otherwise(F.col("_p.idx")).alias("pos"),
        F.greatest("_lp", "_ln", F.lit(0)).cast("long").alias("len"), after.alias("smaller"),
    )


def matching_statistics_by_ranks(collection: DataFrame, reference: DataFrame, cell: int = CELL) -> DataFrame:
    """As :func:`matching_statistics`, for documents and references of any length; no suffix is materialised.

    Reference and collection are ranked together by prefix doubling. The
    nearest reference suffixes are found inside cells of ranks, with what
    neighbouring cells carry over, and match lengths come from the ranks of
    the doubling rounds. Documents are told from the reference by a flag, so
    ids may coincide.
    """
    key = lambda flag, id_: F.struct(F.lit(flag).alias("f"), F.col(id_).cast("long").alias("d"))
    both = reference.select(key(0, "ref_id").alias("doc_id"), "text").union(collection.select(key(1, "doc_id").alias("doc_id"), "text"))
    levels: list = []
    ranks = doubled(sparse_start(positions(both, 1).select("doc_id", "idx", "key"), F.col("key"), []), 1, [], levels)
    rows = ranks.select("doc_id", "idx", "r", (F.col("doc_id.f") == 0).alias("_own"), F.floor(F.col("r") / cell).alias("_b"))
    ref = F.when(F.col("_own"), F.struct("r", "doc_id", "idx"))
    # a document's suffix equal to the reference's comes first: the reference's is then its successor
    span = Window.unboundedPreceding, -1
    up = Window.partitionBy("_b").orderBy("r", "_own").rowsBetween(*span)
    down = Window.partitionBy("_b").orderBy(F.desc("r"), F.desc("_own")).rowsBetween(*span)
    near = rows.withColumns({"_p": F.last(ref, ignorenulls=True).over(up), "_n": F.last(ref, ignorenulls=True).over(down)}).where("not _own")
    edges = rows.groupBy("_b").agg(F.min(ref).alias("_lo"), F.max(ref).alias("_hi"))
    edges = carried(edges, "_b", {"_pb": "_hi"}).join(carried(edges, "_b", {"_nb": "_lo"}, back=True), "_b")
    near = near.join(edges, "_b").select("doc_id", "idx", F.coalesce("_p", "_pb").alias("_p"), F.coalesce("_n", "_nb").alias("_n"))
    side = lambda c, name: near.select(F.lit(name).alias("side"), F.col("doc_id").alias("da"), F.col("idx").alias("ia"), F.col(f"{c}.doc_id").alias("db"), F.col(f"{c}.idx").alias("ib"))
    pairs = stored(side("_p", "p").union(side("_n", "n")).where("db is not null"), "neighbours")
    shared = common_prefixes(pairs, levels)
    best = shared.groupBy("da", "ia").agg(F.max(F.struct("len", (F.col("side") == "n").alias("smaller"), "ib")).alias("x"))
    return best.select(F.col("da.d").alias("doc_id"), F.col("ia").alias("idx"), F.col("x.ib").alias("pos"), "x.len", "x.smaller")


def with_mismatch(ms: DataFrame, collection: DataFrame) -> DataFrame:
    """Adds ``mismatch``: the symbol after each match, empty where the document ends."""
    after = positions(collection).select("doc_id", F.col("idx").alias("_after"), F.col("sym").alias("mismatch"))
    return ms.withColumn("_after", F.col("idx") + F.col("len")).join(after, ["doc_id", "_after"], "left").withColumn("mismatch", F.coalesce("mismatch", F.lit(""))).drop("_after")


def with_runs(ms: DataFrame, collection: DataFrame, reference: DataFrame, symbol: str) -> DataFrame:
    """Matching statistics in which a position of ``symbol`` has what is left of its run as length, and the reference's end as position."""
    runs = symbol_runs(collection, symbol).select("doc_id", "idx", F.col("len").alias("_run"))
    end = F.lit(reference.select(F.length("text")).first()[0]).cast("long")  # one reference
    hit = F.col("_run").isNotNull()
    return ms.join(runs, ["doc_id", "idx"], "left").select(
        "doc_id", "idx", F.when(hit, end).otherwise(F.col("pos")).alias("pos"), F.coalesce("_run", "len").alias("len"), F.when(hit, False).otherwise(F.col("smaller")).alias("smaller"))


def unambiguous(head: DataFrame, index: DataFrame) -> DataFrame:
    """One row: heads whose match occurs once in the reference, and all that match something."""
    once = with_plcp_max(index).select("pos", "plcp_max")
    return head.where("not is_end and len > 0").join(once, "pos").agg(F.count("*").alias("n_matched"), F.count_if(F.col("len") > F.col("plcp_max")).alias("n_unambiguous"))


def phrase_sequences(head: DataFrame) -> DataFrame:
    """(order_no, doc_id, n_phrases): documents by their sequences of (pos, len), a shorter one before its continuations.

    Phrases are symbols here, ranked by (pos, len), and sequences are sorted by
    prefix doubling: neither a document's phrases nor the documents of one
    first phrase, or of one sequence, meet in one row or window.
    """
    rows = head.where("not is_end").select("doc_id", (F.col("head_id") - 1).alias("idx"), "pos", "len")
    by = rows.groupBy("pos", "len").agg(F.count("*").alias("_n"))
    offset = running(by.groupBy("pos").agg(F.sum("_n").alias("_all")), "pos", "_all", "_off").drop("_all")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("pos").orderBy("len").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by = by.withColumn("_before", before).join(offset, "pos").select("pos", "len", "_n", (F.col("_off") + F.col("_before")).alias("r"))
    whole = stored(doubled(rows.join(by, ["pos", "len"]), 1, []).where("idx = 0").select("doc_id", "idx", "r"), "sequences")
    place = running(whole.groupBy("r").agg(F.count("*").alias("_n")), "r", "_n", "_place")
    order = numbered(whole.join(place, "r").select("doc_id", "idx", F.col("_place").alias("r"), "_n"))
    sizes = rows.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_phrases"))
    return order.join(sizes, "doc_id").select(F.col("rank").alias("order_no"), "doc_id", "n_phrases")


def heads(ms: DataFrame, collection: DataFrame, reference: DataFrame, after_empty: bool = False) -> DataFrame:
    """(doc_id, head_id, start, next_start, pos, len, smaller, is_end): positions whose match doesn't continue the one before, and document ends.

    An empty match tells nothing of the next position, whose own match may lie
    one place on by chance. With ``after_empty`` such positions are heads too,
    so heads alone tell all matches.
    """
    w = Window.partitionBy("doc_id").orderBy("idx")
    before = F.when(F.col("len") == 0, -2).otherwise(F.col("pos")).cast("long") if after_empty else F.col("pos")
    first = filled(ms, ["doc_id"], "idx", {"_before": before}, own=False).where("_before is null or _before < 0 or pos <> _before + 1")
    last = reference.select((F.length("text") - 1).cast("long").alias("pos"))  # one row, as one reference is
    ends = collection.select("doc_id", F.length("text").cast("long").alias("idx")).join(last).select("doc_id", "idx", "pos", F.lit(0).cast("long").alias("len"), F.lit(False).alias("smaller"), F.lit(True).alias("is_end"))
    rows = first.select("doc_id", "idx", "pos", "len", "smaller", F.lit(False).alias("is_end")).union(ends)
    return rows.select(
        "doc_id", F.row_number().over(w).cast("long").alias("head_id"), F.col("idx").alias("start"), F.lead("idx").over(w).alias("next_start"), "pos", "len", "smaller", "is_end")


def symbol_runs(collection: DataFrame, symbol: str) -> DataFrame:
    """(doc_id, idx, len): how long the run of ``symbol`` lasts from each of its positions."""

    def told(t: Texts) -> tuple[np.ndarray, dict]:
        hit = t.code == ord(symbol) + 1
        at = np.flatnonzero(hit)
        return t.doc[at], {"idx": t.idx[at], "len": next_place(~hit)[at] - at}

    return of_texts(collection, told, "idx long, len long")


def head_statistics(head: DataFrame, index: DataFrame) -> DataFrame:
    """One row of counts over the heads that are not document ends."""
    top = index.agg(F.max("lcp").alias("max_lcp"))
    rows = head.where("not is_end").join(top)
    return rows.agg(
        F.count("*").alias("n_heads"), F.coalesce(F.sum("len"), F.lit(0)).alias("sum_len"), F.max("len").alias("max_len"),
        F.count_if(F.col("len") == 0).alias("n_zero"), F.count_if(F.col("len") <= F.col("max_lcp")).alias("n_short"),
        (F.sum("len").cast("double") / F.count("*")).alias("avg_len"),
    )


def with_slot(head: DataFrame, index: DataFrame) -> DataFrame:
    """Adds ``slot``: the rank of the matched reference position."""
    return head.join(index.select("pos", F.col("rank").alias("slot")), "pos")


def heads_by_slot(head: DataFrame, index: DataFrame) -> DataFrame:
    """(rank, n): heads for each reference rank, 0 included."""
    counts = with_slot(head.where("not is_end"), index).groupBy(F.col("slot").alias("rank")).count()
    return index.select("rank").join(counts, "rank", "left").select("rank", F.coalesce("count", F.lit(0)).alias("n"))


def sorted_phrases(head: DataFrame, index: DataFrame) -> DataFrame:
    """(order_no, doc_id, start, pos, len): heads by slot and length."""
    rows = with_slot(head.where("not is_end"), index)
    return bucket_rank(rows, F.col("slot"), ["len", "doc_id", "start"], "order_no").select("order_no", "doc_id", "start", "pos", "len")


def length_buckets(phrases: DataFrame) -> DataFrame:
    """One row: how many runs of equal length the sorted phrases have, and the longest."""
    before = phrases.select((F.col("order_no") + 1).alias("order_no"), F.col("len").alias("_l"))
    starts = phrases.join(before, "order_no", "left").where("_l is null or _l <> len").select("order_no")
    starts = bucket_rank(starts, F.floor(F.col("order_no") / CELL), ["order_no"], "k")
    following = starts.select((F.col("k") - 1).alias("k"), F.col("order_no").alias("_next"))
    total = phrases.agg(F.count("*").alias("_n"))
    runs = starts.join(following, "k", "left").join(total).select((F.coalesce("_next", "_n") - F.col("order_no")).alias("run"))
    return runs.agg(F.count("*").alias("n_buckets"), F.max("run").alias("max_run"))
