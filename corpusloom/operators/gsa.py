"""The generalized suffix array of a collection, suffix types, sorted heads, and checks.

The canonical order is (suffix, doc_id, idx); the end of a document is less
than every symbol.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import substr0
from ..storage import importable, stored, stored_alone
from .anchored import gapless, ordered, suffix_order
from .matchstats import suffixes
from .ranking import bucket_rank, chased, filled, numbered, refined, running, sparse_start
from .predecessor import head_of, next_heads
from .refindex import symbol_at
from .symbols import Texts, next_place, of_texts, positions

START = 3
#: Ranks of a cell in which each row meets the one before.
NEAR = 1 << 16


def gsa(collection: DataFrame) -> DataFrame:
    """(rank, doc_id, idx) by anchors; documents of any length."""
    return gapless(stored_alone(lambda: suffix_order(collection), collection.sparkSession, "gsa"))


def gsa_bucketed(collection: DataFrame) -> DataFrame:
    """(rank, doc_id, idx) by sorting suffix strings in buckets of their first symbols; for short documents."""
    rows = suffixes(collection)
    return bucket_rank(rows, F.left("s", F.lit(START)), ["s", "doc_id", "idx"]).select("rank", "doc_id", "idx")


def gsa_by_matches(collection: DataFrame, matches: DataFrame, index: DataFrame) -> DataFrame:
    """(rank, doc_id, idx) from matching statistics, never comparing text.

    A suffix sorts by its match's rank, the side it lies on, and the match
    length; what it still shares is told apart by the suffix after the match.
    Pointers jump over one match, then two, four, …. The reference must hold
    every symbol, so that every match moves on.
    """
    ms = matches.join(index.select("pos", "rank"), "pos")
    side = F.when(F.col("smaller"), F.col("len")).otherwise(-F.col("len"))
    offset = sparse_start(ms.select("doc_id", "idx", "rank", (~F.col("smaller")).alias("_side"), side.alias("_len"), (F.col("idx") + F.col("len")).alias("jump")), F.col("rank"), []).drop("_n")
    place = F.rank().over(Window.partitionBy("rank").orderBy("_side", "_len")) - 1
    rows = offset.select("doc_id", "idx", "jump", (F.col("r") + place).cast("long").alias("r"), F.count("*").over(Window.partitionBy("rank", "_side", "_len")).alias("_n"))
    ends = collection.select("doc_id", F.length("text").cast("long").alias("idx"))
    rows = rows.union(ends.select("doc_id", "idx", F.col("idx").alias("jump"), F.lit(-1).cast("long").alias("r"), F.lit(1).cast("long").alias("_n")))
    rows, state = stored(rows, "match-ranks"), None
    while True:
        *now, largest = rows.agg(F.count_distinct("r"), F.sum(F.when(F.col("jump") > F.col("idx"), 1).otherwise(0)), F.sum("jump"), F.max("_n")).first()
        if now == state:
            break
        state = now
        to = rows.select("doc_id", F.col("idx").alias("jump"), F.col("r").alias("_r"), F.col("jump").alias("_j"))
        both = refined(rows.join(to, ["doc_id", "jump"]).where("r >= 0"), "_r", None, largest).select("doc_id", "idx", F.col("_j").alias("jump"), "r", "_n")
        rows = stored(both.union(rows.where("r < 0")), "match-ranks")
    return numbered(rows.where("r >= 0"))


def anchors(head: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, head_id, next_head_id, r, _n): for each head the place after its match, ranked by its own match.

    That place is inside another head (``next_head_id``), whose match it
    shares, so its next place is that head's: the places are closed, one for
    each head. ``r`` is -1 for document ends, ``_n`` how many have this rank.
    """
    sides = head.select("doc_id", F.col("head_id").alias("next_head_id"), "len", "smaller", "is_end")
    rows = stored(next_heads(head, index).join(sides, ["doc_id", "next_head_id"]).withColumn("_left", F.col("len") - F.col("offset")), "next-heads")
    signed = F.when(F.col("smaller"), F.col("_left")).otherwise(-F.col("_left"))
    ends = rows.where("is_end").select("doc_id", "head_id", "next_head_id", F.lit(-1).cast("long").alias("r"), F.lit(1).cast("long").alias("_n"))
    rows = rows.where("not is_end").select("doc_id", "head_id", "next_head_id", "next_isa", (~F.col("smaller")).cast("int").alias("_side"), signed.alias("_len"))
    sizes = running(rows.groupBy("next_isa").agg(F.count("*").alias("_n")), "next_isa", "_n", "r").drop("_n")
    by = rows.groupBy("next_isa", "_side", "_len").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("next_isa").orderBy("_side", "_len").rowsBetween(Window.unboundedPreceding, -1))
    by = by.select("next_isa", "_side", "_len", "_n", F.coalesce(before, F.lit(0)).alias("_p")).join(sizes, "next_isa")
    ranked = rows.join(by, ["next_isa", "_side", "_len"]).select("doc_id", "head_id", "next_head_id", (F.col("r") + F.col("_p")).cast("long").alias("r"), "_n")
    stop = head.where("is_end").select("doc_id", "head_id", F.col("head_id").alias("next_head_id"), F.lit(-1).cast("long").alias("r"), F.lit(1).cast("long").alias("_n"))
    return ranked.union(ends).union(stop)


def anchor_ranks(head: DataFrame, index: DataFrame, counts: list | None = None) -> DataFrame:
    """(doc_id, head_id, after): the rank of what follows each head's match, by doubling over heads alone.

    Rounds are those of :func:`ranking.chased`, whose ``counts`` these are.
    """
    rows = anchors(head, index).select("doc_id", F.col("head_id").alias("at"), F.col("next_head_id").alias("to"), "r", "_n")
    return chased(stored(rows, "anchors"), counts).select("doc_id", F.col("at").alias("head_id"), F.col("r").alias("after"))


def sorted_by_heads(asked: DataFrame, head: DataFrame, index: DataFrame, ranks: DataFrame) -> DataFrame:
    """(order_no, doc_id, idx) of positions ``asked`` (doc_id, idx) in suffix order, without text.

    A position sorts by the slot of its match, the side it lies on, what is
    left of its head's match, and the rank of what follows that (``ranks``).
    """
    rows = head_of(asked.select("doc_id", "idx"), head).join(ranks, ["doc_id", "head_id"])
    rows = rows.withColumn("_k", F.col("idx") - F.col("head_start")).withColumn("_left", F.col("len") - F.col("_k"))
    rows = rows.withColumn("_at", F.col("pos") + F.col("_k")).join(index.select(F.col("pos").alias("_at"), F.col("rank").alias("slot")), "_at")
    rows = rows.select("doc_id", "idx", "slot", (~F.col("smaller")).alias("_side"), F.when(F.col("smaller"), F.col("_left")).otherwise(-F.col("_left")).alias("_len"), "after")
    return bucket_rank(rows, F.col("slot"), ["_side", "_len", "after", "doc_id", "idx"], "order_no").select("order_no", "doc_id", "idx")


def gsa_by_heads(collection: DataFrame, head: DataFrame, index: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """(rank, doc_id, idx) from sorted heads. The reference must hold every symbol, as :func:`gsa_by_matches` needs it.

    ``ranks`` are the heads' :func:`anchor_ranks`, where they were made before.
    """
    if ranks is None:
        ranks = stored(anchor_ranks(head, index), "anchor-ranks")
    return sorted_by_heads(positions(collection), head, index, ranks).withColumnRenamed("order_no", "rank")


def suborder_violations(order: DataFrame, array: DataFrame) -> DataFrame:
    """One row: positions sorted in ``order`` (order_no, doc_id, idx), empty entries, and neighbours that the suffix array has the other way round."""
    rows = order.join(array, ["doc_id", "idx"], "left").select(F.col("order_no").alias("rank"), F.col("rank").alias("place"))
    return with_before(rows, ["place"]).agg(
        F.count("*").alias("n"), F.count_if(F.col("place").isNull()).alias("n_empty"), F.count_if(F.col("_b.place") >= F.col("place")).alias("violations"))


def _falls(t: Texts) -> np.ndarray:
    """Whether each suffix is greater than the next one; ends aren't."""
    step = np.diff(t.code, append=0)
    step[t.code == 0] = 1
    return step[next_place(step != 0)] < 0


def star_places(t: Texts) -> np.ndarray:
    """Whether each place is of type S and after one of type L, which is of the same text: ends don't fall."""
    falls = _falls(t)
    return ~falls & np.append(False, falls[:-1])


def star_order(collection: DataFrame, ranks: DataFrame) -> DataFrame:
    """(doc_id, idx, _id): S* positions alone in suffix order, ``_id`` rising with it; ``ranks`` are those of :func:`anchored.mark_ranks`."""
    return ordered(collection, ranks, asked=lambda m: star_places(m.texts))


def types(collection: DataFrame) -> DataFrame:
    """(doc_id, idx, sym, type): L if the suffix is greater than the next one, else S; document ends are S."""

    def told(t: Texts) -> tuple[np.ndarray, dict]:
        return t.doc, {"idx": t.idx, "sym": t.symbols(np.arange(len(t.code))), "type": pa.array(["S", "L"]).take(pa.array(_falls(t).astype(np.int8)))}

    return of_texts(collection, told, "idx long, sym string, type string")


def s_star(typed: DataFrame) -> DataFrame:
    """(doc_id, idx, sym) of S positions after an L position."""
    rows = filled(typed, ["doc_id"], "idx", {"_before": F.col("type")}, own=False)
    return rows.where("type = 'S' and _before = 'L'").select("doc_id", "idx", "sym")


def stars(collection: DataFrame) -> DataFrame:
    """As :func:`s_star` of :func:`types`, told from whole texts where they lie: nothing is shuffled."""

    def told(t: Texts) -> tuple[np.ndarray, dict]:
        at = np.flatnonzero(star_places(t))
        return t.doc[at], {"idx": t.idx[at], "sym": t.symbols(at)}

    return of_texts(collection, told, "idx long, sym string")


def sorted_heads(head: DataFrame, collection: DataFrame, index: DataFrame) -> DataFrame:
    """(order_no, name, doc_id, head_id): heads by slot, side, length and next symbol, and the dense name of that key.

    Names count from 2; all document ends have name 1 and no place in the order.
    """
    after = positions(collection).select("doc_id", F.col("idx").alias("_after"), "sym")
    rows = head.where("not is_end").withColumn("_after", F.col("start") + F.col("len")).join(after, ["doc_id", "_after"], "left").join(index.select("pos", F.col("rank").alias("slot")), "pos")
    key = {"_side": ~F.col("smaller"), "_len": F.when(F.col("smaller"), F.col("len")).otherwise(-F.col("len")), "_next": F.coalesce("sym", F.lit(""))}
    rows = rows.withColumns(key).select("doc_id", "head_id", "slot", *key)
    ordered = bucket_rank(rows, F.col("slot"), [*key, "doc_id", "head_id"], "order_no")
    names = bucket_rank(rows.select("slot", *key).distinct(), F.col("slot"), list(key), "_name")
    named = ordered.join(names, ["slot", *key]).select("order_no", (F.col("_name") + 2).alias("name"), "doc_id", "head_id")
    ends = head.where("is_end").select(F.lit(None).cast("long").alias("order_no"), F.lit(1).cast("long").alias("name"), "doc_id", "head_id")
    return named.union(ends)


def order_violations(array: DataFrame, collection: DataFrame) -> DataFrame:
    """One row: rows, distinct positions, least and greatest rank, and neighbours out of order."""
    text = collection.select("doc_id", "text")
    rows = array.join(text, "doc_id").select("rank", "doc_id", "idx", substr0(F.col("text"), F.col("idx")).alias("s"))
    before = rows.select((F.col("rank") + 1).alias("rank"), F.col("s").alias("_s"))
    return rows.join(before, "rank", "left").agg(
        F.count("*").alias("n"), F.count_distinct("doc_id", "idx").alias("n_distinct"), F.min("rank").alias("min_rank"), F.max("rank").alias("max_rank"),
        F.count_if(F.col("_s") > F.col("s")).alias("violations"),
    )


def followed(array: DataFrame, collection: DataFrame) -> DataFrame:
    """(rank, code, falls, next, last, first) of each place of ``array``: its symbol, whether its suffix is greater than the next one, that one's rank.

    ``next`` is -1 at the last place of a document, which then is ``last``; ``first`` is false for a place that was there before.
    Told document by document: the array meets each text once.
    """
    kinds = {"rank": pa.int64(), "code": pa.int64(), "falls": pa.bool_(), "next": pa.int64(), "last": pa.int64(), "first": pa.bool_()}

    def told(key, places: pa.Table, texts: pa.Table) -> pa.Table:
        if not texts.num_rows:
            places = places.slice(0, 0)
        t = Texts(pa.array(["."]), [texts["text"][0].as_py() or "" if texts.num_rows else ""])
        idx, rank = places["idx"].to_numpy(), places["rank"].to_numpy()
        inside = np.flatnonzero((idx >= 0) & (idx < len(t.code) - 1))
        idx, rank = idx[inside], rank[inside]
        order = np.lexsort((rank, idx))
        idx, rank = idx[order], rank[order]
        after = np.searchsorted(idx, idx + 1)
        has = np.append(idx, -1)[after] == idx + 1
        following = np.where(has, np.append(rank, -1)[after], -1)
        found = [rank, t.code[idx], _falls(t)[idx], following, np.where(has, 0, key[0].as_py()), np.diff(idx, prepend=-1) != 0]
        return pa.table({n: pa.array(c, kind) for (n, kind), c in zip(kinds.items(), found)})

    importable(array.sparkSession)
    by = array.select("doc_id", "idx", "rank").groupBy("doc_id").cogroup(collection.select("doc_id", "text").groupBy("doc_id"))
    return by.applyInArrow(told, "rank long, code long, falls boolean, next long, last long, first boolean")


def with_before(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``_b``: ``columns`` of the row that is next before in rank; told in cells of ranks, whose last rows are in the next cell too."""
    cell, last = F.floor(F.col("rank") / NEAR), F.col("rank") % NEAR == NEAR - 1
    cells = rows.withColumn("_cell", F.explode(F.when(last, F.array(cell, cell + 1)).otherwise(F.array(cell))))
    before = F.lag(F.struct(*columns)).over(Window.partitionBy("_cell").orderBy("rank"))
    return cells.withColumn("_b", before).where(F.col("_cell") == cell).drop("_cell")


def linear_violations(array: DataFrame, collection: DataFrame) -> DataFrame:
    """One row: rows, distinct positions, greatest rank, and neighbours out of order, for documents of any length.

    An array is right if (symbol, rank of the next position) rises with rank;
    where both next positions are document ends the document decides. So no
    suffix is compared.
    """
    key = ["code", "next", "last"]
    rows = with_before(followed(array, collection), key)
    return rows.agg(
        F.count("*").alias("n"), F.count_if("first").alias("n_distinct"), F.max("rank").alias("max_rank"),
        F.count_if(F.col("_b") >= F.struct(*key)).alias("violations"),
    )


def induced_violations(array: DataFrame, collection: DataFrame, kind: str) -> DataFrame:
    """As :func:`induction_violations` of all :func:`types`, which the texts tell where they meet the array."""
    key = ["code", "falls", "next", "last"]
    falls, b = F.col("falls"), F.col("_b")
    wrong = (b["code"] > F.col("code")) | (b["code"] == F.col("code")) & (
        (~b["falls"] & falls) | (b["falls"] == falls) & (F.struct(b["next"], b["last"]) >= F.struct("next", "last")))
    rows = with_before(followed(array, collection), key)
    return rows.where(falls if kind == "L" else ~falls).agg(F.count("*").alias("n"), F.count_if(wrong).alias("violations"))


def sa_violations(index: DataFrame, refs: DataFrame) -> DataFrame:
    """The linear check for each reference: a permutation, and (symbol, rank of the next position) rises with rank."""
    follow = index.select("ref_id", (F.col("pos") - 1).alias("pos"), F.col("rank").alias("_next"))
    rows = index.join(symbol_at(refs), ["ref_id", "pos"]).join(follow, ["ref_id", "pos"], "left").select("ref_id", "rank", "pos", F.struct(F.col("sym").alias("c"), F.coalesce("_next", F.lit(-1)).alias("r")).alias("_key"))
    before = rows.select("ref_id", (F.col("rank") + 1).alias("rank"), F.col("_key").alias("_k"))
    return rows.join(before, ["ref_id", "rank"], "left").groupBy("ref_id").agg(
        F.count("*").alias("n"), F.count_distinct("pos").alias("n_distinct"), F.min("pos").alias("min_pos"), F.max("pos").alias("max_pos"),
        F.count_if(F.col("_k") >= F.col("_key")).alias("violations"),
    )


def sa_outcome(index: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref_id, outcome) of the linear check: 0 right, -1 not as many rows as symbols, -2 a position out of range or missing, -3 first symbols out of order, -4 suffixes out of order."""
    follow = index.select("ref_id", (F.col("pos") - 1).alias("pos"), F.col("rank").alias("_next"))
    rows = index.join(symbol_at(refs), ["ref_id", "pos"], "left").join(follow, ["ref_id", "pos"], "left").select("ref_id", "rank", "pos", "sym", F.coalesce("_next", F.lit(-1)).alias("r"))
    before = rows.select("ref_id", (F.col("rank") + 1).alias("rank"), F.col("sym").alias("_sym"), F.col("r").alias("_r"))
    seen = rows.join(before, ["ref_id", "rank"], "left").groupBy("ref_id").agg(
        F.count("*").alias("n"), F.count_distinct("pos").alias("d"), F.count_if(F.col("sym").isNull()).alias("out"),
        F.count_if(F.col("_sym") > F.col("sym")).alias("first"), F.count_if((F.col("_sym") == F.col("sym")) & (F.col("_r") >= F.col("r"))).alias("later"))
    told = refs.select("ref_id", F.length("text").alias("size")).join(seen, "ref_id", "left")
    n = F.coalesce("n", F.lit(0))
    return told.select("ref_id", F.when(n != F.col("size"), -1).when(n == 0, 0).when((F.col("out") > 0) | (F.col("d") < n), -2).when(F.col("first") > 0, -3).when(F.col("later") > 0, -4).otherwise(0).alias("outcome"))


def induction_violations(array: DataFrame, typed: DataFrame, kind: str) -> DataFrame:
    """One row: suffixes of type ``kind``, and those out of place beside the suffix of the rank before.

    Suffixes of a symbol lie together, those of type L first, and inside a type
    the next suffix rises with the own rank. So neighbours tell it all, and
    no symbol's suffixes meet in one window.
    """
    follow = array.select("doc_id", (F.col("idx") - 1).alias("idx"), F.col("rank").alias("_next"))
    rows = array.join(typed, ["doc_id", "idx"]).join(follow, ["doc_id", "idx"], "left")
    last = F.when(F.col("_next").isNull(), F.col("doc_id")).otherwise(0)
    rows = rows.select("rank", "sym", "type", F.struct(F.coalesce("_next", F.lit(-1)).alias("r"), last.alias("d")).alias("_key"))
    before = rows.select((F.col("rank") + 1).alias("rank"), F.col("sym").alias("_s"), F.col("type").alias("_t"), F.col("_key").alias("_k"))
    wrong = (F.col("_t") > F.col("type")) | (F.col("_t") == F.col("type")) & (F.col("_k") >= F.col("_key"))
    wrong = (F.col("_s") > F.col("sym")) | (F.col("_s") == F.col("sym")) & wrong
    return rows.where(F.col("type") == kind).join(before, "rank", "left").agg(F.count("*").alias("n"), F.count_if(wrong).alias("violations"))


def differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: rows of ``a``, and rows that only one of two tables has (``missing`` in ``b``, ``added``); repeated ones count.

    Cells of the whole number ``key`` are compared by counts and sums of hashes, told before anything is
    shuffled; only the rows of cells that differ meet.
    """
    columns, cell = a.columns, F.floor(F.col(key) / NEAR).alias("_cell")
    h = lambda order: F.xxhash64(*order)
    sums = [F.sum(f(h(o))) for o in (columns, columns[::-1]) for f in (lambda x: F.shiftrightunsigned(x, 32), lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)))]
    told = lambda x: x.groupBy(cell).agg(F.count("*").alias("n"), F.array(*sums).alias("sums"))
    both = stored(told(a).withColumn("_of", F.lit(0)).union(told(b.select(columns)).withColumn("_of", F.lit(1))), "cells")
    wrong = both.groupBy("_cell").agg(F.count_distinct("n", "sums").alias("_kinds"), F.count("*").alias("_sides")).where("_kinds > 1 or _sides < 2").select("_cell")
    of = lambda x, sign: x.select(*columns, cell, F.lit(sign).alias("_s")).join(F.broadcast(wrong), "_cell", "left_semi")
    rows = of(a, 1).union(of(b.select(columns), -1)).groupBy(*columns).agg(F.sum("_s").alias("_s"))
    out = rows.agg(F.count_if(F.col("_s") > 0).alias("missing"), F.count_if(F.col("_s") < 0).alias("added"))
    return both.agg(F.coalesce(F.sum(F.when(F.col("_of") == 0, F.col("n"))), F.lit(0)).alias("n")).join(out)


def doc_boundaries(collection: DataFrame, cell: int = 1024) -> DataFrame:
    """(doc_id, offset, length): where each document would begin if all were joined by one separator."""
    rows = collection.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("length")).withColumn("_cell", F.floor(F.col("doc_id") / cell))
    sums = rows.groupBy("_cell").agg(F.sum(F.col("length") + 1).alias("_sum"))
    before = running(sums, "_cell", "_sum", "_before").select("_cell", "_before")
    inside = F.coalesce(F.sum(F.col("length") + 1).over(Window.partitionBy("_cell").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_in", inside).join(before, "_cell").select("doc_id", (F.col("_before") + F.col("_in")).alias("offset"), "length")
