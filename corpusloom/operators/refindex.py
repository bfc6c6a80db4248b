"""Index tables of reference strings (ref_id, text): suffix array, LCP, BWT, counts and smaller-value searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import lcp as lcp_of
from ..functions.text import substr0
from ..storage import stored
from .ranking import common_prefixes, doubled, running, sparse_start
from .staircase import smaller
from .symbols import positions

#: Ranks of a block of occurrence counts, and of block minima.
BLOCK = 128
START = 3


def as_documents(refs: DataFrame) -> DataFrame:
    return refs.select(F.col("ref_id").alias("doc_id"), "text")


def symbol_at(refs: DataFrame, pos: str = "pos", sym: str = "sym") -> DataFrame:
    """(ref_id, pos, sym) of every symbol, to be joined on position."""
    return positions(as_documents(refs)).select(F.col("doc_id").alias("ref_id"), F.col("idx").alias(pos), F.col("sym").alias(sym))


def suffix_array(refs: DataFrame, levels: list | None = None) -> DataFrame:
    """(ref_id, rank, pos) by prefix doubling; no suffix is materialised beyond START symbols."""
    ahead = START if levels is None else 1
    rows = positions(as_documents(refs), ahead).select(F.col("doc_id").alias("ref_id"), "doc_id", "idx", "key")
    ranked = doubled(sparse_start(rows, F.col("key"), ["ref_id"]), ahead, ["ref_id"], levels)
    return ranked.select("ref_id", F.col("r").cast("long").alias("rank"), F.col("idx").alias("pos"))


def with_lcp(sa: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds ``lcp`` with the suffix of the rank before (0 at rank 0), comparing text; for short references."""
    before = sa.select("ref_id", (F.col("rank") + 1).alias("rank"), F.col("pos").alias("_p"))
    both = sa.join(before, ["ref_id", "rank"], "left").join(refs.select("ref_id", "text"), "ref_id")
    value = lcp_of(substr0(F.col("text"), F.col("pos")), substr0(F.col("text"), F.col("_p")))
    return both.select("ref_id", "rank", "pos", F.when(F.col("_p").isNull(), 0).otherwise(value).cast("long").alias("lcp"))


def index_by_levels(refs: DataFrame) -> DataFrame:
    """(ref_id, rank, pos, lcp) for references of any length: the LCP is told from the ranks of the doubling rounds."""
    levels: list = []
    sa = suffix_array(refs, levels)
    before = sa.select("ref_id", (F.col("rank") + 1).alias("rank"), F.col("pos").alias("ib"))
    pairs = sa.join(before, ["ref_id", "rank"], "left").select("ref_id", "rank", F.col("ref_id").alias("da"), F.col("pos").alias("ia"), F.col("ref_id").alias("db"), "ib")
    return common_prefixes(pairs, levels).select("ref_id", "rank", F.col("ia").alias("pos"), F.col("len").alias("lcp"))


def with_plcp_max(index: DataFrame) -> DataFrame:
    """Adds ``plcp_max``: the longest repeat that begins at the position."""
    after = index.select("ref_id", (F.col("rank") - 1).alias("rank"), F.col("lcp").alias("_l"))
    return index.join(after, ["ref_id", "rank"], "left").withColumn("plcp_max", F.greatest("lcp", F.coalesce("_l", F.lit(0)))).drop("_l")


def bwt(sa: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref_id, rank, sym): the symbol before each suffix, cyclically."""
    last = sa.groupBy("ref_id").agg(F.max("pos").alias("_last"))
    at = sa.join(last, "ref_id").select("ref_id", "rank", F.when(F.col("pos") == 0, F.col("_last")).otherwise(F.col("pos") - 1).alias("pos"))
    return at.join(symbol_at(refs), ["ref_id", "pos"]).select("ref_id", "rank", "sym")


def bwt_library(sa: DataFrame, refs: DataFrame) -> DataFrame:
    """The BWT with the end of text first: last symbol, then the symbols before each suffix but the first; ``primary_index`` is the rank of position 0 plus 1."""
    primary = sa.where("pos = 0").select("ref_id", (F.col("rank") + 1).alias("primary_index"))
    first = F.col("rank") + 1 == F.col("primary_index")
    i = F.when(first, 0).otherwise(F.col("rank") + F.when(F.col("rank") < F.col("primary_index"), 1).otherwise(0)).cast("long")
    return bwt(sa, refs).join(primary, "ref_id").select("ref_id", i.alias("i"), "sym", "primary_index")


def c_array(bwt_rows: DataFrame) -> DataFrame:
    """(ref_id, sym, c): how many symbols of the reference are smaller."""
    counts = bwt_rows.groupBy("ref_id", "sym").count()
    w = Window.partitionBy("ref_id").orderBy("sym").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("ref_id", "sym", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("c"))


def occ_blocks(bwt_rows: DataFrame) -> DataFrame:
    """(ref_id, block, sym, cnt): occurrences before the block's end, for symbols and blocks where they occur."""
    per = bwt_rows.groupBy("ref_id", F.floor(F.col("rank") / BLOCK).alias("block"), "sym").count()
    return running(per, "block", "count", "_before", ["ref_id", "sym"]).select("ref_id", "block", "sym", (F.col("_before") + F.col("count")).cast("long").alias("cnt"))


def occ_lookup(bwt_rows: DataFrame) -> DataFrame:
    """(ref_id, sym, block, before, inside): occurrences before every block, and the places inside it (at most BLOCK).

    Every symbol of a reference has a row for each block and one more, so a
    count before any rank is one equi-join: n / BLOCK rows for each symbol.
    """
    rows = bwt_rows.withColumn("block", F.floor(F.col("rank") / BLOCK))
    size = bwt_rows.groupBy("ref_id").agg(F.floor(F.count("*") / BLOCK).alias("_last"))
    symbols = bwt_rows.select("ref_id", "sym").distinct()
    every = size.select("ref_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("block")).join(symbols, "ref_id")
    held = rows.groupBy("ref_id", "sym", "block").agg(F.collect_list((F.col("rank") % BLOCK).cast("int")).alias("inside"))
    all_ = every.join(held, ["ref_id", "sym", "block"], "left").withColumn("inside", F.coalesce("inside", F.array().cast("array<int>"))).withColumn("_n", F.size("inside"))
    return running(all_, "block", "_n", "before", ["ref_id", "sym"]).select("ref_id", "sym", "block", F.col("before").cast("long").alias("before"), "inside")


def occ_rank(bwt_rows: DataFrame) -> DataFrame:
    """Adds ``occ``: occurrences of the row's symbol in ranks 0 to its own."""
    per = bwt_rows.groupBy("ref_id", F.floor(F.col("rank") / BLOCK).alias("block"), "sym").count()
    before = running(per, "block", "count", "_before", ["ref_id", "sym"]).select("ref_id", "block", "sym", "_before")
    inside = F.row_number().over(Window.partitionBy("ref_id", "block", "sym").orderBy("rank"))
    rows = bwt_rows.withColumn("block", F.floor(F.col("rank") / BLOCK)).withColumn("_in", inside)
    return rows.join(before, ["ref_id", "sym", "block"]).select("ref_id", "rank", "sym", (F.col("_before") + F.col("_in")).cast("long").alias("occ"))


def backward_search(bwt_rows: DataFrame, patterns: DataFrame, longest: int) -> DataFrame:
    """(ref_id, pattern, n): occurrences of each pattern by backward steps.

    ``patterns`` is a stated set, asked of every reference. A step is an
    equi-join of each bound with the block that holds it. References must end
    in a symbol that is less than all others and in no pattern, since the BWT is cyclic.
    """
    counts = c_array(bwt_rows)
    occ = stored(occ_lookup(bwt_rows), "occ")
    size = bwt_rows.groupBy("ref_id").agg(F.count("*").alias("_n"))
    state = size.join(patterns).select("ref_id", "pattern", F.lit(0).cast("long").alias("lo"), F.col("_n").alias("hi"), F.length("pattern").alias("left"))
    for _ in range(longest):
        at = state.withColumn("sym", F.when(F.col("left") > 0, substr0(F.col("pattern"), F.col("left") - 1, 1)))
        for bound in ("lo", "hi"):
            side = occ.select(F.col("ref_id"), F.col("sym"), F.col("block").alias("_block"), "before", "inside")
            at = at.withColumn("_block", F.floor(F.col(bound) / BLOCK)).join(side, ["ref_id", "sym", "_block"], "left")
            n = F.col("before") + F.size(F.filter("inside", lambda x: x < F.col(bound) % BLOCK))  # noqa: B023
            at = at.withColumn("_" + bound, F.coalesce(n, F.lit(0))).drop("_block", "before", "inside")
        at = at.join(counts, ["ref_id", "sym"], "left")
        base, done = F.coalesce("c", F.lit(0)), F.col("left") == 0
        state = at.select("ref_id", "pattern", *[F.when(done, F.col(x)).otherwise(base + F.col("_" + x)).alias(x) for x in ("lo", "hi")], F.greatest(F.col("left") - 1, F.lit(0)).alias("left"))
    return state.select("ref_id", "pattern", F.greatest(F.col("hi") - F.col("lo"), F.lit(0)).alias("n"))


def minima(values: DataFrame) -> list[DataFrame]:
    """Tables (ref_id, node, items), the first one stored: BLOCK values (j, v) a node, then minima of BLOCK nodes a node, up to one for a reference."""
    tables, rows = [], values.select("ref_id", "j", "v")
    longest = (values.agg(F.max("j")).first()[0] or 0) + 1
    while True:
        table = rows.groupBy("ref_id", F.floor(F.col("j") / BLOCK).alias("node")).agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("items"))
        table = table if tables else stored(table, "minima")
        tables.append(table)
        longest = -(-longest // BLOCK)
        if longest <= 1:
            return tables
        rows = table.select("ref_id", F.col("node").alias("j"), F.array_min(F.transform("items", lambda x: x["v"])).alias("v"))


def _lcp_minima(index: DataFrame) -> list[DataFrame]:
    return minima(index.select("ref_id", F.col("rank").alias("j"), F.col("lcp").alias("v")))


def psv_nsv(index: DataFrame) -> DataFrame:
    """(ref_id, rank, lcp, psv, nsv): nearest ranks with a strictly smaller LCP value, null if none."""
    values = index.select("ref_id", F.col("rank").alias("j"), F.col("lcp").alias("v"))
    rows = index.select("ref_id", "rank", "lcp")
    for side, step in (("psv", -1), ("nsv", 1)):
        asked = index.select("ref_id", F.col("rank").alias("id"), (F.col("rank") + step).alias("i"), F.col("lcp").alias("bound"))
        near = smaller(values, asked, step < 0).select("ref_id", F.col("id").alias("rank"), F.col("found").alias(side))
        rows = rows.join(near, ["ref_id", "rank"])
    return rows


def range_minimum(index: DataFrame, asked: DataFrame, id_: list[str], tables: list[DataFrame] | None = None) -> DataFrame:
    """``asked`` (ref_id, *id_, lo, hi) with ``min_lcp``: the least LCP value of ranks lo to hi; ranges of any length.

    At each level the ends of a range are looked up in the nodes that hold
    them, and the whole nodes between are left to the next level.
    """
    tables = tables or _lcp_minima(index)
    columns, parts = ["ref_id", *id_], []
    rows = asked.select(*columns, F.col("lo").alias("_a"), F.col("hi").alias("_b"))
    for table in tables:
        node = lambda c: F.floor(F.col(c) / BLOCK)
        ends = rows.select(*columns, "_a", "_b", F.explode(F.array_distinct(F.array(node("_a"), node("_b")))).alias("node"))
        least = F.array_min(F.transform(F.filter("items", lambda x: x["j"].between(F.col("_a"), F.col("_b"))), lambda x: x["v"]))
        parts.append(ends.join(table, ["ref_id", "node"]).select(*columns, least.alias("min_lcp")))
        rows = rows.select(*columns, (node("_a") + 1).alias("_x"), (node("_b") - 1).alias("_y")).where("_x <= _y").select(*columns, F.col("_x").alias("_a"), F.col("_y").alias("_b"))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.union(p)
    return asked.join(all_.groupBy(*columns).agg(F.min("min_lcp").alias("min_lcp")), columns)


def lcp_intervals(index: DataFrame) -> DataFrame:
    """(ref_id, rank, len, lo, hi): the ranks whose suffixes share the first lcp(rank) symbols with this one."""
    n = index.groupBy("ref_id").agg(F.max("rank").alias("_last"))
    near = psv_nsv(index).join(n, "ref_id")
    return near.select("ref_id", "rank", F.col("lcp").alias("len"), F.coalesce("psv", F.lit(0)).cast("long").alias("lo"), (F.coalesce(F.col("nsv") - 1, F.col("_last"))).cast("long").alias("hi"))


def widened(index: DataFrame, asked: DataFrame, id_: str) -> DataFrame:
    """For (ref_id, id_, a, b, len): the interval [lo, hi] around ranks a to b that shares ``len`` symbols."""
    values = index.select("ref_id", F.col("rank").alias("j"), F.col("lcp").alias("v"))
    last = index.groupBy("ref_id").agg(F.max("rank").alias("_last"))
    question = lambda i: asked.select("ref_id", F.col(id_).alias("id"), i.alias("i"), F.col("len").alias("bound"))
    low = smaller(values, question(F.col("a")), True).select("ref_id", F.col("id").alias(id_), F.col("found").alias("_lo"))
    high = smaller(values, question(F.col("b") + 1), False).select("ref_id", F.col("id").alias(id_), F.col("found").alias("_hi"))
    both = asked.join(low, ["ref_id", id_]).join(high, ["ref_id", id_]).join(last, "ref_id")
    return both.select("ref_id", id_, "len", F.coalesce("_lo", F.lit(0)).cast("long").alias("lo"), F.coalesce(F.col("_hi") - 1, F.col("_last")).cast("long").alias("hi"))


def suffix_links(index: DataFrame, intervals: DataFrame) -> DataFrame:
    """(ref_id, rank, len, lo, hi): each interval's string without its first symbol; intervals of length 0 stay at the root."""
    isa = index.select("ref_id", F.col("pos").alias("_pos"), F.col("rank").alias("_rank"))
    sa = index.select("ref_id", F.col("rank").alias("_r"), F.col("pos").alias("_p"))

    def moved(side: str, out: str) -> DataFrame:
        rows = intervals.where("len > 0").withColumnRenamed(side, "_r").join(sa, ["ref_id", "_r"]).withColumn("_pos", F.col("_p") + 1)
        return rows.join(isa, ["ref_id", "_pos"]).select("ref_id", "rank", F.col("_rank").alias(out))

    asked = intervals.where("len > 0").select("ref_id", "rank", (F.col("len") - 1).alias("len"))
    for side, out in (("lo", "a"), ("hi", "b")):
        # the last suffix has no next one; its intervals have length 1 and lead to the root
        asked = asked.join(moved(side, out), ["ref_id", "rank"], "left").fillna(0, [out])
    return widened(index, asked, "rank")


def parent_intervals(index: DataFrame, intervals: DataFrame) -> DataFrame:
    """(ref_id, rank, len, lo, hi): the smallest interval that properly holds each interval (the root has none).

    It shares as many symbols as the greater LCP value at the interval's
    borders, so it is the interval of that border's rank: one equi-join.
    """
    value = lambda name, at: index.select("ref_id", F.col("rank").alias(at), F.col("lcp").alias(name))
    rows = intervals.withColumn("_after", F.col("hi") + 1).join(value("_x", "lo"), ["ref_id", "lo"]).join(value("_y", "_after"), ["ref_id", "_after"], "left")
    rows = rows.where("not (lo = 0 and _y is null)")
    rows = rows.select("ref_id", "rank", F.when(F.coalesce("_y", F.lit(-1)) > F.col("_x"), F.col("_after")).otherwise(F.col("lo")).alias("_at"))
    up = intervals.select("ref_id", F.col("rank").alias("_at"), "len", "lo", "hi")
    return rows.join(up, ["ref_id", "_at"]).select("ref_id", "rank", "len", "lo", "hi")


def interval_bounds(index: DataFrame, refs: DataFrame, intervals: DataFrame) -> DataFrame:
    """(ref_id, lo, hi, len, sym, left_bound, right_bound): first and last rank in each interval whose symbol after ``len`` is ``sym``.

    A new symbol begins at the interval's first rank and at each rank of it
    whose LCP value is ``len``: those are the ranks that have this interval as theirs.
    """
    key = ["ref_id", "lo", "hi", "len"]
    starts = intervals.select(*key, "rank").union(intervals.select(*key, F.col("lo").alias("rank"))).distinct()
    inside = Window.partitionBy(*key).orderBy("rank")  # one row a symbol
    starts = starts.withColumn("_next", F.lead("rank").over(inside)).join(index.select("ref_id", "rank", F.col("pos").alias("_p")), ["ref_id", "rank"])
    met = starts.withColumn("pos", F.col("_p") + F.col("len")).join(symbol_at(refs), ["ref_id", "pos"], "left")
    return met.select(*key, F.coalesce("sym", F.lit("")).alias("sym"), F.col("rank").alias("left_bound"), F.coalesce(F.col("_next") - 1, F.col("hi")).cast("long").alias("right_bound"))


def bound_search(bounds: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (ref_id, lo, hi, len, sym) with the symbol's bounds in the interval, or, where it is absent, ``insertion``: the rank it would begin at."""
    key = ["ref_id", "lo", "hi", "len"]
    met = asked.join(bounds.withColumnRenamed("sym", "_s"), key)
    hit, above = F.col("_s") == F.col("sym"), F.col("_s") > F.col("sym")
    out = met.groupBy(*key, "sym").agg(F.max(F.when(hit, F.col("left_bound"))).alias("left_bound"), F.max(F.when(hit, F.col("right_bound"))).alias("right_bound"), F.min(F.when(above, F.col("left_bound"))).alias("_up"))
    return out.withColumn("insertion", F.when(F.col("left_bound").isNull(), F.coalesce("_up", F.col("hi") + 1))).drop("_up")


def bounds_at(index: DataFrame, refs: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (ref_id, id, lo, hi, offset, sym) with ``left_bound`` and ``right_bound``: the first and last rank of [lo, hi] whose suffix has ``sym`` after ``offset`` symbols, or, if none has, ``insertion``: the rank it would begin at.

    Any interval whose suffixes share ``offset`` symbols will do. All
    questions halve their intervals together: a round is one look at the
    middle rank's suffix and one at its symbol, by equi-joins, so there are as
    many rounds as the widest interval has binary digits. A suffix that ends
    before has the empty symbol, which is less than all others.
    """
    sa = index.select("ref_id", F.col("rank").alias("_m"), F.col("pos").alias("_p"))
    symbols = symbol_at(refs, "_at", "_s")
    # two searches a question: the first rank whose symbol isn't less, and the first whose symbol is greater
    state = asked.select("ref_id", "id", "offset", "sym", F.col("lo").alias("_l"), (F.col("hi") + 1).alias("_r"), F.explode(F.array(F.lit(False), F.lit(True))).alias("_over"))
    while not (state := stored(state, "halves")).where("_l < _r").isEmpty():
        open_ = state.where("_l < _r").withColumn("_m", F.floor((F.col("_l") + F.col("_r")) / 2))
        seen = open_.join(sa, ["ref_id", "_m"]).withColumn("_at", F.col("_p") + F.col("offset")).join(symbols, ["ref_id", "_at"], "left")
        symbol = F.coalesce("_s", F.lit(""))
        below = (symbol < F.col("sym")) | F.col("_over") & (symbol == F.col("sym"))
        halved = seen.withColumn("_l", F.when(below, F.col("_m") + 1).otherwise(F.col("_l"))).withColumn("_r", F.when(below, F.col("_r")).otherwise(F.col("_m")))
        state = halved.select(*state.columns).union(state.where("_l >= _r"))
    ends = state.groupBy("ref_id", "id").agg(F.max(F.when(~F.col("_over"), F.col("_l"))).alias("_a"), F.max(F.when(F.col("_over"), F.col("_l"))).alias("_b"))
    has = F.col("_a") < F.col("_b")
    return asked.join(ends, ["ref_id", "id"]).withColumns({
        "left_bound": F.when(has, F.col("_a")), "right_bound": F.when(has, F.col("_b") - 1), "insertion": F.when(~has, F.col("_a"))}).drop("_a", "_b")
