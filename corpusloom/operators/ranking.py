"""Ranks without a global sort: bucket offsets, and prefix doubling on sparse ranks.

A sparse rank is the number of rows that sort strictly before; rows not yet
told apart share it. It is refined inside groups of equal rank only, so no
window ever spans the table, and a group that has one row is finished. A group
of any size is refined from counts of its distinct next ranks, in cells of
ranks, so neither a large group nor the whole table is one task's window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stored


#: Ranks of a cell in which neighbours are looked for.
CELL = 4096
#: Whole numbers of a span in which sums run; and rows of a group that one window may hold.
SPAN = 1 << 20


def running(sizes: DataFrame, key: str, count: str, out: str, within: list[str] | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``count`` over smaller values of the whole number ``key`` (each on one row), for each ``within``.

    Sums run inside spans of SPAN values, and over spans: the last window has a row for SPAN values.
    """
    within, before = within or [], (Window.unboundedPreceding, -1)
    over = lambda keys, order: (Window.partitionBy(*keys) if keys else Window).orderBy(order).rowsBetween(*before)
    rows = sizes.withColumn("_c", F.floor(F.col(key) / SPAN))
    spans = rows.groupBy(*within, "_c").agg(F.sum(count).alias("_w"))
    spans = spans.select(*within, "_c", F.coalesce(F.sum("_w").over(over(within, "_c")), F.lit(0)).alias("_s1"))
    rows = rows.withColumn("_s0", F.coalesce(F.sum(count).over(over([*within, "_c"], key)), F.lit(0)))
    return rows.join(spans, [*within, "_c"]).withColumn(out, F.col("_s0") + F.col("_s1")).drop("_c", "_s0", "_s1")


def carried(rows: DataFrame, key: str, values: dict[str, str], back: bool = False) -> DataFrame:
    """(key, each of ``values``): the last value that isn't null at a smaller (``back``: greater) whole number ``key``.

    ``values`` maps new names to columns. Like :func:`running`, in spans and over spans.
    """
    span, way = (Window.unboundedPreceding, -1), F.desc if back else F.asc
    r = rows.withColumn("_c1", F.floor(F.col(key) / SPAN))
    inside, over = Window.partitionBy("_c1").orderBy(way(key)).rowsBetween(*span), Window.orderBy(way("_c1")).rowsBetween(*span)
    pick = F.min if back else F.max
    edge = lambda c: pick(F.when(F.col(c).isNotNull(), F.struct(F.col(key).alias("k"), F.col(c).alias("v"))))["v"]
    cells = r.groupBy("_c1").agg(*[edge(c).alias("_e_" + n) for n, c in values.items()])
    cells = cells.select("_c1", *[F.last("_e_" + n, ignorenulls=True).over(over).alias("_o_" + n) for n in values])
    r = r.select(key, "_c1", *[F.last(c, ignorenulls=True).over(inside).alias(n) for n, c in values.items()])
    return r.join(cells, "_c1").select(key, *[F.coalesce(n, "_o_" + n).alias(n) for n in values])


def filled(rows: DataFrame, within: list[str], at: str, values: dict[str, Column], back: bool = False, own: bool = True) -> DataFrame:
    """``rows`` with each of ``values`` (new name to column): the last one that isn't null up to the whole number ``at`` (``back``: from there on), for each ``within``.

    The row's own place counts, with all rows there, unless ``own`` is false. Windows hold the
    rows of CELL places, then one row a cell, so one long string isn't one task.
    """
    way, pick = (F.desc, F.min_by) if back else (F.asc, F.max_by)
    r = rows.withColumns({"_c": F.floor(F.col(at) / CELL), **values})
    inside = Window.partitionBy(*within, "_c").orderBy(way(at)).rangeBetween(Window.unboundedPreceding, Window.currentRow if own else -1)
    over = Window.partitionBy(*within).orderBy(way("_c")).rowsBetween(Window.unboundedPreceding, -1)
    cells = r.groupBy(*within, "_c").agg(*[pick(n, F.when(F.col(n).isNotNull(), F.col(at))).alias("_e_" + n) for n in values])
    cells = cells.select(*within, "_c", *[F.last("_e_" + n, ignorenulls=True).over(over).alias("_o_" + n) for n in values])
    r = r.withColumns({n: F.last(n, ignorenulls=True).over(inside) for n in values}).join(cells, [*within, "_c"])
    return r.withColumns({n: F.coalesce(n, "_o_" + n) for n in values}).drop("_c", *["_o_" + n for n in values])


def refined(rows: DataFrame, after: str, within: list[str] | None = None, largest: int | None = None) -> DataFrame:
    """``rows`` (…, r, ``after``) with finer ``r`` and ``_n``: inside each group of equal ``r``, by the whole number ``after``.

    Where the ``largest`` group has more than SPAN rows (or isn't known), only
    distinct pairs (r, after) and their counts are summed, so a group of any
    size is many tasks' work and equal pairs are combined before they travel.
    """
    within = within or []
    if largest is not None and largest <= SPAN:
        place = F.rank().over(Window.partitionBy(*within, "r").orderBy(after)) - 1
        finer = rows.drop("_n").withColumn("r", (F.col("r") + place).cast("long"))
        return finer.withColumn("_n", F.count("*").over(Window.partitionBy(*within, "r")))
    pairs = rows.groupBy(*within, "r", after).agg(F.count("*").alias("_n"))
    pairs = running(pairs, after, "_n", "_p", [*within, "r"]).withColumn("_r2", (F.col("r") + F.col("_p")).cast("long")).drop("_p")
    return rows.drop("_n").join(pairs, [*within, "r", after]).drop("r").withColumnRenamed("_r2", "r")


def bucket_rank(rows: DataFrame, bucket, order: list, out: str = "rank", within: list | None = None) -> DataFrame:
    """Adds the exact 0-based place of each row in the order (``within``, bucket, ``order``).

    ``bucket`` must be a prefix of the order: its sizes are summed in order
    (one row a bucket), and rows are numbered inside their bucket.
    """
    within = within or []
    b = rows.withColumn("_b", bucket)
    sizes = b.groupBy(*within, "_b").count()
    if dict(sizes.dtypes)["_b"] in ("int", "bigint"):
        before = running(sizes, "_b", "count", "_off", within).drop("count")
    else:  # a few symbols: as many rows as the alphabet has combinations
        span = Window.partitionBy(*within).orderBy("_b") if within else Window.orderBy("_b")
        before = sizes.select(*within, "_b", F.coalesce(F.sum("count").over(span.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy(*within, "_b").orderBy(*order))
    return b.withColumn("_local", local).join(before, [*within, "_b"]).withColumn(out, (F.col("_off") + F.col("_local") - 1).cast("long")).drop("_b", "_off", "_local")


def sparse_start(rows: DataFrame, key, within: list[str]) -> DataFrame:
    """(…, r): sparse ranks by ``key``, whose distinct values are few."""
    b = rows.withColumn("_b", key)
    sizes = b.groupBy(*within, "_b").count()
    span = Window.partitionBy(*within).orderBy("_b") if within else Window.orderBy("_b")
    before = sizes.select(*within, "_b", F.coalesce(F.sum("count").over(span.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("r"), F.col("count").alias("_n"))
    return b.join(before, [*within, "_b"]).drop("_b")


def doubled(rows: DataFrame, start: int, within: list[str], levels: list | None = None, counts: list | None = None) -> DataFrame:
    """Prefix doubling on (doc_id, idx, r, _n): ranks by whole suffixes.

    ``r`` ranks by the first ``start`` symbols; ``_n`` is the size of the
    row's group. Each round joins a suffix of an open group with the rank of
    its continuation, ``k`` symbols on (ends come first), and refines inside
    the group. A group is closed when it has one row, or when its suffixes
    have ended: those are equal, share a rank for good and have ``_n`` below 0.
    Only open rows are ranked and written again. It stops when no group is
    open, after a logarithm of the longest repeat in rounds. ``levels``
    collects (k, table): ranks by the first k symbols; ``counts`` the rows of
    each round.
    """
    k, columns = start, list(dict.fromkeys([*within, "doc_id", "idx", "r", "_n"]))
    closed: list[DataFrame] = []
    open_ = stored(rows.select(*columns), "ranks")
    while True:
        closed.append(open_.where("_n <= 1"))
        open_ = open_.where("_n > 1")
        all_ = reduce(DataFrame.union, closed, open_)
        if levels is not None:
            levels.append((k, all_))
        size, largest = open_.agg(F.count("*"), F.max("_n")).first()
        if counts is not None:
            counts.append(size)
        if not size:
            return reduce(DataFrame.union, closed[1:], closed[0])
        follow = all_.select("doc_id", (F.col("idx") - k).alias("idx"), F.col("r").alias("_next")).where("idx >= 0")
        asked = open_.join(follow, ["doc_id", "idx"], "left").withColumn("_next", F.coalesce("_next", F.lit(-1)))
        finer = refined(asked, "_next", within, largest)
        open_ = stored(finer.withColumn("_n", F.when(F.col("_next") < 0, -F.col("_n")).otherwise(F.col("_n"))).select(*columns), "ranks")
        k *= 2


def chased(open_: DataFrame, counts: list | None = None) -> DataFrame:
    """(doc_id, at, r): places (doc_id, at, to, r, _n) ranked by what their rank ``r`` tells and then by what follows from ``to`` on.

    Equal ranks mean equal text up to ``to``, so what follows it
    decides: pointers jump over one place, then two, four, …. Ends have rank -1 and point to themselves. A group is closed
    when it has one row or when what follows it is closed (document ends are):
    its rows are equal for good, since equal text up to one place begins at one
    place, and have ``_n`` below 0. Only open rows are ranked and written
    again. ``counts`` collects the rows, closed and open, of every round.
    """
    state, closed, n_closed = None, [], 0
    while True:
        is_open = F.col("_n") > 1
        n, *now, largest = open_.agg(
            F.count("*"), F.count_if(is_open), F.count_distinct(F.when(is_open, F.col("r"))), F.sum(F.when(is_open, F.col("to"))), F.max("_n")).first()
        if counts is not None:
            counts.append(n_closed + n)
        n_closed += n - now[0]
        closed.append(open_.where(~is_open))
        open_ = open_.where(is_open)
        rows = reduce(DataFrame.union, closed)
        if not now[0] or now == state:  # pointers that don't move on tell no more apart
            return rows.union(open_).select("doc_id", "at", "r")
        state = now
        follow = rows.union(open_).select("doc_id", F.col("at").alias("to"), F.col("r").alias("_r"), F.col("to").alias("_j"), (F.col("_n") <= 1).alias("_closed"))
        finer = refined(open_.join(follow, ["doc_id", "to"]), "_r", None, largest)
        open_ = stored(finer.select("doc_id", "at", F.col("_j").alias("to"), "r", F.when(F.col("_closed"), -F.col("_n")).otherwise(F.col("_n")).alias("_n")), "anchors")


#: Documents whose equal suffixes one window numbers.
DOCUMENTS = 4096


def numbered(ranked: DataFrame) -> DataFrame:
    """Equal suffixes, which share a sparse rank, are numbered by document.

    Few rows share one, save where very many documents end alike; those are
    counted in cells of documents and numbered inside a cell.
    """
    alike = ranked.where(F.abs("_n") > 1).select("r", "doc_id", "idx").withColumn("_cell", F.floor(F.col("doc_id") / DOCUMENTS))
    before = running(alike.groupBy("r", "_cell").count(), "_cell", "count", "_before", ["r"]).drop("count")
    inside = F.row_number().over(Window.partitionBy("r", "_cell").orderBy("doc_id", "idx")) - 1
    told = alike.withColumn("_in", inside).join(before, ["r", "_cell"]).select((F.col("r") + F.col("_before") + F.col("_in")).cast("long").alias("rank"), "doc_id", "idx")
    return ranked.where(F.abs("_n") <= 1).select(F.col("r").cast("long").alias("rank"), "doc_id", "idx").union(told)


def common_prefixes(pairs: DataFrame, levels: list) -> DataFrame:
    """For (…, da, ia, db, ib): ``len``, how many symbols the two suffixes share.

    Ranks by the first k symbols are equal where k symbols agree, so the length
    is found from the largest level down, two joins a level and no text. Ranks
    tell prefixes of k symbols apart only where the suffixes are that long, so
    the length of the first side's document goes along. The levels must begin
    with single symbols; pairs with a null side share nothing.
    """
    sizes = levels[0][1].groupBy(F.col("doc_id").alias("da")).agg((F.max("idx") + 1).alias("_size"))
    columns = [*pairs.columns, "len"]
    out = pairs.join(sizes, "da", "left").withColumn("len", F.lit(0).cast("long"))
    for k, table in reversed(levels):
        side = lambda d, i, r: table.select(F.col("doc_id").alias(d), F.col("idx").alias(i), F.col("r").alias(r))  # noqa: B023, E731
        at = out.withColumns({"_ia": F.col("ia") + F.col("len"), "_ib": F.col("ib") + F.col("len")})
        at = at.join(side("da", "_ia", "_ra"), ["da", "_ia"], "left").join(side("db", "_ib", "_rb"), ["db", "_ib"], "left")
        same = F.coalesce((F.col("_ra") == F.col("_rb")) & (F.col("_ia") + k <= F.col("_size")), F.lit(False))
        out = stored(at.withColumn("len", F.col("len") + F.when(same, k).otherwise(0)).select(*columns, "_size"), "prefixes")
    return out.select(*columns)
