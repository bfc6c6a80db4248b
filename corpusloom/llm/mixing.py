"""Mixing sources to target token weights by entropy balancing.

Document rates r stay as close to each other in relative entropy (weighted by
tokens) as the constraints allow, so they are exponentially tilted: r =
min(most, exp(dual of the source + dual of the size class)). Each source's
tokens are held to their target exactly; the duals of the size classes (binary
digits of a document's size, at most 64) keep the corpus's share of tokens in
short and long documents, which source weights alone would shift, as far as a
small quadratic penalty and the sources allow. For given class duals a
source's dual has a closed form (water filling under the cap), so the convex
dual is solved by Newton steps on the class duals alone: each is one job that
sums gradient and Hessian over all sources.

A rate k + f becomes k copies of every document of that source and class, and
one more of a share f of its tokens: the documents below a hash threshold,
found from bucket sums. That leaves each class short by less than its next
document. From the documents on both sides of the thresholds, NEAR of each
class, what is short of the source's target is then filled longest first, and
one last exchange (take one, give one back, or both) comes nearest to it. The
next document of each class is among these, and together they are larger than
what is missing, so no more are needed to fill it.

Every choice is a function of the row's id, text and source and of sums, so
reruns agree and no document list is gathered.

Defined cases: a null or empty text has size 0 and takes 0 (the stage keeps it
once); null sources are a source of their own, last; repeated rows are treated
alike (same hash, same copies); an empty table gives an empty result; other
columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import plain, read_table, restored, stored

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
CLASSES = 64
#: Weight of the penalty on class duals, as a share of all tokens.
RIDGE = 0.01
#: Documents on each side of a class's threshold that the last fill may choose from.
NEAR = 64
_BITS = (56, 49)  # the seven bits above these choose a bucket of the 63-bit hash, and one inside it


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mark(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_size``, its class ``_c`` (the number of its binary digits) and the selection hash ``_h``."""
    out = docs.withColumn("_size", word_count(F.col(text)))
    return out.withColumns({"_c": F.length(F.bin("_size")).cast("int"), "_h": F.shiftrightunsigned(F.xxhash64("doc_id", "_size", text), 1)})


def same(a: DataFrame, b: DataFrame, *columns: str):
    """The join condition that ``columns`` of ``a`` equal those of ``b`` (named with a trailing _), nulls included."""
    condition = F.lit(True)
    for c in columns:
        condition = condition & a[c].eqNullSafe(b[c + "_"])
    return condition


def numbered(sources: DataFrame, parts: int = 16) -> DataFrame:
    """Adds ``_at``: the place of a source in code-point order, nulls last.

    Range partitions are numbered inside and shifted by the sizes of those
    before, so no task sorts all sources.
    """
    null = F.col("source").isNull()
    dealt = stored(sources.repartitionByRange(parts, null, F.col("source")).withColumn("_part", F.spark_partition_id()), "mixing-sources")
    sizes = dealt.groupBy("_part").count()
    before = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(null, "source"))
    return dealt.withColumn("_local", local).join(before, "_part").withColumn("_at", F.col("_before") + F.col("_local") - 1).drop("_part", "_local", "_before")


def targets(marked: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target``.

    Targets share all tokens by weight; those above ``most`` times the source
    stop there and the rest is shared again, one grouped sum a round.
    """
    sizes = marked.groupBy("source").agg(F.sum("_size").alias("source_size"))
    table = stored(numbered(sizes).withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_at") % len(weights) + 1).cast("int"))), "mixing-weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    cap = most * F.col("source_size").cast("double")
    share = 0.0
    while True:
        full = cap <= share * F.col("_w")
        held, free = table.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_w")))).first()
        if not free or (new := max(0.0, total - held) / free) <= share:
            break
        share = new
    return table.select("source", "source_size", F.when(cap <= share * F.col("_w"), cap).otherwise(share * F.col("_w")).alias("target"))


def source_rates(target: float, mass: np.ndarray, dual: np.ndarray, most: float = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Rates min(most, exp(l + dual)) that give the source its target, and which of them are below ``most``."""
    if target >= most * mass.sum() * (1 - 1e-12):
        return np.full(len(mass), float(most)), np.zeros(len(mass), bool)
    tilt, free = np.exp(dual - dual.max()), np.ones(len(mass), bool)
    while True:
        rate = tilt * ((target - most * mass[~free].sum()) / (mass[free] * tilt[free]).sum())
        over = free & (rate > most)
        if not over.any():
            return np.where(free, rate, most), free
        free &= ~over


def _sums(sources: DataFrame, dual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each class at these duals, and their derivatives: a row of CLASSES * (CLASSES + 1) numbers a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got, slope = np.zeros(CLASSES), np.zeros((CLASSES, CLASSES))
        for batch in batches:
            for target, classes, mass in zip(batch["target"], batch["classes"], batch["mass"]):
                classes, mass = np.asarray(classes, int), np.asarray(mass, float)
                rate, free = source_rates(target, mass, dual[classes])
                got[classes] += mass * rate
                move = np.where(free, mass * rate, 0.0)
                if move.any():
                    slope[classes, classes] += move
                    slope[np.ix_(classes, classes)] -= np.outer(move, move) / move.sum()
        yield pd.DataFrame({"v": [np.concatenate([got, slope.ravel()])]})

    parts = sources.mapInPandas(run, "v array<double>").select(F.posexplode("v").alias("k", "x")).where("x <> 0").groupBy("k").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(CLASSES * (CLASSES + 1))
    for r in parts:
        out[r["k"]] = r["x"]
    return out[:CLASSES], out[CLASSES:].reshape(CLASSES, CLASSES)


def class_duals(sources: DataFrame, wanted: np.ndarray, ridge: float = RIDGE, rounds: int = 40, tolerance: float = 1e-7) -> np.ndarray:
    """Newton's minimum of the penalised dual over the size classes. ``sources`` has ``target``, ``classes`` and ``mass`` (arrays)."""
    dual, penalty = np.zeros(CLASSES), ridge * max(1.0, wanted.sum())
    for _ in range(rounds):
        got, slope = _sums(sources, dual)
        miss = got - wanted + penalty * dual
        if np.abs(miss).max() <= tolerance * max(1.0, wanted.sum()):
            break
        step = np.linalg.solve(slope + penalty * np.eye(CLASSES), miss)
        dual = dual - step * min(1.0, 2.0 / np.abs(step).max())  # so that exp stays tame
    return np.round(dual, 6)  # sums of fractions may differ in their last digits between runs


def balanced(cells: DataFrame, goal: DataFrame) -> DataFrame:
    """``cells`` (source, _c, mass) with ``rate``: entropy-balanced, at the source's ``target`` of ``goal``."""
    g = goal.select(F.col("source").alias("source_"), "target")
    per = cells.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("_c", "mass"))).alias("x"))  # at most CLASSES entries
    sources = per.join(g, same(per, g, "source")).select("source", "target", F.col("x._c").alias("classes"), F.col("x.mass").alias("mass"))
    sources = stored(sources, "mixing-balance")
    share = {r["_c"]: r["m"] for r in cells.groupBy("_c").agg(F.sum("mass").alias("m")).collect()}
    total = goal.agg(F.sum("target")).first()[0] or 0.0
    wanted = np.array([share.get(c, 0) for c in range(CLASSES)], float)
    dual = class_duals(sources, wanted * (total / max(1.0, wanted.sum())))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rates = [source_rates(t, np.asarray(m, float), dual[np.asarray(c, int)])[0].tolist() for t, c, m in zip(batch["target"], batch["classes"], batch["mass"])]
            yield batch.assign(rate=rates)

    kind = cells.schema["source"].dataType.simpleString()
    rated = sources.mapInPandas(run, f"source {kind}, target double, classes array<int>, mass array<long>, rate array<double>")
    return rated.select("source", F.explode(F.arrays_zip("classes", "mass", "rate")).alias("x")).select("source", F.col("x.classes").alias("_c"), "x.mass", "x.rate")


def thresholds(units: DataFrame, cells: DataFrame) -> DataFrame:
    """``cells`` with ``top``, the largest hash that takes an extra copy, and ``got``, the tokens up to it (at most ``want``)."""
    c = cells.where("want > 0").select(F.col("source").alias("source_"), F.col("_c").alias("_c_"), "want")
    open_ = units.join(c, same(units, c, "source", "_c")).drop("source_", "_c_").withColumn("before", F.lit(0).cast("long"))
    run = Window.partitionBy("source", "_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    # of the buckets of a class the one that crosses its share is cut into buckets again, and what is in that one is looked at row by row
    for bits in _BITS:
        open_ = open_.withColumn("_b", F.shiftright("_h", bits))
        sums = open_.groupBy("source", "_c", "want", "before", "_b").agg(F.sum("_size").alias("_sum"))
        edge = sums.withColumn("_cum", F.col("before") + F.sum("_sum").over(run)).where("_cum > want").groupBy("source", "_c").agg(F.min(F.struct("_b", (F.col("_cum") - F.col("_sum")).alias("before"))).alias("x"))
        edge = stored(edge.select(F.col("source").alias("source_"), F.col("_c").alias("_c_"), F.col("x._b").alias("_b_"), "x.before"), "mixing-edges")
        open_ = open_.drop("before").join(edge, same(open_, edge, "source", "_c", "_b")).drop("source_", "_c_", "_b_")
    by_hash = Window.partitionBy("source", "_c").orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)
    inside = open_.withColumn("_cum", F.col("before") + F.sum("_size").over(by_hash)).where("_cum <= want").groupBy("source", "_c").agg(F.max(F.struct("_h", "_cum")).alias("x"))
    inside = inside.select(F.col("source").alias("source_"), F.col("_c").alias("_c_"), "x")
    out = cells.join(edge, same(cells, edge, "source", "_c"), "left").drop("source_", "_c_")
    out = out.join(inside, same(out, inside, "source", "_c"), "left").drop("source_", "_c_")
    # shares are below 1: a class that asks for a copy more always has an edge
    return out.select(
        "source", "_c", "mass", "whole", F.coalesce("x._h", F.shiftleft("_b_", _BITS[-1]) - 1, F.lit(-1)).alias("top"), F.coalesce("x._cum", "before", F.lit(0)).alias("got"))


def exchanges(left: float, add: np.ndarray, drop: np.ndarray) -> tuple[list[int], list[int]]:
    """Which of ``add`` (sizes) to take and of ``drop`` to give back so that ``left`` is nearest to 0: longest first, then one exchange."""
    taken = []
    for k in np.argsort(-add, kind="stable").tolist():
        if add[k] <= left:
            taken.append(k)
            left -= add[k]
    rest = np.setdiff1d(np.arange(len(add)), taken)
    rest = rest[np.argsort(add[rest], kind="stable")]
    ins, outs = np.concatenate([[0.0], add[rest]]), np.concatenate([[0.0], drop])
    at = np.searchsorted(ins, left + outs)
    best = (abs(left), 0, 0)
    for shift in (0, -1):
        k = np.clip(at + shift, 0, len(ins) - 1)
        off = np.abs(left + outs - ins[k])
        j = int(off.argmin())
        best = min(best, (float(off[j]), int(k[j]), j))
    _, more, less = best
    return taken + ([int(rest[more - 1])] if more else []), [less - 1] if less else []


def fill(units: DataFrame, cells: DataFrame, goal: DataFrame) -> DataFrame:
    """(source, _c, _h, step): documents next to the thresholds that take a copy more or less, so that sources come near their targets."""
    g = goal.select(F.col("source").alias("source_"), "target")
    per = cells.groupBy("source").agg(F.sum(F.col("whole") * F.col("mass") + F.col("got")).alias("_got"))
    left = per.join(g, same(per, g, "source")).select("source_", (F.col("target") - F.col("_got")).alias("left")).where("left <> 0")
    c = cells.where(F.col("whole") < MOST).select(F.col("source").alias("source_"), F.col("_c").alias("_c_"), "top")
    near = units.join(c, same(units, c, "source", "_c")).withColumns({"taken": F.col("_h") <= F.col("top"), "_far": F.abs(F.col("_h") - F.col("top"))})
    place = F.row_number().over(Window.partitionBy("source", "_c", "taken").orderBy("_far"))
    near = near.withColumn("_place", place).where(F.col("_place") <= NEAR).select("source", "_c", "_h", "_size", "taken")
    near = near.join(left, same(near, left, "source")).select("source", "_c", "_h", "_size", "taken", "left")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_size", "_h", "_c"])
        add, drop = rows[~rows["taken"]], rows[rows["taken"]]
        more, less = exchanges(float(rows["left"].iloc[0]), add["_size"].to_numpy(float), drop["_size"].to_numpy(float))
        return pd.concat([add.iloc[more].assign(step=1), drop.iloc[less].assign(step=-1)])[["source", "_c", "_h", "step"]]

    return near.groupBy("source").applyInPandas(run, f"source {units.schema['source'].dataType.simpleString()}, _c int, _h long, step int")


def plan(marked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored tables: targets of sources; whole copies and threshold of each source and class; single exchanges."""
    goal = stored(targets(marked), "mixing-targets")
    # rows that share a hash are one unit; narrow rows, combined before they travel
    units = stored(marked.where("_size > 0").groupBy("source", "_c", "_h").agg(F.sum("_size").alias("_size")), "mixing-units")
    cells = stored(units.groupBy("source", "_c").agg(F.sum("_size").alias("mass")), "mixing-cells")
    rated = balanced(cells, goal)
    r = F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-8, F.round("rate")).otherwise(F.col("rate"))
    whole = F.least(F.lit(MOST), F.floor(r)).cast("int")
    rated = stored(rated.select("source", "_c", "mass", whole.alias("whole"), F.when(whole >= MOST, 0.0).otherwise((r - whole) * F.col("mass")).alias("want")), "mixing-rates")
    cells = stored(thresholds(units, rated), "mixing-thresholds")
    steps = stored(fill(units, cells, goal), "mixing-steps")
    return goal, cells, steps


def with_copies(marked: DataFrame, goal: DataFrame, cells: DataFrame, steps: DataFrame) -> DataFrame:
    """Adds ``_copies`` (of the document), ``source_size`` and ``target``."""
    g = goal.withColumnRenamed("source", "source_")
    out = marked.join(g, same(marked, g, "source")).drop("source_")
    c = cells.select(F.col("source").alias("source_"), F.col("_c").alias("_c_"), "whole", "top")
    out = out.join(c, same(out, c, "source", "_c"), "left").drop("source_", "_c_")
    s = steps.select(F.col("source").alias("source_"), F.col("_c").alias("_c_"), F.col("_h").alias("_h_"), "step")
    out = out.join(s, same(out, s, "source", "_c", "_h"), "left").drop("source_", "_c_", "_h_")
    copies = F.coalesce("whole", F.lit(0)) + F.when(F.col("_h") <= F.col("top"), 1).otherwise(0) + F.coalesce("step", F.lit(0))
    return out.withColumn("_copies", F.when(F.col("_size") > 0, copies).otherwise(1)).drop("whole", "top", "step")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    marked = stored(mark(docs).drop("text"), "mixing-sizes")
    out = with_copies(marked, *plan(marked))
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_copies")).alias("taken"))


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (not at all, or up to three times)."""
    used = ("doc_id", "source", "text")
    marked = stored(mark(docs.select(*used)).drop("text"), "mixing-sizes")
    out = with_copies(mark(plain(docs, *used)), *plan(marked)).where("_copies > 0")
    return restored(out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int")))), docs, *used)
