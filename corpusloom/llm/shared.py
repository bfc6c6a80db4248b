"""Shared storage, connected components and small helpers of the corpus operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..storage import new_path, remove, stored_alone  # noqa: F401

#: White space that separates words in every operator of this package.
SPACE_CLASS = r"[\x20\x09-\x0D]"


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package, wherever the driver was started.

    Texts travel to them in smaller batches than Spark's default of 10,000
    rows, unless the session has chosen a size itself.
    """
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, root) if x)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    That cuts the lineage, keeps no state on executors, and gives the planner
    real sizes: a small table is then broadcast under Spark's own size check.
    """
    importable(df.sparkSession)
    return storage.stored(df, name)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with its columns other than ``used`` renamed c0, c1, ..., so that no working column clashes with them."""
    return docs.toDF(*[n if n in used else f"c{k}" for k, n in enumerate(docs.columns)])


def restored(df: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of ``docs`` from a table made from :func:`plain`, under their names."""
    return df.select(*[F.col(n if n in used else f"c{k}").alias(n) for k, n in enumerate(docs.columns)])


def words_of(text: Column) -> Column:
    """Array of the words of a text (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != F.lit(""))


def prefix_sums(values: Column, block: int = 64) -> Column:
    """Exclusive prefix sums of an array of long, in about ``block`` steps an element."""
    zero = F.lit(0).cast("long")
    total = lambda a: F.aggregate(a, zero, lambda s, x: s + x)
    n_blocks = F.ceil(F.size(values) / F.lit(block)).cast("int")
    blocks = F.when(
        n_blocks > 0,
        F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice(values, b * block + 1, block)),
    ).otherwise(F.array().cast("array<array<bigint>>"))
    starts = F.aggregate(
        F.transform(blocks, total),
        F.struct(zero.alias("s"), F.array().cast("array<bigint>").alias("a")),
        lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a")),
    )["a"]
    return F.flatten(
        F.transform(
            F.arrays_zip(blocks.alias("v"), starts.alias("s")),
            lambda z: F.transform(z["v"], lambda _, i: z["s"] + total(F.slice(z["v"], F.lit(1), i))),
        )
    )


#: Edges of a node that one task's share of a join holds on average.
HUB = 256


def _with_least(edges: DataFrame, least: DataFrame, name: str) -> DataFrame:
    """``edges`` (a, b) with ``m`` of their a, from ``least`` (a, m, n). The edges of a hub are dealt to shares, so no node is a hot key."""
    hubs = stored(least.where(F.col("n") > HUB).select("a", F.ceil(F.col("n") / HUB).cast("int").alias("parts")), name + "-hubs")
    if hubs.isEmpty():
        return edges.join(least.select("a", "m"), "a")
    dealt = edges.join(hubs, "a", "left").withColumn("_s", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    spread = least.select("a", "m", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / HUB).cast("int") - 1)).alias("_s"))
    return dealt.join(spread, ["a", "_s"]).drop("_s")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of (a, b) edges as rows (node, component), component being the least node.

    Alternating large-star and small-star rounds: each is one grouped minimum
    and one join, so no node's neighbours are ever gathered in a task. Every
    round is written to the shared folder; the loop ends when a round changes
    nothing. Nodes without edges do not appear.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    current = stored(edges.select("a", "b").where("a <> b").distinct(), name)
    state = None
    while True:
        # large star: every larger neighbour of a node is linked with the least node near it
        near = both(current)
        least = near.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = _with_least(near, least, name).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours are linked with the least of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = (
            _with_least(down, low, name).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .where("a <> b").distinct()
        )
        following = stored(small, name)
        remove(current)
        current = following
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
