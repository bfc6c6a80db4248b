"""A reference's index as a folder that is built once, and collections that are added to it one after another.

The folder holds ``reference``, ``index`` (suffix array and LCP), ``nodes`` and
``children`` (its suffix tree's handles), and ``heads`` with a partition for
each collection. Adding a collection reads the index and writes its own
partition only; adding it again replaces that partition.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import hashmatch, matchstats, refindex
from ..storage import delete, exists, files, stored
from .collections import collection_file, file_list, reference_file


def build(reference: DataFrame, folder: str) -> None:
    """Write the index of the one row ``reference`` (ref_id, text)."""
    reference = stored(reference.select("ref_id", "text"), "reference")
    index = stored(hashmatch.with_lcp(stored(refindex.suffix_array(reference), "sa"), reference), "index")
    n = reference.select(F.length("text")).first()[0] or 0
    for name, table in zip(("nodes", "children"), hashmatch.tree(index, reference, n)):
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
    index.sortWithinPartitions("rank").write.mode("overwrite").parquet(f"{folder}/index")
    reference.write.mode("overwrite").parquet(f"{folder}/reference")  # last: a folder that has it is whole


def matches(collection: DataFrame, folder: str) -> DataFrame:
    """(doc_id, idx, pos, len, smaller) of a collection against the folder's reference."""
    read = collection.sparkSession.read
    reference, index, *tree = [read.parquet(f"{folder}/{x}") for x in ("reference", "index", "nodes", "children")]
    return hashmatch.hashed_matching_statistics(collection, reference, index, tuple(tree))


def add(collection: DataFrame, folder: str, name: str) -> None:
    """Write the heads of a collection (doc_id, text) as the partition ``name``."""
    reference = collection.sparkSession.read.parquet(f"{folder}/reference")
    collection = stored(collection.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "collection")
    heads = matchstats.heads(stored(matches(collection, folder), "matches"), collection, reference)
    heads.drop("next_start").write.mode("overwrite").parquet(f"{folder}/heads/collection={name}")


def heads(spark: SparkSession, folder: str) -> DataFrame:
    """(collection, doc_id, head_id, start, next_start, pos, len, smaller, is_end) of all collections of a folder."""
    by = Window.partitionBy("collection", "doc_id").orderBy("head_id")
    rows = spark.read.option("basePath", f"{folder}/heads").parquet(f"{folder}/heads").withColumn("collection", F.col("collection").cast("string"))
    return rows.select("collection", "doc_id", "head_id", "start", F.lead("start").over(by).alias("next_start"), "pos", "len", "smaller", "is_end")


def factorize(spark: SparkSession, list_path: str, folder: str) -> list[str]:
    """The files of a file of file names: the first is the reference, each other one a collection. Returns the names of those added now.

    The index is built where the folder has none, and a collection whose file
    (path, length and time of change) was added before is left alone.
    """
    first, *others = file_list(spark, list_path)
    if not exists(spark, f"{folder}/reference/_SUCCESS"):
        build(reference_file(spark, first), folder)
    added = []
    for path in others:
        stem = hashlib.sha256(path.encode()).hexdigest()[:12]
        name = f"{stem}-{hashlib.sha256(repr(files(spark, path)).encode()).hexdigest()[:12]}"
        if not exists(spark, f"{folder}/heads/collection={name}/_SUCCESS"):
            for old in [n for n, _, _ in (files(spark, f"{folder}/heads") if exists(spark, f"{folder}/heads") else ()) if n.startswith(f"collection={stem}-")]:
                delete(spark, f"{folder}/heads/{old}")
            add(collection_file(spark, path), folder, name)
            added.append(name)
    return added
