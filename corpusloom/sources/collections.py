"""Readers of references and collections, and table, text and binary sinks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import trim_terminators
from ..storage import importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_list(spark: SparkSession, path: str) -> list[str]:
    """A file of file names, one a line: the reference first, then collections."""
    rows = spark.read.text(path, wholetext=True).first()
    return [x.strip() for x in (rows[0] if rows else "").splitlines() if x.strip()]


def reference_file(spark: SparkSession, path: str, ref_id: int = 0) -> DataFrame:
    """(ref_id, text): a whole file without its trailing line break and terminator."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.lit(ref_id).cast("long").alias("ref_id"), trim_terminators(F.col("value")).alias("text"))


def collection_file(spark: SparkSession, path, separator: str = "%") -> DataFrame:
    """(doc_id, text): documents that each end with ``separator``; what follows the last one is dropped.

    The separator is only a file format; tables have a row for each document.
    Spark splits the file at it, so no file is read whole. ``path`` may be a list.
    """
    lines = spark.read.text(path, lineSep=separator).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
    lines = lines.withColumn("_n", F.monotonically_increasing_id()).where("value not rlike '^[\\n\\r]*$' or value = ''")
    # numbered inside each block of a file, after the documents of the blocks before
    sizes = lines.groupBy("_f", "_b").count()
    span = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_f", "_b", F.coalesce(F.sum("count").over(span), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_n"))
    numbered = lines.withColumn("_local", local).join(before, ["_f", "_b"])
    return numbered.select((F.col("_before") + F.col("_local")).cast("long").alias("doc_id"), F.regexp_replace("value", "^[\n\r]+", "").alias("text"))


def read_collections(spark: SparkSession, list_path: str) -> tuple[DataFrame, DataFrame]:
    """The reference and the joint collection that a file of file names tells."""
    first, *others = file_list(spark, list_path)
    return reference_file(spark, first), collection_file(spark, others)


def suffix_array_file(spark: SparkSession, path: str, ref_id: int = 0) -> DataFrame:
    """(ref_id, rank, pos) from a binary file of little-endian 32-bit integers."""
    n = F.floor(F.octet_length("content") / 4).cast("int")
    word = lambda i: F.conv(F.concat(*[F.hex(F.substring("content", (i * 4 + k).cast("int"), F.lit(1))) for k in (4, 3, 2, 1)]), 16, 10)
    rows = spark.read.format("binaryFile").load(path).where("length > 0").select("content", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    return rows.select(F.lit(ref_id).cast("long").alias("ref_id"), F.col("i").cast("long").alias("rank"), word(F.col("i")).cast("long").alias("pos"))


def write_index(df: DataFrame, path: str, order: list[str]) -> None:
    """A table sorted within files, so that readers can skip by column statistics."""
    df.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def write_collection_index(path: str, reference: DataFrame, index: DataFrame, heads: DataFrame) -> None:
    """A reference, its index and a collection's heads (relative to it) as one folder: what a compressed collection is made of."""
    reference.select("ref_id", F.length("text").cast("long").alias("length"), "text").write.mode("overwrite").parquet(f"{path}/reference")
    write_index(index, f"{path}/index", ["ref_id", "rank"])
    write_index(heads.select("doc_id", "head_id", "start", "pos", "len", "smaller", "is_end"), f"{path}/heads", ["doc_id", "head_id"])


def read_collection_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reference, index, heads) of such a folder; heads have ``next_start`` again."""
    by = Window.partitionBy("doc_id").orderBy("head_id")
    heads = spark.read.parquet(f"{path}/heads")
    heads = heads.select("doc_id", "head_id", "start", F.lead("start").over(by).alias("next_start"), "pos", "len", "smaller", "is_end")
    return spark.read.parquet(f"{path}/reference").select("ref_id", "text"), spark.read.parquet(f"{path}/index"), heads


def decoded(reference: DataFrame, heads: DataFrame) -> DataFrame:
    """(doc_id, text): the documents that the heads tell, each phrase cut from the reference (which must hold every symbol).

    A phrase ends where the next one, or the document, begins; a document's heads meet in one group.
    """
    kind, text = heads.schema["doc_id"].dataType.simpleString(), reference.first()["text"] or ""  # one reference
    sent = reference.sparkSession.sparkContext.broadcast(text)

    def told(key, rows):
        start, pos, is_end = (rows[c].to_numpy() for c in ("start", "pos", "is_end"))
        order = np.lexsort((is_end, start))
        start, text = start[order], sent.value
        parts = [text[p : p + n] for p, n in zip(pos[order].tolist(), np.diff(start, append=start[-1]).tolist())]
        return pa.table({"doc_id": pa.array([key[0].as_py()], rows["doc_id"].type), "text": ["".join(parts)]})

    importable(reference.sparkSession)
    return heads.select("doc_id", "start", "pos", "is_end").groupBy("doc_id").applyInArrow(told, f"doc_id {kind}, text string")


def write_phrases(phrases: DataFrame, path: str) -> None:
    """Text lines ``pos len`` in phrase order; file names follow the order."""
    ranged = phrases.repartitionByRange("order_no").sortWithinPartitions("order_no")
    ranged.select(F.concat_ws(" ", "pos", "len").alias("value")).write.mode("overwrite").text(path)


def write_reference(augmented: DataFrame, path: str) -> None:
    """The augmented reference as one text; its last line break comes from the writer."""
    augmented.select(F.regexp_replace("text", "\n\\z", "").alias("value")).write.mode("overwrite").text(path)


def write_series(df: DataFrame, path: str) -> None:
    """A debug series as CSV with a header."""
    df.write.mode("overwrite").csv(path, header=True)
