"""Matching statistics of arriving documents against a reference whose index is a folder (:mod:`corpusloom.sources.library`).

The index is read, never built in a batch. Output is one folder a batch, named
by its number, so a batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import library
from ..storage import exists, stored


def stream_matches(documents: DataFrame, folder: str, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that writes (doc_id, idx, pos, len, smaller) of each micro-batch of whole documents (doc_id, text) to ``path``."""

    def one(batch: DataFrame, number: int) -> None:
        library.matches(stored(batch.select("doc_id", "text"), "batch"), folder).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return documents.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_pieces(pieces: DataFrame, folder: str, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """As :func:`stream_matches`, for documents that arrive in ``pieces`` (doc_id, piece, text, is_last), in order of ``piece``.

    A match that reaches the end of what has arrived may go on, and so may
    those of all later positions; everything before is final and written. What
    is open (doc_id, start, text) is the state, a folder a batch too, which
    the next batch reads; a document's last piece closes it. So the statistics
    are those of the whole documents, however they were cut.
    """
    spark = pieces.sparkSession
    empty = f"doc_id {pieces.schema['doc_id'].dataType.simpleString()}, start long, text string"

    def one(batch: DataFrame, number: int) -> None:
        rows = stored(batch.select("doc_id", "piece", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("is_last", F.lit(False)).alias("is_last")), "pieces")
        before = f"{path}/open/batch={number - 1}"
        open_ = spark.read.schema(empty).parquet(before) if exists(spark, before) else spark.createDataFrame([], empty)
        joined = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda p: p["text"]), "").alias("_new"), F.max("is_last").alias("_last"))  # one document's new pieces
        whole = open_.join(joined, "doc_id", "full").select(
            "doc_id", F.coalesce("start", F.lit(0)).alias("start"), F.concat(F.coalesce("text", F.lit("")), F.coalesce("_new", F.lit(""))).alias("text"), F.coalesce("_last", F.lit(False)).alias("_last"))
        whole = stored(whole, "arrived")
        told = stored(library.matches(whole.select("doc_id", "text"), folder).join(whole.select("doc_id", "start", "_last", F.length("text").alias("_n")), "doc_id"), "matches")
        final = F.col("_last") | (F.col("idx") + F.col("len") < F.col("_n"))
        told.where(final).select("doc_id", (F.col("start") + F.col("idx")).alias("idx"), "pos", "len", "smaller").write.mode("overwrite").parquet(f"{path}/final/batch={number}")
        ends = told.where(~final).groupBy("doc_id").agg(F.min("idx").alias("_at"))
        left = whole.where("not _last").join(ends, "doc_id", "left").withColumn("_at", F.coalesce("_at", F.length("text").cast("long")))
        left.select("doc_id", (F.col("start") + F.col("_at")).alias("start"), F.expr("substring(text, cast(_at + 1 as int))").alias("text")).write.mode("overwrite").parquet(f"{path}/open/batch={number}")

    return pieces.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
