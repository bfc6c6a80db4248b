"""Suffix arrays and BWT of integer sequences (seq_id, pos, val)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import importable, stored
from .ownindex import Ranks
from .ranking import doubled, sparse_start
from .symbols import Texts

#: Values of sequences that a task sorts together, and of a sequence that is left to tables; both hold fewer kinds than there are code points.
TOGETHER, MOST = 1 << 18, 1 << 19


def sequences(rows: DataFrame, seq: str, value, order: list) -> DataFrame:
    """(seq_id, pos, val): positions in order within each sequence."""
    pos = (F.row_number().over(Window.partitionBy(seq).orderBy(*order)) - 1).cast("long")
    return rows.select(F.col(seq).alias("seq_id"), pos.alias("pos"), value.cast("long").alias("val"))


def _spread_array(values: DataFrame) -> DataFrame:
    """(seq_id, rank, pos) by prefix doubling from single values."""
    rows = values.select("seq_id", F.col("seq_id").alias("doc_id"), F.col("pos").alias("idx"), "val")
    ranked = doubled(sparse_start(rows, F.col("val"), ["seq_id"]), 1, ["seq_id"])
    return ranked.select("seq_id", F.col("r").cast("long").alias("rank"), F.col("idx").alias("pos"))


def _own(values: DataFrame, told, schema: str) -> DataFrame:
    """(seq_id, ``schema``): what sequences tell by themselves; ``told`` gets them put together, their suffix order and their values with ends."""
    kind = values.schema["seq_id"].dataType.simpleString()
    names = ["seq_id", *[c.split()[0] for c in schema.split(", ")]]

    def run(rows):
        rows = rows.sort_by([("seq_id", "ascending"), ("pos", "ascending")])
        val, number = rows["val"].to_numpy(), np.unique(rows["seq_id"].to_numpy(), return_inverse=True)[1]
        first = np.flatnonzero(np.diff(number, prepend=-1))
        code = np.unique(val, return_inverse=True)[1].astype("<u4")
        texts = [c.tobytes().decode("utf-32-le", "surrogatepass") for c in np.split(code, first[1:])]
        t = Texts(rows["seq_id"].take(pa.array(first)).combine_chunks(), texts)
        r = Ranks(t)
        found = told(t, r, np.insert(val, np.append(first[1:], len(val)), 0))
        return pa.table(dict(zip(names, [t.ids.take(pa.array(r.doc)), *found])))

    importable(values.sparkSession)
    parts = values.count() // TOGETHER + values.sparkSession.sparkContext.defaultParallelism
    rows = values.select("seq_id", "pos", "val", F.pmod(F.xxhash64("seq_id"), F.lit(parts)).alias("_part"))
    return rows.groupBy("_part").applyInArrow(run, f"seq_id {kind}, {schema}")


def _told(values: DataFrame, told, schema: str, spread) -> DataFrame:
    """What short sequences tell by themselves, and very long ones by ``spread``, over many tasks."""
    many = values.groupBy("seq_id").count().where(F.col("count") > MOST).select("seq_id")
    if many.isEmpty():
        return _own(values, told, schema)
    few = _own(values.join(many, "seq_id", "left_anti"), told, schema)
    return few.union(spread(values.join(many, "seq_id", "left_semi")))


def suffix_array(values: DataFrame) -> DataFrame:
    """(seq_id, rank, pos)"""
    return _told(values, lambda t, r, val: (r.rank, t.idx[r.at]), "rank long, pos long", _spread_array)


def library_bwt(values: DataFrame) -> DataFrame:
    """As :func:`bwt` of :func:`suffix_array`, told where a sequence is sorted."""

    def told(t: Texts, r: Ranks, val: np.ndarray):
        idx = t.idx[r.at]
        primary = np.zeros(len(t.texts), np.int64)
        primary[r.doc[idx == 0]] = r.rank[idx == 0] + 1
        primary = primary[r.doc]
        before = np.where(idx > 0, r.at - 1, t.start[r.doc] + r.size[r.doc] - 1)
        return np.where(idx == 0, 0, r.rank + (r.rank < primary)), val[before], primary

    return _told(values, told, "i long, val long, primary_index long", lambda v: bwt(v, stored(_spread_array(v), "sa")))


def bwt(values: DataFrame, sa: DataFrame) -> DataFrame:
    """(seq_id, i, val, primary_index): last value first, then the values before each suffix but that of position 0."""
    primary = sa.where("pos = 0").select("seq_id", (F.col("rank") + 1).alias("primary_index"))
    last = values.groupBy("seq_id").agg(F.max("pos").alias("_last"))
    rows = sa.join(primary, "seq_id").join(last, "seq_id")
    first = F.col("pos") == 0
    i = F.when(first, 0).otherwise(F.col("rank") + F.when(F.col("rank") < F.col("primary_index"), 1).otherwise(0)).cast("long")
    rows = rows.select("seq_id", i.alias("i"), F.when(first, F.col("_last")).otherwise(F.col("pos") - 1).alias("pos"), "primary_index")
    return rows.join(values, ["seq_id", "pos"]).select("seq_id", "i", "val", "primary_index")
