"""Rows told from texts and put in order by keys of which there are few kinds: kinds are counted part by part, and no row is sorted or shuffled.

A part is a range of documents. How many rows of each kind come before a part's
is summed over kinds and parts; the parts' texts then tell their rows once more, each
with its place. So what travels are texts, and a row for each kind that a part has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import importable, stored
from .backward import Heads, Index, indexed
from .hashmatch import dealt
from .ranking import bucket_rank, carried, running
from .symbols import BATCH, TOGETHER, Texts, of_texts

#: Symbols of a part, more or less; at least so many parts for a core, but for small parts.
PART, PARTS, SMALL = 1 << 21, 4, 1 << 16
#: Codes that a symbol has, the end's among them.
CODES = 0x110001

#: What :func:`in_order` and :func:`kinds` tell rows by: (number of the text, columns, key) of texts put together, rows in order; a key below 0 has no place.
Told = Callable[[Texts], tuple[np.ndarray, dict, np.ndarray]]


def _parted(collection: DataFrame) -> DataFrame:
    """(part, doc_id, text): ``part`` rises with doc_id."""
    n, size = collection.agg(F.count("*"), F.sum(F.length("text"))).first()
    cores = collection.sparkSession.sparkContext.defaultParallelism
    most = min(PART, max(SMALL, (size or 0) // (PARTS * cores)))
    step = max(1, most * n // max(size or 1, 1))
    return collection.select(F.expr(f"doc_id div {step}").alias("part"), "doc_id", "text")


def kinds(collection: DataFrame, told: Told, by: str) -> DataFrame:
    """(``by``, key, n): how many rows have each key, for each value of the column ``by``; counted in the tasks first."""

    def counted(t: Texts) -> tuple[np.ndarray, dict]:
        doc, _, key = told(t)
        some = key >= 0
        value, whose = np.unique(t.ids.to_numpy(), return_inverse=True)
        whose, key = whose[doc[some]], key[some]
        order = np.lexsort((key, whose))
        whose, key = whose[order], key[order]
        first = np.flatnonzero(np.append(True, (np.diff(whose) != 0) | (np.diff(key) != 0))[: len(key)])
        text = np.zeros(len(value), np.int64)
        text[np.searchsorted(value, t.ids.to_numpy())] = np.arange(len(t.texts))
        return text[whose[first]], {"key": key[first], "n": np.diff(first, append=len(key))}

    return of_texts(collection, counted, "key long, n long", by).groupBy(by, "key").agg(F.sum("n").alias("n"))


def in_order(collection: DataFrame, told: Told, slot: int, schema: str) -> DataFrame:
    """(order_no, name, doc_id, ``schema``): the rows' places from 0 by (key, doc_id, row), and the dense number of their key from 0; null where the key is below 0.

    Keys divided by ``slot`` are places of a reference.
    """
    spark = collection.sparkSession
    parts = _parted(collection)
    counts = stored(kinds(dealt(parts, "part").sortWithinPartitions("part"), told, "part"), "kinds")
    every = counts.groupBy("key").agg(F.sum("n").alias("n")).withColumn("slot", F.expr(f"key div {slot}"))
    before = running(every.groupBy("slot").agg(F.sum("n").alias("n")), "slot", "n", "_off").select("slot", "_off")
    inside = Window.partitionBy("slot").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(before, "slot").select("key", "slot", (F.col("_off") + F.col("_in")).alias("_first"))
    every = bucket_rank(every, F.col("slot"), ["key"], "name").select("key", "_first", "name")
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(every, "key")
    starts = starts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("key", (F.col("_first") + F.col("_earlier")).alias("at"), "name"))).alias("x"))
    column = lambda c: F.col("x")[c].alias(c)
    starts = stored(starts.select("part", column("key"), column("at"), column("name")), "starts")
    kind = collection.schema["doc_id"].dataType.simpleString()
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    lists = [none(c, "array<bigint>") for c in ("key", "at", "name")]
    rows = parts.select("part", F.lit(1).alias("_kind"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), *lists)
    rows = rows.union(starts.select("part", F.lit(0).alias("_kind"), none("doc_id", kind), none("text", "string"), "key", "at", "name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, at, names = np.zeros((3, 0), np.int64)
        for batch in batches:
            new, texts, a = batch["_kind"].to_pylist(), batch["text"].to_pylist(), 0
            while a < len(new):
                if not new[a]:
                    keys, at, names = (batch[c].slice(a, 1).flatten().to_numpy() for c in ("key", "at", "name"))
                    at, a = at.copy(), a + 1
                    continue
                b, size = a + 1, len(texts[a])
                while b < len(new) and new[b] and size + len(texts[b]) <= TOGETHER:
                    size, b = size + len(texts[b]), b + 1
                ids = batch["doc_id"].slice(a, b - a)
                doc, columns, key = told(Texts(ids, texts[a:b]))
                some = np.flatnonzero(key >= 0)
                own = np.searchsorted(keys, key[some])
                order = np.argsort(own, kind="stable")
                place, name, count = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), np.bincount(own, minlength=len(keys))
                earlier = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
                place[some[order]] = at[own[order]] + earlier
                name[some] = names[own]
                at += count
                out = {"order_no": pa.array(place, mask=key < 0), "name": pa.array(name, mask=key < 0), "doc_id": ids.take(pa.array(doc)), **columns}
                for k in range(0, len(doc), BATCH):
                    part = [c[k : k + BATCH] if isinstance(c, np.ndarray) else c.slice(k, BATCH) for c in out.values()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in part], [*out])
                a = b

    importable(spark)
    return dealt(rows, "part").sortWithinPartitions("part", "_kind", "doc_id").mapInArrow(run, f"order_no long, name long, doc_id {kind}, {schema}")


def _head_keys(reference: DataFrame, index: DataFrame, key: Callable[..., np.ndarray], columns: Callable[..., dict], ends: bool) -> Told:
    index_of = indexed(index, reference)

    def told(t: Texts) -> tuple[np.ndarray, dict, np.ndarray]:
        ref = index_of()
        pos, length, smaller = ref.matched(t)
        h = Heads(t, pos, length)
        own = slice(None) if ends else np.flatnonzero(~h.is_end)
        at = h.at[own]
        value = np.where(h.is_end[own], -1, key(t, ref, at, ref.isa()[pos[at]], length[at], smaller[at]))
        return h.doc[own], columns(h.number[own], h.start[own], pos[at], length[at]), value

    return told


def _phrase(t: Texts, ref: Index, at: np.ndarray, slot: np.ndarray, length: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    return slot * (ref.n + 1) + length


def _match(t: Texts, ref: Index, at: np.ndarray, slot: np.ndarray, length: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """Slot, side, length and next symbol in one number: below 2^63 for references that :mod:`backward` takes."""
    side = (slot * 2 + ~smaller) * (ref.n + 1) + np.where(smaller, length, ref.n - length)
    return side * CODES + t.code[at + length]


def sorted_phrases(collection: DataFrame, reference: DataFrame, index: DataFrame) -> DataFrame:
    """(order_no, doc_id, start, pos, len), as :func:`matchstats.sorted_phrases`."""
    n = reference.select(F.length("text")).first()[0]
    told = _head_keys(reference, index, _phrase, lambda number, start, pos, length: {"start": start, "pos": pos, "len": length}, False)
    rows = in_order(collection, told, n + 1, "start long, pos long, len long")
    return rows.drop("name")


def sorted_heads(collection: DataFrame, reference: DataFrame, index: DataFrame, ends: bool = True) -> DataFrame:
    """(order_no, name, doc_id, head_id), as :func:`gsa.sorted_heads`; without document ends but for ``ends``."""
    n = reference.select(F.length("text")).first()[0]
    told = _head_keys(reference, index, _match, lambda number, start, pos, length: {"head_id": number}, ends)
    rows = in_order(collection, told, 2 * (n + 1) * CODES, "head_id long")
    return rows.withColumn("name", F.coalesce(F.col("name") + 2, F.lit(1)))


def length_buckets(collection: DataFrame, reference: DataFrame, index: DataFrame) -> DataFrame:
    """(n_buckets, max_run), as :func:`matchstats.length_buckets` of :func:`sorted_phrases`: runs of equal length among (slot, length) and their counts."""
    n = reference.select(F.length("text")).first()[0]
    told = _head_keys(reference, index, _phrase, lambda *_: {}, False)
    rows = kinds(dealt(collection.select(F.lit(0).cast("long").alias("all"), "doc_id", "text"), "doc_id"), told, "all")
    rows = stored(rows.select(F.expr(f"key div {n + 1}").alias("slot"), F.expr(f"key % {n + 1}").alias("len"), "n"), "kinds")
    slots = rows.groupBy("slot").agg(F.sum("n").alias("n"), F.max("len").alias("last"))
    before = running(slots, "slot", "n", "_off").select("slot", "_off").join(carried(slots, "slot", {"_before": "last"}), "slot")
    inside = Window.partitionBy("slot").orderBy("len")
    rows = rows.withColumns({"_in": F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_own": F.lag("len").over(inside)}).join(before, "slot")
    starts = rows.where("coalesce(_own, _before) is null or coalesce(_own, _before) <> len").select("slot", (F.col("_off") + F.col("_in")).alias("order_no"))
    starts = stored(bucket_rank(starts, F.col("slot"), ["order_no"], "k"), "runs")
    following = starts.select((F.col("k") - 1).alias("k"), F.col("order_no").alias("_next"))
    total = rows.agg(F.sum("n").alias("_n"))
    runs = starts.join(following, "k", "left").join(total).select((F.coalesce("_next", "_n") - F.col("order_no")).alias("run"))
    return runs.agg(F.count("*").alias("n_buckets"), F.max("run").alias("max_run"))
