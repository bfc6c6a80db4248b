"""Symbols of a collection (doc_id, text): positions, runs, alphabets, histograms and bucket bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import importable

#: Symbols of texts that a task looks at together (a longer text alone), and rows of a batch it returns.
TOGETHER, BATCH = 1 << 18, 1 << 16


class Texts:
    """Texts put together: ``code`` has each one's code points plus 1 and a 0 where it ends, ``doc`` its number, ``idx`` the place in it."""

    def __init__(self, ids: pa.Array, texts: list[str]):
        self.ids, self.texts, sizes = ids, texts, np.array([len(t) + 1 for t in texts])
        raw = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        self.start = np.cumsum(sizes) - sizes
        self.idx = np.arange(len(raw)) - self.start[self.doc]
        self.code = raw.astype(np.int64) + 1
        self.code[self.start + sizes - 1] = 0
        #: The symbols that occur in order of code, the end's empty one first, and the place of each one's there.
        self.known = np.flatnonzero(np.bincount(self.code))
        place = np.zeros(self.known[-1] + 1, np.int64)
        place[self.known] = np.arange(len(self.known))
        self.place = place[self.code]

    def symbols(self, at: np.ndarray) -> pa.Array:
        return pa.array([chr(c - 1) if c else "" for c in self.known.tolist()]).take(pa.array(self.place[at]))


def of_texts(collection: DataFrame, told: Callable[..., tuple[np.ndarray, dict]], schema: str, key: str = "doc_id", lists: tuple[str, ...] = (), put: Callable[..., Texts] = Texts) -> DataFrame:
    """(key, ``schema``): rows told from whole texts, where they lie; ``told`` gives the number of the text of each row, and the columns.

    Texts are put together by ``put``, which may take other forms of them, such as bytes.

    With ``lists``, columns of equally long lists, it also gets the number of the text of each entry, and the entries of each list.
    """
    kind, empty = collection.schema[key].dataType.simpleString(), b"" if collection.schema["text"].dataType.simpleString() == "binary" else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, a = batch.column(0), [t or empty for t in batch.column(1).to_pylist()], 0
            while a < len(texts):
                b, size = a + 1, len(texts[a])
                while b < len(texts) and size + len(texts[b]) <= TOGETHER:
                    size, b = size + len(texts[b]), b + 1
                held = [batch.column(c).slice(a, b - a) for c in lists]
                more = [np.repeat(np.arange(b - a), pc.fill_null(pc.list_value_length(held[0]), 0).to_numpy())] if held else []
                doc, columns = told(put(ids.slice(a, b - a), texts[a:b]), *more, *[h.flatten().to_numpy() for h in held])
                names = [key, *columns]
                for at in range(0, len(doc), BATCH):
                    part = [c[at : at + BATCH] if isinstance(c, np.ndarray) else c.slice(at, BATCH) for c in columns.values()]
                    yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).take(pa.array(doc[at : at + BATCH])), *[pa.array(c) if isinstance(c, np.ndarray) else c for c in part]], names)
                a = b

    importable(collection.sparkSession)
    return collection.select(key, "text", *lists).mapInArrow(run, f"{key} {kind}, {schema}")


def next_place(hit: np.ndarray) -> np.ndarray:
    """For each place the first one from there on where ``hit`` holds (it must hold at the last)."""
    return np.minimum.accumulate(np.where(hit, np.arange(len(hit)), len(hit))[::-1])[::-1]


def positions(collection: DataFrame, ahead: int = 0) -> DataFrame:
    """(doc_id, idx, sym) of every symbol; one row of text is exploded at a time.

    With ``ahead``, also ``key``: the symbol and what follows it, ``ahead``
    symbols in all. It is taken from the array of symbols, so the work is
    linear in the text.
    """
    symbols = F.filter(F.split(F.coalesce("text", F.lit("")), ""), lambda c: c != "")
    if not ahead:
        return collection.select("doc_id", F.posexplode(symbols).alias("idx", "sym")).select("doc_id", F.col("idx").cast("long").alias("idx"), "sym")
    split = collection.select("doc_id", symbols.alias("_a"))
    key = lambda c, i: F.concat_ws("", *[F.get("_a", i + k) for k in range(ahead)])
    rows = split.select("doc_id", F.posexplode(F.transform("_a", lambda c, i: F.struct(c.alias("sym"), key(c, i).alias("key")))).alias("idx", "x"))
    return rows.select("doc_id", F.col("idx").cast("long").alias("idx"), "x.sym", "x.key")


def with_ends(rows: DataFrame, collection: DataFrame) -> DataFrame:
    """Positions with an end row of each document, whose symbol is the empty string (less than all others)."""
    ends = collection.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("idx"), F.lit("").alias("sym"))
    return rows.unionByName(ends)


def histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sym").agg(F.count("*").alias("n"))


def max_runs(collection: DataFrame) -> DataFrame:
    """(sym, max_run): the longest run of each symbol; runs end with their document.

    Each task tells the longest run of each symbol in the texts it looks at
    together, so nothing more is shuffled.
    """

    def told(t: Texts) -> tuple[np.ndarray, dict]:
        first = np.flatnonzero(np.diff(t.place, prepend=-1))
        longest = np.zeros(len(t.known), np.int64)
        np.maximum.at(longest, t.place[first], np.diff(first, append=len(t.place)))
        kinds = np.arange(1, len(t.known))
        return np.zeros(len(kinds), np.int64), {"sym": pa.array([chr(c - 1) for c in t.known[1:].tolist()], pa.string()), "run": longest[kinds]}

    return of_texts(collection, told, "sym string, run long").groupBy("sym").agg(F.max("run").alias("max_run"))


def bucket_bounds(counts: DataFrame, key: str = "sym", count: str = "n") -> DataFrame:
    """Adds ``bucket_start`` (exclusive) and ``bucket_end`` (inclusive) sums in key order. One row per symbol goes to one task."""
    w = Window.orderBy(key)
    return counts.withColumns({
        "bucket_start": F.coalesce(F.sum(count).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "bucket_end": F.sum(count).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    })


def alphabet_codes(*rows: DataFrame) -> DataFrame:
    """(sym, code): dense codes of the joint alphabet in symbol order."""
    first, *others = [r.select("sym").distinct() for r in rows]
    for r in others:
        first = first.union(r)
    return first.distinct().withColumn("code", (F.row_number().over(Window.orderBy("sym")) - 1).cast("long"))


def augmented(reference: DataFrame, collection: DataFrame, separator: str = "%") -> DataFrame:
    """(ref_id, text): each reference, the symbols it lacks (each repeated by its longest run, in symbol order) and the terminator.

    Then every symbol of the collection but ``separator`` (empty: every one) has a match of length 1 at least.
    """
    runs = max_runs(collection).where(F.col("sym") != separator)
    every = runs.agg(F.sort_array(F.collect_list(F.struct("sym", "max_run"))).alias("x"))  # at most one entry a symbol
    every = every.select(F.array_join(F.transform("x", lambda s: F.repeat(s["sym"], s["max_run"].cast("int"))), "").alias("every"))
    # what a reference has is struck out of all runs: work in proportion to both
    tail = F.call_function("translate", F.col("every"), F.col("text"), F.lit(""))
    return reference.join(F.broadcast(every)).select("ref_id", F.concat("text", tail, F.lit("$\n")).alias("text"))
