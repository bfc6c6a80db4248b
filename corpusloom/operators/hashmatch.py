"""Matching statistics by hashed prefixes: the collection is never sorted, alone or with the reference.

The reference's suffix tree (its LCP intervals and leaves) becomes a table of
*handles*: of each node, whose string is longer than its parent's by the
lengths (parent, own], the prefix of the length that is divisible by the
greatest power of two in there, as (length, hash). A position's match is then
found by a binary search over lengths in which each step is one equi-join of
(length, hash of the text's next symbols) with the handles, so its steps are
the logarithm of the longest match.

Lengths up to CHUNK need the position's next CHUNK symbols only. What matches
further is hashed by prefix sums: sums of symbol x power of a base modulo two
primes, made in the document's row, so the hash of any piece is told from two
places. Where a match ends inside an edge of the tree, positions in a row on
one diagonal end together, and only the last of each such run is extended, bit
by bit. Matches are confirmed on text, piece by piece; if two hashes ever
collided, all is done again with another base.

With the end of the tree's path known, the neighbours follow from the node's
interval and the next symbol, as everywhere in this package: the successor in
sorted order wins ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import floor_log2
from ..storage import importable, stored
from .refindex import interval_bounds, lcp_intervals
from .symbols import positions

CHUNK = 32
#: Steps of an extension that one job does.
ROUNDS = 4
PRIMES = (2_147_483_647, 2_147_483_629)


def fattest(a: Column, b: Column) -> Column:
    """The number of (a, b] that is divisible by the greatest power of two."""
    k = floor_log2(a.bitwiseXOR(b))
    return F.call_function("shiftleft", F.call_function("shiftright", b, k), k).cast("long")


def _powers(base: int, n: int, p: int) -> np.ndarray:
    out, have = np.ones(n, np.uint64), 1
    while have < n:
        step = np.uint64(pow(base, have, p))
        out[have : 2 * have] = out[: min(have, n - have)] * step % np.uint64(p)
        have *= 2
    return out


def prefix_hashes(text: str, base: int) -> list[np.ndarray]:
    """Per prime: sums of (symbol + 1) * base^i before each place, and base^-i there; len(text) + 1 of each."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    out = []
    for p in PRIMES:
        sums = np.concatenate([[np.uint64(0)], np.cumsum(code * _powers(base, len(code), p) % np.uint64(p))]) % np.uint64(p)
        out += [sums.astype(np.int64), _powers(pow(base, -1, p), len(code) + 1, p).astype(np.int64)]
    return out


def dealt(collection: DataFrame, key: str) -> DataFrame:
    """Documents spread over as many tasks as a shuffle has: each symbol becomes a row, so a task of the scan would hold far more than its share."""
    importable(collection.sparkSession)
    return collection.repartition(int(collection.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def chunks(collection: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, idx, left, chunk): at each position, how many symbols are left and the next CHUNK of them."""
    kind = collection.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, text in zip(batch[key], batch["text"]):
                n = len(text or "")
                for a in range(0, n, 10_000):
                    at = range(a, min(n, a + 10_000))
                    yield pd.DataFrame({"doc_id": doc, "idx": at, "left": [n - i for i in at], "chunk": [text[i : i + CHUNK] for i in at]})

    return dealt(collection.select(key, "text"), key).mapInPandas(run, f"doc_id {kind}, idx long, left long, chunk string")


def hash_table(collection: DataFrame, base: int, key: str = "doc_id") -> DataFrame:
    """(doc_id, at, s1, w1, s2, w2): the prefix sums and weights at every place, the end included."""
    kind = collection.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, text in zip(batch[key], batch["text"]):
                columns = prefix_hashes(text or "", base)
                for a in range(0, len(columns[0]), 10_000):
                    part = [c[a : a + 10_000] for c in columns]
                    yield pd.DataFrame({"doc_id": doc, "at": np.arange(a, a + len(part[0])), **dict(zip(("s1", "w1", "s2", "w2"), part))})

    return dealt(collection.select(key, "text"), key).mapInPandas(run, f"doc_id {kind}, at long, s1 long, w1 long, s2 long, w2 long")


def piece_hash(a: str, b: str) -> Column:
    """The hash of the piece from a place to a later one, from structs of :func:`hash_table`."""
    one = lambda k, p: F.pmod(F.pmod(F.col(f"{b}.s{k}") - F.col(f"{a}.s{k}"), F.lit(p)) * F.col(f"{a}.w{k}"), F.lit(p))
    return one(1, PRIMES[0]) * (1 << 31) + one(2, PRIMES[1])


def at_place(rows: DataFrame, table: DataFrame, place: Column, out: str, doc: str | None = "doc_id") -> DataFrame:
    """``rows`` with the struct ``out`` of :func:`hash_table` at (``doc``, ``place``), null where there is no such place. ``doc`` is None for the one reference."""
    key = [doc] if doc else []
    side = table.select(*key, F.col("at").alias("_at"), F.struct("s1", "w1", "s2", "w2").alias(out))
    return rows.withColumn("_at", place).join(side, [*key, "_at"], "left").drop("_at")


def tree(index: DataFrame, reference: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, children) of one reference's suffix tree; ``n`` is its length.

    Nodes (lo, hi, len, up, f, pos, chunk): ranks of the suffixes that begin
    with the node's string, its length and its parent's, its handle's length,
    one of its places in the reference and the CHUNK symbols there. Children
    (lo, len, kids): of each branching node, its children in symbol order; a
    child without a symbol (and without ``node``) is a suffix that ends there.
    """
    intervals = stored(lcp_intervals(index), "intervals")
    border = index.select((F.col("rank") - 1).alias("hi"), F.col("lcp").alias("_y"))
    first = index.select(F.col("rank").alias("lo"), "pos", F.col("lcp").alias("_x"))
    inner = intervals.where("hi > lo").select("lo", "hi", "len").distinct()
    leaves = index.select(F.col("rank").alias("lo"), F.col("rank").alias("hi"), (F.lit(n) - F.col("pos")).alias("len"))
    nodes = inner.union(leaves).join(first, "lo").join(border, "hi", "left")
    up = F.greatest(F.when(F.col("lo") > 0, F.col("_x")).otherwise(0), F.coalesce("_y", F.lit(0)))
    nodes = nodes.withColumn("up", up).where("len > up").withColumn("f", fattest(F.col("up"), F.col("len")))
    text = chunks(reference, "ref_id").select(F.col("idx").alias("pos"), "chunk")
    nodes = stored(nodes.select("lo", "hi", "len", "up", "f", "pos").join(text, "pos"), "tree-nodes")

    bounds = interval_bounds(index, reference, intervals.where("hi > lo or len = 0"))
    kid = nodes.select(F.col("lo").alias("left_bound"), F.col("hi").alias("right_bound"), F.col("up").alias("len"), F.struct("lo", "hi", "len", "pos", "chunk").alias("node"))
    kids = bounds.join(kid, ["left_bound", "right_bound", "len"], "left")
    kids = kids.withColumn("node", F.when(F.col("sym") != "", F.col("node")))
    kids = kids.groupBy("lo", "len").agg(F.sort_array(F.collect_list(F.struct("sym", F.col("left_bound").alias("first"), "node"))).alias("kids"))  # at most one a symbol
    return nodes, stored(kids, "tree-children")


def _searched(rows: DataFrame, handles: DataFrame, key) -> DataFrame:
    """One step: the handle of the fattest length in (a, b] is looked up by ``key`` of that length."""
    open_ = F.col("a") < F.col("b")
    rows = rows.withColumn("f", F.when(open_, fattest(F.col("a"), F.col("b"))))
    rows = key(rows).join(handles, ["f", "key"], "left")
    hit = F.col("n").isNotNull()
    return rows.withColumns({
        "node": F.when(hit, F.col("n")).otherwise(F.col("node")), "from": F.when(hit, F.col("f")).otherwise(F.col("from")),
        "a": F.when(hit, F.col("n.len")).otherwise(F.col("a")), "b": F.when(open_ & ~hit, F.col("f") - 1).otherwise(F.col("b"))}).drop("f", "key", "n")


def agreement(rows: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds ``out``: how many of the first CHUNK symbols of two strings agree (null counts as none)."""
    rows = rows.withColumn(out, F.lit(0))
    step = CHUNK
    while step:
        at = F.col(out) + 1
        same = F.substring(a, at, F.lit(step)) == F.substring(b, at, F.lit(step))
        rows = rows.withColumn(out, F.when(F.coalesce(same, F.lit(False)), F.col(out) + step).otherwise(F.col(out)))
        step //= 2
    return rows.withColumn(out, F.coalesce(F.least(out, F.length(a), F.length(b)), F.lit(0)).cast("long"))


def _child(rows: DataFrame, children: DataFrame, symbol: Column) -> DataFrame:
    """For rows whose match ends at ``node``: ``child`` by the next symbol, else ``next``: the first rank that sorts after (null if none)."""
    ends = F.col("node.len") == F.col("len")
    rows = rows.withColumn("_c", symbol).withColumn("_lo", F.when(ends & (F.col("_c") != ""), F.col("node.lo"))).withColumn("_len", F.col("len"))
    own = children.select(F.col("lo").alias("_lo"), F.col("len").alias("_len"), F.explode("kids").alias("k")).where("k.sym <> '' and k.node is not null")
    rows = rows.join(own.select("_lo", "_len", F.col("k.sym").alias("_c"), F.col("k.node").alias("child")), ["_lo", "_len", "_c"], "left")
    # where there is none, the next greater symbol's; a document that ends here sorts before all; a leaf has no children
    side = children.select(F.col("lo").alias("_lo"), F.col("len").alias("_len"), F.transform("kids", lambda k: F.struct(k["sym"].alias("sym"), k["first"].alias("first"))).alias("kids"))
    rows = rows.withColumn("_lo", F.when(F.col("child").isNull(), F.col("_lo"))).join(side, ["_lo", "_len"], "left")
    above = F.array_min(F.transform(F.filter("kids", lambda k: k["sym"] > F.col("_c")), lambda k: k["first"]))
    return rows.withColumn("next", F.when(ends & (F.col("_c") == ""), F.col("node.lo")).otherwise(above)).drop("kids", "_lo", "_len")


def _told(rows: DataFrame, sa: DataFrame) -> DataFrame:
    """(doc_id, idx, pos, len, smaller) of rows with the end of their match: inside an edge of ``node`` (``ahead``, its next symbol), or at ``node`` with ``next``."""
    inside = F.col("ahead").isNotNull()
    after = F.when(inside, (F.col("_c") == "") | (F.col("_c") < F.col("ahead"))).otherwise(F.col("next").isNotNull())
    rank = F.when(inside, F.when(after, F.col("node.lo")).otherwise(F.col("node.hi"))).otherwise(F.coalesce("next", "node.hi"))
    rows = rows.select("doc_id", "idx", rank.alias("rank"), "len", after.alias("smaller"))
    return rows.join(sa, "rank").select("doc_id", "idx", "pos", "len", "smaller")


def extended(rows: DataFrame, sides: list[tuple[DataFrame, str | None, str]]) -> DataFrame:
    """``rows`` (..., known, most) with ``reach``: how many symbols agree from both places on, ``known`` at least, ``most`` at most.

    ``sides`` are the two (hash table, column of its document or None, column of the place).
    """
    longest = rows.agg(F.max(F.col("most") - F.col("known"))).first()[0] or 0
    rows = rows.withColumn("reach", F.col("known"))
    for k in reversed(range(int(longest).bit_length())):
        until = F.col("reach") + (1 << k)
        at = rows
        for name, (table, doc, start) in zip(("_t", "_r"), sides):
            at = at_place(at, table, F.col(start) + F.col("reach"), name + "0", doc)
            at = at_place(at, table, F.col(start) + until, name + "1", doc)
        same = (until <= F.col("most")) & (piece_hash("_t0", "_t1") == piece_hash("_r0", "_r1"))
        reach = F.when(F.coalesce(same, F.lit(False)), until).otherwise(F.col("reach"))
        rows = at.withColumn("reach", reach).select(*rows.columns)
        if k % ROUNDS == 0:
            rows = stored(rows, "extended")
    return rows


def _along_diagonals(rows: DataFrame, texts: DataFrame, own: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (doc_id, idx, left, pos, most, ...) with ``len``: how far they match, ``most`` at most; all match by CHUNK symbols.

    Neighbouring positions on one diagonal end at the same place, so of each
    run of them the last is extended. The second table has the runs:
    (doc_id, idx, pos, reach) from their first position on.
    """
    line = Window.partitionBy("doc_id", "_d").orderBy("idx")
    back = Window.partitionBy("doc_id", "_d").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_d", F.col("pos") - F.col("idx"))
    rows = rows.withColumn("_e", F.when(F.coalesce(F.lead("idx").over(line), F.lit(-1)) != F.col("idx") + 1, F.col("idx")))
    rows = stored(rows.withColumn("_e", F.last("_e", ignorenulls=True).over(back)), "diagonals")
    runs = rows.groupBy("doc_id", "_d", F.col("_e").alias("idx")).agg(F.min("idx").alias("_first"), F.min("left").alias("left")).withColumn("pos", F.col("_d") + F.col("idx"))
    runs = runs.select("doc_id", "_d", "idx", "_first", "pos", F.lit(CHUNK).cast("long").alias("known"), F.least("left", F.lit(n) - F.col("pos")).alias("most"))
    reached = extended(runs, [(texts, "doc_id", "idx"), (own, None, "pos")])
    stop = F.col("idx") + F.col("reach")
    out = rows.join(reached.select("doc_id", "_d", F.col("idx").alias("_e"), stop.alias("_stop")), ["doc_id", "_d", "_e"])
    whole = reached.select("doc_id", F.col("_first").alias("idx"), (F.col("_d") + F.col("_first")).alias("pos"), (stop - F.col("_first")).alias("reach"))
    return out.withColumn("len", F.least("most", F.col("_stop") - F.col("idx"))).drop("_d", "_e", "_stop"), whole


def false_pieces(runs: DataFrame, text: DataFrame, other: DataFrame, key: list[str]) -> int:
    """How many of the pieces of CHUNK symbols that ``runs`` (doc_id, idx, pos, reach) say agree don't.

    The pieces at pos are those of ``other`` (*key, pos, other).
    """
    starts = F.array_union(F.sequence(F.lit(0).cast("long"), F.col("reach") - CHUNK, F.lit(CHUNK).cast("long")), F.array(F.col("reach") - CHUNK))
    pieces = runs.select("doc_id", "idx", "pos", F.explode(starts).alias("k"))
    pieces = pieces.select("doc_id", (F.col("idx") + F.col("k")).alias("idx"), (F.col("pos") + F.col("k")).alias("pos")).distinct()
    return pieces.join(text.select("doc_id", "idx", "chunk"), ["doc_id", "idx"]).join(other, [*key, "pos"]).where("chunk <> other").count()


def with_lcp(sa: DataFrame, refs: DataFrame, counts: list | None = None) -> DataFrame:
    """(ref_id, rank, pos, lcp) of a suffix array (ref_id, rank, pos), for references of any length.

    The first suffix of each symbol shares nothing. Where a suffix and the one
    ranked before it share a symbol, and the suffixes one symbol on are
    neighbours too, those share one symbol less: such positions form runs on
    a diagonal, which end together. Only the last position of
    each run (as many as there are irreducible LCP values) is compared: CHUNK
    symbols, then hashed pieces, confirmed on text. ``counts`` collects how
    many were compared, and how many beyond CHUNK.
    """
    before = sa.select("ref_id", (F.col("rank") + 1).alias("rank"), F.col("pos").alias("_p"))
    rows = sa.join(before, ["ref_id", "rank"], "left").withColumn("_d", F.col("_p") - F.col("pos"))
    line = Window.partitionBy("ref_id", "_d").orderBy("pos")
    back = Window.partitionBy("ref_id", "_d").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    counts_of = positions(refs.select(F.col("ref_id").alias("doc_id"), "text")).groupBy(F.col("doc_id").alias("ref_id"), "sym").count()
    smaller_ones = F.sum("count").over(Window.partitionBy("ref_id").orderBy("sym").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts_of.select("ref_id", F.coalesce(smaller_ones, F.lit(0)).alias("rank"), F.lit(True).alias("_first"))
    rows = stored(rows.join(starts, ["ref_id", "rank"], "left"), "neighbours")
    first = rows.where("_first").select("ref_id", "rank", "pos", F.lit(0).cast("long").alias("lcp"))
    rows = rows.where("_first is null").withColumn("_e", F.when(F.coalesce(F.lead("pos").over(line), F.lit(-1)) != F.col("pos") + 1, F.col("pos")))
    rows = stored(rows.select("ref_id", "rank", "pos", "_d", F.last("_e", ignorenulls=True).over(back).alias("_e")), "lcp-runs")
    text = stored(chunks(refs, "ref_id"), "chunks")
    other = text.select("doc_id", F.col("idx").alias("pos"), F.col("chunk").alias("other"), F.col("left").alias("_l"))
    ends = rows.where("_e = pos").select(F.col("ref_id").alias("doc_id"), F.col("pos").alias("idx"), (F.col("pos") + F.col("_d")).alias("pos"), "_d")
    ends = ends.join(text, ["doc_id", "idx"]).join(other, ["doc_id", "pos"])
    ends = agreement(ends.withColumn("most", F.least("left", "_l")), "chunk", "other", "known").select("doc_id", "idx", "pos", "_d", "most", "known")
    ends = stored(ends, "lcp-ends")
    near, far = ends.where(f"known < {CHUNK} or most = known").withColumn("reach", F.col("known")), ends.where(f"known = {CHUNK} and most > known")
    base = 1_000_003
    if counts is not None:
        counts.extend([ends.count(), far.count()])
    while not far.isEmpty():
        table = stored(hash_table(refs.join(far.select(F.col("doc_id").alias("ref_id")).distinct(), "ref_id", "left_semi"), base, "ref_id"), "hashes")
        reached = extended(far, [(table, "doc_id", "idx"), (table, "doc_id", "pos")])
        if not false_pieces(reached, text, other.drop("_l"), ["doc_id"]):
            near = near.unionByName(reached)
            break
        base += 2
    stops = near.select(F.col("doc_id").alias("ref_id"), "_d", F.col("idx").alias("_e"), (F.col("idx") + F.col("reach")).alias("_stop"))
    return rows.join(stops, ["ref_id", "_d", "_e"]).select("ref_id", "rank", "pos", (F.col("_stop") - F.col("pos")).alias("lcp")).union(first)


_NODE = ("lo", "hi", "len", "pos", "chunk")


def _unlike(handles: DataFrame) -> bool:
    """Whether all handles have a hash of their own."""
    return handles.groupBy("f", "key").count().where("count > 1").isEmpty()


def _short_matches(text: DataFrame, nodes: DataFrame, children: DataFrame, n: int) -> DataFrame:
    """Where matches end of which CHUNK symbols tell it; ``_far`` rows go on."""
    root = F.struct(*[F.lit(v).cast(t).alias(c) for c, v, t in zip(_NODE, (0, n - 1, 0, 0, ""), ("long", "long", "long", "long", "string"))])
    seed = 42
    while True:
        hashed = lambda c: F.xxhash64(F.left(c, F.col("f").cast("int")), F.lit(seed))  # noqa: B023, E731
        handles = stored(nodes.where(F.col("f") <= CHUNK).select("f", hashed("chunk").alias("key"), F.struct(*_NODE).alias("n")), "handles")
        rows = text.select("doc_id", "idx", "left", "chunk", root.alias("node"), F.lit(0).cast("long").alias("from"), F.lit(0).cast("long").alias("a"), F.length("chunk").cast("long").alias("b"))
        for _ in range(CHUNK.bit_length()):
            rows = _searched(rows, handles, lambda r: r.withColumn("key", F.when(F.col("f").isNotNull(), hashed("chunk"))))  # noqa: B023
        symbol = lambda c: F.substring(c, (F.col("len") + 1).cast("int"), F.lit(1))
        rows = agreement(rows.withColumn("_n", F.col("node.chunk")), "chunk", "_n", "len").withColumn("len", F.least("node.len", "len")).drop("_n")
        rows = _child(rows, children, symbol("chunk"))
        known = F.when(F.col("child").isNull(), F.greatest("node.len", F.lit(CHUNK))).otherwise(CHUNK)
        rows = agreement(rows.withColumn("a", known.cast("long")).withColumn("_n", F.col("child.chunk")), "chunk", "_n", "_l").withColumn("len", F.when(F.col("child").isNotNull(), F.col("_l")).otherwise(F.col("len")))
        rows = rows.withColumn("node", F.coalesce("child", "node")).withColumn("_c", symbol("chunk")).withColumn("ahead", F.when(F.col("len") < F.col("node.len"), symbol("node.chunk")))
        # a handle is a hash; where the symbols differ after all, two collided
        rows = rows.withColumn("_bad", F.col("from") > F.col("len")).withColumn("_far", (F.col("len") == CHUNK) & (F.col("left") > CHUNK))
        rows = stored(rows.select("doc_id", "idx", "left", "node", "len", "a", "next", "ahead", "_c", "_bad", "_far"), "short-matches")
        if _unlike(handles) and rows.where("_bad").isEmpty():
            return rows
        seed += 1


def _far_matches(rows: DataFrame, collection: DataFrame, reference: DataFrame, nodes: DataFrame, children: DataFrame, n: int) -> DataFrame:
    """Where matches of more than CHUNK symbols end."""
    hashed = collection.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    text, own_text = chunks(hashed), stored(chunks(reference, "ref_id"), "reference-chunks")
    after = text.select("doc_id", F.col("idx").alias("_i"), F.left("chunk", F.lit(1)).alias("_s"))
    symbol = lambda r: r.withColumn("_i", F.col("idx") + F.col("len")).join(after, ["doc_id", "_i"], "left").withColumn("_c", F.coalesce("_s", F.lit(""))).drop("_i", "_s")
    placed = lambda r, node: r.select("doc_id", "idx", "left", node.alias("node"), node["pos"].alias("pos"), F.least(node["len"], F.col("left")).alias("most"))
    base = 1_000_003
    while True:
        texts, own = stored(hash_table(hashed, base), "hashes"), stored(hash_table(reference, base, "ref_id"), "hashes")
        handles = at_place(nodes.where(F.col("f") > CHUNK), own, F.col("pos"), "_p", None)
        handles = at_place(handles, own, F.col("pos") + F.col("f"), "_q", None)
        handles = stored(handles.select("f", piece_hash("_p", "_q").alias("key"), F.struct(*_NODE).alias("n")), "handles")

        def key(r: DataFrame) -> DataFrame:
            return at_place(r, texts, F.col("idx") + F.col("f"), "_q").withColumn("key", piece_hash("_p", "_q")).drop("_q")  # noqa: B023

        state = rows.select("doc_id", "idx", "left", "node", F.lit(CHUNK).cast("long").alias("from"), "a", F.col("left").alias("b"))
        state = stored(at_place(state, texts, F.col("idx"), "_p"), "far")
        while not state.where("a < b").isEmpty():
            state = stored(_searched(state, handles, key).select(*state.columns), "far")
        first, runs = _along_diagonals(placed(state, F.col("node")), texts, own, n)
        first = stored(_child(symbol(first), children, F.col("_c")), "far")
        down, more = _along_diagonals(placed(first.where("child is not null"), F.col("child")), texts, own, n)
        last = first.where("child is null").drop("child").unionByName(symbol(down).withColumn("next", F.lit(None).cast("long")))
        ahead = own_text.select(F.col("idx").alias("_at"), F.left("chunk", F.lit(1)).alias("ahead"))
        last = last.withColumn("_at", F.when(F.col("len") < F.col("node.len"), F.col("node.pos") + F.col("len"))).join(ahead, "_at", "left")
        if _unlike(handles) and not false_pieces(runs.union(more), text, own_text.select(F.col("idx").alias("pos"), F.col("chunk").alias("other")), []):
            return last
        base += 2


def hashed_matching_statistics(collection: DataFrame, reference: DataFrame, index: DataFrame, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(doc_id, idx, pos, len, smaller) of every symbol of ``collection`` against the one ``reference``, of which ``index`` is (ref_id, rank, pos, lcp).

    ``known`` is the reference's :func:`tree`, where it was made before.
    """
    n = reference.select(F.length("text")).first()[0] or 0  # one reference
    text, sa = chunks(collection), index.select("rank", "pos")
    if not n:
        return text.select("doc_id", "idx", F.lit(None).cast("long").alias("pos"), F.lit(0).cast("long").alias("len"), F.lit(False).alias("smaller"))
    nodes, children = known or tree(index, reference, n)
    rows = _short_matches(text, nodes, children, n)
    near, far = _told(rows.where("not _far"), sa), rows.where("_far")
    if far.isEmpty():
        return near
    return near.unionByName(_told(_far_matches(far, collection, reference, nodes, children, n), sa))
