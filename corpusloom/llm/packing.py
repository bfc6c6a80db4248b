"""Best-fit packing improved by swap-based local search, on counted lengths.

Pieces of equal length are interchangeable, so packing is solved on counts:
the corpus reaches the driver as at most ``capacity`` (length, count) rows.
Bins of equal content form one group with a multiplicity. Best-fit-decreasing
gives the first packing; local search then moves one piece, exchanges one for
one, or two for one, between underfull bins of two groups, always raising the
sum of squared fills, on as many bins as both groups have at once, until the
emptiest bins are empty, the lower bound is met or nothing improves.

The plan is a table of runs (length, first rank, bins, pieces per bin, first
sequence, offset). Best fit makes at most four groups a length and each move
at most two more, on as many bins at once as both groups have, so the table
follows the number of different lengths, at most ``capacity``, not the corpus. Every piece finds its place from its rank among the pieces of
its length; ranks are counted in salted shares, so a length that a third of
all pieces have is no hot spot.

Defined cases: a null or empty text is one piece holding only the end id;
repeated rows and rows with null ids are packed like any others; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import read_table, stored
from .tokens import encoder

CAPACITY = 2048


def pieces_of(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than ``capacity``."""
    if total <= capacity:
        return [(0, total)]
    first = total % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, total, capacity)]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"]):
                ids = encode.ended(text)
                for k, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                    rows.append((key, k, start, length, zlib.crc32(ids[start : start + length])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.assign(doc_id=out["doc_id"].astype(batch["doc_id"].dtype)) if len(out) else out

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Groups of equal bins: content (a sorted tuple of (length, pieces)) and how many bins have it."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.groups: Counter = Counter()

    @staticmethod
    def fill(content: tuple) -> int:
        return sum(length * n for length, n in content)

    def count(self) -> int:
        return sum(self.groups.values())

    @staticmethod
    def changed(content: tuple, out: tuple, into: tuple) -> tuple:
        c = Counter(dict(content))
        for length in out:
            c[length] -= 1
        for length in into:
            c[length] += 1
        return tuple(sorted((x for x in c.items() if x[1]), reverse=True))


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Bins:
    """Best fit, longest first: each piece goes to the fullest bin that still holds it."""
    open_by_room: dict[int, Counter] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in open_by_room if r >= length):
            if not left:
                break
            group, most = open_by_room.pop(room), room // length
            for content in list(group):
                bins = group.pop(content)
                full = min(bins, left // most)
                part = left - full * most if full < bins else 0
                for n, times in ((most, full), (part, 1 if part else 0)):
                    if times:
                        open_by_room.setdefault(room - n * length, Counter())[content + ((length, n),)] += times
                left -= full * most + part
                if rest := bins - full - bool(part):
                    group[content] = rest
                if not left:
                    break
            if group:
                open_by_room.setdefault(room, Counter()).update(group)
        most = capacity // length
        for n, times in ((most, left // most), (left % most, 1)):
            if n and times:
                open_by_room.setdefault(capacity - n * length, Counter())[((length, n),)] += times
    bins = Bins(capacity)
    for group in open_by_room.values():
        bins.groups.update(group)
    return bins


def _best_pair(source: tuple, limit: int) -> tuple | None:
    """The two pieces of ``source`` (longest first) with the largest sum up to ``limit``, by two pointers."""
    best, i, j = None, 0, len(source) - 1
    while i < j or i == j and source[i][1] > 1:
        a, b = source[i][0], source[j][0]
        if a + b > limit:
            i += 1
            continue
        if best is None or a + b > sum(best):
            best = (a, b)
        j -= 1
    return best


def _step(source: tuple, target: tuple, room: int) -> tuple[int, tuple, tuple] | None:
    """The exchange that fills ``target`` most: (gain, pieces it gets, pieces it gives)."""
    best = None
    for out in [()] + [(length,) for length, _ in target]:
        limit = room + sum(out)
        one = next(((length,) for length, _ in source if length <= limit), None)
        for into in (one, _best_pair(source, limit) if out else None):
            if into is None:
                continue
            gain = sum(into) - sum(out)
            if 0 < gain <= room and (best is None or (gain, -len(into)) > (best[0], -len(best[1]))):
                best = (gain, into, out)
    return best


class Open:
    """Groups of underfull bins, found by a length they hold (0: any) and the room they have."""

    def __init__(self):
        self.holders: dict[tuple[int, int], dict] = {}
        self.rooms: dict[int, list[int]] = {}
        self.lengths: list[int] = []

    def add(self, content: tuple, room: int) -> None:
        for length in (0, *(x for x, _ in content)):
            if (length, room) not in self.holders:
                self.holders[length, room] = {}
                if length not in self.rooms:
                    self.rooms[length] = []
                    insort(self.lengths, length)
                insort(self.rooms[length], room)
            self.holders[length, room][content] = None

    def drop(self, content: tuple, room: int) -> None:
        for length in (0, *(x for x, _ in content)):
            held = self.holders[length, room]
            del held[content]
            if not held:
                del self.holders[length, room]
                self.rooms[length].remove(room)
                if not self.rooms[length]:
                    del self.rooms[length]
                    self.lengths.remove(length)

    def best(self, source: tuple, most: int, single: bool) -> tuple | None:
        """(target, (gain, pieces it gets, pieces it gives)) of the exchange that leaves a target least room.

        Targets have at most ``most`` room; ``single`` says that the source is
        one bin, which can't be its own target.
        """
        sums = {}
        for i, (x, n) in enumerate(source):
            for y, _ in source[i if n > 1 else i + 1 :]:
                sums[x + y] = (x, y)
        sums |= {x: (x,) for x, _ in source}
        found = None
        for total, into in sums.items():
            for at in range(bisect_left(self.lengths, total - most), bisect_left(self.lengths, total)):
                out = self.lengths[at]
                if not out and len(into) > 1:
                    continue
                rooms = self.rooms[out]
                k = bisect_left(rooms, total - out)
                if k == len(rooms) or rooms[k] > most:
                    continue
                key = rooms[k] - total + out, len(into), out > 0
                if found is None or key < found[0]:
                    target = next((c for c in self.holders[out, rooms[k]] if c != source or not single), None)
                    if target is not None:
                        found = key, target, (total - out, into, (out,) if out else ())
        return found and found[1:]


def local_search(bins: Bins, total: int) -> Bins:
    """Exchanges between underfull bins until their number meets the lower bound or no exchange improves.

    Every exchange moves pieces to a bin that is at least as full, which raises
    the sum of squared fills, so the search ends. Bins are emptied from the
    emptiest on, in rounds until a round changes nothing; a group that found no
    partner looks again only at groups that came later.
    """
    bound, capacity, groups = -(-total // bins.capacity), bins.capacity, bins.groups
    open_, born, tried, count = Open(), [], {}, bins.count()
    room = lambda c: capacity - bins.fill(c)
    for content in sorted(groups):
        if room(content):
            open_.add(content, room(content))

    def exchange(source: tuple, target: tuple, into: tuple, out: tuple) -> tuple:
        """Makes the exchange on as many bins as both groups have; what is left of a source bin."""
        nonlocal count
        times = groups[source] // 2 if target == source else min(groups[source], groups[target])
        for content in (source, target):
            groups[content] -= times
            if not groups[content]:
                del groups[content]
                open_.drop(content, room(content))
        rest = bins.changed(source, into, out)
        for content in (rest, bins.changed(target, out, into)):
            if not content:
                count -= times
                continue
            if content not in groups and room(content):
                open_.add(content, room(content))
                born.append(content)
            groups[content] += times
        return rest

    changed = True
    while changed and count > bound:
        changed = False
        for source in sorted((c for c in groups if room(c)), key=lambda c: (bins.fill(c), c)):
            while source in groups and count > bound:
                move, single = None, groups[source] < 2
                later = born[tried[source] :] if source in tried else None
                if later is None or len(later) > 64:
                    move = open_.best(source, room(source), single)
                else:
                    for target in dict.fromkeys(later):
                        if target in groups and (target != source or not single) and room(target) <= room(source) and (step := _step(source, target, room(target))):
                            move = target, step
                            break
                if move is None:
                    tried[source] = len(born)
                    break
                rest, changed = exchange(source, move[0], *move[1][1:]), True
                if source not in groups and rest:
                    source = rest
    return bins


def runs(bins: Bins) -> np.ndarray:
    """The plan: rows (length, first rank, bins, pieces a bin, first sequence, offset), by length and rank."""
    rank: Counter = Counter()
    rows, sequence = [], 0
    for content in sorted(bins.groups):
        times, offset = bins.groups[content], 0
        for length, n in content:
            rows.append((length, rank[length], times, n, sequence, offset))
            rank[length] += times * n
            offset += length * n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def ranked(pieces: DataFrame, rows_per_share: int = 1_000) -> DataFrame:
    """Adds ``_rank``: 0, 1, ... among the pieces of a length, in an order fixed by their content."""
    total = pieces.count()
    shares = max(1, min(1 << 12, total // rows_per_share))
    salted = pieces.withColumn("_share", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(shares)).cast("int"))
    per = salted.groupBy("length", "_share").count()
    before = per.select("length", "_share", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_share").orderBy("doc_id", "piece", "start", "ids_crc32"))
    return salted.withColumn("_in", within).join(before, ["length", "_share"]).withColumn("_rank", F.col("_before") + F.col("_in") - 1).drop("_in", "_before", "_share")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (stored) with ``sequence_id`` and ``offset``."""
    counts = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    bins = local_search(best_fit_decreasing(counts, capacity), sum(k * n for k, n in counts.items()))
    plan = runs(bins)
    # (length, first rank) as one number: ranks stay below 2^50
    starts = plan[:, 0] * (1 << 50) + plan[:, 1] if len(plan) else np.empty(0, np.int64)
    names = pieces.columns

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(np.int64), batch["_rank"].to_numpy(np.int64)
            run = plan[np.searchsorted(starts, length * (1 << 50) + rank, "right") - 1]
            at = rank - run[:, 1]
            yield batch[names].assign(sequence_id=run[:, 4] + at // run[:, 3], offset=run[:, 5] + at % run[:, 3] * length)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked(pieces).mapInPandas(place, schema + ", sequence_id long, offset long")


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packing_stage(spark, read_table(spark, sf_dir, "documents"), sf_dir)


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: every piece of every document with its place in a sequence."""
    return pack(stored(token_pieces(docs), "packing-pieces"))
