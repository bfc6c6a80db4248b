"""Backward matching statistics: documents are read right to left over the index of one reference.

The interval of reference suffixes that begin with the match is kept, extended
to the left by the occurrence counts of the BWT, or widened to its parent
interval where the symbol doesn't extend it; what a symbol makes of an interval
is remembered, since a reference has no more intervals than twice its symbols. Documents are independent, so a
task reads whole documents with the reference's index in memory: the index
travels to every worker, so references are limited to MOST_SYMBOLS; longer ones
are refused, and ``matching_statistics_by_ranks`` takes them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashmatch import dealt
from .refindex import psv_nsv
from .symbols import Texts, next_place, of_texts

MOST_SYMBOLS = 4_000_000
#: References whose matching statistics are told here; longer ones go by hashes. Steps that a task remembers.
FEW_SYMBOLS, MOST_KNOWN = 1 << 20, 1 << 20


class Index:
    """The reference's BWT, counts and LCP neighbours as arrays."""

    def __init__(self, text: str, pos: np.ndarray, lcp: np.ndarray, psv: np.ndarray, nsv: np.ndarray):
        self.n, self.lcp, self.psv, self.nsv = len(text), lcp.tolist() + [0], psv.tolist(), nsv.tolist()
        before = [text[p - 1] if p else "" for p in pos.tolist()]
        #: Ranks at which each symbol is the one before the suffix, and how many symbols of the text are smaller.
        self.sorted, self.ranks = sorted(set(text)), {c: [] for c in sorted(set(text))}
        for rank, sym in enumerate(before):
            if sym:
                self.ranks[sym].append(rank)
        self.size = {c: text.count(c) for c in self.ranks}
        self.start = dict(zip(self.ranks, np.cumsum([0, *self.size.values()]).tolist()))
        self.pos, self.known, self.neighbours, self.minima, self.ranked = pos.tolist(), {}, {}, [], None
        #: The text's last symbol alone is the first suffix of its symbol, and follows no other one.
        self.shift = {c: int(c == text[-1]) for c in self.ranks}

    def parent(self, lo: int, hi: int) -> tuple[int, int, int]:
        """(length, lo, hi) of the smallest interval that properly holds [lo, hi]."""
        left, right = self.lcp[lo] if lo else -1, self.lcp[hi + 1] if hi + 1 < self.n else -1
        length = max(left, right, 0)
        at = lo if left >= right else hi + 1
        if length == 0:
            return 0, 0, self.n - 1
        return length, max(0, self.psv[at]), self.nsv[at] - 1 if self.nsv[at] >= 0 else self.n - 1

    def extended(self, sym: str, lo: int, hi: int) -> tuple[int, int, int]:
        """(lo, hi, length) of the longest match that ``sym`` before the interval's string leaves; ``length`` is -1 where it is one more than the string's."""
        if sym not in self.ranks:
            return 0, self.n - 1, 0
        length, at, ranks = -1, self.start[sym] + self.shift[sym], self.ranks[sym]
        while length:
            a, b = bisect_left(ranks, lo), bisect_left(ranks, hi + 1)
            if a < b:
                return at + a, at + b - 1, length + 1 if length > 0 else -1
            length, lo, hi = self.parent(lo, hi)
        return self.start[sym], self.start[sym] + self.size[sym] - 1, 1

    def scan(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Match lengths and both ranks of every position, last first."""
        lo, hi, length, known = 0, self.n - 1, 0, self.known
        lengths, los, his = [], [], []
        for sym in reversed(text):
            # an empty match has no symbol to lose: its extension is one symbol
            key = sym, lo if length else -1, hi
            told = known.get(key)
            if told is None:
                if len(known) >= MOST_KNOWN:
                    known.clear()
                if length:
                    told = self.extended(sym, lo, hi)
                else:
                    told = (self.start[sym], self.start[sym] + self.size[sym] - 1, 1) if sym in self.ranks else (0, self.n - 1, 0)
                known[key] = told
            lo, hi, more = told
            length = length + 1 if more < 0 else more
            lengths.append(length)
            los.append(lo)
            his.append(hi)
        return lengths, los, his

    def least(self, a: int, b: int) -> int:
        """The least LCP value of ranks a to b."""
        k = (b - a + 1).bit_length() - 1
        return min(int(self.minima[k][a]), int(self.minima[k][b - (1 << k) + 1]))

    def placed(self, sym: str, rank: int) -> tuple[int, int, int]:
        """(rank, up, down) after ``sym`` is put before a string that ``rank`` suffixes are less than (-1: before the empty string).

        Its successor shares one symbol more than the string shares with the
        successor, at most ``up`` of them, and its predecessor likewise; -1
        where that neighbour begins with another symbol.
        """
        if sym not in self.ranks:
            at = bisect_left(self.sorted, sym)
            return (self.start[self.sorted[at]] if at < len(self.sorted) else self.n), -1, -1
        ranks, start, shift = self.ranks[sym], self.start[sym], self.shift[sym]
        if rank < 0:
            return start, 0, -1
        k = bisect_left(ranks, rank)
        up = down = -1
        if k < len(ranks):
            up = self.n if ranks[k] == rank else self.least(rank + 1, ranks[k])
        if k:
            down = self.n if ranks[k - 1] == rank - 1 else self.least(ranks[k - 1] + 1, rank - 1)
        elif shift:
            down = 0  # the last symbol alone
        return start + shift + k, up, down

    def matches(self, text: str) -> tuple[list[int], list[int], list[bool]]:
        """Matched places, lengths and whether the match sorts after, of every position, last first."""
        if not self.minima:
            table = np.array(self.lcp[: self.n], np.int32)
            while len(table):
                self.minima.append(table)
                step = 1 << (len(self.minima) - 1)
                table = np.minimum(table[:-step], table[step:])
        n, pos, known = self.n, self.pos, self.neighbours
        rank, after, before = -1, 0, 0
        places, lengths, smaller = [], [], []
        for sym in reversed(text):
            told = known.get((sym, rank))
            if told is None:
                if len(known) >= MOST_KNOWN:
                    known.clear()
                known[sym, rank] = told = self.placed(sym, rank)
            rank, up, down = told
            after = 1 + (after if after < up else up)
            before = 1 + (before if before < down else down)
            if after >= before and rank < n:
                places.append(pos[rank])
                lengths.append(after)
                smaller.append(True)
            else:
                places.append(pos[rank - 1])
                lengths.append(before)
                smaller.append(False)
        return places, lengths, smaller

    def isa(self) -> np.ndarray:
        """The rank of each place of the text."""
        if self.ranked is None:
            self.ranked = np.argsort(np.array(self.pos, np.int64))
        return self.ranked

    def matched(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matched places, lengths and whether the match sorts after, of every place of ``t``; an end matches the last symbol with length 0."""
        at, n = np.flatnonzero(t.code), len(t.code)
        pos, length, smaller = np.full(n, self.n - 1), np.zeros(n, np.int64), np.zeros(n, bool)
        found = [[], [], []]
        for body in t.texts:
            for out, values in zip(found, self.matches(body)):
                values.reverse()
                out.extend(values)
        pos[at], length[at], smaller[at] = found
        return pos, length, smaller


def begins(t: Texts, pos: np.ndarray, length: np.ndarray, after_empty: bool = False) -> np.ndarray:
    """Whether each place begins a head, by what :meth:`Index.matched` tells; ends do."""
    head = (t.code == 0) | (t.idx == 0) | (np.diff(pos, prepend=pos[0]) != 1)
    if after_empty:
        head[1:] |= length[:-1] == 0
    return head


def _sent(index: DataFrame, reference: DataFrame):
    """The reference's text and arrays for every worker."""
    text = reference.first()["text"]
    if len(text) > MOST_SYMBOLS:
        raise ValueError(f"the reference has {len(text)} symbols; backward matching takes {MOST_SYMBOLS}")
    rows = index.join(psv_nsv(index).select("ref_id", "rank", "psv", "nsv"), ["ref_id", "rank"]).select("rank", "pos", "lcp", F.coalesce("psv", F.lit(-1)).alias("psv"), F.coalesce("nsv", F.lit(-1)).alias("nsv"))
    table = rows.toPandas().sort_values("rank")  # at most MOST_SYMBOLS rows of five numbers
    arrays = [table[c].to_numpy(np.int64) for c in ("pos", "lcp", "psv", "nsv")]
    return index.sparkSession.sparkContext.broadcast((text, arrays))


def indexed(index: DataFrame, reference: DataFrame) -> Callable[[], Index]:
    """Gives a task the :class:`Index` of the reference, which must not be empty."""
    sent, last = _sent(index, reference), []

    def index_of() -> Index:
        if not last:
            text, arrays = sent.value
            last.append(Index(text, *arrays))
        return last[0]

    return index_of


def _of_places(collection: DataFrame, reference: DataFrame, index: DataFrame, scan: str, columns: dict) -> DataFrame:
    """(doc_id, idx, ``columns``) that the method ``scan`` of the reference's :class:`Index` tells of every position; ``columns`` are name to (Arrow type, value where there is no reference)."""
    sent = _sent(index, reference)

    def told(t: Texts) -> tuple[np.ndarray, dict]:
        text, arrays = sent.value
        at = np.flatnonzero(t.code)
        if not text:
            return t.doc[at], {"idx": t.idx[at], **{c: pa.array([v] * len(at), k) for c, (k, v) in columns.items()}}
        if last.get("text") != text:
            last.update(text=text, index=Index(text, *arrays))
        found = [[] for _ in columns]
        for body in t.texts:
            for out, values in zip(found, getattr(last["index"], scan)(body)):
                values.reverse()
                out.extend(values)
        return t.doc[at], {"idx": t.idx[at], **{c: pa.array(v, k) for (c, (k, _)), v in zip(columns.items(), found)}}

    last: dict = {}
    names = {pa.int64(): "long", pa.bool_(): "boolean"}
    return of_texts(dealt(collection, "doc_id"), told, ", ".join(["idx long", *[f"{c} {names[k]}" for c, (k, _) in columns.items()]]))


def matching(collection: DataFrame, reference: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, idx, pos, len, smaller): matching statistics, told right to left from the rank each suffix would have among the reference's."""
    return _of_places(collection, reference, index, "matches", {"pos": (pa.int64(), None), "len": (pa.int64(), 0), "smaller": (pa.bool_(), False)})


def of_matches(collection: DataFrame, reference: DataFrame, index: DataFrame, columns: Callable[..., tuple[np.ndarray, dict]], schema: str) -> DataFrame:
    """(doc_id, ``schema``): rows told from whole texts and their matches, where they lie; the reference must not be empty.

    ``columns`` gets the texts, the reference's :class:`Index` and what :meth:`Index.matched` tells, and returns what :func:`symbols.of_texts` asks for.
    """
    index_of = indexed(index, reference)

    def told(t: Texts) -> tuple[np.ndarray, dict]:
        return columns(t, index_of(), *index_of().matched(t))

    return of_texts(dealt(collection, "doc_id"), told, schema)


class Heads:
    """The heads of texts put together: their places ``at``, document ends among them, and of every place the number of its head, ``own``."""

    def __init__(self, t: Texts, pos: np.ndarray, length: np.ndarray, after_empty: bool = False):
        head = begins(t, pos, length, after_empty)
        self.at, self.own = np.flatnonzero(head), np.cumsum(head) - 1
        self.doc, self.start, self.is_end = t.doc[self.at], t.idx[self.at], t.code[self.at] == 0
        #: From 1 in each document.
        self.number = np.arange(len(self.at)) - np.searchsorted(self.doc, self.doc) + 1


def heads(collection: DataFrame, reference: DataFrame, index: DataFrame, after_empty: bool = False) -> DataFrame:
    """As :func:`matchstats.heads` of :func:`matching`, told from whole texts; the reference must not be empty."""

    def columns(t: Texts, _, pos: np.ndarray, length: np.ndarray, smaller: np.ndarray) -> tuple[np.ndarray, dict]:
        h = Heads(t, pos, length, after_empty)
        following = pa.array(np.append(h.start[1:], 0), pa.int64(), mask=h.is_end)
        return h.doc, {"head_id": h.number, "start": h.start, "next_start": following, "pos": pos[h.at], "len": length[h.at], "smaller": smaller[h.at], "is_end": h.is_end}

    schema = "head_id long, start long, next_start long, pos long, len long, smaller boolean, is_end boolean"
    return of_matches(collection, reference, index, columns, schema)


def head_of(collection: DataFrame, reference: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, idx, head_id, head_start): the head that holds each place."""

    def columns(t: Texts, _, pos: np.ndarray, length: np.ndarray, smaller: np.ndarray) -> tuple[np.ndarray, dict]:
        h, at = Heads(t, pos, length), np.flatnonzero(t.code)
        return t.doc[at], {"idx": t.idx[at], "head_id": h.number[h.own[at]], "head_start": h.start[h.own[at]]}

    return of_matches(collection, reference, index, columns, "idx long, head_id long, head_start long")


def pred_succ(collection: DataFrame, reference: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, q, pred, succ): for each place the last head's start up to it and the first one's from it on."""

    def columns(t: Texts, _, pos: np.ndarray, length: np.ndarray, smaller: np.ndarray) -> tuple[np.ndarray, dict]:
        h, at = Heads(t, pos, length), np.flatnonzero(t.code)
        own = h.own[at]
        return t.doc[at], {"q": t.idx[at], "pred": h.start[own], "succ": h.start[own + (h.at[own] < at)]}

    return of_matches(collection, reference, index, columns, "q long, pred long, succ long")


def from_heads(collection: DataFrame, reference: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, idx, pos, len): matches of all places, told from heads alone."""

    def columns(t: Texts, _, pos: np.ndarray, length: np.ndarray, smaller: np.ndarray) -> tuple[np.ndarray, dict]:
        h, at = Heads(t, pos, length, after_empty=True), np.flatnonzero(t.code)
        first = h.at[h.own[at]]
        return t.doc[at], {"idx": t.idx[at], "pos": pos[first] + at - first, "len": np.maximum(length[first] - (at - first), 0)}

    return of_matches(collection, reference, index, columns, "idx long, pos long, len long")


def with_runs(collection: DataFrame, reference: DataFrame, index: DataFrame, symbol: str) -> DataFrame:
    """(doc_id, idx, pos, len, smaller), as :func:`matchstats.with_runs` of :func:`matching`."""

    def columns(t: Texts, ref: Index, pos: np.ndarray, length: np.ndarray, smaller: np.ndarray) -> tuple[np.ndarray, dict]:
        at, hit = np.flatnonzero(t.code), t.code == ord(symbol) + 1
        run = next_place(~hit)[at] - at
        return t.doc[at], {"idx": t.idx[at], "pos": np.where(hit[at], ref.n, pos[at]), "len": np.where(hit[at], run, length[at]), "smaller": smaller[at] & ~hit[at]}

    return of_matches(collection, reference, index, columns, "idx long, pos long, len long, smaller boolean")


def with_mismatch(collection: DataFrame, reference: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, idx, pos, len, smaller, mismatch), as :func:`matchstats.with_mismatch` of :func:`matching`."""

    def columns(t: Texts, _, pos: np.ndarray, length: np.ndarray, smaller: np.ndarray) -> tuple[np.ndarray, dict]:
        at = np.flatnonzero(t.code)
        return t.doc[at], {"idx": t.idx[at], "pos": pos[at], "len": length[at], "smaller": smaller[at], "mismatch": t.symbols(at + length[at])}

    return of_matches(collection, reference, index, columns, "idx long, pos long, len long, smaller boolean, mismatch string")


def next_heads(collection: DataFrame, reference: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, head_id, next_head_id, offset, next_isa), as :func:`predecessor.next_heads` of :func:`heads`."""

    def columns(t: Texts, ref: Index, pos: np.ndarray, length: np.ndarray, smaller: np.ndarray) -> tuple[np.ndarray, dict]:
        h = Heads(t, pos, length)
        own = np.flatnonzero(~h.is_end)
        to = h.at[own] + length[h.at[own]]
        following = h.own[to]
        offset = to - h.at[following]
        return h.doc[own], {"head_id": h.number[own], "next_head_id": h.number[following], "offset": offset, "next_isa": ref.isa()[pos[h.at[following]] + offset]}

    return of_matches(collection, reference, index, columns, "head_id long, next_head_id long, offset long, next_isa long")


def ranks_met(collection: DataFrame, reference: DataFrame, index: DataFrame, asked: Callable[[Texts], np.ndarray] | None = None) -> DataFrame:
    """(isa_pos, n): how many places, or those ``asked`` tells, match each rank of the reference, for ranks that any does; counted in the tasks."""

    def columns(t: Texts, ref: Index, pos: np.ndarray, length: np.ndarray, smaller: np.ndarray) -> tuple[np.ndarray, dict]:
        at = t.code > 0 if asked is None else (t.code > 0) & asked(t)
        rank, n = np.unique(ref.isa()[pos[at]], return_counts=True)
        return np.zeros(len(rank), np.int64), {"isa_pos": rank, "n": n}

    return of_matches(collection, reference, index, columns, "isa_pos long, n long").groupBy("isa_pos").agg(F.sum("n").alias("n"))


def unambiguous(collection: DataFrame, reference: DataFrame, index: DataFrame) -> DataFrame:
    """(n_matched, n_unambiguous), as :func:`matchstats.unambiguous` of :func:`heads`; counted in the tasks."""

    def columns(t: Texts, ref: Index, pos: np.ndarray, length: np.ndarray, smaller: np.ndarray) -> tuple[np.ndarray, dict]:
        at = Heads(t, pos, length).at
        at = at[length[at] > 0]
        lcp, rank = np.array(ref.lcp), ref.isa()[pos[at]]
        once = length[at] > np.maximum(lcp[rank], lcp[rank + 1])
        return np.zeros(1, np.int64), {"n": np.array([len(at)]), "once": np.array([once.sum()])}

    rows = of_matches(collection, reference, index, columns, "n long, once long")
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_matched"), F.coalesce(F.sum("once"), F.lit(0)).alias("n_unambiguous"))


def backward_matching(collection: DataFrame, reference: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, idx, len, lo, hi): match lengths, and the ranks of the reference suffixes that begin with the match (all where nothing matches).

    ``index`` (ref_id, rank, pos, lcp) belongs to the one row of ``reference``.
    """
    return _of_places(collection, reference, index, "scan", {"len": (pa.int64(), 0), "lo": (pa.int64(), 0), "hi": (pa.int64(), -1)})
