"""Suffix order by matches: places are sorted by the matches that follow one another from there, never by text.

A place's way goes over its match to the place after it, and so on to the
document's end. A match's code rises with its rank among the reference's
suffixes, the side it lies on and what it shares, so suffixes sort as the codes
along their ways do. A document's codes are told once, and nothing reads its
text after that. Marks are told from codes, the same wherever a way has them,
and only the rarest are ranked by doubling, as those of :mod:`anchored`.
The reference must hold every symbol, so that every match moves on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import anchored
from .backward import begins, indexed
from .gsa import star_places
from .hashmatch import dealt
from .symbols import Texts, of_texts

#: Matches whose codes' hash marks a place, and how many places of a way have one mark of each level.
WIDTH, GAPS = 2, (8, 64)


def bytes_of(code: np.ndarray, width: int) -> np.ndarray:
    """The last ``width`` bytes of each code, the highest first."""
    return np.ascontiguousarray(code.astype(">i8").view(np.uint8).reshape(-1, 8)[:, 8 - width :])


def strings(code: np.ndarray, width: int, count: np.ndarray) -> pa.Array:
    """Byte strings of ``count`` codes each."""
    ends = (np.append(0, np.cumsum(count)) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(ends), pa.py_buffer(bytes_of(code, width))])


class Keys:
    """The codes of ``count`` places from ``at`` on along ways, each batch made when it is asked for."""

    def __init__(self, code: np.ndarray, width: int, jump: np.ndarray, at: np.ndarray, count: np.ndarray):
        self.code, self.width, self.jump, self.at, self.count = code, width, jump, at, count

    def slice(self, start: int, n: int) -> pa.Array:
        now, count = self.at[start : start + n], self.count[start : start + n]
        out, to = np.empty(count.sum(), np.int64), np.cumsum(count) - count
        left = count
        while len(now):
            out[to] = self.code[now]
            live = np.flatnonzero(left > 1)
            now, to, left = self.jump[now[live]], to[live] + 1, left[live] - 1
        return strings(out, self.width, count)


class Coded:
    """As :class:`Texts`, documents told by the codes of their matches: ``code`` is 0 where a document ends."""

    def __init__(self, ids: pa.Array, texts: list[bytes], width: int):
        self.ids, self.width, inner = ids, width, np.array([len(t) // width for t in texts])
        sizes = inner + 1
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        self.start = np.cumsum(sizes) - sizes
        self.idx = np.arange(len(self.doc)) - self.start[self.doc]
        self.end = (self.start + inner)[self.doc]
        raw = np.zeros((len(self.doc) - len(texts), 8), np.uint8)
        raw[:, 8 - width :] = np.frombuffer(b"".join(texts), np.uint8).reshape(-1, width)
        self.code = np.zeros(len(self.doc), np.int64)
        self.code[self.idx < inner[self.doc]] = raw.view(">i8")[:, 0]


class Ways(anchored.Marks):
    """Marked places of documents put together, by the codes of their matches against a reference of ``n`` symbols."""

    def __init__(self, t: Coded, n: int):
        self.texts, self.levels, self.end, self.code, self.n = t, len(GAPS), t.end, t.code, n
        inner, key = t.code > 0, np.maximum(t.code - 1, 0)
        shared = key % (n + 1)
        self.slot = key // (n + 1)
        length = np.where(self.slot & 1, n - shared, shared)
        self.slot >>= 1
        self.jump = np.arange(len(key)) + np.where(inner, length, 0)
        h = np.zeros(len(key), np.uint64)
        at, whole = np.arange(len(key)), np.ones(len(key), bool)
        for _ in range(WIDTH):
            h = h * np.uint64(0x9E3779B97F4A7C15) + self.code[at].astype(np.uint64)
            whole &= inner[at]
            at = self.jump[at]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        self.whole, self.marked = whole, [whole & (h % np.uint64(gap) == 0) for gap in GAPS]

    def ahead(self, at: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The place of its way that is ranked after each key (-1: the text ends before), and how many codes the key has."""
        to, count = np.full(len(at), -1), np.zeros(len(at), np.int64)
        live, now, k, most = np.arange(len(at)), at, 0, anchored.FAR * GAPS[level]
        while len(live):
            now, k = self.jump[now], k + 1
            ends = self.code[now] == 0
            hit = self.marked[level][now] | self.whole[now] if k == most else self.marked[level][now]
            to[live[hit]] = now[hit]
            count[live[hit]] = k + WIDTH
            count[live[ends]] = k
            open_ = ~(hit | ends)
            live, now = live[open_], now[open_]
            if k >= most and len(live):  # fewer than WIDTH codes are left
                to_end = now
                while len(live):
                    to_end, k = self.jump[to_end], k + 1
                    ends = self.code[to_end] == 0
                    count[live[ends]] = k
                    live, to_end = live[~ends], to_end[~ends]
        return to, count

    def keys(self, at: np.ndarray, stop: np.ndarray) -> Keys:
        return Keys(self.code, self.texts.width, self.jump, at, stop)


def width(n: int) -> int:
    """Bytes of a code of a match against ``n`` symbols."""
    return (2 * n * (n + 1) + 1).bit_length() + 7 >> 3


def coded(collection: DataFrame, reference: DataFrame, index: DataFrame, by_heads: bool) -> DataFrame:
    """(doc_id, text): the codes of the matches of all places of each document; with ``by_heads``, of the matches that its heads tell."""
    index_of, ranks = indexed(index, reference), []

    def told(t: Texts) -> tuple[np.ndarray, dict]:
        n = index_of().n
        if not ranks:
            ranks.append(np.argsort(index_of().pos))
        pos, length, smaller = index_of().matched(t)
        if by_heads:
            head = np.maximum.accumulate(np.where(begins(t, pos, length), np.arange(len(pos)), 0))
            inside = np.arange(len(pos)) - head
            pos, length, smaller = pos[head] + inside, length[head] - inside, smaller[head]
        at = np.flatnonzero(t.code)
        code = ((ranks[0][pos] * 2 + ~smaller) * (n + 1) + np.where(smaller, length, n - length) + 1)[at]
        return np.arange(len(t.texts)), {"text": strings(code, width(n), np.array([len(x) for x in t.texts]))}

    return of_texts(dealt(collection, "doc_id"), told, "text binary")


class Marked:
    """How tasks put coded documents together, tell their marks, and which places are asked for."""

    def __init__(self, reference: DataFrame, index: DataFrame):
        n = index.count()
        self.put, self.marked = lambda ids, texts: Coded(ids, texts, width(n)), lambda t: Ways(t, n)
        pos = [r.pos for r in index.orderBy("rank").select("pos").collect()]  # at most FEW_SYMBOLS
        sent = index.sparkSession.sparkContext.broadcast(np.array(pos, np.int64))
        self.heads = lambda w: begins(w.texts, sent.value[w.slot], w.jump)
        self.stars = lambda w: star_places(w.texts)


def mark_ranks(codes: DataFrame, by: Marked) -> DataFrame:
    """(doc_id, at, r): the marked places that the ways of all places come to, ranked by their ways from there on."""
    return anchored.mark_ranks(codes, by.marked, GAPS, by.put)


def ordered(codes: DataFrame, ranks: DataFrame, by: Marked, asked: str | None = None) -> DataFrame:
    """(doc_id, idx, _id): all places, or the ``heads`` or ``stars``, in suffix order, ``_id`` rising with it."""
    return anchored.ordered(codes, ranks, by.marked, getattr(by, asked) if asked else None, by.put)
