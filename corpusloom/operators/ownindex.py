"""Index tables of many short references, each told from its own text.

A task sorts the suffixes of the texts it looks at together by prefix doubling
on arrays: the first keys hold several symbols and the text's number, so
suffixes of two texts never share a rank. What a text's own rows can answer is
answered there, and only texts are shuffled. Texts above MOST symbols are left to
the tables of :mod:`refindex` and :mod:`hashmatch`, which spread one text over many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashmatch import dealt
from .symbols import Texts, of_texts

MOST = 1 << 20
#: Prefixes of so many symbols are shared by few neighbours; rounds in which nearest smaller values are looked for together.
COMMON, ROUNDS = 8, 32


class Ranks:
    """Suffix order ``at`` of texts put together, text by text (ends, which come first, left out); ``levels`` tell equal prefixes: (symbols, ranks)."""

    def __init__(self, t: Texts):
        n, base = len(t.code), len(t.known)
        self.texts, self.levels = t, [(1, t.place)]
        k, key = 1, t.place
        while k < 16 and base ** (2 * k) * (len(t.texts) + 1) < 1 << 62:
            key = key * base**k + np.concatenate([key[k:], np.zeros(min(k, n), np.int64)])
            k *= 2
            self.levels.append((k, key))
        key = key + t.doc * base**k
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        rank[order] = self._firsts(key[order])
        open_ = self._open(rank)
        while len(open_):
            self.levels.append((k, rank))
            key = rank[open_] * n + rank[open_ + k]
            sub = np.argsort(key)
            key, open_ = key[sub], open_[sub]
            old, first = key // n, self._firsts(key)
            finer = rank.copy()
            finer[open_] = old + first - self._firsts(old)
            rank, k = finer, 2 * k
            open_ = open_[self._open(rank[open_], n)]
        at = np.empty(n, np.int64)
        at[rank] = np.arange(n)
        self.at = at[t.code[at] > 0]
        self.doc = t.doc[self.at]
        self.size = np.array([len(x) for x in t.texts])
        #: Where each text's ranks begin.
        self.begin = np.cumsum(self.size) - self.size
        self.rank = np.arange(len(self.at)) - self.begin[self.doc]

    def before(self) -> np.ndarray:
        """The place before each suffix, cyclically."""
        return np.where(self.texts.idx[self.at] > 0, self.at - 1, self.texts.start[self.doc] + self.size[self.doc] - 1)

    @staticmethod
    def _firsts(key: np.ndarray) -> np.ndarray:
        """For sorted keys, where the first equal one is."""
        new = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
        return np.repeat(new, np.diff(new, append=len(key)))

    @staticmethod
    def _open(rank: np.ndarray, n: int = 0) -> np.ndarray:
        return np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)

    def lcp(self) -> np.ndarray:
        """Symbols shared with the suffix of the rank before in the same text, found from the largest level down."""
        out = np.zeros(len(self.at), np.int64)
        pair = np.flatnonzero(self.rank > 0)
        a, b = self.at[pair], self.at[pair - 1]
        # a level is asked of those that share all its symbols from the start: of few, save for the first levels
        asked = [np.arange(len(pair))]
        for k, ranks in self.levels:
            near = asked[-1]
            asked.append(near[ranks[a[near]] == ranks[b[near]]] if k >= COMMON else near)
        for (k, ranks), near in zip(reversed(self.levels), reversed(asked)):
            # ranks by k symbols are told anew only where k are shared, so equal ones share them
            same = near[ranks[a[near]] == ranks[b[near]]]
            out[pair[same]] += k
            a[same] += k
            b[same] += k
        return out

    def smaller(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each rank the nearest ranks before and after in the same text with a smaller value (none is below 0); -1 and the text's size if none."""
        # between two texts there is one less than all
        held = np.insert(values, np.append(self.begin, len(values)), -1)
        first = self.begin[self.doc] + self.doc + 1
        at = first + self.rank
        return _smaller_before(held)[at] - first, (len(held) - 1 - _smaller_before(held[::-1])[::-1])[at] - first


def _smaller_before(values: np.ndarray) -> np.ndarray:
    """For each place with a value of 0 or more the nearest one before with a smaller value; the first place's must be -1.

    All places go on together by what the place they have come to has found;
    the few that are still open after some rounds, such as the end of a long
    rise, go one after another by what all before them have found, in linear time.
    """
    near = np.maximum(np.arange(len(values)) - 1, 0)
    open_ = np.flatnonzero((values[near] >= values) & (values >= 0))
    for _ in range(ROUNDS):
        near[open_] = near[near[open_]]
        open_ = open_[values[near[open_]] >= values[open_]]
    value, found = memoryview(values), memoryview(near)
    for i in open_.tolist():
        j = i - 1
        while value[j] >= value[i]:
            j = found[j]
        found[i] = j
    return near


def _told_by(refs: DataFrame, columns, schema: str) -> DataFrame:
    def told(t: Texts) -> tuple[np.ndarray, dict]:
        return columns(t, Ranks(t))

    return of_texts(dealt(refs, "ref_id"), told, schema, "ref_id")


def short(refs: DataFrame) -> DataFrame:
    return refs.where(F.length("text") <= MOST)


def long(refs: DataFrame) -> DataFrame:
    return refs.where(F.length("text") > MOST)


def index(refs: DataFrame) -> DataFrame:
    """(ref_id, rank, pos, lcp)"""
    return _told_by(refs, lambda t, r: (r.doc, {"rank": r.rank, "pos": t.idx[r.at], "lcp": r.lcp()}), "rank long, pos long, lcp long")


def suffix_array(refs: DataFrame) -> DataFrame:
    """(ref_id, rank, pos)"""
    return _told_by(refs, lambda t, r: (r.doc, {"rank": r.rank, "pos": t.idx[r.at]}), "rank long, pos long")


def bwt(refs: DataFrame) -> DataFrame:
    """(ref_id, rank, sym): the symbol before each suffix, cyclically."""

    def columns(t: Texts, r: Ranks):
        return r.doc, {"rank": r.rank, "sym": t.symbols(r.before())}

    return _told_by(refs, columns, "rank long, sym string")


def plcp_max(refs: DataFrame) -> DataFrame:
    """(ref_id, pos, plcp_max): the greater of the LCP values before and after each suffix."""

    def columns(t: Texts, r: Ranks):
        lcp = r.lcp()
        after = np.append(lcp, 0)[1:]  # a text's first rank has none, so the last one's is 0
        return r.doc, {"pos": t.idx[r.at], "plcp_max": np.maximum(lcp, after)}

    return _told_by(refs, columns, "pos long, plcp_max long")


def max_lcp(refs: DataFrame, but: str) -> DataFrame:
    """(ref_id, max_lcp, without) of each text that isn't empty: the greatest LCP value, and that of suffixes that don't begin with ``but``."""

    def columns(t: Texts, r: Ranks):
        lcp, kept = r.lcp(), t.code[r.at] != ord(but) + 1
        every, without = np.full(len(t.texts), -1), np.full(len(t.texts), -1)
        np.maximum.at(every, r.doc, lcp)
        np.maximum.at(without, r.doc[kept], lcp[kept])
        some = np.flatnonzero(r.size)
        return some, {"max_lcp": every[some], "without": _values(without[some], without[some] >= 0)}

    return _told_by(refs, columns, "max_lcp long, without long")


def psv_nsv(refs: DataFrame) -> DataFrame:
    """(ref_id, rank, lcp, psv, nsv), as :func:`refindex.psv_nsv`."""

    def columns(t: Texts, r: Ranks):
        lcp = r.lcp()
        before, after = r.smaller(lcp)
        return r.doc, {"rank": r.rank, "lcp": lcp, "psv": _values(before, before >= 0), "nsv": _values(after, after < r.size[r.doc])}

    return _told_by(refs, columns, "rank long, lcp long, psv long, nsv long")


def range_minimum(refs: DataFrame, last) -> DataFrame:
    """(ref_id, lo, hi, min_lcp): the least LCP value of a range from every rank, whose last rank ``last`` tells from the arrays rank, pos and size of the text."""

    def columns(t: Texts, r: Ranks):
        hi = last(r.rank, t.idx[r.at], r.size[r.doc])
        least = np.zeros(len(hi), np.int64)
        level = np.frexp(hi - r.rank + 1)[1] - 1
        for k, table in _minima(r.lcp(), int(level.max(initial=0))):
            own = np.flatnonzero(level == k)
            least[own] = np.minimum(table[own], table[own + hi[own] - r.rank[own] + 1 - (1 << k)])
        return r.doc, {"lo": r.rank, "hi": hi, "min_lcp": least}

    return _told_by(refs, columns, "lo long, hi long, min_lcp long")


def _minima(values: np.ndarray, most: int):
    """(k, least of 2^k values from each place on) for k up to ``most``."""
    table = values
    for k in range(most + 1):
        yield k, table
        table = np.minimum(table[: -(1 << k)], table[1 << k :])


def _values(values: np.ndarray, where: np.ndarray) -> pa.Array:
    """``values``, null but ``where``."""
    return pa.array(values, pa.int64(), mask=~where)


def suffix_links(refs: DataFrame) -> DataFrame:
    """(ref_id, rank, len, lo, hi), as :func:`refindex.suffix_links` of all intervals."""

    def columns(t: Texts, r: Ranks):
        lcp = r.lcp()
        before, after = r.smaller(lcp)
        own = np.flatnonzero(lcp)
        place = np.empty(len(t.code), np.int64)
        place[r.at] = np.arange(len(r.at))
        # the suffix after this one shares a symbol less with one before it, so the last rank up to it that shares no more has the interval
        at = np.where(lcp[own] > 1, place[np.minimum(r.at[own] + 1, len(place) - 1)], r.begin[r.doc[own]])
        at = _last_below(lcp, at, lcp[own])
        return r.doc[own], {"rank": r.rank[own], "len": lcp[own] - 1, "lo": np.maximum(before[at], 0), "hi": after[at] - 1}

    return _told_by(refs, columns, "rank long, len long, lo long, hi long")


def _last_below(values: np.ndarray, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each of ``at`` the last place up to there with a value below ``bound``; there must be one."""
    at = at.copy()
    open_ = np.flatnonzero(values[at] >= bound)
    if not len(open_):
        return at
    tables = [table for _, table in _minima(values, int(len(values)).bit_length() - 1)]
    for k in reversed(range(len(tables))):
        first = at[open_] - (1 << k) + 1
        over = open_[first >= 0]
        far = over[tables[k][at[over] - (1 << k) + 1] >= bound[over]]
        at[far] -= 1 << k
    return at


def parent_intervals(refs: DataFrame) -> DataFrame:
    """(ref_id, rank, len, lo, hi), as :func:`refindex.parent_intervals` of all intervals."""

    def columns(t: Texts, r: Ranks):
        lcp = r.lcp()
        before, after = r.smaller(lcp)
        start = r.begin[r.doc]
        own = np.flatnonzero((before > 0) | (after < r.size[r.doc]))  # the root has none
        lo, up = np.maximum(before[own], 0) + start[own], after[own] + start[own]
        beyond = np.where(after[own] < r.size[r.doc[own]], np.append(lcp, 0)[up], -1)
        at = np.where(beyond > lcp[lo], up, lo)
        return r.doc[own], {"rank": r.rank[own], "len": lcp[at], "lo": np.maximum(before[at], 0), "hi": after[at] - 1}

    return _told_by(refs, columns, "rank long, len long, lo long, hi long")


def occ_blocks(refs: DataFrame, block: int) -> DataFrame:
    """(ref_id, block, sym, cnt), as :func:`refindex.occ_blocks`."""

    def columns(t: Texts, r: Ranks):
        kind, blocks = r.doc * len(t.known) + t.place[r.before()], int(r.size.max(initial=0)) // block + 1
        key, count = np.unique(kind * blocks + r.rank // block, return_counts=True)
        kind, total = key // blocks, np.cumsum(count)
        first = Ranks._firsts(kind)
        doc, symbols = kind // len(t.known), pa.array([chr(c - 1) if c else "" for c in t.known.tolist()]).take(pa.array(kind % len(t.known)))
        return doc, {"block": key % blocks, "sym": symbols, "cnt": total - (total - count)[first]}

    return _told_by(refs, columns, "block long, sym string, cnt long")


def occ_rank(refs: DataFrame) -> DataFrame:
    """(ref_id, rank, sym, occ), as :func:`refindex.occ_rank`."""

    def columns(t: Texts, r: Ranks):
        before = r.before()
        kind = r.doc * len(t.known) + t.place[before]
        order = np.argsort(kind, kind="stable")
        occ = np.empty(len(kind), np.int64)
        occ[order] = np.arange(len(kind)) - Ranks._firsts(kind[order]) + 1
        return r.doc, {"rank": r.rank, "sym": t.symbols(before), "occ": occ}

    return _told_by(refs, columns, "rank long, sym string, occ long")


def faults(t: Texts, doc: np.ndarray, rank: np.ndarray, pos: np.ndarray) -> dict[str, np.ndarray]:
    """For each text what the linear check of its array tells: rows, distinct, least and greatest place, places that it hasn't, and neighbours whose symbols, or the ranks after them, are out of order.

    The array is any rows (number of the text, rank, place); what made it isn't asked.
    """
    n = len(t.texts)
    size = np.array([len(x) for x in t.texts])
    order = np.lexsort((rank, doc))
    doc, rank, pos = doc[order], rank[order], pos[order]
    count = lambda where: np.bincount(doc[where], minlength=n)
    inside = (pos >= 0) & (pos < size[doc])
    at = np.where(inside, t.start[doc] + pos, 0)
    ranked = np.full(len(t.code) + 1, -1)
    ranked[at[inside]] = rank[inside]
    code, following = np.where(inside, t.code[at], -1), np.where(inside, ranked[at + 1], -1)
    distinct = np.zeros(n, np.int64)
    own = np.lexsort((pos, doc))
    new = np.append(True, (np.diff(doc[own]) != 0) | (np.diff(pos[own]) != 0))[: len(own)]
    distinct += np.bincount(doc[own][new], minlength=n)
    least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(least, doc, pos)
    np.maximum.at(most, doc, pos)
    near = np.append(False, (np.diff(doc) == 0) & (np.diff(rank) == 1))[: len(doc)] & inside
    near[1:] &= inside[:-1]
    b = np.maximum(np.arange(len(doc)) - 1, 0)
    first = near & (code[b] > code)
    later = near & (code[b] == code) & (following[b] >= following)
    return {"size": size, "n": count(slice(None)), "n_distinct": distinct, "min_pos": least, "max_pos": most, "out": count(~inside), "first": count(first), "later": count(later)}


def sa_violations(refs: DataFrame) -> DataFrame:
    """(ref_id, n, n_distinct, min_pos, max_pos, violations), as :func:`gsa.sa_violations`, of each text's suffix array, checked where it is made."""

    def columns(t: Texts, r: Ranks):
        f = faults(t, r.doc, r.rank, t.idx[r.at])
        some = np.flatnonzero(f["n"])
        return some, {c: v[some] for c, v in (f | {"violations": f["first"] + f["later"]}).items() if c in ("n", "n_distinct", "min_pos", "max_pos", "violations")}

    return _told_by(refs, columns, "n long, n_distinct long, min_pos long, max_pos long, violations long")


def sa_outcome(refs: DataFrame) -> DataFrame:
    """(ref_id, outcome), as :func:`gsa.sa_outcome`, of each text's suffix array, checked where it is made."""

    def columns(t: Texts, r: Ranks):
        return np.arange(len(t.texts)), {"outcome": outcome(faults(t, r.doc, r.rank, t.idx[r.at])).astype(np.int32)}

    return _told_by(refs, columns, "outcome int")


def outcome(f: dict[str, np.ndarray]) -> np.ndarray:
    wrong = [f["n"] != f["size"], f["n"] == 0, (f["out"] > 0) | (f["n_distinct"] < f["n"]), f["first"] > 0, f["later"] > 0]
    return np.select(wrong, [-1, 0, -2, -3, -4], 0)


def intervals(refs: DataFrame) -> DataFrame:
    """(ref_id, rank, len, lo, hi): the ranks whose suffixes share the first lcp(rank) symbols with this one."""

    def columns(t: Texts, r: Ranks):
        lcp = r.lcp()
        before, after = r.smaller(lcp)
        return r.doc, {"rank": r.rank, "len": lcp, "lo": np.maximum(before, 0), "hi": after - 1}

    return _told_by(refs, columns, "rank long, len long, lo long, hi long")


def bwt_library(refs: DataFrame) -> DataFrame:
    """(ref_id, i, sym, primary_index), as :func:`refindex.bwt_library`."""

    def columns(t: Texts, r: Ranks):
        idx = t.idx[r.at]
        primary = np.zeros(len(t.texts), np.int64)
        primary[r.doc[idx == 0]] = r.rank[idx == 0] + 1
        primary = primary[r.doc]
        before = np.where(idx > 0, r.at - 1, t.start[r.doc] + r.size[r.doc] - 1)
        return r.doc, {"i": np.where(idx == 0, 0, r.rank + (r.rank < primary)), "sym": t.symbols(before), "primary_index": primary}

    return _told_by(refs, columns, "i long, sym string, primary_index long")


def backward_search(refs: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """(ref_id, pattern, n): occurrences of each pattern by backward steps; ends are the symbol before the first place."""

    def columns(t: Texts, r: Ranks):
        docs = np.arange(len(t.texts))
        # ranks with the ends, which are the first of each text
        at = np.insert(r.at, r.begin, t.start + r.size)
        before = np.where(t.idx[at] > 0, t.place[at - 1], 0)
        first = t.doc[at] * len(t.known) + t.place[at]
        found = []
        for pattern in patterns:
            lo, hi = t.start, t.start + r.size + 1
            for sym in reversed(pattern):
                code = int(np.searchsorted(t.known, ord(sym) + 1))
                if code == len(t.known) or t.known[code] != ord(sym) + 1:
                    lo = hi = t.start
                    break
                held = np.flatnonzero(before == code)
                base = np.searchsorted(first, docs * len(t.known) + code) - np.searchsorted(held, t.start)
                lo, hi = base + np.searchsorted(held, lo), base + np.searchsorted(held, hi)
            found.append(np.maximum(hi - lo, 0))
        return np.tile(docs, len(patterns)), {"pattern": pa.array([p for p in patterns for _ in docs], pa.string()), "n": np.concatenate(found)}

    return _told_by(refs, columns, "pattern string, n long")


class Bounds:
    """Of each distinct interval (``begin``, ``hi``, ``len``, ranks counted over all texts) the ranks ``left`` to ``right`` of each next symbol, in order."""

    def __init__(self, t: Texts, r: Ranks):
        lcp = r.lcp()
        before, after = r.smaller(lcp)
        start = r.begin[r.doc]
        lo, hi = np.maximum(before, 0) + start, after - 1 + start
        key = lo * (int(lcp.max(initial=0)) + 1) + lcp
        # a symbol begins at an interval's first rank, and at the ranks that have it as theirs
        rows, own = np.concatenate([np.arange(len(lo)), lo]), np.tile(np.arange(len(lo)), 2)
        order = np.argsort(key[own] * len(lo) + rows)  # below 2^60 for MOST symbols
        rows, own = rows[order], own[order]
        new = np.diff(key[own], prepend=-1) != 0
        keep = new | (np.diff(rows, prepend=-1) != 0)
        rows, own, new = rows[keep], own[keep], new[keep]
        self.left, self.number, self.own = rows, np.cumsum(new) - 1, own
        self.lo, self.hi, self.len, self.doc = lo[own], hi[own], lcp[own], r.doc[own]
        self.right = np.where(np.append(new[1:], True), self.hi, np.append(rows[1:] - 1, 0))
        self.sym = r.at[rows] + self.len
        self.first = np.flatnonzero(new)


def interval_bounds(refs: DataFrame) -> DataFrame:
    """(ref_id, lo, hi, len, sym, left_bound, right_bound), as :func:`refindex.interval_bounds` of all intervals."""

    def columns(t: Texts, r: Ranks):
        b = Bounds(t, r)
        start = r.begin[b.doc]
        return b.doc, {"lo": b.lo - start, "hi": b.hi - start, "len": b.len, "sym": t.symbols(b.sym), "left_bound": b.left - start, "right_bound": b.right - start}

    return _told_by(refs, columns, "lo long, hi long, len long, sym string, left_bound long, right_bound long")


def bound_search(refs: DataFrame, sought: tuple[str, ...]) -> DataFrame:
    """(ref_id, lo, hi, len, sym, left_bound, right_bound, insertion), as :func:`refindex.bound_search` of ``sought`` in all intervals."""

    def columns(t: Texts, r: Ranks):
        b = Bounds(t, r)
        end, seen = np.append(b.first, len(b.own))[1:], t.code[b.sym]
        codes = [ord(s) + 1 for s in sought]
        # rows are in order of symbol inside an interval, so those below a symbol tell where it is
        met = np.stack([b.first + (n := np.append(0, np.cumsum(seen < c)))[end] - n[b.first] for c in codes], axis=1).ravel()
        # an interval's rows follow one another, so its columns repeat
        at, code, end = np.repeat(b.first, len(sought)), np.tile(codes, len(b.first)), np.repeat(end, len(sought))
        inside, near = met < end, np.minimum(met, end - 1)
        hit, start = inside & (seen[near] == code), r.begin[b.doc[at]]
        value = lambda v, where: pa.array(v, pa.int64(), mask=~where)
        return b.doc[at], {
            "lo": b.lo[at] - start, "hi": b.hi[at] - start, "len": b.len[at], "sym": pa.array(list(sought)).take(pa.array(np.tile(np.arange(len(sought)), len(b.first)))),
            "left_bound": value(b.left[near] - start, hit), "right_bound": value(b.right[near] - start, hit),
            "insertion": value(np.where(inside, b.left[near], b.hi[at] + 1) - start, ~hit)}

    return _told_by(refs, columns, "lo long, hi long, len long, sym string, left_bound long, right_bound long, insertion long")


def bounds_at(refs: DataFrame, asked) -> DataFrame:
    """(ref_id, id, lo, hi, offset, sym, left_bound, right_bound, insertion), as :func:`refindex.bounds_at`.

    ``asked`` gives (lo, hi, offset, number of the symbol) from the arrays rank, lo, hi and len of the intervals, and the symbols are its ``symbols``.
    """
    symbols, question = asked

    def columns(t: Texts, r: Ranks):
        lcp = r.lcp()
        before, after = r.smaller(lcp)
        lo, hi, offset, which = question(r.rank, np.maximum(before, 0), after - 1, lcp)
        start, code = r.begin[r.doc], np.array([ord(s) + 1 for s in symbols])[which]

        lo, hi = lo + start, hi + start + 1

        def halved(a: np.ndarray, over: bool, open_: np.ndarray) -> np.ndarray:
            a, b = a.copy(), hi.copy()
            while len(open_):
                m = (a[open_] + b[open_]) // 2
                seen = t.code[r.at[m] + offset[open_]]
                below = seen <= code[open_] if over else seen < code[open_]
                a[open_[below]] = m[below] + 1
                b[open_[~below]] = m[~below]
                open_ = open_[a[open_] < b[open_]]
            return a

        first = halved(lo, False, np.flatnonzero(lo < hi))
        some = np.flatnonzero(first < hi)
        # only where the symbol is met has it a last place
        some = some[t.code[r.at[first[some]] + offset[some]] == code[some]]
        last = halved(first, True, some)
        has = first < last
        first, last, lo, hi = first - start, last - start, lo - start, hi - start - 1
        value = lambda v, where: pa.array(v, pa.int64(), mask=~where)
        return r.doc, {
            "id": r.rank, "lo": lo, "hi": hi, "offset": offset, "sym": pa.array(list(symbols)).take(pa.array(which)),
            "left_bound": value(first, has), "right_bound": value(last - 1, has), "insertion": value(first, ~has)}

    return _told_by(refs, columns, "id long, lo long, hi long, offset long, sym string, left_bound long, right_bound long, insertion long")
