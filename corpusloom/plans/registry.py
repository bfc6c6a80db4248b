"""Names, DataFrame builders and DuckDB oracles of all registered queries.

Tables: whole texts of ``documents`` for the operators that are linear in
text; ``benchmark`` as the collection of short strings (its first item is the
reference of matching statistics; every item is a reference of its own for
index operators); ``events`` as integer sequences. Every query runs over its
whole table. Queries over ``benchmark`` have a form over all of ``documents``
too (:data:`DOCUMENT_QUERIES`, names ending in ``_documents``), which takes
texts of any length and has no oracle, since the SQL compares suffix strings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import gsa as ga
from ..operators import backward, counted, hashmatch, intseq, matchstats, ownindex, predecessor, ranking, refindex, sequences, symbols, ways
from ..operators.anchored import mark_ranks, ordered
from ..sources import collections as src
from ..storage import kept, new_path, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Patterns that the backward search counts.
PATTERNS = ("e", "th", "ing", "tion", "e th", "qqz")
RUN_SYMBOL = "n"
#: Ends that no pattern holds and that sort before all symbols.
TERMINATOR = "\0"
#: Symbols looked for in every interval.
SOUGHT = ("a", "e", "n", "Z")


def query(oracle: str | None = None):
    """Registers a builder (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle.strip()
        return f

    return add


class Whole(str):
    """A table folder whose ``documents``, not ``benchmark``, are collection, references and reference."""


def _documents(spark, d) -> DataFrame:
    return src.table(spark, d, "documents").select("doc_id", "text")


def _items(spark, d) -> DataFrame:
    if isinstance(d, Whole):
        return _documents(spark, d).withColumn("text", F.coalesce("text", F.lit("")))
    return src.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _refs(spark, d) -> DataFrame:
    return _items(spark, d).withColumnRenamed("doc_id", "ref_id")


def _reference(spark, d) -> DataFrame:
    first = _items(spark, d).agg(F.min(F.struct("doc_id", "text")).alias("x"))
    return first.select(F.col("x.doc_id").alias("ref_id"), "x.text")


def _collection(spark, d) -> DataFrame:
    return _items(spark, d).join(_reference(spark, d).select(F.col("ref_id").alias("doc_id")), "doc_id", "left_anti")


def _kept(spark, d, name: str, build) -> DataFrame:
    """A table over ``documents`` that several queries read, built once; over ``benchmark``, made for each query."""
    if isinstance(d, Whole):
        return kept(spark, f"{d}/documents.parquet", name, build)
    return stored(build(), name)


def _own(refs: DataFrame, d, told, spread) -> DataFrame:
    """What each of ``refs`` tells by itself: over ``documents`` by ``told`` from its own text, save for very long ones; those, and items, by ``spread`` over tables."""
    if not isinstance(d, Whole):
        return spread(refs)
    many = ownindex.long(refs)
    few = told(ownindex.short(refs))
    return few if many.isEmpty() else few.unionByName(spread(many))


def _spread_index(refs: DataFrame, d) -> DataFrame:
    if isinstance(d, Whole):
        return stored(hashmatch.with_lcp(stored(refindex.suffix_array(refs), "sa"), refs), "index")
    return stored(refindex.with_lcp(refindex.suffix_array(refs), refs), "index")


def _index(refs: DataFrame, d) -> DataFrame:
    return _own(refs, d, ownindex.index, lambda r: _spread_index(r, d))


def _indexes(spark, d) -> DataFrame:
    """The index of every item."""
    return _index(_refs(spark, d), d)


def _suffix_array(spark, d) -> DataFrame:
    """The suffix array of every item."""
    return _own(_refs(spark, d), d, ownindex.suffix_array, lambda r: stored(refindex.suffix_array(r), "sa"))


def _statistics(d):
    """The form of matching statistics: by suffix strings for short items; else from right to left over the reference's index, or by hashed prefixes where that is long."""
    if isinstance(d, Whole):

        def matched(collection, reference, index):
            size = reference.select(F.length("text")).first()[0] or 0  # one reference
            by = backward.matching if size <= backward.FEW_SYMBOLS else hashmatch.hashed_matching_statistics
            return by(collection, reference, index)

        return matched
    return lambda collection, reference, index: matchstats.matching_statistics(collection, reference)


def _parts(spark, d, augment: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Collection, reference (with all symbols of the collection, if ``augment``) and reference index."""
    name = "augmented-" if augment else ""
    collection = _collection(spark, d)
    reference = _kept(spark, d, name + "reference", lambda: symbols.augmented(_reference(spark, d), collection, "") if augment else _reference(spark, d))
    index = _kept(spark, d, name + "index", lambda: _index(reference, d))
    return collection, reference, index


def _near(spark, d, parts) -> bool:
    """Whether documents tell their matches, and what follows from them, in the task that has their text: then nothing of them is kept."""
    return isinstance(d, Whole) and 0 < (parts[1].select(F.length("text")).first()[0] or 0) <= backward.FEW_SYMBOLS  # one reference


def _matches(spark, d, augment: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """As :func:`_parts`, and matching statistics."""
    parts = _parts(spark, d, augment)
    if _near(spark, d, parts):
        return *parts, backward.matching(*parts)
    return *parts, _kept(spark, d, ("augmented-" if augment else "") + "matches", lambda: _statistics(d)(*parts))


def _heads(spark, d, augment: bool = False, after_empty: bool = False):
    parts = _parts(spark, d, augment)
    if _near(spark, d, parts):
        return *parts, backward.heads(*parts, after_empty)
    build = lambda: matchstats.heads(_matches(spark, d, augment)[3], *parts[:2], after_empty)
    return *parts, _kept(spark, d, ("augmented-" if augment else "") + ("telling-" if after_empty else "") + "heads", build)


def _told(spark, d, near, tables, *more):
    """What ``near`` tells in the tasks that have the texts, of collection, reference, index and ``more``; where that can't be, ``tables()``."""
    parts = _parts(spark, d)
    return near(*parts, *more) if _near(spark, d, parts) else tables()


def _whole_heads(spark, d):
    """As :func:`_heads`, against the reference with all symbols of the collection."""
    return _heads(spark, d, augment=True)


def _anchor_ranks(spark, d, head, index) -> DataFrame:
    """The ranks of what follows each head of :func:`_whole_heads`."""
    return _kept(spark, d, "anchor-ranks", lambda: ga.anchor_ranks(head, index))


def _ordered(spark, d, by_heads: bool = True, asked: str | None = None) -> DataFrame | None:
    """(doc_id, idx, _id): the collection's places, or those ``asked`` for, in suffix order by the matches along their ways; None for items and long references."""
    if not isinstance(d, Whole):
        return None
    collection, reference, index = _parts(spark, d, augment=True)
    if reference.select(F.length("text")).first()[0] > backward.FEW_SYMBOLS:  # one reference
        return None
    by, form = ways.Marked(reference, index), "heads" if by_heads else "matches"
    codes = _kept(spark, d, f"codes-by-{form}", lambda: ways.coded(collection, reference, index, by_heads))
    ranks = _kept(spark, d, f"marks-by-{form}", lambda: ways.mark_ranks(codes, by))
    return _kept(spark, d, f"order-by-{form}" + (f"-of-{asked}" if asked else ""), lambda: ways.ordered(codes, ranks, by, asked))


def _sorted_check(spark, d, asked: str) -> DataFrame | None:
    """The order by heads of the places ``asked`` for, against the suffix array of all; None where :func:`_ordered` is."""
    order = _ordered(spark, d, asked=asked)
    if order is None:
        return None
    array = _star_order(spark, d) if asked == "stars" else _order(spark, d)  # its numbers rise with rank
    return ga.suborder_violations(ga.gapless(order, "order_no"), array.withColumnRenamed("_id", "rank"))


def _marks(spark, d) -> DataFrame:
    return _kept(spark, d, "marks-of-texts", lambda: mark_ranks(_items(spark, d)))


def _order(spark, d) -> DataFrame:
    """(doc_id, idx, _id): the places of all items in suffix order."""
    return _kept(spark, d, "gsa", lambda: ordered(_items(spark, d), _marks(spark, d)))


def _star_order(spark, d) -> DataFrame:
    """As :func:`_order`, S* positions alone."""
    return _kept(spark, d, "stars-in-order", lambda: ga.star_order(_items(spark, d), _marks(spark, d)))


def _array(spark, d) -> DataFrame:
    """The suffix array of all items."""
    return ga.gapless(_order(spark, d))


def _collection_array(spark, d) -> DataFrame:
    """The suffix array of all items but the reference: that of all, in which others' suffixes keep their order."""
    rest = _array(spark, d).join(_collection(spark, d).select("doc_id"), "doc_id", "left_semi").withColumnRenamed("rank", "_r")
    return ranking.bucket_rank(rest, F.floor(F.col("_r") / ranking.CELL), ["_r"]).select("rank", "doc_id", "idx")


_D = "with d as (select doc_id, coalesce(text, '') as text from documents) "
_SYM = _D + ", s as (select doc_id, unnest(range(0, length(text))) as idx, text from d), p as (select doc_id, idx, substr(text, idx + 1, 1) as sym from s) "
_B = "d as (select item_id as doc_id, coalesce(text, '') as text from benchmark)"
#: Index tables of every item: SA and LCP by sorting suffix strings and comparing neighbours.
_LCP_OF = "coalesce(list_max(list_filter(range(0, least(length({a}), length({b})) + 1), lambda k: left({a}, k) = left({b}, k))), 0)"
_IX = f"""{_B}, x as (select doc_id as ref_id, text, unnest(range(0, length(text))) as pos from d),
y as (select ref_id, text, pos, substr(text, pos + 1) as s, row_number() over (partition by ref_id order by substr(text, pos + 1)) - 1 as rank from x),
z as (select *, lag(s) over (partition by ref_id order by rank) as b from y),
ix as (select ref_id, text, rank, pos, s, case when b is null then 0 else {_LCP_OF.format(a='s', b='b')} end as lcp from z),
bw as (select ref_id, rank, case when pos = 0 then right(text, 1) else substr(text, pos, 1) end as sym from ix)"""
#: Matching statistics by sorting all suffixes together.
_MS = f"""{_B}, r0 as (select min(doc_id) as m from d),
u as (select case when doc_id = m then 0 else 1 end as src, doc_id, i, substr(text, i) as s from (select doc_id, text, unnest(range(1, length(text) + 1)) as i from d), r0),
w as (select *,
  last_value(case when src = 0 then struct_pack(i := i, s := s) end ignore nulls) over (order by s, src desc, doc_id, i rows between unbounded preceding and 1 preceding) as p,
  first_value(case when src = 0 then struct_pack(i := i, s := s) end ignore nulls) over (order by s, src desc, doc_id, i rows between 1 following and unbounded following) as n from u),
l as (select src, doc_id, i, s, p.i as pi, n.i as ni,
  coalesce(list_max(list_filter(range(0, length(s) + 1), lambda k: p.s is not null and length(p.s) >= k and left(p.s, k) = left(s, k))), -1) as lp,
  coalesce(list_max(list_filter(range(0, length(s) + 1), lambda k: n.s is not null and length(n.s) >= k and left(n.s, k) = left(s, k))), -1) as ln from w),
ms as (select doc_id, i - 1 as idx, (case when ln >= lp then ni else pi end) - 1 as pos, greatest(lp, ln, 0) as len, ln >= lp as smaller from l where src = 1)"""
_HEADS = _MS + """,
h0 as (select *, lag(pos) over (partition by doc_id order by idx) as b from ms),
h1 as (select doc_id, idx, pos, len, smaller, false as is_end from h0 where b is null or pos <> b + 1
  union all select doc_id, length(text), (select length(text) - 1 from d, r0 where doc_id = m), 0, false, true from d, r0 where doc_id <> m),
h as (select doc_id, row_number() over (partition by doc_id order by idx) as head_id, idx as start, lead(idx) over (partition by doc_id order by idx) as next_start, pos, len, smaller, is_end from h1),
rf as (select text from d, r0 where doc_id = m),
rs as (select i - 1 as pos, row_number() over (order by s) - 1 as rank, s from u where src = 0)"""
_GSA = f"{_B}, g as (select row_number() over (order by substr(text, i), doc_id, i) - 1 as rank, doc_id, i - 1 as idx, substr(text, i) as s, substr(text, i + 1) as t from (select doc_id, text, unnest(range(1, length(text) + 1)) as i from d))"
_TYPES = f"""{_B}, t as (
  select doc_id, i - 1 as idx, substr(text, i, 1) as sym, case when substr(text, i) < substr(text, i + 1) then 'S' else 'L' end as type from (select doc_id, text, unnest(range(1, length(text) + 1)) as i from d)
  union all select doc_id, length(text), '', 'S' from d),
st as (select doc_id, idx, sym from (select *, lag(type) over (partition by doc_id order by idx) as b from t) where type = 'S' and b = 'L')"""
_EV = """e as (select distinct event_type as sym from events), c as (select sym, row_number() over (order by sym) - 1 as val from e),
v as (select user_id as seq_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, val from events join c on event_type = sym),
a as (select seq_id, list(val order by pos) as vals from v group by seq_id),
r as (select seq_id, v.pos, v.val, row_number() over (partition by seq_id order by vals[v.pos + 1:]) - 1 as rank, vals from v join a using (seq_id))"""

# ---- text ----------------------------------------------------------------


@query(_D + r"select doc_id, regexp_replace(regexp_replace(text, '[\n\r]\z', ''), '\$\z', '') as text from d")
def text_trim(spark, d):
    return _documents(spark, d).select("doc_id", tx.trim_terminators(F.coalesce("text", F.lit(""))).alias("text"))


@query(_D + "select doc_id, translate(text, '%X', '$$') as text from d")
def symbol_substitution(spark, d):
    return _documents(spark, d).select("doc_id", tx.substitute_separators(F.coalesce("text", F.lit(""))).alias("text"))


@query(_SYM + "select sym, count(*) as n from p group by sym")
def sym_histogram(spark, d):
    return symbols.histogram(symbols.positions(_documents(spark, d)))


@query(_SYM + """, r as (select doc_id, sym, idx - row_number() over (partition by doc_id, sym order by idx) as island from p)
select sym, max(n) as max_run from (select sym, count(*) as n from r group by doc_id, sym, island) group by sym""")
def sym_max_run(spark, d):
    return symbols.max_runs(_documents(spark, d))


@query(f"""with {_B}, p as (select doc_id, idx, substr(text, idx + 1, 1) as sym from (select doc_id, text, unnest(range(0, length(text))) as idx from d)),
i as (select doc_id, sym, idx - row_number() over (partition by doc_id, sym order by idx) as island from p),
m as (select sym, max(n) as n from (select sym, count(*) as n from i group by doc_id, sym, island) group by sym)
select doc_id as ref_id, text || coalesce((select string_agg(repeat(sym, n), '' order by sym) from m where sym <> '%' and not contains(d.text, sym)), '') || '$' || chr(10) as text from d""")
def ref_augment(spark, d):
    return symbols.augmented(_refs(spark, d), _items(spark, d))


@query("""with t as (select text from documents union all select text from benchmark), s as (select distinct unnest(string_split(text, '')) as sym from t)
select sym, row_number() over (order by sym) - 1 as code from s where sym <> ''""")
def alphabet_remap(spark, d):
    return symbols.alphabet_codes(symbols.positions(_documents(spark, d)), symbols.positions(_items(spark, d)))


@query(_SYM + ", c as (select sym, count(*) as n from p group by sym) select sym, n, coalesce(sum(n) over (order by sym rows between unbounded preceding and 1 preceding), 0)::bigint as bucket_start from c")
def bucket_starts(spark, d):
    return symbols.bucket_bounds(symbols.histogram(symbols.positions(_documents(spark, d)))).select("sym", "n", "bucket_start")


@query(_SYM + ", c as (select sym, count(*) as n from p group by sym) select sym, n, (sum(n) over (order by sym))::bigint as bucket_end from c")
def bucket_ends(spark, d):
    return symbols.bucket_bounds(symbols.histogram(symbols.positions(_documents(spark, d)))).select("sym", "n", "bucket_end")


_PICTURE = r"""case when sym = ' ' then '\s' when sym = chr(10) then '\n' when sym = chr(13) then '\l' when sym = chr(9) then '\t'
 when unicode(sym) > 32 and unicode(sym) < 127 then ' ' || sym else (case when unicode(sym) < 16 then '0' else '' end) || lower(to_hex(unicode(sym))) end"""


@query(_SYM + f"select distinct sym, {_PICTURE} as picture from p")
def printable_char(spark, d):
    return symbols.positions(_documents(spark, d)).select("sym").distinct().select("sym", tx.printable(F.col("sym")).alias("picture"))


@query(f"""with {_B}, p as (select doc_id, idx, substr(text, idx + 1, 1) as sym from (select doc_id, text, unnest(range(0, length(text))) as idx from d))
select doc_id, 'text ' || coalesce(string_agg({_PICTURE}, '' order by idx), '') as picture from d left join p using (doc_id) group by doc_id""")
def print_array(spark, d):
    return _items(spark, d).select("doc_id", tx.pictured("text", F.col("text")).alias("picture"))


@query("select doc_id, case when n_chars = 0 then 0 else length(bin(n_chars)) - 1 end::int as log2 from documents")
def floor_log2(spark, d):
    return src.table(spark, d, "documents").select("doc_id", tx.floor_log2(F.col("n_chars")).alias("log2"))


@query(f"with {_B} select a.doc_id, b.doc_id as other_id, left(a.text, least(length(a.text), length(b.text))) < left(b.text, least(length(a.text), length(b.text))) as is_less from d a join d b on b.doc_id = a.doc_id + 1")
def prefix_compare(spark, d):
    a = _items(spark, d)
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("other_id"), F.col("text").alias("_t"))
    return a.join(b, "doc_id").select("doc_id", "other_id", tx.prefix_less(F.col("text"), F.col("_t")).alias("is_less"))


@query(_D + "select count(*) as n_docs, sum(length(text))::bigint as n_chars, max(length(text)) as max_chars from d")
def doc_lengths(spark, d):
    n = F.length(F.coalesce("text", F.lit("")))
    return _documents(spark, d).agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_chars"), F.max(n).cast("long").alias("max_chars"))


@query(_D + 'select doc_id, coalesce(sum(length(text) + 1) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as "offset", length(text) as length from d')
def doc_boundaries(spark, d):
    return ga.doc_boundaries(_documents(spark, d))


@query(f"with {_B} select doc_id, i - 1 as idx, substr(text, i) as s from (select doc_id, text, unnest(range(1, length(text) + 1)) as i from d)")
def suffix_scan(spark, d):
    return matchstats.suffixes(_items(spark, d))


# ---- reference index ---------------------------------------------------------


@query(f"with {_IX} select ref_id, rank, pos from ix")
def suffix_array(spark, d):
    return _suffix_array(spark, d)


@query(f"with {_IX} select ref_id, pos, rank from ix")
def inverse_sa(spark, d):
    return _suffix_array(spark, d).select("ref_id", "pos", "rank")


@query(f"with {_IX} select ref_id, rank, pos, lcp from ix")
def lcp_array(spark, d):
    return _indexes(spark, d)


@query(f"with {_IX} select ref_id, rank, pos, lcp from ix")
def lcp_array_by_levels(spark, d):
    return refindex.index_by_levels(_refs(spark, d))


@query(f"with {_IX} select ref_id, rank, pos, lcp from ix")
def lcp_array_by_runs(spark, d):
    """LCP values of which only the ends of runs are compared, by hashes."""
    refs = _refs(spark, d)
    return hashmatch.with_lcp(_suffix_array(spark, d), refs)


@query(f"with {_IX} select ref_id, pos, greatest(lcp, coalesce(lead(lcp) over (partition by ref_id order by rank), 0)) as plcp_max from ix")
def plcp_max(spark, d):
    return _own(_refs(spark, d), d, ownindex.plcp_max, lambda r: refindex.with_plcp_max(_spread_index(r, d)).select("ref_id", "pos", "plcp_max"))


@query(f"with {_IX} select ref_id, max(lcp) as max_lcp, max(lcp) filter (where left(s, 1) <> 'N') as max_lcp_without_n from ix group by ref_id")
def max_lcp(spark, d):

    def spread(refs):
        rows = _spread_index(refs, d).join(refindex.symbol_at(refs, sym="_c"), ["ref_id", "pos"])
        return rows.groupBy("ref_id").agg(F.max("lcp").alias("max_lcp"), F.max(F.when(F.col("_c") != "N", F.col("lcp"))).alias("max_lcp_without_n"))

    return _own(_refs(spark, d), d, lambda r: ownindex.max_lcp(r, "N").withColumnRenamed("without", "max_lcp_without_n"), spread)


@query(f"with {_IX} select ref_id, sum(lcp)::bigint as sum_lcp, sum(lcp)::double / count(*) as avg_lcp from ix group by ref_id")
def avg_lcp(spark, d):
    return _indexes(spark, d).groupBy("ref_id").agg(F.sum("lcp").alias("sum_lcp"), (F.sum("lcp").cast("double") / F.count("*")).alias("avg_lcp"))


@query(f"with {_IX} select ref_id, rank, sym from bw")
def bwt(spark, d):
    return _told_bwt(spark, d)


@query(f"""with {_IX}, p as (select ref_id, rank + 1 as primary_index from ix where pos = 0)
select ref_id, case when pos = 0 then 0 else rank + case when rank < primary_index then 1 else 0 end end as i, case when pos = 0 then right(text, 1) else substr(text, pos, 1) end as sym, primary_index from ix join p using (ref_id)""")
def bwt_primary_index(spark, d):
    return _own(_refs(spark, d), d, ownindex.bwt_library, lambda r: refindex.bwt_library(stored(refindex.suffix_array(r), "sa"), r))


def _told_bwt(spark, d):
    return _own(_refs(spark, d), d, ownindex.bwt, lambda r: refindex.bwt(stored(refindex.suffix_array(r), "sa"), r))


def _spread_bwt(refs: DataFrame) -> DataFrame:
    return stored(refindex.bwt(stored(refindex.suffix_array(refs), "sa"), refs), "bwt")


@query(f"with {_IX} select ref_id, sym, (select count(*) from bw b where b.ref_id = a.ref_id and b.sym < a.sym) as c from (select distinct ref_id, sym from bw) a")
def c_array(spark, d):
    return refindex.c_array(_told_bwt(spark, d))


@query(f"""with {_IX} select a.ref_id, a.block, a.sym, count(*) as cnt from (select distinct ref_id, rank // 128 as block, sym from bw) a
join bw b on b.ref_id = a.ref_id and b.sym = a.sym and b.rank < (a.block + 1) * 128 group by all""")
def occ_blocks(spark, d):
    return _own(_refs(spark, d), d, lambda r: ownindex.occ_blocks(r, refindex.BLOCK), lambda r: refindex.occ_blocks(_spread_bwt(r)))


@query(f"with {_IX} select ref_id, rank, sym, row_number() over (partition by ref_id, sym order by rank) as occ from bw")
def occ_rank(spark, d):
    return _own(_refs(spark, d), d, ownindex.occ_rank, lambda r: refindex.occ_rank(_spread_bwt(r)))


@query(f"with {_B}, q as (select unnest({list(PATTERNS)}) as pattern) select doc_id as ref_id, pattern, len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, length(pattern)) = pattern))::bigint as n from d, q where length(text) > 0")
def backward_search_count(spark, d):

    def spread(refs):
        patterns = spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")
        refs = refs.withColumn("text", F.concat("text", F.lit(TERMINATOR)))
        rows = stored(refindex.bwt(refindex.suffix_array(refs), refs), "bwt")
        return refindex.backward_search(rows, patterns, max(map(len, PATTERNS)))

    return _own(_refs(spark, d).where(F.length("text") > 0), d, lambda r: ownindex.backward_search(r, PATTERNS), spread)


_PN = """pn as (select a.ref_id, a.rank, a.lcp, (select max(b.rank) from ix b where b.ref_id = a.ref_id and b.rank < a.rank and b.lcp < a.lcp) as psv,
  (select min(b.rank) from ix b where b.ref_id = a.ref_id and b.rank > a.rank and b.lcp < a.lcp) as nsv from ix a)"""
_IV = _IX + ", " + _PN + ", iv as (select ref_id, rank, lcp as len, coalesce(psv, 0) as lo, coalesce(nsv - 1, (select max(rank) from ix b where b.ref_id = pn.ref_id)) as hi from pn)"


@query(f"with {_IX}, {_PN} select * from pn")
def psv_nsv(spark, d):
    return _own(_refs(spark, d), d, ownindex.psv_nsv, lambda r: refindex.psv_nsv(_spread_index(r, d)))


@query(f"""with {_IX}, q as (select ref_id, rank as lo, least(rank + pos % 300, max(rank) over (partition by ref_id)) as hi from ix)
select q.ref_id, q.lo, q.hi, min(b.lcp) as min_lcp from q join ix b on b.ref_id = q.ref_id and b.rank between q.lo and q.hi group by all""")
def range_min(spark, d):
    """Least LCP values of a range from every rank, of many lengths."""

    def spread(refs):
        index = _spread_index(refs, d)
        last = index.groupBy("ref_id").agg(F.max("rank").alias("_last"))
        asked = index.join(last, "ref_id").select("ref_id", F.col("rank").alias("lo"), F.least(F.col("rank") + F.col("pos") % 300, F.col("_last")).alias("hi"))
        return refindex.range_minimum(index, asked.withColumn("id", F.col("lo")), ["id"]).select("ref_id", "lo", "hi", "min_lcp")

    return _own(_refs(spark, d), d, lambda r: ownindex.range_minimum(r, lambda rank, pos, size: np.minimum(rank + pos % 300, size - 1)), spread)


@query(f"with {_IV} select * from iv")
def lcp_interval(spark, d):
    return _own(_refs(spark, d), d, ownindex.intervals, lambda r: refindex.lcp_intervals(_spread_index(r, d)))


@query(f"""with {_IV} select v.ref_id, v.rank, v.len - 1 as len, min(b.rank) as lo, max(b.rank) as hi from iv v
join ix a on a.ref_id = v.ref_id and a.rank = v.rank join ix b on b.ref_id = v.ref_id and left(b.s, v.len - 1) = substr(a.s, 2, v.len - 1) and length(b.s) >= v.len - 1
where v.len > 0 group by all""")
def suffix_link(spark, d):

    def spread(refs):
        index = _spread_index(refs, d)
        return refindex.suffix_links(index, stored(refindex.lcp_intervals(index), "intervals"))

    return _own(_refs(spark, d), d, ownindex.suffix_links, spread)


@query(f"""with {_IV}, s as (select ref_id, max(rank) as last from ix group by ref_id),
q as (select v.*, greatest(coalesce(x.lcp, 0), coalesce(y.lcp, 0)) as plen from iv v join s using (ref_id) left join ix x on x.ref_id = v.ref_id and x.rank = v.lo left join ix y on y.ref_id = v.ref_id and y.rank = v.hi + 1 where not (v.lo = 0 and v.hi = s.last))
select q.ref_id, q.rank, q.plen as len, min(b.rank) as lo, max(b.rank) as hi from q join ix a on a.ref_id = q.ref_id and a.rank = q.lo join ix b on b.ref_id = q.ref_id and length(b.s) >= q.plen and left(b.s, q.plen) = left(a.s, q.plen) group by all""")
def parent_interval(spark, d):

    def spread(refs):
        index = _spread_index(refs, d)
        return refindex.parent_intervals(index, stored(refindex.lcp_intervals(index), "intervals"))

    return _own(_refs(spark, d), d, ownindex.parent_intervals, spread)


@query(f"with {_IV} select v.ref_id, v.lo, v.hi, v.len, substr(b.s, v.len + 1, 1) as sym, min(b.rank) as left_bound, max(b.rank) as right_bound from (select distinct ref_id, lo, hi, len from iv) v join ix b on b.ref_id = v.ref_id and b.rank between v.lo and v.hi group by all")
def interval_bound_search(spark, d):

    def spread(refs):
        index = _spread_index(refs, d)
        return refindex.interval_bounds(index, refs, stored(refindex.lcp_intervals(index), "intervals"))

    return _own(_refs(spark, d), d, ownindex.interval_bounds, spread)


@query(f"""with {_IV}, q as (select distinct ref_id, lo, hi, len, sym from iv, (select unnest({list(SOUGHT)}) as sym)),
b as (select q.*, x.rank, substr(x.s, q.len + 1, 1) as c from q join ix x on x.ref_id = q.ref_id and x.rank between q.lo and q.hi)
select ref_id, lo, hi, len, sym, min(rank) filter (where c = sym) as left_bound, max(rank) filter (where c = sym) as right_bound,
  case when count(*) filter (where c = sym) = 0 then lo + count(*) filter (where c < sym) end as insertion from b group by ref_id, lo, hi, len, sym""")
def bound_insertion(spark, d):
    """Where some symbols are in each interval, or would be."""

    def spread(refs):
        index = _spread_index(refs, d)
        intervals = stored(refindex.lcp_intervals(index), "intervals")
        asked = intervals.select("ref_id", "lo", "hi", "len").distinct().withColumn("sym", F.explode(F.array(*map(F.lit, SOUGHT))))
        return refindex.bound_search(refindex.interval_bounds(index, refs, intervals), asked)

    return _own(_refs(spark, d), d, lambda r: ownindex.bound_search(r, SOUGHT), spread)


@query(f"""with {_IV}, q as (select ref_id, rank as id, lo + rank % least(3, hi - lo + 1) as lo, hi, greatest(len - rank % 3, 0) as "offset", ({list(SOUGHT)})[rank % {len(SOUGHT)} + 1] as sym from iv),
b as (select q.*, x.rank, substr(x.s, q."offset" + 1, 1) as c from q join ix x on x.ref_id = q.ref_id and x.rank between q.lo and q.hi)
select ref_id, id, lo, hi, "offset", sym, min(rank) filter (where c = sym) as left_bound, max(rank) filter (where c = sym) as right_bound,
  case when count(*) filter (where c = sym) = 0 then lo + count(*) filter (where c < sym) end as insertion from b group by ref_id, id, lo, hi, "offset", sym""")
def bound_search_anywhere(spark, d):
    """Symbols looked for in parts of intervals, at offsets up to what their suffixes share; all questions halve together."""

    def spread(refs):
        index = _spread_index(refs, d)
        asked = stored(refindex.lcp_intervals(index), "intervals").select(
            "ref_id", F.col("rank").alias("id"), (F.col("lo") + F.col("rank") % F.least(F.lit(3), F.col("hi") - F.col("lo") + 1)).alias("lo"), "hi",
            F.greatest(F.col("len") - F.col("rank") % 3, F.lit(0)).alias("offset"), F.get(F.array(*map(F.lit, SOUGHT)), (F.col("rank") % len(SOUGHT)).cast("int")).alias("sym"))
        return refindex.bounds_at(index, refs, asked)

    def asked(rank, lo, hi, length):
        return lo + rank % np.minimum(3, hi - lo + 1), hi, np.maximum(length - rank % 3, 0), rank % len(SOUGHT)

    return _own(_refs(spark, d), d, lambda r: ownindex.bounds_at(r, (SOUGHT, asked)), spread)


@query(f"with {_B} select doc_id as ref_id, 0 as outcome from d")
def sa_outcome(spark, d):
    return _own(_refs(spark, d), d, ownindex.sa_outcome, lambda r: ga.sa_outcome(stored(refindex.suffix_array(r), "sa"), r))


@query(f"""with {_IX}, k as (select ref_id, rank, pos, left(s, 1) as sym, (select b.rank from ix b where b.ref_id = ix.ref_id and b.pos = ix.pos + 1) as nxt from ix),
m as (select *, lag(sym) over w as s0, lag(coalesce(nxt, -1)) over w as n0 from k window w as (partition by ref_id order by rank))
select ref_id, count(*) as n, count(distinct pos) as n_distinct, min(pos) as min_pos, max(pos) as max_pos, count(*) filter (where s0 is not null and (s0 > sym or (s0 = sym and n0 >= coalesce(nxt, -1)))) as violations from m group by ref_id""")
def sa_check(spark, d):
    return _own(_refs(spark, d), d, ownindex.sa_violations, lambda r: ga.sa_violations(stored(refindex.suffix_array(r), "sa"), r))


# ---- matching statistics ---------------------------------------------------------


@query(f"""with {_B}, r0 as (select min(doc_id) as m from d), rf as (select text as ref from d, r0 where doc_id = m)
select doc_id, i - 1 as idx, list_max(list_filter(range(0, length(text) - i + 2), lambda l: contains(ref, substr(text, i, l)))) as len from (select doc_id, text, unnest(range(1, length(text) + 1)) as i from d), r0, rf where doc_id <> m""")
def ms_len(spark, d):
    return _matches(spark, d)[3].select("doc_id", "idx", "len")


@query(f"with {_MS} select * from ms")
def ms_full(spark, d):
    return _matches(spark, d)[3]


@query(f"with {_MS} select * from ms")
def ms_by_ranks(spark, d):
    return matchstats.matching_statistics_by_ranks(_collection(spark, d), _reference(spark, d))


@query(f"with {_MS} select * from ms")
def ms_by_hashes(spark, d):
    reference = _reference(spark, d)
    return hashmatch.hashed_matching_statistics(_collection(spark, d), reference, _index(reference, d))


@query(f"with {_MS} select ms.doc_id, ms.idx, pos, len, smaller, substr(text, idx + len + 1, 1) as mismatch from ms join d using (doc_id)")
def ms_mismatch(spark, d):

    def tables():
        collection, _, _, ms = _matches(spark, d)
        return matchstats.with_mismatch(ms, collection)

    return _told(spark, d, backward.with_mismatch, tables)


@query(f"""with {_MS}, q as (select ms.*, length(regexp_extract(substr(text, idx + 1), '^{RUN_SYMBOL}+')) as run, (select length(text) from d, r0 where doc_id = m) as n from ms join d using (doc_id))
select doc_id, idx, case when run > 0 then n else pos end as pos, case when run > 0 then run else len end as len, run = 0 and smaller as smaller from q""")
def ms_with_runs(spark, d):
    """Matches in which the runs of one symbol stand for themselves."""

    def tables():
        collection, reference, _, ms = _matches(spark, d)
        return matchstats.with_runs(ms, collection, reference, RUN_SYMBOL)

    return _told(spark, d, backward.with_runs, tables, RUN_SYMBOL)


@query(f"""with {_MS}, rs as (select s, row_number() over (order by s) - 1 as rank from u where src = 0)
select ms.doc_id, ms.idx, ms.len, min(rank) as lo, max(rank) as hi from ms join d using (doc_id) join rs on left(rs.s, ms.len) = substr(d.text, ms.idx + 1, ms.len) group by all""")
def ms_backward(spark, d):
    """Right to left over the reference's index, with the interval of each match."""
    reference = stored(_reference(spark, d), "reference")
    return backward.backward_matching(_collection(spark, d), reference, _index(reference, d))


@query(f"with {_HEADS} select * from h")
def ms_heads(spark, d):
    return _heads(spark, d)[3]


@query(f"with {_B} select doc_id, i - 1 as idx, length(regexp_extract(substr(text, i), '^{RUN_SYMBOL}+')) as len from (select doc_id, text, unnest(range(1, length(text) + 1)) as i from d) where substr(text, i, 1) = '{RUN_SYMBOL}'")
def ms_n_runs(spark, d):
    return matchstats.symbol_runs(_items(spark, d), RUN_SYMBOL)


@query(f"""with {_HEADS}, rl as (select max({_LCP_OF.format(a='s', b='b')}) as max_lcp from (select s, lag(s) over (order by rank) as b from rs) where b is not null)
select count(*) as n_heads, coalesce(sum(len), 0)::bigint as sum_len, max(len) as max_len, count(*) filter (where len = 0) as n_zero, count(*) filter (where len <= max_lcp) as n_short, sum(len)::double / count(*) as avg_len from h, rl where not is_end""")
def ms_head_stats(spark, d):
    _, _, index, head = _heads(spark, d)
    return matchstats.head_statistics(head, index)


@query(f"""with {_HEADS}, q as (select h.doc_id, h.head_id, count(*) as n from h join d using (doc_id) join u on u.src = 0 and left(u.s, h.len) = substr(d.text, h.start + 1, h.len) where not is_end and len > 0 group by all)
select count(*) as n_matched, count(*) filter (where n = 1) as n_unambiguous from q""")
def ms_unambiguous(spark, d):

    def tables():
        _, _, index, head = _heads(spark, d)
        return matchstats.unambiguous(head, index)

    return _told(spark, d, backward.unambiguous, tables)


@query(f"""with {_HEADS}, q as (select doc_id, list(struct_pack(pos := pos, len := len) order by start) as x from h where not is_end group by doc_id)
select row_number() over (order by x, doc_id) - 1 as order_no, doc_id, len(x)::int as n_phrases from q""")
def phrase_sequences(spark, d):
    """Documents sorted by their sequences of phrases."""
    return _told(spark, d, sequences.phrase_sequences, lambda: matchstats.phrase_sequences(_heads(spark, d)[3]))


@query(f"with {_HEADS} select rs.rank, count(h.doc_id) as n from rs left join h on h.pos = rs.pos and not h.is_end group by rs.rank")
def suffixes_before(spark, d):
    _, _, index, head = _heads(spark, d)
    return matchstats.heads_by_slot(head, index)


_PHRASES = _HEADS + ", ph as (select row_number() over (order by rs.rank, h.len, h.doc_id, h.start) - 1 as order_no, h.doc_id, h.start, h.pos, h.len from h join rs on rs.pos = h.pos where not h.is_end)"


@query(f"with {_PHRASES} select * from ph")
def phrase_sort(spark, d):

    def tables():
        _, _, index, head = _heads(spark, d)
        return matchstats.sorted_phrases(head, index)

    return _told(spark, d, counted.sorted_phrases, tables)


@query(f"with {_PHRASES}, q as (select order_no, order_no - row_number() over (partition by len order by order_no) as island, len from ph), r as (select count(*) as run from q group by len, island) select count(*) as n_buckets, max(run) as max_run from r")
def length_buckets(spark, d):

    def tables():
        _, _, index, head = _heads(spark, d)
        return matchstats.length_buckets(stored(matchstats.sorted_phrases(head, index), "phrases"))

    return _told(spark, d, counted.length_buckets, tables)


@query(f"with {_MS} select min(len) as min_len, max(len) as max_len, sum(len)::bigint as sum_len, sum(len)::double / count(*) as avg_len from ms")
def ms_length_summary(spark, d):
    ms = _matches(spark, d)[3]
    return ms.agg(F.min("len").alias("min_len"), F.max("len").alias("max_len"), F.sum("len").alias("sum_len"), (F.sum("len").cast("double") / F.count("*")).alias("avg_len"))


@query(f"with {_MS} select doc_id, idx, pos, len from ms")
def ms_from_heads(spark, d):
    """Matches of all positions told from heads alone."""

    def tables():
        collection, _, _, head = _heads(spark, d, after_empty=True)
        rows = predecessor.head_of(symbols.positions(collection).select("doc_id", "idx"), head)
        k = F.col("idx") - F.col("head_start")
        return rows.select("doc_id", "idx", (F.col("pos") + k).alias("pos"), F.greatest(F.col("len") - k, F.lit(0)).alias("len"))

    return _told(spark, d, backward.from_heads, tables)


# ---- predecessors ------------------------------------------------------------------


@query(f"with {_HEADS} select ms.doc_id, ms.idx, h.head_id, h.start as head_start from ms asof join h on ms.doc_id = h.doc_id and ms.idx >= h.start")
def head_of_suffix(spark, d):

    def tables():
        collection, _, _, head = _heads(spark, d)
        return predecessor.head_of(symbols.positions(collection).select("doc_id", "idx"), head).select("doc_id", "idx", "head_id", "head_start")

    return _told(spark, d, backward.head_of, tables)


@query(f"with {_HEADS}, q as (select ms.doc_id, ms.idx as q, a.start as pred from ms asof left join h a on ms.doc_id = a.doc_id and ms.idx >= a.start) select q.doc_id, q.q, q.pred, b.start as succ from q asof left join h b on q.doc_id = b.doc_id and q.q <= b.start")
def pred_succ_lookup(spark, d):

    def tables():
        collection, _, _, head = _heads(spark, d)
        return predecessor.pred_succ(symbols.positions(collection).select("doc_id", F.col("idx").alias("q")), head.select("doc_id", F.col("start").alias("key")))

    return _told(spark, d, backward.pred_succ, tables)


@query(f"""with {_HEADS}, q as (select doc_id, head_id as from_head, start + len as idx from h where not is_end),
j as (select q.doc_id, q.from_head, h.head_id as next_head_id, q.idx - h.start as "offset", h.pos from q asof join h on q.doc_id = h.doc_id and q.idx >= h.start)
select j.doc_id, j.from_head as head_id, j.next_head_id, j."offset", rs.rank as next_isa from j join rs on rs.pos = j.pos + j."offset" """)
def next_head(spark, d):

    def tables():
        _, _, index, head = _heads(spark, d)
        return predecessor.next_heads(head, index)

    return _told(spark, d, backward.next_heads, tables)


# ---- types, buckets, heads, GSA ---------------------------------------------------------


@query(f"with {_TYPES} select * from t")
def ls_types(spark, d):
    return ga.types(_items(spark, d))


@query(f"with {_TYPES} select * from st")
def sstar(spark, d):
    return ga.stars(_items(spark, d))


@query(f"with {_TYPES} select sym, count(*) as n from st group by sym")
def sstar_per_symbol(spark, d):
    return symbols.histogram(ga.stars(_items(spark, d)))


@query(f"""with {_HEADS}, t as (select doc_id, idx, substr(text, idx + 1) < substr(text, idx + 2) as is_s, idx > 0 and substr(text, idx) > substr(text, idx + 1) as after_l from ms join d using (doc_id))
select rs.rank as isa_pos, count(*) as n from ms join t using (doc_id, idx) join rs on rs.pos = ms.pos where t.is_s and t.after_l group by rs.rank""")
def sstar_buckets(spark, d):

    def tables():
        collection, _, index, ms = _matches(spark, d)
        star = ga.stars(collection).select("doc_id", "idx")
        return ms.join(star, ["doc_id", "idx"]).join(index.select("pos", F.col("rank").alias("isa_pos")), "pos").groupBy("isa_pos").agg(F.count("*").alias("n"))

    return _told(spark, d, backward.ranks_met, tables, ga.star_places)


@query(f"with {_HEADS} select rs.rank as isa_pos, count(*) as n from ms join rs on rs.pos = ms.pos group by rs.rank")
def full_suffix_buckets(spark, d):

    def tables():
        _, _, index, ms = _matches(spark, d)
        return ms.join(index.select("pos", F.col("rank").alias("isa_pos")), "pos").groupBy("isa_pos").agg(F.count("*").alias("n"))

    return _told(spark, d, backward.ranks_met, tables)


_SORTED = _HEADS + """, hk as (select h.doc_id, h.head_id, rs.rank as slot, not h.smaller as side, case when h.smaller then h.len else -h.len end as k, substr(d.text, h.start + h.len + 1, 1) as nxt from h join d using (doc_id) join rs on rs.pos = h.pos where not h.is_end)"""


@query(f"with {_SORTED} select row_number() over (order by slot, side, k, nxt, doc_id, head_id) - 1 as order_no, doc_id, head_id from hk")
def head_sort(spark, d):

    def tables():
        collection, _, index, head = _heads(spark, d)
        return ga.sorted_heads(head, collection, index).where("order_no is not null")

    return _told(spark, d, counted.sorted_heads, tables, False).select("order_no", "doc_id", "head_id")


@query(f"with {_SORTED} select dense_rank() over (order by slot, side, k, nxt) + 1 as name, doc_id, head_id from hk union all select 1, doc_id, head_id from h where is_end")
def head_names(spark, d):

    def tables():
        collection, _, index, head = _heads(spark, d)
        return ga.sorted_heads(head, collection, index)

    return _told(spark, d, counted.sorted_heads, tables).select("name", "doc_id", "head_id")


@query(f"with {_GSA} select rank, doc_id, idx from g")
def gsa(spark, d):
    return _array(spark, d)


@query(f"with {_GSA} select rank, doc_id, idx from g")
def gsa_bucketed(spark, d):
    return ga.gsa_bucketed(_items(spark, d))


@query(_GSA.replace("from benchmark)", "from benchmark where item_id > (select min(item_id) from benchmark))", 1).join(["with ", " select rank, doc_id, idx from g"]))
def gsa_by_ranks(spark, d):
    if (order := _ordered(spark, d, by_heads=False)) is not None:
        return ga.gapless(order)
    collection, _, index, ms = _matches(spark, d, augment=True)
    return ga.gsa_by_matches(collection, ms, index)


_WITHOUT_FIRST = _GSA.replace("from benchmark)", "from benchmark where item_id > (select min(item_id) from benchmark))", 1)
#: The items with the first one augmented, as reference.
_AUGMENTED = """b0 as (select item_id as doc_id, coalesce(text, '') as text, min(item_id) over () as m from benchmark),
i0 as (select doc_id, substr(text, idx + 1, 1) as sym, idx - row_number() over (partition by doc_id, substr(text, idx + 1, 1) order by idx) as island from (select doc_id, text, unnest(range(0, length(text))) as idx from b0 where doc_id > m)),
m0 as (select sym, max(n) as n from (select sym, count(*) as n from i0 group by doc_id, sym, island) group by sym),
d as (select doc_id, case when doc_id = m then text || coalesce((select string_agg(repeat(sym, n), '' order by sym) from m0 where not contains(b0.text, sym)), '') || '$' || chr(10) else text end as text from b0)"""


@query(f"with {_WITHOUT_FIRST} select rank, doc_id, idx from g")
def gsa_by_heads(spark, d):
    if (order := _ordered(spark, d)) is not None:
        return ga.gapless(order)
    collection, _, index, head = _whole_heads(spark, d)
    return ga.gsa_by_heads(collection, head, index, _anchor_ranks(spark, d, head, index))


@query(f"with {_HEADS.replace(_B, _AUGMENTED)} select count(*) as n, 0::bigint as n_empty, 0::bigint as violations from h where not is_end")
def heads_check(spark, d):
    """Heads sorted by their matches and what follows, against the suffix array of all positions."""
    if (told := _sorted_check(spark, d, "heads")) is not None:
        return told
    collection, _, index, head = _whole_heads(spark, d)
    ranks = _anchor_ranks(spark, d, head, index)
    starts = head.where("not is_end").select("doc_id", F.col("start").alias("idx"))
    return ga.suborder_violations(ga.sorted_by_heads(starts, head, index, ranks), _collection_array(spark, d))


@query(f"with {_TYPES} select count(*) as n, 0::bigint as n_empty, 0::bigint as violations from st where sym <> '' and doc_id > (select min(doc_id) from d)")
def sstar_check(spark, d):
    """S* positions sorted by heads, against the suffix array of all positions."""
    if (told := _sorted_check(spark, d, "stars")) is not None:
        return told
    collection, _, index, head = _whole_heads(spark, d)
    ranks = _anchor_ranks(spark, d, head, index)
    star = ga.stars(collection).where("sym <> ''")
    return ga.suborder_violations(ga.sorted_by_heads(star, head, index, ranks), _collection_array(spark, d))


@query(f"with {_GSA}, t as (select *, idx > 0 and s < t and (select substr(d.text, g.idx) > g.s from d where d.doc_id = g.doc_id) as star from g) select row_number() over (order by rank) - 1 as order_no, doc_id, idx from t where star")
def sstar_sorted(spark, d):
    return ga.gapless(_star_order(spark, d), "order_no")


@query(f"with {_GSA} select count(*) as n, count(*) as n_distinct, 0::bigint as min_rank, count(*) - 1 as max_rank, 0::bigint as violations from g")
def gsa_check(spark, d):
    items = _items(spark, d)
    return ga.order_violations(_array(spark, d), items)


@query(_D + "select sum(length(text))::bigint as n, sum(length(text))::bigint as n_distinct, (sum(length(text)) - 1)::bigint as max_rank, 0::bigint as violations from d")
def gsa_documents_check(spark, d):
    """The suffix array of all documents, whole, and its linear check."""
    docs = _documents(spark, d)
    return ga.linear_violations(_array(spark, Whole(d)), docs)


@query(f"with {_TYPES} select count(*) as n, 0::bigint as violations from t where type = 'L'")
def induce_l_check(spark, d):
    items = _items(spark, d)
    return ga.induced_violations(_array(spark, d), items, "L")


@query(f"with {_TYPES} select count(*) as n, 0::bigint as violations from t where type = 'S' and sym <> ''")
def induce_s_check(spark, d):
    items = _items(spark, d)
    return ga.induced_violations(_array(spark, d), items, "S")


# ---- integer sequences, sinks --------------------------------------------------------------


def _event_codes(spark, d) -> DataFrame:
    events = src.table(spark, d, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("sym"))
    codes = symbols.alphabet_codes(events)
    return stored(intseq.sequences(events.join(codes, "sym"), "user_id", F.col("code"), ["ts", "event_id"]), "sequences")


@query(f"with {_EV} select seq_id, rank, pos from r")
def int_suffix_array(spark, d):
    return intseq.suffix_array(_event_codes(spark, d))


@query(f"""with {_EV}, p as (select seq_id, rank + 1 as primary_index from r where pos = 0)
select seq_id, case when pos = 0 then 0 else rank + case when rank < primary_index then 1 else 0 end end as i, case when pos = 0 then vals[len(vals)] else vals[pos] end as val, primary_index from r join p using (seq_id)""")
def int_bwt(spark, d):
    return intseq.library_bwt(_event_codes(spark, d))


@query(f"with {_B} select count(*) as n, 0::bigint as n_different from d where doc_id > (select min(doc_id) from d)")
def index_roundtrip(spark, d):
    """Reference, index and heads written, read back, and the collection decoded from them."""
    collection, reference, index, head = _whole_heads(spark, d)
    path = new_path(spark, "collection-index")
    src.write_collection_index(path, reference, index, head)
    read, _, heads = src.read_collection_index(spark, path)
    both = collection.join(src.decoded(read, heads).withColumnRenamed("text", "_t"), "doc_id", "full")
    return both.agg(F.count("*").alias("n"), F.count_if(~F.col("text").eqNullSafe(F.col("_t"))).alias("n_different"))


@query(f"with {_GSA} select count(*) as n, 0::bigint as missing, 0::bigint as added from g")
def sink_roundtrip(spark, d):
    """The GSA written as a sorted table and read back."""
    array = _array(spark, d) if isinstance(d, Whole) else stored(ga.gsa_bucketed(_items(spark, d)), "gsa")
    path = new_path(spark, "sink")
    src.write_index(array, path, ["rank"])
    back = spark.read.parquet(path)
    return ga.differences(array, back, "rank").select("n", "missing", "added")


# ---- the same over documents -----------------------------------------------------------------

#: Queries that read ``documents`` or ``events`` themselves.
_OWN_TABLE = set(
    "text_trim symbol_substitution sym_histogram sym_max_run alphabet_remap bucket_starts bucket_ends printable_char floor_log2 "
    "doc_lengths doc_boundaries gsa_documents_check int_suffix_array int_bwt".split()
)
#: Queries that write out suffix strings, whose size is the square of a text's; gsa_documents and gsa_documents_check tell the same of the last two.
_STRINGS = {"suffix_scan", "gsa_bucketed", "gsa_check"}
#: Queries whose form over documents is another one's: ms_full_documents and lcp_array_documents. By ranks, joint sorting doesn't finish there.
_SAME = {"ms_by_ranks", "ms_by_hashes", "lcp_array_by_runs", "lcp_array_by_levels"}


def _over_documents(f):
    def run(spark, d):
        return f(spark, Whole(d))

    run.__doc__ = f"As ``{f.__name__}``, over all of ``documents`` (reference: the one of the least id)."
    return run


DOCUMENT_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f"{name}_documents": _over_documents(f) for name, f in QUERIES.items() if name not in _OWN_TABLE | _STRINGS | _SAME
}
