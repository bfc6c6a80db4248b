"""Windows inside cells: one long string, many documents of one ending, and sequences that many share."""

import itertools

import pytest

from corpusloom.operators import gsa, matchstats, predecessor, ranking
from pyspark.sql import functions as F

#: Longer than some cells, with a run over a cell's edge.
LONG = "ab" * 1000 + "n" * 5000 + "ba" * 900 + "n" * 3


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, LONG), (2, "n"), (3, ""), (4, None), (5, "né🎉🎉n")], "doc_id long, text string")


def test_types_and_sstar_of_a_long_string(docs):
    text, kind = LONG + "\0", ["S"]
    for a, b in zip(LONG[::-1], text[::-1]):
        kind.append("S" if a < b else "L" if a > b else kind[-1])
    kind.reverse()
    typed = gsa.types(docs)
    got = {(r.doc_id, r.idx): r.type for r in typed.collect()}
    assert [got[1, i] for i in range(len(text))] == kind
    assert got[3, 0] == got[4, 0] == "S" and len(got) == sum(n + 1 for n in (len(LONG), 1, 0, 0, 5))
    star = sorted(r.idx for r in gsa.s_star(typed).collect() if r.doc_id == 1)
    assert star == [i for i in range(1, len(text)) if kind[i] == "S" and kind[i - 1] == "L"]


def test_symbol_runs_over_cells(docs):
    got = {(r.doc_id, r.idx): r.len for r in matchstats.symbol_runs(docs, "n").collect()}
    want = {}
    for d, t in {1: LONG, 2: "n", 5: "né🎉🎉n"}.items():
        want |= {(d, i): len(list(itertools.takewhile(lambda c: c == "n", t[i:]))) for i in range(len(t)) if t[i] == "n"}
    assert got == want


def test_predecessors_over_cells(spark):
    keys = [0, 5000, 5001, 20000]
    asked = [0, 1, 4096, 5000, 5001, 9000, 20000, 30000]
    k = spark.createDataFrame([(1, x) for x in keys], "doc_id long, key long")
    q = spark.createDataFrame([(1, x) for x in asked] + [(2, 7)], "doc_id long, q long")
    got = {(r.doc_id, r.q): (r.pred, r.succ) for r in predecessor.pred_succ(q, k).collect()}
    want = {(1, x): (max((y for y in keys if y <= x), default=None), min((y for y in keys if y >= x), default=None)) for x in asked}
    assert got == want | {(2, 7): (None, None)}


def test_sequences_that_many_documents_share(spark):
    """Equal sequences, prefixes and one first phrase of all: documents are told apart by sequence, then by id."""
    kinds = [[(4, 2)], [(4, 2), (1, 3)], [(4, 2), (1, 3), (9, 1)], [(4, 2), (1, 2)], [(4, 1), (4, 1), (4, 1)]]
    seq = {d: kinds[d % 5] for d in range(6000)}
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.posexplode(F.get(F.array(*[F.array(*[F.struct(F.lit(p).cast("long").alias("pos"), F.lit(n).cast("long").alias("len")) for p, n in x]) for x in kinds]), (F.col("id") % 5).cast("int"))).alias("k", "x"))
    head = rows.select("doc_id", (F.col("k") + 1).cast("long").alias("head_id"), F.col("k").cast("long").alias("start"), "x.pos", "x.len", F.lit(False).alias("is_end"))
    got = [(r.doc_id, r.n_phrases) for r in sorted(matchstats.phrase_sequences(head).collect(), key=lambda r: r.order_no)]
    assert got == [(d, len(seq[d])) for d in sorted(seq, key=lambda d: (seq[d], d))]


def test_ten_thousand_documents_of_one_ending(spark):
    """Suffixes that all documents end with are numbered by document, and no window holds more than a cell of them."""
    n = 10_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.chr((F.col("id") % 3 + 97)), F.lit(" e.")).alias("text"))
    assert ranking.DOCUMENTS < n
    want = sorted((f"{'abc'[d % 3]} e."[i:], d, i) for d in range(n) for i in range(4))
    got = sorted(gsa.gsa(docs).collect(), key=lambda r: r.rank)
    assert [(r.doc_id, r.idx) for r in got] == [(d, i) for _, d, i in want] and [r.rank for r in got] == list(range(4 * n))
