"""The small fixture, known by heart, and edge cases by brute force."""

from itertools import product

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import gsa, intseq, matchstats, predecessor, refindex, symbols

REFERENCE = "ACGTACGGT"
DOCS = {1: "ACGTTCGG", 2: "TACGGNACG", 3: "CGTACGGT"}
AUGMENTED = "ACGTACGGTN$\n"


def collection(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string")


def refs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "ref_id long, text string")


def suffix_order(docs):
    return [(i, d) for _, d, i in sorted((t[i:], d, i) for d, t in docs.items() for i in range(len(t)))]


@pytest.fixture(scope="module")
def golden(spark):
    ref = symbols.augmented(refs(spark, REFERENCE), collection(spark, DOCS)).cache()
    index = refindex.with_lcp(refindex.suffix_array(ref), ref).cache()
    ms = matchstats.matching_statistics(collection(spark, DOCS), ref).cache()
    return ref, index, ms


def test_augmented_reference(spark, golden):
    assert golden[0].first().text == AUGMENTED
    assert {r.sym: r.max_run for r in symbols.max_runs(collection(spark, DOCS)).collect()} == {"A": 1, "C": 1, "G": 2, "N": 1, "T": 2}


def test_index_tables(spark, golden):
    ref, index, _ = golden
    rows = index.orderBy("rank").collect()
    assert [r.pos for r in rows] == [11, 10, 4, 0, 5, 1, 6, 2, 7, 9, 3, 8]
    assert [r.lcp for r in rows] == [0, 0, 0, 3, 0, 2, 0, 1, 2, 0, 0, 1]
    assert "".join(r.sym for r in refindex.bwt(index, ref).orderBy("rank").collect()) == "$NT\nAACCGTGG"
    near = refindex.psv_nsv(index).orderBy("rank").collect()
    assert [(r.psv, r.nsv) for r in near] == [(None, None)] * 3 + [(2, 4), (None, None), (4, 6), (None, None), (6, 9), (7, 9), (None, None), (None, None), (10, None)]
    assert [r.plcp_max for r in refindex.with_plcp_max(index).orderBy("pos").collect()] == [3, 2, 2, 1, 3, 2, 1, 2, 1, 0, 0, 0]
    assert {r.sym: r.c for r in refindex.c_array(refindex.bwt(index, ref)).collect()} == {"\n": 0, "$": 1, "A": 2, "C": 4, "G": 6, "N": 9, "T": 10}
    patterns = spark.createDataFrame([(p,) for p in ("A", "ACG", "CG", "GT", "TT")], "pattern string")
    assert {r.pattern: r.n for r in refindex.backward_search(refindex.bwt(index, ref), patterns, 3).collect()} == {"A": 2, "ACG": 2, "CG": 2, "GT": 2, "TT": 0}


GOLDEN_MS = {
    1: [(0, 4, 0), (1, 3, 0), (7, 2, 0), (8, 1, 0), (8, 1, 1), (5, 3, 1), (6, 2, 1), (6, 1, 1)],
    2: [(3, 5, 1), (4, 4, 1), (5, 3, 1), (6, 2, 1), (2, 1, 1), (9, 1, 0), (4, 3, 1), (5, 2, 1), (6, 1, 1)],
    3: [(1, 8, 1), (2, 7, 1), (3, 6, 1), (4, 5, 1), (5, 4, 1), (6, 3, 1), (2, 2, 1), (3, 1, 1)],
}
GOLDEN_HEADS = {1: [0, 2, 4, 5, 7, 8], 2: [0, 4, 5, 6, 9], 3: [0, 6, 8]}


def test_matching_statistics_and_heads(spark, golden):
    ref, index, ms = golden
    got = {d: [None] * len(t) for d, t in DOCS.items()}
    for r in ms.collect():
        got[r.doc_id][r.idx] = (r.pos, r.len, int(r.smaller))
    assert got == GOLDEN_MS
    head = matchstats.heads(ms, collection(spark, DOCS), ref).cache()
    starts = {d: [] for d in DOCS}
    for r in head.orderBy("doc_id", "start").collect():
        starts[r.doc_id].append(r.start)
        assert not r.is_end or (r.pos, r.len) == (11, 0)
    assert starts == GOLDEN_HEADS
    asked = symbols.positions(collection(spark, DOCS)).select("doc_id", "idx")
    for r in predecessor.head_of(asked, head).collect():
        assert r.head_start == max(s for s in GOLDEN_HEADS[r.doc_id] if s <= r.idx)
    for r in predecessor.pred_succ(asked.select("doc_id", F.col("idx").alias("q")), head.select("doc_id", F.col("start").alias("key"))).collect():
        assert r.pred == max(s for s in GOLDEN_HEADS[r.doc_id] if s <= r.q) and r.succ == min(s for s in GOLDEN_HEADS[r.doc_id] if s >= r.q)


def test_types_and_gsa(spark, golden):
    ref, index, _ = golden
    docs = collection(spark, DOCS)
    types = {d: "" for d in DOCS}
    for r in gsa.types(docs).orderBy("doc_id", "idx").collect():
        types[r.doc_id] += r.type
    assert types == {1: "SSSLLSLLS", 2: "LSSSSLSSLS", 3: "SSLSSSSLS"}
    assert sorted((r.doc_id, r.idx) for r in gsa.s_star(gsa.types(docs)).collect()) == [(1, 5), (1, 8), (2, 1), (2, 6), (2, 9), (3, 3), (3, 8)]
    want = [(6, 2), (1, 2), (3, 3), (0, 1), (7, 2), (5, 1), (2, 2), (4, 3), (0, 3), (1, 1), (7, 1), (8, 2), (6, 1), (3, 2), (5, 3), (4, 2), (6, 3), (1, 3), (2, 1), (5, 2), (7, 3), (0, 2), (2, 3), (4, 1), (3, 1)]
    for array in (gsa.gsa(docs), gsa.gsa_bucketed(docs), gsa.gsa_by_matches(docs, matchstats.matching_statistics(docs, ref), index)):
        assert [(r.idx, r.doc_id) for r in array.orderBy("rank").collect()] == want
    array = gsa.gsa(docs).cache()
    assert gsa.order_violations(array, docs).first().violations == 0
    assert [gsa.induction_violations(array, gsa.types(docs), k).first().violations for k in "LS"] == [0, 0]
    assert gsa.sa_violations(index, ref).first().violations == 0


def test_checks_see_errors(spark):
    docs = collection(spark, {1: "banana"})
    wrong = gsa.gsa(docs).withColumn("rank", F.when(F.col("rank") == 0, 5).when(F.col("rank") == 5, 0).otherwise(F.col("rank")))
    assert gsa.order_violations(wrong, docs).first().violations > 0
    assert gsa.linear_violations(wrong, docs).first().violations > 0
    ref = refs(spark, "banana")
    index = refindex.suffix_array(ref).withColumn("rank", 5 - F.col("rank"))
    assert gsa.sa_violations(index, ref).first().violations > 0


def test_integer_sequences(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([2, 1, 3, 1, 3, 1])], "seq_id long, pos long, val long")
    sa = intseq.suffix_array(rows).cache()
    assert [r.pos for r in sa.orderBy("rank").collect()] == [5, 3, 1, 0, 4, 2]
    out = intseq.bwt(rows, sa).orderBy("i").collect()
    assert [r.val for r in out] == [1, 3, 3, 2, 1, 1] and out[0].primary_index == 4


EDGES = {1: "", 2: "a", 3: "aaaaaaaa", 4: "banana", 5: "banana", 6: "ban", 7: "a!# $%\n", 8: "né🎉né", 9: "NNNN", 10: "ab" * 700}


def test_edge_documents(spark):
    docs = collection(spark, EDGES)
    want = suffix_order(EDGES)
    assert [(r.idx, r.doc_id) for r in gsa.gsa(docs).orderBy("rank").collect()] == want
    assert tuple(gsa.linear_violations(gsa.gsa(docs), docs).first()) == (len(want), len(want), len(want) - 1, 0)
    ref = symbols.augmented(refs(spark, "banana"), docs).cache()
    index = refindex.with_lcp(refindex.suffix_array(ref), ref).cache()
    levels = refindex.index_by_levels(ref)
    assert sorted(levels.collect()) == sorted(index.collect())
    by_text, by_rank = matchstats.matching_statistics(docs, ref), matchstats.matching_statistics_by_ranks(docs, ref)
    assert sorted(by_text.collect()) == sorted(by_rank.select(*by_text.columns).collect())
    assert [(r.idx, r.doc_id) for r in gsa.gsa_by_matches(docs, matchstats.matching_statistics(docs, ref), index).orderBy("rank").collect()] == want
    text = ref.first().text
    for r in matchstats.matching_statistics(docs, ref).collect():
        s = EDGES[r.doc_id][r.idx :]
        best = max(n for n in range(len(s) + 1) if s[:n] in text)
        assert r.len == best and text[r.pos : r.pos + best] == s[:best] and r.smaller == (s <= text[r.pos :])


def test_exhaustive_binary_strings(spark):
    texts = ["".join(p) for n in range(1, 8) for p in product("ab", repeat=n)]
    ref = refs(spark, *texts).cache()
    sa = refindex.suffix_array(ref).cache()
    got = {}
    for r in sa.orderBy("ref_id", "rank").collect():
        got.setdefault(r.ref_id, []).append(r.pos)
    assert got == {k: sorted(range(len(t)), key=lambda i: t[i:]) for k, t in enumerate(texts)}
    assert all(r.violations == 0 for r in gsa.sa_violations(sa, ref).collect())
    out = {}
    for r in refindex.bwt_library(sa, ref).orderBy("ref_id", "i").collect():
        out.setdefault(r.ref_id, []).append((r.sym, r.primary_index))
    for k, t in enumerate(texts):
        order = got[k]
        p = order.index(0) + 1
        u = [t[-1]] + [t[i - 1] for i in order[: p - 1]] + [t[i - 1] for i in order[p:]]
        assert out[k] == [(c, p) for c in u]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab$ é", max_size=12), min_size=1, max_size=6), st.text("ab$ é", min_size=1, max_size=12))
def test_random_collections(spark, texts, reference):
    docs = dict(enumerate(texts, 1))
    if not any(texts):
        return
    frame = collection(spark, docs)
    ref = symbols.augmented(refs(spark, reference), frame).cache()
    index = refindex.with_lcp(refindex.suffix_array(ref), ref).cache()
    want = suffix_order(docs)
    assert [(r.idx, r.doc_id) for r in gsa.gsa_bucketed(frame).orderBy("rank").collect()] == want
    assert [(r.idx, r.doc_id) for r in gsa.gsa_by_matches(frame, matchstats.matching_statistics(frame, ref), index).orderBy("rank").collect()] == want


def test_text_functions(spark):
    rows = spark.createDataFrame([("abc$\n", "abd"), ("", "x"), (None, "x"), ("xy\r", "xyz" * 2000), ("xyz" * 2000, "xyz" * 2000)], "a string, b string")
    got = rows.select(tx.trim_terminators(F.col("a")), tx.lcp(F.col("a"), F.col("b")), tx.substitute_separators(F.lit("a%X")), tx.prefix_less(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("abc", 2, "a$$", True), ("", 0, "a$$", False), (None, None, "a$$", None), ("xy", 2, "a$$", True), ("xyz" * 2000, 6000, "a$$", False)]
    pictures = spark.createDataFrame([(c,) for c in " \n\r\tA\x01é€"], "c string").select(tx.printable(F.col("c"))).collect()
    assert [r[0] for r in pictures] == ["\\s", "\\n", "\\l", "\\t", " A", "01", "e9", "20ac"]
    logs = spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 4, 2**40 - 1, 2**40)], "v long").select(tx.floor_log2(F.col("v"))).collect()
    assert [r[0] for r in logs] == [0, 0, 1, 1, 2, 39, 40]


def test_smaller_values_across_blocks(spark):
    import random

    rng = random.Random(4)
    values = [rng.randint(0, 60) for _ in range(1500)]
    index = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "ref_id long, rank long, lcp long")
    for r in refindex.psv_nsv(index).collect():
        before = [j for j in range(r.rank) if values[j] < r.lcp]
        after = [j for j in range(r.rank + 1, 1500) if values[j] < r.lcp]
        assert r.psv == (before[-1] if before else None) and r.nsv == (after[0] if after else None)
