"""Sorting by heads, searches in indexes, backward matching, folders and timers, against brute force."""

import io

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom import progress
from corpusloom.operators import backward, gsa, matchstats, ranking, refindex, symbols
from corpusloom.sources import collections as src
from corpusloom.storage import stored

DOCS = {1: "ACGTTCGG", 2: "TACGGNACG", 3: "CGTACGGT", 4: "", 5: "ACGTACGGTACGTACGGT" * 6, 6: "ACGTACGGTACGTACGGT" * 6, 7: "G", 8: "né🎉 $%", 9: "%a%", 10: "%%"}


def table(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string")


@pytest.fixture(scope="module")
def parts(spark):
    docs = table(spark, DOCS)
    ref = stored(symbols.augmented(spark.createDataFrame([(0, "ACGTACGGT")], "ref_id long, text string"), docs, ""), "reference")
    index = stored(refindex.with_lcp(refindex.suffix_array(ref), ref), "index")
    return docs, ref, index, stored(matchstats.heads(matchstats.matching_statistics(docs, ref), docs, ref), "heads")


def order_of(docs, asked):
    return [(d, i) for _, d, i in sorted((docs[d][i:], d, i) for d, i in asked)]


def test_sorting_works_in_heads(spark, parts):
    docs, _, index, head = parts
    counts = []
    ranks = stored(gsa.anchor_ranks(head, index, counts), "ranks")
    # no round has more rows than there are heads, far fewer than positions
    assert set(counts) == {head.count()} and counts[0] < sum(map(len, DOCS.values()))
    everywhere = [(d, i) for d, t in DOCS.items() for i in range(len(t))]
    got = [(r.doc_id, r.idx) for r in gsa.gsa_by_heads(docs, head, index).orderBy("rank").collect()]
    assert got == order_of(DOCS, everywhere)
    starts = head.where("not is_end").select("doc_id", F.col("start").alias("idx"))
    got = [(r.doc_id, r.idx) for r in gsa.sorted_by_heads(starts, head, index, ranks).orderBy("order_no").collect()]
    assert got == order_of(DOCS, [(r.doc_id, r.idx) for r in starts.collect()])


def test_checks_of_sorted_positions_see_errors(spark, parts):
    docs, _, index, head = parts
    ranks = stored(gsa.anchor_ranks(head, index), "ranks")
    star = stored(gsa.sorted_by_heads(gsa.s_star(gsa.types(docs)).where("sym <> ''"), head, index, ranks), "star")
    array = stored(gsa.gsa(docs), "gsa")
    n = star.count()
    assert tuple(gsa.suborder_violations(star, array).first()) == (n, 0, 0)
    swapped = star.withColumn("order_no", F.when(F.col("order_no") == 0, n - 1).when(F.col("order_no") == n - 1, 0).otherwise(F.col("order_no")))
    assert gsa.suborder_violations(swapped, array).first().violations > 0
    assert gsa.suborder_violations(star.withColumn("doc_id", F.when(F.col("order_no") == 1, 99).otherwise(F.col("doc_id"))), array).first().n_empty == 1


def test_no_window_holds_a_whole_group(spark, monkeypatch):
    """Groups larger than a window may hold are refined from counts in spans, with equal results."""
    rng = np.random.default_rng(1)
    docs = {k: "".join(rng.choice(["a", "b"], 300, p=[0.9, 0.1])) for k in range(4)} | {9: "a" * 200}
    want = order_of(docs, [(d, i) for d, t in docs.items() for i in range(len(t))])
    monkeypatch.setattr(ranking, "SPAN", 16)
    plan = ranking.refined(spark.range(10).select(F.lit(0).alias("r"), "id"), "id", None, 10)._jdf.queryExecution().toString()
    assert "rank(" in plan
    plan = ranking.refined(spark.range(10).select(F.lit(0).alias("r"), "id"), "id", None, 17)._jdf.queryExecution().toString()
    assert "rank(" not in plan and "_c" in plan
    got = [(r.doc_id, r.idx) for r in gsa.gsa(table(spark, docs)).orderBy("rank").collect()]
    assert got == want


def test_running_sums_and_carried_values(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SPAN", 8)
    rng = np.random.default_rng(3)
    keys = sorted(rng.choice(200, 60, replace=False).tolist())
    rows = [(k, int(rng.integers(0, 5)), None if rng.random() < 0.6 else k * 10) for k in keys]
    df = spark.createDataFrame(rows, "key long, n long, v long")
    for r in ranking.running(df, "key", "n", "before").collect():
        assert r.before == sum(n for k, n, _ in rows if k < r.key)
    for back in (False, True):
        for r in ranking.carried(df, "key", {"x": "v"}, back).collect():
            seen = [v for k, _, v in rows if v is not None and (k > r.key if back else k < r.key)]
            assert r.x == ((seen[0] if back else seen[-1]) if seen else None)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60))
def test_smaller_values_and_range_minima(spark, values):
    old, refindex.BLOCK = refindex.BLOCK, 3
    try:
        index = spark.createDataFrame([(0, k, k, v) for k, v in enumerate(values)], "ref_id long, rank long, pos long, lcp long")
        for r in refindex.psv_nsv(index).collect():
            before = [k for k in range(r.rank) if values[k] < r.lcp]
            after = [k for k in range(r.rank + 1, len(values)) if values[k] < r.lcp]
            assert (r.psv, r.nsv) == (before[-1] if before else None, after[0] if after else None)
        asked = spark.createDataFrame([(0, k, k, min(len(values) - 1, k + 7 * k % 50)) for k in range(len(values))], "ref_id long, id long, lo long, hi long")
        for r in refindex.range_minimum(index, asked, ["id"]).collect():
            assert r.min_lcp == min(values[r.lo : r.hi + 1])
    finally:
        refindex.BLOCK = old


TEXTS = ["banana", "abracadabra", "a", "aaaa", "mississippi", "na ban"]


def test_backward_matching_and_search(spark):
    docs = table(spark, {1: "bananas nab", 2: "", 3: "ssissim aaaaab", 4: "zzz", 5: "cadabrac"})
    for text in TEXTS:
        ref = spark.createDataFrame([(0, text)], "ref_id long, text string")
        index = stored(refindex.with_lcp(refindex.suffix_array(ref), ref), "index")
        order = sorted(range(len(text)), key=lambda i: text[i:])
        rows = backward.backward_matching(docs, ref, index).collect()
        bodies = {r.doc_id: r.text for r in docs.collect()}
        assert len(rows) == sum(map(len, bodies.values()))
        for r in rows:
            s = bodies[r.doc_id][r.idx :]
            best = max(n for n in range(len(s) + 1) if s[:n] in text)
            inside = [k for k, p in enumerate(order) if text[p:].startswith(s[:best])]
            assert (r.len, r.lo, r.hi) == (best, inside[0], inside[-1]), (text, s)
    refs = spark.createDataFrame([(k, t + "\0") for k, t in enumerate(TEXTS)], "ref_id long, text string")
    patterns = ["a", "an", "nan", "ana", "ss", "issi", "aa", "q", "nb"]
    rows = refindex.backward_search(refindex.bwt(refindex.suffix_array(refs), refs), spark.createDataFrame([(p,) for p in patterns], "pattern string"), 4).collect()
    for r in rows:
        t = TEXTS[r.ref_id]
        assert r.n == sum(t.startswith(r.pattern, i) for i in range(len(t))), (t, r.pattern)
    assert len(rows) == len(TEXTS) * len(patterns)


def test_long_references_are_refused(spark, parts, monkeypatch):
    docs, ref, index, _ = parts
    monkeypatch.setattr(backward, "MOST_SYMBOLS", 5)
    with pytest.raises(ValueError):
        backward.backward_matching(docs, ref, index)


def test_outcomes_of_broken_arrays(spark):
    ref = spark.createDataFrame([(0, "banana"), (1, "")], "ref_id long, text string")
    right = [5, 3, 1, 0, 4, 2]
    cases = {0: right, -1: right[:-1], -2: [5, 3, 1, 0, 4, 6], -3: [5, 3, 0, 1, 4, 2], -4: [3, 5, 1, 0, 4, 2]}
    for want, order in cases.items():
        index = spark.createDataFrame([(0, k, p) for k, p in enumerate(order)], "ref_id long, rank long, pos long")
        assert {r.ref_id: r.outcome for r in gsa.sa_outcome(index, ref).collect()} == {0: want, 1: 0}


def test_folders_restore_the_collection(spark, parts, tmp_path):
    docs, ref, index, head = parts
    src.write_collection_index(str(tmp_path / "x"), ref, index, head)
    read, again, heads = src.read_collection_index(spark, str(tmp_path / "x"))
    assert {r.doc_id: r.text for r in src.decoded(read, heads).collect()} == DOCS
    assert sorted(again.collect()) == sorted(index.collect()) and sorted(map(tuple, heads.collect())) == sorted(map(tuple, head.select(*heads.columns).collect()))


def test_runs_mismatches_and_sequences(spark, parts):
    docs, ref, index, head = parts
    text = ref.first().text
    ms = stored(matchstats.matching_statistics(docs, ref), "ms")
    for r in matchstats.with_mismatch(ms, docs).collect():
        assert r.mismatch == DOCS[r.doc_id][r.idx + r.len : r.idx + r.len + 1]
    for r in matchstats.with_runs(ms, docs, ref, "G").collect():
        s = DOCS[r.doc_id][r.idx :]
        if s[0] == "G":
            assert (r.pos, r.len, r.smaller) == (len(text), len(s) - len(s.lstrip("G")), False)
    phrases = {}
    for r in head.where("not is_end").orderBy("doc_id", "start").collect():
        phrases.setdefault(r.doc_id, []).append((r.pos, r.len))
    got = [(r.doc_id, r.n_phrases) for r in matchstats.phrase_sequences(head).orderBy("order_no").collect()]
    assert got == [(d, len(phrases[d])) for d in sorted(phrases, key=lambda d: (phrases[d], d))]
    once = matchstats.unambiguous(head, index).first()
    matched = [(DOCS[r.doc_id][r.start : r.start + r.len]) for r in head.where("not is_end and len > 0").collect()]
    assert tuple(once) == (len(matched), sum(sum(text.startswith(m, i) for i in range(len(text))) == 1 for m in matched))


def test_timed_stages_and_stream_progress(spark, parts):
    docs = parts[0]
    array, seconds = progress.timed_sort(docs, spark.createDataFrame([(0, "ACGTACGGT")], "ref_id long, text string"))
    assert array.count() == sum(map(len, DOCS.values())) and all(wall > 0 and cpu >= 0 for wall, cpu in seconds.values()) and "sort heads" in seconds
    out = io.StringIO()
    listener = progress.Progress(every=10, out=out)

    class Told:
        def __init__(self, rows):
            self.progress = type("P", (), {"id": "q", "name": "n", "numInputRows": rows})

    for rows in (4, 4, 4, 9):
        listener.onQueryProgress(Told(rows))
    assert out.getvalue() == "n: 12 rows\nn: 21 rows\n"
