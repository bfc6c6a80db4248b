"""Faults that a review found: each test failed before its fix."""

import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import anchored, backward, gsa, intseq, matchstats, ownindex, predecessor, symbols
from corpusloom.plans import registry
from corpusloom.sources import collections


def folder_of(spark, at, texts):
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows.write.parquet(f"{at}/documents.parquet")
    rows.withColumnRenamed("doc_id", "item_id").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.mark.parametrize("form", ["", "_documents"])
def test_matches_told_from_heads_after_an_empty_match(spark, tmp_path, form):
    """Z matches nothing and is placed one before the match of what follows it."""
    folder, queries = folder_of(spark, str(tmp_path), {1: "abcd", 2: "Zbcd", 3: "dZbc"}), registry.QUERIES | registry.DOCUMENT_QUERIES
    want = {(r.doc_id, r.idx, r.pos, r.len) for r in queries["ms_full" + form](spark, folder).collect()}
    assert {(2, 0, 0, 0), (2, 1, 1, 3)} < want
    assert {tuple(r) for r in queries["ms_from_heads" + form](spark, folder).collect()} == want


@pytest.mark.parametrize("name", ["sstar", "sstar_per_symbol", "ms_n_runs", "ref_augment", "ls_types"])
def test_what_a_text_tells_by_itself_is_not_shuffled(spark, tmp_path, name):
    folder = folder_of(spark, str(tmp_path), {1: "banana", 2: "nab🎉", 3: None, 4: "", 5: "bb\0an"})
    frame = registry.DOCUMENT_QUERIES[name + "_documents"](spark, folder)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and "SortMergeJoin" not in plan
    assert sorted(map(repr, frame.collect())) == sorted(map(repr, registry.QUERIES[name](spark, folder).collect()))


def test_lacking_symbols_are_added_by_their_longest_run(spark, tmp_path):
    folder = folder_of(spark, str(tmp_path), {1: "banana", 2: "nab🎉🎉", 3: None, 5: "bb\0an"})
    got = {r.ref_id: r.text for r in registry.DOCUMENT_QUERIES["ref_augment_documents"](spark, folder).collect()}
    assert got == {1: "banana\0🎉🎉$\n", 2: "nab🎉🎉\0$\n", 3: "\0abbn🎉🎉$\n", 5: "bb\0an🎉🎉$\n"}


OWN = ["suffix_array", "inverse_sa", "lcp_array", "avg_lcp", "bwt", "bwt_primary_index", "c_array", "backward_search_count", "lcp_interval", "interval_bound_search", "bound_insertion", "bound_search_anywhere"]


@pytest.mark.parametrize("name", OWN)
def test_short_references_tell_their_index_themselves(spark, tmp_path, monkeypatch, name):
    """As over items, with one reference beyond the length that one task may take."""
    folder = folder_of(spark, str(tmp_path), {1: "banana bandana", 2: "nab🎉\0ae", 3: None, 4: "", 5: "a" * 40, 6: "e the tion Zinging"})
    frame = registry.DOCUMENT_QUERIES[name + "_documents"](spark, folder)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    want = sorted(map(repr, registry.QUERIES[name](spark, folder).collect()))
    assert sorted(map(repr, frame.collect())) == want
    if name in ("bwt", "bound_search_anywhere"):
        monkeypatch.setattr(ownindex, "MOST", 14)
        assert sorted(map(repr, registry.DOCUMENT_QUERIES[name + "_documents"](spark, folder).collect())) == want


@pytest.mark.parametrize("after_empty", [False, True])
def test_heads_told_from_texts(spark, after_empty):
    texts = {2: "Zbcd", 3: None, 4: "", 5: "bcabcaZZabcd", 6: "dcba🎉a" * 3}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    ref = spark.createDataFrame([(1, "abcdabca")], "ref_id long, text string")
    index = ownindex.index(ref)
    ms = matchstats.matching_statistics(docs, ref)
    assert sorted(map(repr, backward.matching(docs, ref, index).collect())) == sorted(map(repr, ms.collect()))
    frame = backward.heads(docs, ref, index, after_empty)
    assert "Window" not in frame._jdf.queryExecution().executedPlan().toString()
    want = matchstats.heads(ms, docs.fillna(""), ref, after_empty)
    assert sorted(map(repr, frame.collect())) == sorted(map(repr, want.collect()))


def test_a_cell_of_heads_is_small():
    """Each position is compared with every head of its cell."""
    assert predecessor.CELL <= 32


@pytest.mark.parametrize("gaps", [(16, 256), (2, 4)])
def test_suffix_order_by_anchors(spark, monkeypatch, gaps):
    """Copies, runs without a mark and texts without any, against sorted suffix strings; only rare marks are ranked by doubling."""
    rnd, rows = random.Random(1), []
    base = "".join(rnd.choice("ab c🎉é") for _ in range(2000))
    texts = [base, base, base[100:], base[:1500], "a" * 2000, "a" * 1500, "", None, "x", "ab" * 900, base[:1000] + "a" * 2500 + base[:700], "b" + "a" * 1499, "\0a\0" * 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(anchored, "GAPS", gaps)
    monkeypatch.setattr(anchored, "chased", lambda marks, old=anchored.chased: old(rows.append(marks.count()) or marks))
    want = sorted((t[i:], d, i) for d, t in enumerate(texts) if t for i in range(len(t)))
    got = sorted((r.rank, r.doc_id, r.idx) for r in gsa.gsa(docs).collect())
    assert got == [(k, d, i) for k, (_, d, i) in enumerate(want)]
    if gaps[1] > 16:
        assert rows[0] < len(want) / 2


def test_arrays_are_checked_where_they_meet_their_texts(spark, monkeypatch):
    """Neighbours in two cells are compared too, and symbols aren't joined by place."""
    docs = spark.createDataFrame([(1, "banana"), (2, "nab🎉"), (3, None), (4, ""), (5, "bb\0an"), (6, "banana")], "doc_id long, text string")
    monkeypatch.setattr(gsa, "NEAR", 4)
    array, typed = gsa.gsa(docs).cache(), gsa.types(docs)
    assert tuple(gsa.linear_violations(array, docs).first()) == (21, 21, 20, 0)
    sizes = [typed.where(F.col("type") == k).where("sym <> ''").count() for k in "LS"]
    assert [tuple(gsa.induced_violations(array, docs, k).first()) for k in "LS"] == [(n, 0) for n in sizes]
    assert "SortMergeJoin" not in gsa.linear_violations(array, docs)._jdf.queryExecution().executedPlan().toString()
    for a in range(0, 20, 3):  # any two neighbours the wrong way round
        wrong = array.withColumn("rank", F.when(F.col("rank") == a, a + 1).when(F.col("rank") == a + 1, a).otherwise(F.col("rank")))
        assert gsa.linear_violations(wrong, docs).first().violations > 0
        assert sum(gsa.induced_violations(wrong, docs, k).first().violations for k in "LS") > 0
    twice = array.union(array.where("rank = 3")).withColumn("rank", F.col("rank"))
    assert tuple(gsa.linear_violations(twice, docs).first())[:3] == (22, 21, 20)
    assert gsa.linear_violations(array.where("rank <> 5"), docs).first().n == 20


def test_documents_are_decoded_in_one_group_each(spark):
    """Heads are neither counted, collected nor told their next start by a window."""
    reference = spark.createDataFrame([(0, "abc🎉$\n")], "ref_id long, text string")
    rows = [(1, 3, 3, None, 5, True), (1, 2, 2, 3, 3, False), (1, 1, 0, 2, 1, False), (2, 1, 0, None, 5, True)]
    heads = spark.createDataFrame(rows, "doc_id long, head_id long, start long, next_start long, pos long, is_end boolean")
    frame = collections.decoded(reference, heads)
    assert {tuple(r) for r in frame.collect()} == {(1, "bc🎉"), (2, "")}
    assert "Aggregate" not in frame._jdf.queryExecution().executedPlan().toString()


def test_short_sequences_sort_themselves(spark, monkeypatch):
    """As by tables, with some sequences beyond the length that one task may take; nothing is ranked by rounds where none is."""
    rnd = random.Random(2)
    rows = [(s, i, rnd.choice((5, -3, 1 << 40))) for s, n in enumerate((1, 7, 30, 90, 60)) for i in range(n)] + [(9, i, 4) for i in range(50)]
    values = spark.createDataFrame(rows, "seq_id long, pos long, val long").cache()
    want = sorted(map(tuple, intseq.bwt(values, intseq._spread_array(values)).collect()))
    for most in (1 << 19, 50):
        monkeypatch.setattr(intseq, "MOST", most)
        assert sorted(map(tuple, intseq.library_bwt(values).collect())) == want
    monkeypatch.setattr(intseq, "MOST", 1 << 19)
    assert "Join" not in intseq.library_bwt(values)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["gsa_by_heads", "gsa_by_ranks", "heads_check", "sstar_check"])
def test_suffix_order_by_ways_of_matches(spark, tmp_path, monkeypatch, name):
    """Copies, runs, document ends that differ and texts of one symbol; only rare places of ways are ranked by doubling, and no head is joined with its places."""
    rnd, rows = random.Random(3), []
    base = "".join(rnd.choice("ab c🎉é") for _ in range(3000))
    texts = [base[:40], base, base, base[100:], "a" * 2500, "a" * 1500, "", None, "x", "ab" * 900, base[:1000] + "a" * 2500 + base[:700], "b" + "a" * 1499, "\0a\0" * 5]
    folder = folder_of(spark, str(tmp_path), dict(enumerate(texts)))
    places = [(t[i:], d, i) for d, t in enumerate(texts) if t and d for i in range(len(t))]
    monkeypatch.setattr(anchored, "chased", lambda marks, old=anchored.chased: old(rows.append(marks.count()) or marks))
    monkeypatch.setattr(gsa, "next_heads", None)
    got = [tuple(r) for r in registry.DOCUMENT_QUERIES[name + "_documents"](spark, folder).collect()]
    if name.startswith("gsa"):
        assert sorted(got) == [(k, d, i) for k, (_, d, i) in enumerate(sorted(places))]
    else:
        docs = registry._collection(spark, registry.Whole(folder))
        asked = gsa.stars(docs).where("sym <> ''") if name == "sstar_check" else registry._whole_heads(spark, registry.Whole(folder))[3].where("not is_end")
        assert got == [(asked.count(), 0, 0)]
    assert rows[0] < len(places) / 3


def test_an_order_is_checked_against_the_array_in_cells(spark, monkeypatch):
    monkeypatch.setattr(gsa, "NEAR", 4)
    array = spark.createDataFrame([(7 * k, 1, k) for k in range(20)], "rank long, doc_id long, idx long")
    order = array.select((F.col("rank") / 7).cast("long").alias("order_no"), "doc_id", "idx")
    assert tuple(gsa.suborder_violations(order, array).first()) == (20, 0, 0)
    for a in (3, 4, 18):  # inside a cell and between two
        wrong = order.withColumn("order_no", F.when(F.col("order_no") == a, a + 1).when(F.col("order_no") == a + 1, a).otherwise(F.col("order_no")))
        assert gsa.suborder_violations(wrong, array).first().violations == 1
    assert tuple(gsa.suborder_violations(order, array.where("idx <> 5")).first())[:2] == (20, 1)



def opcodes(f):
    """How many of Python's own steps ``f`` takes in the index's module."""
    steps = 0

    def seen(frame, event, arg):
        nonlocal steps
        if not frame.f_code.co_filename.endswith("ownindex.py"):
            return None
        frame.f_trace_opcodes, steps = True, steps + (event == "opcode")
        return seen

    old = sys.gettrace()
    sys.settrace(seen)
    try:
        f()
    finally:
        sys.settrace(old)
    return steps


@pytest.mark.parametrize("name", ["bound_insertion", "bound_search_anywhere", "interval_bound_search", "lcp_interval"])
def test_bounds_are_told_without_a_step_of_python_a_symbol(spark, monkeypatch, tmp_path, name):
    rnd, held = random.Random(4), []
    folder = folder_of(spark, str(tmp_path), {1: "".join(rnd.choice("aen Zb") for _ in range(20_000))})
    monkeypatch.setattr(ownindex, "_told_by", lambda refs, columns, schema, old=ownindex._told_by: old(refs, held.append(columns) or columns, schema))
    registry.DOCUMENT_QUERIES[name + "_documents"](spark, folder)
    texts = symbols.Texts(pa.array([1]), [spark.read.parquet(f"{folder}/documents.parquet").first().text])
    ranks = ownindex.Ranks(texts)
    assert opcodes(lambda: held[0](texts, ranks)) < 20_000


@pytest.mark.parametrize("rounds", [0, 2, 32])
def test_nearest_smaller_values(monkeypatch, rounds):
    """Long rises and falls, equal values and empty texts, whatever the rounds leave open."""
    monkeypatch.setattr(ownindex, "ROUNDS", rounds)
    rnd = random.Random(5)
    sizes = [0, 1, 300, 0, 200, 7]
    values = [0, *range(250), *[0] * 50, *range(200, 0, -1), *[rnd.randrange(3) for _ in range(7)]]
    ranks = object.__new__(ownindex.Ranks)
    ranks.size = np.array(sizes)
    ranks.begin = np.cumsum(sizes) - sizes
    ranks.doc = np.repeat(np.arange(len(sizes)), sizes)
    ranks.rank = np.arange(len(values)) - ranks.begin[ranks.doc]
    want = []
    for a, n in zip(ranks.begin.tolist(), sizes):
        v = values[a : a + n]
        want += [(max([j for j in range(i) if v[j] < v[i]], default=-1), min([j for j in range(i + 1, n) if v[j] < v[i]], default=n)) for i in range(n)]
    before, after = ranks.smaller(np.array(values))
    assert list(zip(before.tolist(), after.tolist())) == want


def test_an_end_is_looked_for_only_where_the_symbol_is(monkeypatch):
    """A text without the symbols asked for is halved once, not twice."""
    texts = symbols.Texts(pa.array([1]), ["bcdf" * 500])
    held, looked = [], []
    monkeypatch.setattr(ownindex, "_told_by", lambda refs, columns, schema: held.append(columns))
    everywhere = lambda rank, lo, hi, length: (0 * rank, 0 * rank + len(rank) - 1, 0 * rank, 0 * rank)
    ownindex.bounds_at(None, (("e",), everywhere))
    ranks = ownindex.Ranks(texts)

    class Code(np.ndarray):
        def __getitem__(self, at):
            looked.append(np.size(at))
            return super().__getitem__(at)

    texts.code = texts.code.view(Code)
    _, columns = held[0](texts, ranks)
    assert columns["left_bound"].null_count == 2000 and columns["insertion"].to_pylist() == [1500] * 2000
    assert sum(looked) <= 13 * 2000


def test_rows_of_an_interval_follow_one_another(monkeypatch):
    held = []
    monkeypatch.setattr(ownindex, "_told_by", lambda refs, columns, schema: held.append(columns))
    ownindex.bound_search(None, ("a", "n"))
    texts = symbols.Texts(pa.array([1, 2]), ["", "banana"])
    _, columns = held[0](texts, ownindex.Ranks(texts))
    assert columns["sym"].to_pylist() == ["a", "n"] * (len(columns["lo"]) // 2)
    assert (columns["lo"][::2] == columns["lo"][1::2]).all()
    empty = symbols.Texts(pa.array([1]), [""])
    assert len(held[0](empty, ownindex.Ranks(empty))[0]) == 0
