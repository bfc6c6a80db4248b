"""Faults that a review found in round 4: each test failed before its fix."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import backward, counted, gsa, matchstats, ownindex, sequences, symbols
from corpusloom import storage
from corpusloom.plans import registry


def folder_of(spark, at, texts):
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows.write.parquet(f"{at}/documents.parquet")
    rows.withColumnRenamed("doc_id", "item_id").write.parquet(f"{at}/benchmark.parquet")
    return at


def both_forms(spark, folder, name):
    """The form over documents, whose plan is returned, and that over items."""
    frame = registry.DOCUMENT_QUERIES[name + "_documents"](spark, folder)
    return frame._jdf.queryExecution().executedPlan().toString(), sorted(map(repr, frame.collect())), sorted(map(repr, registry.QUERIES[name](spark, folder).collect()))


@pytest.mark.parametrize("texts", [["ab"], ["x", "", None], ["né", "n"], ["b", "ab", "abcdefg", "abcdefgh"]])
def test_texts_shorter_than_a_mark_are_ordered(spark, texts):
    """A task that had fewer than 8 symbols and ends in all failed."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((t[i:], d, i) for d, t in enumerate(texts) if t for i in range(len(t)))
    assert [(r.doc_id, r.idx) for r in sorted(gsa.gsa(docs).collect(), key=lambda r: r.rank)] == [(d, i) for _, d, i in want]


OWN = ["plcp_max", "max_lcp", "psv_nsv", "range_min", "suffix_link", "parent_interval", "occ_blocks", "occ_rank", "sa_check", "sa_outcome"]


@pytest.mark.parametrize("name", OWN)
def test_texts_answer_from_their_own_index(spark, tmp_path, monkeypatch, name):
    """Nothing but texts is shuffled; with one reference beyond the length that one task may take, the result is the same."""
    rnd = random.Random(2)
    texts = {1: "banana bandana", 2: "nab🎉\0ae", 3: None, 4: "", 5: "a" * 40, 6: "NNaNNbN", 7: "N", 8: "".join(rnd.choice("ab") for _ in range(700)), 9: "ab" * 200 + "a"}
    folder = folder_of(spark, str(tmp_path), texts)
    plan, got, want = both_forms(spark, folder, name)
    assert "Join" not in plan and "Window" not in plan and "Aggregate" not in plan
    assert got == want
    if name in ("range_min", "suffix_link", "sa_check"):
        monkeypatch.setattr(ownindex, "MOST", 14)
        assert both_forms(spark, folder, name)[1] == want


def test_faults_of_arrays(spark):
    """Told of any rows, as by the tables (which tell a place that is there twice as a row too many)."""
    text = {1: "banana", 2: "b", 3: "", 4: "abab"}
    t = symbols.Texts(pa.array(list(text)), list(text.values()))
    r = ownindex.Ranks(t)
    right = t.idx[r.at]
    refs = spark.createDataFrame(list(text.items()), "ref_id long, text string")
    for change, outcome in (((), 0), ((9,), -2), ((3,), -2), ((0, 3, 1, 5), -3), ((3, 5), -4)):
        pos = np.append(change, right[len(change) :]).astype(np.int64)
        got = dict(zip(text, ownindex.outcome(ownindex.faults(t, r.doc, r.rank, pos)).tolist()))
        assert got == {1: outcome, 2: 0, 3: 0, 4: 0}
        if change != (3,):
            array = spark.createDataFrame([(list(text)[d], k, p) for d, k, p in zip(r.doc.tolist(), r.rank.tolist(), pos.tolist())], "ref_id long, rank long, pos long")
            assert {x.ref_id: x.outcome for x in gsa.sa_outcome(array, refs).collect()} == got
    assert ownindex.outcome(ownindex.faults(t, r.doc[1:], r.rank[1:], right[1:])).tolist() == [-1, 0, 0, 0]


NEAR = ["head_of_suffix", "ms_from_heads", "ms_with_runs", "ms_mismatch", "pred_succ_lookup", "ms_heads", "ms_unambiguous", "next_head", "sstar_buckets", "full_suffix_buckets"]


@pytest.mark.parametrize("name", NEAR)
def test_matches_and_heads_are_told_where_texts_lie(spark, tmp_path, name):
    """No row a symbol or head is shuffled, joined or kept."""
    texts = {1: "banana nabnn", 2: "nab🎉\0annae", 3: None, 4: "", 5: "n" * 40, 6: "NNaNNbNnnn", 7: "Z", 8: "Zbanana nabnnZ"}
    folder = folder_of(spark, str(tmp_path), texts)
    plan, got, want = both_forms(spark, folder, name)
    assert "Join" not in plan.replace("BroadcastNestedLoopJoin", "").replace("BroadcastHashJoin", "") and "Window" not in plan and "heads-" not in plan and "matches-" not in plan
    assert got == want


@pytest.fixture(scope="module")
def parts(spark):
    """Collection, reference, its index, and heads: copies, near copies, one text that begins another one, texts without a phrase."""
    rnd = random.Random(3)
    near = "".join(rnd.choice("abn") for _ in range(300))
    texts = ["banana", near, None, near[:200], "", near, near[:250] + "b" + near[251:], "Zab", "b🎉an", "banana", "n" * 50, near[:200]]
    docs = spark.createDataFrame([(7 * k + 2, t) for k, t in enumerate(texts)], "doc_id long, text string").fillna("")
    reference = spark.createDataFrame([(1, "banana nabnn")], "ref_id long, text string")
    index = ownindex.index(reference).cache()
    return docs, reference, index, backward.heads(docs, reference, index).cache()


@pytest.mark.parametrize("part", [1, 100, 1 << 20])
def test_heads_are_ordered_by_counting(spark, monkeypatch, parts, part):
    """Kinds of heads are shuffled, heads aren't; any size of parts gives the same."""
    docs, reference, index, head = parts
    monkeypatch.setattr(counted, "PART", part)
    monkeypatch.setattr(counted, "SMALL", part)
    phrases = matchstats.sorted_phrases(head, index).cache()
    for got, want in (
        (counted.sorted_phrases(docs, reference, index), phrases),
        (counted.sorted_heads(docs, reference, index), gsa.sorted_heads(head, docs, index)),
        (counted.length_buckets(docs, reference, index), matchstats.length_buckets(phrases)),
    ):
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))
        assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("first", [1, 16])
def test_sequences_of_phrases_take_a_row_a_document(spark, monkeypatch, parts, first):
    docs, reference, index, head = parts
    monkeypatch.setattr(sequences, "FIRST", first)
    by = {}
    for h in sorted(head.where("not is_end").collect(), key=lambda h: (h.doc_id, h.head_id)):
        by.setdefault(h.doc_id, []).append((h.pos, h.len))
    want = [(k, d, len(x)) for k, (x, d) in enumerate(sorted((x, d) for d, x in by.items()))]
    assert sorted(tuple(r) for r in sequences.phrase_sequences(docs, reference, index).collect()) == want


def test_stars_are_sorted_alone(spark, tmp_path):
    """Their array is not cut out of that of all places, and tables that were stored on the way are gone."""
    texts = {3: "banana bandana $", 5: "", 7: "ban", 8: None, 9: "banana bandana $", 12: "na" * 300 + "x"}
    folder = folder_of(spark, str(tmp_path), texts)
    typed = lambda t: ["S" if t[i:] < t[i + 1 :] else "L" for i in range(len(t))]
    star = {(d, i) for d, t in texts.items() if t for k in [typed(t)] for i in range(1, len(t)) if k[i - 1 : i + 1] == ["L", "S"]}
    frame = registry.DOCUMENT_QUERIES["sstar_sorted_documents"](spark, folder)
    assert "SortMergeJoin" not in frame._jdf.queryExecution().executedPlan().toString()
    want = sorted((texts[d][i:], d, i) for d, i in star)
    assert sorted((r.order_no, r.doc_id, r.idx) for r in frame.collect()) == [(k, d, i) for k, (_, d, i) in enumerate(want)]
    assert tuple(registry.DOCUMENT_QUERIES["sstar_check_documents"](spark, folder).first()) == (len([d for d, _ in star if d > 3]), 0, 0)


def test_kept_tables_leave_no_others(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/source")
    inner = []

    def build():
        inner.append(storage.stored(spark.range(5), "on-the-way"))
        return storage.kept(spark, f"{tmp_path}/source", "other", lambda: inner[0].where("id > 0")).where("id > 1")

    assert storage.kept(spark, f"{tmp_path}/source", "outer", build).count() == 3
    assert storage.kept(spark, f"{tmp_path}/source", "other", None).count() == 4
    assert not any(storage.exists(spark, f) for f in inner[0].inputFiles())


def test_differences_between_tables(spark, monkeypatch):
    """Rows meet only in cells that differ."""
    monkeypatch.setattr(gsa, "NEAR", 10)
    a = spark.range(100).select(F.col("id").alias("rank"), (F.col("id") % 7).alias("doc_id"), (F.col("id") * 3).alias("idx"))
    told = lambda b: tuple(gsa.differences(a, b, "rank").select("n", "missing", "added").first())
    assert told(a) == (100, 0, 0)
    assert told(a.where("rank <> 15")) == (100, 1, 0)
    assert told(a.union(a.where("rank in (3, 99)"))) == (100, 0, 2)
    assert told(a.withColumn("doc_id", F.when(F.col("rank") == 50, 9).otherwise(F.col("doc_id")))) == (100, 1, 1)
    assert told(a.where("rank < 90")) == (100, 10, 0)
    twice = a.where("rank <> 20").union(a.where("rank = 21"))
    assert told(twice) == (100, 1, 1)
