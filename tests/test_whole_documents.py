"""Queries over whole documents, against brute force and against their forms over short items."""

import pytest

import __spark_entry__
from corpusloom.plans import registry

TEXTS = {3: "banana bandana $", 5: "", 7: "ban", 8: None, 9: "banana bandana $", 11: "né🎉 ban%d\nana", 12: "na" * 300 + "x", 14: "qqz", 15: "%n%d"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    rows = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    rows.write.parquet(f"{at}/documents.parquet")
    rows.withColumnRenamed("doc_id", "item_id").write.parquet(f"{at}/benchmark.parquet")
    return at


def run(spark, folder, name):
    return __spark_entry__.queries()[name](spark, folder).collect()


def suffixes():
    return sorted((t[i:], d, i) for d, t in TEXTS.items() if t for i in range(len(t)))


def test_every_item_query_has_a_form_over_documents():
    own = registry._OWN_TABLE | registry._STRINGS | registry._SAME
    assert set(registry.DOCUMENT_QUERIES) == {f"{n}_documents" for n in registry.QUERIES if n not in own}


@pytest.mark.parametrize("name", ["gsa_documents", "gsa_by_ranks_documents", "gsa_by_heads_documents"])
def test_gsa(spark, folder, name):
    want = [(d, i) for _, d, i in suffixes() if name == "gsa_documents" or d != 3]
    assert [(r.doc_id, r.idx) for r in sorted(run(spark, folder, name), key=lambda r: r.rank)] == want


def test_matching_statistics(spark, folder):
    ref, seen = TEXTS[3], 0
    for r in run(spark, folder, "ms_full_documents"):
        s, seen = TEXTS[r.doc_id][r.idx :], seen + 1
        best = max(n for n in range(len(s) + 1) if s[:n] in ref)
        assert r.len == best and ref[r.pos : r.pos + best] == s[:best]
    assert seen == sum(len(t or "") for d, t in TEXTS.items() if d != 3)


def test_index(spark, folder):
    got = {}
    for r in sorted(run(spark, folder, "lcp_array_documents"), key=lambda r: r.rank):
        got.setdefault(r.ref_id, []).append((r.pos, r.lcp))
    for d, t in TEXTS.items():
        order = sorted(range(len(t or "")), key=lambda i: t[i:])
        shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        want = [(i, shared(t[i:], t[order[k - 1] :]) if k else 0) for k, i in enumerate(order)]
        assert got.get(d, []) == want


@pytest.mark.parametrize("name", ["ms_heads", "head_of_suffix", "pred_succ_lookup", "head_sort", "phrase_sequences", "ls_types", "sstar_sorted", "bwt", "sink_roundtrip"])
def test_equal_to_the_form_over_items(spark, folder, name):
    assert sorted(map(repr, run(spark, folder, name + "_documents"))) == sorted(map(repr, run(spark, folder, name)))
