"""The document operators on messy and empty tables, against brute force."""

from collections import Counter, defaultdict

import brute
import numpy as np
import pytest

from corpusloom.llm import minhash, mixing, packing, pii, quality, queries, tokenids
from corpusloom.llm.tokens import encoder


def texts(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def bag(rows):
    return Counter(map(repr, rows))


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables_give_empty_results(spark, tables, name):
    assert queries.QUERIES[name](spark, tables[1]).count() == 0


def test_quality_counts_and_verdict(spark, tables):
    rows = quality.op4_quality_rules(spark, tables[0]).collect()
    want = [(i, *brute.quality(t)) for i, t in texts(spark, tables[0])]
    assert bag(tuple(r)[:7] for r in rows) == bag(want)
    kept = {r.doc_id: r.kept for r in rows if r.doc_id is not None and r.doc_id >= 100}
    assert all(kept[i] for i in range(100, 700)) and not any(kept[i] for i in range(700, 800))
    assert not any(r.kept for r in rows if r.base_failed)


def test_binomial_tail_is_exact(spark):
    from math import comb

    from pyspark.sql import functions as F

    cases = [(n, k) for n in (1, 19, 20, 21, 200, 1500) for k in (0, 1, 3, 12, 40) if k < n * 0.05]
    df = spark.createDataFrame(cases, "n long, k long").withColumn("p", quality.binomial_tail(F.col("n"), F.col("k"), 0.05))
    for n, k, p in df.collect():
        assert p == pytest.approx(sum(comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(k + 1)), rel=1e-9)
    one = spark.createDataFrame([(100, 10)], "n long, k long").select(quality.binomial_tail(F.col("n"), F.col("k"), 0.05)).first()[0]
    assert one == 1.0


def test_pii_base_spans(spark, tables):
    rows = pii.op1_pii(spark, tables[0]).collect()
    assert bag(tuple(r)[:6] for r in rows) == bag((i, *brute.base_row(t)) for i, t in texts(spark, tables[0]))
    ten = next(r for r in rows if r.doc_id == 10)
    assert ten.spans.startswith(",".join(f"{k}:{s}:{e}" for k, s, e in brute.base_spans(dict(texts(spark, tables[0]))[10])))


def test_pii_patterns_on_awkward_texts(spark):
    cases = ["a@b.c_d@e.f@g.h", "x" * 50_000, "1.2.3.4.5.6.7.8", "1" * 30_000, "+1" + " " * 5_000 + "2", "é🎉 a@b.cd 🎉 4111-1111 1111-1111", "a@" + "b." * 9_000, "0255.1.1.1 256.1.1.1 00000.1.1.01", "++1 23 456 7890", "a@b..c", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"]
    found = pii.with_candidates(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string"))
    for r in pii.spans(found, pii.Model()).select("doc_id", "_p_base").collect():
        assert [(x.kind, x.s, x.e) for x in r[1]] == brute.base_spans(cases[r[0]]), cases[r[0]][:60]


def test_pii_model_adds_supported_spans_only(spark):
    rows = [(i, f"Please call our phone 312-555-{1000 + i} today or write e-mail to user{i}@mail.example.com now") for i in range(40)]
    rows += [(100 + i, f"order ref 12-{i}") for i in range(40)]
    found = pii.with_candidates(spark.createDataFrame(rows, "doc_id long, text string"))
    model = pii.train(pii.pattern_counts(found))
    added = {r[0]: [x.kind for x in r[1]] for r in pii.spans(found, model).select("doc_id", "_p_added").collect()}
    assert all(added[i] == ["local_phone"] for i in range(40)) and not any(added[100 + i] for i in range(40))


def test_pii_stage_redacts(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    out = pii.pii_stage(spark, docs, tables[0])
    assert out.columns == docs.columns
    ten = [r for r in out.collect() if r.doc_id == 10]
    assert len(ten) == 2 and ten[0].text == ten[1].text and "@" not in ten[0].text and "<EMAIL>" in ten[0].text and "1.2.3.400" in ten[0].text and ten[0].n_chars == len(ten[0].text)


def test_near_duplicates(spark, tables):
    rows = minhash.op3_minhash_dedup(spark, tables[0]).collect()
    docs = texts(spark, tables[0])
    want = brute.near_components([x for x in dict(docs).items() if x[0] is not None])
    assert len(rows) == len(docs)
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == want[r.doc_id], r
        else:
            assert not r.kept
    assert {r.component_id for r in rows if r.doc_id is None} == {1, None}


def test_near_duplicate_chain_in_blocks(spark, monkeypatch):
    """Lists cut into many small blocks give the same components."""
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 7)
    words = [f"t{i}" for i in range(240)]
    rows = []
    for i in range(60):
        words[(i * 37) % 240] = f"c{i}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near_components(rows)


def test_dedup_stage_keeps_one_of_each_group(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    out = minhash.dedup_stage(spark, docs, tables[0])
    assert out.columns == docs.columns
    n = Counter(r.doc_id for r in out.collect())
    assert n[1] == 1 and n[10] == 1 and 2 not in n and 3 not in n and n[4] == n[5] == n[6] == n[8] == 1 and 9 not in n and n[None] == 1


def test_tokens_equal_the_files_library(spark, tables):
    encode = encoder()
    assert encode._fast
    for _, t in texts(spark, tables[0])[:40] + [(0, " " * 3000 + "x <|endoftext|> a" * 50)]:
        assert encode(t).tolist() == encode._slow.encode(t or "", add_special_tokens=False).ids


def test_packing_is_gapless_and_whole(spark, tables):
    rows = packing.op5_best_fit_packing(spark, tables[0]).collect()
    docs = texts(spark, tables[0])
    assert sum(r.length for r in rows) == sum(len(encoder()(t)) + 1 for _, t in docs)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length))
    assert [x[1:] for x in sorted(pieces[7])] == packing.pieces_of(len(encoder()(dict(docs)[7])) + 1)


def test_local_search_empties_bins():
    rng = np.random.default_rng(5)
    gained = 0
    for case in range(40):
        # triples that fill bins exactly, which best fit packs badly
        counts = Counter()
        for _ in range(20):
            a = int(rng.integers(260, 400))
            b = int(rng.integers(260, 400))
            counts.update([a, b, 1000 - a - b])
        total = sum(k * n for k, n in counts.items())
        first = packing.best_fit_decreasing(dict(counts), 1000)
        before = first.count()
        after = packing.local_search(first, total)
        assert after.count() <= before and all(after.fill(c) <= 1000 for c in after.groups)
        pieces = Counter()
        for content, n in after.groups.items():
            for length, k in content:
                pieces[length] += k * n
        assert pieces == counts
        gained += before - after.count()
    assert gained > 0


def test_packed_rows_restore_documents(spark, tables):
    docs = texts(spark, tables[0])
    parts = defaultdict(list)
    for r in tokenids.op2_token_ids(spark, tables[0]).collect():
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == packing.CAPACITY and not ids[r.n_tokens :].any() and r.cu_seqlens[-1] == r.n_tokens
        positions = tokenids.position_ids(r)
        assert [p for p in range(r.n_tokens) if positions[p] == 0] == r.position_resets
        for k in range(r.n_segments):
            parts[r.doc_ids[k]].append((r.pieces[k], r.starts[k], ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]]))
    ids = [i for i, _ in docs]
    for i, t in docs:
        if ids.count(i) == 1:
            assert np.concatenate([x[2] for x in sorted(parts[i], key=lambda x: x[0])]).tolist() == [*encoder()(t), 0]


def test_segment_tree_is_best_fit():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 65, 300).tolist()
    bins = tokenids.best_fit_decreasing(lengths, 64)
    rooms = []
    for k in sorted(range(300), key=lambda k: (-lengths[k], k)):
        fits = [r for r in rooms if r >= lengths[k]]
        room = min(fits) if fits else 64
        if fits:
            rooms.remove(room)
        rooms.append(room - lengths[k])
    assert len(bins) == len(rooms) and sorted(64 - sum(lengths[k] for k in b) for b in bins) == sorted(rooms)


def test_mixing_meets_targets(spark, tables):
    rows = mixing.op6_mixing(spark, tables[0]).collect()
    again = mixing.op6_mixing(spark, tables[0]).collect()
    assert bag(rows) == bag(again) and len(rows) == len(texts(spark, tables[0]))
    assert all(r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0) for r in rows)
    total = sum(r["size"] for r in rows)
    by = {r.source_size: r.target for r in rows}
    # sources a, b, c, null weigh 5, 2, 1, 5; the null one has no words
    sizes = sorted(by)
    assert sizes[0] == 0 and by[0] == 0
    assert sum(by.values()) == pytest.approx(total)
    assert all(t <= 3 * s + 1e-6 for s, t in by.items())
    for s, t in by.items():
        members = [r for r in rows if r.source_size == s]
        slack = max((r["size"] for r in members), default=0)
        assert abs(sum(r.taken for r in members) - t) <= slack / 2 + 1
