"""Near copies among documents with null and repeated ids."""

from collections import Counter

from corpusloom.llm import minhash

SCHEMA = "doc_id long, text string"


def text(*changes, name="w", n=400):
    words = [f"{name}{i}" for i in range(n)]
    for i in changes:
        words[i] = f"changed{i}"
    return " ".join(words)


def test_texts_without_an_id_link_like_others(spark):
    # each change is five of 396 shingles: two to four changes are near, eight from one end to the other are not
    a, middle, b = text(), text(50, 100, 150, 200), text(50, 100, 150, 200, 250, 300, 350, 390)
    c, d, alone = text(name="c"), text(9, 99, name="c"), text(name="z")
    rows = [(7, a), (None, middle), (9, b), (None, c), (None, d), (None, d), (None, alone), (None, None), (3, "other words")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r._set): (r.component_id, r.kept, r._group) for r in minhash.near_duplicates(docs).collect()}
    by_text = {t: got[i, minhash.xxh3_128_digest(minhash.shingles(t).tobytes())] for i, t in rows if t}
    assert by_text[a][:2] == (7, True) and by_text[middle][:2] == (7, False) and by_text[b][:2] == (7, False)
    assert by_text[c][:2] == by_text[d][:2] == by_text[alone][:2] == (None, False)
    assert by_text[c][2] == by_text[d][2] != by_text[alone][2]
    kept = Counter((r.doc_id, r.text) for r in minhash.dedup_stage(spark, docs, "").collect())
    assert sum(kept[None, t] for t in (c, d)) == 1
    assert {k: n for k, n in kept.items() if k[1] not in (c, d)} == {(7, a): 1, (None, alone): 1, (None, None): 1, (3, "other words"): 1}


def test_the_stage_links_from_80_percent(spark):
    # 396 shingles, each change replaces five: 351 / 441 = 0.796, 356 / 436 = 0.817, 366 / 426 = 0.859
    at = lambda k: [40 * i + 10 for i in range(k)]
    rows = [(1, text()), (2, text(*at(8))), (3, text(name="v")), (4, text(*at(9), name="v")), (5, text(name="u")), (6, text(*at(6), name="u"))]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.doc_id for r in minhash.dedup_stage(spark, docs, "").collect()) == [1, 3, 4, 5]
    assert [r.doc_id for r in sorted(minhash.near_duplicates(docs).collect()) if r.kept] == [1, 2, 3, 4, 5]


def test_an_id_with_two_texts_is_in_two_classes(spark):
    a, b = text(), text(name="b")
    rows = [(2, text(7)), (5, a), (5, b), (8, text(200, name="b"))]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [(2, 2, True), (5, 2, False), (5, 5, True), (8, 5, False)]
    assert {(r.doc_id, r.text) for r in minhash.dedup_stage(spark, docs, "").collect()} == {(2, text(7)), (5, b)}
