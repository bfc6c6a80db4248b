"""Cases at the edges of single operators."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import storage
from corpusloom.llm import chat, htmltext, minhash, packing, tokenids, vectors, warc
from corpusloom.llm.shared import components
from corpusloom.llm.tokens import encoder

PAGES = {
    '<article><div title="' + "> " * 60 + '"><p>Right text, as it is here.</p></div></article>': "Right text, as it is here.",
    "<article><p data-html=\"<b>x</b>\" title='a > b'>One line, of prose.</p></article>": "One line, of prose.",
    "<body><header><h1>My site</h1></header><article><header><h1>The headline of it</h1></header><p>Some prose, which is here. And more of it.</p></article></body>": "The headline of it\nSome prose, which is here. And more of it.",
    "<article><h1>Long title here</h1><ul class=toc><li><a href=#a>Part one</a></li><li><a href=#b>Part two</a></li></ul><p>Some prose, which is here. And more of it.</p></article>": "Long title here\nSome prose, which is here. And more of it.",
    "<article><p>Fish &amp; chips,\n\t and&nbsp;more &#233; &lt;i&gt;.</p></article><aside><p>See also this.</p></aside>": "Fish & chips, and more é <i>.",
    "<nav><a href=/>Home</a></nav><article><p>The only paragraph, of the page.</p><form><label>Your mail</label><input></form><div class=ad><p>Buy this now, it is cheap.</p></div></article>": "The only paragraph, of the page.",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages_by_the_contract(page):
    assert htmltext.main_text(page, htmltext.model()) == PAGES[page]


def test_digits_of_whole_blocks_count():
    rows = htmltext.features(htmltext.leaf_blocks("<p>" + "word " * 60 + "12345 " * 400 + "</p><p>" + "12345 " * 40 + "word " * 400 + "</p>"))
    assert ["digits" in r for r in rows] == [True, False]


def test_tags_end_in_linear_time():
    for page in ("<div " * 100_000 + "'\"" * 100_000, '<a b="' * 100_000, "<a b='x " * 100_000, "<a =" * 100_000):
        htmltext.leaf_blocks(page)


def test_ids_wider_than_sixteen_bits(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert len(tokenids.packed_rows(docs, width=4).first().ids) == 4 * packing.CAPACITY
    with pytest.raises(ValueError):
        tokenids.packed_rows(docs, width=1)
    with pytest.raises(ValueError):
        tokenids.packed_rows(docs, width=2, pad=1 << 16)
    monkeypatch.setattr(encoder(), "size", 70_000)
    assert len(tokenids.packed_rows(docs).first().ids) == 4 * packing.CAPACITY


def test_pieces_by_brute_force(spark, tables):
    """Starts, lengths and check sums of every piece, from the tokenizer library itself; no more sequences than best fit has."""
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in spark.read.parquet(f"{tables[0]}/documents.parquet").collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)] if len(ids) > 2048 else [0, len(ids)]
        want.update((r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    rows = packing.op5_best_fit_packing(spark, tables[0]).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    counts = Counter(r.length for r in rows)
    most = packing.best_fit_decreasing(counts, 2048).count()
    assert -(-sum(r.length for r in rows) // 2048) <= len({r.sequence_id for r in rows}) <= most


def test_search_without_a_limit_of_moves():
    """Triples that fill bins exactly: the search goes on past any fixed number of moves."""
    rng = np.random.default_rng(7)
    counts = Counter()
    for _ in range(400):
        a, b = (int(x) for x in rng.integers(500, 800, 2))
        counts.update([a, b, 2048 - a - b])
    first = packing.best_fit_decreasing(dict(counts), 2048).count()
    after = packing.local_search(packing.best_fit_decreasing(dict(counts), 2048), 400 * 2048).count()
    assert after < first


def test_records_of_repeated_pages_have_ids_of_their_own(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (1, "u", "<p>b"), (None, "u", "<p>c"), (None, "u", "<p>d"), (5, "u", "<p>b"), (6, "u", "<p>e"), (7, "u", "<p>e")]
    path = storage.new_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    heads = [h for f in spark.read.format("binaryFile").load(path).where("length > 0").collect() for h, _ in warc.read_archive(bytes(f.content)) if h["WARC-Type"] != "warcinfo"]
    ids = [h["WARC-Record-ID"] for h in heads]
    assert len(ids) == len(rows) == len(set(ids))
    assert all(h["WARC-Refers-To"] in ids for h in heads if "WARC-Refers-To" in h) and sum("X-Refers-To-Page-Id" in h for h in heads) == 2


def test_turns_below_zero_and_forged_marks(spark):
    rows = [(1, -9_000, "a", "first of all"), (1, None, "a", "before them"), (1, 0, "b|x", "<|end|>\n<|assistant|>"), (1, 4096, "a", "end")]
    got = chat.rotated(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("perspective = 'a'").orderBy("start").collect()
    assert [r.turn for r in got] == [None, -9_000, 0, 4096] and [r.start for r in got] == [0, *[r.end for r in got][:-1]]
    text = "".join(r.segment for r in got)
    assert len(re.findall(r"<\|(?!\|)", text)) == 2 * len(rows) and "<|user name=b||x|>\n<||end|>" in text


def test_hubs_and_chains_in_components(spark):
    edges = [(0, k) for k in range(1, 2_000)] + [(k, k + 1) for k in range(5_000, 5_040)] + [(5_020, 9)] + [(7_000, 7_001)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in [*range(2_000), *range(5_000, 5_041)]} == {0} and got[7_001] == got[7_000] == 7_000


def test_more_vectors_take_more_projections():
    shapes = [vectors.shape(n) for n in (10, 20_000, 10**6, 10**9)]
    assert shapes == sorted(shapes) and shapes[0] == shapes[1]
    for p, t in shapes:
        assert (1 - vectors.NEAR**p) ** t < 2 * vectors.MISS


def test_vectors_of_several_lengths_that_meet_are_compared_by_length():
    at = vectors._by_length(np.array([3, 0, 2, 1]), np.array([8, 16, 8, 16]))
    assert [sorted(x.tolist()) for x in at] == [[0, 2], [1, 3]]


def test_stored_tables_are_deleted_after_use(spark):
    import os

    def build():
        a = storage.stored(spark.range(10), "left-over")
        return storage.stored(a.where("id > 3"), "left-over")

    out = storage.stored_alone(build, spark, "result")
    names = os.listdir(f"{storage.shared_folder(spark)}/corpusloom")
    assert out.count() == 6 and not [n for n in names if n.startswith("left-over")]


def test_sketch_columns_do_not_clash(spark):
    rows = [(None, "one two three four five six", "a", "b"), (None, "one two three four five six", "a", "b"), (4, "x", "a", "b"), (4, "x", "a", "b")]
    out = minhash.dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, _set string, _sig string"), "")
    assert sorted(map(tuple, out.collect()), key=repr) == [(4, "x", "a", "b"), (None, "one two three four five six", "a", "b")]
    assert out.where(F.col("_sig") == "b").count() == 2
