"""Vectors, pages, archives, dialogues and the pipeline on messy tables."""

import hashlib
import base64
import struct
from collections import Counter, defaultdict

import conftest
import numpy as np
import pytest

from corpusloom.llm import chat, htmltext, vectors, warc


def brute_vectors(rows):
    ok = [v is not None and len(v) > 0 and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.float64(np.float32(rows[a][1])), np.float64(np.float32(rows[b][1]))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98 - 1e-12:
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(rows[k][0], links[k], least.get(find(k)) if ok[k] else rows[k][0], rows[k][0] is not None and rows[k][0] == (least.get(find(k)) if ok[k] else rows[k][0])) for k in range(len(rows))]


def test_vectors_messy(spark, tables):
    rows = [tuple(r)[:3] for r in spark.read.parquet(f"{tables[0]}/embeddings.parquet").collect()]
    got = [tuple(r) for r in vectors.op8_vector_dedup(spark, tables[0]).collect()]
    assert Counter(map(repr, got)) == Counter(map(repr, brute_vectors(rows)))


def test_vectors_dense_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(1)
    center = rng.standard_normal(24)
    rows = [(i, (center + 0.1 * rng.standard_normal(24)).tolist(), 1) for i in range(150)]
    rows += [(200 + i, rng.standard_normal(24).tolist(), i % 2) for i in range(150)]
    want = {r[0]: r for r in brute_vectors(rows)}
    got = {r[0]: tuple(r) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    found, there = sum(r[1] for r in got.values()), sum(r[1] for r in want.values())
    assert there > 1000 and 0.99 * there <= found <= there
    assert all(got[i][2] == want[i][2] for i in range(150))


def test_archives_round_trip(spark, tables):
    pages = [tuple(r)[:3] for r in spark.read.parquet(f"{tables[0]}/pages.parquet").collect()]
    top = {}
    for i, _, h in pages:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", i))
    want = []
    for i, _, h in pages:
        data = (h or "").encode()
        t = top.get(h or "")
        revisit = t is not None and i != t
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", t if revisit else None))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op10_warc(spark, tables[0]).collect()]
    assert Counter(map(repr, got)) == Counter(map(repr, want))


def test_archive_layout():
    import zstandard

    records = [warc.record(i, f"http://x/{i}", (f"<p>page {i} with common words</p>" * 20).encode()) for i in range(200)]
    data = warc.archive(records) + b"\n"
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D
    words, at, frames = zstandard.ZstdCompressionDict(data[8 : 8 + size]), 8 + size, []
    reader = zstandard.ZstdDecompressor(dict_data=words)
    while at < len(data) - 9:  # every record is a frame of its own
        one = reader.decompressobj()
        frames.append(one.decompress(data[at:]))
        at = len(data) - len(one.unused_data)
    assert frames[1:] == records and data[at:] == struct.pack("<II", 0x184D2A50, 1) + b"\n"
    assert [b for _, b in warc.read_archive(data)][1:] == [r.split(b"\r\n\r\n", 1)[1][:-4] for r in records]


def test_page_text_cases():
    chain = htmltext.model()
    page = "<html><title>t</title><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>First\n  line,\tof text &eacute;.<script>var a='<p>no</p>'</script><p>Second &lt;b&gt; line here.</article><section class=comments><h2>Comments</h2><div class=comment><p>I liked this, very much indeed.</p></div></section><footer>&copy; me</footer>"
    assert htmltext.main_text(page, chain) == "A & B\nFirst line, of text é.\nSecond <b> line here."
    for empty in (None, "", "<p>", "   ", "<!-- x", "<script>never closed <p>x</p>", "<"):
        assert htmltext.main_text(empty, chain) in ("", "<")
    assert len(htmltext.main_text("<article>" + "<p>Some words, in a row.</p>" * 20_000, chain).split("\n")) == 20_000
    htmltext.leaf_blocks("<div " * 5_000 + "'\"" * 5_000)


def test_page_chain_on_held_out_pages():
    chain = htmltext.model()
    wrong = total = 0
    for page, main in htmltext.labelled_pages(120, seed=991):
        rows, labels = htmltext.labelled_blocks(page, main)
        path = chain.decode(rows)
        wrong += sum(a != b for a, b in zip(path, labels))
        total += len(labels)
    assert wrong / total < 0.02


def test_viterbi_is_the_best_path():
    from itertools import product

    chain = htmltext.Chain({"a": (0.3, 1.0), "b": (0.5, -0.2), "c": (0.0, 0.1)}, [[0.2, -0.7], [-0.4, 0.6]])
    rows = [["a"], ["b", "c"], ["c"], ["a", "b"], ["b"]]
    s = chain.scores(rows)
    value = lambda y: sum(s[k][y[k]] for k in range(5)) + sum(chain.moves[y[k]][y[k + 1]] for k in range(4))
    assert tuple(chain.decode(rows)) == max(product((0, 1), repeat=5), key=value)


def test_pages_table(spark, tables):
    rows = htmltext.op9_html_text(spark, tables[0]).collect()
    assert len(rows) == 8 and all(r.n_chars == len(r.text) for r in rows)


def test_rotation(spark, tables):
    rows = chat.op7_chat_rotation(spark, tables[0]).collect()
    views = defaultdict(list)
    for r in rows:
        views[r.conv_id, r.perspective].append(r)
    assert set(views) == {(1, "user"), (1, "assistant"), (2, "unknown"), (2, "user"), (None, "user")}
    for (_, who), part in views.items():
        part.sort(key=lambda r: r.start)
        text = "".join(r.segment for r in part)
        assert [r.start for r in part] == [sum(len(x.segment) for x in part[:k]) for k in range(len(part))]
        for r in part:
            assert text[r.start : r.end] == r.segment
            assert (r.mask_start is not None) == (r.speaker == who)
            if r.mask_start is not None:
                assert text[r.mask_start : r.mask_end] == r.segment.split("\n", 1)[1]
    assert [r.role for r in views[1, "user"]] == ["system", "assistant", "user", "user"]


def test_pipeline_stages(spark, tables):
    import corpus_pipeline

    full, empty = tables
    docs = spark.read.parquet(f"{full}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, full)
        if k < 4:
            assert out.columns == docs.columns, name
        rows = out.collect()
        if k < 4:
            assert all(tuple(r)[5:] == conftest.EXTRA for r in rows), name
        docs = spark.createDataFrame(rows, out.schema)
    assert len(rows) > 500 and {r.doc_id for r in rows if r.doc_id is not None} <= {1, 7, *range(100, 700)}
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert corpus_pipeline.run(spark, full).count() == len(rows)
