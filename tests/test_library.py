"""Index folders: collections one after another, streams of pieces; suffix arrays as binary pairs; bound searches anywhere."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import gsa, hashmatch, matchstats, refindex, staircase
from corpusloom.sources import library, pairs
from corpusloom.streaming.matching import stream_pieces

LINE = "the quick brown fox jumps over the lazy dog while nobody in the whole wide town is looking; "


def texts(seed, n, size=150):
    """Similar strings: copies of the reference's parts with changes, and unlike ones."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = "".join(LINE[a : a + rng.randint(1, 90)] for a in (rng.randrange(len(LINE)) for _ in range(rng.randint(0, 4))))
        t = "".join(c if rng.random() > 0.02 else rng.choice("aé🎉$% ") for c in t)
        out.append((i, t[:size] if i % 5 else (LINE * 3)[i:]))
    return out


REFERENCE = LINE + LINE[20:] + "an end"


def brute(ref, s):
    """(len, pos, smaller) by sorting the reference's suffixes."""
    order = sorted(range(len(ref)), key=lambda i: ref[i:])
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    k = sum(ref[i:] < s for i in order)
    lp, ln = shared(ref[order[k - 1] :], s) if k else -1, shared(ref[order[k] :], s) if k < len(ref) else -1
    return (ln, order[k], True) if ln >= lp else (max(lp, 0), order[k - 1], False)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("library")) + "/one"
    library.build(spark.createDataFrame([(1, REFERENCE)], "ref_id long, text string"), at)
    return at


def expected(rows, ref=REFERENCE):
    known = {}
    for d, t in rows:
        for i in range(len(t)):
            s = t[i:]
            if s not in known:
                known[s] = brute(ref, s)
            n, pos, smaller = known[s]
            yield d, i, pos, n, smaller


def test_hashed_matches_equal_brute_force(spark, folder):
    rows = texts(1, 40)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, library.matches(table, folder).collect()))
    assert got == sorted(expected(rows)) and max(r[3] for r in got) > 2 * hashmatch.CHUNK


@pytest.mark.parametrize("ref", ["a", "aaaa", "abab" * 30, "z" * 70 + "a" + "z" * 70])
def test_hashed_matches_of_odd_references(spark, ref):
    rows = [(1, "a"), (2, "aaaaaa"), (3, "abab" * 31 + "b"), (4, "z" * 100), (5, ""), (6, "Z~"), (7, "z" * 60 + "a" + "z" * 71)]
    one = spark.createDataFrame([(1, ref)], "ref_id long, text string")
    index = hashmatch.with_lcp(refindex.suffix_array(one), one)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, hashmatch.hashed_matching_statistics(table, one, index).collect()))
    assert got == sorted(expected(rows, ref))


def test_a_collision_of_hashes_is_noticed(spark, folder, monkeypatch):
    rows = texts(2, 6)
    seen = []
    true = hashmatch.false_pieces
    monkeypatch.setattr(hashmatch, "false_pieces", lambda *a: seen.append(1) or (1 if len(seen) == 1 else true(*a)))
    got = sorted(map(tuple, library.matches(spark.createDataFrame(rows, "doc_id long, text string"), folder).collect()))
    assert got == sorted(expected(rows)) and len(seen) == 2


def test_lcp_compares_ends_of_runs_only(spark):
    refs = spark.createDataFrame([(1, REFERENCE), (2, "ab" * 300), (3, ""), (4, "x"), (5, "mississippi")], "ref_id long, text string")
    counts = []
    sa = refindex.suffix_array(refs)
    got = {(r.ref_id, r.pos): r.lcp for r in hashmatch.with_lcp(sa, refs, counts).collect()}
    want = {(r.ref_id, r.pos): r.lcp for r in refindex.with_lcp(sa, refs).collect()}
    assert got == want and counts[0] < len(want) / 4


def test_collections_one_after_another(spark, tmp_path):
    first, second = texts(3, 8), texts(4, 6)
    (tmp_path / "ref.txt").write_text(REFERENCE + "$\n")
    for name, rows in (("a", first), ("b", second)):
        (tmp_path / f"{name}.txt").write_text("".join(t.replace("%", "") + "%" for _, t in rows))
    (tmp_path / "list.txt").write_text(f"{tmp_path}/ref.txt\n{tmp_path}/a.txt\n")
    at = str(tmp_path / "lib")
    assert len(library.factorize(spark, str(tmp_path / "list.txt"), at)) == 1
    stamp = os.stat(f"{at}/index/_SUCCESS").st_mtime_ns
    (tmp_path / "list.txt").write_text(f"{tmp_path}/ref.txt\n{tmp_path}/a.txt\n{tmp_path}/b.txt\n")
    assert len(library.factorize(spark, str(tmp_path / "list.txt"), at)) == 1 and library.factorize(spark, str(tmp_path / "list.txt"), at) == []
    assert os.stat(f"{at}/index/_SUCCESS").st_mtime_ns == stamp
    heads = library.heads(spark, at)
    for rows, part in zip((first, second), sorted(heads.select("collection").distinct().collect(), key=lambda r: heads.where(F.col("collection") == r[0]).agg(F.max("doc_id")).first()[0], reverse=True)):
        docs = spark.createDataFrame([(i + 1, t.replace("%", "")) for i, t in rows], "doc_id long, text string")
        one = spark.createDataFrame([(0, REFERENCE)], "ref_id long, text string")
        want = matchstats.heads(matchstats.matching_statistics(docs, one), docs, one).collect()
        got = heads.where(F.col("collection") == part[0]).drop("collection").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    (tmp_path / "b.txt").write_text("fox%\n")
    assert len(library.factorize(spark, str(tmp_path / "list.txt"), at)) == 1
    assert heads.sparkSession.read.parquet(f"{at}/heads").select("collection").distinct().count() == 2


def test_pieces_equal_the_whole(spark, folder, tmp_path):
    rows, rng, cut = texts(6, 8), random.Random(7), []
    for d, t in rows:
        places = sorted(rng.randrange(len(t) + 1) for _ in range(3))
        parts = [t[a:b] for a, b in zip([0, *places], [*places, len(t)])]
        cut += [(d, k, p, k == 3, k // 2 if d % 3 else k // 3) for k, p in enumerate(parts)]
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    for batch in range(2):  # each query starts anew from the checkpoint and the folder of open pieces
        new = [r[:4] for r in cut if r[4] == batch]
        spark.createDataFrame(new, "doc_id long, piece long, text string, is_last boolean").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id long, piece long, text string, is_last boolean").parquet(source)
        stream_pieces(stream, folder, out, check).awaitTermination(300)
    got = sorted(map(tuple, spark.read.parquet(f"{out}/final").select("doc_id", "idx", "pos", "len", "smaller").collect()))
    assert got == sorted(expected(rows))


def test_pairs_written_side_by_side(spark, tmp_path):
    docs = spark.createDataFrame(texts(8, 12), "doc_id long, text string")
    array = gsa.gsa(docs).cache()
    path = str(tmp_path / "array.gsa")
    pairs.write_pairs(array, path)
    want = [(r.doc_id, r.idx) for r in array.orderBy("rank").collect()]
    assert np.fromfile(path, pairs.RECORD).tolist() == want
    back = pairs.read_pairs(spark, path, slice_records=100)
    assert back.rdd.getNumPartitions() == -(-len(want) // 100)
    assert [(r.doc_id, r.idx) for r in back.orderBy("rank").collect()] == want and [r.rank for r in back.orderBy("rank").collect()] == list(range(len(want)))
    first = open(path, "rb").read()
    # a task that was killed half way is run again and writes the same bytes
    writer = pairs.PairWriter(path, True)
    batches = pairs.PairReader(path, 10**9)
    half = next(batches.read(pairs.Slice(0, len(want) // 2)))
    writer.write(iter([half]))
    again = writer.write(batches.read(pairs.Slice(0, len(want))))
    writer.commit([again])
    assert open(path, "rb").read() == first
    with pytest.raises(Exception, match="each of 0 to n - 1|already exists|ranks"):
        pairs.write_pairs(array.where("rank <> 3"), path)
    assert open(path, "rb").read() == first and os.listdir(tmp_path) == ["array.gsa"]


def test_staircases_of_many_levels(spark):
    rng = random.Random(9)
    shapes = {1: [rng.randrange(12) for _ in range(300)], 2: list(range(200)), 3: list(range(200, 0, -1)), 4: [5] * 150, 5: [1], 6: [k % 7 + k // 40 for k in range(260)]}
    values = spark.createDataFrame([(r, j, v) for r, vs in shapes.items() for j, v in enumerate(vs)], "ref_id long, j long, v long")
    asked = [(r, k, rng.randrange(len(vs)), rng.randrange(-1, 14)) for r, vs in shapes.items() for k in range(120)]
    table = spark.createDataFrame(asked, "ref_id long, id long, i long, bound long")
    for before in (True, False):
        got = {(r.ref_id, r.id): r.found for r in staircase.smaller(values, table, before, cell=8, fan=3).collect()}
        for r, k, i, x in asked:
            at = [j for j, v in enumerate(shapes[r]) if v < x and (j <= i if before else j >= i)]
            assert got[r, k] == (None if not at else max(at) if before else min(at))


def test_documents_that_end_alike(spark):
    rows = [(i, f"{i % 97} and so it ends.") for i in range(10_000)]
    counts = []
    from corpusloom.operators.ranking import doubled, numbered, sparse_start
    from corpusloom.operators.symbols import positions

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    start = sparse_start(positions(docs, gsa.START).select("doc_id", "idx", "key"), F.col("key"), [])
    ranked = numbered(doubled(start, gsa.START, [], counts=counts))
    assert counts[-1] == 0 and all(a >= b for a, b in zip(counts, counts[1:]))
    got = ranked.agg(F.count("*"), F.count_distinct("rank"), F.min("rank"), F.max("rank")).first()
    n = sum(len(t) for _, t in rows)
    assert tuple(got) == (n, n, 0, n - 1)
    assert gsa.linear_violations(ranked, docs).first()["violations"] == 0
    # no cell of equal suffixes holds more than the documents it may
    assert ranked.where(F.col("idx") >= 0).select("doc_id").distinct().count() == 10_000
