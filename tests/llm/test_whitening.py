"""Whitening against numpy's eigenvectors."""

import numpy as np

from corpusloom.llm import whitening


def check(spark, rows, components=32, parts=6):
    table = spark.createDataFrame([(i, v, "own") for i, v in rows], "vec_id long, embedding array<float>, n string").repartition(parts)
    got = whitening.whitened(table, components).toPandas()
    kept = [(i, np.asarray([np.float32(x) for x in v], np.float64)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    dim = max(len(v) for _, v in kept)
    x = np.array([np.floor(64 * np.pad(v, (0, dim - len(v)))).astype(int) + 1_000_000 for _, v in kept])
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, axes = np.linalg.eigh(c.T @ c / n)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(components, int((e > e[0] * 1e-12).sum()))
    assert len(got) == n * k and set(got["n"]) == {n}
    want = c @ axes[:, :k] / np.sqrt(e[:k])
    mine = {}
    for r in got.itertuples():
        mine.setdefault(int(r.vec_id), np.zeros(k))[r.component - 1] = r.whitened
    for j in range(k):
        a = np.array([mine[i][j] for i, _ in kept])
        assert min(np.abs(a - want[:, j]).max(), np.abs(a + want[:, j]).max()) < 1e-8
    assert dict(zip(got.vec_id.astype(int), got.deviation)) == dict(zip([i for i, _ in kept], ((n * x - s) ** 2).sum(1).tolist()))
    assert np.allclose(got.groupby("component").explained.first(), e[:k] / e.sum(), rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_against_eigenvectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(700, 12)) @ np.diag(np.linspace(3, 0.3, 12)) @ np.linalg.qr(rng.normal(size=(12, 12)))[0] + 5
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(i + 1000, base[0].tolist()) for i in range(150)] + [(2000, None), (2001, [float("nan")] * 12), (2002, [*base[1][:11].tolist(), None]), (2003, [float("inf")] + [0.0] * 11)]
    check(spark, rows)
    check(spark, rows, components=5, parts=40)


def test_lost_rank_short_and_large_vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(80, 3)).tolist()
    check(spark, [(i, [*x, 2.0, -1.0]) for i, x in enumerate(v)])  # two dimensions without variance
    check(spark, [(i, x[: 1 + i % 3]) for i, x in enumerate(v)])
    check(spark, [(i, [1e3 * x[0], x[1], 3e2 * x[2]]) for i, x in enumerate(v)])


def test_nothing_to_whiten(spark, tables):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, [])]):
        assert whitening.whitened(spark.createDataFrame(rows, schema)).collect() == []
    full, empty = tables
    assert whitening.op12_whitening(spark, empty).collect() == []
    rows = whitening.op12_whitening(spark, full).collect()
    assert {r.vec_id for r in rows} == {1, 2, 3, 4, 5, 7, 10, None, 11, 12, 13} and all(r.identity_error < 1e-4 for r in rows)


def test_merging_keeps_everything():
    rng = np.random.default_rng(3)
    y = rng.integers(-300, 300, (1000, 7))
    parts = [whitening.summary(y[a:b]) for a, b in ((0, 1), (1, 4), (4, 500), (500, 1000))]
    held = parts[0]
    for p in parts[1:]:
        held = whitening.merged(held, p)
    n, s, r = held
    c = y - y.mean(0)
    assert n == 1000 and (s == y.sum(0)).all() and np.allclose(r.T @ r, c.T @ c, rtol=1e-12)
