"""Entropy balancing, its rounding and the last fill."""

from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing
from corpusloom.llm.mixing import CLASSES


def test_source_rates_hold_the_target_under_the_cap():
    rng = np.random.default_rng(2)
    for _ in range(200):
        mass, dual = rng.integers(1, 1000, 6).astype(float), rng.normal(0, 2, 6)
        target = rng.uniform(0.01, 2.99) * mass.sum()
        rate, free = mixing.source_rates(target, mass, dual)
        assert rate.max() <= 3 and mass @ rate == pytest.approx(target)
        # below the cap rates are proportional to the tilt
        assert np.ptp(np.log(rate[free]) - dual[free]) < 1e-9 and not (np.log(rate[~free]) - dual[~free] > (np.log(rate[free]) - dual[free]).max(initial=9) + 1e-9).any()
    assert mixing.source_rates(30.0, np.array([4.0, 6.0]), np.zeros(2))[0].tolist() == [3, 3]


def test_newton_finds_the_minimum_of_the_dual(spark):
    rows = [("a", 90.0, [5, 7], [20, 80]), ("b", 60.0, [5, 7, 9], [10, 20, 90]), (None, 30.0, [9], [10])]
    sources = spark.createDataFrame(rows, "source string, target double, classes array<int>, mass array<long>")
    wanted = np.zeros(CLASSES)
    wanted[[5, 7, 9]] = 23, 78, 79
    dual = mixing.class_duals(sources, wanted, ridge=0.01)

    def value(d):
        """The penalised objective, whose gradient the steps set to zero."""
        got = np.zeros(CLASSES)
        for _, t, c, m in rows:
            got[c] += np.array(m) * mixing.source_rates(t, np.array(m, float), d[c])[0]
        return got - wanted + 0.01 * 180 * d

    assert np.abs(value(dual)).max() < 1e-3 and len({round(x, 3) for x in dual[[5, 7, 9]]}) == 3


def test_exchanges_against_all_choices():
    rng = np.random.default_rng(4)
    for _ in range(300):
        add, drop, left = rng.integers(1, 40, rng.integers(0, 6)).astype(float), rng.integers(1, 40, rng.integers(0, 5)).astype(float), float(rng.integers(0, 60))
        more, less = mixing.exchanges(left, add, drop)
        after = abs(left - add[more].sum() + drop[less].sum())
        assert len(set(more)) == len(more) and len(less) <= 1
        greedy, rest = left, []
        for x in sorted(add, reverse=True):
            greedy, rest = (greedy - x, rest) if x <= greedy else (greedy, [*rest, x])
        assert after == min(abs(greedy - a + b) for a, b in product([0, *rest], [0, *drop]))


def test_every_source_is_near_its_target(spark):
    folder = "/root/testdata/sf0.01"
    rows = mixing.op6_mixing(spark, folder)
    source = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source")
    per = rows.join(source, "doc_id").groupBy("source").agg(F.sum("taken").alias("got"), F.first("target").alias("target"), F.count_if(F.col("taken") > 3 * F.col("size")).alias("over")).collect()
    assert all(abs(r.got - r.target) <= 0.001 * r.target and not r.over for r in per)


def test_targets_and_copies_by_brute_force(spark):
    """Whole numbers of copies as the contract has them, on sources of known sizes."""
    rows = [(i, f"s{i % 3}" if i % 7 else None, " ".join(["w"] * (1 + i * 13 % 50))) for i in range(300)] + [(300, "empty", None), (301, "s1", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    marked = mixing.stored(mixing.mark(docs).drop("text"), "test")
    got = mixing.with_copies(marked, *mixing.plan(marked)).collect()
    size = Counter()
    for r in rows:
        size[r[1]] += len((r[2] or "").split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, held = sum(size.values()), {}, set()
    while True:
        share = (total - sum(3 * size[s] for s in held)) / max(1, sum(weight[s] for s in order if s not in held))
        more = {s for s in order if s not in held and share * weight[s] >= 3 * size[s]}
        if not more:
            break
        held |= more
    for s in order:
        target[s] = 3 * size[s] if s in held else share * weight[s]
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source] and 0 <= r._copies <= 3
        taken[r.source] += r._size * r._copies
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
