"""The toxicity classifier: held-out accuracy, what it may see, and edges."""

import random
import zlib

import numpy as np

from corpusloom.llm import toxicity

RUDE = ("blorg", "snarfle", "wuzzock")


def corpus(n=900, seed=5):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("aeionrstl") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 120))]
        y = int(rng.random() < 0.2)
        if y:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(RUDE).upper() if rng.random() < 0.3 else rng.choice(RUDE))
        docs.append((i, " ".join(words)))
        labels.append((i, y))
    return docs, labels


def run(spark, docs, labels):
    d = spark.createDataFrame([(*r, "own") for r in docs], "doc_id long, text string, score string").repartition(4)
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    return {r.doc_id: r for r in toxicity.scored(d.select("doc_id", "text"), toxicity.fitted(d, y)).collect()}


def test_held_out_accuracy_and_folds(spark):
    docs, labels = corpus()
    got, y = run(spark, docs, labels), dict(labels)
    assert {i for i, r in got.items() if r.held_out} == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].predicted == y[i] for i in held) >= 0.98 * len(held)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = corpus(300)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = run(spark, docs, labels), run(spark, docs, turned)
    assert all(abs(a[i].score - b[i].score) < 1e-9 for i, _ in docs)


def test_long_texts_are_read_to_the_end(spark):
    docs, labels = corpus()
    body = " ".join(f"neat{k % 89}" for k in range(60_000))
    got = run(spark, [*docs, (5001, body), (5002, body + " blorg snarfle wuzzock blorg, snarfle!")], labels)
    assert got[5001].predicted == 0 and got[5002].score > got[5001].score


def test_edges(spark, tables):
    full, empty = tables
    assert toxicity.op13_toxicity(spark, empty).collect() == []
    rows = toxicity.op13_toxicity(spark, full).collect()  # labels of one class
    assert len(rows) == spark.read.parquet(f"{full}/documents.parquet").count() and all(r.score < 0.5 for r in rows)
    got = run(spark, [(1, None), (2, ""), (None, "x"), (3, " \t\n")], [])
    assert {r.score for r in got.values()} == {0.5} and got[None].held_out == (zlib.crc32(b" ") % 5 == 0)


def test_ngrams_are_those_of_the_text():
    text = "Ab\t\tcé🎉 x"
    flat = " ab cé🎉 x "
    for n, got in zip(toxicity.ORDERS, toxicity.ngrams(text)):
        want = [flat[i : i + n] for i in range(len(flat) - n + 1)]
        assert len(got) == len(want) and len(set(got.tolist())) == len(set(want))
    again = dict(zip([flat[i : i + 3] for i in range(len(flat) - 2)], next(toxicity.ngrams(text)).tolist()))
    assert again[" ab"] == next(toxicity.ngrams("ab")).tolist()[0] and list(map(len, toxicity.ngrams(None))) == []
    model = toxicity.Model(np.array(list(again.values()), np.int64), np.ones(len(again)), 0.0)
    assert len(model.held(text)) == len(again) and len(model.held("zzzz")) == 0
