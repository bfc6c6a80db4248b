"""Spans that weak supervision adds, against a plain-Python run of patterns and model."""

import math
import re

from pyspark.sql import functions as F

from corpusloom.llm import pii

SAYS = [
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and so on', "API_KEY: 'sk-a8F3kd02LmQ9zXc71Bv4'", "password=hunter2hunter2 now", "call 312-555-0142 or (415) 555-2671.",
    "the donaudampfschifffahrtsgesellschaftskapitaen sails", "sha1 of the file 04dbebab91ab85687d33eeaaf9ac699e1188f962", "IBAN DE89 3704 0044 0532 0130 00 is mine", "ssn 123-45-6789, not 000-12-3456",
    "write to jane [at] example [dot] org", "Dr. Maria Keller signed", "+1 (743) 555-3824 is a phone of its own", "a" * 5_000 + "1", "token=" * 400, "", None,
]
#: Python's lookbehinds have one width; its possessive repeats are Java's.
LOOK = "(?<!\\+[0-9]{1,3}[\\x20.-]?\\(?)"


def candidates(text):
    """(kind, start, end) of the added kinds as the patterns say."""
    found = []
    for kind, pattern in pii.EXTRA.items():
        for m in re.finditer(pattern.replace(LOOK, ""), text or ""):
            if kind == "local_phone" and re.search(r"\+[0-9]{1,3}[ .-]?\(?$", text[: m.start()]):
                continue
            lead = re.match(pii.LEADS[kind], m.group()) if kind in pii.LEADS else None
            found.append((kind, m.start() + (lead.end() if lead else 0), m.end()))
    return found


def accepted(row, model):
    """Base and added spans of a row's candidates by the model's weights."""
    def score(x):
        z = model.weights.get("bias", -1e9)
        return z + sum(w for name, w in model.weights.items() if "=" in name and str(x[name.split("=")[0]]) == name.split("=")[1])

    base = [(x.kind, x.s, x.e) for x in row if x.kind in pii.BASE and x.ok]
    added = []
    for secret in (False, True):
        for x in row:
            free = all(b[2] <= x.s or x.e <= b[1] for b in (base + added if secret else base))
            if x.kind not in pii.BASE and (x.kind == "secret") == secret and score(x) > math.log(model.threshold / (1 - model.threshold)) and free:
                added.append((x.kind, x.s, x.e))
    return base, added


def test_candidates_and_added_spans(spark):
    rows = [(i, t) for i, t in enumerate(SAYS * 6)]
    found = pii.stored(pii.with_candidates(spark.createDataFrame(rows, "doc_id long, text string")), "test")
    model = pii.train(pii.pattern_counts(found))
    kinds = set()
    for r in pii.spans(found, model).collect():
        assert [(x.kind, x.s, x.e) for x in r._p_all if x.kind in pii.EXTRA] == candidates(r.text), r.text
        got = [[tuple(x) for x in a] for a in (r._p_base, r._p_added)]
        assert got == list(accepted(r._p_all, model))
        kinds |= {x[0] for x in got[1]}
    assert {"secret", "local_phone", "national_id"} <= kinds


def test_every_planted_token_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = pii.op1_pii(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where(F.col("text").rlike("(?i)token = \"[0-9a-f]{40}\"")).collect()
    assert len(rows) >= 10
    for r in rows:
        want = {f"secret:{m.start(1)}:{m.end(1)}" for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r.text)}
        assert want <= set(r.spans.split(",")) and r.n_spans == r.n_added + r.n_email + r.n_ip + r.n_card + r.n_phone


def test_characters_after_the_64th_count(spark):
    docs = spark.createDataFrame([(1, "a1" * 40), (2, "a1" * 40 + "bcdefghijk")], "doc_id long, text string")
    votes = {r.doc_id: r._p_all[0].variety for r in pii.with_candidates(docs).collect()}
    assert votes == {1: -1, 2: 1}


def test_values_of_any_length_and_no_overlaps(spark):
    secrets = {n: 'password = "' + ("Ab3!" * n)[:n] + '"' for n in (20, 300, 3_000, 30_000)}
    name = "x" * 100 + " [at] " + "y" * 80 + " [dot] example [dot] very [dot] long [dot] chain [dot] org"
    rows = [(n, t) for n, t in secrets.items()] + [(1, name), (2, "Mr John [at] example [dot] org"), (3, "Dr " + "L" + "o" * 50 + " spoke."), (4, "a" * 60_000)]
    found = pii.with_candidates(spark.createDataFrame(rows, "doc_id long, text string"))
    all_ = {r.doc_id: [(x["kind"], x["s"], x["e"]) for x in r["_p_all"]] for r in found.collect()}
    for n in secrets:
        assert ("secret", 12, 12 + n) in all_[n]
    assert ("spelt_email", 0, len(name)) in all_[1] and ("person", 0, 54) in all_[3] and len(all_[4]) <= 1
    everything = pii.Model.accepts
    pii.Model.accepts = lambda self, x: x["e"] > x["s"]
    try:
        marks = [(x["s"], x["e"]) for r in pii.spans(found.where("doc_id = 2"), pii.Model({}, {})).collect() for x in [*r["_p_base"], *r["_p_added"]]]
    finally:
        pii.Model.accepts = everything
    assert len(marks) == 1
