"""The corpus pipeline: quality rules, near-dedup, PII, mixing and packing, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpusloom.llm import minhash, mixing, packing, pii, quality
from corpusloom.llm.shared import read_table, remove, stored_alone

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("quality", quality.quality_stage),
    ("near_dedup", minhash.dedup_stage),
    ("pii", pii.pii_stage),
    ("mixing", mixing.mixing_stage),
    ("packing", packing.packing_stage),
]

#: The learnt cutoffs, similarity links and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored_alone(lambda: stage(spark, docs, sf_dir), spark, f"pipeline-{name}")  # noqa: B023
        if name != STAGES[0][0]:
            remove(before)
    return STAGES[-1][1](spark, docs, sf_dir)
