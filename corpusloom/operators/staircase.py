"""Nearest smaller values: one stack pass a cell, and staircases that are merged by level.

Values of a reference are cut into cells of CELL places. A task reads a cell in
order and keeps the values that nothing later undercuts, a strictly rising
stack; a question ("the last value below x up to here") is a binary search in
it. What a cell can't answer is told from the cells before: their stacks as
they end, the *staircases*, go up as the values of the next level, whose cells
are FAN cells of this one, and so on until one cell holds a reference. A cell
asks once for each distinct bound, and answers come down by equi-joins.

A staircase has no more steps than its cell has distinct values. The mirrored
question (the first value below x from here on) is the same with places negated.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import importable, stored

CELL = 65_536
FAN = 256
_COLUMNS = ["ref_id", "node", "kind", "at", "x", "id"]
#: Kinds of rows: questions of a cell that ask for what lies before it, values, questions that include their own place; of results: answers, steps.
BEFORE, VALUE, UP_TO = 0, 1, 2
ANSWER, STEP = 0, 1


def _climbed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, held, where, out = None, [], [], []

    def steps() -> None:
        out.extend((key[0], STEP, key[1], x, None, at) for x, at in zip(held, where))

    columns = ["ref_id", "kind", "node", "x", "id", "at"]
    types = {"kind": "int32", "node": "int64", "x": "int64", "id": "Int64", "at": "Int64"}
    for batch in batches:
        for ref, node, kind, at, x, id_ in zip(*[batch[c].tolist() for c in _COLUMNS]):
            if (ref, node) != key:
                if key is not None:
                    steps()
                key, held, where = (ref, node), [], []
            if kind == VALUE:
                while held and held[-1] >= x:
                    held.pop()
                    where.pop()
                held.append(x)
                where.append(at)
            else:
                k = bisect_left(held, x)
                out.append((ref, ANSWER, node, x, id_, where[k - 1] if k else None))
        if len(out) > 5_000:
            yield pd.DataFrame(out, columns=columns).astype(types)
            out = []
    if key is not None:
        steps()
    yield pd.DataFrame(out, columns=columns).astype(types)


def _level(rows: DataFrame, name: str, ref_type: str) -> DataFrame:
    importable(rows.sparkSession)
    dealt = rows.repartition("ref_id", "node").sortWithinPartitions("ref_id", "node", "place", "kind", "at").select(*_COLUMNS)
    return stored(dealt.mapInPandas(_climbed, f"ref_id {ref_type}, kind int, node long, x long, id long, at long"), name)


def smaller(values: DataFrame, asked: DataFrame, before: bool, cell: int = CELL, fan: int = FAN) -> DataFrame:
    """(ref_id, id, found): of ``values`` (ref_id, j, v) the greatest j <= i (``before``; else the least j >= i) with v < bound, for each of ``asked`` (ref_id, id, i, bound); null if none.

    ``id`` is a whole number, one of a kind in its reference.
    """
    sign = 1 if before else -1
    ref_type = values.schema["ref_id"].dataType.simpleString()
    node = lambda c, size: F.floor(F.greatest(F.col(c), F.lit(0)) / size).cast("long") * sign
    own = values.select("ref_id", node("j", cell).alias("node"), (F.col("j") * sign).alias("place"), F.lit(VALUE).alias("kind"), (F.col("j") * sign).cast("long").alias("at"), F.col("v").cast("long").alias("x"), F.lit(0).cast("long").alias("id"))
    questions = asked.select("ref_id", node("i", cell).alias("node"), (F.col("i") * sign).alias("place"), F.lit(UP_TO).alias("kind"), F.lit(0).cast("long").alias("at"), F.col("bound").cast("long").alias("x"), F.col("id").cast("long").alias("id"))
    above = (F.floor(F.abs("node") / fan) * sign).cast("long").alias("node")
    levels = [_level(own.unionByName(questions), "stairs", ref_type)]
    while True:
        done = levels[-1]
        cells = done.groupBy("ref_id").agg((F.max("node") - F.min("node")).alias("n")).agg(F.max("n")).first()[0] or 0
        if not cells:
            break
        # a level up: steps are the values of their cell, a cell's open questions come before its own steps
        steps = done.where(F.col("kind") == STEP).select("ref_id", above, F.col("node").alias("place"), F.lit(VALUE).alias("kind"), "at", "x", F.lit(0).cast("long").alias("id"))
        opened = done.where((F.col("kind") == ANSWER) & F.col("at").isNull()).select("ref_id", "node", "x").distinct()
        opened = opened.select("ref_id", above, F.col("node").alias("place"), F.lit(BEFORE).alias("kind"), F.lit(0).cast("long").alias("at"), "x", F.col("node").alias("id"))
        levels.append(_level(steps.unionByName(opened), "stairs", ref_type))
    found = None
    for done in reversed(levels):
        answers = done.where(F.col("kind") == ANSWER).select("ref_id", "node", "x", "id", "at")
        if found is not None:
            up = found.select("ref_id", F.col("id").alias("node"), "x", F.col("at").alias("_up"))
            answers = answers.join(up, ["ref_id", "node", "x"], "left").withColumn("at", F.coalesce("at", "_up")).drop("_up")
        found = answers
    return found.select("ref_id", "id", (F.col("at") * sign).alias("found"))
