"""Embedding whitening by hierarchical merging of singular value decompositions.

A task keeps, of the vectors it has read, their number, the exact sum of each
dimension and the singular values and right vectors of the centred rows, all of
them (at most as many as dimensions): a summary of d * d numbers for any number
of rows. Two summaries merge by stacking both triangles and one row that
corrects for the difference of the means, ``sqrt(n1 n2 / n) (mean1 - mean2)``,
and decomposing anew; nothing is lost. Tasks' summaries merge in rounds of
:data:`FAN` as Spark groups, so the driver sees the last one only, whose size
the dimensions bound (d * d + d numbers; 33 kB for 64).

Entries are whole numbers ``x = floor(64 c) + 1000000``. Sums are of
``x - 1000000`` and exact, differences of means come from whole numbers, and
rows are centred as ``(n x - S) / n``, so the large common part of x costs no
digits. The whitened vectors' covariance is checked over all of them by a
second pass whose centred moments merge the same way.

Defined cases: vectors that are null or hold null or non-finite entries are
dropped; shorter vectors count as ended by entries 0 up to the longest length;
entries beyond 2^52 / 64 count as that; components without variance (singular
value below 1e-13 of the greatest, times the dimensions) can't be whitened and
are not returned, so equal vectors alone, a single vector or an empty table
give no rows; a null id stays; a deviation beyond a long is its greatest value;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import read_table, stored

SCALE, OFFSET = 64.0, 1_000_000
COMPONENTS = 32
#: Summaries that one group merges.
FAN = 16
LARGEST = 2**52


def whole(vectors: list, dim: int) -> np.ndarray:
    """x - OFFSET of each entry, as long."""
    out = np.zeros((len(vectors), dim), np.int64)
    for row, v in zip(out, vectors):
        c = np.asarray(v, np.float64)
        with np.errstate(over="ignore"):
            row[: len(c)] = np.clip(np.floor(SCALE * c), -LARGEST, LARGEST)
    return out


def scaled(y: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """n * y - s exactly: long where that fits, else Python's integers."""
    most = n * max((int(np.abs(y).max()) if y.size else 0), 1) + max(map(abs, s.tolist()), default=0)
    return n * y - s if most < 2**62 else n * y.astype(object) - s.astype(object)


def summary(y: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, triangle) of rows: the triangle's rows are the singular values times the right vectors of the centred rows."""
    n, s = len(y), y.sum(0)
    return n, s, _triangle((scaled(y, n, s) / n).astype(np.float64))


def _triangle(rows: np.ndarray) -> np.ndarray:
    _, values, right = np.linalg.svd(rows, full_matrices=False)
    return values[:, None] * right


def merged(a: tuple, b: tuple) -> tuple[int, np.ndarray, np.ndarray]:
    (n1, s1, r1), (n2, s2, r2) = a, b
    n = n1 + n2
    # whole numbers of any size; their quotient is rounded once
    apart = np.array([(int(p) * n2 - int(q) * n1) / (n1 * n2) for p, q in zip(s1.tolist(), s2.tolist())])
    return n, s1 + s2, _triangle(np.vstack([r1, r2, np.sqrt(n1 / n * n2) * apart]))


def moments(w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = w.mean(0)
    return len(w), mean, (w - mean).T @ (w - mean)


def merged_moments(a: tuple, b: tuple) -> tuple[int, np.ndarray, np.ndarray]:
    (n1, m1, c1), (n2, m2, c2) = a, b
    n, apart = n1 + n2, m2 - m1
    return n, m1 + apart * (n2 / n), c1 + c2 + np.outer(apart, apart) * (n1 / n * n2)


def _told(x: tuple | None, kind: type) -> pd.DataFrame:
    rows = [] if x is None else [(x[0], x[1].astype(kind), np.ascontiguousarray(x[2]).ravel())]
    return pd.DataFrame(rows, columns=["n", "s", "r"])


def _read(row, kind: type) -> tuple:
    s = np.asarray(row.s, kind)
    return int(row.n), s, np.asarray(row.r, np.float64).reshape(-1, len(s))


def _merged_up(parts: DataFrame, merge, kind: type) -> tuple | None:
    """The one summary of a table (id, n, s, r), merged in rounds by FAN neighbouring ids, which leaves ids FAN times smaller; None if it is empty."""
    schema = parts.drop("id").schema
    rows = stored(parts, "summaries")
    while rows.count() > 1:

        def together(group: pd.DataFrame) -> pd.DataFrame:
            out = None
            for row in group.sort_values("id").itertuples():
                out = _read(row, kind) if out is None else merge(out, _read(row, kind))
            return _told(out, kind).assign(id=int(group["id"].iloc[0]) // FAN)[["id", "n", "s", "r"]]

        rows = stored(rows.groupBy(F.floor(F.col("id") / FAN)).applyInPandas(together, f"id long, {schema.simpleString()[7:-1].replace(':', ' ')}"), "summaries")
    row = rows.first()  # d * d + d numbers
    return None if row is None else _read(row, kind)


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    kind = "float" if table.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    v = F.col("embedding").cast(f"array<{kind}>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return table.select("vec_id", v.alias("v")).where(F.col("v").isNotNull() & sound)


def fitted(rows: DataFrame, dim: int) -> tuple | None:
    """(n, sums of x - OFFSET, triangle) of all vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            for k in range(0, len(batch), 1024):
                own = summary(whole(batch["v"].iloc[k : k + 1024].tolist(), dim))
                held = own if held is None else merged(held, own)
        yield _told(held, np.int64)

    parts = rows.select("v").mapInPandas(run, "n long, s array<long>, r array<double>")
    return _merged_up(parts.select(F.spark_partition_id().cast("long").alias("id"), "*"), merged, np.int64)


def _identity_error(rows: DataFrame, dim: int, whiten) -> float:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            own = moments(whiten(batch["v"].tolist())[1])
            held = own if held is None else merged_moments(held, own)
        yield _told(held, np.float64)

    parts = rows.select("v").mapInPandas(run, "n long, s array<double>, r array<double>")
    n, _, c = _merged_up(parts.select(F.spark_partition_id().cast("long").alias("id"), "*"), merged_moments, np.float64)
    return float(np.abs(c / n - np.eye(len(c))).max())


def whitened(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of (vec_id, embedding)."""
    rows = usable(table)
    id_type = table.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    fit = fitted(rows, dim) if dim else None
    if fit is None:
        return table.sparkSession.createDataFrame([], schema)
    n, s, triangle = fit
    _, values, right = np.linalg.svd(triangle, full_matrices=False)
    keep = int((values > values[0] * dim * 1e-13).sum()) if values[0] > 0 else 0
    if not keep:
        return table.sparkSession.createDataFrame([], schema)
    explained = (values * values / (values * values).sum())[: min(keep, components)]
    k = len(explained)
    # (n y - S) / n on a unit vector, over sqrt(e) = value / sqrt(n)
    axes = right[:k].T * (np.sqrt(n) / values[:k])

    def whiten(vectors: list) -> tuple[np.ndarray, np.ndarray]:
        far = scaled(whole(vectors, dim), n, s)
        return far, (far / n).astype(np.float64) @ axes

    error = _identity_error(rows, dim, whiten)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            far, w = whiten(batch["v"].tolist())
            most = int(np.abs(far).max()) ** 2 * dim
            deviation = (far * far).sum(1) if most < 2**63 else np.array([min(sum(int(x) ** 2 for x in row), 2**63 - 1) for row in far.tolist()])
            ids = batch["vec_id"].to_numpy()
            yield pd.DataFrame({
                "vec_id": np.repeat(ids, k), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch)), "n": n,
                "deviation": np.repeat(deviation.astype(np.int64), k), "whitened": w.ravel(), "explained": np.tile(explained, len(batch)), "identity_error": error})

    # ids travel as text, since pandas has no whole numbers with nulls
    out = rows.select(F.col("vec_id").cast("string").alias("vec_id"), "v").mapInPandas(run, schema.replace(f"vec_id {id_type}", "vec_id string"))
    return out.withColumn("vec_id", F.col("vec_id").cast(id_type))


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(read_table(spark, sf_dir, "embeddings"))
