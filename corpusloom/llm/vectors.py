"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

A unit vector x falls, in each of L hash tables, into the bucket of its P
quantised random projections floor((a x + b) / WIDTH). Vectors of cosine 0.98
are at most 0.2 apart, where one projection agrees with probability 0.84;
unlike ones agree with 0.27. P grows with the logarithm of the number of
vectors, so that unlike vectors meet about as rarely among many as among few,
and L with P, so that vectors of cosine 0.98 meet in a table with probability
0.999 (8 and 24 up to 20,000 vectors, 12 and 53 at three million); at more
similarity recall only rises. Every pair that meets is checked by its exact
cosine in double precision.

Equal vectors of a label are one class, compared once and counted as often as
they occur. A bucket of any size is cut into blocks and compared block against
block; a pair counts in the first table where it meets, so link numbers are
exact over the pairs found. Blocks return sums and a spanning forest, never
the pairs.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite
component, and vectors without a label, link with nothing; vectors of other
length are not compared; a null id stays, never kept, and counts as a vector;
repeated rows are copies; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, read_table, stored

THRESHOLD = 0.98
WIDTH = 1.0
#: Chance that a projection agrees for vectors of cosine 0.98 and for unlike ones, and that near ones meet in no table.
NEAR, UNLIKE, MISS = 0.84, 0.27, 0.001
BLOCK = 1024
#: Rows that a task's group of whole block pairs holds on average.
GROUP_ROWS = 20_000
_PLANES: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}


def shape(vectors: int) -> tuple[int, int]:
    """(projections, tables) for a number of vectors."""
    projections = 8 + max(0, math.ceil(math.log(max(1, vectors) / 20_000) / -math.log(UNLIKE)))
    return projections, round(math.log(MISS) / math.log(1 - NEAR**projections))


def planes(dim: int, projections: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    key = dim, projections, tables
    if key not in _PLANES:
        rng = np.random.default_rng([20240301, *key])
        _PLANES[key] = rng.standard_normal((dim, tables * projections)), rng.random(tables * projections) * WIDTH
    return _PLANES[key]


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; a prior division keeps squares in range."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def bucket_keys(v: np.ndarray, projections: int, tables: int) -> np.ndarray:
    """The 64-bit bucket of each row in each table."""
    a, b = planes(v.shape[1], projections, tables)
    q = np.floor((unit(v) @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(v), tables, projections)
    out = np.zeros((len(v), tables), np.uint64)
    for k in range(projections):
        out = (out ^ q[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _hashed(batches: Iterator[pd.DataFrame], projections: int, tables: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys: list = [None] * len(batch)
        for dim, rows in batch.groupby("dim").indices.items():
            found = bucket_keys(np.stack([np.asarray(x, np.float64) for x in batch["v"].iloc[rows]]), projections, tables)
            for r, k in zip(rows, found):
                keys[r] = k
        yield batch.assign(keys=keys)


def _by_length(at: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Rows that meet, by vector length: different ones meet by a collision of buckets only."""
    if len(at) < 2 or (size[at] == size[at[0]]).all():
        return [at]
    return [at[size[at] == d] for d in np.unique(size[at])]


def _compared(rows: pd.DataFrame) -> pd.DataFrame:
    """Link counts and a spanning forest of the block pairs in ``rows``."""
    out_a, out_b, out_n = [], [], []
    bucket, table, i, j, own, rep, copies = (rows[c].to_numpy(np.int64) for c in ("bucket", "t", "i", "j", "own", "rep", "copies"))
    keys = np.stack(rows["keys"].tolist())
    raw = rows["v"].tolist()
    order = np.lexsort((j, i, bucket))
    cut = np.flatnonzero((np.diff(bucket[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
    size = rows["dim"].to_numpy(np.int64)
    for at in (part for whole in np.split(order, cut) for part in _by_length(whole, size)):
        first = at[0]
        left, right = at[own[at] == i[first]], at[own[at] == j[first]]
        if not len(left) or not len(right):
            continue
        x = unit(np.stack([raw[k] for k in left]).astype(np.float64))
        y = x if i[first] == j[first] else unit(np.stack([raw[k] for k in right]).astype(np.float64))
        near = x @ y.T >= THRESHOLD
        if i[first] == j[first]:
            near = np.triu(near, 1)
        if not near.any():
            continue
        for s in range(table[first]):  # a pair counts where it meets first
            near &= keys[left, s][:, None] != keys[right, s][None, :]
        for who, n in ((left, near @ copies[right]), (right, near.T @ copies[left])):
            some = n > 0
            out_a += rep[who[some]].tolist()
            out_b += [None] * int(some.sum())
            out_n += n[some].tolist()
        root: dict = {}

        def find(z: int, root: dict = root) -> int:
            while root.get(z, z) != z:
                z = root[z]
            return z

        for p, q in zip(*np.nonzero(near)):
            a, b = find(int(rep[left[p]])), find(int(rep[right[q]]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out_a.append(int(rep[left[p]]))
                out_b.append(int(rep[right[q]]))
                out_n.append(0)
    return pd.DataFrame({"a": pd.Series(out_a, dtype="Int64"), "b": pd.Series(out_b, dtype="Int64"), "n": pd.Series(out_n, dtype="Int64")})


def near_vectors(table: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label)."""
    # components travel as they are stored; all arithmetic is in double precision
    kind = "float" if table.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    v = F.col("embedding").cast(f"array<{kind}>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = table.select("vec_id", F.col("label").cast("string").alias("label"), v.alias("v"))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & sound, F.lit(False))
    rows = rows.withColumn("v", F.when(usable, F.transform("v", lambda x: F.when(x == 0, F.lit(0).cast(kind)).otherwise(x))))
    key = [F.when(F.col("v").isNotNull(), F.xxhash64("label", "v", F.lit(s))).alias(f"k{s}") for s in (1, 2)]
    keyed = rows.select("vec_id", *key, "label", "v")
    # a class is named by a number of its own, since ids may be null
    groups = keyed.where("v is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    groups = groups.select(F.monotonically_increasing_id().alias("rep"), "k1", "k2", "least", "copies", "label", "v", F.size("v").alias("dim"))
    groups = stored(groups, "vector-groups")
    projections, tables = shape(groups.count())
    groups = stored(groups.mapInPandas(lambda batches: _hashed(batches, projections, tables), f"rep long, k1 long, k2 long, least long, copies long, label string, v array<{kind}>, dim int, keys array<long>"), "vector-classes")

    posted = groups.select("rep", "label", "dim", F.posexplode("keys").alias("t", "key")).select("rep", "dim", "t", F.xxhash64("label", "dim", "t", "key").alias("bucket"))
    # buckets of several tables with the same members (by number and two hashes) are one: the first table counts their pairs
    hashes = [F.bit_xor(F.xxhash64("rep", F.lit(s))).alias(f"x{s}") for s in (1, 2)]
    full = posted.groupBy("bucket").agg(F.count("*").alias("m"), F.min("t").alias("t"), *hashes).where("m > 1")
    full = full.groupBy("m", "x1", "x2").agg(F.min(F.struct("t", "bucket")).alias("x")).select(F.col("x.bucket").alias("bucket"), F.ceil(F.col("m") / BLOCK).cast("int").alias("parts"))
    live = posted.join(full, "bucket").withColumn("own", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("parts")).cast("int"))
    live = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    live = stored(live.select("rep", "dim", "t", "bucket", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")), "vector-postings")
    share = max(1, live.count() // GROUP_ROWS)
    live = live.withColumn("g", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(share)))
    met = live.join(groups.select("rep", "copies", "v", "keys"), "rep")
    found = stored(met.groupBy("g").applyInPandas(_compared, "a long, b long, n long"), "vector-links")

    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    label = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    named = groups.select("rep", "k1", "k2", "least", "copies").join(links, "rep", "left").join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = keyed.select("vec_id", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("k1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op8_vector_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


#: All pairs of a label in double precision; copies are linked like any pair.
ORACLE = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as x from embeddings),
o as (select vec_id, label, x, sqrt(list_inner_product(x, x)) as n from v
  where label is not null and len(x) > 0 and len(list_filter(x, lambda y: y is null or not isfinite(y))) = 0 and len(list_filter(x, lambda y: y <> 0)) > 0),
g as (select a.vec_id as a, b.vec_id as b from o a join o b on a.label = b.label and len(a.x) = len(b.x) and a.vec_id <> b.vec_id
  where case when len(a.x) = len(b.x) then list_inner_product(a.x, b.x) / (a.n * b.n) >= 0.98 end),
t(a, b) as (select a, b from g union select t.a, g.b from t join g on t.b = g.a),
c as (select a, least(a, min(b)) as component from t group by a),
k as (select a, count(*) as n from g group by a)
select vec_id, coalesce(k.n, 0) as n_links, coalesce(c.component, vec_id) as component_id, coalesce(c.component, vec_id) = vec_id as kept
from v left join c on c.a = vec_id left join k on k.a = vec_id
"""
