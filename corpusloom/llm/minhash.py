"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

1. A document's set holds its distinct five-word shingles (64-bit hashes);
   documents with equal sets collapse to one class, so copies are never
   compared with each other.
2. Each class posts its K signature coordinates as (coordinate, value)
   elements. Elements that occur once cannot collide and go. A class with m
   shared elements can only reach T collisions if it meets its partner among
   its m - T + 1 rarest ones (prefix merging), so only these are posted.
3. Within a posting list collisions are counted on whole signatures, blocks
   against blocks; a pair counts in the first list it shares (skip merging).
   Lists of any length are cut into blocks, so no task holds a whole list, and
   no pair is emitted: only which documents must meet in which block.
4. There they are compared on their full sets, and each block returns a
   spanning forest of its links, which joins the same documents as all links.

A pair is missed only if fewer than T = 10 of its K = 24 coordinates agree,
which has probability 1.5e-7 at similarity 0.85 (the query) and 6.7e-6 at 0.8
(the pipeline's stage); every link that is returned is exact.

Defined cases: null and whitespace texts have an empty set and link with
nothing; texts of fewer than five words are one shingle; texts with a null id
link like all others, and are never kept or a component's id, which is null
where no document has one; repeated rows share the class of their text; an id
with several texts is in several classes; an empty table gives an empty result;
other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .shared import components, plain, read_table, remove, restored, stored

K, T = 24, 10
WIDTH = 5
#: Percent of the union that the intersection must reach, in the query and in the pipeline's stage.
PERCENT, STAGE_PERCENT = 85, 80
#: Shingles that a block of a posting list holds on average.
BLOCK_SHINGLES = 250_000
BLOCK_DOCS = 250


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 60_000:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    # bytes.lower and bytes.split act on ASCII letters and ASCII white space only
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - WIDTH + 1)
    # a short text is one shingle of another length: the length takes part
    out = np.full(n, min(len(words), WIDTH), np.uint64)
    for j in range(min(WIDTH, len(words))):
        out = _mix(out ^ (h[j : j + n] * _MULTIPLIERS[j]))
    return np.unique(out)


_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**63, K, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, K, dtype=np.uint64)


def signature(h: np.ndarray) -> np.ndarray:
    """K minimum hashes, the upper 32 bits of each as signed integers."""
    out = np.empty(K, np.uint32)
    for k in range(K):
        x = (h + _B[k]) * _A[k]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        out[k] = x.min() >> np.uint64(32)
    return out.view(np.int32)


def _with_sketch(docs: DataFrame) -> T_.StructType:
    new = [("_n", T_.LongType()), ("_set", T_.BinaryType()), ("_sig", T_.ArrayType(T_.IntegerType()))]
    return T_.StructType(docs.schema.fields + [T_.StructField(n, t) for n, t in new])


def sketched(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_n`` (set size), ``_set`` (128-bit digest of the set, null if empty) and ``_sig``."""
    schema = _with_sketch(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, key, sig = [], [], []
            for t in batch[text]:
                h = shingles(t)
                n.append(len(h))
                key.append(xxh3_128_digest(h.tobytes()) if len(h) else None)
                sig.append(signature(h) if len(h) else None)
            yield batch.assign(_n=n, _set=key, _sig=sig)

    return docs.mapInPandas(run, schema)


def _sketch_only(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """As :func:`sketched`, with ``columns`` only; the texts aren't sent back to the JVM."""
    kept = docs.select(*columns, text)
    schema = _with_sketch(docs.select(*columns))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hs = [shingles(t) for t in batch[text]]
            yield batch[columns].assign(
                _n=[len(h) for h in hs],
                _set=[xxh3_128_digest(h.tobytes()) if len(h) else None for h in hs],
                _sig=[signature(h) if len(h) else None for h in hs],
            )

    return kept.mapInPandas(run, schema)


def _blocks(postings: DataFrame) -> DataFrame:
    """Postings (cls, sig, n, prefix, e) dealt to block pairs: adds ``i`` and ``j`` (block numbers, i <= j) and ``own`` (the row's block).

    Only long lists have more than one block; their table is small beside the
    postings and is joined under Spark's size check, so postings stay where they are.
    """
    size = postings.groupBy("e").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    parts = F.ceil(F.greatest(F.col("w") / BLOCK_SHINGLES, F.col("m") / BLOCK_DOCS)).cast("int")
    long_ = stored(size.select("e", parts.alias("parts")).where("parts > 1"), "near-long-lists")
    n_parts = F.coalesce("parts", F.lit(1))
    return (
        postings.join(long_, "e", "left")
        .withColumn("own", F.pmod(F.xxhash64("cls", F.lit(7)), n_parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), n_parts - 1)))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        .drop("other", "parts")
    )


def _shared_out(df: DataFrame, rows: int, per_share: int) -> DataFrame:
    """Adds ``g``: whole block pairs dealt to groups of about ``per_share`` rows, so that a group's fixed cost is paid once for many."""
    return df.withColumn("g", F.pmod(F.xxhash64("e", "i", "j"), F.lit(max(1, rows // per_share))))


def _by_block(rows: pd.DataFrame) -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
    """((element, i, j), row numbers) of each block pair."""
    e, i, j = (rows[c].to_numpy(np.int64) for c in ("e", "i", "j"))
    order = np.lexsort((j, i, e))
    cut = np.flatnonzero((np.diff(e[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
    for at in np.split(order, cut):
        if len(at) > 1:
            yield (int(e[at[0]]), int(i[at[0]]), int(j[at[0]])), at


def _meetings(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Which documents of each block pair must be compared on their sets."""
    sig, n, own = np.stack(rows["sig"].tolist()), rows["n"].to_numpy(np.int64), rows["own"].to_numpy()
    ids, prefixes = rows["cls"].to_numpy(np.int64), rows["prefix"].tolist()
    found = []
    for (e, i, j), at in _by_block(rows):
        left, right = at[own[at] == i], at[own[at] == j]
        chosen: set = set()
        before: dict = {}

        def earlier(x: int, e: int = e, before: dict = before) -> frozenset:
            """The document's elements before this one, in the order that all documents share."""
            if x not in before:
                p = prefixes[x].tolist()
                before[x] = frozenset(p[: p.index(e)])
            return before[x]

        for q, a in enumerate(left):
            others = right[q + 1 :] if i == j else right
            lo, hi = np.minimum(n[others], n[a]), np.maximum(n[others], n[a])
            ok = ((sig[others] == sig[a]).sum(1) >= T) & (100 * lo >= percent * hi)
            for b in others[ok].tolist():
                if not (a in chosen and b in chosen) and not earlier(int(a)) & earlier(b):
                    chosen |= {int(a), b}
        found += [(e, i, j, ids[x]) for x in chosen]
    return pd.DataFrame(found, columns=["e", "i", "j", "cls"]).astype("int64")


def _overlaps(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Intersection sizes of sets[rows] with sets[cols], by a matrix product over the shingles both sides have."""
    a, b = np.concatenate([sets[x] for x in rows]), np.concatenate([sets[x] for x in cols])
    common = np.intersect1d(a, b)
    out = np.zeros((len(rows), len(cols)), np.int64)
    step = max(1, 8_000_000 // max(len(rows), len(cols)))
    for at in range(0, len(common), step):
        part = common[at : at + step]

        def matrix(which: np.ndarray, part: np.ndarray = part) -> np.ndarray:
            m = np.zeros((len(which), len(part)), np.float32)
            for r, x in enumerate(which):
                p = np.searchsorted(part, sets[x])
                ok = p < len(part)
                p = p[ok]
                m[r, p[part[p] == sets[x][ok]]] = 1
            return m

        out += (matrix(rows) @ matrix(cols).T).astype(np.int64)
    return out


def _linked_pairs(sets: list[np.ndarray], n: np.ndarray, percent: int, tile: int = 192) -> Iterator[tuple[int, int]]:
    """All pairs of sets that reach the similarity."""
    if len(sets) <= 8:
        for p in range(len(sets)):
            for q in range(p):
                if 100 * min(n[p], n[q]) >= percent * max(n[p], n[q]):
                    both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                    if 100 * both >= percent * (n[p] + n[q] - both):
                        yield p, q
        return
    for x in range(0, len(sets), tile):
        for y in range(x, len(sets), tile):
            r, c = np.arange(x, min(x + tile, len(sets))), np.arange(y, min(y + tile, len(sets)))
            both = _overlaps(sets, r, c)
            union = n[r][:, None] + n[c][None, :] - both
            for p, q in zip(*np.nonzero(100 * both >= percent * union)):
                yield int(r[p]), int(c[q])


def _links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """A spanning forest of the exact links among the documents of each block pair."""
    edges = []
    ids, texts = rows["cls"].to_numpy(np.int64), rows["text"].tolist()
    for _, at in _by_block(rows):
        at = at[np.argsort(ids[at], kind="stable")]
        sets = [shingles(texts[x]) for x in at]
        n = np.array([len(s) for s in sets])
        root = list(range(len(at)))

        def find(x: int, root: list = root) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for p, q in _linked_pairs(sets, n, percent):
            a, b = find(p), find(q)
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((ids[at[p]], ids[at[q]]))
    return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")


def classes(sketch: DataFrame) -> DataFrame:
    """One row per distinct set: ``_set``, ``cls`` (its number, fixed once the table is stored), ``rep`` (least id, null if it has none), ``n``, ``sig``."""
    groups = sketch.where("_set is not null").groupBy("_set").agg(F.min("doc_id").alias("rep"), F.first("_n").alias("n"), F.first("_sig").alias("sig"))
    return groups.withColumn("cls", F.monotonically_increasing_id())


def _several(sketch: DataFrame) -> DataFrame:
    """``_id``: ids that occur on several rows."""
    return sketch.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id"))


def similar_classes(groups: DataFrame, docs: DataFrame, sketch: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Stored links (a, b) between class numbers that join the same classes as all links would.

    ``docs`` has ``doc_id`` and ``text``, ``sketch`` its sets.
    """
    # the low six bits of a packed element are its coordinate
    packed = F.transform(F.col("sig"), lambda v, k: F.shiftleft(F.xxhash64(k, v), 6).bitwiseOR(k.cast("long")))
    posted = groups.select("_set", F.explode(packed).alias("e"))
    often = posted.groupBy("e").count().where("count > 1")
    # order of all elements: rarest first
    prefix = (
        posted.join(often, "e").groupBy("_set").agg(F.sort_array(F.collect_list(F.struct("count", "e"))).alias("x"))
        .where(F.size("x") >= T).select("_set", F.slice("x", F.lit(1), F.size("x") - (T - 1)).alias("x"))
    )
    lists = groups.join(prefix, "_set").select("cls", "n", "sig", F.col("x.e").alias("prefix"), F.explode("x.e").alias("e"))
    lists = stored(lists, "near-postings")
    dealt = stored(_blocks(lists), "near-blocks")
    met = _shared_out(dealt, dealt.count(), 10_000).groupBy("g").applyInPandas(lambda rows: _meetings(rows, percent), "e long, i long, j long, cls long")
    meet = stored(met, "near-meetings")
    # neither side of this join is bounded, so neither is broadcast at any size
    wanted = meet.select("cls").distinct().join(groups.select("cls", "rep", "_set"), "cls").hint("merge")
    block = _shared_out(meet, meet.count(), 100).join(_texts(docs, wanted, sketch), "cls")
    links = stored(block.groupBy("g").applyInPandas(lambda rows: _links(rows, percent), "a long, b long").distinct(), "near-links")
    for done in (lists, dealt, meet):
        remove(done)
    return links


def _texts(docs: DataFrame, wanted: DataFrame, sketch: DataFrame) -> DataFrame:
    """(cls, text): one text with the set of each class of ``wanted`` (cls, rep, _set).

    An id on one row tells the text. Where the least id is null or on several
    rows, the text is found by its set.
    """
    docs, several = docs.select("doc_id", "text"), stored(_several(sketch), "near-several")
    no_id = sketch.where("doc_id is null").limit(1).count() > 0
    repeated = not several.isEmpty()
    by_id = docs.join(wanted, docs["doc_id"] == wanted["rep"])
    if not (no_id or repeated):
        return by_id.select("cls", "text")
    rows = docs.where("doc_id is null")
    if repeated:
        by_id = by_id.join(several, by_id["rep"] == several["_id"], "left_anti")
        rows = rows.union(docs.join(several, docs["doc_id"] == several["_id"], "left_semi"))
        wanted = wanted.join(several, wanted["rep"] == several["_id"], "left").where("rep is null or _id is not null")
    else:
        wanted = wanted.where("rep is null")
    found = sketched(rows).where("_set is not null").groupBy("_set").agg(F.first("text").alias("text"))
    return by_id.select("cls", "text").union(found.join(wanted.select("cls", "_set"), "_set").select("cls", "text"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links at ``percent`` of the union; one row per document: ``doc_id``, ``_set``, ``_group`` (number of the component), ``n_shingles``, ``component_id``, ``kept``."""
    sketch = stored(_sketch_only(docs, ["doc_id"]), "near-sketches")
    groups = stored(classes(sketch), "near-classes")
    found = components(similar_classes(groups, docs, sketch, percent)).select(F.col("node").alias("cls"), F.col("component").alias("_group"))
    # a component's id is the least of its documents'
    linked = stored(found.join(groups.select("cls", "rep"), "cls"), "near-linked")
    least = linked.groupBy("_group").agg(F.min("rep").alias("_least"))
    label = (
        groups.select("_set", "cls", "rep").join(linked.select("cls", "_group").join(least, "_group"), "cls", "left")
        .select("_set", F.coalesce("_group", "cls").alias("_group"), F.coalesce("_least", "rep").alias("component"))
    )
    out = sketch.select("doc_id", "_n", "_set").join(label, "_set", "left")
    component = F.when(F.col("_set").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select(
        "doc_id", "_set", "_group", F.col("_n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def op3_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return near_duplicates(docs.select("doc_id", "text")).drop("_set", "_group")


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays, once.

    Documents without words are linked with nothing and stay. Of a group
    without any id one document stays.
    """
    used = ("doc_id", "text")
    return restored(_one_of_each(plain(docs, *used)), docs, *used)


def _one_of_each(docs: DataFrame) -> DataFrame:
    found = stored(near_duplicates(docs.select("doc_id", "text"), STAGE_PERCENT), "near-result")
    keep = found.where("doc_id is not null and (kept or _set is null)").select(F.col("doc_id").alias("_id")).distinct()
    # the kept ids grow with the input: they are merged, never broadcast
    out = docs.join(keep.hint("merge"), docs["doc_id"] == keep["_id"], "left_semi")
    names = [F.col(f"`{c}`") for c in docs.columns]
    again = stored(_several(found), "near-again")
    no_id = found.where("doc_id is null").limit(1).count() > 0
    if not no_id and again.isEmpty():
        return out.select(*names)
    # rows that no id tells apart stay by their set: the least of the component's
    rows = out.join(again, out["doc_id"] == again["_id"], "left_semi").select(*names).union(docs.where("doc_id is null").select(*names))
    rows = stored(sketched(rows), "near-untold")
    able = found.where("_set is not null and (kept or doc_id is null and component_id is null)")
    first = able.groupBy("_group").agg(F.min(F.struct("doc_id", "_set")).alias("x")).select(F.col("x.doc_id").alias("_id"), F.col("x._set").alias("_s"))
    once = rows.where("_set is not null").dropDuplicates(["doc_id", "_set"])
    once = once.join(first.hint("merge"), once["doc_id"].eqNullSafe(first["_id"]) & (once["_set"] == first["_s"]), "left_semi")
    told = out.join(again, out["doc_id"] == again["_id"], "left_anti").select(*names)
    return told.union(once.select(*names)).union(rows.where("_set is null").select(*names))


#: All shingles are joined exactly, so it suits small tables; components are the reachable pairs of distinct sets.
ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as a from documents),
l as (select doc_id, list_distinct(list_transform(range(1, greatest(len(a) - 4, 1) + 1), lambda i: array_to_string(a[i:i + 4], ' '))) as s from w where len(a) > 0),
u as (select md5(array_to_string(list_sort(s), chr(10))) as k, min(doc_id) as rep, any_value(s) as s from l group by k),
x as (select rep, len(s) as n, unnest(s) as h from u),
p as (select a.rep as a, b.rep as b, any_value(a.n) as n, any_value(b.n) as m, count(*) as shared from x a join x b on a.h = b.h and a.rep < b.rep group by all),
e as (select a, b from p where 100 * shared >= 85 * (n + m - shared)),
g as (select a, b from e union all select b, a from e),
t(a, b) as (select a, b from g union select t.a, g.b from t join g on t.b = g.a),
c as (select a, least(a, min(b)) as component from t group by a)
select w.doc_id, coalesce(len(l.s), 0) as n_shingles, coalesce(c.component, u.rep, w.doc_id) as component_id, coalesce(c.component, u.rep, w.doc_id) = w.doc_id as kept
from w left join l using (doc_id) left join u on u.k = md5(array_to_string(list_sort(l.s), chr(10))) left join c on c.a = u.rep
"""
