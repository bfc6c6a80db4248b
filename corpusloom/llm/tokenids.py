"""Packed token ids in binary rows: best-fit-decreasing with a segment tree over bin capacities.

Documents are encoded, ended by the end id and cut into pieces of at most
``capacity`` tokens without loss. A task packs the pieces of its rows in blocks
of about ``BLOCK_TOKENS`` tokens: longest first, each into the fullest open bin
that still holds it. The bin is found by a search in a segment tree over free
capacities, in a logarithm of ``capacity`` steps. Packing in blocks needs no
shuffle of ids and bounds memory; its price is at most a few underfull rows
a block, about one in a thousand.

A row is one sequence: its ids as little-endian unsigned numbers padded with
``pad`` to the full width (so a column of rows is a matrix), the cumulative
segment lengths, the offsets where positions start again at 0, and the
document, piece and start of each segment, from which texts are restored.

Defined cases: a null or empty text is the end id alone; repeated rows and
null ids are packed like others; texts of any length are cut; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .packing import CAPACITY, pieces_of
from .shared import read_table
from .tokens import encoder

BLOCK_TOKENS = 2_000_000


class CapacityTree:
    """Open bins by free capacity; ``take(n)`` gives the fullest bin with at least ``n`` free."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, free: int, bin_: int) -> None:
        self.bins[free].append(bin_)
        self._add(free, 1)

    def _add(self, free: int, n: int) -> None:
        at = free + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(bin, its free capacity) or None."""
        at = least + self.leaves
        if not self.count[at]:
            # up to the first right neighbour that holds a bin, then down its left side
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        free = at - self.leaves
        self._add(free, -1)
        return self.bins[free].pop(), free


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """The indices of ``lengths`` in each bin."""
    tree, bins = CapacityTree(capacity), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = tree.take(lengths[k])
        if found is None:
            bins.append([])
            found = len(bins) - 1, capacity
        bin_, free = found
        bins[bin_].append(k)
        if free > lengths[k]:
            tree.put(free - lengths[k], bin_)
    return bins


def packed_rows(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, width: int | None = None, pad: int = 0) -> DataFrame:
    """One row per sequence; ``width`` bytes an id: 2 or 4, by default the least that holds the vocabulary (and ``pad``)."""
    if (most := max(encoder(path).size - 1, pad)) >= 1 << 8 * (width := width or (2 if most < 1 << 16 else 4)):
        raise ValueError(f"{width} bytes don't hold the id {most}")
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"sequence_id long, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{key}>, pieces array<int>, starts array<long>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, context = encoder(path), TaskContext.get()
        number = (context.partitionId() if context else 0) << 40
        held: list[tuple] = []
        tokens = 0

        def flush() -> pd.DataFrame:
            nonlocal number
            rows = []
            for bin_ in best_fit_decreasing([len(x[3]) for x in held], capacity):
                segments = [held[k] for k in bin_]
                ends = np.cumsum([len(s[3]) for s in segments])
                ids = np.full(capacity, pad, f"<u{width}")
                ids[: ends[-1]] = np.concatenate([s[3] for s in segments])
                starts = [0, *ends[:-1].tolist()]
                rows.append((number, int(ends[-1]), len(segments), ids.tobytes(), [0, *ends.tolist()], starts, [s[0] for s in segments], [s[1] for s in segments], [s[2] for s in segments]))
                number += 1
            return pd.DataFrame(rows, columns=["sequence_id", "n_tokens", "n_segments", "ids", "cu_seqlens", "position_resets", "doc_ids", "pieces", "starts"])

        for batch in batches:
            keys = [None if x is None or x != x else x for x in batch["doc_id"].astype(object)]
            for doc, text in zip(keys, batch["text"]):
                ids = encode.ended(text).astype(f"<u{width}")
                for k, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                    held.append((doc, k, start, ids[start : start + length]))
                tokens += len(ids)
                if tokens >= BLOCK_TOKENS:
                    yield flush()
                    held, tokens = [], 0
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInPandas(run, schema)


def position_ids(row) -> np.ndarray:
    """Positions of a row's tokens, counted anew in every segment."""
    ends = np.asarray(row["cu_seqlens"])
    return np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))


def op2_token_ids(spark, sf_dir: str) -> DataFrame:
    return packed_rows(read_table(spark, sf_dir, "documents"))
