"""A Spark data source of suffix arrays as one binary file of fixed-width pairs.

Format ``suffix_pairs``: record r of the file is the pair (doc_id, idx) of the
suffix of rank r, two little-endian 64-bit integers. As a record's place
follows from its rank, tasks write their ranks at their offsets into one file,
side by side and in any order, and a task that is repeated writes the same
bytes again. The file is made under a name of its own and renamed when all
tasks are done; a failed write leaves nothing.

Reading plans slices of whole records, ``sliceRecords`` (option, 1,000,000)
each, so a file of any size is many tasks' work, and gives (rank, doc_id, idx).

The path must be a file system that driver and executors mount alike. Ranks to
be written must be those of a whole array: each of 0 to n - 1 once.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

RECORD = np.dtype([("doc_id", "<i8"), ("idx", "<i8")])
SCHEMA = "rank bigint, doc_id bigint, idx bigint"
SLICE = 1_000_000
BATCH = 65_536


@dataclass
class Slice(InputPartition):
    first: int
    count: int


@dataclass
class Written(WriterCommitMessage):
    count: int
    least: int
    greatest: int
    ranks: int


class PairReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Slice]:
        length = os.path.getsize(self.path)
        if length % RECORD.itemsize:
            raise ValueError(f"{self.path} has {length} bytes, no whole number of pairs")
        n = length // RECORD.itemsize
        return [Slice(a, min(self.size, n - a)) for a in range(0, n, self.size)] or [Slice(0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as file:
            file.seek(partition.first * RECORD.itemsize)
            for a in range(partition.first, partition.first + partition.count, BATCH):
                rows = np.fromfile(file, RECORD, min(BATCH, partition.first + partition.count - a))
                yield pa.RecordBatch.from_arrays([np.arange(a, a + len(rows)), rows["doc_id"].copy(), rows["idx"].copy()], names=["rank", "doc_id", "idx"])


class PairWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        if os.path.exists(path) and not overwrite:
            raise FileExistsError(path)
        self.path, self.open = path, f"{path}.{uuid.uuid4().hex}"
        with open(self.open, "wb"):
            pass

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        count, least, greatest, total = 0, 1 << 62, -1, 0
        file = os.open(self.open, os.O_WRONLY)
        try:
            for batch in iterator:
                rank = batch.column("rank").to_numpy(zero_copy_only=False)
                if not len(rank):
                    continue
                rows = np.empty(len(rank), RECORD)
                rows["doc_id"], rows["idx"] = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "idx"))
                # ranks that follow one another are one write
                for part in np.split(np.arange(len(rank)), np.flatnonzero(np.diff(rank) != 1) + 1):
                    os.pwrite(file, rows[part[0] : part[-1] + 1].tobytes(), int(rank[part[0]]) * RECORD.itemsize)
                count, total = count + len(rank), total + int(rank.sum())
                least, greatest = min(least, int(rank.min())), max(greatest, int(rank.max()))
        finally:
            os.close(file)
        return Written(count, least, greatest, total)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        n = sum(m.count for m in done)
        if n and (min(m.least for m in done) != 0 or max(m.greatest for m in done) != n - 1 or sum(m.ranks for m in done) != n * (n - 1) // 2):
            self.abort(messages)
            raise ValueError("the ranks are not each of 0 to n - 1 once")
        os.replace(self.open, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.open):
            os.unlink(self.open)


class PairSource(DataSource):
    """``spark.dataSource.register(PairSource)``, then ``format("suffix_pairs")`` with ``load(path)`` or ``save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "suffix_pairs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PairReader:
        return PairReader(self.options["path"], int(self.options.get("sliceRecords", SLICE)))

    def writer(self, schema: StructType, overwrite: bool) -> PairWriter:
        if not {"rank", "doc_id", "idx"} <= set(schema.names):
            raise ValueError(f"rank, doc_id and idx are needed, not {schema.names}")
        return PairWriter(self.options["path"], overwrite)


def write_pairs(array, path: str) -> None:
    """A suffix array (rank, doc_id, idx) as such a file; ranks are sorted inside tasks, so that writes are long."""
    array.sparkSession.dataSource.register(PairSource)
    rows = array.select(*[array[c].cast("long").alias(c) for c in ("rank", "doc_id", "idx")])
    rows.repartitionByRange("rank").sortWithinPartitions("rank").write.format("suffix_pairs").mode("overwrite").save(path)


def read_pairs(spark, path: str, slice_records: int = SLICE):
    """(rank, doc_id, idx) of such a file."""
    spark.dataSource.register(PairSource)
    return spark.read.format("suffix_pairs").option("sliceRecords", slice_records).load(path)
