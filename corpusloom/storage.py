"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextvars
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where that is unset, a local session (one machine, so any folder is shared)
    uses one below its warehouse; on a cluster there is no folder to guess.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that driver and executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:") + "/_shared"
        spark.conf.set(CHECKPOINT_DIR, folder)
    return folder.rstrip("/")


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package, wherever the driver was started; other machines get it by ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, root) if x)


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; other applications have their own."""
    return f"{shared_folder(spark)}/corpusloom/{spark.sparkContext.applicationId}"


#: Paths given out inside the innermost :func:`stored_alone`, which is this thread's own.
_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("paths", default=None)
#: Where tables that queries share are: (application, what it is) to path.
_kept: dict[tuple, str] = {}


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (scope := _scope.get()) is not None:
        scope.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it again: the lineage is cut, and sizes are known to the planner."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_alone(build, spark: SparkSession, name: str) -> DataFrame:
    """Store what ``build()`` returns and delete the tables that were stored on the way in this thread."""
    mark = _scope.set(given := [])
    try:
        out = stored(build(), name)
    finally:
        _scope.reset(mark)
    for path in given[:-1]:
        delete(spark, path)
    if (scope := _scope.get()) is not None:
        scope.append(given[-1])
    return out


def kept(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` made from the files of the folder ``source``: built once for an application and read again by other queries.

    It is built anew if those files have changed or the table was deleted. Tables that were stored on the way are deleted, save those that are kept themselves.
    """
    key = (spark.sparkContext.applicationId, name, source, files(spark, source))
    path = _kept.get(key)
    if path is None or not exists(spark, f"{path}/_SUCCESS"):
        mark = _scope.set(given := [])  # it outlives the scope it is built in
        try:
            path = new_path(spark, name)
            build().write.parquet(path)
        finally:
            _scope.reset(mark)
        for other in given[1:]:
            delete(spark, other)
        _kept[key] = path
    return spark.read.parquet(path)


def _of(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _of(spark, path)
    return system.exists(where)


def files(spark: SparkSession, path: str) -> tuple:
    """(name, length, time of change) of a file or of what lies in a folder."""
    where, system = _of(spark, path)
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in system.listStatus(where)))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    where, system = _of(spark, path)
    system.delete(where, True)


def cleared(spark: SparkSession) -> None:
    """Delete this application's intermediate tables. Only when no result that reads them is needed any more: results are read from them lazily."""
    delete(spark, own_folder(spark))


def remove(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored` that nothing needs any more."""
    spark = df.sparkSession
    tail = f"{own_folder(spark)}/".split(":", 1)[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if tail in folder:
            delete(spark, folder)
