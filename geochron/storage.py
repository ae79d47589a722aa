"""Places that all executors share, and tables that cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR = "file:///tmp/checkpoints"
_passing: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("passing", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only where that is unset and everything runs on this machine, as in tests."""
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        found = sc._jsc.sc().getCheckpointDir()
        if found.isDefined():
            place = found.get()
        elif sc.master == "local" or sc.master.startswith("local["):
            place = _OWN_DIR
        else:
            raise ValueError("spark.checkpoint.dir isn't set: on a cluster it must name a folder that driver and executors share")
    return place.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/geochron-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The rows as a Parquet table in the shared folder: later plans start from files, and lost executors lose nothing.

    Within passing_tables() it is deleted at the end, unless it is to be kept.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    if (held := _passing.get()) is not None and not keep:
        held.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing_tables() -> Iterator[None]:
    """Deletes, at its end, the tables that are written within it.  What leaves it must be a kept table, as nothing lazy may read the others any more."""
    token = _passing.set([])
    try:
        yield
    finally:
        for spark, path in _passing.get():
            remove(spark, path)
        _passing.reset(token)


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by written(); nothing that will still be run may read them."""
    for df in tables:
        for path in {p.rpartition("/")[0] for p in df.inputFiles()}:
            if "/geochron-" in path:
                remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
