"""Session-level helpers shared by all operators: shared storage, lineage cuts, table loading."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

FOLDER = "echoloom"
#: Paths written in this process and not yet removed.
WRITTEN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is made and set, on a local master only: on a cluster the
    executors couldn't see it, so there the absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="echoloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{FOLDER}"


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    WRITTEN.discard(path)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files; otherwise all of a query's stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialize(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back; lineage ends there, so a lost
    executor costs at most a re-read. Returns the new frame and its path (for ``drop_path``)."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    WRITTEN.add(path)
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """``materialize`` when the path isn't needed; ``intermediates`` removes it."""
    return materialize(df)[0]


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``cut`` of what ``make`` gives; whatever else was written for it is removed."""
    before = set(WRITTEN)
    df, path = materialize(make())
    for other in WRITTEN - before - {path}:
        drop_path(spark, other)
    return df


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Removes on leaving what was written to the shared folder inside: consume a query's result before that."""
    before = set(WRITTEN)
    try:
        yield
    finally:
        for path in WRITTEN - before:
            drop_path(spark, path)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(WRITTEN) if spark else ():
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


atexit.register(_at_exit)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
