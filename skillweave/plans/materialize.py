"""Cutting lineage through tables in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: the tables that were written and not dropped yet, in order
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one on a local master; on a cluster that
    is an error, as executors would write to disks of their own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all of {master} share")
        at = "file://" + tempfile.mkdtemp(prefix="skillweave-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, system = _file_system(spark, path)
    return system.exists(hadoop)


def upload(spark: SparkSession, local: str, path: str) -> None:
    """Moves a local file of the driver to any Hadoop path, over what is there."""
    target, system = _file_system(spark, path)
    system.mkdirs(target.getParent())
    # a local file system would leave a checksum file beside it
    system.setWriteChecksum(False)
    system.copyFromLocalFile(True, True, spark._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), target)


def join_parts(spark: SparkSession, folder: str, path: str) -> None:
    """Makes one file of the part files of a folder, in the order of their partitions, over what is at path; each
    part goes as soon as it is copied."""
    source, held = _file_system(spark, folder)
    target, system = _file_system(spark, path)
    system.mkdirs(target.getParent())
    system.setWriteChecksum(False)
    found = [x.getPath() for x in held.listStatus(source)]
    parts = sorted((x for x in found if x.getName().startswith("part-")), key=lambda x: (int(x.getName().split("-")[1]), x.getName()))
    out = system.create(target, True)
    try:
        for part in parts:
            own = held.open(part)
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(own, out, 1 << 16, False)
            finally:
                own.close()
            held.delete(part, False)
    finally:
        out.close()
    held.delete(source, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back.

    The files survive the loss of an executor, are compressed and column-pruned on reading. They are removed by
    ``release``, at the end of the ``scratch`` they were written in, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skillweave-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop, system = _file_system(spark, path)
    system.deleteOnExit(hadoop)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._skillweave_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Drop materialised tables that no plan reads any more."""
    _drop({t._skillweave_path for t in tables})


def _drop(paths: set[str]) -> None:
    for spark, path in [x for x in _written if x[1] in paths]:
        _written.remove((spark, path))
        hadoop, system = _file_system(spark, path)
        system.delete(hadoop, True)
        system.cancelDeleteOnExit(hadoop)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """All tables that are materialised inside are dropped at the end, but for those put on the list that it gives;
    results must be written or collected before.

    For sessions that run many queries: ``with scratch(): query(spark, path).write...``
    """
    before = {path for _, path in _written}
    keep: list[DataFrame] = []
    try:
        yield keep
    finally:
        _drop({path for _, path in _written} - before - {t._skillweave_path for t in keep})
