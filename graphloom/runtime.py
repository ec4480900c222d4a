"""Session plumbing shared by all operators: scratch tables, lineage cuts, code shipping."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_lock = threading.Lock()


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent (a local session, as in tests) is a
    temporary folder of this machine used; on a cluster the setting must exist.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by driver and executors")
    with _lock:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


#: Removes a query's shuffle files as soon as it ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder to cut lineage; dropped one by one or all at the end.

    A written table survives the loss of any executor, and the shuffle files that
    it was computed from are released as soon as it exists. What is not dropped
    goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, scratch_path(spark, name), 0

    def write(self, df: DataFrame, name: str = "t", partition_by: str | None = None) -> str:
        """The path of ``df``, written as Parquet."""
        self.n += 1
        path, conf = f"{self.root}/{self.n:03d}-{name}", self.spark.conf
        before = conf.get(RELEASE, None)
        conf.set(RELEASE, "true")
        try:
            (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
        finally:
            conf.set(RELEASE, before) if before is not None else conf.unset(RELEASE)
        if self.n == 1:
            delete_at_exit(self.spark, self.root)
        return path

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.write(df, name)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        delete_path(self.spark, df._scratch_path)

    def close(self) -> None:
        delete_path(self.spark, self.root)


def _located(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it takes it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _located(spark, path)
    fs.delete(p, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    fs, p = _located(spark, path)
    fs.deleteOnExit(p)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _located(spark, path)
    return fs.exists(p)


def rename_path(spark: SparkSession, path: str, to: str) -> None:
    fs, p = _located(spark, path)
    if not fs.rename(p, _located(spark, to)[1]):
        raise OSError(f"{path} cannot become {to}")


def write_bytes(spark: SparkSession, path: str, data: bytes, part: int = 4 << 20) -> None:
    """A file of the shared folder, deleted when the driver ends."""
    fs, p = _located(spark, path)
    out = fs.create(p, True)
    try:
        for at in range(0, len(data), part):
            out.write(bytearray(data[at : at + part]))
    finally:
        out.close()
    fs.deleteOnExit(p)


def ship_package(spark: SparkSession) -> None:
    """Let executors import this package, whatever their working folder or PYTHONPATH."""
    sc = spark.sparkContext
    with _lock:
        if sc.applicationId in _shipped:
            return
        here = os.path.dirname(os.path.abspath(__file__))
        if not os.path.isdir(here):  # imported from an archive that was itself shipped
            return
        path = os.path.join(tempfile.mkdtemp(prefix="graphloom-code-"), "graphloom_code.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(here):
                for n in names:
                    if n.endswith((".py", ".txt")):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(here)))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
