"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
import uuid

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes in an Arrow batch; with the longest texts a batch stays within memory.
ARROW_ROWS = 1000
ARROW_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset and all runs on
    one machine, as in tests, a folder of our own; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = getattr(shared_dir, "own", None)
        if at is None or not os.path.isdir(at):
            at = shared_dir.own = tempfile.mkdtemp(prefix="lodestone-")
    return at


def sound(spark: SparkSession) -> None:
    """A union of frames that were dealt by one key does not count as dealt by it:
    adaptive execution may have put the parts of each together in its own way, and
    groups over the union would then fall apart."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def ship(spark: SparkSession) -> None:
    """Send the package to workers that would not find it by their path."""
    sound(spark)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {os.getcwd()}
    sc = spark.sparkContext
    if root in known or getattr(sc, "_lodestone_shipped", False):
        return
    at = tempfile.mkdtemp(prefix="lodestone-ship-")  # executors fetch it from the driver at any time
    sc.addPyFile(shutil.make_archive(os.path.join(at, "lodestone_package"), "zip", root, "lodestone"))
    sc._lodestone_shipped = True


def bounded(spark: SparkSession) -> None:
    """Keep Arrow batches small, in rows and bytes: texts can be long.

    The session's settings stay lowered, since results are lazy."""
    ship(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= ARROW_ROWS:
        spark.conf.set(rows, str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def tidy(run):
    """A function over Arrow batches that returns its freed memory to the system
    when its task ends: workers live on, beside the next stages' tasks."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return tidied


class Scratch:
    """Tables of one run, each written once and read by its later steps.

    A written table cuts lineage: a lost executor costs the tasks that it ran,
    not the steps before.
    """

    #: Folders of this process, for clean().
    made: list[str] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.made.append(self.at)

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.at}/{name}"
        frame.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.at}/{name}")


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Delete the tables of all runs of this process. Results are lazy and read
    them, so write what is wanted first."""
    while Scratch.made:
        _delete(spark, Scratch.made.pop())
