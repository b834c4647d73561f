"""Tables that cut an iteration's lineage, in the folder executors share."""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset and all runs on
    one machine, a folder of our own. On a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own or not os.path.isdir(_own[0]):
        _own[:] = [tempfile.mkdtemp(prefix="lodestone-")]
    return _own[0]


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
    at = tempfile.mkdtemp(prefix="lodestone-ship-")  # executors fetch it from the driver
    sc.addPyFile(shutil.make_archive(os.path.join(at, "lodestone_package"), "zip", root, "lodestone"))
    sc._lodestone_shipped = True


def discard(spark: SparkSession, at: str) -> None:
    """Delete a folder that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Tables:
    """Tables of one run, each written once and read by its later steps."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.steps = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", []
        self.schemas = {}

    def keep(self, frame: DataFrame, step: str, session: SparkSession | None = None) -> DataFrame:
        frame.write.parquet(f"{self.at}/{step}")
        self.steps.append(step)
        self.schemas[step] = frame.schema
        return self.read(step, session)

    def read(self, step: str, session: SparkSession | None = None) -> DataFrame:
        """A table again, by another session if one is given."""
        return (session or self.spark).read.schema(self.schemas[step]).parquet(f"{self.at}/{step}")

    def only(self, *steps: str) -> None:
        """Delete all tables but these."""
        for step in [s for s in self.steps if s not in steps]:
            discard(self.spark, f"{self.at}/{step}")
            self.steps.remove(step)


def signature(spark: SparkSession, path: str) -> str:
    """Tells one state of a table's files from another: names, sizes and times."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, todo = [], [at]
    while todo:
        for f in fs.listStatus(todo.pop()):
            if f.isDirectory():
                todo.append(f.getPath())
            else:
                found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:32]


def built(spark: SparkSession, at: str, build: Callable[[str], object]) -> str:
    """The folder ``at``, which ``build`` fills if it does not exist. It is filled
    under another name and renamed, so it is there whole or not at all."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path(at)):
        tmp = f"{at}-{uuid.uuid4().hex}"
        build(tmp)
        fs.mkdirs(path(at).getParent())
        # of two that build at once, the one that comes second finds the folder taken, or comes to lie inside it
        if not fs.exists(path(at)):
            fs.rename(path(tmp), path(at))
        else:
            fs.delete(path(tmp), True)
    return at
