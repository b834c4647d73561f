"""A versioned block store on Parquet.

Each project's blocks lie in a folder of their own. A version maps projects to
folders; a write makes new folders for the projects that it touches and a new
version that points to them, and to the old folders of all others. Versions are
numbered files that are created once and never changed, so readers never see
half a write, a lost job leaves no trace, and of two writers that start from one
version the second fails.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.schemas import STORED

SCHEMA_VERSION = 3


class ConcurrentWrite(RuntimeError):
    """Another writer holds, or has written, the next version."""


def latest(rows: DataFrame, keys: list[str], order: str = "indexed_at") -> DataFrame:
    """The last row of each key."""
    w = W.partitionBy(*keys).orderBy(F.desc_nulls_last(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new rows in place of those with equal keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def applied(old: DataFrame, new: DataFrame, feed: DataFrame, keys: tuple[str, ...] = ("filepath",)) -> DataFrame:
    """old after a change feed (keys, change): blocks of every named file go,
    those of files that still exist come from new. Files of several projects
    need project_id among the keys."""
    keys = list(keys)
    gone = old.join(feed.select(*keys).distinct(), keys, "left_anti")
    return gone.unionByName(new.join(feed.where("change <> 'deleted'").select(*keys).distinct(), keys, "left_semi"), allowMissingColumns=True)


class BlockStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _manifests(self) -> dict[int, str]:
        """Number -> file name. A version's is ``n.json``, that of a return to version v ``n-v.json``."""
        return {int(n[:9]): n for n in self._names("manifests") if n.endswith(".json")}

    def _number(self) -> int:
        return max(self._manifests(), default=0)

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/manifests/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def manifest(self) -> dict:
        """The newest manifest: the current version and its folders, no others'."""
        held = self._manifests()
        if not held:
            return {"current": None, "folders": {}, "schema": SCHEMA_VERSION, "meta": {}}
        return self._load(held[max(held)])

    def _publish(self, base: int, value: dict, back_to: int | None = None) -> None:
        """Writes manifest base + 1; whoever creates its lock may."""
        n = base + 1
        name = f"{n:09d}.json" if back_to is None else f"{n:09d}-{back_to:09d}.json"
        lock = self._path(f"{self.path}/locks/{n:09d}")
        try:
            self._fs.create(lock, False).close()
        except Exception as e:
            raise ConcurrentWrite(f"version {n} is taken; if its writer died, delete {lock}") from e
        tmp = self._path(f"{self.path}/locks/{n:09d}.json")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        self._fs.mkdirs(self._path(f"{self.path}/manifests"))
        if not self._fs.rename(tmp, self._path(f"{self.path}/manifests/{name}")):
            raise ConcurrentWrite(f"version {n} could not be published")

    def is_stale(self) -> bool:
        return self.manifest().get("schema") != SCHEMA_VERSION

    def _folders(self) -> dict[str, str]:
        return self.manifest()["folders"]

    def read(self, project: str | Iterable[str] | None = None) -> DataFrame:
        """The blocks of a project, of some, or of all; only their folders are read."""
        folders = self._folders()
        if project is not None:
            named = [project] if isinstance(project, str) else list(project)
            folders = {p: folders[p] for p in named if p in folders}
        if not folders:
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).parquet(*[f"{self.path}/{at}" for _, at in sorted(folders.items())])

    def projects(self) -> list[str]:
        return sorted(self._folders())

    def meta(self) -> dict:
        return self.manifest().get("meta", {})

    def _commit(self, rows: DataFrame, touched: Iterable[str], base: int | None = None, meta: dict | None = None) -> str:
        """A version in which the touched projects hold ``rows``, the others what they held."""
        base = self._number() if base is None else base
        m = self.manifest()
        folders = {p: at for p, at in m["folders"].items() if p not in set(touched)}
        at = f"data/{uuid.uuid4().hex}"
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in STORED.fields])
        # the folder's name holds the project's; the rows keep it as well
        rows.withColumn("p", F.concat(F.lit("_"), "project_id")).write.partitionBy("p").parquet(f"{self.path}/{at}")
        for name in self._names(at):
            if name.startswith("p="):
                folders[unquote(name[2:])[1:]] = f"{at}/{name}"
        v = f"v={base + 1}"
        self._publish(base, {"current": v, "folders": folders, "schema": SCHEMA_VERSION, "meta": m.get("meta", {}) | (meta or {})})
        return v

    def _own(self, rows: DataFrame) -> set[str]:
        """The projects of rows: names only, one each."""
        return {r[0] for r in rows.select("project_id").distinct().collect()}

    def upsert(self, blocks: DataFrame, meta: dict | None = None) -> str:
        """Insert or replace by project and id; of equal keys the last indexed wins."""
        base = self._number()
        new = latest(self._stored(blocks), ["project_id", "id"])
        touched = self._own(new)
        return self._commit(merged(self.read(touched), new, ["project_id", "id"]), touched, base, meta)

    def _stored(self, blocks: DataFrame, project: str = "") -> DataFrame:
        for f in STORED.fields:
            if f.name not in blocks.columns:
                blocks = blocks.withColumn(f.name, F.current_timestamp() if f.name == "indexed_at" else F.lit(None).cast(f.dataType))
        return blocks.select(*STORED.fieldNames()).withColumn("project_id", F.coalesce("project_id", F.lit(project)))

    def delete_files(self, filepaths: DataFrame, project: str | None = None) -> str:
        base, gone = self._number(), filepaths.select("filepath").distinct()
        rows = self.read(project)
        touched = self._own(rows.join(gone, "filepath", "left_semi"))
        return self._commit(self.read(touched).join(gone, "filepath", "left_anti"), touched, base)

    def apply_changes(self, blocks: DataFrame, feed: DataFrame, project: str | None = None) -> str:
        """Blocks of every file that the feed (filepath, change[, project_id])
        names go; those of files that still exist come from ``blocks``. Files of
        other projects stay. Rows without a project are of ``project``, or of
        the one project that the blocks and the store know; if they know more,
        that is an error."""
        base = self._number()
        feed, project = self._named(blocks, feed, project)
        touched = self._own(feed)
        return self._commit(applied(self.read(touched), self._stored(blocks, project), feed, ("project_id", "filepath")), touched, base)

    def _named(self, blocks: DataFrame, feed: DataFrame, project: str | None) -> tuple[DataFrame, str]:
        """The feed with a project in each row, and the project of rows without one."""
        if project is None and "project_id" not in feed.columns:
            known = {p for p in self._own(blocks) if p is not None} | set(self.projects()) if "project_id" in blocks.columns else set(self.projects())
            if len(known) > 1:
                raise ValueError("the feed names no project and the store holds several")
            project = next(iter(known), "")
        project = project or ""
        return feed.withColumn("project_id", F.coalesce("project_id", F.lit(project)) if "project_id" in feed.columns else F.lit(project)), project

    def count(self, project: str | None = None) -> int:
        return self.read(project).count()

    def clear(self, project: str | None = None) -> str:
        return self._commit(self.read(()), self.projects() if project is None else [project])

    def versions(self) -> list[str]:
        """Those that can be read, in order; told by file names."""
        return [f"v={n}" for n, name in sorted(self._manifests().items()) if "-" not in name]

    def snapshot(self) -> str | None:
        held = self._manifests()
        if not held:
            return None
        n = max(held)
        return f"v={int(held[n][10:19])}" if "-" in held[n] else f"v={n}"

    def restore(self, version: str) -> None:
        held = self._manifests()
        base = max(held, default=0)
        n = int(version[2:]) if version[:2] == "v=" and version[2:].isdigit() else 0
        if "-" in held.get(n, "-"):
            raise ValueError(f"no version {version}")
        self._publish(base, self._load(held[n]), n)

    def retain(self, last: int, grace: int = 3600) -> list[str]:
        """Drops all versions but the ``last`` ones and the current, and the folders
        that no kept version names. Folders younger than ``grace`` seconds stay: a
        writer may be about to publish them. Returns the versions that went."""
        held = self._manifests()
        if not held:
            return []
        named = self.versions()
        kept = set(named[-last:] if last > 0 else []) | {self.snapshot()}
        gone = [v for v in named if v not in kept]
        newest = max(held)  # the newest manifest stays: it says what is current, and numbers go on from it
        used = {newest} | {int(v[2:]) for v in kept if int(v[2:]) in held}
        folders = {at.split("/")[1] for n in used for at in self._load(held[n])["folders"].values()}
        for n in sorted(held):
            if n not in used:
                self._fs.delete(self._path(f"{self.path}/manifests/{held[n]}"), False)
                self._fs.delete(self._path(f"{self.path}/locks/{n:09d}"), False)
        at = self._path(f"{self.path}/data")
        before = (time.time() - grace) * 1000
        for f in self._fs.listStatus(at) if self._fs.exists(at) else []:
            if f.getPath().getName() not in folders and f.getModificationTime() < before:
                self._fs.delete(f.getPath(), True)
        return gone


class MemoryStore:
    """The same blocks as a cached frame, for tests and small collections: no
    versions, nothing is written."""

    def __init__(self, spark: SparkSession, path: str = ""):
        self.spark, self._rows, self._n, self._meta = spark, spark.createDataFrame([], STORED), 0, {}

    _stored, _named, _own = BlockStore._stored, BlockStore._named, BlockStore._own

    def _set(self, rows: DataFrame) -> str:
        old, self._n = self._rows, self._n + 1
        self._rows = rows.select(*STORED.fieldNames()).persist()
        self._rows.count()  # before what it was made of goes
        old.unpersist()
        return self.snapshot()

    def snapshot(self) -> str | None:
        return f"v={self._n}" if self._n else None

    def projects(self) -> list[str]:
        return sorted(r[0] for r in self._rows.select("project_id").distinct().collect())

    def read(self, project: str | Iterable[str] | None = None) -> DataFrame:
        named = [project] if isinstance(project, str) else project
        return self._rows if named is None else self._rows.where(F.col("project_id").isin(list(named)))

    def meta(self) -> dict:
        return self._meta

    def upsert(self, blocks: DataFrame, meta: dict | None = None) -> str:
        self._meta |= meta or {}
        new = latest(self._stored(blocks), ["project_id", "id"])
        return self._set(merged(self._rows, new, ["project_id", "id"]))

    def delete_files(self, filepaths: DataFrame, project: str | None = None) -> str:
        gone = filepaths.select("filepath").distinct()
        hit = self._rows.join(gone, "filepath", "left_anti")
        return self._set(hit if project is None else hit.unionByName(self._rows.where(F.col("project_id") != project).join(gone, "filepath", "left_semi")))

    def apply_changes(self, blocks: DataFrame, feed: DataFrame, project: str | None = None) -> str:
        feed, project = self._named(blocks, feed, project)
        return self._set(applied(self._rows, self._stored(blocks, project), feed, ("project_id", "filepath")))

    def count(self, project: str | None = None) -> int:
        return self.read(project).count()

    def clear(self, project: str | None = None) -> str:
        return self._set(self._rows.limit(0) if project is None else self._rows.where(F.col("project_id") != project))


STORES = {"parquet": BlockStore, "memory": MemoryStore}


def open_store(spark: SparkSession, path: str, kind: str = "parquet") -> BlockStore | MemoryStore:
    """The store of a kind that settings name."""
    if kind not in STORES:
        raise ValueError(f"unknown store: {kind}")
    return STORES[kind](spark, path)
