"""A streaming source of a tree's changes: files added, modified and deleted.

An offset is the number of a listing (path, size, time of each file), which is
kept as a table beside the stream's checkpoint; a batch is what two listings
differ in. So a stream that was stopped goes on from the listing that it last
took, and sees what was deleted meanwhile. Listings that are behind are dropped.
The driver holds two listings, tasks read the texts.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .files import glob_regex
from .scratch import ship

SCHEMA = "filepath string, text string, change string, ts timestamp"
#: Files that one task reads, and bytes.
PART_FILES, PART_BYTES = 500, 64 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path.rstrip("/")
    fs, at = pafs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://") else "file://" + path[5:])
    return fs, at.rstrip("/")


class _Part(InputPartition):
    def __init__(self, rows: list[tuple[str, str, int]]):
        self.rows = rows


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.state = options["path"], options["state"]
        self.patterns = json.loads(options.get("patterns", '["*"]'))
        self.exclude = re.compile(options["exclude"]) if options.get("exclude") else None

    # listings

    def _at(self, n: int) -> str:
        return f"{_open(self.state)[1]}/{n:012d}.parquet"

    def _numbers(self) -> list[int]:
        fs, at = _open(self.state)
        found = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
        return sorted(int(f.base_name[:-8]) for f in found if f.base_name.endswith(".parquet"))

    def _load(self, n: int) -> dict[str, tuple[int, int]]:
        if n == 0:
            return {}
        t = pq.read_table(self._at(n), filesystem=_open(self.state)[0])
        return {p: (s, m) for p, s, m in zip(*(t.column(c).to_pylist() for c in ("path", "size", "modified")), strict=True)}

    def _list(self) -> dict[str, tuple[int, int]]:
        fs, root = _open(self.root)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        own = {f.path[len(root) + 1 :]: f for f in found if f.type == pafs.FileType.File and any(fnmatch.fnmatch(f.base_name, p) for p in self.patterns)}
        return {p: (f.size, f.mtime_ns or 0) for p, f in own.items() if self.exclude is None or not self.exclude.search(p)}

    # the stream

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        known, now = self._numbers(), self._list()
        last = known[-1] if known else 0
        if now == self._load(last):
            return {"listing": last}
        fs, at = _open(self.state)
        fs.create_dir(at, recursive=True)
        rows = sorted(now.items())
        t = pa.table({"path": pa.array([p for p, _ in rows], pa.string()), "size": pa.array([v[0] for _, v in rows], pa.int64()), "modified": pa.array([v[1] for _, v in rows], pa.int64())})
        tmp = f"{at}/{last + 1:012d}.tmp"  # there whole or not at all
        pq.write_table(t, tmp, filesystem=fs)
        fs.move(tmp, self._at(last + 1))
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        old, new = self._load(start["listing"]), self._load(end["listing"])
        rows, out, size = [], [], 0
        for path in sorted(old.keys() | new.keys()):
            if old.get(path) == new.get(path):
                continue
            if len(rows) >= PART_FILES or size >= PART_BYTES:
                out.append(_Part(rows))
                rows, size = [], 0
            rows.append((path, "deleted" if path not in new else "added" if path not in old else "modified", new.get(path, (0, 0))[1]))
            size += new.get(path, (0, 0))[0]
        return [*out, _Part(rows)] if rows else out or [_Part([])]

    def read(self, part: _Part) -> Iterator[tuple]:
        fs, root = _open(self.root)
        for path, change, modified in part.rows:
            text = None
            if change != "deleted":
                try:
                    with fs.open_input_stream(f"{root}/{path}") as f:
                        text = f.read().decode("utf-8", "replace")
                except FileNotFoundError:  # it went since it was listed
                    change = "deleted"
            yield path, text, change, dt.datetime.fromtimestamp(modified / 1e9, dt.timezone.utc)

    def commit(self, end: dict) -> None:
        fs, _ = _open(self.state)
        for n in self._numbers():
            if n < end["listing"]:
                fs.delete_file(self._at(n))


class TreeChanges(DataSource):
    """``spark.readStream.format("treechanges").option("state", folder).load(root)``"""

    @classmethod
    def name(cls) -> str:
        return "treechanges"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def tree_changes(spark: SparkSession, root: str, state: str, patterns: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """filepath, text, change and ts of a tree's files, as a stream; names match
    any of ``patterns``, paths none of ``exclude``; ``state`` is a folder that
    belongs to this stream."""
    ship(spark)
    spark.dataSource.register(TreeChanges)
    return spark.readStream.format("treechanges").option("state", state).option("patterns", json.dumps(patterns or ["*"])).option("exclude", "|".join(f"(?:{glob_regex(p)})" for p in exclude or [])).load(root)
