"""What a git repository tells the driver: commits, changes, diffs."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

from .files import parse_status


class Repository:
    """Answers are empty, never errors, where git has none."""

    def __init__(self, path: str, timeout: float = 30):
        self.path, self.timeout = path, timeout

    def _git(self, *args: str) -> str | None:
        try:
            out = subprocess.run(["git", *args], cwd=self.path, capture_output=True, text=True, timeout=self.timeout)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return out.stdout.rstrip("\n") if out.returncode == 0 else None

    def commit(self) -> str:
        return self._git("rev-parse", "HEAD") or ""

    def behind(self, since: str) -> int:
        """Commits after ``since``; -1 if it is not known."""
        out = self._git("rev-list", "--count", f"{since}..HEAD")
        return int(out) if out and out.isdigit() else -1

    def changed(self, spark: SparkSession, since: str) -> DataFrame:
        """filepath and change since a commit; a rename deletes and adds."""
        lines = (self._git("diff", "--name-status", f"{since}..HEAD") or "").split("\n")
        return parse_status(spark.createDataFrame([(x,) for x in lines], "line string"))

    def diff(self, spark: SparkSession, uncommitted: bool = False) -> DataFrame:
        """One row: the last commit's diff, or the staged and unstaged ones."""
        parts = [self._git("diff", "--cached"), self._git("diff")] if uncommitted else [self._git("diff", "HEAD~1", "HEAD")]
        return spark.createDataFrame([("\n".join(p for p in parts if p),)], "diff string")

    def freshness(self, last: str | None, quick: int = 1000, full: int = 10_000) -> dict:
        behind = self.behind(last) if last else 0
        return {"current": self.commit(), "last": last, "behind": behind, "reindex": "full" if behind >= full else "quick" if behind >= quick else None}
