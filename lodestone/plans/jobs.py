"""Background work beside searches: lanes of priority, and work on a clock."""

from __future__ import annotations

import itertools
import queue
import stat
import threading
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from lodestone.functions import text as X
from lodestone.sources.state import EventLog
from lodestone.sources.vcs import Repository

LANES = ("gateway", "normal", "background")


class Jobs:
    """Runs functions in order of priority (0 first), one thread to a job.

    A job runs in its lane's scheduler pool, so with the FAIR scheduler a
    search's tasks go before background ones. While the cluster is busier than
    ``most_busy`` (running tasks by cores), all but priority 0 wait, and fall
    behind by one each time. Errors are kept, and end no other job.
    """

    def __init__(self, spark: SparkSession, most_busy: float = 0.5, wait: float = 0.5, workers: int = 2):
        self.spark, self.most_busy, self.wait = spark, most_busy, wait
        self.errors: list[BaseException] = []
        self._waiting: queue.PriorityQueue = queue.PriorityQueue()
        self._order, self._stop = itertools.count(), threading.Event()
        self._threads = [threading.Thread(target=self._work, daemon=True) for _ in range(workers)]
        for t in self._threads:
            t.start()

    def busy(self) -> float:
        tracker, sc = self.spark.sparkContext.statusTracker(), self.spark.sparkContext
        infos = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
        return sum(i.numActiveTasks for i in infos if i is not None) / max(sc.defaultParallelism, 1)

    def submit(self, job: Callable[[], object], priority: int = 2) -> None:
        self._waiting.put((priority, next(self._order), job))

    def _work(self) -> None:
        while not self._stop.is_set():
            try:
                priority, _, job = self._waiting.get(timeout=0.1)
            except queue.Empty:
                continue
            try:
                if priority > 0 and self.busy() > self.most_busy:
                    time.sleep(self.wait)
                    self._waiting.put((priority + 1, next(self._order), job))
                    continue
                self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", LANES[min(priority, 2)])
                job()
            except Exception as e:
                self.errors.append(e)
            finally:
                self._waiting.task_done()

    def drain(self) -> None:
        """Waits for all that was submitted."""
        self._waiting.join()

    def close(self) -> None:
        self._stop.set()
        for t in self._threads:
            t.join()


def record_changes(spark: SparkSession, repo: Repository, log: EventLog, uncommitted: bool = False) -> str:
    """Appends one line on the last commit's changes to the memory log, and returns it."""
    from pyspark.sql import functions as F

    row = repo.diff(spark, uncommitted).select(X.diff_summary(F.col("diff")).alias("detail")).first()
    entry = spark.createDataFrame([(row.detail,)], "detail string").select(F.lit("memory").alias("category"), F.localtimestamp().alias("ts"), "detail")
    log.append(entry)
    return row.detail


class Clock:
    """Calls a function every so many seconds until it is stopped; a call that
    fails is told to ``failed`` and the next one comes all the same."""

    def __init__(self, seconds: float, job: Callable[[], object], failed: Callable[[Exception], None] | None = None):
        self._stop = threading.Event()

        def run():
            while not self._stop.wait(seconds):
                try:
                    job()
                except Exception as e:
                    if failed is not None:
                        failed(e)

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()

    def stop(self) -> None:
        self._stop.set()
        self._thread.join()


def install_hook(repo: str, command: str) -> bool:
    """A post-commit hook that runs a command; an existing hook stays as it is."""
    at = Path(repo, ".git", "hooks", "post-commit")
    if at.exists():
        return False
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(f"#!/bin/sh\n{command} 2>/dev/null\n")
    at.chmod(at.stat().st_mode | stat.S_IXUSR | stat.S_IXGRP | stat.S_IXOTH)
    return True
