"""What the command line does around an engine: settings, checks and upkeep."""

from __future__ import annotations

import os
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.sources import files, listing, parsing, state
from lodestone.sources.scratch import shared_dir
from lodestone.sources.store import BlockStore
from lodestone.sources.vcs import Repository
from lodestone.streaming import watch

from .engine import Engine
from .profiles import Settings

FILE = "settings.json"


def init(root: str, profile: str = "code") -> str:
    """Writes default settings into the tree's index folder; kept if there are any."""
    at = os.path.join(state.index_location(root), FILE)
    if not os.path.exists(at):
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "w") as f:
            f.write(state.dump_settings(Settings(profile=profile)))
    return at


def settings(root: str, profile: str = "code") -> Settings:
    """The tree's own settings, or defaults of a profile."""
    at = os.path.join(state.index_location(root), FILE)
    if not os.path.exists(at):
        return Settings(profile=profile)
    with open(at) as f:
        return state.load_settings(f.read())


def doctor(spark: SparkSession, root: str, store: BlockStore) -> list[tuple[str, bool]]:
    """What an engine needs, and whether it is there."""

    def works(f) -> bool:
        try:
            f()
            return True
        except Exception:  # whatever it is, it does not work
            return False

    return [
        ("the tree is a folder", os.path.isdir(root)), ("its settings can be read", works(lambda: settings(root))),
        ("git answers for it", bool(Repository(root).commit())), ("executors share a folder", works(lambda: shared_dir(spark))),
        ("Spark runs tasks", works(lambda: spark.range(8).selectExpr("sum(id)").collect())), ("the store can be read", works(store.count)),
        ("the store has this version's schema", not store.is_stale()),
    ]


def dry_run(spark: SparkSession, root: str, s: Settings) -> DataFrame:
    """language, files and bytes that indexing would read."""
    found = files.read_files(spark, root, list(s.spec.patterns), s.exclude, s.max_file_kb, s.source_roots)
    return found.groupBy(files.language(F.col("filepath")).alias("language")).agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes")).orderBy("language")


def follow(engine: Engine, root: str, project: str, every: str | None = None) -> StreamingQuery:
    """Keeps a project's blocks up to date with its tree, deletions included; once,
    or every so often."""
    s, own = engine.settings, os.path.join(state.index_location(root), "stream")
    stream = listing.tree_changes(engine.spark, root, f"{own}/listings", list(s.spec.patterns), s.exclude)
    if s.source_roots:
        stream = stream.where(reduce(or_, [F.col("filepath").startswith(r.strip("/") + "/") for r in s.source_roots if r != "."] or [F.lit(True)]))
    parse = lambda d: parsing.blocks(parsing.parse_files(d, s.max_file_kb)).drop("method").withColumn("project_id", F.lit(project))
    return watch.maintain(stream, engine.store, parse, f"{own}/checkpoint", every, project)


def janitor(engine: Engine, root: str, project: str, since: str) -> str:
    """Brings a project up to date with the commits after ``since``: files that
    went go, files that changed are parsed again. Returns the current commit."""
    s, repo = engine.settings, Repository(root)
    feed = repo.changed(engine.spark, since)
    found = files.read_files(engine.spark, root, list(s.spec.patterns), s.exclude, s.max_file_kb, s.source_roots)
    named = found.join(feed.where("change <> 'deleted'").select("filepath"), "filepath", "left_semi")
    blocks = parsing.blocks(parsing.parse_files(named, s.max_file_kb)).drop("method").withColumn("project_id", F.lit(project))
    engine.store.apply_changes(blocks, feed, project)
    return repo.commit()
