"""python -m lodestone COMMAND: the engine on the command line."""

from __future__ import annotations

import argparse
import json

from lodestone.functions import text as X


def main(argv: list[str] | None = None, spark=None) -> int:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("--store", default=".lodestone/store")
    p.add_argument("--project")
    p.add_argument("--profile", default="code")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"reindex": ["root"], "search": ["query"], "assemble": ["query"], "classify": ["query"], "status": [], "clear": [], "versions": [], "restore": ["version"], "census": ["root"], "token-stats": ["log"], "metrics": ["log"],
        "init": ["root"], "config": ["root"], "doctor": ["root"], "dry-run": ["root"], "run": ["root"], "janitor": ["root", "since"], "memory": ["root", "log"], "dashboard": ["log"]}.items():
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        if name == "search":
            s.add_argument("--top-k", type=int, default=5)
    a = p.parse_args(argv)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from lodestone.operators import metrics
    from lodestone.plans import setup
    from lodestone.plans.engine import Engine
    from lodestone.plans.profiles import Settings
    from lodestone.plans.service import Service
    from lodestone.sources import files, state
    from lodestone.sources.store import BlockStore

    spark = spark or SparkSession.builder.appName("lodestone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "init":
        print(setup.init(a.root, a.profile))
        return 0
    settings = setup.settings(a.root, a.profile) if a.command in ("config", "doctor", "dry-run", "run", "janitor") else Settings(profile=a.profile)
    service = Service(Engine(spark, BlockStore(spark, a.store), settings), a.project)
    store = service.engine.store
    if a.command == "reindex":
        project = a.project or spark.createDataFrame([(a.root,)], "p string").select(X.project_id(F.col("p"))).first()[0]
        print(service.engine.index_tree(a.root, project), store.count(project))
    elif a.command == "search":
        print(service.search_code(a.query, a.top_k))
    elif a.command == "assemble":
        print(service.assemble_context(a.query))
    elif a.command == "classify":
        print(service.classify(a.query))
    elif a.command == "status":
        print(json.dumps(service.status(), indent=2))
    elif a.command == "clear":
        print(store.clear(a.project))
    elif a.command == "versions":
        print("\n".join(store.versions()))
    elif a.command == "restore":
        store.restore(a.version)
    elif a.command == "census":
        found = files.read_files(spark, a.root, ["*"], service.engine.settings.exclude)
        for r in files.census(found).orderBy(F.desc("files"), "ext").collect():  # a row for each ending
            print(r.ext, r.files)
    elif a.command == "token-stats":
        print(json.dumps(metrics.token_stats(state.EventLog(spark, a.log, state.USAGE).read(), F.localtimestamp()).first().asDict()))
    elif a.command == "metrics":
        for r in metrics.summary(state.EventLog(spark, a.log).read()).orderBy("category").collect():  # a row for each category
            print(json.dumps(r.asDict(), default=str))
    elif a.command == "config":
        print(state.dump_settings(settings))
    elif a.command == "doctor":
        found = setup.doctor(spark, a.root, store)
        print("\n".join(f"{'ok' if ok else 'FAIL'}  {what}" for what, ok in found))
        return 0 if all(ok for _, ok in found) else 1
    elif a.command == "dry-run":
        for r in setup.dry_run(spark, a.root, settings).collect():  # a row for each language
            print(r.language, r.files, r.bytes)
    elif a.command == "run":
        project = a.project or spark.createDataFrame([(a.root,)], "p string").select(X.project_id(F.col("p"))).first()[0]
        setup.follow(service.engine, a.root, project).awaitTermination()
        print(store.count(project))
    elif a.command == "janitor":
        project = a.project or spark.createDataFrame([(a.root,)], "p string").select(X.project_id(F.col("p"))).first()[0]
        print(setup.janitor(service.engine, a.root, project, a.since), store.count(project))
    elif a.command == "memory":
        from lodestone.plans.jobs import record_changes
        from lodestone.sources.vcs import Repository

        print(record_changes(spark, Repository(a.root), state.EventLog(spark, a.log)))
    elif a.command == "dashboard":
        log = state.EventLog(spark, a.log).read()
        for r in metrics.summary(log).join(metrics.index_latency(log, "category"), "category", "left").orderBy("category").collect():  # a row for each category
            print(json.dumps(r.asDict(), default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
