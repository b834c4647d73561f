"""The tools of the engine as text in, text out: what a server or the command
line calls. Each answer is capped, and charged to the session's budget."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import budget, caches

from .engine import Engine

NOTHING, MISS = "No confident matches found for this query.", "CACHE_MISS"
CACHE = "query string, vector array<float>, value string, expires_at timestamp"


class Service:
    def __init__(self, engine: Engine, project: str | None = None, cache_path: str | None = None, ttl: int = 1800, cache_entries: int = 200):
        self.engine, self.project, self.cache_path, self.ttl, self.cache_entries = engine, project, cache_path, ttl, cache_entries
        self.remaining = engine.settings.session_cap

    @property
    def spark(self) -> SparkSession:
        return self.engine.spark

    def binding(self) -> str:
        """single, workspace or unbound."""
        if self.project is not None:
            return "single"
        return "workspace" if self.engine.store.read().select("project_id").distinct().limit(1).count() else "unbound"

    def _ask(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([(0, query)], "query_id long, query string")

    def emit(self, text: str) -> str:
        """The text within the tool's cap and what the session has left."""
        text = text[: 4 * self.engine.settings.tool_tokens]
        tokens = max(1, len(text) // 4)
        if tokens > self.remaining:
            text, self.remaining = text[: 4 * self.remaining], 0
        else:
            self.remaining -= tokens
        return text

    def reset_session(self) -> None:
        self.remaining = self.engine.settings.session_cap

    def search_code(self, query: str, top_k: int = 5) -> str:
        if self.binding() == "unbound":
            return "No project is indexed."
        q = self._ask(query)
        hits = self.engine.search(q, self.project, top_k) if self.project is not None else self.engine.route(q, top_k)
        rows = hits.orderBy("rank").limit(top_k).collect()  # top_k rows
        if not rows:
            return self.emit(NOTHING)
        out = []
        for r in rows:
            name = r.function if "function" in r else r.id
            out += [f"{r['rank']}. {r.filepath}:{name}", f"   relevance: {r.rerank_score:.3f}"] + ([f"   Code: {r.code[:200]}"] if r.code else []) + [""]
        return self.emit("\n".join(out))

    def assemble_context(self, query: str) -> str:
        rows = self.engine.assemble(self._ask(query), self.project).limit(1).collect()
        return self.emit(rows[0].context if rows else NOTHING)

    def set_profile(self, name: str) -> str:
        try:
            self.engine.set_profile(name)
        except KeyError:
            return f"Unknown profile: {name}"
        s = self.engine.settings.spec
        return f"Profile {s.name}: legs {', '.join(s.legs)}, patterns {' '.join(s.patterns)}"

    def orchestrate(self, query: str, instruction: str = "", generate=None) -> str:
        context = self.engine.assemble(self._ask(query), self.project).limit(1).collect()
        work = self.spark.createDataFrame([(0, context[0].context if context else "", bool(instruction))], "key long, text string, has_instruction boolean")
        plan = self.engine.orchestrate(work, generate).first()
        if plan.work_class == "context_only" or generate is None:
            return self.emit(context[0].context if context else NOTHING)
        if plan.work_class == "defer_to_cloud":
            return self.emit(f"Too large for local work: {plan.tokens} tokens.")
        if plan.work_class == "local_map_reduce":
            return self.emit(self._map_reduce(work, instruction, generate))
        prompt = work.withColumn("prompt", F.concat(F.lit(instruction + "\n\n"), "text"))
        return self.emit(generate(prompt).select("answer").first()[0])

    def _map_reduce(self, work: DataFrame, instruction: str, generate) -> str:
        """Each chunk is asked on its own, then the answers are reduced together."""
        sized = work.withColumn("tokens", X.approx_tokens(F.col("text")))
        chunks = budget.chunk_bounds(sized.select("key", "tokens", "text"))
        part = F.substr("text", (F.col("start") * 4 + 1).cast("int"), ((F.col("end") - F.col("start")) * 4).cast("int"))

        def answered(d: DataFrame, seq: str) -> DataFrame:
            out = generate(d.withColumn("prompt", F.concat(F.lit(instruction + "\n\n"), "text")))
            return out.select("key", F.col(seq).cast("long").alias("seq"), X.approx_tokens(F.col("answer")).alias("tokens"), F.col("answer").alias("text"))

        parts = answered(chunks.select("key", "chunk", part.alias("text")), "chunk")
        done = budget.tree_reduce(parts, lambda d: answered(d, "batch"))
        return done.orderBy("seq").first().text

    def _generations(self) -> list[int]:
        """Numbered folders of the cache, the newest last; only whole ones."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(self.cache_path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path(self.cache_path)):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path(self.cache_path))]
        return sorted(int(n[2:]) for n in names if n.startswith("g=") and fs.exists(path(f"{self.cache_path}/{n}/_SUCCESS")))

    def _entries(self) -> DataFrame | None:
        """The newest entries, as many as the cache may hold; None without a cache."""
        held = self._generations()
        if not held:
            return None
        rows = self.spark.read.schema(CACHE).parquet(f"{self.cache_path}/g={held[-1]}")
        return rows.orderBy(F.desc("expires_at"), "query").limit(self.cache_entries)

    def _compact(self, generation: int) -> None:
        """Writes the entries that stay to a new folder and drops the old one."""
        live = self._entries().where(F.col("expires_at") > F.lit(dt.datetime.now(dt.timezone.utc)))
        live.coalesce(1).write.parquet(f"{self.cache_path}/g={generation + 1}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.cache_path}/g={generation}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _vector(self, q: DataFrame) -> DataFrame:
        return self.engine.embed(q) if self.engine.embed else q.withColumn("vector", F.array().cast("array<float>"))

    def cache_set(self, query: str, value: str, ttl_seconds: int = 0) -> str:
        until = dt.datetime.now(dt.timezone.utc) + dt.timedelta(seconds=ttl_seconds or self.ttl)
        row = self._vector(self._ask(query)).select("query", "vector", F.lit(value).alias("value"), F.lit(until).alias("expires_at"))
        generation = max(self._generations(), default=0)
        row.write.mode("append").parquet(f"{self.cache_path}/g={generation}")
        if self.spark.read.schema(CACHE).parquet(f"{self.cache_path}/g={generation}").count() > 2 * self.cache_entries:
            self._compact(generation)
        return "cached"

    def cache_get(self, query: str) -> str:
        entries = self._entries()
        if entries is None:
            return MISS
        probe = self._vector(self._ask(query)).withColumnRenamed("query_id", "probe_id")
        hit = caches.semantic_lookup(probe, entries, F.lit(dt.datetime.now(dt.timezone.utc))).first()
        return MISS if hit is None or hit.value is None else self.emit(hit.value)

    def classify(self, query: str) -> str:
        return "SIMPLE" if self._ask(query).select(X.simple_query(F.col("query"))).first()[0] else "COMPLEX"

    def status(self) -> dict:
        rows = self.engine.store.read().groupBy("project_id").agg(F.count("*").alias("blocks"), F.countDistinct("filepath").alias("files"), F.max("indexed_at").alias("at")).orderBy("project_id").collect()  # a row for each project
        return {r.project_id: {"blocks": r.blocks, "files": r.files, "indexed_at": str(r["at"])} for r in rows}
