"""The engine: index a tree, search it, assemble contexts, route between trees."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import budget, compress, fusion, graph, lexical, structural, vector, workspace
from lodestone.operators.cells import Cells
from lodestone.operators.postings import Postings
from lodestone.sources import files, parsing, scratch
from lodestone.sources.store import BlockStore

from .profiles import Settings

Embedder = Callable[[DataFrame], DataFrame]


class Engine:
    """Searches over one store. Queries come as a frame (query_id, query), so one
    plan answers many; hits are never collected. The blocks of a project stay in
    memory as long as the store's snapshot does."""

    def __init__(self, spark: SparkSession, store: BlockStore, settings: Settings | None = None, embed: Embedder | None = None, scorer: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.store, self.settings, self.embed, self.scorer = spark, store, settings or Settings(), embed, scorer
        self.parsed = self.searched = 0
        self._maps: dict[str, str] = {}
        scratch.sound(spark)
        self._own = f"engine-{uuid.uuid4().hex}"
        self._held: dict[str | None, tuple[str | None, DataFrame]] = {}

    def set_profile(self, name: str) -> None:
        self.settings.profile = name
        _ = self.settings.spec  # raises on an unknown name

    def index_tree(self, root: str, project: str) -> str:
        """Read, parse and store the files below root. Texts that were parsed before,
        for whatever version or project, are not parsed again; ``parsed`` says how
        many were."""
        s = self.settings
        found = files.read_files(self.spark, root, list(s.spec.patterns), s.exclude, s.max_file_kb, s.source_roots)
        done, self.parsed = parsing.parse_unseen(found, f"{self._root()}/parsed", s.max_file_kb)
        rows = parsing.blocks(done).withColumn("project_id", F.lit(project))
        if self.embed is not None and s.spec.embeddings:
            rows = self.embed(rows)  # adds vector
        at = f"{self._root()}/maps/{uuid.uuid4().hex}"
        parsing.repo_map(done).write.parquet(at)
        self._maps[project] = at
        return self.store.upsert(rows.drop("method"), meta={f"map/{project}": at})

    def repo_map(self, project: str) -> DataFrame | None:
        """filepath and names of the project's files, as they were last indexed."""
        at = self.store.meta().get(f"map/{project}", self._maps.get(project))
        return None if at is None else self.spark.read.parquet(at)

    def _blocks(self, project: str | None) -> DataFrame:
        """The blocks that a search of a project may see: its own, and those of
        none, which are stamped with it. Read again when the snapshot changes."""
        snapshot = self.store.snapshot()
        held = self._held.get(project)
        if held is None or held[0] != snapshot:
            if held is not None:
                held[1].unpersist()
            rows = self.store.read([project, ""] if project is not None else None)
            if project is not None:
                rows = workspace.drop_foreign(rows.withColumn("project_id", F.when(F.col("project_id") != "", F.col("project_id"))), project, self.settings.root)
            rows = rows.select("id", "project_id", "filepath", F.col("function").alias("name"), F.col("code").alias("text"), "vector").persist()
            self._held[project] = snapshot, rows
        return self._held[project][1]

    def _root(self) -> str:
        """Where what is derived from the blocks lies."""
        return getattr(self.store, "path", None) or f"{scratch.shared_dir(self.spark)}/{self._own}"

    def _index(self, kind: str, project: str | None, build: Callable[[str], object]) -> str:
        """The folder of an index of what ``_blocks`` gives, built once a snapshot and
        kept beside the store; those of a store in memory lie in the shared folder."""
        what = hashlib.sha256(repr((project, self.settings.root)).encode()).hexdigest()[:16]
        return scratch.built(self.spark, f"{self._root()}/{kind}/{self.store.snapshot()}/{what}", build)

    def _postings(self, project: str | None) -> Postings:
        return Postings(self.spark, self._index("postings2", project, lambda to: Postings.build(self._blocks(project), to, "project_id")))

    def _cells(self, project: str | None) -> Cells:
        return Cells(self.spark, self._index("cells3", project, lambda to: Cells.build(self._blocks(project), to)))

    def _lexical(self, blocks: DataFrame, queries: DataFrame, k: int, project: str | None) -> DataFrame:
        """Line search; BM25 where the settings say so."""
        if self.settings.lexical == "grep":
            return lexical.grep(blocks, queries, k)
        return lexical.bm25(blocks, queries, k, index=self._postings(project))

    def search(self, queries: DataFrame, project: str | None = None, k: int | None = None, mode: str | None = None, guard: bool = True) -> DataFrame:
        """query_id, rank, id, score, similarity, rerank_score, raw_cosine and the block.

        ``mode`` is hybrid, or one leg: bm25, ast or embeddings; without an
        embedder embeddings falls back to bm25.
        """
        s, b = self.settings, self._blocks(project)
        k, mode = k or s.top_k, mode or s.mode
        vectors = self.embed is not None and s.spec.embeddings
        leg = {"bm25": lambda n: lexical.bm25(b, queries, n, index=self._postings(project)), "ast": lambda n: graph.graph_rank(b, queries, n), "embeddings": lambda n: vector.nearest(b, self.embed(queries), n, index=self._cells(project))}
        if mode != "hybrid":
            hits = leg[mode if mode in leg and (mode != "embeddings" or vectors) else "bm25"](k)
            hits = hits.withColumn("raw_cosine", F.when(F.col("source") == "embeddings", F.col("score")).otherwise(0.0))
            hits = fusion.minmax(hits).withColumn("rerank_score", F.col("similarity"))
            signal = "raw_cosine" if mode == "embeddings" and vectors else None
        else:
            on = s.spec.legs
            hits = fusion.hybrid(self._lexical(b, queries, 2 * k, project), leg["embeddings"](2 * k) if vectors and "embeddings" in on else None, structural.structural(b, queries, 2 * k) if "structural" in on else None, k, self.scorer if s.rerank else None)
            signal = "rerank_score" if s.rerank and self.scorer else "raw_cosine" if vectors else None
        if guard and signal:  # the signal that was really produced
            hits = fusion.confidence_guard(hits, s.spec.rerank_least if signal == "rerank_score" else s.least_cosine, signal)
        cols = ["query_id", "rank", "id", "score", "similarity", "rerank_score", "raw_cosine"]
        return hits.select(*cols).join(b.select("id", "project_id", "filepath", F.col("name").alias("function"), F.col("text").alias("code")), "id")

    def cached_search(self, queries: DataFrame, project: str | None = None, k: int | None = None, mode: str | None = None, guard: bool = True) -> DataFrame:
        """``search`` behind a cache of answers: only texts that were not asked of this
        snapshot in this way are searched, each once, whatever its query_id;
        ``searched`` says how many. Answers lie beside the store, so other sessions
        find them; a new snapshot has a cache of its own."""
        s = self.settings
        what = repr((project, k or s.top_k, mode or s.mode, guard, s.profile, s.lexical, s.rerank, s.least_cosine, s.root))
        at = f"{self._root()}/answers/{self.store.snapshot()}/{hashlib.sha256(what.encode()).hexdigest()[:16]}"
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(at).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        keyed = queries.select("query_id", "query", F.sha2(F.coalesce("query", F.lit("")), 256).alias("key"))
        new = keyed.groupBy(F.col("key").alias("query_id")).agg(F.first("query").alias("query"))
        if fs.exists(path(f"{at}/asked")):
            new = new.join(self.spark.read.parquet(f"{at}/asked"), F.col("query_id") == F.col("key"), "left_anti")
        new = new.persist()
        self.searched = new.count()
        if self.searched:
            self.search(new, project, k, mode, guard).withColumnRenamed("query_id", "key").write.mode("append").parquet(f"{at}/hits")
            new.select(F.col("query_id").alias("key")).write.mode("append").parquet(f"{at}/asked")  # last: what is asked has its hits
        new.unpersist()
        if not fs.exists(path(f"{at}/hits")):  # no queries at all
            return self.search(queries, project, k, mode, guard)
        # two that search the same at once may both keep it
        hits = self.spark.read.parquet(f"{at}/hits").dropDuplicates(["key", "rank"])
        return keyed.select("query_id", "key").join(hits, "key").drop("key")

    def fused(self, queries: DataFrame, k: int = 5, project: str | None = None, prefix: str | None = None, scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """query_id, rank, id, score, similarity, rerank_score: full text and
        vectors fused over one store; full text alone without an embedder. A hit
        without a vector has similarity 0.5; rerank_score is null without a scorer."""
        b = self._blocks(project)
        if prefix is not None:
            b = b.where(F.col("filepath").startswith(prefix))
        legs = [(lexical.bm25(b, queries, 2 * k, fill=False, index=self._postings(project) if prefix is None else None), fusion.WEIGHTS[0])]
        if self.embed is not None:
            legs.append((vector.nearest(b.where("vector IS NOT NULL"), self.embed(queries), 2 * k), fusion.WEIGHTS[2]))
        hits = fusion.ranked(fusion.reciprocal_rank_fusion(legs), "raw").where(F.col("rank") <= k)
        hits = hits.withColumn("similarity", F.when(F.col("raw_cosine") > 0, F.col("raw_cosine")).otherwise(0.5))
        scored = scorer(hits) if scorer is not None else hits.withColumn("rerank_score", F.lit(None).cast("double"))
        return scored.select("query_id", "rank", "id", "score", "similarity", "rerank_score", "raw_cosine")

    def assemble(self, queries: DataFrame, project: str | None = None, memory: DataFrame | None = None) -> DataFrame:
        """query_id, context, tokens after compression and the tool's cap. The context
        holds the hits, the project's files, and the memory log's tail if given."""
        files_ = self.repo_map(project) if project is not None else None
        found = workspace.assemble(self.search(queries, project), memory, files_)
        small = compress.compress(found.select(F.col("query_id").alias("id"), F.col("context").alias("text")), self.settings.compression, headers=True)
        text = X.truncate_tokens(F.col("compressed"), self.settings.tool_tokens)
        return small.select(F.col("id").alias("query_id"), text.alias("context"), X.approx_tokens(text).alias("tokens"), "reduction_pct", "strategies")

    def route(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """The k best hits of each query within its best project. Each project's
        k best are found in one pass, so the winner's are complete."""
        k, b = k or self.settings.top_k, self._blocks(None)
        hits = workspace.routed_search(self._postings(None).search(queries, k, by_group=True).withColumnRenamed("grp", "project_id"), k)
        hits = fusion.minmax(hits).withColumn("rerank_score", F.col("similarity")).withColumn("raw_cosine", F.lit(0.0))
        found = b.select("id", "project_id", "filepath", F.col("name").alias("function"), F.col("text").alias("code"))
        return hits.select("query_id", "rank", "id", "project_id", "score", "similarity", "rerank_score", "raw_cosine").join(found, ["project_id", "id"])

    def orchestrate(self, work: DataFrame, generate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """work_class and chunk bounds of each row (key, text, has_instruction)."""
        sized = work.withColumn("tokens", X.approx_tokens(F.col("text")))
        planned = budget.plan_work(sized, generate is not None)
        chunks = budget.chunk_bounds(planned.where("work_class = 'local_map_reduce'").select("key", "tokens"))
        return planned.join(chunks.groupBy("key").agg(F.count("*").alias("chunks")), "key", "left").drop("text")
