"""Rules of files, texts and evaluations that the other catalogs do not reach."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import evaluate, memory, metrics, workspace
from lodestone.sources import files
from lodestone.streaming import watch

from .catalog_search import SQL as SEARCH_SQL
from .catalog_search import context_assembly, context_hits, table
from .catalog_tables import SQL as TABLES_SQL
from .catalog_tables import notes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def docs(spark, d):
    return table(spark, d, "documents")


@query
def strip_ansi(spark, d):
    coloured = F.concat(F.lit("\x1b[1;31m"), F.regexp_replace("text", " ", "\x1b[0m "), F.lit("\x1b[K"))
    return docs(spark, d).select("doc_id", F.md5(X.strip_ansi(coloured)).alias("m"))


SQL["strip_ansi"] = r"""SELECT doc_id, md5(regexp_replace(chr(27) || '[1;31m' || replace(text, ' ', chr(27) || '[0m ') || chr(27) || '[K', '\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])', '', 'g')) AS m FROM documents"""


@query
def collapse_docstrings(spark, d):
    """Commas stand for the quotes of docstrings."""
    return docs(spark, d).select("doc_id", F.md5(X.collapse_docstrings(F.regexp_replace("text", ",", '"""'))).alias("m"))


SQL["collapse_docstrings"] = r"""SELECT doc_id, md5(regexp_replace(regexp_replace(replace(text, ',', '\"\"\"'), '\"\"\"[\s\S]*?\"\"\"', '\"\"\"...\"\"\"', 'g'), '[\x27]{3}[\s\S]*?[\x27]{3}', repeat(chr(39), 3) || '...' || repeat(chr(39), 3), 'g')) AS m FROM documents""".replace(r'\"', '"')


@query
def watched_files(spark, d):
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".py").otherwise(".txt")))
    return docs(spark, d).select("doc_id", path.alias("filepath")).where(files.watched(F.col("filepath"), ["*.py", "1*"], ["*/src0/*", "de/*"]))


SQL["watched_files"] = r"""WITH p AS (SELECT doc_id, lang || '/' || source || '/' || doc_id::VARCHAR || CASE WHEN doc_id % 3 = 0 THEN '.py' ELSE '.txt' END AS filepath FROM documents)
SELECT doc_id, filepath FROM p WHERE (filepath LIKE '%.py' OR regexp_matches(filepath, '/1[^/]*$')) AND NOT contains(filepath, '/src0/') AND NOT starts_with(filepath, 'de/')"""


@query
def sync_due(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("last"), F.max("ts").alias("now"), (F.count("*") - 5).alias("behind"))
    return e.select("user_id", watch.should_sync(F.col("last").cast("timestamp"), F.col("now").cast("timestamp"), F.col("behind"), 86_400).alias("due"))


SQL["sync_due"] = "SELECT user_id, count(*) - 5 > 0 AND floor(epoch(max(ts))) - floor(epoch(min(ts))) >= 86400 AS due FROM events GROUP BY user_id"


@query
def infra_markers(spark, d):
    """Documents as files; some words make them manifests."""
    f = docs(spark, d).select(F.concat(F.col("source"), F.lit("-"), (F.col("doc_id") % 50).cast("string")).alias("project_id"), F.concat_ws("/", "lang", F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".yaml").otherwise(".md"))).alias("filepath"), F.regexp_replace(F.regexp_replace("text", "an", "kind:"), "er", "apiVersion:").alias("text"))
    return files.infra_markers(f)


SQL["infra_markers"] = """WITH f AS (SELECT source || '-' || (doc_id % 50)::VARCHAR AS project_id, doc_id % 2 = 0 AS yaml, substr(replace(replace(text, 'an', 'kind:'), 'er', 'apiVersion:'), 1, 4096) AS head FROM documents)
SELECT project_id, bool_or(yaml AND contains(head, 'kind:') AND contains(head, 'apiVersion:')) AS infra FROM f GROUP BY project_id"""


@query
def context_judged(spark, d):
    """Texts as contexts, held against their source's number and their language."""
    t = docs(spark, d)
    return t.select("doc_id", X.gold_in_context(F.col("text"), F.col("lang")).alias("shown"), X.plausible(F.col("lang"), F.col("source"), F.col("text")).alias("plausible"))


SQL["context_judged"] = """SELECT doc_id, CASE WHEN contains(lower(text), 'no relevant') OR length(text) < 50 THEN false ELSE contains(text, lang) END AS shown, contains(lower(source || ' ' || text), lower(lang)) AS plausible FROM documents"""


@query
def profile_rates(spark, d):
    """Orders as evaluated queries."""
    o = table(spark, d, "orders")
    rank = F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderkey") % 7)
    return evaluate.profile_rates(o.select((F.col("o_custkey") % 2 == 0).alias("relevant"), rank.alias("hit_rank"), (F.col("o_totalprice") > 100_000).alias("passed"), (F.col("o_orderkey") % 1000).alias("tokens")))


SQL["profile_rates"] = """WITH q AS (SELECT o_custkey % 2 = 0 AS rel, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 7 END AS r, o_totalprice > 100000 AS passed, o_orderkey % 1000 AS tokens FROM orders)
SELECT round(100 * avg(coalesce(r = 1, false)::INT) FILTER (WHERE rel), 1) AS top1_pct, round(100 * avg(coalesce(r <= 5, false)::INT) FILTER (WHERE rel), 1) AS top5_pct, round(100 * avg((NOT passed)::INT) FILTER (WHERE NOT rel), 1) AS suppressed_pct, round(avg(tokens), 1) AS avg_tokens FROM q"""


@query
def index_latency(spark, d):
    return metrics.index_latency(table(spark, d, "events"), "event_type")


SQL["index_latency"] = """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS n, max(value) FILTER (WHERE r = n // 2) AS p50, max(value) FILTER (WHERE r = n * 95 // 100) AS p95 FROM r GROUP BY event_type"""


@query
def context_with_map(spark, d):
    """Contexts with a map of the files and the tail of the memory logs."""
    t = table(spark, d, "documents")
    files_ = t.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("filepath"), F.col("lang").alias("names"))
    out = workspace.assemble(context_hits(spark, d), memory.tail(memory.entry(notes(spark, d)), 10, 40), files_)
    return out.select("query_id", F.md5("context").alias("context_md5"), "tokens")


SQL["context_with_map"] = SEARCH_SQL["context_assembly"].rsplit("SELECT query_id, md5", 1)[0] + f""", mp AS (SELECT string_agg(f, chr(10) ORDER BY f) AS map FROM (SELECT source || '/' || doc_id::VARCHAR || ': ' || lang AS f FROM documents ORDER BY source || '/' || doc_id::VARCHAR LIMIT 20)),
me AS (SELECT max(text) AS memory FROM ({TABLES_SQL["memory_tail"]})), fin AS (SELECT query_id, context || chr(10) || chr(10) || '## Files' || chr(10) || map || chr(10) || chr(10) || '## Recent changes' || chr(10) || memory AS context FROM c, mp, me)
SELECT query_id, md5(context) AS context_md5, greatest(1, length(context) // 4)::BIGINT AS tokens FROM fin"""


@query
def cold_warm_latency(spark, d):
    """Events as runs: a user's first of a kind is cold."""
    return metrics.cold_and_warm(table(spark, d, "events"), "event_type", "user_id", ["ts", "event_id"])


SQL["cold_warm_latency"] = """WITH r AS (SELECT event_type, value, CASE WHEN row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) = 1 THEN 'cold' ELSE 'warm' END AS phase FROM events WHERE value IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY event_type, phase ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type, phase) AS n FROM r)
SELECT event_type, phase, count(*) AS count, max(value) FILTER (WHERE i = floor(50 * (n - 1) / 100)) AS p50, max(value) FILTER (WHERE i = floor(95 * (n - 1) / 100)) AS p95 FROM s GROUP BY event_type, phase"""


def doc_files(spark, d):
    return docs(spark, d).select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("filepath"), "text")


TOTALS = """p AS (SELECT source || '/' || doc_id::VARCHAR AS filepath, text FROM documents), tr AS (SELECT string_agg(filepath, chr(10) ORDER BY filepath) AS t FROM (SELECT filepath FROM p ORDER BY filepath LIMIT 50)),
tot AS (SELECT count(*) AS files, sum(greatest(1, length(text) // 4))::BIGINT AS whole_tokens, greatest(1, length(any_value(t)) // 4)::BIGINT AS tree_tokens FROM p, tr)"""


@query
def tree_tokens(spark, d):
    return metrics.tree_tokens(doc_files(spark, d))


SQL["tree_tokens"] = f"WITH {TOTALS} SELECT files, whole_tokens, tree_tokens FROM tot"


@query
def end_to_end_reduction(spark, d):
    return metrics.end_to_end(context_assembly(spark, d), metrics.tree_tokens(doc_files(spark, d)))


SQL["end_to_end_reduction"] = f"""WITH {TOTALS}, ctx AS ({SEARCH_SQL["context_assembly"]}), a AS (SELECT *, tree_tokens + 10 * (whole_tokens // greatest(files, 1)) AS agent FROM ctx, tot)
SELECT query_id, tokens, round(100.0 * (1 - tokens / whole_tokens), 1) AS whole_pct, round(100.0 * (1 - tokens / agent), 1) AS agent_pct FROM a"""
