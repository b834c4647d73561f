"""Event, cache, store and memory queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import caches, memory, metrics, workspace
from lodestone.sources import files, store
from lodestone.streaming import watch

from .catalog_search import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "2024-01-20 00:00:00"


def query(f):
    QUERIES[f.__name__] = f
    return f


def events(spark, d):
    return table(spark, d, "events")


def logs(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return events(spark, d).select("event_id", F.col("event_type").alias("category"), "ts", "value", k.alias("results"), (F.coalesce(k, F.lit(0)) > 90).alias("error"))


LOGS = "lg AS (SELECT event_id, event_type AS category, ts, value, json_extract_string(props, '$.k')::INTEGER AS results, coalesce(json_extract_string(props, '$.k')::INTEGER, 0) > 90 AS error FROM events)"


@query
def metrics_summary(spark, d):
    return metrics.summary(logs(spark, d)).withColumn("last_ts", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss"))


SQL["metrics_summary"] = f"""WITH {LOGS}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ts DESC, event_id DESC) <= 50 AS l FROM lg)
SELECT category, count(*) AS total, round(avg(value), 1) AS avg_value, round(avg(results) FILTER (WHERE l), 1) AS avg_results, round(100 * avg(error::INT), 1) AS error_rate, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM r GROUP BY category"""


@query
def latency_percentiles(spark, d):
    return metrics.latency_summary(events(spark, d), "event_type")


SQL["latency_percentiles"] = """WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS count, round(avg(value), 4) AS mean, min(value) AS min, max(value) AS max, max(value) FILTER (WHERE i = floor(50 * (n - 1) / 100)) AS p50, max(value) FILTER (WHERE i = floor(95 * (n - 1) / 100)) AS p95, max(value) FILTER (WHERE i = floor(99 * (n - 1) / 100)) AS p99 FROM s GROUP BY event_type"""


@query
def rolling_history(spark, d):
    return metrics.keep_last(logs(spark, d), 500).select("category", "event_id")


SQL["rolling_history"] = f"WITH {LOGS} SELECT category, event_id FROM lg QUALIFY row_number() OVER (PARTITION BY category ORDER BY ts DESC, event_id DESC) <= 500"


def history(spark, d):
    v = F.floor(F.col("value") * 10).cast("long")
    return events(spark, d).select("event_id", "ts", (v + 10).alias("original"), F.floor(v / 3).cast("long").alias("compressed"), (F.col("user_id") % 50).cast("long").alias("ms"))


HIST = "hs AS (SELECT event_id, ts, floor(value * 10)::BIGINT + 10 AS original, floor(floor(value * 10)::BIGINT / 3)::BIGINT AS compressed, (user_id % 50)::BIGINT AS ms FROM events)"


@query
def token_stats(spark, d):
    return metrics.token_stats(history(spark, d), F.lit(NOW).cast("timestamp_ntz"), 15)


SQL["token_stats"] = f"""WITH {HIST}, r AS (SELECT *, original - compressed AS s, CASE WHEN original > 0 THEN round((original - compressed) / original * 100, 1) ELSE 0.0 END AS p FROM hs WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 15 DAYS)
SELECT count(*) AS total_requests, coalesce(sum(s), 0)::BIGINT AS total_saved_tokens, coalesce(round(avg(p), 1), 0) AS avg_savings_pct, coalesce(sum(ms), 0)::BIGINT AS total_time_ms, coalesce(round(avg(ms), 0), 0) AS avg_time_ms, round(coalesce(sum(s), 0) / 1e6 * 0.14, 4) AS saved_cost FROM r"""


@query
def retained_history(spark, d):
    return metrics.retained(history(spark, d), F.lit(NOW).cast("timestamp_ntz"), 10, 10_000).select("event_id")


SQL["retained_history"] = f"SELECT event_id FROM events WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 10 DAYS ORDER BY ts DESC, event_id DESC LIMIT 10000"


@query
def recent_activity(spark, d):
    e = events(spark, d)
    parts = [e.where(F.col("event_type") == k).select("ts", F.lit(k).alias("source"), F.col("event_id").cast("string").alias("detail")) for k in ("click", "view", "purchase")]
    return metrics.recent_activity(parts, 8).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


SQL["recent_activity"] = "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, source, detail FROM (SELECT ts, event_type AS source, event_id::VARCHAR AS detail FROM events WHERE event_type IN ('click', 'view', 'purchase') ORDER BY ts DESC, source, detail LIMIT 8)"


@query
def sparkline(spark, d):
    days = events(spark, d).groupBy("event_type", F.to_date("ts").alias("pos")).agg(F.count("*").alias("value"))
    return metrics.sparkline(days, "event_type")


SQL["sparkline"] = """WITH a AS (SELECT event_type, ts::DATE AS pos, count(*) AS v FROM events GROUP BY 1, 2), b AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM a WINDOW w AS (PARTITION BY event_type))
SELECT event_type, string_agg(substr('▁▂▃▄▅▆▇█', CASE WHEN hi = lo THEN 5 ELSE 1 + floor((v - lo) / (hi - lo) * 7)::INT END, 1), '' ORDER BY pos) AS line FROM b GROUP BY event_type"""


@query
def debounce_sessions(spark, d):
    s = watch.debounce(events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", key="user_id")
    return s.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events")


SQL["debounce_sessions"] = """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events FROM b GROUP BY user_id, s"""


def requests(spark, d):
    return events(spark, d).select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), "ts", "event_id")


@query
def cache_ttl_replay(spark, d):
    return caches.replay(requests(spark, d), 86_400)


REPLAY = """rq AS (SELECT user_id::VARCHAR || ':' || event_type AS key, epoch_us(ts) AS t, event_id FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, event_id) AS n FROM rq),
rp AS (SELECT key, n, event_id, t, t AS since, false AS hit FROM o WHERE n = 1
       UNION ALL SELECT o.key, o.n, o.event_id, o.t, CASE WHEN o.t - rp.since <= 86400000000 THEN rp.since ELSE o.t END, o.t - rp.since <= 86400000000 FROM rp JOIN o ON o.key = rp.key AND o.n = rp.n + 1)"""
SQL["cache_ttl_replay"] = f"WITH RECURSIVE {REPLAY} SELECT key, event_id, hit FROM rp"


@query
def cache_hit_rate(spark, d):
    return caches.hit_rate(caches.replay(requests(spark, d), 86_400))


SQL["cache_hit_rate"] = f"WITH RECURSIVE {REPLAY} SELECT key, count(*) AS requests, sum(hit::INT)::BIGINT AS hits, round(avg(hit::INT), 3) AS hit_rate FROM rp GROUP BY key"


@query
def cache_unexpired(spark, d):
    e = requests(spark, d).groupBy("key").agg(F.max("ts").alias("ts"), F.max("event_id").alias("value"))
    return caches.unexpired(e, F.lit(NOW).cast("timestamp_ntz"), 5 * 86_400).select("key", "value")


SQL["cache_unexpired"] = f"WITH e AS (SELECT user_id::VARCHAR || ':' || event_type AS key, max(ts) AS ts, max(event_id) AS value FROM events GROUP BY 1) SELECT key, value FROM e WHERE TIMESTAMP '{NOW}' - ts <= INTERVAL 5 DAYS"


@query
def lru_evict(spark, d):
    e = events(spark, d).groupBy("event_type", F.col("user_id").alias("key")).agg(F.max("ts").alias("ts"))
    return caches.evict(e, 20, ["event_type"]).select("event_type", "key")


SQL["lru_evict"] = "WITH e AS (SELECT event_type, user_id AS key, max(ts) AS ts FROM events GROUP BY 1, 2) SELECT event_type, key FROM e QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, key) <= 20"


@query
def semantic_cache_lookup(spark, d):
    """Every vector asks; 97 ids have the text of an entry, the others none, so similarity decides."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("probe_id"), F.col("embedding").alias("vector"), "label")
    day = F.lit(NOW).cast("timestamp_ntz")
    entries = v.where("label % 2 = 0").select(F.concat(F.lit("query "), (F.col("probe_id") % 97).cast("string")).alias("query"), "vector", F.col("probe_id").alias("value"), (day + F.when(F.col("probe_id") % 3 == 0, F.expr("INTERVAL -1 HOUR")).otherwise(F.expr("INTERVAL 1 HOUR"))).alias("expires_at"))
    return caches.semantic_lookup(v.withColumn("query", F.concat(F.lit("  Query  "), F.col("probe_id").cast("string"))), entries, day, 0.3)


SQL["semantic_cache_lookup"] = """WITH v AS (SELECT vec_id, 'query ' || (vec_id % 97)::VARCHAR AS eq, 'query ' || vec_id::VARCHAR AS q, embedding::DOUBLE[] AS x, label FROM embeddings), e AS (SELECT *, vec_id % 3 <> 0 AS live FROM v WHERE label % 2 = 0),
ex AS (SELECT v.vec_id, bool_or(live) AS live, max(e.vec_id) FILTER (WHERE live) AS value FROM v JOIN e ON e.eq = v.q GROUP BY v.vec_id),
sm AS (SELECT v.vec_id, e.vec_id AS value, round(list_cosine_similarity(v.x, e.x), 6) AS s FROM v, e WHERE live AND v.vec_id NOT IN (SELECT vec_id FROM ex)),
b AS (SELECT vec_id, value FROM sm WHERE s >= 0.3 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, value DESC) = 1)
SELECT v.vec_id AS probe_id, CASE WHEN ex.vec_id IS NOT NULL THEN CASE WHEN ex.live THEN ex.value END ELSE b.value END AS value,
  CASE WHEN ex.vec_id IS NOT NULL THEN CASE WHEN ex.live THEN 'exact' ELSE 'expired' END WHEN b.vec_id IS NOT NULL THEN 'semantic' ELSE 'miss' END AS match FROM v LEFT JOIN ex USING (vec_id) LEFT JOIN b USING (vec_id)"""


def versions(spark, d):
    """Orders as stored rows of two versions; the later has other prices and lacks some."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_totalprice").alias("price"), F.lit(1).alias("v"))
    return o.where("id % 5 <> 0"), o.where("id % 3 = 0").withColumn("price", F.round(F.col("price") * 2, 2)).withColumn("v", F.lit(2))


OLD_NEW = "o AS (SELECT o_orderkey AS id, o_custkey AS owner, o_totalprice AS price, 1 AS v FROM orders), a AS (SELECT * FROM o WHERE id % 5 <> 0), b AS (SELECT id, owner, round(price * 2, 2) AS price, 2 AS v FROM o WHERE id % 3 = 0)"


@query
def upsert_merge(spark, d):
    old, new = versions(spark, d)
    return store.merged(old, new, ["id"])


SQL["upsert_merge"] = f"WITH {OLD_NEW} SELECT * FROM b UNION ALL SELECT * FROM a WHERE id NOT IN (SELECT id FROM b)"


@query
def dedupe_latest(spark, d):
    old, new = versions(spark, d)
    return store.latest(old.unionByName(new), ["id"], "v")


SQL["dedupe_latest"] = f"WITH {OLD_NEW} SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY id ORDER BY v DESC) = 1"


@query
def delete_by_file(spark, d):
    old, new = versions(spark, d)
    return old.join(new.select("owner").distinct(), "owner", "left_anti").select("id", "owner", "price", "v")


SQL["delete_by_file"] = f"WITH {OLD_NEW} SELECT * FROM a WHERE owner NOT IN (SELECT owner FROM b)"


@query
def delta_apply(spark, d):
    old, new = versions(spark, d)
    feed = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("filepath"), F.when(F.col("c_custkey") % 2 == 0, "deleted").otherwise("modified").alias("change")).where("CAST(filepath AS BIGINT) % 4 < 2")
    f = lambda x: x.withColumn("filepath", F.col("owner").cast("string"))
    return store.applied(f(old), f(new), feed).select("id", "owner", "price", "v")


SQL["delta_apply"] = f"WITH {OLD_NEW}, f AS (SELECT c_custkey AS owner, c_custkey % 2 = 0 AS gone FROM customer WHERE c_custkey % 4 < 2) SELECT * FROM a WHERE owner NOT IN (SELECT owner FROM f) UNION ALL SELECT * FROM b WHERE owner IN (SELECT owner FROM f WHERE NOT gone)"


@query
def delta_apply_projects(spark, d):
    """The same files in two projects: a feed of one leaves the other's rows."""
    old, new = versions(spark, d)
    two = lambda x: x.withColumn("filepath", F.col("owner").cast("string")).withColumn("project_id", F.explode(F.array(F.lit("p1"), F.lit("p2"))))
    feed = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 3 == 0, "p1").otherwise("p2").alias("project_id"), F.col("c_custkey").cast("string").alias("filepath"), F.when(F.col("c_custkey") % 2 == 0, "deleted").otherwise("modified").alias("change"))
    return store.applied(two(old), two(new), feed, ("project_id", "filepath")).select("project_id", "id", "owner", "price", "v")


SQL["delta_apply_projects"] = f"""WITH {OLD_NEW}, p AS (SELECT unnest(['p1', 'p2']) AS project_id), f AS (SELECT c_custkey AS owner, CASE WHEN c_custkey % 3 = 0 THEN 'p1' ELSE 'p2' END AS project_id, c_custkey % 2 = 0 AS gone FROM customer)
SELECT p.project_id, a.* FROM a, p WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.owner = a.owner AND f.project_id = p.project_id)
UNION ALL SELECT p.project_id, b.* FROM b, p WHERE EXISTS (SELECT 1 FROM f WHERE f.owner = b.owner AND f.project_id = p.project_id AND NOT gone)"""


@query
def snapshot_diff(spark, d):
    old, new = versions(spark, d)
    f = lambda x: x.select(F.col("id").cast("string").alias("filepath"), F.col("price").cast("string").alias("text"))
    return files.changes(f(old), f(new)).groupBy("change").agg(F.count("*").alias("files"))


SQL["snapshot_diff"] = f"WITH {OLD_NEW}, j AS (SELECT a.price AS p, b.price AS q FROM a FULL JOIN b ON a.id = b.id) SELECT CASE WHEN q IS NULL THEN 'deleted' WHEN p IS NULL THEN 'added' ELSE 'modified' END AS change, count(*) AS files FROM j WHERE p IS DISTINCT FROM q GROUP BY 1"


@query
def name_status(spark, d):
    """Page ids as status lines of each kind."""
    i = F.col("page_id").cast("string")
    line = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("M\ta/"), i)).when(F.col("page_id") % 4 == 1, F.concat(F.lit("D\ta/"), i)).when(F.col("page_id") % 4 == 2, F.concat(F.lit("R100\ta/"), i, F.lit("\tb/"), i)).otherwise(F.concat(F.lit("A\ta/"), i))
    return files.parse_status(table(spark, d, "pages").select(line.alias("line")))


SQL["name_status"] = """SELECT 'a/' || page_id::VARCHAR AS filepath, CASE WHEN page_id % 4 IN (1, 2) THEN 'deleted' ELSE 'modified' END AS change FROM pages UNION ALL SELECT 'b/' || page_id::VARCHAR, 'modified' FROM pages WHERE page_id % 4 = 2"""


@query
def project_isolation(spark, d):
    p = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("project_id"), F.concat(F.lit("/srv/"), "source").alias("filepath"))
    return workspace.drop_foreign(p, "src1", "/srv/src1").select("doc_id", "project_id")


SQL["project_isolation"] = "SELECT doc_id, 'src1' AS project_id FROM documents WHERE (doc_id % 3 = 0 OR source = 'src1') AND starts_with('/srv/' || source, '/srv/src1')"


def notes(spark, d):
    return events(spark, d).select(F.col("user_id").alias("log_id"), F.col("ts"), F.col("event_id").alias("seq"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("note"))


@query
def memory_rotate(spark, d):
    return memory.rotate(notes(spark, d), 50).select("log_id", "seq")


SQL["memory_rotate"] = "SELECT user_id AS log_id, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50"


@query
def memory_compact(spark, d):
    return memory.compact(notes(spark, d), 60).select("log_id", "seq", "note")


SQL["memory_compact"] = """WITH a AS (SELECT user_id AS log_id, event_id AS seq, event_type || ' ' || event_id::VARCHAR AS note, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
SELECT log_id, seq, CASE WHEN n >= 60 AND r = 1 THEN '[COMPACTED] Multiple historical changes (60 entries compacted).' ELSE note END AS note FROM a WHERE n < 60 OR r > 60 OR r = 1"""


@query
def memory_tail(spark, d):
    return memory.tail(memory.entry(notes(spark, d)), 10, 40).select("log_id", "text")


SQL["memory_tail"] = """WITH a AS (SELECT user_id AS log_id, '[' || strftime(ts, '%Y-%m-%d %H:%M') || '] ' || event_type || ' ' || event_id::VARCHAR AS line, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events),
b AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY log_id ORDER BY r) - 1 AS used FROM a WHERE r <= 10)
SELECT log_id, string_agg(CASE WHEN greatest(1, used // 4) > 40 THEN substr(line, 1, 160) ELSE line END, chr(10) ORDER BY r DESC) AS text FROM b WHERE greatest(1, used // 4) <= 40 OR r = 1 GROUP BY log_id"""


@query
def stream_fold(spark, d):
    """Words of conversations as deltas of their turn."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("message_id"), F.col("turn").alias("index"), F.posexplode(F.split("text", "(?<= )")).alias("seq", "text"))
    e = c.select("message_id", "index", "seq", F.lit("content_block_delta").alias("kind"), "text")
    stop = table(spark, d, "conversations").select(F.col("conv_id").alias("message_id"), F.lit(None).cast("int").alias("index"), F.col("turn").cast("int").alias("seq"), F.lit("message_delta").alias("kind"), F.lit("end_turn").alias("text"))
    return watch.fold_stream(e.unionByName(stop)).select("message_id", "index", F.md5("text").alias("m"), "stop_reason")


SQL["stream_fold"] = "SELECT conv_id AS message_id, turn AS index, md5(text) AS m, 'end_turn' AS stop_reason FROM conversations WHERE text IS NOT NULL"


@query
def freshness_states(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("project")).agg(F.count("*").alias("n"))
    behind = F.col("n") * 400
    return o.select("project", watch.freshness(behind).alias("state"), X.approx_tokens(F.lit("x")).alias("least"))


SQL["freshness_states"] = "SELECT o_custkey AS project, CASE WHEN count(*) * 400 >= 10000 THEN 'full' WHEN count(*) * 400 >= 1000 THEN 'quick' ELSE 'fresh' END AS state, 1::BIGINT AS least FROM orders GROUP BY o_custkey"
