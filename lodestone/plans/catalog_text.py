"""Text, budget, compression and parsing queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.functions import text as X
from lodestone.operators import budget, compress, metrics
from lodestone.sources import files, parsing

from .catalog_search import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def ids(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source")


LINES = "ln AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"


@query
def scalar_functions(spark, d):
    t = F.col("text")
    return table(spark, d, "benchmark").select(
        "item_id", X.approx_tokens(t).alias("tokens"), F.md5(X.normalised_query(t)).alias("normal"), X.truncate_tokens(t, 10).alias("cut"), F.size(X.keywords(t)).alias("n_keywords"),
        X.project_id(t).alias("project"), X.cache_key(F.lit("search"), t).alias("cache_key"), X.simple_query(t).alias("is_simple"), X.reduction_pct(F.length(t), F.lit(1000)).alias("reduction"),
    )


SQL["scalar_functions"] = r"""SELECT item_id, greatest(1, length(text) // 4)::BIGINT AS tokens, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS normal, substr(text, 1, 40) AS cut,
len(list_distinct(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*')))::INTEGER AS n_keywords, substr(sha1(text), 1, 12) AS project, md5('search|' || text) AS cache_key,
regexp_matches(lower(text), 'docstring|type hint|rename|typo|comment|format|import|spacing|indent') AS is_simple, round(100.0 * (1 - length(text) / 1000), 1) AS reduction FROM benchmark"""


@query
def block_ids(spark, d):
    p = table(spark, d, "pages").select("page_id", X.block_id(F.regexp_extract("url", "https?://([^?]*)", 1), F.lit("page"), F.col("page_id")).alias("id"))
    return p.select("page_id", "id", X.evaluation_id(F.col("id")).alias("eval_id"), X.block_parts(F.col("id")).alias("p")).select("page_id", "id", "eval_id", "p.filepath", "p.function", "p.line_start", "p.line_end")


SQL["block_ids"] = "WITH p AS (SELECT page_id, regexp_extract(url, 'https?://([^?]*)', 1) AS f FROM pages) SELECT page_id, f || ':page:' || page_id::VARCHAR AS id, f || ':page' AS eval_id, f AS filepath, 'page' AS function, page_id::INTEGER AS line_start, page_id::INTEGER + 1 AS line_end FROM p"


@query
def token_totals(spark, d):
    return ids(spark, d).groupBy("source").agg(F.sum(X.approx_tokens(F.col("text"))).alias("tokens"), F.count("*").alias("documents"))


SQL["token_totals"] = "SELECT source, sum(greatest(1, length(text) // 4))::BIGINT AS tokens, count(*) AS documents FROM documents GROUP BY source"


def ranked_docs(spark, d):
    w = W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, d, "documents").select("source", "doc_id", X.approx_tokens(F.col("text")).alias("tokens"), F.row_number().over(w).alias("rank"))


RANKED = "rk AS (SELECT source, doc_id, greatest(1, length(text) // 4)::BIGINT AS tokens, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents)"


@query
def budget_prefix(spark, d):
    return budget.budget_prefix(ranked_docs(spark, d), 20_000, ["source"]).select("source", "doc_id", "rank", "used")


SQL["budget_prefix"] = f"WITH {RANKED}, u AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY rank)::BIGINT AS used FROM rk) SELECT source, doc_id, rank::INTEGER AS rank, used FROM u WHERE used <= 20000"


@query
def session_budget(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), X.approx_tokens(F.col("text")).alias("tokens"))
    return budget.session_charge(c, 60, 40).select("session", "seq", "tokens", F.col("emitted").cast("long").alias("emitted"))


SQL["session_budget"] = """WITH c AS (SELECT conv_id AS session, turn AS seq, greatest(1, coalesce(length(text), 0) // 4)::BIGINT AS tokens FROM conversations),
b AS (SELECT *, coalesce(sum(least(tokens, 40)) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT session, seq, tokens, greatest(0, least(least(tokens, 40), 60 - before))::BIGINT AS emitted FROM b"""


@query
def token_chunks(spark, d):
    sized = ids(spark, d).select(F.col("id").alias("key"), X.approx_tokens(F.col("text")).alias("tokens"))
    return budget.chunk_bounds(sized, 1500, 500)


SQL["token_chunks"] = """WITH s AS (SELECT doc_id AS key, greatest(1, length(text) // 4)::BIGINT AS tokens FROM documents)
SELECT key, tokens, c::INTEGER AS chunk, c * 824 AS start, least(c * 824 + 936, tokens) AS "end" FROM s, unnest(range(0, 1 + greatest(0, ceil((tokens - 936) / 824))::BIGINT)) t(c)"""


@query
def plan_workclass(spark, d):
    w = ids(spark, d).select(F.col("id").alias("key"), X.approx_tokens(F.col("text")).alias("tokens"), (F.col("id") % 5 != 0).alias("has_instruction"))
    return budget.plan_work(w, True, 1000, 500).groupBy("work_class").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


SQL["plan_workclass"] = """WITH w AS (SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS t FROM documents)
SELECT CASE WHEN doc_id % 5 = 0 THEN 'context_only' WHEN t <= 750 THEN 'local_one_shot' WHEN t <= 2000 THEN 'local_map_reduce' ELSE 'defer_to_cloud' END AS work_class, count(*) AS n, sum(t)::BIGINT AS tokens FROM w GROUP BY 1"""


@query
def greedy_batches(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("long").alias("key"), F.col("turn").cast("long").alias("seq"), X.approx_tokens(F.col("text")).alias("tokens"))
    return budget.greedy_batches(c, 60)


SQL["greedy_batches"] = """WITH RECURSIVE p AS (SELECT conv_id AS key, turn AS seq, greatest(1, length(text) // 4)::BIGINT AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
b AS (SELECT key, seq, tokens, n, 0::BIGINT AS batch, tokens AS used FROM p WHERE n = 1
      UNION ALL SELECT p.key, p.seq, p.tokens, p.n, CASE WHEN b.used > 0 AND b.used + p.tokens > 60 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.used > 0 AND b.used + p.tokens > 60 THEN p.tokens ELSE b.used + p.tokens END
      FROM b JOIN p ON p.key = b.key AND p.n = b.n + 1)
SELECT key, seq, tokens, batch FROM b"""


@query
def token_reduction(spark, d):
    used = budget.budget_prefix(ranked_docs(spark, d), 20_000, ["source"]).groupBy("source").agg(F.max("used").alias("used_tokens"))
    whole = ids(spark, d).agg(F.sum(X.approx_tokens(F.col("text"))).alias("whole_tokens"))
    return metrics.token_reduction(used.crossJoin(whole))


SQL["token_reduction"] = f"""WITH {RANKED}, u AS (SELECT source, sum(tokens) OVER (PARTITION BY source ORDER BY rank)::BIGINT AS used FROM rk), p AS (SELECT source, max(used) AS used FROM u WHERE used <= 20000 GROUP BY source),
l AS (SELECT list_sort(list(used)) AS v, count(*) AS n FROM p), t AS (SELECT sum(greatest(1, length(text) // 4))::BIGINT AS w FROM documents)
SELECT n, w AS whole_tokens, v[1 + floor(n * 0.5)::INT] AS median, v[1 + floor(n * 0.25)::INT] AS p25, v[1 + floor(n * 0.75)::INT] AS p75, round(100 * (1 - v[1 + floor(n * 0.5)::INT] / w), 1) AS reduction_pct FROM l, t"""


@query
def collapse_whitespace(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(X.collapse_whitespace(F.regexp_replace("html", "<[^>]*>", "\n"))).alias("m"))


SQL["collapse_whitespace"] = r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]*>', chr(10), 'g'), '\n\s*\n\s*\n', chr(10) || chr(10), 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(t, '(?m)[ \t\x0B\f\r]+$', '', 'g') AS t FROM a)
SELECT page_id, md5(regexp_replace(regexp_replace(t, '^(?:[ \t\x0B\f\r]*\n)+', ''), '(?:\n[ \t\x0B\f\r]*)+$', '')) AS m FROM b"""


def stats_of(lines: DataFrame) -> DataFrame:
    t = compress.text_of(lines)
    return t.select("id", F.md5("text").alias("m"), F.length("text").alias("chars"))


@query
def collapse_imports(spark, d):
    """Lines that begin with two common words stand for imports."""
    lines = compress.lines_of(ids(spark, d)).withColumn("line", F.regexp_replace("line", "^(The|En) ", "import "))
    return stats_of(compress.remove_imports(lines))


SQL["collapse_imports"] = f"""WITH {LINES}, a AS (SELECT id, pos, regexp_replace(line, '^(The|En) ', 'import ') AS line FROM ln),
b AS (SELECT *, (starts_with(trim(line), 'import ') OR starts_with(trim(line), 'from ')) AND NOT starts_with(trim(line), 'importlib') AND NOT starts_with(trim(line), 'import_string') AS i FROM a),
c AS (SELECT *, coalesce(lag(i) OVER (PARTITION BY id ORDER BY pos), false) AS p FROM b),
t AS (SELECT id, string_agg(CASE WHEN i THEN '# [imports removed - see repo map]' ELSE line END, chr(10) ORDER BY pos) AS text FROM c WHERE NOT i OR NOT p GROUP BY id)
SELECT id, md5(text) AS m, length(text)::INTEGER AS chars FROM t"""


@query
def dedupe_patterns(spark, d):
    return stats_of(compress.dedupe_patterns(compress.lines_of(ids(spark, d))))


SQL["dedupe_patterns"] = rf"""WITH {LINES}, a AS (SELECT *, regexp_replace(regexp_replace(trim(line), '\d+', 'N', 'g'), '[''"][^''"]*[''"]', '"..."', 'g') AS p, trim(line) = '' AS blank FROM ln),
b AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY id, p ORDER BY pos) > 1 AS again FROM a), c AS (SELECT *, coalesce(lag(again) OVER (PARTITION BY id ORDER BY pos), false) AS was FROM b),
t AS (SELECT id, string_agg(CASE WHEN again THEN '    # [duplicate pattern (1)]' ELSE line END, chr(10) ORDER BY pos) AS text FROM c WHERE NOT again OR NOT was GROUP BY id)
SELECT id, md5(text) AS m, length(text)::INTEGER AS chars FROM t"""


@query
def max_lines(spark, d):
    return stats_of(compress.max_lines(compress.lines_of(ids(spark, d)), 5))


SQL["max_lines"] = f"""WITH {LINES}, a AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM ln),
t AS (SELECT id, string_agg(line, chr(10) ORDER BY pos) || CASE WHEN max(n) > 5 THEN chr(10) || chr(10) || '# ... (' || (max(n) - 5)::VARCHAR || ' more lines omitted) ...' ELSE '' END AS text FROM a WHERE pos < 5 GROUP BY id)
SELECT id, md5(text) AS m, length(text)::INTEGER AS chars FROM t"""


@query
def filter_lines(spark, d):
    return stats_of(compress.filter_lines(compress.lines_of(ids(spark, d)), [r"^\s*$", "^The "], ["[a-z]"], 30))


SQL["filter_lines"] = rf"""WITH {LINES}, a AS (SELECT * FROM ln WHERE NOT regexp_matches(line, '(?:^\s*$)|(?:^The )') AND regexp_matches(line, '[a-z]')), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS r, count(*) OVER (PARTITION BY id) AS n FROM a),
t AS (SELECT id, string_agg(line, chr(10) ORDER BY pos) || CASE WHEN max(n) > 30 THEN chr(10) || chr(10) || '# ... (' || (max(n) - 30)::VARCHAR || ' more lines omitted) ...' ELSE '' END AS text FROM b WHERE r <= 30 GROUP BY id)
SELECT id, md5(text) AS m, length(text)::INTEGER AS chars FROM t"""


@query
def truncate_functions(spark, d):
    """Words one a line, capitalised ones as declarations, so that functions are frequent."""
    t = ids(spark, d).select("id", F.regexp_replace("text", " ", "\n  ").alias("text"))
    name = F.col("line").rlike("^ *[A-Z][a-z]*[.,]?$")
    lines = compress.lines_of(t).withColumn("line", F.when(name, F.concat(F.lit("def "), F.trim("line"))).otherwise(F.col("line")))
    return stats_of(compress.truncate_functions(lines))


SQL["truncate_functions"] = r"""WITH w AS (SELECT doc_id AS id, string_split(replace(text, ' ', chr(10) || '  '), chr(10)) AS l FROM documents),
x AS (SELECT id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM w),
y AS (SELECT id, pos, CASE WHEN regexp_matches(line, '^ *[A-Z][a-z]*[.,]?$') THEN 'def ' || trim(line) ELSE line END AS line FROM x),
a AS (SELECT *, regexp_matches(line, '^\s*(def |async def |function |fn |func |class |@\w+)') AS h, CASE WHEN trim(line) <> '' THEN length(line) - length(ltrim(line)) END AS ind FROM y),
b AS (SELECT *, sum(h::INT) OVER (PARTITION BY id ORDER BY pos) AS fn FROM a),
c AS (SELECT *, NOT h AND ind <= first_value(ind) OVER (PARTITION BY id, fn ORDER BY pos) AS o FROM b),
e AS (SELECT *, CASE WHEN fn = 0 THEN true ELSE coalesce(max(o::INT) OVER (PARTITION BY id, fn ORDER BY pos), 0) = 1 END AS out FROM c),
f AS (SELECT *, count(*) OVER (PARTITION BY id, fn, out) AS n, row_number() OVER (PARTITION BY id, fn, out ORDER BY pos) AS r FROM e),
t AS (SELECT id, string_agg(CASE WHEN NOT out AND n > 15 AND r = 6 THEN '    # ... (' || (n - 10)::VARCHAR || ' lines omitted) ...' ELSE line END, chr(10) ORDER BY pos) AS text
      FROM f WHERE out OR n <= 15 OR r <= 6 OR r > n - 5 GROUP BY id)
SELECT id, md5(text) AS m, length(text)::INTEGER AS chars FROM t"""


@query
def compress_text(spark, d):
    return compress.compress(ids(spark, d), "aggressive").select("id", F.md5("compressed").alias("m"), "original_tokens", "compressed_tokens", "reduction_pct")


#: A line's strings and what lies between them.
PIECES = r"""(?s)[^'"]+|'[^'\\]*(?:\\.[^'\\]*)*'|"[^"\\]*(?:\\.[^"\\]*)*"|['"].*""".replace("'", "''")
SQL["compress_text"] = rf"""WITH a AS (SELECT doc_id AS id, regexp_replace(coalesce(text, ''), '\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])', '', 'g') AS t FROM documents),
l0 AS (SELECT id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM a),
l1 AS (SELECT *, CASE WHEN contains(line, '#') AND NOT regexp_matches(line, '{"|".join(compress.MARKERS)}') THEN regexp_extract_all(line, '{PIECES}') END AS p FROM l0),
l2 AS (SELECT *, list_max(list_filter(range(1, len(p) + 1), lambda i: p[i][1] <> '''' AND p[i][1] <> '"' AND contains(p[i], '#'))) AS k FROM l1),
l3 AS (SELECT *, regexp_replace(substr(line, 1, length(array_to_string(p[1:k - 1], '')) + length(p[k]) - strpos(reverse(p[k]), '#')), '\s+$', '') AS cut FROM l2),
l4 AS (SELECT id, pos, CASE WHEN k IS NULL OR cut = '' THEN line ELSE cut END AS line FROM l3 WHERE k IS NULL OR NOT regexp_matches(line, '^\s*#')),
t1 AS (SELECT id, string_agg(line, chr(10) ORDER BY pos) AS t FROM l4 GROUP BY id),
t2 AS (SELECT id, regexp_replace(regexp_replace(t, '"{{3}}[\s\S]*?"{{3}}', repeat('"', 3) || '...' || repeat('"', 3), 'g'), '''{{3}}[\s\S]*?''{{3}}', repeat('''', 3) || '...' || repeat('''', 3), 'g') AS t FROM t1),
t3 AS (SELECT id, regexp_replace(regexp_replace(t, '\n\s*\n\s*\n', chr(10) || chr(10), 'g'), '(?m)[ \t\x0B\f\r]+$', '', 'g') AS t FROM t2),
t4 AS (SELECT id, string_split(regexp_replace(regexp_replace(t, '^(?:[ \t\x0B\f\r]*\n)+', ''), '(?:\n[ \t\x0B\f\r]*)+$', ''), chr(10)) AS t FROM t3),
m0 AS (SELECT id, unnest(t) AS line, generate_subscripts(t, 1) AS pos FROM t4),
m1 AS (SELECT *, (starts_with(trim(line), 'import ') OR starts_with(trim(line), 'from ')) AND NOT starts_with(trim(line), 'importlib') AND NOT starts_with(trim(line), 'import_string') AS i FROM m0),
m2 AS (SELECT *, coalesce(lag(i) OVER (PARTITION BY id ORDER BY pos), false) AS was FROM m1),
m3 AS (SELECT id, pos, CASE WHEN i THEN '{compress.IMPORT_NOTE}' ELSE line END AS line FROM m2 WHERE NOT i OR NOT was),
f0 AS (SELECT *, regexp_matches(line, '^\s*(def |async def |function |fn |func |class |@\w+)') AS h, CASE WHEN trim(line) <> '' THEN length(line) - length(ltrim(line)) END AS ind FROM m3),
f1 AS (SELECT *, sum(h::INT) OVER (PARTITION BY id ORDER BY pos) AS fn FROM f0),
f2 AS (SELECT *, NOT h AND ind <= first_value(ind) OVER (PARTITION BY id, fn ORDER BY pos) AS o FROM f1),
f3 AS (SELECT *, CASE WHEN fn = 0 THEN true ELSE coalesce(max(o::INT) OVER (PARTITION BY id, fn ORDER BY pos), 0) = 1 END AS out FROM f2),
f4 AS (SELECT *, count(*) OVER (PARTITION BY id, fn, out) AS n, row_number() OVER (PARTITION BY id, fn, out ORDER BY pos) AS r FROM f3),
f5 AS (SELECT id, pos, CASE WHEN NOT out AND n > 15 AND r = 6 THEN '    # ... (' || (n - 10)::VARCHAR || ' lines omitted) ...' ELSE line END AS line FROM f4 WHERE out OR n <= 15 OR r <= 6 OR r > n - 5),
d0 AS (SELECT *, regexp_replace(regexp_replace(trim(line), '\d+', 'N', 'g'), '[''"][^''"]*[''"]', '"..."', 'g') AS p, trim(line) = '' AS blank FROM f5),
d1 AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY id, p ORDER BY pos) > 1 AS again FROM d0),
d2 AS (SELECT *, coalesce(lag(again) OVER (PARTITION BY id ORDER BY pos), false) AS was FROM d1),
d3 AS (SELECT id, pos, CASE WHEN again THEN '    # [duplicate pattern (1)]' ELSE line END AS line FROM d2 WHERE NOT again OR NOT was),
x AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS r, count(*) OVER (PARTITION BY id) AS n FROM d3),
c AS (SELECT id, string_agg(line, chr(10) ORDER BY pos) || CASE WHEN max(n) > 100 THEN chr(10) || chr(10) || '# ... (' || (max(n) - 100)::VARCHAR || ' more lines omitted) ...' ELSE '' END AS text FROM x WHERE r <= 100 GROUP BY id),
z AS (SELECT doc_id AS id, coalesce(c.text, '') AS m, greatest(1, length(coalesce(d.text, '')) // 4)::BIGINT AS o, greatest(1, length(coalesce(c.text, '')) // 4)::BIGINT AS k FROM documents d LEFT JOIN c ON c.id = d.doc_id)
SELECT id, md5(m) AS m, o AS original_tokens, k AS compressed_tokens, CASE WHEN o > 0 THEN round(100.0 * (1 - k / o), 1) ELSE 0.0 END AS reduction_pct FROM z"""


@query
def yaml_split(spark, d):
    f = ids(spark, d).select(F.col("id").cast("string").alias("filepath"), F.regexp_replace("text", r"\n([A-Z][a-z]) ", "\n---\nkind: $1\n").alias("text"))
    return parsing.yaml_documents(f)


SQL["yaml_split"] = r"""WITH f AS (SELECT doc_id::VARCHAR AS filepath, string_split(regexp_replace(text, '\n([A-Z][a-z]) ', chr(10) || '---' || chr(10) || 'kind: \1' || chr(10), 'g'), chr(10) || '---' || chr(10)) AS p FROM documents),
u AS (SELECT filepath, unnest(p) AS doc, generate_subscripts(p, 1) - 1 AS pos FROM f), n AS (SELECT *, len(string_split(doc, chr(10))) AS n FROM u),
s AS (SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY filepath ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, regexp_extract(doc, '(?m)^\s*kind:\s*(\S+)', 1) AS kind FROM n)
SELECT filepath, pos::INTEGER AS pos, CASE WHEN kind <> '' THEN kind ELSE substr(string_split(doc, chr(10))[1], 1, 30) END AS name, before + 1 AS line_start, before + n AS line_end, length(doc)::INTEGER AS chars FROM s WHERE trim(regexp_replace(doc, '\s', '', 'g')) <> ''"""


@query
def parse_blocks(spark, d):
    """Documents as modules: a definition for each line."""
    code = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("def f_"), i.cast("string"), F.lit("(self):\n    '''"), F.regexp_replace(x, r"[\\']", ""), F.lit("'''\n"))), "\n")
    f = ids(spark, d).select(F.concat(F.lit("src/"), F.col("id").cast("string"), F.lit(".py")).alias("filepath"), code.alias("text"))
    return parsing.blocks(parsing.parse_files(f)).groupBy("filepath").agg(F.count("*").alias("blocks"), F.sum(F.col("line_end") - F.col("line_start")).alias("span"), F.max("function").alias("last"))


SQL["parse_blocks"] = "SELECT 'src/' || doc_id::VARCHAR || '.py' AS filepath, len(string_split(text, chr(10))) AS blocks, len(string_split(text, chr(10))) AS span, list_max(list_transform(range(0, len(string_split(text, chr(10)))), lambda i: 'f_' || i::VARCHAR)) AS last FROM documents"


def paths(spark, d):
    """Urls as paths of projects; the path's length picks an ending."""
    ends = F.array(*map(F.lit, [".py", ".tf", ".yaml", ".cs", ".sh", ".md"]))
    p = F.regexp_extract("url", r"example\.com/([^?#]*)", 1)
    return table(spark, d, "pages").select(F.regexp_extract("url", r"([a-z]+)[.]example", 1).alias("project_id"), F.concat(F.regexp_replace(p, "/$", ""), F.element_at(ends, (F.col("page_id") % 6 + 1).cast("int"))).alias("filepath"))


PATHS = r"pt AS (SELECT regexp_extract(url, '([a-z]+)[.]example', 1) AS project_id, regexp_replace(regexp_extract(url, 'example\.com/([^?#]*)', 1), '/$', '') || ['.py', '.tf', '.yaml', '.cs', '.sh', '.md'][1 + page_id % 6] AS filepath, page_id FROM pages)"


@query
def extension_census(spark, d):
    return files.census(paths(spark, d))


SQL["extension_census"] = rf"WITH {PATHS} SELECT regexp_extract(filepath, '[^/](\.[^./]+)$', 1) AS ext, count(*) AS files FROM pt WHERE regexp_extract(filepath, '[^/](\.[^./]+)$', 1) <> '' GROUP BY 1"


@query
def profile_classify(spark, d):
    p = paths(spark, d).withColumn("ext", files.extension(F.col("filepath")))
    return files.profile(p.groupBy("project_id", "ext").agg(F.count("*").alias("files")))


SQL["profile_classify"] = rf"""WITH {PATHS}, e AS (SELECT project_id, regexp_extract(filepath, '[^/](\.[^./]+)$', 1) AS ext FROM pt),
c AS (SELECT project_id, count(*) AS n, count(*) FILTER (WHERE ext IN ('.tf', '.hcl')) AS tf, count(*) FILTER (WHERE ext = '.yaml') AS y, count(*) FILTER (WHERE ext = '.cs') AS cs, count(*) FILTER (WHERE ext = '.py') AS py, count(*) FILTER (WHERE ext = '.sh') AS sh FROM e GROUP BY project_id)
SELECT project_id, CASE WHEN tf > 0 THEN 'iac' WHEN y / n > 0.5 AND greatest(py, cs) / n <= 0.3 THEN 'iac' WHEN cs > 0 THEN 'dotnet' WHEN py / n > 0.5 THEN 'python' WHEN sh / n > 0.5 THEN 'shell' ELSE 'code' END AS profile FROM c"""


@query
def exclude_filter(spark, d):
    return paths(spark, d).where(~files.excluded(F.col("filepath"), ["**/fr/**", "de/**", "*.tf", "en/1*"])).select("project_id", "filepath")


SQL["exclude_filter"] = rf"WITH {PATHS} SELECT project_id, filepath FROM pt WHERE NOT regexp_matches(filepath, '(^|/)fr(/|$)') AND NOT regexp_matches(filepath, '(^|/)de(/|$)') AND NOT regexp_matches(filepath, '(^|/)[^/]*\.tf(/|$)') AND NOT regexp_matches(filepath, '(^|/)en/1[^/]*(/|$)')"


@query
def layout_rank(spark, d):
    return files.source_layout(paths(spark, d))


SQL["layout_rank"] = rf"""WITH {PATHS}, e AS (SELECT *, regexp_extract(filepath, '[^/](\.[^./]+)$', 1) AS ext, CASE WHEN contains(filepath, '/') THEN string_split(filepath, '/')[1] END AS top FROM pt),
f AS (SELECT * FROM e WHERE ext <> ''), x AS (SELECT project_id, ext, count(*) AS n, count(*) FILTER (WHERE top IS NULL) AS at_root FROM f GROUP BY 1, 2),
m AS (SELECT project_id, at_root FROM x QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY n DESC, ext DESC) = 1),
g AS (SELECT project_id, top, count(*) AS n FROM f WHERE top IS NOT NULL GROUP BY 1, 2), b AS (SELECT *, row_number() OVER w AS r, lead(n) OVER w AS nx FROM g WINDOW w AS (PARTITION BY project_id ORDER BY n DESC, top))
SELECT m.project_id, CASE WHEN b.top IS NOT NULL AND (nx IS NULL OR b.n > 2 * nx) AND at_root = 0 THEN b.top ELSE '.' END AS source_root FROM m LEFT JOIN b ON b.project_id = m.project_id AND r = 1"""


@query
def language_detect(spark, d):
    return paths(spark, d).select(files.language(F.col("filepath")).alias("language")).groupBy("language").agg(F.count("*").alias("files"))


SQL["language_detect"] = rf"""WITH {PATHS}, e AS (SELECT regexp_extract(filepath, '[^/](\.[^./]+)$', 1) AS ext FROM pt)
SELECT CASE ext WHEN '.tf' THEN 'hcl' WHEN '.yaml' THEN 'yaml' WHEN '.cs' THEN 'csharp' WHEN '.sh' THEN 'bash' ELSE 'python' END AS language, count(*) AS files FROM e GROUP BY 1"""


@query
def canonical_text(spark, d):
    c = table(spark, d, "conversations")
    kind = F.when(F.col("role") == "assistant", "tool_result").when(F.col("role") == "system", "image").otherwise("text")
    b = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", kind.alias("type"), "text"))).alias("b"))
    return b.select("conv_id", F.md5(X.content_text(F.col("b"))).alias("m"))


SQL["canonical_text"] = "SELECT conv_id, md5(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role <> 'system'), '')) AS m FROM conversations GROUP BY conv_id"


@query
def last_user_message(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


SQL["last_user_message"] = "SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id"


@query
def diff_summary(spark, d):
    """Documents as diffs that touch a file for each of their lines."""
    names = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("diff --git a/x b/src/"), F.length(x).cast("string"), F.when(F.length(x) % 3 == 0, ".md").when(F.length(x) % 3 == 1, "_test.py").otherwise(".yaml"), F.lit("\n+ line")))
    return ids(spark, d).select("id", X.diff_summary(F.array_join(names, "\n")).alias("summary"))


SQL["diff_summary"] = """WITH n AS (SELECT doc_id AS id, text, list_sort(list_distinct(list_transform(string_split(text, chr(10)), lambda x: 'src/' || length(x)::VARCHAR || CASE length(x) % 3 WHEN 0 THEN '.md' WHEN 1 THEN '_test.py' ELSE '.yaml' END))) AS f FROM documents),
h AS (SELECT *, list_filter([CASE WHEN len(list_filter(f, lambda x: contains(x, 'test'))) > 0 THEN 'tests' END, CASE WHEN len(list_filter(f, lambda x: x LIKE '%.md')) > 0 THEN 'documentation' END, CASE WHEN len(list_filter(f, lambda x: x LIKE '%.yaml')) > 0 THEN 'config' END], lambda x: x IS NOT NULL) AS k FROM n)
SELECT id, CASE WHEN text IS NULL THEN 'No significant changes.' ELSE 'Modified ' || CASE WHEN len(k) > 0 THEN array_to_string(k, ' + ') ELSE 'code' END || ': ' || array_to_string(f[1:5], '; ') || CASE WHEN len(f) > 5 THEN '; +' || (len(f) - 5)::VARCHAR || ' more' ELSE '' END END AS summary FROM h"""
