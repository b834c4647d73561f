"""Quality rules from distribution divergence, in DataFrame functions only.

Each text's character-class histogram and its histogram over its language's
common words are compared with the language's reference by the Jensen-Shannon
distance (base 2, so 0 to 1). The references are made of the median shares over
all texts of the language in the table, so that poor texts, being fewer than
half, do not move them. A text too short for a histogram is not judged by it.

Edge cases: a null text has no words; a null or unknown language is a language
of its own whose common words are those of all lists; rows that repeat count
each time; an empty table gives no rows; columns that are not asked for by
``carry`` are ignored, so names never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Frequent function words of each language.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "was", "it", "with", "this"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por"],
}
CLASSES = ["lower", "upper", "digit", "space", "mark", "symbol", "other"]
WINDOW = 8


def _js(p: str, q: str) -> Column:
    """Jensen-Shannon distance of two arrays of counts."""
    return F.expr(f"""
        sqrt(greatest(0D, aggregate(zip_with(
            transform({p}, x -> x / greatest(1e-9D, aggregate({p}, 0D, (s, v) -> s + v))),
            transform({q}, x -> x / greatest(1e-9D, aggregate({q}, 0D, (s, v) -> s + v))),
            (a, b) -> (CASE WHEN a > 0 THEN a * log2(2 * a / (a + b)) ELSE 0D END + CASE WHEN b > 0 THEN b * log2(2 * b / (a + b)) ELSE 0D END) / 2),
            0D, (s, v) -> s + v)))""")


def features(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Counts and histograms of each text."""
    every = sorted({w for ws in COMMON.values() for w in ws})
    pick = F.coalesce(*[F.when(F.col("_lang") == k, F.array(*map(F.lit, v))) for k, v in COMMON.items()], F.array(*map(F.lit, every)))
    of = lambda pattern: F.length("_text") - F.length(F.regexp_replace("_text", pattern, ""))
    d = docs.select(*carry, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"), F.col("lang").cast("string").alias("_lang"))
    d = d.select(
        *carry, "_lang",
        F.regexp_extract_all("_text", F.lit(WORD), 0).alias("_w"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)).alias("_l"),
        F.regexp_extract_all(F.lower("_text"), F.lit(r"(?<!\p{L})(" + "|".join(every) + r")(?!\p{L})"), 1).alias("_c"),
        pick.alias("_pick"),
        F.length("_text").cast("long").alias("_n"),
        of(r"\p{Ll}+").cast("long").alias("_lower"), of(r"\p{Lu}+").cast("long").alias("_upper"), of(r"\p{Nd}+").cast("long").alias("_digit"),
        of(r"[.,;:!?'\"()-]+").cast("long").alias("_mark"), of(r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
    )
    d = d.select(
        *carry, "_lang", "n_symbols", "_l",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.expr(f"CASE WHEN size(_w) >= {WINDOW} THEN transform(sequence(1, size(_w) - {WINDOW - 1}), i -> xxhash64(slice(_w, i, {WINDOW}))) ELSE array() END").cast("array<bigint>").alias("_g"),
        "_n", "_lower", "_upper", "_digit", "_mark",
        F.concat(F.expr("transform(_pick, x -> CAST(size(_c) - size(array_remove(_c, x)) AS BIGINT))"), F.array(F.size("_w").cast("long"))).alias("_words"),
    )
    # what is in no word is space; a tenth of a text may be digits, since numbers are no sign of poor prose
    space = F.col("_n") - F.col("word_chars")
    other = F.greatest(F.lit(0), F.expr("word_chars - _lower - _upper - _digit - _mark - n_symbols"))
    d = d.withColumn("chars", F.array("_lower", "_upper", F.greatest(F.lit(0), F.expr("_digit - _n div 10")), space, "_mark", "n_symbols", other)).drop("_n", "_lower", "_upper", "_digit", "_mark")
    # the last place of the word histogram holds all other words
    d = d.withColumn("words", F.expr("concat(slice(_words, 1, size(_words) - 1), array(greatest(0L, n_words - aggregate(slice(_words, 1, size(_words) - 1), 0L, (s, v) -> s + v))))")).drop("_words")
    d = d.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")).drop("_l")
    d = d.withColumn("_s", F.expr("CASE WHEN size(array_distinct(_g)) < size(_g) THEN array_sort(transform(_g, (h, i) -> struct(h, i))) ELSE array() END")).drop("_g")
    d = d.withColumn("_at", F.expr("array_sort(transform(filter(_s, (x, k) -> x.h <=> get(_s, k - 1).h OR x.h <=> get(_s, k + 1).h), x -> x.i))")).drop("_s")
    covered = F.expr(f"aggregate(_at, named_struct('t', 0L, 'e', 0L), (a, x) -> named_struct('t', a.t + x + {WINDOW} - greatest(CAST(x AS BIGINT), a.e), 'e', CAST(x + {WINDOW} AS BIGINT)), a -> a.t)")
    return d.withColumn("n_repeat_words", covered).drop("_at")


def quality_rules(spark: SparkSession, docs: DataFrame, carry: list[str] | None = None, most_char_js: float = 0.13, short_slack: float = 4.5, most_word_js: float = 0.5, least_chars: int = 100, least_words: int = 50, most_languages: int = 10_000) -> DataFrame:
    """carry (doc_id unless given), the counts, char_js, word_js, base_failed and
    kept for each row of docs(text, lang, ...).

    Few words make rough histograms: the character limit is most_char_js plus
    short_slack / n_words.
    """
    carry = ["doc_id"] if carry is None else carry
    scratch = Scratch(spark, "quality")
    own = scratch.keep(features(docs, carry), "features")
    width = max(len(v) for v in COMMON.values()) + 1
    width = max(width, len({w for ws in COMMON.values() for w in ws}) + 1)
    # shares to three places: exact medians of at most 1001 values each, merged in part
    share = lambda c, i: F.round(F.get(c, F.lit(i)) / F.greatest(F.lit(1), F.aggregate(c, F.lit(0).cast("long"), lambda s, v: s + v)), 3)
    medians = lambda c, n: F.array(*[F.coalesce(F.percentile(share(c, i), 0.5), F.lit(0.0)) for i in range(n)])
    refs = own.where("n_words >= 20").groupBy("_lang").agg(medians("chars", len(CLASSES)).alias("_rc"), medians("words", width).alias("_rw")).withColumnRenamed("_lang", "_ref")
    refs = scratch.keep(refs, "references")
    # one row a language; past the bound the join is left to Spark
    if refs.count() <= most_languages:
        refs = F.broadcast(refs)
    d = own.join(refs, F.col("_lang").eqNullSafe(F.col("_ref")), "left")
    d = d.withColumn("_rw", F.expr("slice(_rw, 1, size(words))"))
    d = d.withColumn("_rc", F.coalesce("_rc", F.expr("transform(chars, x -> CAST(x AS DOUBLE))"))).withColumn("_rw", F.coalesce("_rw", F.expr("transform(words, x -> CAST(x AS DOUBLE))")))
    d = d.withColumn("char_js", _js("chars", "_rc")).withColumn("word_js", _js("words", "_rw"))
    far = ((F.col("char_js") > most_char_js + short_slack / F.greatest(F.col("n_words"), F.lit(1))) & (F.expr("aggregate(chars, 0L, (s, v) -> s + v)") >= least_chars)) | ((F.col("word_js") > most_word_js) & (F.col("n_words") >= least_words))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return d.select(*carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_js", "word_js", failed.alias("base_failed"), (~failed & ~far).alias("kept"))


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_EVERY = sorted({w for ws in COMMON.values() for w in ws})
_JS = """sqrt(greatest(0, list_sum(list_transform(list_zip(list_transform({p}, lambda x: x / greatest(1e-9, list_sum({p}))), list_transform({q}, lambda x: x / greatest(1e-9, list_sum({q})))),
  lambda z: (CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END) / 2))))"""
_PICK = "CASE lang " + " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in COMMON.items()) + f" ELSE {_list(_EVERY)} END"
_GONE = lambda p: f"(length(text) - length(regexp_replace(text, '{p}', '', 'g')))::BIGINT"
_MEDIANS = lambda c, n: "[" + ", ".join(f"coalesce(quantile_cont(round({c}[{i + 1}] / greatest(1, list_sum({c})), 3), 0.5), 0)" for i in range(n)) + "]"
#: The query's result in DuckDB's SQL.
SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, lang FROM documents),
a AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
        list_filter(regexp_extract_all(lower(text), '\p{{L}}+'), lambda x: list_contains({_list(_EVERY)}, x)) AS c, {_PICK} AS pick,
        {_GONE(r'[#*$%&|<>]+')} AS n_symbols, [{_GONE(r'\p{Ll}+')}, {_GONE(r'\p{Lu}+')}, {_GONE(r'\p{Nd}+')}, {_GONE(r'[ \t\n\x0B\f\r]+')}, {_GONE(r"[.,;:!?''" + r'"()-]+')}, {_GONE(r'[#*$%&|<>]+')}] AS k FROM t),
b AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        length(text) AS size, list_concat(k, [greatest(0, length(text) - list_sum(k))::BIGINT]) AS chars, list_transform(pick, lambda x: len(list_filter(c, lambda y: y = x))::BIGINT) AS h FROM a),
h AS (SELECT * EXCLUDE (h, chars, size), list_concat(chars[1:2], [greatest(0, chars[3] - size // 10)::BIGINT], chars[4:7]) AS chars, list_concat(h, [greatest(0, n_words - list_sum(h))::BIGINT]) AS words FROM b),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM a, unnest(range(1, greatest(len(w) - 6, 1))) u(i) WHERE len(w) >= 8),
m AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
s AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM m WHERE n > 1),
p AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8)))::BIGINT AS r FROM s GROUP BY doc_id),
f AS (SELECT lang, {_MEDIANS('chars', len(CLASSES))} AS rc, {_MEDIANS('words', len(_EVERY) + 1)} AS rw FROM h WHERE n_words >= 20 GROUP BY lang),
j AS (SELECT h.*, coalesce(p.r, 0) AS n_repeat_words, {_JS.format(p='chars', q='rc')} AS cj, {_JS.format(p='words', q='rw[1:len(words)]')} AS wj FROM h LEFT JOIN p USING (doc_id) LEFT JOIN f ON h.lang IS NOT DISTINCT FROM f.lang),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, coalesce((cj > 0.13 + 4.5 / greatest(n_words, 1) AND list_sum(chars) >= 100) OR (wj > 0.5 AND n_words >= 50), false) AS far FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT far AS kept FROM v
"""
