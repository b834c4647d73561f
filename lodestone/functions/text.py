"""Scalar text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a search drops.
STOPWORDS = [
    "the", "how", "does", "a", "to", "of", "in", "is", "are", "be", "and", "or", "not", "but", "if", "else", "for", "while", "do", "as", "by",
    "with", "from", "on", "at", "this", "that", "which", "when", "where", "what", "why", "who", "can", "should", "would", "could", "may",
    "might", "must", "have", "has", "had", "did",
]
#: Words that mark a request as simple.
SIMPLE_MARKS = ["docstring", "type hint", "rename", "typo", "comment", "format", "import", "spacing", "indent"]


def word_tokens(text: Column) -> Column:
    """Lower-case runs of [a-z0-9]."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def keywords(text: Column) -> Column:
    """Distinct identifiers of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z_][a-z0-9_]*"), 0))


def search_terms(query: Column) -> Column:
    """Distinct identifiers of three characters or more, without stop words."""
    terms = F.regexp_extract_all(F.lower(query), F.lit("[a-z_][a-z0-9_]{2,}"), 0)
    return F.array_except(F.array_distinct(terms), F.array(*map(F.lit, STOPWORDS)))


def _whole(parts: Column) -> Column:
    return F.filter(parts, lambda p: p != "")


def name_tokens(name: Column) -> Column:
    """Parts of a block's name, and its parts joined by _ and by -."""
    low = F.lower(name)
    under = F.array_join(_whole(F.split(low, "[.-]+")), "_")
    dash = F.array_join(_whole(F.split(low, "[_.]")), "-")
    joined = F.array(F.when(under != "", under), F.when((dash != "") & (dash != under), dash))
    return F.array_distinct(F.array_compact(F.concat(_whole(F.split(low, "[._-]+")), joined)))


def identifiers(text: Column) -> Column:
    """Names and references: declarations, dotted names, prefixed names, kinds."""
    low = F.lower(text)
    declared = r'(?:resource|data)\s+"([a-z_][a-z0-9_]*)"\s+"([a-z_][a-z0-9_-]*)"'
    # a name is looked for at its start only: no match begins inside one
    dotted = r"(?<![a-z_])([a-z_][a-z0-9_]*+)\s*+\.\s*+([a-z_][a-z0-9_-]*+)"
    prefixed = r"\b(var|module|data|resource|output|kind|metadata)[\s.]+([a-z_][a-z0-9_-]*)"

    def pairs(pattern: str, first: bool) -> Column:
        """Both names of each match, the first if asked, and both with a dot."""
        one, two = (lambda m, g=g: F.regexp_extract(m, pattern, g) for g in (1, 2))
        names = lambda m: F.array(*([one(m)] if first else []), two(m), F.concat(one(m), F.lit("."), two(m)))
        return F.flatten(F.transform(F.regexp_extract_all(low, F.lit(pattern), 0), names))

    return F.array_distinct(F.concat(pairs(declared, True), pairs(dotted, True), pairs(prefixed, False), F.regexp_extract_all(low, F.lit(r"\bkind\s*:\s*([a-z][a-z0-9-]*)"), 1)))


def rounded(value: Column, places: int) -> Column:
    """Rounded as SQL engines round binary numbers: scaled up, to the next whole
    number, scaled down. Spark's own round works on the decimal notation, in which
    0.5005 is a tie; scaled up as a binary number it lies below it."""
    scale = F.lit(10.0**places)
    return F.round(value * scale) / scale


def normalised_query(query: Column) -> Column:
    """Trimmed, lower-cased, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(query), r"\s+", " "))


def approx_tokens(text: Column) -> Column:
    """A quarter of the characters, one at least; null counts as empty."""
    return F.greatest(F.lit(1), F.floor(F.coalesce(F.length(text), F.lit(0)) / 4)).cast("long")


def truncate_tokens(text: Column, most: Column | int) -> Column:
    """The text's first ``most`` approximate tokens."""
    n = F.lit(most) if isinstance(most, int) else most
    return F.when(n <= 0, F.lit("")).otherwise(F.substring(text, F.lit(1), n * 4))


def block_id(filepath: Column, function: Column, line: Column) -> Column:
    return F.concat_ws(":", filepath, function, line.cast("string"))


def block_parts(doc_id: Column) -> Column:
    """filepath, function, line_start and line_end of an id; 0 for a bad line."""
    p = r"^(.*):([^:]*):([^:]*)$"
    line = F.coalesce(F.expr("try_cast(NULL AS INT)"), F.regexp_extract(doc_id, p, 3).try_cast("int"), F.lit(0))
    return F.struct(F.regexp_extract(doc_id, p, 1).alias("filepath"), F.regexp_extract(doc_id, p, 2).alias("function"), line.alias("line_start"), (line + 1).alias("line_end"))


def evaluation_id(doc_id: Column) -> Column:
    """An id without its line."""
    return F.regexp_replace(doc_id, ":[0-9]+$", "")


def project_id(path: Column) -> Column:
    return F.substring(F.sha1(path), 1, 12)


def cache_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])", "")


def collapse_docstrings(text: Column, language: str = "python") -> Column:
    if language == "python":
        return F.regexp_replace(F.regexp_replace(text, r'"""[\s\S]*?"""', '"""..."""'), r"'''[\s\S]*?'''", "'''...'''")
    if language in ("javascript", "typescript", "rust"):
        return F.regexp_replace(F.regexp_replace(text, r"/\*\*[\s\S]*?\*/", "/** ... */"), r"/\*![\s\S]*?\*/", "/*! ... */")
    return text


def collapse_whitespace(text: Column) -> Column:
    """Runs of blank lines become one; line ends and outer blank lines go."""
    text = F.regexp_replace(text, r"\n\s*\n\s*\n", "\n\n")
    text = F.regexp_replace(text, r"(?m)[ \t\x0B\f\r]+$", "")
    return F.regexp_replace(F.regexp_replace(text, r"^(?:[ \t\x0B\f\r]*\n)+", ""), r"(?:\n[ \t\x0B\f\r]*)+$", "")


def changed_paths(diff: Column) -> Column:
    """Paths that a diff names, sorted, each once."""
    heads = F.regexp_extract_all(diff, F.lit(r"(?m)^diff --git .* b/(.*?)\s*$"), 1)
    files = F.filter(F.regexp_extract_all(diff, F.lit(r"(?m)^(?:\+\+\+|---)[+\- /]*(.*?)\s*$"), 1), lambda f: (f != "") & (f != "dev/null"))
    plain = F.transform(files, lambda f: F.regexp_replace(f, "^[ab]/", ""))
    return F.array_sort(F.array_distinct(F.concat(heads, plain)))


def diff_summary(diff: Column) -> Column:
    """One line on what a diff touches."""
    files = changed_paths(diff)
    n = F.size(files)
    some = lambda p: F.exists(files, lambda f: f.rlike(p))
    hints = F.array_compact(F.array(F.when(some("(?i)test"), "tests"), F.when(some(r"\.(md|rst|txt)$"), "documentation"), F.when(some(r"\.(ya?ml|json|toml)$"), "config")))
    what = F.when(F.size(hints) > 0, F.array_join(hints, " + ")).otherwise("code")
    names = F.concat(F.array_join(F.slice(files, 1, 5), "; "), F.when(n > 5, F.concat(F.lit("; +"), (n - 5).cast("string"), F.lit(" more"))).otherwise(""))
    text = F.when(n == 0, F.lit("Modified codebase (diff details unavailable).")).otherwise(F.concat(F.lit("Modified "), what, F.lit(": "), names))
    return F.when(diff.isNull() | (F.length(F.trim(diff)) < 10), F.lit("No significant changes.")).otherwise(text)


def reduction_pct(compressed: Column, original: Column) -> Column:
    """Percent saved, to one place; 0 without an original."""
    return F.when(original > 0, F.round(100.0 * (1 - compressed / original), 1)).otherwise(F.lit(0.0))


def gold_in_context(context: Column, function: Column) -> Column:
    """Whether an assembled context shows the wanted function."""
    return F.when(F.lower(context).contains("no relevant") | (F.length(context) < 50), F.lit(False)).otherwise(F.coalesce(context.contains(function), F.lit(False)))


def plausible(expected: Column, function: Column, filepath: Column) -> Column:
    return F.lower(F.concat_ws(" ", function, filepath)).contains(F.lower(expected))


def simple_query(query: Column) -> Column:
    return F.lower(query).rlike("|".join(SIMPLE_MARKS))


def content_text(blocks: Column) -> Column:
    """Text and tool results of an array of content blocks, a line each."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"].isin("text", "tool_result")), lambda b: b["text"]), "\n")


def hit_line(rank: Column, function: Column, filepath: Column, similarity: Column, code: Column) -> Column:
    """A hit as a line with a preview of 200 characters."""
    return F.concat(rank.cast("string"), F.lit(". "), function, F.lit(" ("), filepath, F.lit(") "), F.format_string("%.3f", rounded(similarity, 3)), F.lit("\n"), F.substring(code, 1, 200))
