"""Deterministic compression of text, as a table of lines.

A text is exploded once into (id, pos, line); stages are filters and windows
within one text, so they share its partitioning by id, and the lines are put
together again at the end. All of it stays in the JVM, comment stripping too:
a line is cut into strings and what lies between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.functions import text as X

#: Comment marks, import prefixes and the words that keep a comment.
COMMENT = {"python": "#", "javascript": "//", "typescript": "//", "rust": "//", "go": "//"}
IMPORTS = {
    "python": ["import ", "from "], "javascript": ["import ", "export ", "require("], "typescript": ["import ", "export ", "require("],
    "rust": ["use ", "extern crate "], "go": ["import "],
}
MARKERS = ["TODO", "FIXME", "XXX", "HACK", "NOTE", "BUG", "OPTIMIZE", "REVIEW", "WARNING"]
IMPORT_NOTE = "# [imports removed - see repo map]"


def lines_of(docs: DataFrame) -> DataFrame:
    """id, pos, line of docs(id, text)."""
    return docs.select("id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))


def text_of(lines: DataFrame) -> DataFrame:
    """id, text of lines; a text without lines is gone."""
    return lines.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))


#: Pieces of a line: what is outside quotes, a whole string, a string without end.
#: Strings are unrolled and possessive: no piece is read twice.
_PIECES = r"""[^'"]++|'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|['"].*"""
_EDGE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def comment_place(line: Column, mark: str) -> Column:
    """Characters before the last comment mark outside quotes; -1 without one."""
    size = len(mark)

    def step(state: Column, piece: Column) -> Column:
        bare = ~(piece.startswith("'") | piece.startswith('"')) & piece.contains(mark)
        at = state["pos"] + F.length(piece) - F.instr(F.reverse(piece), mark[::-1]) - size + 1
        return F.struct((state["pos"] + F.length(piece)).alias("pos"), F.when(bare, at).otherwise(state["cut"]).alias("cut"))

    start = F.struct(F.lit(0).alias("pos"), F.lit(-1).alias("cut"))
    return F.aggregate(F.regexp_extract_all(line, F.lit(f"(?s){_PIECES}"), 0), start, step, lambda s: s["cut"])


def without_comment(line: Column, mark: str) -> Column:
    """The line without its comment; null if it is nothing else. A comment with a
    word that marks it as wanted stays."""
    cut, left = comment_place(line, mark), F.regexp_replace(line, f"^{_EDGE}", "")
    wanted = F.lit(False)
    for m in MARKERS:
        wanted = wanted | line.contains(m)
    rest = F.regexp_replace(F.substring(line, F.lit(1), cut), f"(?<!{_EDGE[:-1]}){_EDGE}$", "")
    short = F.when(left.startswith(mark), F.lit(None)).otherwise(F.when(rest == "", line).otherwise(rest))
    return F.when(~line.contains(mark) | wanted, line).when(cut < 0, line).otherwise(short)


def remove_comments(lines: DataFrame, language: str = "python") -> DataFrame:
    mark = COMMENT.get(language)
    if mark is None:
        return lines
    return lines.withColumn("line", without_comment(F.col("line"), mark)).where("line IS NOT NULL")


def remove_imports(lines: DataFrame, language: str = "python") -> DataFrame:
    """Each run of import lines becomes one note."""
    bare = F.trim("line")
    is_import = F.lit(False)
    for p in IMPORTS.get(language, ["import "]):
        is_import = is_import | bare.startswith(p)
    is_import = is_import & ~bare.startswith("importlib") & ~bare.startswith("import_string")
    d = lines.withColumn("_i", is_import)
    first = ~F.coalesce(F.lag("_i").over(W.partitionBy("id").orderBy("pos")), F.lit(False))
    d = d.withColumn("_f", first).where("NOT _i OR _f")
    return d.select("id", "pos", F.when(F.col("_i"), F.lit(IMPORT_NOTE)).otherwise(F.col("line")).alias("line"))


def truncate_functions(lines: DataFrame, most: int = 15, keep: int = 5) -> DataFrame:
    """Functions above ``most`` lines keep their first and last five.

    A function begins at a declaration and ends before the next declaration or
    the first line that is indented no deeper.
    """
    w = W.partitionBy("id").orderBy("pos")
    head = F.col("line").rlike(r"^\s*(def |async def |function |fn |func |class |@\w+)")
    indent = F.length("line") - F.length(F.ltrim("line"))
    d = lines.withColumn("_h", head).withColumn("_in", F.when(F.trim("line") != "", indent))
    d = d.withColumn("_fn", F.sum(F.col("_h").cast("int")).over(w))  # 0 before the first
    own = W.partitionBy("id", "_fn").orderBy("pos")
    base = F.first("_in").over(own)
    out = (~F.col("_h")) & (F.col("_in") <= base)
    d = d.withColumn("_out", F.when(F.col("_fn") == 0, True).otherwise(F.coalesce(F.max(out).over(own), F.lit(False))))
    group = W.partitionBy("id", "_fn", "_out")
    d = d.withColumn("_n", F.count("*").over(group)).withColumn("_r", F.row_number().over(group.orderBy("pos")))
    long = (~F.col("_out")) & (F.col("_n") > most)
    d = d.where(~long | (F.col("_r") <= keep + 1) | (F.col("_r") > F.col("_n") - keep))
    note = F.concat(F.lit("    # ... ("), (F.col("_n") - 2 * keep).cast("string"), F.lit(" lines omitted) ..."))
    return d.select("id", "pos", F.when(long & (F.col("_r") == keep + 1), note).otherwise(F.col("line")).alias("line"))


def dedupe_patterns(lines: DataFrame) -> DataFrame:
    """Lines like an earlier one go, a note stands for each run of them."""
    pattern = F.regexp_replace(F.regexp_replace(F.trim("line"), r"\d+", "N"), r"""['"][^'"]*['"]""", '"..."')
    d = lines.withColumn("_p", pattern).withColumn("_blank", F.trim("line") == "")
    again = (F.row_number().over(W.partitionBy("id", "_p").orderBy("pos")) > 1) & ~F.col("_blank")
    d = d.withColumn("_again", again)
    first = ~F.coalesce(F.lag("_again").over(W.partitionBy("id").orderBy("pos")), F.lit(False))
    d = d.withColumn("_f", first).where("NOT _again OR _f")
    return d.select("id", "pos", F.when(F.col("_again"), F.lit("    # [duplicate pattern (1)]")).otherwise(F.col("line")).alias("line"))


def max_lines(lines: DataFrame, most: int = 100) -> DataFrame:
    """The first lines of each text and a note on the rest."""
    w = W.partitionBy("id")
    d = lines.withColumn("_r", F.row_number().over(w.orderBy("pos"))).withColumn("_n", F.count("*").over(w)).where(F.col("_r") <= most)
    note = F.concat(F.col("line"), F.lit("\n\n# ... ("), (F.col("_n") - most).cast("string"), F.lit(" more lines omitted) ..."))
    return d.select("id", "pos", F.when((F.col("_n") > most) & (F.col("_r") == most), note).otherwise(F.col("line")).alias("line"))


def filter_lines(lines: DataFrame, strip: list[str] | None = None, keep: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Declarative line filter: drop lines that match ``strip``, keep only those
    that match ``keep``, then the first ``most``."""
    if strip:
        lines = lines.where(~F.col("line").rlike("|".join(f"(?:{p})" for p in strip)))
    if keep:
        lines = lines.where(F.col("line").rlike("|".join(f"(?:{p})" for p in keep)))
    return lines if most is None else max_lines(lines, most)


def compress(docs: DataFrame, level: str = "minimal", language: str = "python", headers: bool = False) -> DataFrame:
    """id, text, compressed, original_tokens, compressed_tokens, reduction_pct,
    strategies. With ``headers``, as in assembled contexts, Markdown headers are
    not comments."""
    if level == "none":
        out = docs.select("id", "text", F.col("text").alias("compressed")).withColumn("strategies", F.array().cast("array<string>"))
    else:
        names = ["strip_ansi", "remove_comments"]
        lines = lines_of(docs.select("id", X.strip_ansi(F.col("text")).alias("text")))
        header = F.col("line").rlike(r"^#{1,6} ") if headers else F.lit(False)
        bare = remove_comments(lines.where(~header) if headers else lines, language)
        lines = lines.where(header).unionByName(bare) if headers else bare
        text = F.col("text")
        if level == "aggressive":
            text = X.collapse_docstrings(text, language)
            names.append("remove_docstrings")
        names += ["collapse_whitespace", "remove_imports"]
        lines = remove_imports(lines_of(text_of(lines).select("id", X.collapse_whitespace(text).alias("text"))), language)
        if level == "aggressive":
            lines = dedupe_patterns(truncate_functions(lines))
            names += ["truncate_functions", "deduplicate_patterns"]
        lines = max_lines(lines)
        out = docs.select("id", "text").join(text_of(lines).withColumnRenamed("text", "compressed"), "id", "left").withColumn("compressed", F.coalesce("compressed", F.lit("")))
        out = out.withColumn("strategies", F.array(*map(F.lit, [*names, "max_lines"])))
    out = out.withColumn("original_tokens", X.approx_tokens(F.col("text"))).withColumn("compressed_tokens", X.approx_tokens(F.col("compressed")))
    return out.withColumn("reduction_pct", X.reduction_pct(F.col("compressed_tokens"), F.col("original_tokens")))
