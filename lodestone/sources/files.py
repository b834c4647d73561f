"""File scans, path filters and what the paths tell about a tree."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: File ending -> language.
LANGUAGES = {
    ".py": "python", ".pyw": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".ts": "typescript",
    ".tsx": "typescript", ".rs": "rust", ".go": "go", ".c": "cpp", ".h": "cpp", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp",
    ".cs": "csharp", ".java": "java", ".rb": "ruby", ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".yaml": "yaml", ".yml": "yaml", ".tf": "hcl",
    ".tfvars": "hcl", ".hcl": "hcl", ".json": "json", ".toml": "toml", ".cfg": "toml", ".ini": "toml",
}


def extension(path: Column) -> Column:
    """The ending of a file's name with its dot, or ''."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(path.rlike(r"(^|/)Dockerfile$"), F.lit("bash")).otherwise(F.coalesce(F.try_element_at(table, F.lower(extension(path))), F.lit("python")))


def _segment(glob: str) -> str:
    """One path segment's glob as a regular expression."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", r"\\")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = end
        else:
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
        i += 1
    return out


def glob_regex(pattern: str) -> str:
    """The regular expression of an exclude pattern over relative paths.

    A plain name matches any part of a path, a plain path matches its start
    (anywhere after a leading ``**/``), a glob matches whole parts in a row.
    """
    core = pattern
    anywhere = core.startswith("**/")
    core = core.removeprefix("**/")
    while core.endswith("/**"):
        core = core[:-3]
    core = core.rstrip("/")
    anchored = "/" in core and not anywhere and not re.search(r"[*?\[]", core)
    body = "/".join(map(_segment, core.split("/")))
    return f"^{body}(/|$)" if anchored else f"(^|/){body}(/|$)"


def excluded(path: Column, patterns: list[str]) -> Column:
    return path.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns)) if patterns else F.lit(False)


def watched(path: Column, include: list[str], exclude: list[str]) -> Column:
    """The watcher's filter: include by name, exclude by the whole path."""
    any_of = lambda c, ps, f: c.rlike("|".join(f(p) for p in ps)) if ps else F.lit(False)
    name = F.element_at(F.split(path, "/"), -1)
    whole = lambda p: "^" + _segment(p).replace("[^/]", ".") + "$"
    return any_of(name, include, lambda p: f"^{_segment(p)}$") & ~any_of(path, exclude, whole)


def chosen_roots(spark: SparkSession, root: str, within: list[str] | None) -> list[str]:
    """The folders below root to read: those that exist, and none inside another."""
    base = root.rstrip("/")
    named = sorted({posixpath.normpath(w.strip("/") or ".") for w in within or ["."]}, key=len)
    if any(w.startswith("..") for w in named):
        raise ValueError("a source root lies outside the tree")
    kept = []
    for w in named:
        if not any(k == "." or w == k or w.startswith(f"{k}/") for k in kept):
            kept.append(w)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [at for at in (base if k == "." else f"{base}/{k}" for k in sorted(kept)) if fs.exists(path(at))]


def read_files(spark: SparkSession, root: str, patterns: list[str], exclude: list[str] | None = None, max_kb: int = 0, source_roots: list[str] | None = None) -> DataFrame:
    """filepath (relative to root), text, modified of the files below root, or
    below its ``source_roots``, each file once.

    Paths are pruned before any content is read; bytes that are no UTF-8 are replaced.
    """
    roots = chosen_roots(spark, root, source_roots)
    if not roots and source_roots:
        return spark.createDataFrame([], "filepath string, text string, modified timestamp")
    names = "{" + ",".join(sorted(set(patterns))) + "}" if len(set(patterns)) > 1 else patterns[0]
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(roots or root)
    base = root.rstrip("/").removeprefix("file:")
    d = d.withColumn("filepath", F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(base) + "/", ""))
    d = d.where(~excluded(F.col("filepath"), exclude or []))
    if max_kb:
        d = d.where(F.col("length") <= max_kb * 1024)
    return d.select("filepath", utf8(F.col("content")).alias("text"), F.col("modificationTime").alias("modified"))


def utf8(content: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def census(files: DataFrame) -> DataFrame:
    """Files of each ending."""
    return files.select(extension(F.col("filepath")).alias("ext")).where("ext <> ''").groupBy("ext").agg(F.count("*").alias("files"))


def profile(counts: DataFrame, markers: Column | None = None) -> DataFrame:
    """The profile of each project_id with (ext, files)."""
    of = lambda *e: F.coalesce(F.sum(F.when(F.col("ext").isin(*e), F.col("files"))), F.lit(0))
    d = counts.groupBy("project_id").agg(
        F.sum("files").alias("n"), of(".tf", ".hcl").alias("tf"), of(".yaml", ".yml").alias("yaml"), of(".cs").alias("cs"), of(".py").alias("py"), of(".sh", ".bash").alias("sh"),
        F.greatest(*[of(e) for e in (".py", ".cs", ".ts", ".js", ".go", ".rs")]).alias("most"), F.coalesce(F.bool_or(markers) if markers is not None else F.lit(False), F.lit(False)).alias("markers"),
    )
    kind = F.when(F.col("n") == 0, "code").when(F.col("markers") | (F.col("tf") > 0), "iac")
    kind = kind.when((F.col("yaml") / F.col("n") > 0.5) & (F.col("most") / F.col("n") <= 0.3), "iac").when(F.col("cs") > 0, "dotnet")
    kind = kind.when(F.col("py") / F.col("n") > 0.5, "python").when(F.col("sh") / F.col("n") > 0.5, "shell").otherwise("code")
    return d.select("project_id", kind.alias("profile"))


def infra_markers(files: DataFrame) -> DataFrame:
    """Whether each project_id holds chart, kustomization or manifest files."""
    name = F.element_at(F.split("filepath", "/"), -1)
    head = F.substring("text", 1, 4096)
    manifest = name.rlike(r"\.ya?ml$") & head.contains("kind:") & head.contains("apiVersion:")
    return files.groupBy("project_id").agg(F.bool_or(name.isin("Chart.yaml", "kustomization.yaml", "kustomization.yml") | manifest).alias("infra"))


def source_layout(files: DataFrame) -> DataFrame:
    """source_root of each project_id: its one top directory, or the one with more
    than twice the files of the next, unless the root holds the main ending."""
    d = files.withColumn("ext", extension(F.col("filepath"))).where("ext <> ''").withColumn("top", F.when(F.col("filepath").contains("/"), F.element_at(F.split("filepath", "/"), 1)))
    by_ext = d.groupBy("project_id", "ext").agg(F.count("*").alias("n"), F.sum(F.col("top").isNull().cast("int")).alias("at_root"))
    main = by_ext.groupBy("project_id").agg(F.max_by("at_root", F.struct("n", "ext")).alias("at_root"))
    dirs = d.where("top IS NOT NULL").groupBy("project_id", "top").agg(F.count("*").alias("n"))
    w = W.partitionBy("project_id").orderBy(F.desc("n"), "top")
    best = dirs.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("n").over(w)).where("r = 1")
    alone = (F.col("next").isNull() | (F.col("n") > 2 * F.col("next"))) & (F.col("at_root") == 0)
    return main.join(best, "project_id", "left").select("project_id", F.when(F.coalesce(alone, F.lit(False)), F.col("top")).otherwise(".").alias("source_root"))


def parse_status(status: DataFrame) -> DataFrame:
    """filepath and change of name-status lines; a rename deletes and adds."""
    p = F.split("line", "\t")
    code = F.substring(F.get(p, F.lit(0)), 1, 1)
    rename = F.array(F.struct(F.get(p, F.lit(1)).alias("filepath"), F.lit("deleted").alias("change")), F.struct(F.get(p, F.lit(2)).alias("filepath"), F.lit("modified").alias("change")))
    copy = F.array(F.struct(F.get(p, F.lit(2)).alias("filepath"), F.lit("modified").alias("change")))
    one = F.array(F.struct(F.get(p, F.lit(1)).alias("filepath"), F.when(code == "D", "deleted").otherwise("modified").alias("change")))
    return status.where("line <> ''").select(F.explode(F.when(code == "R", rename).when(code == "C", copy).otherwise(one)).alias("c")).select("c.filepath", "c.change").where("filepath IS NOT NULL").distinct()


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """filepath and change between two snapshots (filepath, text), by content hash."""
    o = old.select("filepath", F.sha2("text", 256).alias("h0"))
    n = new.select("filepath", F.sha2("text", 256).alias("h1"))
    d = o.join(n, "filepath", "full").where("NOT (h0 <=> h1)")
    return d.select("filepath", F.when(F.col("h1").isNull(), "deleted").when(F.col("h0").isNull(), "added").otherwise("modified").alias("change"))
