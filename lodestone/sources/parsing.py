"""Source text to blocks: functions, classes and their methods.

Files are parsed in Arrow batches, one row a file, and exploded to one row a
block. YAML documents need no parser and stay in SQL.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window as W

from lodestone.schemas import FILE

from .files import language

#: What begins a function or a class on a line, by language.
PATTERNS: dict[str, tuple[str | None, str | None]] = {
    "python": (r"^\s*(?:async\s+)?def\s+(\w+)\s*\(", r"^\s*class\s+(\w+)\s*[(:]"),
    "javascript": (r"(?:function\s+(\w+)\s*\(|(\w+)\s*=\s*(?:async\s+)?\(|(\w+)\s*=\s*function)", r"class\s+(\w+)\s*(?:extends\s+\w+\s*)?\{"),
    "typescript": (r"(?:function\s+(\w+)\s*\(|(\w+)\s*=\s*(?:async\s+)?\(|(\w+)\s*=\s*function)", r"class\s+(\w+)\s*(?:extends\s+\w+\s*)?(?:implements\s+[\w,\s]+)?\{"),
    "rust": (r"^\s*(?:pub\s+(?:async\s+)?)?fn\s+(\w+)\s*[<(]", r"^\s*(?:pub\s+)?(?:struct|enum|trait|impl)\s+(\w+)"),
    "go": (r"^\s*func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\s*\(", r"^\s*type\s+(\w+)\s+struct\s*\{"),
    "java": (r"^\s*(?:public\s+|private\s+|protected\s+|static\s+)*(?:void|int|String|boolean|List|Map|[\w<>[\],\s]+)\s+(\w+)\s*\(", r"^\s*(?:public\s+|private\s+)?(?:abstract\s+)?class\s+(\w+)"),
    "ruby": (r"^\s*def\s+(?:self\.)?(\w+)", r"^\s*class\s+(\w+)\s*(?:<\s+\w+)?"),
    "cpp": (r"^\s*(?:virtual\s+)?(?:void|int|char|bool|float|double|auto|[\w:*&<>,\s]+)\s+(\w+)\s*\(", r"^\s*class\s+(\w+)\s*(?::\s*public\s+\w+)?\s*\{"),
    "json": (r'^\s*"(\w+)"\s*:', None),
    "toml": (r"^\s*\[(\w[\w.-]*)\]", None),
}
MOST_CODE, MOST_REGEX_CODE = 100_000, 10_000
Row = dict


def _row(name: str, lines: list[str], start: int, end: int) -> Row:
    return {"name": name, "line_start": start + 1, "line_end": end + 1, "code": "\n".join(lines[start : end + 1]).strip()}


def parse_python(code: str) -> tuple[list[Row], list[Row]]:
    """Definitions inside a class are its methods, at any depth below it but not
    inside a further class; other definitions are functions."""
    lines = code.split("\n")
    functions, classes = [], []

    def visit(node, owner) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                (functions if owner is None else owner["methods"]).append(_row(child.name, lines, child.lineno - 1, child.end_lineno - 1))
                visit(child, owner)
            elif isinstance(child, ast.ClassDef):
                own = _row(child.name, lines, child.lineno - 1, child.end_lineno - 1) | {"methods": []}
                classes.append(own)
                visit(child, own)
            else:
                visit(child, owner)

    visit(ast.parse(code), None)
    return functions, classes


def block_end(lines: list[str], start: int) -> int:
    """The last line of the block that a line opens: by braces, else by indent."""
    if "{" in lines[start]:
        depth = 0
        for i in range(start, len(lines)):
            depth += lines[i].count("{") - lines[i].count("}")
            if depth == 0 and i > start:
                return i
        return len(lines) - 1
    indent = lambda s: len(s) - len(s.lstrip())
    base, i = indent(lines[start]), start + 1
    while i < len(lines) and (not lines[i].strip() or indent(lines[i]) > base or lines[i].lstrip().startswith(("#", "//"))):
        i += 1
    return i - 1


def parse_patterns(code: str, lang: str) -> tuple[list[Row], list[Row]]:
    lines = code.split("\n")

    def found(pattern: str | None) -> list[Row]:
        out = []
        for i, line in enumerate(lines) if pattern else ():
            if m := re.search(pattern, line):
                name = next((g for g in m.groups() if g), (m.group().split() or ["<unknown>"])[-1]).strip()
                row = _row(name, lines, i, block_end(lines, i))
                if len(row["code"]) < MOST_REGEX_CODE:
                    out.append(row)
        return out

    function, klass = PATTERNS.get(lang, (None, None))
    return found(function), [r | {"methods": []} for r in found(klass)]


def _mask(code: str, line_comments: tuple[str, ...], block: bool) -> str:
    """The code with the inside of strings and comments blanked, same length."""
    out, i, n = list(code), 0, len(code)
    while i < n:
        if any(code.startswith(c, i) for c in line_comments):
            end = code.find("\n", i)
        elif block and code.startswith("/*", i):
            end = code.find("*/", i + 2)
            end = end + 2 if end >= 0 else -1
        elif code[i] in "\"'":
            end = i + 1
            while end < n and code[end] != code[i] and code[end] != "\n":
                end += 2 if code[end] == "\\" else 1
            out[i + 1 : min(end, n)] = [c if c == "\n" else " " for c in code[i + 1 : min(end, n)]]
            i = end + 1
            continue
        else:
            i += 1
            continue
        end = n if end < 0 else end
        out[i:end] = [c if c == "\n" else " " for c in code[i:end]]
        i = end
    return "".join(out)


def _close(masked: str, at: int) -> int:
    """Where the brace at ``at`` closes."""
    depth = 0
    for i in range(at, len(masked)):
        depth += {"{": 1, "}": -1}.get(masked[i], 0)
        if depth == 0:
            return i
    return len(masked) - 1


def parse_hcl(code: str) -> tuple[list[Row], list[Row]]:
    """Blocks and the blocks inside them, named by their type and labels."""
    masked, lines, out = _mask(code, ("#", "//"), True), code.split("\n"), []
    for m in re.finditer(r'(?m)^[ \t]*([A-Za-z_][\w-]*)((?:[ \t]+(?:"[^"\n]*"|[A-Za-z_][\w-]*))*)[ \t]*\{', masked):
        head = code[m.start(2) : m.end(2)]
        name = ".".join([m[1], *(a or b for a, b in re.findall(r'"([^"]*)"|([A-Za-z_][\w-]*)', head))])
        row = _row(name, lines, code.count("\n", 0, m.start(1)), code.count("\n", 0, _close(masked, m.end() - 1)))
        if len(row["code"]) < MOST_CODE:
            out.append(row)
    return out, []


def parse_csharp(code: str) -> tuple[list[Row], list[Row]]:
    masked, lines, classes = _mask(code, ("//",), True), code.split("\n"), []
    line = lambda at: code.count("\n", 0, at)

    def whole(at: int) -> int | None:  # the end of a body, or of a declaration without one
        m = re.compile(r"[^{;]*?([{;]|=>)").match(masked, at)
        return None if not m else _close(masked, m.end() - 1) if m[1] == "{" else masked.find(";", m.start(1)) if m[1] == "=>" else m.end() - 1

    for m in re.finditer(r"(?m)^[ \t]*(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|ref|file|unsafe|new)\s+)*(class|interface|struct|record)(?:\s+(?:class|struct))?\s+(\w+)", masked):
        end = whole(m.end())
        if end is None or end < 0:
            continue
        own = _row(m[2], lines, line(m.start() + len(m.group()) - len(m.group().lstrip())), line(end)) | {"methods": []}
        declared = r"(?m)(?:^|(?<=[{};]))[ \t]*(?:\[[^\]\n]*\]\s*)*(?:(?:public|private|protected|internal|static|async|virtual|override|sealed|abstract|partial|extern|unsafe|new)\s+)*(?!(?:public|private|protected|internal|static|virtual|override|sealed|abstract|partial|extern|return|new|else|throw|await|using|if|while|for|foreach|switch|lock|catch|class|struct|record|interface|case|yield|var)\b)[\w.]+(?:<[^(){};=]*?>)?(?:\[\])*\??\s+(?:[\w.]+\.)?(\w+)\s*(?:<[^(){};]*?>)?\s*\("
        for f in re.compile(declared).finditer(masked, m.end(), end):
            depth, at = 0, f.end() - 1
            while at < end:
                depth += {"(": 1, ")": -1}.get(masked[at], 0)
                at += 1
                if depth == 0:
                    break
            after = re.compile(r"\s*(?:where[^{;]*)?(\{|=>|;)").match(masked, at)
            stop = whole(at) if after else None
            if stop is not None and 0 <= stop <= end:
                row = _row(f[1], lines, line(f.start() + len(f.group()) - len(f.group().lstrip())), line(stop))
                if len(row["code"]) < MOST_CODE:
                    own["methods"].append(row)
        if len(own["code"]) < MOST_CODE:
            classes.append(own)
    return [], classes


def parse_bash(code: str) -> tuple[list[Row], list[Row]]:
    masked, lines, out = _mask(code, ("#",), False), code.split("\n"), []
    for m in re.finditer(r"(?m)^[ \t]*(?:function[ \t]+([\w:.-]+)[ \t]*(?:\(\s*\))?|([\w:.-]+)[ \t]*\(\s*\))\s*\{", masked):
        row = _row(m[1] or m[2], lines, code.count("\n", 0, m.start(1) if m[1] else m.start(2)), code.count("\n", 0, _close(masked, m.end() - 1)))
        if len(row["code"]) < MOST_CODE:
            out.append(row)
    return out, []


def parse_yaml(code: str) -> tuple[list[Row], list[Row]]:
    """Documents, named by kind and name."""
    out, at = [], 0
    for doc in code.split("\n---\n"):
        own = doc.split("\n")
        kind = name = None
        for i, line in enumerate(own):
            if line.strip().startswith("kind:"):
                kind = line.split(":", 1)[1].strip()
            elif "metadata:" in line:
                name = next((x.split(":", 1)[1].strip() for x in own[i + 1 : i + 5] if x.strip().startswith("name:")), name)
        label = f"{kind}.{name}" if kind and name else (kind or own[0][:30])
        if doc.strip() and len(doc) < MOST_CODE:
            out.append({"name": label, "line_start": at + 1, "line_end": at + len(own), "code": doc.strip()})
        at += len(own) + 1
    return out, []


PARSERS = {"hcl": parse_hcl, "csharp": parse_csharp, "bash": parse_bash, "yaml": parse_yaml}


def parse(code: str, lang: str) -> tuple[list[Row], list[Row]]:
    """(functions, classes) of a text; Python that does not parse goes by patterns."""
    code = code.lstrip("﻿")
    if lang == "python":
        try:
            return parse_python(code)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return parse_patterns(code, lang)
    return PARSERS[lang](code) if lang in PARSERS else parse_patterns(code, lang)


def parse_files(files: DataFrame, most_kb: int = 0) -> DataFrame:
    """A row of functions and classes for each file (filepath, text).

    A file that is too large or fails has an error and no blocks; how long one
    takes makes no difference, so results do not depend on the machine.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for path, text, lang in pdf[["filepath", "text", "lang"]].itertuples(index=False):
                functions, classes, error = [], [], None
                if text is None:
                    error = "unreadable"
                elif most_kb and len(text.encode()) > most_kb * 1024:
                    error = "too large"
                else:
                    try:
                        functions, classes = parse(text, lang)
                    except Exception as e:  # a bad file must not end the job
                        error = f"{type(e).__name__}: {e}"[:200]
                out.append((path, functions, classes, error))
            yield pd.DataFrame(out, columns=["filepath", "functions", "classes", "error"])

    return files.select("filepath", "text", language(F.col("filepath")).alias("lang")).mapInPandas(run, FILE)


#: Goes up when parsers give other results; part of the key of what is kept.
PARSER_VERSION = 1


def parse_unseen(files: DataFrame, kept: str, most_kb: int = 0) -> tuple[DataFrame, int]:
    """What ``parse_files`` gives, and how many texts had to be parsed for it.

    Results are kept in the folder ``kept`` by a hash of text and language, so
    versions, projects and copies of a file share them; only texts that no earlier
    call has seen are parsed, each once. The parsed files (filepath, text, ..) are
    those given; what they look like is read from the folder.
    """
    spark = files.sparkSession
    lang = language(F.col("filepath"))
    key = F.sha2(F.concat_ws("|", F.lit(str(PARSER_VERSION)), F.lit(str(most_kb)), lang, F.when(F.col("text").isNull(), "unreadable").otherwise(F.concat(F.lit("text|"), "text"))), 256)
    keyed = files.select("filepath", "text", lang.alias("lang"), key.alias("key")).persist()
    kind = StructType([StructField("key", StringType()), *[f for f in FILE if f.name != "filepath"]])
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept)
    known = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    held = lambda: spark.read.schema(kind).parquet(kept)
    try:
        new = keyed.groupBy("key").agg(F.min_by(F.struct("filepath", "text"), "filepath").alias("x")).select("key", "x.filepath", "x.text")
        if known:
            new = new.join(held().select("key"), "key", "left_anti")
        new = new.persist()
        count = new.count()
        if count or not known:
            # the key goes along in the path
            done = parse_files(new.select(F.concat_ws("/", "key", "filepath").alias("filepath"), "text"), most_kb)
            done.withColumn("key", F.substring("filepath", 1, 64)).select(*kind.names).write.mode("append").parquet(kept)
        new.unpersist()
        # two that parse the same at once may both keep it
        once = held().dropDuplicates(["key"])
        return files.select("filepath", key.alias("key")).join(once, "key").select(*FILE.names), count
    finally:
        keyed.unpersist()


def blocks(parsed: DataFrame) -> DataFrame:
    """One row a block: functions, then methods as Class.method; ``method`` tells which."""
    f = parsed.select("filepath", F.explode("functions").alias("f"), F.lit(False).alias("method"))
    m = parsed.select("filepath", F.explode("classes").alias("c")).select("filepath", F.col("c.name").alias("cls"), F.explode("c.methods").alias("f"))
    m = m.select("filepath", F.struct(F.concat_ws(".", "cls", "f.name").alias("name"), "f.line_start", "f.line_end", "f.code").alias("f"), F.lit(True).alias("method"))
    d = f.unionByName(m)
    return d.select(F.concat_ws(":", "filepath", "f.name", F.col("f.line_start").cast("string")).alias("id"), "filepath", F.col("f.name").alias("function"), F.col("f.code").alias("code"), "f.line_start", "f.line_end", "method")


def repo_map(parsed: DataFrame) -> DataFrame:
    """filepath and the names it defines, in one string."""
    names = F.concat(F.transform("functions", lambda f: f["name"]), F.transform("classes", lambda c: c["name"]))
    return parsed.select("filepath", F.array_join(names, ", ").alias("names"))


def yaml_documents(files: DataFrame, separator: str = "\n---\n") -> DataFrame:
    """Documents of each file with their lines, without a parser."""
    d = files.select("filepath", F.posexplode(F.split("text", separator)).alias("pos", "doc"))
    n = F.size(F.split("doc", "\n"))
    before = F.coalesce(F.sum(n + 1).over(W.partitionBy("filepath").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kind: Column = F.regexp_extract("doc", r"(?m)^\s*kind:\s*(\S+)", 1)
    d = d.withColumn("line_start", (before + 1).cast("long")).withColumn("line_end", (before + n).cast("long"))
    return d.where(F.trim(F.regexp_replace("doc", r"\s", "")) != "").select("filepath", "pos", F.when(kind != "", kind).otherwise(F.substring(F.get(F.split("doc", "\n"), F.lit(0)), 1, 30)).alias("name"), "line_start", "line_end", F.length("doc").alias("chars"))
