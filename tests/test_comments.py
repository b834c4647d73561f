"""Comment stripping in the JVM against a walk over characters."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import compress


def walk(line, mark):
    bare = line.strip()
    if mark in bare and any(m in bare for m in compress.MARKERS):
        return line
    quote, escaped, cut = "", False, -1
    for i, c in enumerate(line):
        if not quote and line.startswith(mark, i):
            cut = i
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = bool(quote)
        elif quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
    if cut < 0:
        return line
    if line.lstrip().startswith(mark):
        return None
    return line[:cut].rstrip() or line


@pytest.mark.parametrize("language", ["python", "go"])
def test_equals_a_walk_over_characters(spark, language):
    rng, mark = random.Random(len(language)), compress.COMMENT[language]
    parts = [mark, mark[0], "'", '"', "\\", "\\'", "x = 1", " ", "\t", "TODO", "it's", "é", "　", "'a'", '"b # // c"', "\r"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(3000)]
    rows += [(9000, "x" * 200_000 + mark), (9001, "'" + "a\\'" * 50_000 + f"' {mark} end"), (9002, f"{mark} '" * 50_000), (9003, '"' * 100_001 + mark)]
    d = spark.createDataFrame(rows, "id long, line string")
    got = {r.id: r.out for r in d.select("id", compress.without_comment(F.col("line"), mark).alias("out")).collect()}
    assert got == {i: walk(x, mark) for i, x in rows}
