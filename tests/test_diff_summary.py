from lodestone.plans import catalog


def test_all_lines_count(spark, tmp_path):
    rows = [(1, "\n".join("x" * n for n in range(1, 13))), (2, "\n".join(["abc"] * 7 + ["abcd", "abcde"])), (3, "")]
    spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.id: r.summary for r in catalog.queries()["diff_summary"](spark, str(tmp_path)).collect()}
    want = {}
    for i, t in rows:
        names = sorted({f"src/{len(x)}" + (".md", "_test.py", ".yaml")[len(x) % 3] for x in t.split("\n")})
        hints = [h for h, end in (("tests", "_test.py"), ("documentation", ".md"), ("config", ".yaml")) if any(n.endswith(end) for n in names)]
        want[i] = f"Modified {' + '.join(hints)}: {'; '.join(names[:5])}" + (f"; +{len(names) - 5} more" if len(names) > 5 else "")
    assert out == want and out[1].endswith("+7 more")
