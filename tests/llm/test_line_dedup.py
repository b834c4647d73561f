from lodestone.llm import line_dedup as L

SCHEMA = "doc_id long, text string, source string, h string, n_lines string"


def brute(rows, least):
    sites = {}
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            k = line.strip(" \t\r\x0b\x0c")
            if k and s is not None:
                sites.setdefault(k, set()).add(s)
    bad = {k for k, v in sites.items() if len(v) >= least}
    out = []
    for i, t, _ in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for x in lines if x.strip(" \t\r\x0b\x0c") not in bad]
        out.append((i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def rows():
    out = []
    for i in range(60):
        lines = [f"own {i}", "everywhere", f"shared by {i % 4}", "", f"near {i % 12}" if i < 36 else "x"]
        out.append((i, "\n".join(lines), f"site{i % 20}" if i % 13 else None))
    out += [(100, None, "site1"), (101, "", "site2"), (102, "everywhere", "site3"), (103, " everywhere \r\n\teverywhere", "site4"), (104, "y" * 100_000 + "\neverywhere", "site5")]
    return out + [out[0], out[0], (None, "everywhere\nmine", "site6")]


def test_matches_brute_force(spark):
    for least in (2, 3, 5, 10):
        d = spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows()], SCHEMA)
        out = L.remove_boilerplate(spark, d, least)
        assert out.columns == ["doc_id", "text", "source", "h", "n_lines", "n_removed"]
        assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str) == brute(rows(), least)


def test_empty_table(spark):
    assert L.remove_boilerplate(spark, spark.createDataFrame([], SCHEMA)).count() == 0
