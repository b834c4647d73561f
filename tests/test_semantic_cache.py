import numpy as np

from lodestone.plans import catalog


def test_similarity_answers_most_probes(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(220, 8))
    x[0::11] *= -1
    label = [i % 10 for i in range(220)]
    spark.createDataFrame([(i, x[i].tolist(), label[i]) for i in range(220)], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = {r.probe_id: (r.value, r.match) for r in catalog.queries()["semantic_cache_lookup"](spark, str(tmp_path)).collect()}
    entries = [i for i in range(220) if label[i] % 2 == 0]
    live = [i for i in entries if i % 3]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for p in range(220):
        same = [i for i in entries if i % 97 == p]
        if same:
            held = [i for i in same if i in live]
            want[p] = (max(held), "exact") if held else (None, "expired")
        else:
            s, v = max((round(float(unit[p] @ unit[i]), 6), i) for i in live)
            want[p] = (v, "semantic") if s >= 0.3 else (None, "miss")
    assert out == want
    assert sum(m == "semantic" for _, m in out.values()) > 100
