import pytest
from pyspark.sql import functions as F

from lodestone.operators import budget, compress, evaluate, fusion, lexical, structural
from lodestone.plans.engine import Engine
from lodestone.plans.profiles import Settings
from lodestone.sources import files
from lodestone.sources.store import BlockStore


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "app").mkdir()
    (root / "tests").mkdir()
    (root / "app" / "auth.py").write_text("def login_user(name):\n    return check_password(name)\n\n\ndef check_password(name):\n    return True\n")
    (root / "app" / "cart.py").write_text("class Cart:\n    def add_item(self, item):\n        self.items.append(item)\n")
    (root / "tests" / "test_auth.py").write_text("def test_login_user():\n    pass\n")
    (root / "notes.md").write_text("def nothing(): pass")
    return str(root)


@pytest.fixture(scope="module")
def engine(spark, tree, tmp_path_factory):
    e = Engine(spark, BlockStore(spark, str(tmp_path_factory.mktemp("store"))), Settings(profile="python", exclude=["**/tests/**"]))
    e.index_tree(tree, "shop")
    return e


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_index_keeps_to_patterns_and_excludes(engine):
    got = {r.id for r in engine.store.read("shop").collect()}
    assert got == {"app/auth.py:login_user:1", "app/auth.py:check_password:5", "app/cart.py:Cart.add_item:2"}


@pytest.mark.parametrize("mode", ["hybrid", "bm25", "ast", "embeddings", "unknown"])
def test_search_modes(spark, engine, mode):
    rows = engine.search(ask(spark, "login_user", "cart add item"), "shop", 2, mode).collect()
    best = {r.query_id: r.function for r in rows if r["rank"] == 1}
    assert best == {0: "login_user", 1: "Cart.add_item"}
    assert all(0 <= r.similarity <= 1 for r in rows) and len(rows) <= 4


def test_vectors_and_guard(spark, engine):
    def embed(d):
        c = F.col("query") if "query" in d.columns else F.col("code")
        has = lambda w: F.when(F.lower(c).contains(w), 1.0).otherwise(0.0).cast("float")
        return d.withColumn("vector", F.array(has("login"), has("cart"), F.lit(0.1).cast("float")))

    e = Engine(spark, engine.store, Settings(profile="python", least_cosine=0.9), embed)
    e.store.upsert(embed(e.store.read("shop").drop("vector")))
    rows = e.search(ask(spark, "login", "zzz qqq"), "shop", 3, "embeddings").collect()
    assert {r.query_id for r in rows if r["rank"] == 1} == {0, 1}
    e.settings.least_cosine = 1.01
    assert e.search(ask(spark, "login"), "shop", 3, "embeddings").count() == 0
    assert e.search(ask(spark, "login"), "shop", 3, "embeddings", guard=False).count() == 3


def test_assemble_route_orchestrate(spark, engine):
    text = engine.assemble(ask(spark, "login user"), "shop").first()
    assert "login_user" in text.context and text.tokens >= 1
    engine.store.upsert(spark.createDataFrame([("b.py:zebra:1", "b.py", "zebra", "zebra crossing", 1, 2, "zoo")], "id string, filepath string, function string, code string, line_start int, line_end int, project_id string"))
    won = {r.query_id: r.project_id for r in engine.route(ask(spark, "zebra", "login user")).collect()}
    assert won == {0: "zoo", 1: "shop"}
    work = spark.createDataFrame([(1, "x" * 100, True), (2, "x" * 100_000, True), (3, "x" * 200_000, True), (4, "x", False)], "key long, text string, has_instruction boolean")
    plan = {r.key: (r.work_class, r.chunks) for r in engine.orchestrate(work, lambda d: d).collect()}
    assert plan == {1: ("local_one_shot", None), 2: ("local_map_reduce", 6), 3: ("defer_to_cloud", None), 4: ("context_only", None)}
    assert {r.work_class for r in engine.orchestrate(work).collect()} == {"context_only"}
    with pytest.raises(KeyError):
        Engine(spark, engine.store).set_profile("none")


def test_structural_prefers_names(spark):
    blocks = spark.createDataFrame([("1", "resource.aws_iam_role.this", 'resource "aws_iam_role" "this" {}'), ("2", "variable.region", "default = aws_iam_role.this.arn"), ("3", "output.x", "value = 1")], "id string, name string, text string")
    rows = structural.structural(blocks, ask(spark, "aws iam role")).orderBy("rank").collect()
    assert [r.id for r in rows] == ["1", "2"]


def test_bm25_fills_and_takes_nothing(spark):
    docs = spark.createDataFrame([("a", "red fox"), ("b", "red red wine"), ("c", None)], "id string, text string")
    rows = lexical.bm25(docs, ask(spark, "red", "zebra"), 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in rows] == [(0, "b"), (0, "a"), (0, "c"), (1, "a"), (1, "b"), (1, "c")]
    assert lexical.bm25(docs.limit(0), ask(spark, "red"), 3).count() == 0


def test_minmax_and_rerank(spark):
    hits = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.25), (0, "c", 0.0), (1, "x", 0.1)], "query_id long, id string, score double")
    out = {(r.query_id, r.id): r.similarity for r in fusion.minmax(hits).collect()}
    assert out == {(0, "a"): 1.0, (0, "b"): 0.5, (0, "c"): 0.0, (1, "x"): 1.0}
    flipped = fusion.rerank(fusion.minmax(hits), 1, lambda d: d.withColumn("rerank_score", -F.col("score"))).collect()
    assert {r.id for r in flipped} == {"c", "x"}
    assert fusion.rerank(fusion.minmax(hits), 1).count() == 2


def test_eval_matches_suffixes(spark):
    hits = spark.createDataFrame([(0, 1, "x/a.py:f:1"), (0, 2, "b.py:g:9"), (1, 1, "q")], "query_id long, rank int, id string")
    gold = spark.createDataFrame([(0, "a.py:f:7"), (0, "z"), (1, "w")], "query_id long, gold string")
    out = {r.query_id: (r.recall, r.mrr) for r in evaluate.per_query(hits, gold).collect()}
    assert out == {0: (0.5, 1.0), 1: (0.0, 0.0)}


def test_compression_stages(spark):
    code = "import os\nimport sys\n\n\n\n\ndef f():\n    x = '# kept'  # gone\n    # TODO stay\n    # all gone\n    return x\n\x1b[31mred\x1b[0m\n# Title\n"
    d = spark.createDataFrame([("a", code), ("b", None)], "id string, text string")
    out = {r.id: r.compressed for r in compress.compress(d).collect()}
    assert out["a"] == "# [imports removed - see repo map]\n\ndef f():\n    x = '# kept'\n    # TODO stay\n    return x\nred"
    kept = {r.id: r.compressed for r in compress.compress(d, headers=True).collect()}
    assert kept["a"] == out["a"] + "\n# Title"
    assert out["b"] == ""
    assert compress.compress(d, "none").where("id = 'a'").first().compressed == code
    long = "def g():\n" + "\n".join(f"    step_{chr(97 + i)}()" for i in range(20)) + "\nend = 1\nend = 2"
    cut = compress.compress(spark.createDataFrame([("c", long)], "id string, text string"), "aggressive").first()
    assert cut.compressed.split("\n")[5] == "    # ... (11 lines omitted) ..." and cut.compressed.endswith("end = 1\n    # [duplicate pattern (1)]")
    assert "truncate_functions" in cut.strategies and cut.reduction_pct > 0


def test_tree_reduce(spark):
    parts = spark.createDataFrame([(1, i, 25, "w" * 100) for i in range(9)] + [(2, 0, 1, "solo")], "key long, seq long, tokens long, text string")
    reduce = lambda d: d.select("key", F.col("batch").alias("seq"), F.lit(10).cast("long").alias("tokens"), F.substring("text", 1, 40).alias("text"))
    assert {r.key: r.text for r in budget.tree_reduce(parts, reduce, 60).collect()} == {1: "w" * 40, 2: "solo"}


@pytest.mark.parametrize("pattern, path, hit", [("**/tests/**", "a/tests/x.py", True), ("tests/**", "b/tests/x", True), ("app/secret/**", "app/secret/k", True), ("app/secret/**", "x/app/secret/k", False), ("**/app/secret/**", "x/app/secret/k", True), ("*.pyc", "a/b.pyc", True), ("*.pyc", "a/b.py", False), ("app/*.js", "x/app/m.js", True), ("[ab]?", "x/a1", True), ("tests", "contests/x", False)])
def test_exclude_patterns(spark, pattern, path, hit):
    assert spark.createDataFrame([(path,)], "p string").select(files.excluded(F.col("p"), [pattern])).first()[0] is hit
