from lodestone.sources import parsing as P

PY = '''import os

def top(a):
    def inner():
        return 1
    return inner

class Box:
    x = 1

    async def put(self):
        class Deep:
            def last(self):
                pass

    @property
    def get(self):
        return 2
'''
TF = '''# resource "no" "no" {
resource "aws_iam_role" "this" {
  name = "a{b"
  assume {
    x = 1
  }
}
variable "v" {}
'''
CS = '''namespace A {
  public class Mediator : IMediator {
    private readonly int _x = 1;
    public Mediator(int x) { _x = x; }
    public async Task<Response<T>> Send<T>(Request r, int n = 1) where T : class
    {
      if (r == null) { return Foo(); }
      return new Thing(r);
    }
    public int Twice(int a) => a * 2;
    public interface INested { void Go(string s); }
  }
}
'''
SH = '''#!/bin/bash
deploy() {
  echo "}"
}
function clean {
  rm -f x
}
'''
YML = "apiVersion: v1\nkind: Service\nmetadata:\n  name: web\n---\nkind: Secret\n---\nplain: 1\n"


def names(rows):
    return [r["name"] for r in rows]


def test_python_definitions():
    functions, classes = P.parse(PY, "python")
    assert names(functions) == ["top", "inner"]
    by = {c["name"]: c for c in classes}
    assert names(by["Box"]["methods"]) == ["put", "get"] and names(by["Deep"]["methods"]) == ["last"]
    assert (functions[0]["line_start"], functions[0]["line_end"]) == (3, 6)


def test_python_that_does_not_parse_goes_by_patterns():
    functions, classes = P.parse("def broken(:\n    x = 1\n\nclass A(\n", "python")
    assert names(functions) == ["broken"] and names(classes) == ["A"]


def test_hcl_blocks_and_those_inside():
    functions, _ = P.parse(TF, "hcl")
    assert names(functions) == ["resource.aws_iam_role.this", "assume", "variable.v"]
    assert (functions[0]["line_start"], functions[0]["line_end"]) == (2, 7)


def test_csharp_types_and_methods():
    _, classes = P.parse("﻿" + CS, "csharp")
    by = {c["name"]: c for c in classes}
    assert names(by["Mediator"]["methods"]) == ["Send", "Twice", "Go"]
    assert names(by["INested"]["methods"]) == ["Go"]


def test_bash_functions():
    functions, _ = P.parse(SH, "bash")
    assert names(functions) == ["deploy", "clean"]
    assert (functions[0]["line_start"], functions[0]["line_end"]) == (2, 4)


def test_yaml_documents_and_lines(spark):
    functions, _ = P.parse(YML, "yaml")
    assert names(functions) == ["Service.web", "Secret", "plain: 1"]
    assert [(f["line_start"], f["line_end"]) for f in functions] == [(1, 4), (6, 6), (8, 9)]
    out = P.yaml_documents(spark.createDataFrame([("a.yaml", YML)], "filepath string, text string")).orderBy("pos").collect()
    assert [(r.line_start, r.line_end) for r in out] == [(1, 4), (6, 6), (8, 9)]


def test_patterns_of_other_languages():
    js, _ = P.parse("function a(x) {\n  if (x) { y }\n}\nconst b = async (z) => {\n  return z\n}\n", "javascript")
    assert [(f["name"], f["line_start"], f["line_end"]) for f in js] == [("a", 1, 3), ("b", 4, 6)]
    go, kinds = P.parse("type T struct {\n  x int\n}\nfunc (t *T) Do(a int) {\n}\n", "go")
    assert names(go) == ["Do"] and names(kinds) == ["T"]
    assert names(P.parse("[tool.x]\na = 1\n", "toml")[0]) == ["tool.x"]
    assert P.parse("anything", "unknown") == ([], [])


def test_files_to_blocks(spark):
    d = spark.createDataFrame([("a.py", PY), ("b.tf", TF), ("c.py", None), ("d.py", "x = 1\n" * 400)], "filepath string, text string")
    parsed = P.parse_files(d, most_kb=1).cache()
    errors = {r.filepath: r.error for r in parsed.collect()}
    assert errors == {"a.py": None, "b.tf": None, "c.py": "unreadable", "d.py": "too large"}
    got = {r.id for r in P.blocks(parsed).collect()}
    assert {"a.py:top:3", "a.py:Box.put:11", "b.tf:variable.v:8"} <= got and len(got) == 8
    assert {r.filepath: r.names for r in P.repo_map(parsed).collect()}["a.py"] == "top, inner, Box, Deep"
