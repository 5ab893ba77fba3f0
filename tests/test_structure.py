import pytest
from pyspark.sql import functions as F

from skein.functions.paths import MANIFESTS, is_entrypoint, is_generated
from skein.operators import graph, overview, read, structure
from skein.sources import tree

PY = '''"""Doc."""
import os
from .util import helper

LIMIT = 3

class A(Base):
    """An A."""
    def run(self):
        return helper(os.getcwd())

    def stop(self):
        self.run()

@cached
def main():
    A().run()
'''
RS = """use crate::util::helper;

/// Runs it.
pub fn run(x: u32) -> u32 {
    helper(x)
}

impl Widget {
    fn draw(&self) {
        run(1);
    }
}
"""
TREE = [("app/main.py", PY), ("app/util.py", "def helper(x):\n    return x\n"), ("app/pyproject.toml", ""), ("lib/src/run.rs", RS), ("lib/src/util.rs", "pub fn helper(x: u32) -> u32 { x }\n"), ("lib/Cargo.toml", ""), ("web/a.js", "export const go = 1;\nconst b = require('./b');\n"), ("web/b.js", "module.exports.x = 1\n")]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(TREE, "path string, content string").cache()


@pytest.fixture(scope="module")
def s(files):
    return structure.structure(files).cache()


def test_symbols(s):
    got = {(r["path"], r["name"]): (r["kind"], r["line"], r["end_line"], r["weight"]) for r in structure.symbols(s).collect()}
    assert got[("app/main.py", "A")] == ("class_definition", 7, 13, 100)
    assert got[("app/main.py", "main")][:2] == ("decorated_definition", 15)
    assert got[("app/main.py", "LIMIT")] == ("variable_declaration", 5, 5, 40)
    assert got[("lib/src/run.rs", "run")] == ("function_item", 4, 6, 100)
    assert got[("lib/src/run.rs", "Widget")] == ("impl_item", 8, 12, 90)


def test_outline_is_nested(s):
    rows = {r["name"]: r for r in structure.outline(s).where("path = 'lib/src/run.rs'").collect()}
    assert rows["draw"]["parent_id"] == rows["Widget"]["entry_id"] and rows["draw"]["depth"] == 1 and rows["run"]["doc"] == "Runs it."
    lines = list(structure.outline_tree([r.asDict() for r in sorted(rows.values(), key=lambda r: r["entry_id"])]))
    assert lines[0].startswith("[4-6] pub fn run") and lines[-1].startswith("  [9-11]")


def test_imports_resolve(s, files):
    r = structure.resolve_imports(structure.imports(s), files.select("path"))
    got = {(x["path"], x["spec"]): x["resolved"] for x in r.collect()}
    assert got[("app/main.py", ".util")] == "app/util.py" and got[("app/main.py", "os")] is None
    assert got[("web/a.js", "./b")] == "web/b.js"
    assert [x["path"] for x in structure.dependents(r, "app/util.py").collect()] == ["app/main.py"]


def test_enclosing(spark, s):
    points = spark.createDataFrame([("app/main.py", 10), ("app/main.py", 7), ("app/main.py", 2)], "path string, line int")
    got = {r["line"]: r["enclosing"] for r in structure.enclosing(points, structure.outline(s)).collect()}
    assert got == {10: "run", 7: "A", 2: None}


def test_siblings_and_roots(s, files):
    assert [r["name"] for r in structure.siblings(structure.outline(s), "run").where("path = 'app/main.py'").collect()] == ["stop"]
    roots = {r["path"]: r["root"] for r in structure.package_roots(files.select("path"), MANIFESTS).collect()}
    assert roots["app/main.py"] == "app" and roots["lib/src/run.rs"] == "lib" and "web/a.js" not in roots


def test_calls_and_graph(spark, s, files):
    syms, calls = structure.symbols(s), structure.calls(s)
    assert {(r["callee"], r["path"]) for r in graph.callees(calls, syms, "run").collect()} == {("helper", "app/util.py"), ("helper", "lib/src/util.rs")}
    deep = {r["callee"]: r["depth"] for r in graph.callees_within(calls, syms, "main", 3).collect()}
    assert deep == {"A": 1, "run": 1, "helper": 2}
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("p", "text")).select("path", (F.col("p") + 1).alias("line"), "text")
    tokens = lines.select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w*"), F.lit(0)))).alias("token"))
    code = structure.outline(s).where("kind not like 'variable%'")
    hits = graph.callers(tokens, syms, code, "helper", hops=2)
    got = {(r["path"], r["line"]): (r["depth"], r["caller"]) for r in hits.collect()}
    assert got[("app/main.py", 10)] == (1, "run") and got[("lib/src/run.rs", 5)] == (1, "run") and got[("lib/src/run.rs", 10)] == (2, "draw")
    assert got[("app/main.py", 17)] == (2, "main")
    guarded = graph.callers(tokens, syms, code, "helper", hops=3, hub_guard=0)
    assert {r["depth"] for r in guarded.collect()} == {1}
    roots = structure.package_roots(files.select("path"), MANIFESTS)
    assert [r["name"] for r in graph.suspicious(syms, roots).orderBy("name").collect()] == ["helper", "run"]
    imp = graph.impact(hits, None, syms.where("name = 'helper'"))
    assert [(r["path"], r["score"], r["reasons"]) for r in imp.collect()][0][1] >= 7
    assert {r["key"]: r["n"] for r in graph.count_by(hits, "package").collect()} == {"app": 4, "lib/src": 3}


def test_anchors_and_subclasses(spark):
    assert structure.export_anchors("export const go = 1;\nexport { a as b, c };\nexports.x = 1\n") == [(1, "go"), (2, "b"), (2, "c"), (3, "x")]
    lines = spark.createDataFrame([("class B(A):",), ("class C:",), ("x(A)",)], "text string")
    assert [r["text"] for r in structure.subclass_lines(lines, "A").collect()] == ["class B(A):"]


def test_overview(files):
    t = {r["dir"]: (r["file_count"], r["bytes"]) for r in overview.tree(files).collect()}
    assert t[""][0] == len(TREE) and t["lib/src"] == (2, len(RS) + len(TREE[4][1]))
    assert [r["path"] for r in overview.key_files(files).orderBy("path").collect()] == ["app/main.py", "app/pyproject.toml", "lib/Cargo.toml"]
    stats = {r["lang"]: r["files"] for r in overview.language_stats(files).collect()}
    assert stats["python"] == 2 and stats["rust"] == 2
    assert overview.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    f = files.select("path", F.length("content").alias("size"), F.lit(1).alias("modified"))
    assert overview.fingerprint(f) == overview.fingerprint(f.repartition(3)) != overview.fingerprint(f.where("path != 'web/a.js'"))
    assert overview.footer(10, 10, 25) == "[11-20 of 25] — next: --offset 20" and overview.footer(20, 5, 25) == "[21-25 of 25]"


def test_generated_and_entry(spark):
    df = spark.createDataFrame([("a/yarn.lock", ""), ("x.min.js", ""), ("b.py", "# DO NOT EDIT"), ("c.py", "x")], "p string, c string")
    assert [r[0] for r in df.select(is_generated(F.col("p"), F.col("c"))).collect()] == [True, True, True, False]
    e = spark.createDataFrame([("index.ts",), ("a/b/index.ts",), ("src/x/index.ts",), ("z/main.go",)], "p string")
    assert [r[0] for r in e.select(is_entrypoint(F.col("p"))).collect()] == [True, False, True, True]


def test_reading(files):
    assert read.section("a\r\nb\nc", 2, 1) == "b" and read.section("a\nb\nc", 0, 2) == "a\nb"
    assert read.cascade("x" * 50, "y" * 20, "z", 30) == ("outline", "y" * 20)
    assert read.resolve_name(files, "MAIN.py") == ["app/main.py"]
    r = read.resolve_mention(files, read.Trigger(0, 3, "app/main.py", False, (2, 3)), 1000)
    assert r["text"] == "import os\nfrom .util import helper" and r["kind"] == "file"
    assert read.resolve_mention(files, read.Trigger(0, 3, "web"), 1000)["entries"] == ["web/a.js", "web/b.js"]
    assert read.stream_lines(["a", "", "b"], lambda x: x or None, str.upper) == ["A", "B"]


@pytest.mark.parametrize(
    "text,cursor,want",
    [("see @src/a", 10, ("src/a", False, None)), ("a@b.com", 7, None), ("@f#L10-20", 9, ("f", False, (10, 20))), ("@f#L7", 5, ("f", False, (7, 7))), ("(@x", 3, ("x", False, None)), ("@a b", 4, None), ("\\@x", 3, None), ("", 0, None)],
)
def test_triggers(text, cursor, want):
    t = read.detect_trigger(text, cursor)
    assert (t and (t.query, t.quoted, t.line_range)) == want


def test_walk_and_index(spark, tmp_path):
    root = tmp_path / "repo"
    for p, c in {"a.py": "﻿def f():\n    pass\n", ".hidden/x.py": "x", "node_modules/m.js": "m", "img.png": "x", "logs/a.log": "l", "logs/keep.log": "k", ".git/config": "c", "b.bin2": "a\0b"}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(c)
    rules = tree.ignore_regex("logs/*\n!logs/keep.log\n# c\n")
    git = {r["path"]: r for r in tree.walk(spark, str(root), True, rules).collect()}
    assert set(git) == {"a.py", ".hidden/x.py", "node_modules/m.js", "img.png", "logs/keep.log", "b.bin2"} and git["a.py"]["content"].startswith("def") and git["b.bin2"]["is_binary"]
    plain = tree.walk(spark, str(root), False)
    assert {r["path"] for r in plain.select("path").collect()} == {"a.py", "logs/a.log", "logs/keep.log", "b.bin2"}
    where = str(tmp_path / "index")
    tree.save_index(plain, where, "h1")
    saved = tree.load_index(spark, where, "h1", 4)
    assert saved and tree.load_index(spark, where, "h2", 4) is None and tree.load_index(spark, where, "h1", 100) is None and tree.load_index(spark, where + "x") is None
    (root / "a.py").write_text("def g(): pass\n")
    (root / "logs/a.log").unlink()
    now = tree.walk(spark, str(root), False)
    gone, fresh = tree.changes(saved["files"], now)
    assert [r["path"] for r in gone.collect()] == ["logs/a.log"] and [r["path"] for r in fresh.collect()] == ["a.py"]
    assert [r["name"] for r in structure.symbols(tree.refresh_structure(saved["structure"], saved["files"], now)).collect()] == ["g"]


def test_git_listing():
    assert tree.parse_status("?? new.py\0 M a.py\0R  b.py\0old.py\0A  c.py\0!! x\0") == [("new.py", 128), ("a.py", 256), ("b.py", 8), ("c.py", 1), ("x", 16384)]


def test_ignore_files_of_the_tree(spark, tmp_path):
    for p, text in {".gitignore": "*.log\nbuild/\n", "a/.gitignore": "!keep.log\nprivate.txt\n", "a/keep.log": "x", "a/private.txt": "x", "a/ok.txt": "x", "private.txt": "x", "b.log": "x", "build/out.txt": "x"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(text)
    rules = tree.tree_rules(spark, str(tmp_path))
    found = {r["path"] for r in tree.walk(spark, str(tmp_path), True, rules).collect()}
    assert {p for p in found if not p.endswith(".gitignore")} == {"a/keep.log", "a/ok.txt", "private.txt"}
