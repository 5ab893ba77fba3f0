import json

import pytest

from skein.engine import Engine, emit
from skein.operators import cards, structure
from tests.test_structure import TREE


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark.createDataFrame(TREE, "path string, content string").cache())


def test_symbols_and_globs(engine):
    assert [(r["asked"], r["path"]) for r in engine.symbol("run, hel*").collect()][0][0] == "run"
    assert [r["path"] for r in engine.glob("**/*.rs").collect()] == ["lib/src/run.rs", "lib/src/util.rs"]
    assert [r["name"] for r in cards.substring_symbols(engine.symbols, "elp").collect()] == ["helper"]
    assert cards.ranked_symbols(engine.symbols, "run").first()["name"] == "run"


def test_ask(engine):
    assert engine.ask("app/util.py")[0] == "path" and engine.ask("app/util.py:2")[1]["text"] == "    return x"
    assert engine.ask("helper")[0] == "symbol" and engine.ask("help")[0] == "prefix" and engine.ask("*.zzz")[0] == "glob"
    kind, hits = engine.ask("pub fn run")
    assert kind == "content" and hits.first()["path"] == "lib/src/run.rs"


def test_calls(engine):
    d = {r["callee"]: r for r in engine.callees_detailed("run").collect()}
    assert d["helper"]["args"] in (["x"], ["os.getcwd"]) or d["helper"]["returned"] in (True, False)
    card = engine.flow("helper").collect()
    assert {r["path"] for r in card} == {"app/util.py", "lib/src/util.rs"} and len(card[0]["callers"]) >= 2
    e = cards.expanded(engine.files, engine.symbols, structure.calls(engine.structures), "run", 1000)
    assert e.count() == 2


def test_impact_and_dependents(engine):
    assert [r["path"] for r in engine.dependents("app/util.py").collect()] == ["app/main.py"]
    top = engine.impact("helper", 2).first()
    assert top["path"] == "app/main.py" and "imports" in top["reasons"]


def test_reading_and_presence(engine):
    assert engine.read("util.py")["text"].startswith("def helper") and engine.read("nothing")["kind"] == "candidates"
    assert engine.mention("see @app/util.py", 16)["kind"] == "file"
    p = cards.presence(engine.files.where("path = 'app/util.py'"), ["return", "helper", "zz"]).first()
    assert p["present"] == ["helper", "return"]
    assert json.loads(emit(engine.glob("app/*.py"))) == [{"path": "app/main.py"}, {"path": "app/util.py"}]
    assert cards.split_arguments("a, b" + "c" * 50) == ["a", "b" + "c" * 36 + "..."]


def test_saved_index_is_refreshed(spark, tmp_path):
    root, index = tmp_path / "r", str(tmp_path / "i")
    root.mkdir()
    (root / "a.py").write_text("def alpha():\n    pass\n")
    (root / "b.py").write_text("def beta():\n    alpha()\n")
    assert Engine.saved(spark, str(root), index).grep("alpha").count() == 2
    (root / "b.py").write_text("def gamma():\n    pass\n")
    again = Engine.saved(spark, str(root), index)
    assert again.grep("alpha").count() == 1 and again.grep("gamma").count() == 1 and again.grep("alpha", page=5).count() == 1
    assert {r["name"] for r in again.symbols.collect()} == {"alpha", "gamma"}


def test_an_index_finds_what_a_scan_finds(spark, tmp_path):
    from skein.operators import bigram

    files = spark.createDataFrame([*TREE, ("x/long.txt", "the transformation_pipeline runs\n"), ("x/typo.txt", "the transfrmation_pipeline runs\nand trans_formation_pipe_line\n"), ("x/none.txt", "nothing\n")], "path string, content string").cache()
    scan, indexed = Engine(files), Engine(files, postings=bigram.build(files))
    for mode, query in [("regex", r"fn\s+\w+\("), ("regex", r"\p{Lu}\("), ("regex", "(unclosed"), ("regex", "[[a]b]"), ("fuzzy", "transformation_pipeline"), ("fuzzy", "helpr"), ("auto", "pub fn (run|helper)"), ("literal", "return")]:
        rows = [sorted((r["path"], r["line"]) for r in e.grep(query, mode).collect()) for e in (scan, indexed)]
        assert rows[0] == rows[1], (mode, query)
        assert rows[0] or query in ("(unclosed", "[[a]b]"), (mode, query)


def test_reading_by_structure(engine):
    views = {r["path"]: r for r in engine.views().collect()}
    assert views["lib/src/run.rs"]["body"].startswith("[4-6] pub fn run(x: u32) -> u32 {  // Runs it.") and views["web/b.js"]["body"] == ""
    small = {r["path"]: r for r in engine.views(total_tokens=10).collect()}
    assert small["app/main.py"]["view"] == "truncated" and small["app/main.py"]["body"].endswith("[truncated to budget]\n") and len(small["app/main.py"]["body"].encode()) <= 32
    assert [(r["name"], r["body"]) for r in engine.section("app/main.py", 10).collect()] == [("run", "    def run(self):\n        return helper(os.getcwd())")]
    assert engine.section("app/main.py", 1).count() == 0
    assert [(r["path"], r["line"], r["name"]) for r in engine.exports().orderBy("path").collect()] == [("web/a.js", 1, "go"), ("web/b.js", 1, "x")]
    assert [r["path"] for r in engine.mentioned("util nothing").collect()] == ["app/util.py", "lib/src/util.rs"] and engine.mentioned("  ").count() == 0
    leaves = {r["path"]: r["symbols"] for r in engine.leaves(1).collect()}
    assert [s["name"] for s in leaves["app/main.py"]] == ["A"] and leaves["app/pyproject.toml"] is None


def test_generated_files_are_marked(spark):
    e = Engine(spark.createDataFrame([("a_pb2.py", "def f():\n    pass\n"), ("b.py", None)], "path string, content string"))
    assert {r["path"]: r["body"] for r in e.views().collect()} == {"a_pb2.py": "[generated file]\n[1-2] def f():", "b.py": ""}


def test_pages_by_use_and_matches_over_lines(spark):
    rows = [(f"f{i}", "hit\nhit\n", i % 3, 10 - i) for i in range(6)]
    e = Engine(spark.createDataFrame(rows, "path string, content string, access_frecency int, modified int").cache())
    assert sorted({r["path"] for r in e.grep("hit", page=3).collect()}) == ["f2", "f5"]
    two = e.grep(r"hit\nhit", "regex").orderBy("path").collect()
    assert [(r["path"], r["line"], r["text"]) for r in two[:2]] == [("f0", 1, "hit\nhit"), ("f1", 1, "hit\nhit")] and len(two) == 6
