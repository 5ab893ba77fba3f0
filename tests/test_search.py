import random

import pytest
from pyspark.sql import functions as F

from skein import catalog
from skein.functions import fuzzy, paths, text
from skein.operators import bigram, find, grep
from skein.plans.dsl import AGENT_GREP, parse
from skein.plans.predicates import conjunction
from skein.sources import corpus

TREE = {
    "src/lib.rs": "pub fn parse_query(x: u32) {\n    helper(x)\n}\n\nfn helper(x: u32) {}\n",
    "src/util/mod.rs": "use crate::lib;\nlet s = \"PARSE_QUERY\";\n",
    "tests/lib_test.rs": "import foo\nparse_query(1)\r\nparse query\n",
    "docs/guide.md": "Überblick parse\naaaa\n",
    "bin.dat": "a\0parse_query",
    "empty.rs": "",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(TREE.items()), "path string, content string").cache()


def hits(df):
    return sorted((r["path"], r["line"]) for r in df.collect())


def test_literal_and_smart_case(files):
    assert hits(grep.literal_lines(files, "parse_query")) == [("src/lib.rs", 1), ("src/util/mod.rs", 2), ("tests/lib_test.rs", 2)]
    assert hits(grep.literal_lines(files, "PARSE_Q")) == [("src/util/mod.rs", 2)]


def test_regex_and_fallback(files):
    assert hits(grep.regex_lines(files, r"^\s+helper\(")) == [("src/lib.rs", 2)]
    assert hits(grep.regex_lines(files, "helper(")) == [("src/lib.rs", 2), ("src/lib.rs", 5)]
    escaped = grep.regex_lines(files, r"parse_query\(")
    assert hits(escaped) == hits(grep.literal_lines(files, "parse_query("))


def test_offsets_ranges_and_display(files):
    row = grep.literal_lines(files, "aa").select(grep.literal_offsets(F.col("text"), "aa", True).alias("o"), grep.byte_ranges(F.col("text"), "aa").alias("r")).first()
    assert row["o"] == [0, 1, 2] and [(x["start"], x["end"]) for x in row["r"]] == [(0, 2), (2, 4)]
    long = files.sparkSession.createDataFrame([("é" * 300,), ("x" * 600,), ("short",)], "t string").select(grep.display(F.col("t")).alias("d")).collect()
    assert [r["d"] for r in long] == ["é" * 256, "x" * 512, "short"]
    assert grep.merge_ranges([(4, 6), (0, 2), (2, 3), (5, 9)]) == [(0, 3), (4, 9)]


def test_display_query_cuts_long_lines(spark, sf):
    whole = {(r["path"], r["line"]): r["text"] for r in grep.literal_lines(corpus.files(spark, sf), "the").collect()}
    out = {(r["path"], r["line"]): r["text"] for r in catalog.QUERIES["grep_display_cut"](spark, sf).collect()}
    assert out == {k: t.encode()[:512].decode(errors="ignore") for k, t in whole.items()}
    assert any(len(t.encode()) > 512 for t in whole.values())


def test_context_caps_and_pages(files):
    c = grep.with_context(grep.literal_lines(files, "helper(x)"), files, 1, 1).first()
    assert (c["context_before"], c["context_after"]) == (["pub fn parse_query(x: u32) {"], ["}"])
    many = files.sparkSession.createDataFrame([(f"f{i}", "x\n" * 3) for i in range(5)], "path string, content string")
    found = grep.literal_lines(many, "x")
    assert grep.cap_per_file(found, 2).count() == 10
    assert hits(grep.soft_page(found, 4)) == [(f, n) for f in ("f0", "f1") for n in (1, 2, 3)]
    assert {r["path"] for r in grep.soft_page(found, 4, 3).collect()} == {"f3", "f4"}


def test_multi(files):
    m = {(r["path"], r["line"]): r["matched"] for r in grep.multi_lines(files, ["query", "helper"]).collect()}
    assert m[("src/lib.rs", 1)] == ["query"] and m[("src/lib.rs", 2)] == ["helper"]
    first = files.sparkSession.createDataFrame([("xx b a",)], "t string").select(grep.first_match(F.col("t"), ["a", "b"], True).alias("f")).first()
    assert first["f"] == "b"


def test_multiline(files):
    rows = grep.multiline_spans(files, r"\{\n\s+helper", False).collect()
    assert [(r["path"], r["first_line"], r["last_line"]) for r in rows] == [("src/lib.rs", 1, 2)]


def test_fuzzy_lines(files):
    best = [(r["path"], r["line"]) for r in grep.fuzzy_lines(files, "parse_qeury").orderBy(F.desc("score")).collect()]
    assert ("src/lib.rs", 1) in best and ("docs/guide.md", 2) not in best


def test_search_retries(files):
    assert hits(grep.search(files, "parse_query *.rs !tests/")) == [("src/lib.rs", 1), ("src/util/mod.rs", 2)]
    assert hits(grep.search(files, "nothere.rs helper(", AGENT_GREP)) == [("src/lib.rs", 2), ("src/lib.rs", 5)]
    assert grep.ladder(files, "zzz helper(x:")[0] == "without first word"
    assert grep.ladder(files, "parse_query")[0] == "exact"


def test_line_kinds(spark):
    rows = [("pub(crate) async fn f()", 0), ("export default class A", 0), ("function(", 0), ("definition x", 1), ("import a", 2), ("  use x", 2), ("#  include <a>", 2), ("require ('x')", 2), ("from 'x'", 2), ("user", 1)]
    df = spark.createDataFrame(rows, "text string, want int")
    kind = F.when(grep.is_definition_line(F.col("text")), 0).when(grep.is_import_line(F.col("text")), 2).otherwise(1)
    assert [r for r in df.withColumn("got", kind).collect() if r["got"] != r["want"]] == []


def test_output_budget_drops_imports_after_definitions(files):
    page = grep.multi_lines(files, ["parse_query", "import foo"])
    kinds = [r["kind"] for r in grep.output_budget(page).collect()]
    assert sorted(kinds) == [0, 1, 1]


@pytest.mark.parametrize("needle", ["parse_query", "helper(", "aa", "überblick", "q"])
def test_index_agrees_with_scan(files, needle):
    postings = bigram.build(files)
    probed = bigram.probe(files, postings, bigram.literal_plan(needle))
    assert hits(grep.literal_lines(probed, needle)) == hits(grep.literal_lines(files, needle))


@pytest.mark.parametrize("pattern", [r"parse[_ ]query", r"(fn|let) \w+", r"a{3,}", r"hel.er\(x", r"x|helper", r"(?i)PARSE_Q", r"\bfn\s+helper"])
def test_regex_plans_lose_nothing(files, pattern):
    probed = bigram.probe(files, bigram.build(files), bigram.regex_plan(pattern))
    assert hits(grep.regex_lines(probed, pattern)) == hits(grep.regex_lines(files, pattern))


def test_plans():
    assert bigram.regex_plan(".*") == bigram.ANY and bigram.regex_plan("(") == bigram.ANY
    assert bigram.many_plan(["abc", "x"]) == bigram.ANY
    assert bigram.fuzzy_plan("abcdefghijkl", 2).least == 3
    plan = bigram.regex_plan("abc|xyz")
    assert plan.kind == "or" and len(plan.parts) == 2


def test_constraints(spark):
    df = spark.createDataFrame([("src/a.rs", 256), ("test/b.RS", None), (".rs", 0), ("src/c.md", 128), ("x/src.rs", 1)], "path string, st int")
    pick = lambda q: [r["path"] for r in df.where(conjunction(parse(q).constraints, F.col("path"), F.col("st"))).collect()]
    assert pick("*.rs x") == ["src/a.rs", "test/b.RS", "x/src.rs"]
    assert pick("*.rs *.md /src/ x") == ["src/a.rs", "src/c.md"]
    assert pick("!src/ x") == ["test/b.RS", ".rs", "x/src.rs"]
    assert pick("status:clean x") == ["test/b.RS", ".rs"] and pick("g:staged x") == ["x/src.rs"] and pick("!st:mod x") == ["test/b.RS", ".rs"]
    assert pick("a.rs foo") == ["src/a.rs"] and pick("type:go x") == pick("x y")


def test_alignment():
    score = lambda n, t, k=2: (m := fuzzy.align(n, t, k)) and m[0]
    assert score("main", "main") > score("main", "src/main.rs") > score("main", "m/a/i/n")
    assert score("schema", "schema.rs") > score("shcema", "schema.rs") > 0
    assert score("zzz", "abc", 1) is None


def test_ranking(spark):
    rows = [("src/main.rs", 0, 0, None, 5), ("src/domain.rs", 0, 0, 256, 4), ("docs/main/notes.md", 50, 0, None, 3), ("zzz.txt", 0, 0, None, 1)]
    f = spark.createDataFrame(rows, "path string, access_frecency int, mod_frecency int, git_status int, modified long")
    out = find.fuzzy_files(f, "main.rs").collect()
    assert out[0]["path"] == "src/main.rs" and out[0]["match_type"] == "exact_filename" and "zzz.txt" not in [r["path"] for r in out]
    near = find.fuzzy_files(f, "main.rs", find.Context(current_file="src/main.rs")).collect()
    assert next(r for r in near if r["path"] == "src/main.rs")["current_penalty"] < 0
    combo = find.fuzzy_files(f, "main", find.Context(last_pick="/root/docs/main/notes.md", open_count=4)).first()
    assert combo["path"] == "docs/main/notes.md" and combo["combo"] == 400
    assert [r["path"] for r in find.fuzzy_files(f, "").collect()][0] == "docs/main/notes.md"
    assert [r["path"] for r in find.mixed(f, "main/").collect()] == ["docs/main"]
    assert find.page(f, ["path"], 3, 10).count() == 1 and find.page(f, ["path"], 0, 0).count() == 0
    assert [r["path"] for r in find.named(f, "domain").collect()] == ["src/domain.rs"]


def test_frecency(spark):
    day = 86_400_000_000
    a = spark.createDataFrame([("a", 0), ("a", 10 * day), ("b", -31 * day)] + [("c", 10 * day)] * 19, "path string, us long")
    got = {r["path"]: r["access_frecency"] for r in find.access_scores(a, F.lit(10 * day)).collect()}
    assert got == {"a": 2, "c": 13}
    ages = spark.createDataFrame([(0,), (120,), (510,), (900,), (86401,), (604801,)], "age long")
    assert [r[0] for r in ages.select(find.change_score(F.col("age"), F.lit(True))).collect()] == [16, 16, 12, 8, 2, 0]


def test_did_you_mean(spark):
    names = spark.createDataFrame([("parse_query",), ("parseQueryFast",), ("HTTPServer",), ("Parse",)], "name string")
    ask = lambda q: [r["name"] for r in find.did_you_mean(names, q).collect()]
    assert ask("parseQuery") == ["parse_query"] and ask("httpserv") == ["HTTPServer"] and ask("pasre") == ["Parse"]


def test_paths(spark):
    p = spark.createDataFrame([("a/b/c.tar.gz",), ("Makefile",), (".env.local",), ("x/.rs",), ("src/index.ts",)], "p string")
    c = F.col("p")
    out = [tuple(r) for r in p.select(paths.ext_of(c), paths.name_of(c), paths.dir_of(c), paths.language_of(c), paths.package_key(c)).collect()]
    assert out[0] == ("gz", "c.tar.gz", "a/b", "other", "a/b") and out[1][3] == "make" and out[2][0] == "local" and out[3][0] == "" and out[4][3] == "typescript"
    far = [r[0] for r in p.select(paths.distance_penalty("a/x/y/f", paths.dir_of(c))).collect()]
    assert far == [-2, -3, -3, -3, -3]


def test_text_functions():
    assert text.truncate_lines("a\nbb\nccc\n", 100) == ("a\nbb\nccc\n", 3, 0)
    assert text.truncate_lines("aaaa\n" * 10, 29) == ("aaaa\naaaa\n[8 more lines]\n", 2, 8)
    assert text.filter_text('x = "//no" // yes\n/// doc\n#! keep\ny # gone\n', "minimal") == 'x = "//no"\n/// doc\n#! keep\ny\n'
    assert text.filter_text("a /* b\nc */ d\n\n\n\ne // f\n", "aggressive") == "a  d\n\ne\n"
    assert text.percent_budget(50, 85) == 42 and text.split_budget(1000)["body"] == 850
    assert text.cut_bytes("aé", 2) == "a" and len(text.snippet("x" * 500, 250)) == 182


def brute_fuzzy(rows, query):
    """Scores of all files for a query, part by part, over plain rows ``(path, access, mod, git, modified)``; no open file, no picks."""
    parts = query.split()
    allowed = min(max(len(" ".join(parts)) // 4, 2), 6)
    out = []
    for path, access, mod, git, modified in rows:
        found = [fuzzy.align(p, path, min(allowed, len(p) - 1)) for p in parts]
        if not all(found):
            continue
        base = min(found[0][0], 65535)
        for m in found[1:]:
            base = min((base + m[0]) // len(parts), 65535)
        needle, name = parts[0], path.rsplit("/", 1)[-1]
        in_name = max(found[0][1] - (len(needle) - 1), 0) >= len(path) - len(name)
        again = None if in_name or any("/" in p for p in parts) else fuzzy.align(needle, name, min(allowed, len(needle) - 1))
        exact = (in_name and name.lower() == needle.lower()) or (again is not None and name.lower() == needle.lower())
        if exact:
            bonus = base // 5 * 2
        elif again:
            bonus = min(base // 6, 30) * min(again[0], 16 * len(needle)) // (16 * len(needle))
        elif in_name:
            bonus = min(base // 6, 30)
        else:
            bonus = base * 5 // 100 if name in paths.ENTRY_MODULES and 5 <= len(name) <= 11 else 0
        total = base + base * (access + 4 * mod) // 100 + (base * 15 // 100 if git and git & paths.DIRTY else 0) + bonus
        out.append((-total, -modified, path))
    return [(p, -t) for t, _, p in sorted(out)]


def test_several_parts_and_names_against_brute_force(spark):
    rng = random.Random(3)
    words = ["main", "server", "render", "name", "mod", "score", "user_service", "index"]
    rows = {f"{rng.choice(words)}/{rng.choice(words)}/{rng.choice(words)}{rng.choice(['', '_' + rng.choice(words)])}.{rng.choice(['rs', 'ts', 'py'])}" for _ in range(150)}
    rows |= {"server/mod.rs", "user_service/server.rs", "user_service/server/mod.rs", "rename/rename.ts", "rename/generateSessionName.ts"}
    rows = [(p, rng.randrange(5), rng.randrange(3), rng.choice([None, 0, 256]), i) for i, p in enumerate(sorted(rows))]
    f = spark.createDataFrame(rows, "path string, access_frecency int, mod_frecency int, git_status int, modified long")
    for query in ("server mod", "mod server rs", "rename ts", "name score main", "server"):
        want = [x for x in brute_fuzzy(rows, query) if True][:100]
        if len(query.split()) == 1:
            got = [r["path"] for r in find.fuzzy_files(f, query).collect()]
            assert got[:5] == [p for p, _ in want][:5]
        else:
            assert [(r["path"], r["total"]) for r in find.fuzzy_files(f, query).collect()] == want


def test_names_are_matched_alone(spark):
    """A needle that the path matches above the name is looked for in the name; a whole name counts more than scattered letters."""
    rows = [("rename/x/rename.ts", 0, 0, None, 1), ("rename/x/generateSessionName.ts", 0, 0, None, 2)]
    f = spark.createDataFrame(rows, "path string, access_frecency int, mod_frecency int, git_status int, modified long")
    out = {r["path"]: r for r in find.fuzzy_files(f, "rename").collect()}
    assert out["rename/x/rename.ts"]["name_bonus"] > out["rename/x/generateSessionName.ts"]["name_bonus"]
    assert out["rename/x/rename.ts"]["match_type"] == "fuzzy_filename"


def test_regex_dialect(spark):
    f = spark.createDataFrame([("a", "Abc xyz\n*** x\nabc aa"), ("b", "none")], "path string, content string")
    find_lines = lambda p: [(r["path"], r["line"]) for r in grep.regex_lines(f, p).orderBy("path", "line").collect()]
    assert find_lines(r"\p{Lu}bc") == [("a", 1)] and find_lines("(?P<n>xyz)") == [("a", 1)] and find_lines(r"(?P<n>a)(?P=n)") == [("a", 3)]
    assert find_lines("***") == [("a", 2)] and grep.valid_regex(spark, "a(b") and grep.valid_regex(spark, r"\p{Lu}") is None


def test_combo_runs_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(3), rng.choice("ab"), rng.choice(["x", "y", None]), rng.randrange(20), i) for i in range(200)]
    c = spark.createDataFrame(rows, "project long, query string, file_path string, us long, seq long")
    want = []
    for key in {(r[0], r[1]) for r in rows}:
        picks = [r[2] for r in sorted((r for r in rows if (r[0], r[1]) == key), key=lambda r: (r[3], r[4]))][::-1]
        run = next((i for i, p in enumerate(picks) if p != picks[0]), len(picks))
        want.append((*key, picks[0], run))
    assert sorted(map(tuple, find.combo_runs(c).collect()), key=repr) == sorted(want, key=repr)


def test_index_probe_masks_contents(spark, tmp_path):
    f = spark.createDataFrame([(f"f{i}", "needle here" if i % 10 == 0 else "other text") for i in range(50)], "path string, content string")
    where = f"file://{tmp_path}/index"
    bigram.save(bigram.build(f), where)
    plan = bigram.thinned(bigram.literal_plan("needle"), bigram.load_counts(spark, where))
    assert len(plan.parts) == 4
    found = bigram.probe(f, spark.read.parquet(f"{where}/postings"), plan)
    hits = grep.literal_lines(found, "needle")
    assert sorted(r["path"] for r in hits.collect()) == ["f0", "f10", "f20", "f30", "f40"]
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "needle" in plan[: plan.index("Join")] and "(?i)needle" not in plan[plan.index("Join") :].split("\n", 1)[1]
