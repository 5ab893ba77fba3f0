"""Registered queries of the code operators, over a small program generated for each document, and their SQL twins.

The twins know the program (``corpus.code_files``): line and kind of every definition, call and import follow from the document's id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.catalog import query
from skein.functions import paths
from skein.operators import cards, graph, grep, overview, read, structure
from skein.plans.classify import classify
from skein.plans.location import parse_location
from skein.plans.storage import materialize
from skein.sources import corpus

IDS = "ids AS (SELECT doc_id AS i, doc_id // 2 AS j, 'pkg' || (doc_id % 5) || '/mod_' || doc_id || '.py' AS path FROM documents WHERE doc_id IS NOT NULL)"
SYMBOLS = (
    IDS + ", symbols AS (SELECT 'Shape_' || i AS name, path, 4 AS line, 6 AS end_line, 'class_definition' AS kind, i FROM ids UNION ALL SELECT 'area', path, 5, 6, 'function_definition', i FROM ids "
    "UNION ALL SELECT 'fn_' || i, path, 8, 10, 'function_definition', i FROM ids UNION ALL SELECT 'helper', 'common/util.py', 1, 2, 'function_definition', NULL)"
)
USES = IDS + ", uses AS (SELECT i, j, path, u.line, u.caller FROM ids, (VALUES (2, NULL), (6, 'area'), (9, 'fn')) AS u(line, caller))"
CALLER = "CASE caller WHEN 'fn' THEN 'fn_' || i ELSE caller END AS caller"


def _structure(spark: SparkSession, d: str) -> DataFrame:
    return materialize(structure.structure(corpus.code_files(spark, d)), "code-structure")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """``path, line, token`` of every name on every line."""
    lines = corpus.lines(corpus.code_files(spark, d))
    return lines.select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(corpus.IDENTIFIER), F.lit(0)))).alias("token"))


def _callers(spark: SparkSession, d: str, name: str, hops: int, guard: int = graph.HUB_GUARD) -> DataFrame:
    s = _structure(spark, d)
    return graph.callers(_tokens(spark, d), structure.symbols(s), structure.outline(s), name, hops, guard)


@query("code_symbols", f"WITH {SYMBOLS} SELECT name, path, line, end_line, kind, 100 AS weight, 'python' AS lang FROM symbols")
def code_symbols(spark, d):
    return structure.symbols(_structure(spark, d))


@query(
    "code_outline",
    f"WITH {IDS} SELECT path, 0 AS entry_id, -1 AS parent_id, 0 AS depth, 'Shape_' || i AS name, 4 AS start_line, 6 AS end_line, 'class Shape_' || i || '(Base_' || (i % 3) || '):' AS signature FROM ids "
    "UNION ALL SELECT path, 1, 0, 1, 'area', 5, 6, 'def area(self):' FROM ids UNION ALL SELECT path, 2, -1, 0, 'fn_' || i, 8, 10, 'def fn_' || i || '(x):' FROM ids "
    "UNION ALL SELECT 'common/util.py', 0, -1, 0, 'helper', 1, 2, 'def helper(x):'",
)
def code_outline(spark, d):
    return structure.outline(_structure(spark, d)).select("path", "entry_id", "parent_id", "depth", "name", "start_line", "end_line", "signature")


@query("code_calls", f"WITH {IDS} SELECT path, 6 AS line, 'fn_' || j AS callee FROM ids UNION ALL SELECT path, 9, 'fn_' || j FROM ids UNION ALL SELECT path, 10, 'helper' FROM ids")
def code_calls(spark, d):
    return structure.calls(_structure(spark, d))


@query("code_imports", f"WITH {IDS} SELECT path, 0 AS ord, 1 AS line, 'os' AS spec FROM ids UNION ALL SELECT path, 1, 2, 'pkg' || (j % 5) || '.mod_' || j FROM ids")
def code_imports(spark, d):
    return structure.imports(_structure(spark, d)).select("path", "ord", "line", "spec")


RESOLVED = (
    IDS + ", resolved AS (SELECT a.path, 0 AS ord, 'os' AS spec, NULL AS resolved FROM ids a "
    "UNION ALL SELECT a.path, 1, 'pkg' || (a.j % 5) || '.mod_' || a.j, CASE WHEN b.path <> a.path THEN b.path END FROM ids a LEFT JOIN (SELECT DISTINCT i, path FROM ids) b ON b.i = a.j)"
)


@query("imports_resolved", f"WITH {RESOLVED} SELECT * FROM resolved")
def imports_resolved(spark, d):
    return structure.resolve_imports(structure.imports(_structure(spark, d)), corpus.code_files(spark, d).select("path"))


@query("code_dependents", f"WITH {RESOLVED} SELECT path, min(spec) AS spec FROM resolved WHERE resolved = 'pkg1/mod_1.py' GROUP BY path")
def code_dependents(spark, d):
    return structure.dependents(imports_resolved(spark, d), "pkg1/mod_1.py")


@query("callees_of_one", f"WITH {SYMBOLS} SELECT name AS callee, path, line, kind FROM symbols WHERE name IN ('fn_2', 'helper')")
def callees_of_one(spark, d):
    s = _structure(spark, d)
    return graph.callees(structure.calls(s), structure.symbols(s), "fn_5")


@query(
    "callees_three_hops",
    f"WITH {SYMBOLS} SELECT name AS callee, path, line, 1 AS depth FROM symbols WHERE name IN ('fn_10', 'helper') UNION ALL SELECT name, path, line, CASE name WHEN 'fn_5' THEN 2 ELSE 3 END FROM symbols WHERE name IN ('fn_5', 'fn_2')",
)
def callees_three_hops(spark, d):
    s = _structure(spark, d)
    return graph.callees_within(structure.calls(s), structure.symbols(s), "fn_21", 3)


@query("callers_three_hops", f"WITH {USES} SELECT path, line, 'fn_' || j AS target, h.depth, {CALLER} FROM uses, (VALUES (1), (2), (3)) AS h(depth) WHERE i // (2 ** h.depth)::BIGINT = 1")
def callers_three_hops(spark, d):
    return _callers(spark, d, "fn_1", 3).select("path", "line", "target", "depth", "caller")


@query("callers_of_a_hub", f"WITH {IDS} SELECT path, 10 AS line, 1 AS depth, 'fn_' || i AS caller FROM ids")
def callers_of_a_hub(spark, d):
    """A name with more hits than the guard is reported, but not followed to a second hop."""
    return _callers(spark, d, "helper", 2, 100).select("path", "line", "depth", "caller")


@query("callers_by_package", f"WITH {USES} SELECT regexp_extract(path, '^[^/]*') AS key, count(*) AS n FROM uses WHERE i // 4 = 1 OR i // 2 = 1 GROUP BY ALL")
def callers_by_package(spark, d):
    return graph.count_by(_callers(spark, d, "fn_1", 2), "package")


@query("callers_by_caller", f"WITH {USES} SELECT coalesce(CASE caller WHEN 'fn' THEN 'fn_' || i ELSE caller END, '<unknown>') AS key, count(*) AS n FROM uses WHERE i // 2 = 1 GROUP BY ALL")
def callers_by_caller(spark, d):
    return graph.count_by(_callers(spark, d, "fn_1", 1), "caller")


@query(
    "callers_proximity",
    f"WITH {USES}, h AS (SELECT regexp_extract(path, '^[^/]*') AS dir, h.depth FROM uses, (VALUES (1), (2), (3)) AS h(depth) WHERE i // (2 ** h.depth)::BIGINT = 1), "
    "b AS (SELECT DISTINCT depth + 1 AS depth, dir, 1 AS near FROM h) SELECT h.depth, count(*) AS total, coalesce(sum(near), 0)::BIGINT AS related, count(*) >= 50 AND coalesce(sum(near), 0) * 5 < count(*) AS scattered FROM h LEFT JOIN b USING (depth, dir) WHERE h.depth >= 2 GROUP BY h.depth",
)
def callers_proximity(spark, d):
    return graph.proximity(_callers(spark, d, "fn_1", 3))


@query("code_references", f"WITH {USES} SELECT path, line, 'usage' AS role FROM uses WHERE j = 1 UNION ALL SELECT path, 8, 'definition' FROM ids WHERE i = 1")
def code_references(spark, d):
    return graph.references(_tokens(spark, d), structure.symbols(_structure(spark, d)), "fn_1")


@query(
    "code_impact",
    f"WITH {IDS} SELECT path, 11 AS score, 'direct,imports' AS reasons FROM ids WHERE i // 2 = 1 UNION ALL SELECT path, 3, 'transitive' FROM ids WHERE i // 4 = 1",
)
def code_impact(spark, d):
    defining = structure.symbols(_structure(spark, d)).where(F.col("name") == "fn_1")
    ranked = graph.impact(_callers(spark, d, "fn_1", 2), code_dependents(spark, d), defining)
    return ranked.withColumn("reasons", F.array_join("reasons", ",")).withColumn("score", F.col("score").cast("int"))


@query("code_siblings", f"WITH {SYMBOLS} SELECT path, name, kind, line AS start_line, end_line FROM symbols WHERE name = 'Shape_7'")
def code_siblings(spark, d):
    return structure.siblings(structure.outline(_structure(spark, d)), "fn_7")


@query("code_enclosing", f"WITH {IDS} SELECT path, l.line, CASE l.line WHEN 2 THEN NULL WHEN 4 THEN 'Shape_' || i WHEN 5 THEN 'area' ELSE 'fn_' || i END AS enclosing FROM ids, (VALUES (2), (4), (5), (9)) AS l(line)")
def code_enclosing(spark, d):
    points = corpus.lines(corpus.code_files(spark, d)).where(F.col("path").startswith("pkg") & F.col("path").endswith(".py") & F.col("line").isin(2, 4, 5, 9)).select("path", "line")
    return structure.enclosing(points, structure.outline(_structure(spark, d)))


@query("code_package_roots", f"WITH {IDS} SELECT path, regexp_extract(path, '^[^/]*') AS root FROM ids UNION ALL SELECT 'pkg' || k || '/pyproject.toml', 'pkg' || k FROM range(5) AS r(k)")
def code_package_roots(spark, d):
    return structure.package_roots(corpus.code_files(spark, d).select("path"), ("pyproject.toml",))


@query("code_suspicious", f"WITH {IDS} SELECT 'area' AS name, count(DISTINCT i % 5) AS roots FROM ids HAVING count(DISTINCT i % 5) >= 2")
def code_suspicious(spark, d):
    return graph.suspicious(structure.symbols(_structure(spark, d)), code_package_roots(spark, d))


@query("code_subclasses", f"WITH {IDS} SELECT path, 4 AS line, 'class Shape_' || i || '(Base_1):' AS text FROM ids WHERE i % 3 = 1")
def code_subclasses(spark, d):
    return structure.subclass_lines(corpus.lines(corpus.code_files(spark, d)), "Base_1")


@query("code_import_bundles", f"WITH {IDS} SELECT path, 'import os' AS imports FROM ids")
def code_import_bundles(spark, d):
    return structure.bundle_imports(corpus.lines(corpus.code_files(spark, d)))


@query(
    "code_callees_detailed",
    f"WITH {IDS} SELECT path, 9 AS line, 'fn_2' AS callee, 'x' AS args, 'y' AS target, false AS returned FROM ids WHERE i = 5 UNION ALL SELECT path, 10, 'helper', 'y', NULL, true FROM ids WHERE i = 5",
)
def code_callees_detailed(spark, d):
    found = cards.callees_detailed(corpus.code_files(spark, d), structure.symbols(_structure(spark, d)), "fn_5")
    return found.withColumn("args", F.array_join("args", "|")).select("path", "line", "callee", "args", "target", "returned")


@query("code_bodies", f"WITH {IDS} SELECT path, 8 AS line, 'function_definition' AS kind, 'def fn_5(x):' || chr(10) || '    y = fn_2(x)' || chr(10) || '    return helper(y)' AS body FROM ids WHERE i = 5")
def code_bodies(spark, d):
    return cards.bodies(corpus.code_files(spark, d), structure.symbols(_structure(spark, d)), "fn_5", 4000)


@query("code_expanded", f"WITH {IDS} SELECT a.path, 8 AS line, 'fn_2@' || b.path || ':8;helper@common/util.py:1' AS calls FROM ids a JOIN ids b ON b.i = 2 WHERE a.i = 5")
def code_expanded(spark, d):
    s = _structure(spark, d)
    out = cards.expanded(corpus.code_files(spark, d), structure.symbols(s), structure.calls(s), "fn_5", 4000)
    calls = F.transform("calls", lambda c: F.concat(c["callee"], F.lit("@"), c["path"], F.lit(":"), c["line"].cast("string")))
    return out.select("path", "line", F.array_join(calls, ";").alias("calls"))


@query(
    "code_flow",
    f"WITH {USES} SELECT (SELECT path FROM ids WHERE i = 5) AS path, 'fn_2,helper' AS callees, string_agg(path || ':' || line, ',' ORDER BY path, line) AS callers FROM (SELECT path, line FROM uses WHERE j = 5 ORDER BY path, line LIMIT 10)",
)
def code_flow(spark, d):
    s = _structure(spark, d)
    out = cards.flow(corpus.code_files(spark, d), structure.symbols(s), structure.calls(s), _callers(spark, d, "fn_5", 1), "fn_5", 4000)
    place = F.transform(F.array_sort("callers"), lambda c: F.concat(c["path"], F.lit(":"), c["line"].cast("string")))
    return out.select("path", F.array_join(F.array_sort("callees"), ",").alias("callees"), F.array_join(place, ",").alias("callers"))


@query("symbol_lookup", f"WITH {SYMBOLS} SELECT CASE WHEN name LIKE 'Shape%' THEN 'Shape_1*' ELSE name END AS asked, name, path, line FROM symbols WHERE name LIKE 'Shape\\_1%' ESCAPE '\\' OR name IN ('fn_7', 'helper')")
def symbol_lookup(spark, d):
    return cards.symbol_query(structure.symbols(_structure(spark, d)), "fn_7, Shape_1*, helper, fn_7").select("asked", "name", "path", "line")


@query("symbol_ranking", f"WITH {SYMBOLS} SELECT name, path, line, 100000000::BIGINT + CASE WHEN name = 'fn_1' THEN 50000000 ELSE 0 END AS score FROM symbols WHERE name LIKE 'fn\\_1%' ESCAPE '\\'")
def symbol_ranking(spark, d):
    return cards.ranked_symbols(structure.symbols(_structure(spark, d)), "fn_1").select("name", "path", "line", "score")


@query("symbol_substring", f"WITH {SYMBOLS} SELECT DISTINCT name FROM symbols WHERE contains(name, 'ape_9')")
def symbol_substring(spark, d):
    return cards.substring_symbols(structure.symbols(_structure(spark, d)), "ape_9")


@query("glob_paths", f"WITH {IDS} SELECT DISTINCT path FROM ids WHERE regexp_matches(path, '^pkg[13]/mod_[^/]*8[.]py$') ORDER BY path LIMIT 1000")
def glob_paths(spark, d):
    return cards.glob_files(corpus.code_files(spark, d), "pkg[13]/mod_*8.py")


@query("pattern_presence", f"WITH {IDS} SELECT path, 'Base_0,helper' AS present FROM ids WHERE i % 3 = 0 UNION ALL SELECT path, 'helper' FROM ids WHERE i % 3 <> 0 UNION ALL SELECT 'common/util.py', 'helper' UNION ALL SELECT 'pkg' || k || '/pyproject.toml', '' FROM range(5) AS r(k)")
def pattern_presence(spark, d):
    return cards.presence(corpus.code_files(spark, d), ["helper", "Base_0"]).select("path", F.array_join("present", ",").alias("present"))


@query("definition_lines", f"WITH {SYMBOLS} SELECT path, line FROM symbols")
def definition_lines(spark, d):
    """Lines that define something, by their text alone."""
    return corpus.lines(corpus.code_files(spark, d)).where(grep.is_definition_line(F.col("text"))).select("path", "line")


@query("key_files", f"SELECT 'pkg' || k || '/pyproject.toml' AS path, 'build' AS kind FROM range(5) AS r(k)")
def key_files(spark, d):
    return overview.key_files(corpus.code_files(spark, d))


# Path rules, over a path for each document that its id chooses from a list.

PATHS = (
    ("a/build.rs", "build", "rust", False, False, False), ("a/tests/x.rs", "test", "rust", False, False, False), ("docs/x.md", "docs", "markdown", False, False, False), ("a/ui/x.ts", "ui", "typescript", False, False, False),
    ("a/auth/x.go", "auth", "go", False, False, False), ("a/provider/x.java", "provider", "java", False, False, False), ("a/x.toml", "config", "structured", False, False, False), ("a/router/x.py", "handler", "python", False, False, False),
    ("a/src/x.c", "implementation", "c", False, False, False), ("src/main.rs", "implementation", "rust", False, False, True), ("a/Cargo.toml", "config", "structured", False, True, False), ("a/x.test.js", "generic", "javascript", True, False, False),
    ("a/x.spec.ts", "generic", "typescript", True, False, False), ("Makefile", "generic", "make", False, True, False), ("index.ts", "generic", "typescript", False, False, True), ("a/b/__tests__/x.kt", "generic", "kotlin", True, False, False),
    ("a/x_test.go", "test", "go", False, False, False), ("a/app.py", "generic", "python", False, False, True), ("a/x.csv", "generic", "tabular", False, False, False), ("a/x.bin", "generic", "other", False, False, False),
)
_VALUES = ", ".join(f"({k}, '{p}', '{r}', '{lang}', {t}, {b}, {e})" for k, (p, r, lang, t, b, e) in enumerate(PATHS))
CHOSEN = f"v(k, path, role, lang, is_test, is_build, is_entry) AS (VALUES {_VALUES}), chosen AS (SELECT doc_id, v.* FROM documents JOIN v ON doc_id % {len(PATHS)} = k)"


@query("path_rules", f"WITH {CHOSEN} SELECT doc_id, path, role, lang, is_test, is_build, is_entry FROM chosen")
def path_rules(spark, d):
    path = F.element_at(F.array(*(F.lit(p[0]) for p in PATHS)), (F.col("doc_id") % len(PATHS) + 1).cast("int"))
    rows = corpus.table(spark, d, "documents").select("doc_id", path.alias("path")).where("doc_id IS NOT NULL")
    p = F.col("path")
    return rows.select(
        "doc_id", "path", paths.role_of(p).alias("role"), paths.language_of(p).alias("lang"), paths.is_test_file(p).alias("is_test"), paths.is_build_file(p).alias("is_build"), paths.is_entrypoint(p).alias("is_entry")
    )


@query("generated_files", f"WITH {CHOSEN} SELECT doc_id, doc_id % 7 = 0 OR doc_id % 3 = 1 AS generated FROM chosen")
def generated_files(spark, d):
    rows = corpus.table(spark, d, "documents").select("doc_id").where("doc_id IS NOT NULL")
    path = F.when(F.col("doc_id") % 7 == 0, F.element_at(F.array(*map(F.lit, ("a/x.min.js", "yarn.lock", "x_pb2.py"))), (F.col("doc_id") % 3 + 1).cast("int"))).otherwise("a/x.py")
    content = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("# "), F.element_at(F.array(F.lit("@generated"), F.lit("DO NOT EDIT")), (F.col("doc_id") % 2 + 1).cast("int")))).otherwise(F.concat(F.repeat(F.lit("x "), 300), F.lit("@generated")))
    return rows.select("doc_id", paths.is_generated(path, content).alias("generated"))


# Parsers that run on the driver: their results as a table.

LOCATIONS = ("src/a.rs:12", "src/a.rs:12:4", "src/a.rs", "a.rs(12,4)")


@query("parsed_locations", "SELECT * FROM (VALUES ('src/a.rs:12', 'src/a.rs', true), ('src/a.rs:12:4', 'src/a.rs', true), ('src/a.rs', 'src/a.rs', false), ('a.rs(12,4)', 'a.rs', true)) AS t(query, path, located)")
def parsed_locations(spark, d):
    rows = [(q, path, at is not None) for q in LOCATIONS for path, at in [parse_location(q)]]
    return spark.createDataFrame(rows, "query string, path string, located boolean")


ASKED = ("src/lib.rs", "*.rs", "parse_query", "how are files ranked")


@query("classified_queries", "SELECT * FROM (VALUES ('src/lib.rs', 'path'), ('*.rs', 'glob'), ('parse_query', 'symbol'), ('how are files ranked', 'concept')) AS t(query, kind)")
def classified_queries(spark, d):
    rows = [(q, classify(q, lambda p: p == "src/lib.rs")) for q in ASKED]
    return spark.createDataFrame(rows, "query string, kind string")


# Shapes of search results, and scores joined with files.


@query("grep_grouped", f"WITH {SYMBOLS}, h AS (SELECT path, line FROM symbols WHERE name <> 'helper') SELECT path, count(*) AS n, string_agg(line, ',' ORDER BY line) AS lines FROM h GROUP BY path")
def grep_grouped(spark, d):
    hits = corpus.lines(corpus.code_files(spark, d)).where(grep.is_definition_line(F.col("text")) & F.col("path").startswith("pkg"))
    return grep.grouped(hits).select("path", "n", F.array_join(F.transform("lines", lambda x: x["line"].cast("string")), ",").alias("lines"))


@query("grep_usage_kinds", f"WITH {IDS} SELECT path, l.line, CASE l.line WHEN 1 THEN 'import' WHEN 8 THEN 'definition' ELSE 'usage' END AS kind FROM ids, (VALUES (1), (8), (9)) AS l(line)")
def grep_usage_kinds(spark, d):
    hits = corpus.lines(corpus.code_files(spark, d)).where(F.col("path").startswith("pkg") & F.col("path").endswith(".py") & F.col("line").isin(1, 8, 9))
    return grep.output(hits, "usage").select("path", "line", "kind")


@query("grep_scan_counters", "SELECT count(*) AS files, count(*) FILTER (WHERE coalesce(text, '') = '') AS empty, 0::BIGINT AS too_large, 0::BIGINT AS binary, count(*) FILTER (WHERE coalesce(text, '') <> '') AS searched, count(*) FILTER (WHERE contains(lower(text), 'license')) AS matched FROM documents")
def grep_scan_counters(spark, d):
    return grep.scan_counters(corpus.files(spark, d), "license")


@query(
    "files_with_scores",
    f"WITH {IDS}, a AS (SELECT 'pkg' || (user_id % 5) || '/mod_' || user_id || '.py' AS path, epoch_us(ts) AS us FROM events), n AS (SELECT max(us) AS now FROM a), "
    "x AS (SELECT path, sum(exp(-0.0693::DOUBLE * ((now - us) / 86400e6::DOUBLE))) AS x FROM a, n WHERE (now - us) / 86400e6::DOUBLE <= 30 GROUP BY path) "
    "SELECT ids.path, coalesce(round(CASE WHEN x <= 10 THEN x ELSE 10 + sqrt(x - 10) END)::BIGINT, 0) AS access_frecency FROM ids LEFT JOIN x ON x.path = ids.path",
)
def files_with_scores(spark, d):
    """Events stand in for accesses of the modules with their users' numbers."""
    from skein.operators import find

    e = corpus.table(spark, d, "events")
    a = e.select(F.format_string("pkg%d/mod_%d.py", F.col("user_id") % 5, F.col("user_id")).alias("path"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    now = a.agg(F.max("us")).first()[0]
    files = corpus.code_files(spark, d).where("doc_id IS NOT NULL").select("path")
    return find.with_scores(files, find.access_scores(a, F.lit(now))).select("path", "access_frecency")


@query("last_accesses_by_type", "WITH r AS (SELECT event_type AS path, epoch_us(ts) AS us, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT path, us, event_id, n FROM r WHERE n <= 128")
def last_accesses_by_type(spark, d):
    """Types of events stand in for files: each has more accesses than are kept."""
    from skein.operators import find

    e = corpus.table(spark, d, "events")
    return find.last_accesses(e.select(F.col("event_type").alias("path"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")).select("path", "us", "event_id", "n")


# Reading by structure, exports, mentions, hubs and counts of what is kept.

OUTLINE = "'[4-6] class Shape_' || i || '(Base_' || (i % 3) || '):' || chr(10) || '  [5-6] def area(self):' || chr(10) || '[8-10] def fn_' || i || '(x):'"
SIGNATURES = "'class Shape_' || i || '(Base_' || (i % 3) || '):' || chr(10) || 'def area(self):' || chr(10) || 'def fn_' || i || '(x):'"


@query("code_views", f"WITH {IDS} SELECT path, 'outline' AS view, {OUTLINE} AS body FROM ids UNION ALL SELECT 'common/util.py', 'outline', '[1-2] def helper(x):'")
def code_views(spark, d):
    return read.views(corpus.code_files(spark, d), _structure(spark, d))


@query("code_views_small", f"WITH {IDS} SELECT path, 'signatures' AS view, {SIGNATURES} AS body FROM ids UNION ALL SELECT 'common/util.py', 'outline', '[1-2] def helper(x):'")
def code_views_small(spark, d):
    """With 20 tokens only the shortest outline fits; the others give way to signatures."""
    return read.views(corpus.code_files(spark, d), _structure(spark, d), total_tokens=20)


@query("code_signatures", f"WITH {IDS} SELECT path, 'signatures' AS view, {SIGNATURES} AS body FROM ids UNION ALL SELECT 'common/util.py', 'signatures', 'def helper(x):'")
def code_signatures(spark, d):
    return read.views(corpus.code_files(spark, d), _structure(spark, d), "signatures")


@query(
    "code_sections",
    f"WITH {IDS} SELECT path, 6 AS line, 'area' AS name, 'function_definition' AS kind, 5 AS start_line, 6 AS end_line, '    def area(self):' || chr(10) || '        return fn_' || j || '(self)' AS body FROM ids "
    "UNION ALL SELECT path, 9, 'fn_' || i, 'function_definition', 8, 10, 'def fn_' || i || '(x):' || chr(10) || '    y = fn_' || j || '(x)' || chr(10) || '    return helper(y)' FROM ids",
)
def code_sections(spark, d):
    """Lines 2, 6 and 9 of each module; the second is in no definition."""
    files = corpus.code_files(spark, d)
    points = files.where("doc_id IS NOT NULL").select("path", F.explode(F.array(F.lit(2), F.lit(6), F.lit(9))).alias("line"))
    return read.sections(files, _structure(spark, d), points)


@query("script_exports", "SELECT 'web/s_' || doc_id || '.js' AS path, e.line, CASE e.line WHEN 1 THEN 'go_' || doc_id ELSE e.name END AS name FROM documents, (VALUES (1, ''), (2, 'b'), (2, 'c'), (3, 'x')) AS e(line, name) WHERE doc_id IS NOT NULL")
def script_exports(spark, d):
    i = F.col("doc_id")
    docs = corpus.table(spark, d, "documents").where(i.isNotNull())
    script = F.format_string("export const go_%d = 1;\nexport { a as b, c };\nmodule.exports.x = 1;\n", i)
    return structure.anchors(docs.select(F.format_string("web/s_%d.js", i).alias("path"), script.alias("content")))


@query("mentioned_files", f"WITH {IDS} SELECT path, ceil(strlen('import os' || chr(10) || 'from pkg' || (j % 5) || '.mod_' || j || ' import fn_' || j || chr(10) || chr(10) || 'class Shape_' || i || '(Base_' || (i % 3) || '):' || chr(10) || '    def area(self):' || chr(10) || '        return fn_' || j || '(self)' || chr(10) || chr(10) || 'def fn_' || i || '(x):' || chr(10) || '    y = fn_' || j || '(x)' || chr(10) || '    return helper(y)' || chr(10)) / 4)::BIGINT AS tokens FROM ids WHERE contains(path, 'mod_7') UNION ALL SELECT 'common/util.py', ceil(strlen('def helper(x):' || chr(10) || '    return x' || chr(10)) / 4)::BIGINT")
def mentioned_files(spark, d):
    return read.mentioned(corpus.code_files(spark, d), "see mod_7 util.py mod_7").select("path", "tokens")


@query("callers_hub_counts", f"WITH {IDS} SELECT 1 AS depth, 'helper' AS target, count(*) AS n, count(*) > 100 AS is_hub FROM ids")
def callers_hub_counts(spark, d):
    return graph.hub_counts(_callers(spark, d, "helper", 2, 100), 100)


@query("callers_skipping", f"WITH {USES} SELECT path, line, 'fn_' || j AS target, h.depth FROM uses, (VALUES (1), (2)) AS h(depth) WHERE i // (2 ** h.depth)::BIGINT = 1 AND (h.depth = 1 OR j <> 2)")
def callers_skipping(spark, d):
    """``fn_2`` is reported as a caller, but not looked up."""
    s = _structure(spark, d)
    return graph.callers(_tokens(spark, d), structure.symbols(s), structure.outline(s), "fn_1", 2, skip=("fn_2",)).select("path", "line", "target", "depth")


@query("impact_by_text", f"WITH {IDS}, p AS (SELECT path, CASE WHEN j = 1 THEN 9 ELSE 0 END + CASE WHEN starts_with(j::VARCHAR, '1') AND i <> 1 THEN 2 ELSE 0 END AS score FROM ids) SELECT path, score::BIGINT AS score FROM p WHERE score > 0")
def impact_by_text(spark, d):
    defining = structure.symbols(_structure(spark, d)).where(F.col("name") == "fn_1")
    return graph.impact_by_text(_callers(spark, d, "fn_1", 1), corpus.code_files(spark, d), defining)


@query("tree_leaves", f"WITH {IDS} SELECT path, 'Shape_' || i || '@4;area@5' AS symbols FROM ids UNION ALL SELECT 'common/util.py', 'helper@1' UNION ALL SELECT 'pkg' || k || '/pyproject.toml', NULL FROM range(5) AS r(k)")
def tree_leaves(spark, d):
    out = overview.with_symbols(corpus.code_files(spark, d), structure.symbols(_structure(spark, d)), 2)
    return out.select("path", F.array_join(F.transform("symbols", lambda s: F.concat(s["name"], F.lit("@"), s["line"].cast("string"))), ";").alias("symbols"))


@query(
    "entry_counts",
    "SELECT (SELECT count(*) FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL)) + (SELECT count(*) FROM (SELECT 1 FROM events WHERE user_id IS NULL LIMIT 1)) AS files, "
    "(SELECT sum(least(n, 128))::BIGINT FROM (SELECT count(*) AS n FROM events GROUP BY user_id)) AS accesses, (SELECT count(*) FROM events) AS picks, (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) AS queries",
)
def entry_counts(spark, d):
    from skein.operators import find

    return find.entry_counts(corpus.accesses(spark, d), corpus.completions(spark, d))


# Imports of other languages: a pair of files for each document, of the language that its id chooses.

IMPORTS = (
    ("crates/a_%d/src/x/run.rs", "use crate::util_%d::go;\n", "crates/a_%d/src/util_%d.rs", "crate::util_%d::go"),
    ("web/a_%d/x.ts", "import { a } from './lib';\n", "web/a_%d/lib/index.ts", "./lib"),
    ("web/b_%d/x.js", "const a = require('../common_%d');\n", "web/common_%d.js", "../common_%d"),
    ("src/c_%d/x.c", '#include "near_%d.h"\n', "src/c_%d/near_%d.h", "near_%d.h"),
    ("src/d_%d/X.java", "import org.k_%d.Thing;\n", "org/k_%d/Thing.java", "org.k_%d.Thing"),
    ("rb_%d/x.rb", "require_relative 'y'\n", "rb_%d/y.rb", "./y"),
    ("e_%d/x.tsx", "import Page from '@/page_%d';\n", "src/page_%d.tsx", "@/page_%d"),
    ("p_%d/sub/x.py", "from ..near import thing\n", "p_%d/near.py", "..near"),
)


def _filled(which: int, i):
    """The text for the document's language, its id in place of each ``%d``."""
    text = F.element_at(F.array(*(F.lit(row[which]) for row in IMPORTS)), (i % len(IMPORTS) + 1).cast("int"))
    return F.replace(text, F.lit("%d"), i.cast("string"))


def _rows() -> str:
    quote = lambda x: "'" + x.replace("'", "''").replace("%d", "' || doc_id || '") + "'"
    return " UNION ALL ".join(f"SELECT {quote(a)} AS path, {quote(spec)} AS spec, {quote(b)} AS resolved FROM documents WHERE doc_id % {len(IMPORTS)} = {k}" for k, (a, _, b, spec) in enumerate(IMPORTS))


@query("imports_by_language", _rows())
def imports_by_language(spark, d):
    i = F.col("doc_id")
    docs = corpus.table(spark, d, "documents").where(i.isNotNull())
    files = docs.select(F.inline(F.array(F.struct(_filled(0, i).alias("path"), _filled(1, i).alias("content")), F.struct(_filled(2, i).alias("path"), F.lit("").alias("content")))))
    return structure.resolve_imports(structure.imports(structure.structure(files)), files.select("path")).select("path", "spec", "resolved")
