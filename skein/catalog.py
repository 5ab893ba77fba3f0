"""Registered queries of the library's own operators, over whole tables, and their SQL twins.

Documents stand in for files (``source/lang/doc_<id>.txt``), events for accesses and picks; a token's definition is the first line that
holds it. Limits are those of top-k reports and pages.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import paths
from skein.functions.text import estimated_tokens, split_budget
from skein.operators import bigram, find, graph, grep, overview, read
from skein.plans.dsl import GREP, parse
from skein.plans.predicates import conjunction
from skein.plans.storage import committed, shared_dir
from skein.sources import corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

FILES = "files AS (SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, text AS content, doc_id, source, lang FROM documents)"
LINES = (
    FILES + ", parts AS (SELECT path, doc_id, source, string_split(content, chr(10)) AS l FROM files), raw AS (SELECT path, doc_id, source, generate_subscripts(l, 1) AS line, unnest(l) AS text, len(l) AS n FROM parts), "
    "lines AS (SELECT path, doc_id, source, line::INT AS line, text FROM raw WHERE NOT (line = n AND text = ''))"
)
TOKENS = FILES + ", tokens AS (SELECT path, source, unnest(list_distinct(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*'))) AS token FROM files)"
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _low(c: str) -> str:
    return FOLD.format(c)


# Content search


@query("grep_literal", f"WITH {LINES} SELECT path, line, text FROM lines WHERE contains({_low('text')}, 'tion') AND path LIKE '%/en/%' AND path LIKE '%.txt' ORDER BY path, line LIMIT 200")
def grep_literal(spark, d):
    q = parse("tion *.txt /en/", GREP)
    scope = corpus.files(spark, d).where(conjunction(q.constraints, F.col("path")))
    return grep.literal_lines(scope, q.search_text()).orderBy("path", "line").limit(200)


@query("grep_literal_all", f"WITH {LINES} SELECT path, line FROM lines WHERE contains({_low('text')}, 'the')")
def grep_literal_all(spark, d):
    return grep.literal_lines(corpus.files(spark, d), "the").select("path", "line")


@query("grep_regex", f"WITH {LINES} SELECT path, line FROM lines WHERE regexp_matches(text, '(?i)\\bthe\\b')")
def grep_regex(spark, d):
    return grep.regex_lines(corpus.files(spark, d), r"\bthe\b").select("path", "line")


@query("grep_smart_case", f"WITH {LINES} SELECT path, line FROM lines WHERE contains(text, 'The')")
def grep_smart_case(spark, d):
    return grep.literal_lines(corpus.files(spark, d), "The").select("path", "line")


@query("grep_word", f"WITH {LINES} SELECT path, line FROM lines WHERE regexp_matches(text, '(?i)\\b(?:and)\\b')")
def grep_word(spark, d):
    return grep.regex_lines(corpus.files(spark, d), grep.word_pattern("and", False), ignore_case=True).select("path", "line")


@query("grep_files_with_matches", f"WITH {LINES} SELECT DISTINCT path FROM lines WHERE contains({_low('text')}, 'license')")
def grep_files_with_matches(spark, d):
    return grep.literal_lines(corpus.files(spark, d), "license").select("path").distinct()


@query("grep_count_by_file", f"WITH {LINES} SELECT path, count(*) AS n FROM lines WHERE contains({_low('text')}, 'the') GROUP BY path")
def grep_count_by_file(spark, d):
    return grep.literal_lines(corpus.files(spark, d), "the").groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("grep_max_count", f"WITH {LINES}, h AS (SELECT path, line, row_number() OVER (PARTITION BY path ORDER BY line) AS n FROM lines WHERE contains({_low('text')}, 'the')) SELECT path, line FROM h WHERE n <= 2")
def grep_max_count(spark, d):
    return grep.cap_per_file(grep.literal_lines(corpus.files(spark, d), "the"), 2).select("path", "line")


@query(
    "grep_context",
    f"WITH {LINES}, w AS (SELECT path, line, text, lag(text) OVER p AS b, lead(text) OVER p AS a FROM lines WINDOW p AS (PARTITION BY path ORDER BY line)) "
    f"SELECT path, line, coalesce(b, '') AS before_text, coalesce(a, '') AS after_text FROM w WHERE contains({_low('text')}, 'license')",
)
def grep_context(spark, d):
    files = corpus.files(spark, d)
    c = grep.with_context(grep.literal_lines(files, "license"), files, 1, 1)
    return c.select("path", "line", F.array_join("context_before", "").alias("before_text"), F.array_join("context_after", "").alias("after_text"))


@query(
    "grep_soft_page",
    f"WITH {LINES}, h AS (SELECT path, line FROM lines WHERE contains({_low('text')}, 'the')), c AS (SELECT path, count(*) AS n FROM h GROUP BY path), "
    "b AS (SELECT path, coalesce(sum(n) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) SELECT path, line FROM h JOIN b USING (path) WHERE before < 50",
)
def grep_soft_page(spark, d):
    return grep.soft_page(grep.literal_lines(corpus.files(spark, d), "the"), 50).select("path", "line")


@query(
    "grep_ranked_page",
    f"WITH {LINES}, h AS (SELECT path, line FROM lines WHERE contains({_low('text')}, 'the')), c AS (SELECT path, count(*) AS n, regexp_extract(path, '_([0-9]+)[.]txt$', 1)::BIGINT AS i FROM h GROUP BY path), "
    "b AS (SELECT path, coalesce(sum(n) OVER (ORDER BY i % 7 DESC, i % 3 DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) SELECT path, line FROM h JOIN b USING (path) WHERE before < 50",
)
def grep_ranked_page(spark, d):
    """A page in the order of use and change, which the documents' ids stand in for."""
    files = corpus.files(spark, d)
    ranks = files.select("path", (F.col("doc_id") % 7).alias("frecency"), (F.col("doc_id") % 3).alias("modified"))
    return grep.soft_page(grep.literal_lines(files, "the"), 50, ranks=ranks).select("path", "line")


@query(
    "grep_offsets",
    f"WITH {LINES} SELECT path, line, array_to_string(list_filter(range(0, greatest(length(text) - 2, 0)), lambda i: substr({_low('text')}, i + 1, 3) = 'ion'), ',') AS starts FROM lines WHERE contains({_low('text')}, 'ion')",
)
def grep_offsets(spark, d):
    hits = grep.literal_lines(corpus.files(spark, d), "ion")
    return hits.select("path", "line", F.array_join(grep.literal_offsets(F.col("text"), "ion", True).cast("array<string>"), ",").alias("starts"))


NEEDLES = ["license", "apache", "tion the"]


@query(
    "multi_grep_matched_patterns",
    f"WITH {LINES} SELECT path, line, array_to_string(list_filter(['license', 'apache', 'tion the'], lambda p: contains({_low('text')}, p)), '|') AS matched FROM lines WHERE len(list_filter(['license', 'apache', 'tion the'], lambda p: contains({_low('text')}, p))) > 0",
)
def multi_grep(spark, d):
    m = grep.multi_lines(corpus.files(spark, d), NEEDLES)
    return m.select("path", "line", F.array_join("matched", "|").alias("matched"))


@query("grep_display", f"WITH {LINES} SELECT path, line, text FROM lines WHERE contains(text, 'License') AND strlen(text) <= 512")
def grep_display(spark, d):
    hits = grep.literal_lines(corpus.files(spark, d), "License").where(F.octet_length("text") <= 512)
    return hits.select("path", "line", grep.display(F.col("text")).alias("text"))


@query("grep_display_cut")
def grep_display_cut(spark, d):
    hits = grep.literal_lines(corpus.files(spark, d), "the")
    return hits.select("path", "line", grep.display(F.col("text")).alias("text"))


@query("grep_trimmed", f"WITH {LINES} SELECT path, line, ltrim(text, ' ' || chr(9)) AS text FROM lines WHERE contains(text, 'Licensed')")
def grep_trimmed(spark, d):
    return grep.trim_lines(grep.literal_lines(corpus.files(spark, d), "Licensed")).select("path", "line", "text")


@query(
    "grep_line_kinds",
    f"WITH {LINES} SELECT path, line, CASE WHEN regexp_matches(text, '^\\s*(?:(?:pub|export|default|async|abstract|unsafe|static|protected|private|public)\\s+)*(?:struct|fn|enum|trait|impl|class|interface|function|def|func|type|module|object)(?:[^A-Za-z0-9_]|$)') THEN 'definition' "
    "WHEN regexp_matches(text, '^\\s*(?:import[ \\t]|use[ \\t])') THEN 'import' ELSE 'usage' END AS kind FROM lines",
)
def grep_line_kinds(spark, d):
    t = F.col("text")
    kind = F.when(grep.is_definition_line(t), "definition").when(grep.is_import_line(t), "import").otherwise("usage")
    return corpus.lines(corpus.files(spark, d)).select("path", "line", kind.alias("kind"))


@query("grep_fuzzy")
def grep_fuzzy(spark, d):
    return grep.fuzzy_lines(corpus.files(spark, d), "lisence").select("path", "line", "score")


@query("grep_pages", "SELECT regexp_replace(url, '^https?://', '') AS path FROM pages WHERE contains(html, '<nav>') AND contains(" + _low("html") + ", 'charset')")
def grep_pages(spark, d):
    f = corpus.page_files(spark, d)
    return f.where(grep.literal(F.col("content"), "<nav>", False) & grep.literal(F.col("content"), "charset", True)).select("path")


# Path constraints


def _filtered(text: str) -> Query:
    return lambda spark, d: corpus.files(spark, d).where(conjunction(parse(text).constraints, F.col("path"))).select("path")


for _name, _text, _where in (
    ("filter_extension_or", "*.txt *.md x", "path LIKE '%.txt' OR path LIKE '%.md'"),
    ("filter_path_segment", "src1/en/ x", "contains('/' || lower(path), '/src1/en/')"),
    ("filter_path_suffix", "en/doc_7.txt x", "('/' || lower(path)) LIKE '%/en/doc\\_7.txt' ESCAPE '\\'"),
    ("filter_glob", "src1*/{en,fr}/doc_?.txt x", "regexp_full_match(path, 'src1.*/(?:en|fr)/doc_.\\.txt')"),
    ("filter_negated_text", "!doc_1 x", "NOT contains(lower(path), 'doc_1')"),
    ("filter_negated_extension", "!*.md /de/ x", "path NOT LIKE '%.md' AND contains('/' || path, '/de/')"),
    ("filter_type_is_no_filter", "type:rust x", "true"),
    ("filter_status_clean", "status:clean x", "true"),
):
    query(_name, f"WITH {FILES} SELECT path FROM files WHERE {_where}")(_filtered(_text))


# Finding files

ROLE_SQL = (
    "CASE WHEN regexp_matches(lower(path), 'build\\.rs$|/ci/|\\.github/workflows') THEN 'build' WHEN regexp_matches(lower(path), '/tests/|/test/|_test\\.|_spec\\.|test\\.rs$') THEN 'test' "
    "WHEN regexp_matches(lower(path), '\\.mdx?$|/docs/|/doc/') THEN 'docs' WHEN regexp_matches(lower(path), '/tui/|/ui/|/screen/|/component/|/widget/') THEN 'ui' "
    "WHEN regexp_matches(lower(path), '/auth|oauth|login') THEN 'auth' WHEN regexp_matches(lower(path), '/provider|/backend/') THEN 'provider' "
    "WHEN regexp_matches(lower(path), '/config|\\.toml$|\\.json$|\\.yaml$|\\.yml$') THEN 'config' WHEN regexp_matches(lower(path), '/handler|/router|/middleware') THEN 'handler' "
    "WHEN regexp_matches(lower(path), '/src/|^src/') THEN 'implementation' ELSE 'generic' END"
)
ROLE_SCORE_SQL = "CASE role WHEN 'implementation' THEN 20 WHEN 'test' THEN -15 WHEN 'docs' THEN -25 WHEN 'ui' THEN 20 WHEN 'auth' THEN 20 WHEN 'provider' THEN 15 WHEN 'handler' THEN 15 WHEN 'build' THEN -10 ELSE 0 END"


def _page_paths(spark, d):
    return corpus.page_files(spark, d).select("path")


PAGES = "pf AS (SELECT regexp_replace(url, '^https?://', '') AS path, html AS content FROM pages)"


@query("role_classify", f"WITH {PAGES} SELECT path, {ROLE_SQL} AS role FROM pf")
def role_classify(spark, d):
    return _page_paths(spark, d).select("path", paths.role_of(F.col("path")).alias("role"))


@query(
    "find_scored_tokens",
    f"WITH {FILES}, s AS (SELECT path, {ROLE_SQL} AS role, CASE WHEN contains(lower(path), 'src1 doc_1') THEN 100 ELSE 0 END + 25 * (contains(lower(path), 'src1')::INT + contains(lower(path), 'doc_1')::INT) AS hits FROM files) "
    f"SELECT path, role, hits + {ROLE_SCORE_SQL} AS score FROM s WHERE hits > 0 AND hits + {ROLE_SCORE_SQL} >= 1 ORDER BY score DESC, path LIMIT 30",
)
def find_scored_tokens(spark, d):
    return find.token_files(corpus.files(spark, d), "src1 doc_1")


@query(
    "find_substring",
    f"WITH {FILES}, p AS (SELECT path, 'file' AS kind FROM files UNION ALL SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1), 'dir' FROM files), "
    "s AS (SELECT path, kind, CASE WHEN contains(lower(regexp_extract(path, '[^/]*$')), 'c1') THEN 2 WHEN contains(lower(path), 'c1') THEN 1 ELSE 0 END AS score FROM p) SELECT path, kind, score FROM s WHERE score > 0 ORDER BY score DESC, kind DESC, path LIMIT 100",
)
def find_substring(spark, d):
    f = corpus.files(spark, d).select("path")
    dirs = f.select(paths.dir_of(F.col("path")).alias("path")).distinct()
    return find.substring_files(f.withColumn("kind", F.lit("file")).unionByName(dirs.withColumn("kind", F.lit("dir"))), "c1")


def _scored_files(spark, d):
    """Files with a frecency and a git state made from the document: the state's bits are a hash of the id."""
    f = corpus.files(spark, d)
    status = F.element_at(F.array(*(F.lit(x) for x in (0, 256, 128, 1, 2, 512))), (F.col("doc_id") % 6 + 1).cast("int"))
    return f.select("path", (F.col("doc_id") % 13).alias("access_frecency"), (F.col("doc_id") % 5).alias("mod_frecency"), status.alias("git_status"), F.col("doc_id").alias("modified"))


@query("find_fuzzy")
def find_fuzzy(spark, d):
    ctx = find.Context(current_file="src1/en/doc_1.txt")
    return find.fuzzy_files(_scored_files(spark, d), "/en/ dco_12 src1", ctx).select("path", "total", "match_type")


@query("find_mixed")
def find_mixed(spark, d):
    return find.mixed(_scored_files(spark, d), "src1")


STATES = "list_value(0, 256, 128, 1, 2, 512)[(doc_id % 6 + 1)::INT]"


@query(
    "find_by_frecency",
    f"WITH {FILES}, s AS (SELECT path, doc_id % 13 + 4 * (doc_id % 5) AS f, {STATES} AS st, doc_id FROM files) SELECT path, f + CASE WHEN (st & 2435) <> 0 THEN f * 15 // 100 ELSE 0 END AS total FROM s ORDER BY total DESC, doc_id DESC, path LIMIT 100",
)
def find_by_frecency(spark, d):
    return find.fuzzy_files(_scored_files(spark, d), "").select("path", "total")


@query("git_status_labels", f"WITH {FILES} SELECT path, CASE {STATES} WHEN 0 THEN 'clean' WHEN 256 THEN 'modified' WHEN 128 THEN 'untracked' WHEN 1 THEN 'staged_new' WHEN 2 THEN 'staged_modified' ELSE 'deleted' END AS label FROM files")
def git_status_labels(spark, d):
    return _scored_files(spark, d).select("path", paths.status_label(F.col("git_status")).alias("label"))


@query("filter_status_modified", f"WITH {FILES} SELECT path FROM files WHERE ({STATES} & 2435) <> 0")
def filter_status_modified(spark, d):
    return _scored_files(spark, d).where(conjunction(parse("git:mod x").constraints, F.col("path"), F.col("git_status"))).select("path")


ACCESSES = "a AS (SELECT 'user/' || user_id AS path, epoch_us(ts) AS us, event_id FROM events), n AS (SELECT max(us) AS now FROM a)"


@query(
    "frecency_access_score",
    f"WITH {ACCESSES}, x AS (SELECT path, sum(exp(-0.0693::DOUBLE * ((now - us) / 86400e6::DOUBLE))) AS x FROM a, n WHERE (now - us) / 86400e6::DOUBLE <= 30 GROUP BY path) SELECT path, round(CASE WHEN x <= 10 THEN x ELSE 10 + sqrt(x - 10) END)::BIGINT AS access_frecency FROM x",
)
def frecency_access_score(spark, d):
    a = corpus.accesses(spark, d)
    now = a.agg(F.max("us")).first()[0]
    return find.access_scores(a, F.lit(now))


@query("frecency_last_128", f"WITH {ACCESSES}, r AS (SELECT path, us, event_id, row_number() OVER (PARTITION BY path ORDER BY us DESC, event_id DESC) AS n FROM a) SELECT path, us, event_id, n FROM r WHERE n <= 128")
def frecency_last_128(spark, d):
    return find.last_accesses(corpus.accesses(spark, d)).select("path", "us", "event_id", "n")


_STEPS = ((16, 120), (8, 900), (4, 3600), (2, 86400), (1, 604800))
_CHANGE = "CASE WHEN age <= 120 THEN 16 " + " ".join(f"WHEN age <= {b} THEN {p} - floor(({p - q}) * (age - {a})::DOUBLE / {b - a})" for (p, a), (q, b) in zip(_STEPS, _STEPS[1:], strict=False)) + " ELSE 0 END"


@query("modification_score", f"WITH {ACCESSES}, g AS (SELECT event_id, (now - us) // 1000000 AS age FROM a, n) SELECT event_id, ({_CHANGE})::BIGINT AS score FROM g")
def modification_score(spark, d):
    a = corpus.accesses(spark, d)
    now = a.agg(F.max("us")).first()[0]
    age = F.floor((F.lit(now) - F.col("us")) / 1_000_000)
    return a.select("event_id", find.change_score(age, F.lit(True)).alias("score"))


@query(
    "combo_runs",
    "WITH c AS (SELECT user_id AS project, event_type AS query, json_extract_string(props, '$.k') AS file_path, epoch_us(ts) AS us, event_id AS seq FROM events), "
    "m AS (SELECT *, CASE WHEN row_number() OVER o = 1 THEN 1 WHEN file_path IS DISTINCT FROM lag(file_path) OVER o THEN 1 ELSE 0 END AS ch FROM c WINDOW o AS (PARTITION BY project, query ORDER BY us, seq)), "
    "i AS (SELECT *, sum(ch) OVER (PARTITION BY project, query ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS island FROM m), l AS (SELECT project, query, max(island) AS island FROM i GROUP BY ALL) "
    "SELECT i.project, i.query, i.file_path, count(*) AS open_count FROM i JOIN l USING (project, query, island) GROUP BY ALL",
)
def combo_runs(spark, d):
    return find.combo_runs(corpus.completions(spark, d))


@query(
    "history_second_newest",
    "WITH r AS (SELECT user_id AS project, event_type AS query, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT project, query, seq FROM r WHERE k = 2",
)
def history_second_newest(spark, d):
    return find.nth_query(corpus.completions(spark, d), 1).select("project", "query", "seq")


@query("distance_penalty", f"WITH {FILES} SELECT path, CASE WHEN path LIKE 'src1/en/%' THEN 0 WHEN path LIKE 'src1/%' THEN -1 ELSE -2 END AS penalty FROM files")
def distance_penalty(spark, d):
    return corpus.files(spark, d).select("path", paths.distance_penalty("src1/en/doc_1.txt", paths.dir_of(F.col("path"))).alias("penalty"))


# Roll-ups


@query("facets_by_source", "SELECT source AS kind, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total FROM documents GROUP BY source")
def facets_by_source(spark, d):
    return overview.facets(corpus.table(spark, d, "documents"), "source")


_LINE_COUNT = "CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + CASE WHEN right(content, 1) = chr(10) THEN 0 ELSE 1 END END"


@query("language_stats", f"WITH {FILES} SELECT lang, count(*) AS files, sum({_LINE_COUNT})::BIGINT AS code_lines, sum(strlen(content))::BIGINT AS bytes FROM files GROUP BY lang")
def language_stats(spark, d):
    f = corpus.files(spark, d).withColumn("lang", F.split("path", "/")[1])
    return overview.language_stats(f)


@query("workspace_totals", f"WITH {FILES} SELECT count(*) AS files, sum({_LINE_COUNT})::BIGINT AS lines, sum(strlen(content))::BIGINT AS bytes FROM files")
def workspace_totals(spark, d):
    return overview.workspace_totals(corpus.files(spark, d))


@query("top_symbols", f"WITH {TOKENS} SELECT token AS name, count(*) AS definitions FROM tokens GROUP BY token ORDER BY definitions DESC, name LIMIT 20")
def top_symbols(spark, d):
    return overview.top_symbols(corpus.tokens(corpus.files(spark, d)).withColumnRenamed("token", "name"), 20)


@query(
    "tree_rollup",
    f"WITH {FILES}, up AS (SELECT unnest(['', source, source || '/' || lang]) AS dir, unnest([0, 1, 2]) AS depth, strlen(content) AS b FROM files) SELECT dir, depth, sum(b)::BIGINT AS bytes, sum(ceil(b / 4.0::DOUBLE))::BIGINT AS est_tokens, count(*) AS file_count FROM up GROUP BY dir, depth",
)
def tree_rollup(spark, d):
    return overview.tree(corpus.files(spark, d))


@query(
    "top_n_per_file",
    f"WITH {TOKENS}, r AS (SELECT path, token, row_number() OVER (PARTITION BY path ORDER BY length(token) DESC, token) AS rank FROM tokens) SELECT path, token, rank::INT AS rank FROM r WHERE rank <= 3",
)
def top_n_per_file(spark, d):
    t = corpus.tokens(corpus.files(spark, d)).select("path", F.col("token").alias("name"), F.length("token").alias("weight"), F.lit(0).alias("line"))
    return overview.top_per_file(t, 3).select("path", F.col("name").alias("token"), "rank")


@query("stable_dedup", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY source, n_chars ORDER BY doc_id) AS n FROM documents) SELECT source, n_chars, doc_id FROM r WHERE n = 1")
def stable_dedup(spark, d):
    return overview.first_of(corpus.table(spark, d, "documents"), ["source", "n_chars"], ["doc_id"]).select("source", "n_chars", "doc_id")


@query("page_window", f"WITH {FILES}, t AS (SELECT count(*) AS total FROM files) SELECT path, total, total > 20 AS has_more FROM files, t ORDER BY path LIMIT 10 OFFSET 10")
def page_window(spark, d):
    return overview.numbered_page(corpus.files(spark, d).select("path"), ["path"], 10, 10)


@query("page_hosts", f"WITH {PAGES}, u AS (SELECT path, CASE WHEN len(string_split(path, '/')) > 2 THEN string_split(path, '/')[1] || '/' || string_split(path, '/')[2] ELSE string_split(path, '/')[1] END AS key FROM pf) SELECT key, count(*) AS n FROM u GROUP BY key")
def page_hosts(spark, d):
    return graph.count_by(_page_paths(spark, d).withColumn("caller", F.lit(None).cast("string")), "package")


@query("token_totals", f"WITH {FILES} SELECT source, sum(ceil(strlen(content) / 4.0::DOUBLE))::BIGINT AS tokens FROM files GROUP BY source")
def token_totals(spark, d):
    f = corpus.files(spark, d).select(F.split("path", "/")[0].alias("source"), F.octet_length("content").alias("b"))
    return f.groupBy("source").agg(F.sum(estimated_tokens(F.col("b"))).alias("tokens"))


@query("dir_max_frecency", f"WITH {FILES} SELECT source || '/' || lang AS path, max(doc_id % 13) AS frecency FROM files GROUP BY ALL")
def dir_max_frecency(spark, d):
    return find.directories(_scored_files(spark, d))


# Index

_BIGRAMS = (
    FILES + f", c AS (SELECT path, {_low('content')} AS c FROM files), g AS (SELECT path, 0 AS gap, unnest(list_distinct(list_transform(range(1, length(c)), lambda i: substr(c, i, 2)))) AS key FROM c "
    "UNION ALL SELECT path, 1, unnest(list_distinct(list_transform(range(1, length(c) - 1), lambda i: substr(c, i, 1) || substr(c, i + 2, 1)))) FROM c), p AS (SELECT * FROM g WHERE regexp_matches(key, '^[ -~][ -~]$'))"
)


@query("bigram_candidates", f"WITH {_BIGRAMS} SELECT path FROM p WHERE (key, gap) IN (('li', 0), ('ic', 0), ('ce', 0), ('lc', 1), ('ie', 1)) GROUP BY path HAVING count(*) = 5")
def bigram_candidates(spark, d):
    return bigram.candidates(bigram.build(corpus.files(spark, d)), bigram.literal_plan("lice"))


@query("bigram_regex_candidates", f"WITH {_BIGRAMS} SELECT path FROM p GROUP BY path HAVING bool_or(key = 'qu' AND gap = 0) AND (bool_or(key = 'ti' AND gap = 0) OR bool_or(key = 'ta' AND gap = 0))")
def bigram_regex_candidates(spark, d):
    return bigram.candidates(bigram.build(corpus.files(spark, d)), bigram.regex_plan("qu.*t[ia]"))


@query("bigram_density", f"WITH {_BIGRAMS}, n AS (SELECT count(*)::DOUBLE AS n FROM files) SELECT key, gap::TINYINT AS gap, count(*) AS files FROM p, n GROUP BY key, gap, n HAVING count(*) / n >= CASE WHEN gap = 0 THEN 0.031 ELSE 0.12 END AND count(*) / n < 0.9")
def bigram_density(spark, d):
    files = corpus.files(spark, d)
    kept = bigram.prune(bigram.build(files), files.count())
    return kept.groupBy("key", "gap").agg(F.count(F.lit(1)).alias("files"))


_COUNTS: dict[str, dict[tuple[str, int], int]] = {}


def saved_postings(spark, d):
    """The corpus's postings and files for each key, built and saved once for each application and folder, clustered by key."""
    where = f"{shared_dir(spark)}/index/{spark.sparkContext.applicationId}-{zlib.crc32(d.encode()):08x}"
    if where not in _COUNTS:
        if not any(p.endswith("/counts") for p in committed(spark, where)):
            bigram.save(bigram.build(corpus.files(spark, d)), where)
        _COUNTS[where] = bigram.load_counts(spark, where)
    return spark.read.parquet(f"{where}/postings"), _COUNTS[where]


@query("scan_same_literal", f"WITH {LINES} SELECT path, line FROM lines WHERE contains({_low('text')}, 'apache license')")
def scan_same_literal(spark, d):
    """What :func:`grep_through_index` finds, without the index."""
    return grep.literal_lines(corpus.files(spark, d), "apache license").select("path", "line")


@query("grep_regex_fallback", f"WITH {LINES} SELECT path, line FROM lines WHERE contains(text, '***')")
def grep_regex_fallback(spark, d):
    """A pattern that doesn't compile is taken literally."""
    return grep.regex_lines(corpus.files(spark, d), "***").select("path", "line")


@query("grep_regex_classes", f"WITH {LINES} SELECT path, line FROM lines WHERE regexp_matches(text, '\\p{{Lu}}\\p{{Ll}}+tion')")
def grep_regex_classes(spark, d):
    """Unicode classes and a named group."""
    return grep.regex_lines(corpus.files(spark, d), r"(?P<word>\p{Lu}\p{Ll}+)tion").select("path", "line")


@query("grep_through_index", f"WITH {LINES} SELECT path, line FROM lines WHERE contains({_low('text')}, 'apache license')")
def grep_through_index(spark, d):
    files = corpus.files(spark, d)
    postings, counts = saved_postings(spark, d)
    found = bigram.probe(files, postings, bigram.thinned(bigram.literal_plan("apache license"), counts))
    return grep.literal_lines(found, "apache license").select("path", "line")


@query("token_semi_join", f"WITH {TOKENS} SELECT path FROM files WHERE path IN (SELECT path FROM tokens WHERE token = 'License')")
def token_semi_join(spark, d):
    f = corpus.files(spark, d)
    return f.select("path").join(corpus.tokens(f).where(F.col("token") == "License"), "path", "left_semi")


@query(
    "overlay_merge",
    f"WITH {FILES} SELECT path, strlen(content) AS size FROM files WHERE doc_id % 10 NOT IN (0, 1) UNION ALL SELECT path, strlen(content || ' changed') FROM files WHERE doc_id % 10 = 1",
)
def overlay_merge(spark, d):
    """A fold of made-up events: of ten files the first is deleted and the second changed."""
    files = corpus.files(spark, d)
    gone, changed = files.where(F.col("doc_id") % 10 == 0), files.where(F.col("doc_id") % 10 == 1)
    delta = changed.select("path", F.concat("content", F.lit(" changed")).alias("content"))
    return bigram.with_overlay(files.select("path", "content"), gone, delta).select("path", F.octet_length("content").alias("size"))


# Graph over tokens

_USES = LINES + ", tok AS (SELECT DISTINCT path, line, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS token FROM lines), defs AS (SELECT token AS name, arg_min({'path': path, 'line': line}, {'p': path, 'l': line}) AS d FROM tok GROUP BY token)"


def _token_lines(spark, d):
    lines = corpus.lines(corpus.files(spark, d))
    return lines.select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(corpus.IDENTIFIER), F.lit(0)))).alias("token"))


def _definitions(tokens):
    first = tokens.groupBy("token").agg(F.min(F.struct("path", "line")).alias("d"))
    return first.select(F.col("token").alias("name"), F.col("d.path").alias("path"), F.col("d.line").alias("line"))


@query(
    "refs_tokens",
    f"WITH {_USES}, x AS (SELECT d.path AS path, d.line AS line FROM defs WHERE name = 'License') SELECT path, line, 'definition' AS role FROM x UNION ALL SELECT path, line, 'usage' FROM tok WHERE token = 'License' AND (path, line) NOT IN (SELECT (path, line) FROM x)",
)
def refs_tokens(spark, d):
    t = _token_lines(spark, d)
    return graph.references(t, _definitions(t), "License")


_SPANS = (
    ", b AS (SELECT path, line, text, CASE WHEN line % 5 = 1 THEN 1 ELSE 0 END AS s FROM lines), "
    "sp AS (SELECT path, line AS start_line, least(line + 4, max(line) OVER (PARTITION BY path)) AS end_line, 'block_' || ((line - 1) // 5) AS name FROM b WHERE s = 1)"
)


@query("enclosing_range_join", f"WITH {LINES} SELECT path, line, 'block_' || ((line - 1) // 5) AS enclosing FROM lines WHERE contains({_low('text')}, 'license')")
def enclosing_range_join(spark, d):
    """Lines with a hit and the block of five lines around them."""
    from skein.operators.structure import enclosing

    files = corpus.files(spark, d)
    blocks = corpus.lines(files).where((F.col("line") - 1) % 5 == 0)
    blocks = blocks.select("path", F.col("line").alias("start_line"), (F.col("line") + 4).alias("end_line"), F.lit(0).alias("depth"), F.concat(F.lit("block_"), F.floor((F.col("line") - 1) / 5).cast("string")).alias("name"))
    return enclosing(grep.literal_lines(files, "license").select("path", "line"), blocks)


_CALLERS = (
    _USES + ", h1 AS (SELECT path, line FROM tok WHERE token = 'Apache' AND (path, line) NOT IN (SELECT (d.path, d.line) FROM defs WHERE name = 'Apache')), "
    "f2 AS (SELECT DISTINCT 'in_' || regexp_replace(regexp_extract(path, '[^/]*$'), '[^A-Za-z0-9]', '_', 'g') AS t FROM h1)"
)


@query("callers_one_hop", f"WITH {_CALLERS} SELECT path, line, 'Apache' AS target, 1 AS depth FROM h1")
def callers_one_hop(spark, d):
    t = _token_lines(spark, d)
    whole = t.groupBy("path").agg(F.max("line").alias("end_line")).select("path", F.lit(1).alias("start_line"), "end_line", F.lit(0).alias("depth"), F.concat(F.lit("in_"), F.regexp_replace(paths.name_of(F.col("path")), "[^A-Za-z0-9]", "_")).alias("name"))
    return graph.callers(t, _definitions(t), whole, "Apache", hops=2).select("path", "line", "target", "depth")


@query(
    "impact_rank",
    f"WITH {_CALLERS}, x AS (SELECT d.path AS path FROM defs WHERE name = 'Apache'), u AS (SELECT path, count(*) * 3 AS s FROM h1 GROUP BY path UNION ALL SELECT path, 2 FROM files WHERE contains(content, 'Licensed under')) "
    "SELECT path, sum(s)::BIGINT AS score FROM u WHERE path NOT IN (SELECT path FROM x) GROUP BY path",
)
def impact_rank(spark, d):
    """Direct uses of a token weigh three, a mention of its license two."""
    files, t = corpus.files(spark, d), _token_lines(spark, d).where(F.col("token") == "Apache")
    defs = _definitions(t)
    names = spark.createDataFrame([("Apache",)], "target string")
    hits = graph.usages(t, defs, names).withColumn("depth", F.lit(1))
    importers = files.where(F.col("content").contains("Licensed under")).select("path")
    return graph.impact(hits, importers, defs).select("path", "score")


@query("siblings", f"WITH {FILES}, o AS (SELECT source, lang FROM files WHERE doc_id = 7) SELECT path FROM files JOIN o USING (source, lang) WHERE doc_id <> 7")
def siblings(spark, d):
    from skein.operators.structure import siblings as others

    f = corpus.files(spark, d).select(paths.dir_of(F.col("path")).alias("dir"), "path", "doc_id")
    scopes = f.select(F.col("dir").alias("parent_id"), F.col("doc_id").alias("entry_id"), F.col("dir").alias("path"), F.col("path").alias("name"), F.lit("file").alias("kind"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    own = scopes.where(F.col("entry_id") == 7).select("name").first()
    return others(scopes, own[0] if own else "").select(F.col("name").alias("path"))


_LEV = "SELECT DISTINCT token AS name FROM tokens"


@query(
    "did_you_mean",
    f"WITH {TOKENS}, n AS ({_LEV}), l AS (SELECT name, CASE WHEN name IN ('lisence', 'LISENCE', 'Lisence') AND name <> 'lisence' THEN 0 WHEN starts_with(lower(name), 'lisence') AND name <> 'lisence' THEN 1 WHEN levenshtein(lower(name), 'lisence') <= 2 AND name <> 'lisence' THEN 2 END AS layer FROM n) "
    "SELECT name, layer FROM l WHERE layer = (SELECT min(layer) FROM l) ORDER BY name LIMIT 5",
)
def did_you_mean(spark, d):
    return find.did_you_mean(corpus.tokens(corpus.files(spark, d)).withColumnRenamed("token", "name"), "lisence")


# Reading


@query("token_budget", f"WITH {LINES}, r AS (SELECT path, line, sum(strlen(text) + 1) OVER (PARTITION BY path ORDER BY line ROWS UNBOUNDED PRECEDING) AS upto FROM lines) SELECT path, line, upto::BIGINT AS upto FROM r WHERE upto <= {split_budget(1000)['body'] * 4}")
def token_budget(spark, d):
    return read.lines_within(corpus.lines(corpus.files(spark, d)), 1000).select("path", "line", "upto")


@query("read_budgeted")
def read_budgeted(spark, d):
    return corpus.files(spark, d).select("path", read.budgeted(F.col("content"), 500, "minimal").alias("r")).select("path", "r.body", "r.kept_lines", "r.dropped_lines")


@query("mention_tokens", "SELECT conv_id, turn, unnest(regexp_extract_all(text, '(?:^|[\\s(\\[{<\"''])@([^\\s)\\]}>\"'']+)', 1)) AS mention FROM conversations")
def mention_tokens(spark, d):
    return read.mentions(corpus.table(spark, d, "conversations")).select("conv_id", "turn", "mention")


@query("blank_runs", f"WITH {LINES}, w AS (SELECT path, line, trim(text) = '' AS blank, coalesce(lag(trim(text) = '') OVER (PARTITION BY path ORDER BY line), false) AS before FROM lines) SELECT path, line FROM w WHERE NOT (blank AND before)")
def blank_runs(spark, d):
    w = W.partitionBy("path").orderBy("line")
    blank = F.trim("text") == ""
    lines = corpus.lines(corpus.files(spark, d)).withColumn("skip", blank & F.coalesce(F.lag(blank).over(w), F.lit(False)))
    return lines.where(~F.col("skip")).select("path", "line")


@query(
    "accepted_accesses",
)
def accepted_accesses(spark, d):
    from skein.streaming.events import accepted_batch

    return accepted_batch(corpus.accesses(spark, d))


@query("prune_accesses", f"WITH {ACCESSES}, r AS (SELECT path, us, row_number() OVER (PARTITION BY path ORDER BY us DESC) AS k FROM a, n WHERE us >= now - 30 * 86400000000) SELECT path, us FROM r WHERE k <= 128")
def prune_accesses(spark, d):
    from skein.streaming.events import prune_accesses as prune

    a = corpus.accesses(spark, d)
    return prune(a, a.agg(F.max("us")).first()[0]).select("path", "us")


from skein import code_catalog  # noqa: E402, F401  registers the queries over generated code
