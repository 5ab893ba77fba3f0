"""One object for all questions about a code base: loads or builds the tables and answers with DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.paths import MANIFESTS
from skein.operators import bigram, cards, find, graph, grep, overview, read, structure
from skein.plans import classify, dsl
from skein.sources import corpus, tree


class Engine:
    """``files(path, content, ...)`` and what is derived from them. Columns for ranking are optional: ``access_frecency, mod_frecency, git_status, modified``."""

    def __init__(self, files: DataFrame, structures: DataFrame | None = None, postings: DataFrame | None = None):
        defaults = {"access_frecency": "0", "mod_frecency": "0", "git_status": "cast(null as int)", "modified": "0"}
        for c, value in defaults.items():
            if c not in files.columns:
                files = files.withColumn(c, F.expr(value))
        self.spark, self.files = files.sparkSession, files
        self.structures = structure.structure(files) if structures is None else structures
        self.postings = postings
        self.cursors = classify.Cursors()

    @classmethod
    def over(cls, spark: SparkSession, root: str, in_git: bool = True, rules: str = "") -> Engine:
        return cls(tree.walk(spark, root, in_git, tree.ignore_regex(rules) + tree.tree_rules(spark, root)).where(F.col("content").isNotNull()))

    @classmethod
    def saved(cls, spark: SparkSession, root: str, index: str, head: str = "", in_git: bool = True, rules: str = "") -> Engine:
        """From the index if it is valid, else built and saved; files changed since the index was made are read again."""
        files = tree.walk(spark, root, in_git, tree.ignore_regex(rules) + tree.tree_rules(spark, root)).where(F.col("content").isNotNull())
        tables = tree.load_index(spark, index, head, files.count())
        if tables is None:
            tree.save_index(files, index, head)
            tables = tree.load_index(spark, index, head)
        structures = tree.refresh_structure(tables["structure"], tables["files"], files)
        gone, fresh = tree.changes(tables["files"], files)
        postings = bigram.with_overlay(tables["postings"], gone, bigram.build(fresh))
        return cls(files, structures, postings)

    @property
    def symbols(self) -> DataFrame:
        return structure.symbols(self.structures)

    @property
    def tokens(self) -> DataFrame:
        words = F.array_distinct(F.regexp_extract_all("text", F.lit(corpus.IDENTIFIER), F.lit(0)))
        return corpus.lines(self.files).select("path", "line", F.explode(words).alias("token"))

    def grep(self, query: str, mode: str = "auto", page: int | None = None) -> DataFrame:
        scope = self.files
        q = dsl.parse(query, dsl.GREP)
        if self.postings is not None and not q.constraints and q.parts:
            scope = bigram.probe(scope, self.postings, self._plan(q.search_text(), mode))
        ranks = self.files.select("path", F.col("access_frecency").alias("frecency"), "modified") if page else None
        return grep.search(scope, query, mode=mode, page=page, status=F.col("git_status"), ranks=ranks)

    def _plan(self, text: str, mode: str) -> bigram.Plan:
        """What files must hold that a search in this mode can find the text in."""
        if mode == "fuzzy":
            return bigram.fuzzy_lines_plan(text, min(len(text) // 3, 2), max(len(text) // 3, 2))
        if mode == "regex" or (mode == "auto" and grep.looks_like_regex(text)):
            return bigram.literal_plan(text) if grep.valid_regex(self.spark, text) else bigram.regex_plan(grep.engine_regex(text))
        return bigram.literal_plan(text)

    def find(self, query: str, ctx: find.Context = find.Context(), offset: int = 0, limit: int = 100) -> DataFrame:
        return find.fuzzy_files(self.files, query, ctx, offset, limit)

    def find_mixed(self, query: str, offset: int = 0, limit: int = 100) -> DataFrame:
        return find.mixed(self.files, query, offset, limit)

    def glob(self, pattern: str, most: int = 1000) -> DataFrame:
        return cards.glob_files(self.files, pattern, most)

    def symbol(self, query: str) -> DataFrame:
        return cards.symbol_query(self.symbols, query)

    def outline(self, path: str) -> DataFrame:
        return structure.outline(self.structures.where(F.col("path") == path)).orderBy("entry_id")

    def callers(self, name: str, hops: int = 1, hub_guard: int = graph.HUB_GUARD, skip: tuple[str, ...] = ()) -> DataFrame:
        code = structure.outline(self.structures).where(~F.col("kind").startswith("variable"))
        return graph.callers(self.tokens, self.symbols, code, name, hops, hub_guard, skip)

    def callees(self, name: str, hops: int = 1) -> DataFrame:
        calls = structure.calls(self.structures)
        return graph.callees(calls, self.symbols, name) if hops == 1 else graph.callees_within(calls, self.symbols, name, hops)

    def callees_detailed(self, name: str) -> DataFrame:
        return cards.callees_detailed(self.files, self.symbols, name)

    def refs(self, name: str) -> DataFrame:
        return graph.references(self.tokens, self.symbols, name)

    def flow(self, name: str, total_tokens: int = 4000) -> DataFrame:
        return cards.flow(self.files, self.symbols, structure.calls(self.structures), self.callers(name), name, total_tokens)

    def siblings(self, name: str) -> DataFrame:
        return structure.siblings(structure.outline(self.structures), name)

    def deps(self) -> DataFrame:
        return structure.resolve_imports(structure.imports(self.structures), self.files.select("path"))

    def dependents(self, path: str) -> DataFrame:
        return structure.dependents(self.deps(), path)

    def impact(self, name: str, hops: int = 3) -> DataFrame:
        own = self.symbols.where(F.col("name") == name)
        importers = self.deps().join(own.select(F.col("path").alias("resolved")).distinct(), "resolved", "left_semi").select("path")
        return graph.impact(self.callers(name, hops), importers, own)

    def suspicious(self) -> DataFrame:
        return graph.suspicious(self.symbols, structure.package_roots(self.files.select("path"), MANIFESTS))

    def map(self, most_depth: int | None = None) -> DataFrame:
        return overview.tree(self.files, most_depth)

    def leaves(self, symbols: int = 5) -> DataFrame:
        return overview.with_symbols(self.files, self.symbols, symbols)

    def views(self, mode: str = "outline", total_tokens: int = 25_000) -> DataFrame:
        return read.views(self.files, self.structures, mode, total_tokens)

    def section(self, path: str, line: int) -> DataFrame:
        points = self.spark.createDataFrame([(path, line)], "path string, line int")
        return read.sections(self.files, self.structures, points)

    def exports(self) -> DataFrame:
        return structure.anchors(self.files)

    def mentioned(self, text: str, total_tokens: int = 4000) -> DataFrame:
        return read.mentioned(self.files, text, total_tokens)

    def overview(self, most: int = 10) -> dict[str, DataFrame]:
        return {"languages": overview.language_stats(self.files, most), "totals": overview.workspace_totals(self.files), "symbols": overview.top_symbols(self.symbols, most), "key_files": overview.key_files(self.files)}

    def did_you_mean(self, name: str) -> DataFrame:
        return find.did_you_mean(self.symbols, name)

    def read(self, target: str, total_tokens: int = 4000, level: str = "none") -> dict:
        """``path``, ``path:12`` or ``path:12-40``; a bare file name is looked up."""
        path, location = classify.parse_location(target)
        if not self.exists(path):
            names = read.resolve_name(self.files, path)
            if len(names) != 1:
                return {"kind": "candidates", "paths": names}
            path = names[0]
        span = (location.start[0], (location.end or location.start)[0]) if location else None
        return read.resolve_mention(self.files, read.Trigger(0, len(path), path, False, span), total_tokens, level)

    def mention(self, text: str, cursor: int, total_tokens: int = 4000) -> dict | None:
        trigger = read.detect_trigger(text, cursor)
        return None if trigger is None else read.resolve_mention(self.files, trigger, total_tokens)

    def exists(self, path: str) -> bool:
        return self.files.where(F.col("path") == path).limit(1).count() > 0

    def ask(self, raw: str):
        """The kind of the query and its answer."""
        some = lambda df: df if df.limit(1).count() else None
        return classify.dispatch(
            raw, self.exists, lambda n: some(self.symbol(n)), lambda n: some(self.symbol(n + "*")), self.glob, lambda p, loc: self.read(p if loc is None else f"{p}:{loc.start[0]}"), self.grep
        )


def emit(rows: DataFrame, form: str = "json", most: int = 1000) -> str:
    """A page of results as JSON without nulls, or as tab-separated text."""
    page = rows.limit(most)
    if form == "json":
        return "[" + ",".join(r[0] for r in page.select(F.to_json(F.struct(*page.columns))).collect()) + "]"
    cells = lambda v: v if isinstance(v, str) else json.dumps(v, default=str)
    return "\n".join("\t".join(cells(v) for v in r) for r in page.collect())
