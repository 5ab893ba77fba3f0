"""Callers, callees, references and change impact over name-keyed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.paths import dir_of, package_key
from skein.plans.storage import materialize

HUB_GUARD = 200
MOST_HOPS = 5


def usages(tokens: DataFrame, definitions: DataFrame, names: DataFrame) -> DataFrame:
    """``path, line, target``: lines that hold a wanted name and don't define it. ``tokens(path, line, token)``, ``names(target)``."""
    hits = tokens.join(names, F.col("token") == F.col("target")).select("path", "line", "target").distinct()
    return hits.join(definitions.select("path", "line", F.col("name").alias("target")), ["path", "line", "target"], "left_anti")


def callers(tokens: DataFrame, definitions: DataFrame, outline: DataFrame, name: str, hops: int = 1, hub_guard: int = HUB_GUARD, skip: tuple[str, ...] = ()) -> DataFrame:
    """``path, line, target, depth, caller``: who uses ``name``, who uses those, and so on; names in ``skip`` aren't looked up after the first hop.

    A line is reported once, at the smallest depth, for the alphabetically first target. Names with more than ``hub_guard``
    hits are reported but not followed. Each hop is written to shared storage, so lineage stays short.
    """
    spark = tokens.sparkSession
    frontier, seen, known = spark.createDataFrame([(name,)], "target string"), None, spark.createDataFrame([(name,)], "target string")
    for depth in range(1, min(hops, MOST_HOPS) + 1):
        hits = usages(tokens, definitions, frontier)
        if seen is not None:
            hits = hits.join(seen.select("path", "line"), ["path", "line"], "left_anti")
        hits = hits.groupBy("path", "line").agg(F.min("target").alias("target"))
        spans = outline.select("path", "start_line", "end_line", F.col("depth").alias("d"), F.col("name").alias("caller"))
        around = hits.join(spans, (hits.path == spans.path) & hits.line.between(spans.start_line, spans.end_line), "left").select(hits.path, hits.line, "target", "d", "start_line", "caller")
        best = around.groupBy("path", "line", "target").agg(F.max(F.struct("d", "start_line", "caller"))["caller"].alias("caller"))
        step = materialize(best.withColumn("depth", F.lit(depth)), "hop")
        seen = step if seen is None else seen.unionByName(step)
        quiet = step.groupBy("target").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= hub_guard)
        nxt = step.join(quiet, "target").where(F.col("caller").isNotNull()).select(F.col("caller").alias("target")).distinct()
        frontier = materialize(nxt.where(~F.col("target").isin(*skip)).join(known, "target", "left_anti"), "frontier")
        known = known.union(frontier)
        if depth == hops or frontier.limit(1).count() == 0:
            break
    return seen


def count_by(hits: DataFrame, key: str) -> DataFrame:
    """``key, n`` by caller, file or package, most first."""
    column = {"caller": F.coalesce("caller", F.lit("<unknown>")), "file": F.col("path"), "package": package_key(F.col("path"))}[key]
    return hits.groupBy(column.alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key")


def hub_counts(hits: DataFrame, hub_guard: int = HUB_GUARD) -> DataFrame:
    """``depth, target, n, is_hub``: hits of each name that was looked up, and whether it has too many to be followed."""
    n = hits.groupBy("depth", "target").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("is_hub", F.col("n") > hub_guard)


def suspicious(definitions: DataFrame, roots: DataFrame) -> DataFrame:
    """Names defined under two package roots or more: a hop through them can cross unrelated code."""
    return definitions.join(roots, "path").groupBy("name").agg(F.countDistinct("root").alias("roots")).where(F.col("roots") >= 2)


def proximity(hits: DataFrame) -> DataFrame:
    """``depth, total, related``: hits of depth two and more, and those in a directory that the depth before had hits in."""
    placed = hits.select("depth", dir_of(F.col("path")).alias("dir"))
    before = placed.select((F.col("depth") + 1).alias("depth"), "dir").distinct().withColumn("near", F.lit(1))
    joined = placed.where(F.col("depth") >= 2).join(before, ["depth", "dir"], "left")
    out = joined.groupBy("depth").agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("near"), F.lit(0)).alias("related"))
    return out.withColumn("scattered", (F.col("total") >= 50) & (F.col("related") * 5 < F.col("total")))


def callees(calls: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """``callee, path, line, kind``: definitions, in the same language, of what the bodies of ``name`` call."""
    own = symbols.where(F.col("name") == name).select("path", F.col("line").alias("start"), "end_line", "lang")
    inside = calls.join(own, "path").where(F.col("line").between(F.col("start"), F.col("end_line"))).select("callee", "lang").distinct()
    targets = symbols.where(F.col("name") != name).select(F.col("name").alias("callee"), "lang", "path", "line", "kind")
    return inside.join(targets, ["callee", "lang"]).select("callee", "path", "line", "kind")


def callees_within(calls: DataFrame, symbols: DataFrame, name: str, hops: int) -> DataFrame:
    """``callee, path, line, depth``: callees of callees, each definition once at the smallest depth."""
    spark, seen = calls.sparkSession, None
    frontier = spark.createDataFrame([(name,)], "name string")
    for depth in range(1, min(hops, MOST_HOPS) + 1):
        own = symbols.join(frontier, "name").select("name", "path", F.col("line").alias("start"), "end_line", "lang")
        inside = calls.join(own, "path").where(F.col("line").between(F.col("start"), F.col("end_line")) & (F.col("callee") != F.col("name"))).select("callee", "lang").distinct()
        hits = inside.join(symbols.select(F.col("name").alias("callee"), "lang", "path", "line"), ["callee", "lang"]).select("callee", "path", "line").distinct()
        if seen is not None:
            hits = hits.join(seen.select("path", "line"), ["path", "line"], "left_anti").select("callee", "path", "line")
        step = materialize(hits.withColumn("depth", F.lit(depth)), "callees")
        seen = step if seen is None else seen.unionByName(step)
        frontier = step.select(F.col("callee").alias("name")).distinct()
        if step.limit(1).count() == 0:
            break
    return seen


def references(tokens: DataFrame, definitions: DataFrame, name: str) -> DataFrame:
    """``path, line, role``: where a name is defined and where it is used."""
    tokens, own = tokens.where(F.col("token") == name), definitions.where(F.col("name") == name)
    names = tokens.sparkSession.createDataFrame([(name,)], "target string")
    defs = own.select("path", "line", F.lit("definition").alias("role"))
    return defs.unionByName(usages(tokens, own, names).select("path", "line", F.lit("usage").alias("role")))


def impact(hits: DataFrame, importers: DataFrame | None, defining: DataFrame) -> DataFrame:
    """``path, score, reasons``: three for each direct use, two for an import, one for each use further away; defining files left out."""
    direct = hits.where(F.col("depth") == 1).groupBy("path").agg(F.count(F.lit(1)).alias("n")).select("path", (F.col("n") * 3).alias("s"), F.lit("direct").alias("why"))
    far = hits.where(F.col("depth") > 1).groupBy("path").agg(F.count(F.lit(1)).alias("n")).select("path", F.col("n").alias("s"), F.lit("transitive").alias("why"))
    parts = direct.unionByName(far)
    if importers is not None:
        parts = parts.unionByName(importers.groupBy("path").agg(F.count(F.lit(1)).alias("n")).select("path", (F.col("n") * 2).alias("s"), F.lit("imports").alias("why")))
    ranked = parts.join(defining.select("path").distinct(), "path", "left_anti").groupBy("path").agg(F.sum("s").alias("score"), F.array_sort(F.collect_set("why")).alias("reasons"))
    return ranked.orderBy(F.desc("score"), "path")


def mentions_of_stems(files: DataFrame, defining: DataFrame) -> DataFrame:
    """``path`` of files whose text holds the name, without ending, of another file that defines the symbol; defining files left out.

    The names are as many as files define the one symbol; each text is held against each of them, so this suits symbols that few files define.
    """
    own = defining.select("path").distinct()
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    stems = own.select(stem.alias("stem")).where(F.col("stem") != "").distinct()
    rest = files.join(own, "path", "left_anti").select("path", "content")
    return rest.join(stems, F.col("content").contains(F.col("stem")), "left_semi").select("path")


def impact_by_text(hits: DataFrame, files: DataFrame, defining: DataFrame) -> DataFrame:
    """``path, score``: three for each direct use and two where the text names a defining file; a rougher measure than :func:`impact`."""
    direct = hits.where(F.col("depth") == 1).groupBy("path").agg((F.count(F.lit(1)) * 3).alias("s"))
    parts = direct.unionByName(mentions_of_stems(files, defining).select("path", F.lit(2).cast("long").alias("s")))
    return parts.groupBy("path").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "path")
