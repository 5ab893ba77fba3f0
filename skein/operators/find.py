"""Finding files and directories: fuzzy, substring and token scores, frecency, pages."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import fuzzy
from skein.functions.paths import DIRTY, ENTRY_MODULES, dir_of, distance_penalty, has_bits, name_of, role_of, role_score
from skein.functions.text import fold_ascii, fold_text, smart_case
from skein.plans.dsl import FILE_SEARCH, Dialect, parse
from skein.plans.predicates import conjunction

# Decay per day and days looked back, for people and for agents; points by seconds since a change.
DECAY, DAYS = {False: 0.0693, True: 0.231}, {False: 30, True: 7}
CHANGE_POINTS = {False: ((16, 120), (8, 900), (4, 3600), (2, 86400), (1, 604800)), True: ((16, 30), (8, 300), (4, 900), (2, 3600), (1, 14400))}
HISTORY = 128


def access_scores(accesses: DataFrame, now_us: Column, agent: bool = False) -> DataFrame:
    """``path, access_frecency`` from ``accesses(path, us)``: decayed count within the days looked back, compressed above 10.

    Per path only a sum moves, so a file that everybody opens costs no more than another.
    """
    days = (now_us - F.col("us")) / F.lit(86400e6)
    total = accesses.where(days <= DAYS[agent]).groupBy("path").agg(F.sum(F.exp(-F.lit(DECAY[agent]) * days)).alias("x"))
    score = F.when(F.col("x") <= 10, F.col("x")).otherwise(10 + F.sqrt(F.col("x") - 10))
    return total.select("path", F.round(score).cast("long").alias("access_frecency"))


def with_scores(files: DataFrame, accessed: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """``files`` with ``access_frecency`` and ``mod_frecency``, 0 where a file was never opened or hasn't changed."""
    out = files.drop("access_frecency", "mod_frecency").join(accessed.select("path", "access_frecency"), "path", "left")
    out = out.withColumn("mod_frecency", F.lit(0).cast("long")) if changed is None else out.join(changed.select("path", "mod_frecency"), "path", "left")
    return out.fillna(0, ["access_frecency", "mod_frecency"])


def last_accesses(accesses: DataFrame, most: int = HISTORY) -> DataFrame:
    """The newest accesses of each path, numbered from the newest."""
    w = W.partitionBy("path").orderBy(F.desc("us"), F.desc("event_id"))
    return accesses.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def change_score(age_s: Column, dirty: Column, agent: bool = False) -> Column:
    """Points for a recent change of a file that git sees as changed: linear between the steps, in whole numbers."""
    out = F.lit(0).cast("long")
    steps = CHANGE_POINTS[agent]
    for i in reversed(range(len(steps))):
        points, upto = steps[i]
        if i == 0:
            value = F.lit(points).cast("long")
        else:
            before, since = steps[i - 1]
            value = before - F.floor((before - points) * (age_s - since) / F.lit(upto - since))
        out = F.when(age_s <= upto, value.cast("long")).otherwise(out)
    return F.when(dirty, out).otherwise(F.lit(0).cast("long"))


def clamp(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(2**31 - 1)), F.lit(-(2**31))).cast("long")


@dataclass(frozen=True)
class Context:
    """What is known about who asks: the open file, the last pick for the same query and how often it was opened."""

    current_file: str | None = None
    last_pick: str | None = None
    open_count: int = 0
    min_combo: int = 3
    combo_multiplier: int = 100


def combo_boost(path: Column, ctx: Context) -> Column:
    if not ctx.last_pick:
        return F.lit(0)
    value = 1000 if ctx.min_combo == 0 else ctx.open_count * (ctx.combo_multiplier if ctx.open_count >= ctx.min_combo else 5)
    return F.when(F.lit(ctx.last_pick).endswith(path), value).otherwise(0)


def suffix_overlap(path: Column, needle: str) -> Column:
    """How many characters the needle and the path share at their ends, without regard to case."""
    low, n = F.reverse(fold_ascii(path)), fold_text(needle)[::-1]
    out = F.lit(0)
    for i in reversed(range(len(n))):
        out = F.when(F.substring(low, i + 1, 1) == n[i], F.lit(1) + out).otherwise(F.lit(0))
    return out


def total_score(files: DataFrame, needle: str, ctx: Context, typos: int = 2, in_path: bool | None = None) -> DataFrame:
    """The parts of the score for ``files(path, base, end_col, exact, access_frecency, mod_frecency, git_status)`` and their sum.

    Where the needle was found above the file's name, the name alone is matched too (unless the query names a path, ``in_path``); the
    bonus for a name found that way grows with how well it matches.
    """
    in_path = "/" in needle if in_path is None else in_path
    path, base = F.col("path"), F.col("base").cast("long")
    whole = lambda e: F.expr(e)
    name = name_of(path)
    begins = F.greatest(F.col("end_col") - (len(needle) - 1), F.lit(0))
    in_name = begins >= F.length(path) - F.length(name)
    files = files.withColumn("in_name", in_name)
    if in_path:
        files = files.withColumn("again", F.lit(None).cast("struct<score:int,end_col:int,exact:boolean>"))
    else:
        files = files.withColumn("again", fuzzy.path_score(F.when(~F.col("in_name"), name), needle, typos))
    found_again = F.col("again").isNotNull()
    exact = F.coalesce(F.col("again")["exact"], F.lit(False)) | (F.col("in_name") & (fold_ascii(name) == fold_text(needle)))
    most = 16 * len(needle)
    quality = F.least(F.col("again")["score"].cast("long"), F.lit(most))
    entry = name.isin(*ENTRY_MODULES) & F.length(name).between(5, 11)
    f = files.withColumn("base", base).withColumn("frecency", (F.coalesce("access_frecency", F.lit(0)) + 4 * F.coalesce("mod_frecency", F.lit(0))).cast("long"))
    f = f.withColumn("frecency_boost", clamp(whole("base * frecency div 100")))
    f = f.withColumn("git_boost", F.when(has_bits(F.col("git_status"), DIRTY), whole("base * 15 div 100")).otherwise(0))
    f = f.withColumn("distance", distance_penalty(ctx.current_file, dir_of(path)))
    f = f.withColumn("name_bonus", F.when(exact, whole("base div 5 * 2")).when(found_again, F.floor(F.least(whole("base div 6"), F.lit(30)) * quality / most)).when(F.col("in_name"), F.least(whole("base div 6"), F.lit(30))).when(entry, whole("base * 5 div 100")).otherwise(0))
    f = f.withColumn("current_penalty", F.when(path == (ctx.current_file or ""), -whole("base div 4")).otherwise(0))
    f = f.withColumn("combo", combo_boost(path, ctx))
    if "/" in needle:
        f = f.withColumn("overlap", suffix_overlap(path, needle)).withColumn("cover", F.expr(f"overlap * 100 div {len(needle)}"))
        f = f.withColumn("alignment", F.when((F.col("overlap") > 10) & (F.col("cover") >= 30), whole("base * cover div 100")).otherwise(0)).drop("overlap", "cover")
    else:
        f = f.withColumn("alignment", F.lit(0))
    kind = F.when(exact, "exact_filename").when(F.col("in_name") | found_again, "fuzzy_filename").when(F.col("exact"), "exact_path").otherwise("fuzzy_path")
    parts = ("base", "frecency_boost", "git_boost", "distance", "name_bonus", "current_penalty", "combo", "alignment")
    return f.withColumn("match_type", kind).drop("in_name", "again").withColumn("total", clamp(sum((F.col(p) for p in parts), F.lit(0))))


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the order; a top-k, not a sort of everything."""
    return df.orderBy(*order).limit(offset + limit).offset(offset) if limit else df.limit(0)


def fuzzy_files(files: DataFrame, query: str, ctx: Context = Context(), offset: int = 0, limit: int = 100, dialect: Dialect = FILE_SEARCH) -> DataFrame:
    """Ranked files for a query in the search language; without text, by frecency alone.

    Every part of the text must match in what the parts before left. The first part's score is taken whole; each later one is added, and the sum
    divided by the number of parts. Where the match ends is where the first part's does; it is exact if every part's is.
    """
    q = parse(query, dialect)
    f = files.where(conjunction(q.constraints, F.col("path"), F.col("git_status")))
    needles = [p for p in q.parts if len(p) >= 2]
    if not needles:
        return page(frecency_files(f, ctx), [F.desc("total"), F.desc("modified"), "path"], offset, limit)
    f = f.withColumn("base", F.lit(0)).withColumn("end_col", F.lit(0)).withColumn("exact", F.lit(False))
    allowed = min(max(sum(map(len, q.parts)) // 4, 2), 6) if len(needles) == 1 else min(max(len(" ".join(q.parts)) // 4, 2), 6)
    for i, p in enumerate(needles):
        typos = min(allowed, len(p) - 1)
        letters = sorted(set(fold_text(p)))
        near = sum((F.lower("path").contains(c).cast("int") for c in letters), F.lit(0)) >= len(letters) - typos
        m = fuzzy.path_score(F.col("path"), p, typos)
        f = f.where(near).withColumn("m", m).where(F.col("m").isNotNull())
        if i:
            f = f.withColumn("base", F.least(F.floor((F.col("base") + F.col("m.score")) / len(needles)), F.lit(65535)).cast("long")).withColumn("exact", F.col("exact") & F.col("m.exact")).drop("m")
        else:
            f = f.withColumn("base", F.least(F.col("m.score"), F.lit(65535)).cast("long")).withColumn("end_col", F.col("m.end_col")).withColumn("exact", F.col("m.exact")).drop("m")
    scored = total_score(f, needles[0], ctx, min(allowed, len(needles[0]) - 1), any("/" in p for p in q.parts))
    return page(scored, [F.desc("total"), F.desc("modified"), "path"], offset, limit)


def frecency_files(files: DataFrame, ctx: Context = Context()) -> DataFrame:
    f = files.withColumn("frecency", (F.coalesce("access_frecency", F.lit(0)) + 4 * F.coalesce("mod_frecency", F.lit(0))).cast("long"))
    dirty = F.when(has_bits(F.col("git_status"), DIRTY), F.expr("frecency * 15 div 100")).otherwise(0)
    return f.withColumn("total", clamp(F.col("frecency") + dirty - F.when(F.col("path") == (ctx.current_file or ""), F.col("frecency")).otherwise(0)))


def directories(files: DataFrame) -> DataFrame:
    """``path`` (of directories with files), ``frecency``: the highest of their files'."""
    d = files.withColumn("dir", dir_of(F.col("path"))).where(F.col("dir") != "")
    return d.groupBy("dir").agg(F.max(F.coalesce("access_frecency", F.lit(0))).alias("frecency")).withColumnRenamed("dir", "path")


def fuzzy_dirs(dirs: DataFrame, needle: str, offset: int = 0, limit: int = 100) -> DataFrame:
    """Ranked directories; a match of the last component counts 40 percent more if exact and 16 if not."""
    m = fuzzy.path_score(F.col("path"), needle, min(max(len(needle) // 4, 2), 6, max(len(needle) - 1, 0)))
    d = dirs.withColumn("m", m).where(F.col("m").isNotNull()).withColumn("base", F.col("m.score").cast("long"))
    last = name_of(F.col("path"))
    bonus = F.when(fold_ascii(last) == fold_text(needle), F.expr("base div 5 * 2")).when(F.col("m.end_col") >= F.length("path") - F.length(last), F.expr("base * 16 div 100")).otherwise(0)
    d = d.withColumn("total", clamp(F.col("base") + F.expr("base * frecency div 100") + bonus)).drop("m")
    return page(d, [F.desc("total"), "path"], offset, limit)


def mixed(files: DataFrame, query: str, offset: int = 0, limit: int = 100, ctx: Context = Context()) -> DataFrame:
    """Files and directories in one ranking; a query that ends in ``/`` asks for directories."""
    dirs = fuzzy_dirs(directories(files), query.strip().rstrip("/"), 0, 2 * (offset + limit)).select("path", "total", F.lit("dir").alias("kind"))
    if query.strip().endswith("/"):
        return page(dirs, [F.desc("total"), "path"], offset, limit)
    found = fuzzy_files(files, query, ctx, 0, 2 * (offset + limit)).select("path", "total", F.lit("file").alias("kind"))
    return page(found.unionByName(dirs), [F.desc("total"), "kind", "path"], offset, limit)


def substring_files(paths: DataFrame, needle: str, most: int = 100) -> DataFrame:
    """``path, kind, score``: 2 for a hit in the name, 1 in the path; files before directories."""
    low, n = fold_ascii(F.col("path")), fold_text(needle)
    scored = paths.withColumn("score", F.when(name_of(low).contains(n), 2).when(low.contains(n), 1).otherwise(0)).where(F.col("score") > 0)
    return scored.select("path", "kind", "score").orderBy(F.desc("score"), F.desc("kind"), "path").limit(most)


def token_files(files: DataFrame, query: str, threshold: int = 1, most: int = 30) -> DataFrame:
    """``path, role, score``: 100 for the whole query in the path, 25 for each of its words, and the role's score."""
    low, q = F.lower(F.col("path")), query.lower()
    hits = sum((low.contains(t).cast("int") for t in q.split()), F.lit(0)) * 25 + F.when(low.contains(q), 100).otherwise(0)
    f = files.select("path", hits.alias("hits")).where(F.col("hits") > 0)
    f = f.select("path", "hits", F.inline(F.array(F.struct(role_of(F.col("path")).alias("role")))))  # a table function, so that the role is found once a row
    f = f.withColumn("score", F.col("hits") + role_score(F.col("role"))).where(F.col("score") >= threshold)
    return f.select("path", "role", "score").orderBy(F.desc("score"), "path").limit(most)


def named(files: DataFrame, needle: str, limit: int = 200) -> DataFrame:
    """Smart-case substring of the path; without any hit, fuzzy ones with a long common run or half the best score."""
    path = F.col("path") if not smart_case(needle) else F.lower("path")
    hits = files.where(path.contains(needle)).select("path")
    if hits.limit(1).count():
        return hits.orderBy("path").limit(limit)
    @F.pandas_udf("int")
    def run(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: fuzzy.longest_run(needle, p))

    m = fuzzy.path_score(F.col("path"), needle, max(2, len(needle) // 4))
    f = files.select("path", m.alias("m")).where(F.col("m").isNotNull()).withColumn("run", run("path"))
    best = f.agg(F.max("m.score").alias("best"))
    f = f.crossJoin(F.broadcast(best)).where((F.col("run") >= max(-(-len(needle) // 2), 3)) | (F.col("m.score") * 2 >= F.col("best")))  # one row
    return f.select("path", F.col("m.score").alias("score")).orderBy(F.desc("score"), "path").limit(limit)


def two_words(files: DataFrame, query: str, limit: int = 20) -> tuple[DataFrame, bool]:
    """Ranked files, again with the first two of three or more words if nothing was found; whether the best is twice the second."""
    found, words = fuzzy_files(files, query, limit=limit), query.split()
    if len(words) >= 3 and found.limit(1).count() == 0:
        found = fuzzy_files(files, " ".join(words[:2]), limit=limit)
    top = [r["total"] for r in found.select("total").head(2)]
    return found, bool(top) and (len(top) == 1 or top[0] > 2 * top[1])


def combo_runs(completions: DataFrame) -> DataFrame:
    """``project, query, file_path, open_count``: the current run of picks of one file for a query.

    The run is what follows the newest pick of another file. Files are reduced to their newest pick before anything is joined, and picks
    are counted where they are, so a long history needs neither a sort nor one task.
    """
    key, when = ["project", "query"], F.struct("us", "seq")
    newest = completions.groupBy(*key, "file_path").agg(F.max(when).alias("at"))
    last = newest.groupBy(*key).agg(F.max("at").alias("last_at"))
    last = newest.join(last, key).withColumn("is_last", F.col("at") == F.col("last_at"))
    last = last.groupBy(*key).agg(F.max(F.when(F.col("is_last"), F.struct("file_path")))["file_path"].alias("last_file"), F.max(F.when(~F.col("is_last"), F.col("at"))).alias("cut"))
    picks = completions.join(last.withColumnRenamed("project", "p").withColumnRenamed("query", "q"), F.col("project").eqNullSafe(F.col("p")) & F.col("query").eqNullSafe(F.col("q")))
    picks = picks.where(F.col("cut").isNull() | (when > F.col("cut")))
    return picks.groupBy(*key, "last_file").agg(F.count(F.lit(1)).alias("open_count")).withColumnRenamed("last_file", "file_path").select(*key, "file_path", "open_count")


def entry_counts(accesses: DataFrame, completions: DataFrame) -> DataFrame:
    """One row, ``files, accesses, picks, queries``: files with accesses, accesses kept of them, picks, and queries (told apart by project)."""
    per_file = accesses.groupBy("path").agg(F.least(F.count(F.lit(1)), F.lit(HISTORY)).alias("n"))
    kept = per_file.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("accesses"))
    picked = completions.groupBy("project", "query").agg(F.count(F.lit(1)).alias("n"))
    return kept.crossJoin(picked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("picks"), F.count(F.lit(1)).alias("queries")))  # one row each


def nth_query(completions: DataFrame, n: int) -> DataFrame:
    """Each project's ``n``-th newest query, from 0."""
    w = W.partitionBy("project").orderBy(F.desc("us"), F.desc("seq"))
    return completions.withColumn("k", F.row_number().over(w)).where(F.col("k") == n + 1).drop("k")


def did_you_mean(names: DataFrame, query: str, most: int = 5) -> DataFrame:
    """Names like the query: in another case style, else with the query as prefix, else within two edits. The first kind that finds any."""
    words = _words(query)
    styles = {"_".join(words), "-".join(words), "_".join(words).upper(), "".join(w.capitalize() for w in words), words[0] + "".join(w.capitalize() for w in words[1:]) if words else query} - {query}
    low = F.lower("name")
    layer = F.when(F.col("name").isin(*sorted(styles)), 0).when(low.startswith(query.lower()) & (F.col("name") != query), 1).when((F.levenshtein(low, F.lit(query.lower()), 2) >= 0) & (F.col("name") != query), 2)
    found = names.select("name").distinct().withColumn("layer", layer).where(F.col("layer").isNotNull())
    best = found.agg(F.min("layer").alias("best"))
    return found.crossJoin(F.broadcast(best)).where(F.col("layer") == F.col("best")).select("name", "layer").orderBy("name").limit(most)  # one row


def _words(name: str) -> list[str]:
    """Words of a name in any style; a run of capitals is one word, without the capital that begins the next."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


def symbol_score(is_definition: Column, weight: Column, exact: Column, in_comment: Column, frecency: Column) -> Column:
    """A definition's weight in millions, 50 million if exact, less 10 million in a comment (not below 0), ten for each frecency point."""
    first = F.when(is_definition, weight.cast("long") * 1_000_000).otherwise(F.lit(0)) + F.when(exact, 50_000_000).otherwise(0)
    return F.greatest(first - F.when(in_comment, 10_000_000).otherwise(0), F.lit(0)).cast("long") + frecency.cast("long") * 10
