"""Workspace roll-ups: facets, languages, totals, trees, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.paths import ancestors, is_build_file, is_entrypoint, language_of
from skein.functions.text import estimated_tokens


def facets(rows: DataFrame, kind: str) -> DataFrame:
    """``kind, n``, and how many rows there are in all."""
    counts = rows.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("total", F.sum("n").over(W.partitionBy()))  # a row per kind


def language_stats(files: DataFrame, most: int | None = None) -> DataFrame:
    """``lang, files, code_lines, bytes`` of ``files(path, lang?, content)``, most lines first."""
    f = files if "lang" in files.columns else files.withColumn("lang", language_of(F.col("path")))
    count = F.when(F.col("content") == "", 0).otherwise(F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + F.when(F.col("content").endswith("\n"), 0).otherwise(1))
    out = f.groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.sum(count).cast("long").alias("code_lines"), F.sum(F.octet_length("content")).cast("long").alias("bytes"))
    out = out.orderBy(F.desc("code_lines"), "lang")
    return out.limit(most) if most else out


def workspace_totals(files: DataFrame) -> DataFrame:
    stats = language_stats(files)
    return stats.agg(F.sum("files").alias("files"), F.sum("code_lines").alias("lines"), F.sum("bytes").alias("bytes"))


def top_symbols(names: DataFrame, most: int) -> DataFrame:
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("definitions")).orderBy(F.desc("definitions"), "name").limit(most)


def tree(files: DataFrame, most_depth: int | None = None) -> DataFrame:
    """``dir, depth, bytes, est_tokens, file_count`` for every directory, all below included; the root's name is empty."""
    sized = files.select("path", F.octet_length("content").cast("long").alias("b"))
    up = sized.select(F.posexplode(ancestors(F.col("path"))).alias("depth", "dir"), "b")
    if most_depth is not None:
        up = up.where(F.col("depth") <= most_depth)
    return up.groupBy("dir", "depth").agg(F.sum("b").alias("bytes"), F.sum(estimated_tokens(F.col("b"))).alias("est_tokens"), F.count(F.lit(1)).alias("file_count"))


def top_per_file(symbols: DataFrame, most: int) -> DataFrame:
    w = W.partitionBy("path").orderBy(F.desc("weight"), "line", "name")
    return symbols.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def with_symbols(files: DataFrame, symbols: DataFrame, most: int = 5) -> DataFrame:
    """``path, bytes, est_tokens, symbols``: the leaves of a tree with the heaviest definitions of each, null where there are none."""
    best = top_per_file(symbols, most).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "kind", "line"))).alias("symbols"))
    size = F.octet_length("content").cast("long")
    return files.select("path", size.alias("bytes"), estimated_tokens(size).alias("est_tokens")).join(best, "path", "left")


def key_files(files: DataFrame) -> DataFrame:
    """Build files and entry points."""
    kind = F.when(is_build_file(F.col("path")), "build").when(is_entrypoint(F.col("path")), "entrypoint")
    return files.select("path", kind.alias("kind")).where(F.col("kind").isNotNull())


def fnv1a(data: bytes, h: int = 0xCBF29CE484222325) -> int:
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def fingerprint(files: DataFrame) -> str:
    """FNV-1a over path, 0, size and time of change of all files in path order, streamed to the driver partition by partition."""
    h = 0xCBF29CE484222325
    for r in files.select("path", "size", "modified").orderBy("path").toLocalIterator():
        h = fnv1a(r["path"].encode() + b"\0" + int(r["size"]).to_bytes(8, "little") + int(r["modified"]).to_bytes(8, "little"), h)
    return f"{h:016x}"


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the order given."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def numbered_page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page with ``total`` and ``has_more``. The page is a top-k; the total is a count."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.orderBy(*order).limit(offset + limit).offset(offset)
    return page.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)  # one row


def footer(offset: int, shown: int, total: int) -> str:
    more = f" — next: --offset {offset + shown}" if offset + shown < total else ""
    return f"[{offset + 1 if shown else 0}-{offset + shown} of {total}]{more}"
