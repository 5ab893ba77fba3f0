"""The engine's tables from data that is already in Parquet: documents, pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import line_array

IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content, doc_id`` with ``source/lang/doc_<id>.txt`` as the path."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(path.alias("path"), F.col("text").alias("content"), "doc_id")


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content, doc_id`` of a small program for each document: ``pkg<id % 5>/mod_<id>.py`` imports and calls that of half the id."""
    i, j = F.col("doc_id"), F.floor(F.col("doc_id") / 2).cast("long")
    source = F.format_string(
        "import os\nfrom pkg%d.mod_%d import fn_%d\n\nclass Shape_%d(Base_%d):\n    def area(self):\n        return fn_%d(self)\n\ndef fn_%d(x):\n    y = fn_%d(x)\n    return helper(y)\n",
        j % 5, j, j, i, i % 3, j, i, j,
    )
    d = table(spark, sf_dir, "documents").where(F.col("doc_id").isNotNull())
    more = [("common/util.py", "def helper(x):\n    return x\n")] + [(f"pkg{k}/pyproject.toml", "[project]\n") for k in range(5)]
    fixed = spark.createDataFrame([(p, c, None) for p, c in more], "path string, content string, doc_id long")
    return d.select(F.format_string("pkg%d/mod_%d.py", i % 5, i).alias("path"), source.alias("content"), "doc_id").unionByName(fixed)


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(F.regexp_replace("url", "^https?://", "").alias("path"), F.col("html").alias("content"))


def lines(files: DataFrame) -> DataFrame:
    """``path, line, text``, lines counted from 1."""
    exploded = files.select("path", F.posexplode(line_array(F.col("content"))).alias("pos", "text"))
    return exploded.select("path", (F.col("pos") + 1).alias("line"), "text")


def tokens(files: DataFrame) -> DataFrame:
    """``path, token``, each identifier once per file."""
    found = F.array_distinct(F.regexp_extract_all("content", F.lit(IDENTIFIER), F.lit(0)))
    return files.select("path", F.explode(found).alias("token"))


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, ts``: each user's events as accesses of a file."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``project, query, file_path, us, seq``: a user's picks of a file for a query."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("project"), F.col("event_type").alias("query"), F.get_json_object("props", "$.k").alias("file_path"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("seq"))
