"""Directory trees as tables: files with contents, ignore rules, git states, and the persisted index."""

from __future__ import annotations

import json
import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.paths import dir_of, ext_of, name_of
from skein.operators import bigram, structure

# Directories left out outside version control, and extensions of binary files.
IGNORED_DIRS = ("node_modules", "__pycache__", "venv", ".venv", "target/debug", "target/release", "target/rust-analyzer", "target/criterion")
BINARY = (
    "png jpg jpeg gif bmp ico webp tiff tif avif heic heif jxl jp2 j2k psd icns cur raw cr2 nef dng tga rgbe hdr exr dds ktx ktx2 pvr astc ai webarchive mhtml "
    "mp4 avi mov wmv mkv mp3 wav flac ogg m4a aac webm flv mpg mpeg wma opus pcm reapeaks zip tar gz bz2 xz 7z rar zst lz4 lzma cab cpio jsonlz4 deb rpm apk dmg msi iso "
    "nupkg whl egg snap appimage flatpak crx pak exe dll so dylib o a lib bin elf pdf doc docx xls xlsx ppt pptx db sqlite sqlite3 mdb sqlite-wal sqlite-shm sqlite3-wal sqlite3-shm "
    "db-wal db-shm ldb ttf otf woff woff2 eot class pyc pyo wasm dex jar war cmi cmt cmti cmx cof cot cop nib swiftdeps swiftdeps~ swiftdoc swiftmodule swiftsourceinfo "
    "npy npz h5 hdf5 pt pth onnx safetensors tfrecord tflite gguf ggml joblib glb fbx blend blp meta dat tfx dia journal toc thm pfl shadow scan flm bcmap userinfo "
    "parquet arrow pb DS_Store suo"
).split()


def binary_name(path: Column) -> Column:
    return F.coalesce(ext_of(path).isin(*BINARY), F.lit(False))


def ignore_regex(rules: str, base: str = "") -> list[tuple[bool, str]]:
    """``(keeps, expression)`` for each line of an ignore file in ``base``; the last that matches a path decides."""
    out = []
    for line in rules.splitlines():
        line = line.rstrip() if not line.endswith("\\ ") else line
        if not line or line.startswith("#"):
            continue
        keeps, line = line.startswith("!"), line.removeprefix("!")
        folder, anchored = line.endswith("/"), "/" in line.rstrip("/")
        body = re.escape(line.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"/\*\*", "/.*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        body = re.sub(r"\\\[(.*?)\\\]", lambda m: "[" + m[1].replace("\\-", "-").replace("!", "^", 1) + "]", body)
        at = re.escape(base + "/") if base else ""
        out.append((keeps, f"^{at}{'' if anchored else '(?:.*/)?'}{body}{'/.*' if folder else '(?:/.*)?'}$"))
    return out


def not_ignored(path: Column, rules: list[tuple[bool, str]]) -> Column:
    keep = F.lit(True)
    for keeps, expression in rules:
        keep = F.when(path.rlike(expression), keeps).otherwise(keep)
    return keep


def unlisted(spark: SparkSession, root: str) -> list[str]:
    """Files and folders below ``root`` that Spark's listing passes over because their names begin with a dot or an underscore."""
    start = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = start.getFileSystem(spark._jsc.hadoopConfiguration())
    found, folders = [], [start]
    while folders:
        for entry in store.listStatus(folders.pop()):
            path, name = entry.getPath(), entry.getPath().getName()
            if name == ".git":
                continue
            if name[0] in "._":
                found.append(path.toString())
            if entry.isDirectory():
                folders.append(path)
    return found


def tree_rules(spark: SparkSession, root: str, names: tuple[str, ...] = (".gitignore", ".ignore")) -> list[tuple[bool, str]]:
    """The rules of all ignore files below ``root``, outer folders first, so that the nearest file has the last word."""
    root = root.rstrip("/")
    found = [p for p in unlisted(spark, root) if p.rsplit("/", 1)[-1] in names]
    if not found:
        return []
    bare = lambda p: re.sub(r"^\w+:(//[^/]*(?=/))?", "", p)
    jvm, placed = spark._jvm, []
    for name in found:  # Spark's readers pass over names that begin with a dot; these files are few and small
        path = jvm.org.apache.hadoop.fs.Path(name)
        stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
        try:
            placed.append((bare(name)[len(bare(root)) + 1 :], jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()
    out: list[tuple[bool, str]] = []
    for path, text in sorted(placed, key=lambda x: (x[0].count("/"), x[0])):
        out += ignore_regex(text, path.rsplit("/", 1)[0] if "/" in path else "")
    return out


def walk(spark: SparkSession, root: str, in_git: bool = True, rules: list[tuple[bool, str]] = (), most: int = 10 * 1024 * 1024) -> DataFrame:
    """``path, dir, name, ext, size, modified, is_binary, content`` of the files below ``root``, on any store that Spark reads.

    ``.git`` is never read. In version control hidden files stay and ignore rules hold; outside, hidden files, binary
    extensions and common build folders go. Contents of files above ``most`` bytes are null; a byte-order mark is taken off.
    """
    root = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([root, *unlisted(spark, root)])
    full = F.regexp_replace(F.col("path"), r"^\w+:(//[^/]*(?=/))?", "")
    prefix = re.sub(r"^\w+:(//[^/]*(?=/))?", "", root)
    f = raw.select(F.substring(full, len(prefix) + 2, 1 << 20).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    p = F.col("path")
    f = f.where(~p.rlike(r"(^|/)\.git/"))
    if in_git:
        f = f.where(not_ignored(p, list(rules)))
    else:
        folders = "|".join(re.escape(d) for d in IGNORED_DIRS)
        f = f.where(~p.rlike(r"(^|/)\.[^/]") & ~p.rlike(f"(^|/)({folders})/") & ~binary_name(p))
    nul = F.instr(F.decode(F.col("content"), "ISO-8859-1"), "\0") > 0
    f = f.withColumn("is_binary", binary_name(p) | F.coalesce(nul, F.lit(False)))
    text = F.regexp_replace(F.decode(F.col("content"), "UTF-8"), "^\ufeff", "")
    f = f.withColumn("content", F.when((F.col("size") <= most) & ~F.col("is_binary"), text))
    return f.select("path", dir_of(p).alias("dir"), name_of(p).alias("name"), ext_of(p).alias("ext"), "size", "modified", "is_binary", "content")


def dir_table(files: DataFrame, empty: DataFrame | None = None) -> DataFrame:
    d = files.select("dir").distinct()
    return d if empty is None else d.union(empty.select("dir")).distinct()


_CODES = {"index": {"A": 1, "M": 2, "D": 4, "R": 8, "T": 16}, "tree": {"M": 256, "D": 512, "T": 1024, "R": 2048}}


def parse_status(output: str) -> list[tuple[str, int]]:
    """``(path, bits)`` from ``git status --porcelain=v1 -z``."""
    out, fields = [], iter(output.split("\0"))
    for entry in fields:
        if len(entry) < 4:
            continue
        x, y, path = entry[0], entry[1], entry[3:]
        if x in "RC":
            next(fields, None)  # the name before
        bits = 128 if x + y == "??" else 16384 if x + y == "!!" else _CODES["index"].get(x, 0) | _CODES["tree"].get(y, 0)
        out.append((path, bits))
    return out


def git_status(spark: SparkSession, root: str) -> DataFrame:
    """``path, status`` of what differs from the last commit, submodules left out; one listing, made where the driver runs."""
    done = subprocess.run(["git", "-C", root, "status", "--porcelain=v1", "-z", "--untracked-files=all", "--ignore-submodules=all"], capture_output=True, text=True, check=True)
    return spark.createDataFrame(parse_status(done.stdout), "path string, status int")


SCHEMA_VERSION = 1


def save_index(files: DataFrame, where: str, head: str = "") -> None:
    """Write files, structure and postings below ``where``; the meta row comes last, so a half-written index has none."""
    spark = files.sparkSession
    files.drop("content").write.mode("overwrite").parquet(f"{where}/files")
    structure.structure(files).write.mode("overwrite").parquet(f"{where}/structure")
    bigram.build(files.where(F.col("content").isNotNull())).repartitionByRange("key").sortWithinPartitions("key", "gap", "path").write.mode("overwrite").parquet(f"{where}/postings")
    n = spark.read.parquet(f"{where}/files").count()
    spark.createDataFrame([(json.dumps({"schema": SCHEMA_VERSION, "head": head, "files": n}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{where}/meta")


def load_index(spark: SparkSession, where: str, head: str = "", n_files: int | None = None) -> dict[str, DataFrame] | None:
    """The saved tables, or None if they are of another schema or commit, or file counts differ by over 5 percent and 10."""
    try:
        meta = json.loads(spark.read.text(f"{where}/meta").first()[0])
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    drift = abs(meta["files"] - n_files) if n_files is not None else 0
    if meta["schema"] != SCHEMA_VERSION or meta["head"] != head or drift > max(meta["files"] // 20, 10):
        return None
    return {name: spark.read.parquet(f"{where}/{name}") for name in ("files", "structure", "postings")}


def changes(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths that vanished, and rows of ``new`` that are new or have another size or time."""
    gone = old.select("path").join(new.select("path"), "path", "left_anti")
    known = old.select("path", F.col("size").alias("_s"), F.col("modified").alias("_m"))
    fresh = new.join(known, "path", "left").where(F.col("_s").isNull() | (F.col("_s") != F.col("size")) | (F.col("_m") != F.col("modified"))).drop("_s", "_m")
    return gone, fresh


def refresh_structure(saved: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Structure of the tree as it is now: files that didn't change aren't read again."""
    gone, fresh = changes(old, new)
    touched = gone.union(fresh.select("path"))
    return saved.join(touched, "path", "left_anti").unionByName(structure.structure(fresh))
