"""Path expressions: parts, ancestors, package keys, distance, roles, languages, git states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_of(path: Column) -> Column:
    """The parent without a trailing slash; empty at the root."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def ext_of(path: Column) -> Column:
    """After the last dot of the name, unless the dot is its first character; else empty."""
    return F.regexp_extract(name_of(path), "^.+\\.([^.]*)$", 1)


def ancestors(path: Column) -> Column:
    """All directories above, the root (empty) first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def package_key(path: Column) -> Column:
    """The first two components, or one if the second is the file."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.concat_ws("/", parts[0], parts[1])).otherwise(parts[0])


def distance_penalty(current_file: str | None, directory: Column) -> Column:
    """Minus the number of levels from the current file's directory up to the common one, -20 at least."""
    if current_file is None:
        return F.lit(0)
    here = [p for p in current_file.split("/")[:-1] if p]
    there = F.split(directory, "/")
    common = F.lit(0)
    for i in reversed(range(len(here))):
        common = F.when(F.get(there, F.lit(i)) == here[i], F.lit(1) + common).otherwise(F.lit(0))
    return F.greatest(common - len(here), F.lit(-20))


# Roles with their score, and the tests on the lower-case path, first match wins.
ROLE_SCORES = {"implementation": 20, "test": -15, "docs": -25, "ui": 20, "auth": 20, "provider": 15, "config": 0, "handler": 15, "build": -10, "generic": 0}
ROLE_RULES = (
    ("build", r"build\.rs$|/ci/|\.github/workflows"),
    ("test", r"/tests/|/test/|_test\.|_spec\.|test\.rs$"),
    ("docs", r"\.mdx?$|/docs/|/doc/"),
    ("ui", r"/tui/|/ui/|/screen/|/component/|/widget/"),
    ("auth", r"/auth|oauth|login"),
    ("provider", r"/provider|/backend/"),
    ("config", r"/config|\.toml$|\.json$|\.yaml$|\.yml$"),
    ("handler", r"/handler|/router|/middleware"),
    ("implementation", r"/src/|^src/"),
)


def role_of(path: Column) -> Column:
    low, out = F.lower(path), F.lit("generic")
    for role, rule in reversed(ROLE_RULES):
        out = F.when(low.rlike(rule), role).otherwise(out)
    return out


def role_score(role: Column) -> Column:
    out = F.lit(0)
    for name, score in ROLE_SCORES.items():
        out = F.when(role == name, score).otherwise(out)
    return out


# File types by extension, then by name.
LANGUAGES = {
    "typescript": "ts", "tsx": "tsx", "javascript": "js jsx mjs cjs", "python": "py pyi", "rust": "rs", "go": "go", "java": "java", "scala": "scala sc",
    "c": "c h", "cpp": "cpp hpp cc cxx hh hxx", "ruby": "rb", "php": "php phtml", "swift": "swift", "kotlin": "kt kts", "csharp": "cs", "elixir": "ex exs",
    "verse": "verse", "markdown": "md mdx rst", "structured": "json yaml yml toml xml ini", "tabular": "csv tsv", "log": "log",
}
NAMED = {"dockerfile": ("Dockerfile", "Containerfile"), "make": ("Makefile", "GNUmakefile"), "ruby": ("Vagrantfile", "Rakefile")}
NOT_CODE = ("markdown", "structured", "tabular", "log", "other")


def language_of(path: Column) -> Column:
    ext, name, out = ext_of(path), name_of(path), F.lit("other")
    out = F.when((ext == "") & name.startswith(".env"), "structured").otherwise(out)
    for lang, names in NAMED.items():
        out = F.when((ext == "") & name.isin(*names), lang).otherwise(out)
    for lang, exts in LANGUAGES.items():
        out = F.when(ext.isin(*exts.split()), lang).otherwise(out)
    return out


# Names of manifests, lock files, build files and entry points.
MANIFESTS = ("Cargo.toml", "package.json", "pyproject.toml", "setup.py", "go.mod", "pom.xml", "build.gradle", "build.sbt", "mix.exs")
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "composer.lock", "Gemfile.lock", "poetry.lock", "go.sum", "bun.lockb")
GENERATED_NAME = r"\.min\.js$|\.min\.css$|\.pb\.go$|\.generated\.|_pb2\.py$|_pb2_grpc\.py$|\.designer\.cs$|\.g\.dart$|\.gen\.go$|\.gen\.ts$"
GENERATED_TEXT = r"@generated|DO NOT EDIT|Do not edit|do not edit|auto-generated|Auto-generated|AUTO-GENERATED|[Tt]his file is generated|THIS FILE IS GENERATED|[Aa]utomatically generated"
BUILD_FILES = (
    "Cargo.toml", "Cargo.lock", "pyproject.toml", "setup.py", "setup.cfg", "package.json", "package-lock.json", "yarn.lock", "bun.lockb", "pnpm-lock.yaml", "go.mod",
    "go.sum", "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "Gemfile", "Gemfile.lock", "composer.json", "composer.lock",
    "Makefile", "CMakeLists.txt", "Dockerfile", "flake.nix", "shell.nix", "default.nix", "mix.exs",
)
ENTRYPOINTS = ("main.rs", "lib.rs", "main.py", "__main__.py", "app.py", "manage.py", "main.go", "Main.java", "Application.java", "Program.cs", "main.kt", "main.swift")
ENTRY_MODULES = (
    "mod.rs", "lib.rs", "main.rs", "index.js", "index.jsx", "index.ts", "index.tsx", "index.mjs", "index.cjs", "index.vue", "__init__.py", "__main__.py", "main.go", "main.c",
    "index.php", "main.rb", "index.rb",
)


def is_generated(path: Column, content: Column) -> Column:
    """By name, or by a marker in the first 512 characters."""
    name = name_of(path)
    return name.isin(*LOCK_FILES) | F.lower(name).rlike(GENERATED_NAME) | F.substring(content, 1, 512).rlike(GENERATED_TEXT)


def is_build_file(path: Column) -> Column:
    return name_of(path).isin(*BUILD_FILES)


def is_entrypoint(path: Column) -> Column:
    index = F.lower(name_of(path)).isin("index.ts", "index.tsx", "index.js", "index.mjs")
    return name_of(path).isin(*ENTRYPOINTS) | (index & (path.startswith("src/") | path.contains("/src/") | (F.size(F.split(path, "/")) <= 2)))


def is_test_file(path: Column) -> Column:
    return path.rlike(r"\.test\.|\.spec\.|__tests__/")


# Git status bits.
INDEX_NEW, INDEX_MODIFIED, INDEX_DELETED, INDEX_RENAMED, INDEX_TYPE = 1, 2, 4, 8, 16
WT_NEW, WT_MODIFIED, WT_DELETED, WT_TYPE, WT_RENAMED, IGNORED = 128, 256, 512, 1024, 2048, 16384
DIRTY = WT_MODIFIED | INDEX_MODIFIED | WT_NEW | INDEX_NEW | WT_RENAMED
STAGED = INDEX_NEW | INDEX_MODIFIED | INDEX_DELETED | INDEX_RENAMED | INDEX_TYPE


def has_bits(status: Column, mask: int) -> Column:
    return F.coalesce(status.bitwiseAND(F.lit(mask)) != 0, F.lit(False))


def status_label(status: Column) -> Column:
    """The first that applies; null and 0 are clean, bits without a name unknown."""
    out = F.when(F.coalesce(status, F.lit(0)) == 0, "clean").otherwise("unknown")
    for mask, label in ((IGNORED, "ignored"), (INDEX_DELETED, "staged_deleted"), (INDEX_MODIFIED, "staged_modified"), (INDEX_NEW, "staged_new"), (WT_RENAMED, "renamed"), (WT_DELETED, "deleted"), (WT_MODIFIED, "modified"), (WT_NEW, "untracked")):
        out = F.when(has_bits(status, mask), label).otherwise(out)
    return out


def frecency_word(score: Column) -> Column:
    return F.when(score >= 100, "hot").when(score >= 50, "warm").when(score >= 10, "frequent")
