"""Symbols, outlines, calls and imports of source files, one pass over each content.

Python is read with its own parser. Other languages are read by their declaration words, with spans from braces or indentation: names,
kinds, lines and nesting, no types. Kinds carry the same names and weights for all.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import languages
from skein.functions.paths import NOT_CODE, ancestors, dir_of, language_of, name_of

# Weights of definition kinds; others weigh 50.
WEIGHTS = {
    100: "function_declaration function_definition function_item function_expression generator_function method_definition method_declaration class_declaration class_definition "
    "struct_item interface_declaration trait_declaration trait_item enum_item enum_declaration type_item type_declaration type_definition extension_function_definition decorated_definition elixir_def",
    90: "impl_item object_declaration",
    80: "const_item const_declaration static_item",
    70: "mod_item namespace_definition property_declaration",
    40: "lexical_declaration variable_declaration",
    30: "export_statement",
}
WEIGHT = {kind: w for w, kinds in WEIGHTS.items() for kind in kinds.split()}


@dataclass
class Entry:
    """A definition; ``parent`` is the index of the entry that holds it, -1 at the top."""

    kind: str
    name: str
    start: int
    end: int
    parent: int = -1
    depth: int = 0
    signature: str = ""
    doc: str | None = None
    calls: list[tuple[int, str]] = field(default_factory=list)


@dataclass
class Module:
    entries: list[Entry]
    calls: list[tuple[int, str]]
    imports: list[tuple[int, str]]


def _callee(node: ast.expr) -> str | None:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def read_python(source: str) -> Module:
    lines, out = source.split("\n"), Module([], [], [])
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return read_generic(source, "python")

    def walk(node, parent: int, depth: int) -> None:
        for child in ast.iter_child_nodes(node):
            inner, below = parent, depth
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                kind = "decorated_definition" if child.decorator_list else "class_definition" if isinstance(child, ast.ClassDef) else "function_definition"
                out.entries.append(Entry(kind, child.name, first, child.end_lineno or first, parent, depth, lines[child.lineno - 1].strip(), (ast.get_docstring(child) or "").split("\n")[0] or None))
                inner, below = len(out.entries) - 1, depth + 1
            elif isinstance(child, ast.Import):
                out.imports += [(child.lineno, a.name) for a in child.names]
            elif isinstance(child, ast.ImportFrom):
                out.imports.append((child.lineno, "." * child.level + (child.module or "")))
            elif isinstance(child, ast.Assign) and isinstance(node, ast.Module):
                out.entries += [Entry("variable_declaration", t.id, child.lineno, child.end_lineno or child.lineno, parent, depth, lines[child.lineno - 1].strip()) for t in child.targets if isinstance(t, ast.Name)]
            elif isinstance(child, ast.Call) and (name := _callee(child.func)):
                out.calls.append((child.lineno, name))
            walk(child, inner, below)

    walk(tree, -1, 0)
    out.calls.sort()
    return out


_CALL = re.compile(r"\b([A-Za-z_]\w*)\s*!?\(")
_QUOTED = re.compile(r"""//.*|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])'""")


def read_generic(source: str, language: str = "") -> Module:
    lines = source.split("\n")
    out = Module([], [], languages.imports(lines, language))
    bare = [_QUOTED.sub('""', x) for x in lines]
    blocks, around = languages.Blocks(bare, language not in languages.INDENTED), []
    for i, line in enumerate(bare):
        found = languages.declaration(line, language)
        if found:
            doc = lines[i - 1].strip().lstrip("/!").strip() if i and lines[i - 1].strip().startswith(("///", "//!")) else None
            entry = Entry(*found, i + 1, blocks.end(i) + 1, signature=lines[i].strip(), doc=doc)
            while around and out.entries[around[-1]].end <= i:  # blocks that ended before this line
                around.pop()
            parent = next((p for p in reversed(around) if out.entries[p].end >= entry.end), -1)
            entry.parent, entry.depth = parent, out.entries[parent].depth + 1 if parent >= 0 else 0
            around.append(len(out.entries))
            out.entries.append(entry)
        out.calls += [(i + 1, n) for n in _CALL.findall(line) if n not in languages.NOT_CALLS and not (found and n == found[1])]
    return out


def read_module(source: str, language: str) -> Module:
    return read_python(source) if language == "python" else read_generic(source, language)


STRUCTURE = (
    "struct<entries:array<struct<kind:string,name:string,start_line:int,end_line:int,entry_id:int,parent_id:int,depth:int,signature:string,doc:string>>,"
    "calls:array<struct<line:int,callee:string>>,imports:array<struct<line:int,spec:string>>>"
)


def structure(files: DataFrame) -> DataFrame:
    """``path, lang, s`` for code files of ``files(path, content)``: everything a single read of the content gives. Write it once and derive the rest."""

    @F.pandas_udf(STRUCTURE)
    def read(contents: pd.Series, langs: pd.Series) -> pd.DataFrame:
        rows = []
        for c, lang in zip(contents, langs, strict=True):
            m = read_module(c or "", lang)
            rows.append({
                "entries": [{"kind": e.kind, "name": e.name, "start_line": e.start, "end_line": e.end, "entry_id": i, "parent_id": e.parent, "depth": e.depth, "signature": e.signature.encode()[:120].decode(errors="ignore"), "doc": e.doc} for i, e in enumerate(m.entries)],
                "calls": [{"line": a, "callee": b} for a, b in m.calls],
                "imports": [{"line": a, "spec": b} for a, b in m.imports],
            })
        return pd.DataFrame(rows, columns=["entries", "calls", "imports"])

    code = files.withColumn("lang", language_of(F.col("path"))).where(~F.col("lang").isin(*NOT_CODE))
    return code.select("path", "lang", read("content", "lang").alias("s"))


def outline(s: DataFrame) -> DataFrame:
    return s.select("path", "lang", F.explode("s.entries").alias("e")).select("path", "lang", "e.*")


def symbols(s: DataFrame) -> DataFrame:
    """``name, path, line, end_line, kind, weight, lang``."""
    weight = F.lit(50)
    for w, kinds in WEIGHTS.items():
        weight = F.when(F.col("kind").isin(*kinds.split()), w).otherwise(weight)
    return outline(s).select("name", "path", F.col("start_line").alias("line"), "end_line", "kind", weight.alias("weight"), "lang")


def calls(s: DataFrame) -> DataFrame:
    return s.select("path", F.explode("s.calls").alias("c")).select("path", "c.line", "c.callee")


def imports(s: DataFrame) -> DataFrame:
    return s.select("path", "lang", F.posexplode("s.imports").alias("ord", "i")).select("path", "lang", "ord", "i.line", "i.spec")


def enclosing(points: DataFrame, outline: DataFrame, deepest: bool = True) -> DataFrame:
    """``points(path, line, ...)`` with the name of the entry around them, null outside; joined on the path, so no range join over files."""
    spans = outline.select("path", "start_line", "end_line", "depth", "name")
    joined = points.join(spans, "path").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    rank = F.struct(-F.col("depth") if deepest else F.col("depth"), -F.col("start_line") if deepest else F.col("start_line"), "name")
    best = joined.groupBy(*points.columns).agg(F.min(rank)["name"].alias("enclosing"))
    return points.join(best, points.columns, "left")


def resolve_imports(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """``path, ord, spec, resolved``: the first existing of the files that a specification can mean in its language; null if there is none.

    What begins with a dot is tried from the file's directory. ``crate``, ``self`` and ``super`` name Rust's directories, with ever fewer of the
    last segments, which can be items; ``@/`` and ``~/`` are a script's sources. Anything else is tried from the root, then from the
    directories above the file, nearest first. The number of tries depends on the depth of the path, not on the corpus.
    """
    lang, here, spec = F.col("lang"), dir_of(F.col("path")), F.col("spec")
    under = lambda base, tail: F.when(base == "", tail).otherwise(F.concat(base, F.lit("/"), tail))
    dots = F.length(F.regexp_extract("spec", r"^\.*", 0))
    python = F.concat(F.lit("./"), F.repeat(F.lit("../"), dots - 1), F.replace(F.substring(spec, dots + 1, F.length("spec")), F.lit("."), F.lit("/")))
    near = F.when((lang == "python") & (dots > 0), python).otherwise(spec)
    steps = F.filter(F.split(under(here, near), "/"), lambda x: ~x.isin("", "."))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)))
    named = spec.rlike(r"\.(h|hpp|hh|hxx|js|ts|jsx|tsx|mjs|cjs|css|json|rb|php)$") | spec.contains("/")
    cut = F.filter(F.split("spec", r"::|\.|\\\\"), lambda x: (x != "") & ~x.rlike("[{}]"))
    parts = F.when(named, F.array("spec")).otherwise(cut)
    up = F.reverse(ancestors(F.col("path")))
    plain = F.array_join(F.filter(parts, lambda x: ~x.isin("crate", "super", "self")), "/")
    anywhere = F.concat(F.array(plain), F.transform(up, lambda d: under(d, plain)))
    first, rest = F.element_at(parts, 1), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    source = F.coalesce(F.get(F.filter(up, lambda d: d.rlike("(^|/)src$")), F.lit(0)), F.lit("src"))
    base = F.when(first == "crate", source).when(first == "super", dir_of(here)).otherwise(here)
    shorter = F.transform(F.sequence(F.size(rest), F.lit(1), F.lit(-1)), lambda n: under(base, F.array_join(F.slice(rest, F.lit(1), n), "/")))
    stems = (
        F.when((F.size(cut) == 0) & (dots == 0), F.array().cast("array<string>"))
        .when((dots > 0) | spec.startswith("/"), F.array(F.array_join(walked, "/")))
        .when(lang.isin(*languages.SCRIPTS) & spec.rlike("^[@~]/"), F.array(F.concat(F.lit("src/"), F.substring(spec, F.lit(3), F.length("spec"))), F.substring(spec, F.lit(3), F.length("spec"))))
        .when((lang == "rust") & first.isin("crate", "super", "self") & (F.size(rest) > 0), F.concat(shorter, anywhere))
        .otherwise(anywhere)
    )
    endings = F.array(F.lit(""))
    for name, these in languages.ENDINGS.items():
        endings = F.when(lang == name, F.array(F.lit(""), *map(F.lit, these))).otherwise(endings)
    asked = imports.select("path", "lang", "spec").distinct().withColumn("endings", endings)
    tried = F.flatten(F.transform(stems, lambda s: F.transform("endings", lambda e: F.concat(s, e))))
    wide = asked.select("path", "spec", F.posexplode(tried).alias("priority", "candidate"))
    hit = wide.join(paths.select(F.col("path").alias("candidate")).distinct(), "candidate").where(F.col("candidate") != F.col("path"))
    found = hit.groupBy("path", "spec").agg(F.min_by("candidate", "priority").alias("resolved"))
    return imports.select("path", "ord", "spec").join(found, ["path", "spec"], "left").select("path", "ord", "spec", "resolved")


def dependents(resolved: DataFrame, target: str) -> DataFrame:
    """Files that import ``target``, each with its first specification that does."""
    hits = resolved.where(F.col("resolved") == target)
    return hits.groupBy("path").agg(F.min_by("spec", "ord").alias("spec"))


def siblings(outline: DataFrame, name: str, with_imports: bool = False) -> DataFrame:
    """Other children of the scopes that hold ``name``."""
    kept = outline if with_imports else outline.where(F.col("kind") != "import")
    own = kept.where(F.col("name") == name).select("path", "parent_id", F.col("entry_id").alias("own_id"))
    return kept.join(own, ["path", "parent_id"]).where(F.col("entry_id") != F.col("own_id")).select("path", "name", "kind", "start_line", "end_line").distinct()


def package_roots(paths: DataFrame, manifests: tuple[str, ...]) -> DataFrame:
    """``path, root``: the nearest directory above with a manifest."""
    roots = paths.where(name_of(F.col("path")).isin(*manifests)).select(dir_of(F.col("path")).alias("root")).distinct()
    up = paths.select("path", F.explode(ancestors(F.col("path"))).alias("root"))
    return up.join(roots, "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))


_ANCHORS = tuple(
    re.compile(p) for p in (
        r"^\s*export\s+(?:default\s+)?(?:async\s+)?(?:function\*?|class|const|let|var)\s+([A-Za-z_$][\w$]*)", r"^\s*(?:module\.)?exports\.([A-Za-z_$][\w$]*)\s*=",
        r"^\s*define\(\s*['\"]([^'\"]+)['\"]", r"^\s*(?:root|window|global|globalThis)\.([A-Za-z_$][\w$]*)\s*=",
    )
)


def export_anchors(source: str) -> list[tuple[int, str]]:
    """Names that a script exports, by line and name, each once."""
    found = set()
    for i, line in enumerate(source.split("\n"), 1):
        for rule in _ANCHORS:
            if m := rule.search(line):
                found.add((i, m[1]))
        if m := re.match(r"^\s*export\s*\{([^}]*)\}", line):
            found |= {(i, re.split(r"\s+as\s+", x.strip())[-1]) for x in m[1].split(",") if x.strip()}
    return sorted(found)


def anchors(files: DataFrame) -> DataFrame:
    """``path, line, name`` of what the scripts among ``files(path, content)`` export, each once a line."""

    @F.pandas_udf("array<struct<line:int,name:string>>")
    def found(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: [{"line": i, "name": n} for i, n in export_anchors(c or "")])

    scripts = files.where(language_of(F.col("path")).isin(*languages.SCRIPTS))
    return scripts.select("path", F.explode(found("content")).alias("a")).select("path", "a.line", "a.name")


def subclass_lines(lines: DataFrame, name: str) -> DataFrame:
    """Lines that declare a class with ``name`` in their first parentheses."""
    text = F.col("text")
    return lines.where((text.rlike(r"^\s*class ") | text.contains(": class ") | text.contains("<")) & F.regexp_extract("text", r"\(([^)]*)\)", 1).contains(name))


def outline_tree(entries: list[dict], style: str = "agent") -> Iterator[str]:
    """Rendered outline of one file, in entry order."""
    for e in entries:
        pad = "  " * e["depth"]
        if style == "markdown":
            yield f"{pad}- `{e['signature']}` (lines {e['start_line']}-{e['end_line']})"
        elif style == "tabular":
            yield "\t".join(str(e[k]) for k in ("start_line", "end_line", "kind", "name"))
        elif style == "structured":
            yield f"{pad}{e['kind']} {e['name']} {e['start_line']}..{e['end_line']}"
        else:
            yield f"{pad}[{e['start_line']}-{e['end_line']}] {e['signature']}" + (f"  // {e['doc']}" if e["doc"] else "")


def bundle_imports(lines: DataFrame) -> DataFrame:
    """``path, imports``: the leading run of import lines of each file as one text."""
    from skein.operators.grep import is_import_line

    w = W.partitionBy("path").orderBy("line")
    marked = lines.where(F.trim("text") != "").withColumn("other", F.sum((~is_import_line(F.col("text"))).cast("int")).over(w))
    lead = marked.where(F.col("other") == 0)
    return lead.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: F.trim(x["text"])), "; ").alias("imports"))
