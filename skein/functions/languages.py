"""What declarations and imports look like in each language, read line by line."""

from __future__ import annotations

import re
from bisect import bisect_right

SCRIPTS = ("javascript", "typescript", "tsx")
TYPED = ("c", "cpp", "java", "csharp")  # functions are declared by a type and a name
INDENTED = ("python", "ruby", "elixir")  # blocks end by indentation, braces mean other things

# Files that an import can mean, by language: endings first, then index files.
ENDINGS = {
    "rust": (".rs", "/mod.rs", "/lib.rs"),
    "typescript": (".ts", ".tsx", ".d.ts", ".js", "/index.ts", "/index.tsx", "/index.js"),
    "tsx": (".tsx", ".ts", ".jsx", ".js", "/index.ts", "/index.tsx", "/index.js"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs", "/index.js", "/index.mjs"),
    "python": (".py", "/__init__.py"),
    "go": (".go",),
    "java": (".java",),
    "scala": (".scala", ".sc"),
    "c": (".h", ".c"),
    "cpp": (".hpp", ".hh", ".h", ".cpp", ".cc", ".cxx"),
    "ruby": (".rb",),
    "php": (".php",),
    "swift": (".swift",),
    "kotlin": (".kt", ".kts"),
    "csharp": (".cs",),
    "elixir": (".ex", ".exs"),
    "verse": (".verse",),
}

_DECLARATIONS = (
    ("impl_item", r"impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)"),
    ("method_declaration", r"func\s+\([^)]*\)\s*(\w+)"),
    ("function_item", r"(?:fn|func|function\*?|def|fun)\s+(?:self\.)?(?:[\w<>]+\.)?(\w+[!?]?)"),
    ("class_declaration", r"(?:case\s+|data\s+|sealed\s+)?class\s+(\w+)"),
    ("class_declaration", r"record\s+(\w+)\s*[(<{]"),
    ("struct_item", r"struct\s+(\w+)"),
    ("enum_item", r"enum\s+(?:class\s+)?(\w+)"),
    ("trait_item", r"trait\s+(\w+)"),
    ("interface_declaration", r"(?:interface|protocol)\s+(\w+)"),
    ("object_declaration", r"(?:case\s+|companion\s+)?object\s+(\w+)"),
    ("mod_item", r"(?:mod|module|namespace)\s+([\w.:\\]+)"),
    ("type_item", r"type\s+(\w+)"),
    ("type_definition", r"typedef\s+.*\b(\w+)\s*;"),
    ("const_item", r"const\s+(?:fn\s+)?(\w+)"),
    ("static_item", r"static\s+(?:mut\s+)?(\w+)\s*:"),
    ("lexical_declaration", r"(?:let|var|val)\s+(?:mut\s+)?(\w+)"),
)
_PREFIX = r"^(\s*)(?:(?:pub(?:\([^)]*\))?|export|default|async|abstract|unsafe|final|open|inline|suspend|static|internal|partial|sealed|public|private|protected|override|extern(?:\s+\"C\")?)\s+)*"
_RULES = [(kind, re.compile(_PREFIX + rule)) for kind, rule in _DECLARATIONS]
_ELIXIR = [("elixir_def", re.compile(r"^(\s*)def(?:p|macrop?|guardp?|module|protocol|impl|delegate)?\s+([\w.]+[!?]?)"))]

# What a language's grammar calls a kind, where it isn't the common name.
KINDS = {
    **dict.fromkeys(SCRIPTS, {"function_item": "function_declaration", "const_item": "lexical_declaration", "type_item": "type_alias_declaration", "enum_item": "enum_declaration"}),
    "go": {"function_item": "function_declaration", "const_item": "const_declaration", "type_item": "type_declaration", "lexical_declaration": "var_declaration"},
    "java": {"enum_item": "enum_declaration"},
    "csharp": {"enum_item": "enum_declaration", "mod_item": "namespace_definition"},
    "kotlin": {"function_item": "function_declaration", "lexical_declaration": "property_declaration"},
    "swift": {"function_item": "function_declaration", "struct_item": "class_declaration", "enum_item": "class_declaration", "lexical_declaration": "property_declaration"},
    "php": {"function_item": "function_definition", "trait_item": "trait_declaration", "mod_item": "namespace_definition", "enum_item": "enum_declaration", "const_item": "const_declaration"},
    "scala": {"function_item": "function_definition", "class_declaration": "class_definition", "trait_item": "trait_declaration"},
    "c": {"mod_item": "namespace_definition"},
    "cpp": {"mod_item": "namespace_definition", "class_declaration": "class_definition"},
    "python": {"function_item": "function_definition", "class_declaration": "class_definition"},
}

NOT_CALLS = frozenset("if for while switch match return catch fn func function def sizeof and or not in elif with assert except print_ loop import".split())
_NOT_FIRST = frozenset("return new else throw await yield case goto using typedef delete do if for while switch catch import package struct enum class interface namespace".split())
_MODIFIERS = frozenset("public private protected internal static final abstract synchronized override virtual async sealed native default unsafe extern new partial inline constexpr explicit".split())
_HEAD = re.compile(r"[\w\s:<>,*&\[\]~.?@]*")
_METHOD = re.compile(r"^\s+(?:(?:async|static|get|set|public|private|protected|readonly|override)\s+)*[*#]?([A-Za-z_$][\w$]*)\s*$")


def typed_function(line: str, language: str) -> str | None:
    """The name in ``type name(...)`` where a function is defined; in Java and C# also where it is only declared. Linear in the line."""
    head, paren, rest = line.partition("(")
    if not paren or not _HEAD.fullmatch(head):
        return None
    words = re.findall(r"~?[A-Za-z_]\w*", head)
    name = words[-1] if words else ""
    if len(words) < 2 or not head.rstrip().endswith(name) or words[0] in _NOT_FIRST or name in NOT_CALLS or all(w in _MODIFIERS for w in words[:-1]):
        return None
    tail = rest.rpartition(")")[2].strip() if ")" in rest else rest.strip()[-1:].replace(",", "")
    declared = (language in ("java", "csharp") and tail == ";") or (language == "csharp" and tail.startswith("=>"))
    return name if declared or (";" not in tail and (tail == "" or tail[0] == "{" or re.match(r"const|noexcept|override|final|throws|where|=>|:", tail))) else None


def script_method(line: str) -> str | None:
    """The name of a method in the body of a class or object of a script."""
    head, paren, rest = line.partition("(")
    if not paren or not rest.rstrip().endswith("{") or "=>" in rest:
        return None
    m = _METHOD.match(head)
    return m[1] if m and m[1] not in NOT_CALLS else None


def declaration(line: str, language: str) -> tuple[str, str] | None:
    """``(kind, name)`` of what the line declares. Strings and comments are blanked before."""
    for kind, rule in _ELIXIR if language == "elixir" else _RULES:
        if m := rule.match(line):
            return KINDS.get(language, {}).get(kind, kind), m[2]
    if language in TYPED and (name := typed_function(line, language)):
        return "function_definition" if language in ("c", "cpp") else "method_declaration", name
    if language in SCRIPTS and (name := script_method(line)):
        return "method_definition", name
    return None


_FROM = (re.compile(r"^\s*(?:import|export)\b[^'\"]*['\"]([^'\"]+)['\"]"), re.compile(r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)"), re.compile(r"^\s*\}\s*from\s*['\"]([^'\"]+)['\"]"))
_INCLUDE = (re.compile(r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]"),)
_PYTHON = (re.compile(r"^\s*from\s+([\w.]+)\s+import\b"), re.compile(r"^\s*import\s+([\w.]+)"))
_DOTTED = (re.compile(r"^\s*import\s+(?:static\s+)?(\w+(?:\.\w+)*)"),)
_IMPORTS = {
    "rust": (re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+(?:::)?(\w+(?:::\w+)*)"),),
    **dict.fromkeys(SCRIPTS, _FROM),
    "python": _PYTHON,
    "c": _INCLUDE,
    "cpp": _INCLUDE,
    "java": _DOTTED,
    "kotlin": _DOTTED,
    "swift": _DOTTED,
    "scala": _DOTTED,
    "csharp": (re.compile(r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?(\w+(?:\.\w+)*)\s*;"),),
    "php": (re.compile(r"^\s*use\s+(?:function\s+|const\s+)?\\?(\w+(?:\\\w+)*)"),),
    "ruby": (re.compile(r"^\s*require(?:_relative)?\s*\(?\s*['\"]([^'\"]+)['\"]"),),
    "elixir": (re.compile(r"^\s*(?:alias|import|use|require)\s+([A-Z]\w*(?:\.[A-Z]\w*)*)"),),
    "verse": (re.compile(r"^\s*using\s*\{\s*([^}\s]+)\s*\}"),),
}
_GO_ONE, _GO_SPEC = re.compile(r"^\s*import\s+(?:[\w.]+\s+)?[\"`]([^\"`]+)[\"`]"), re.compile(r"^\s*(?:[\w.]+\s+)?[\"`]([^\"`]+)[\"`]")


def imports(lines: list[str], language: str) -> list[tuple[int, str]]:
    """``(line, specification)`` in order; in Go the lines of an import block too, in Ruby a relative one as a path from here."""
    if language == "go":
        out, block = [], False
        for i, line in enumerate(lines, 1):
            if block and line.lstrip().startswith(")"):
                block = False
            elif m := (_GO_SPEC if block else _GO_ONE).match(line):
                out.append((i, m[1]))
            elif re.match(r"^\s*import\s*\(", line):
                block = True
        return out
    out = []
    for i, line in enumerate(lines, 1):
        for rule in _IMPORTS.get(language, ()):
            if m := rule.search(line):
                near = language == "ruby" and "require_relative" in line and not m[1].startswith(".")
                out.append((i, "./" + m[1] if near else m[1]))
                break
    return out


class Blocks:
    """Where the block that begins on a line ends: at its closing brace, or with the last line that is indented more.

    Each line is looked at a fixed number of times, however deep blocks nest.
    """

    def __init__(self, bare: list[str], braces: bool = True):
        n = len(bare)
        self.bare, self.braces = bare, braces
        self.after, self.closes, self.opens, depth = [], {}, [n] * (n + 1), 0
        for i, line in enumerate(bare):
            before, depth = depth, depth + line.count("{") - line.count("}")
            self.after.append(depth)
            for level in range(depth, before):
                self.closes.setdefault(level, []).append(i)
        for i in reversed(range(n)):
            self.opens[i] = i if "{" in bare[i] else self.opens[i + 1]
        indent = [len(x) - len(x.lstrip()) if x.strip() else -1 for x in bare]
        self.indent = indent
        self.next, self.last, stack, filled = [n] * n, [-1] * (n + 1), [], -1
        for i in range(n):  # the last filled line before each line
            self.last[i] = filled
            filled = i if indent[i] >= 0 else filled
        self.last[n] = filled
        for i in reversed(range(n)):  # the next filled line that is indented no more
            if indent[i] < 0:
                continue
            while stack and indent[stack[-1]] > indent[i]:
                stack.pop()
            self.next[i] = stack[-1] if stack else n
            stack.append(i)

    def _goes_on(self, at: int) -> bool:
        """Whether what is declared on this line has its block on a later one."""
        line = self.bare[at].rstrip()
        following = next((x.lstrip() for x in self.bare[at + 1 : at + 4] if x.strip()), "")
        return line.count("(") > line.count(")") or line.endswith((",", "(", "extends", "implements")) or following.startswith(("{", "where", "throws", ": ", "extends", "implements", "->"))

    def end(self, at: int) -> int:
        """The last line, from 0, of the block that begins on line ``at``."""
        first = self.opens[at]
        if self.braces:
            if ";" in self.bare[at].partition("{")[0].rpartition(")")[2]:
                return at
            if first < len(self.bare) and (first == at or (first <= at + 8 and self._goes_on(at))):
                before = self.after[at - 1] if at else 0
                if self.after[first] <= before:
                    return first
                lines = self.closes.get(before, [])
                k = bisect_right(lines, first)
                return lines[k] if k < len(lines) else len(self.bare) - 1
        stop = self.next[at]
        closed = stop < len(self.bare) and self.bare[stop].strip() == "end" and self.indent[stop] == self.indent[at]
        return stop if closed else max(at, self.last[stop])
