"""The query language: free text mixed with constraints such as ``*.rs``, ``!test/``, ``status:modified`` and ``name:12``."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from skein.plans.location import Location, parse_location

WILDCARDS = frozenset("*?[{")


def has_wildcards(token: str) -> bool:
    return any(c in WILDCARDS for c in token)


@dataclass(frozen=True)
class Constraint:
    """``kind``: extension, glob, segment, file, type, status, text or not (with ``inner``)."""

    kind: str
    value: str = ""
    inner: Constraint | None = None


@dataclass(frozen=True)
class Query:
    raw: str
    constraints: tuple[Constraint, ...] = ()
    parts: tuple[str, ...] = ()
    location: Location | None = None

    @property
    def kind(self) -> str:
        return "empty" if not self.parts else "text" if len(self.parts) == 1 else "parts"

    def search_text(self) -> str:
        """What a content search looks for: the free tokens, with a backslash before ``*``, ``/`` or ``!`` taken off."""
        return " ".join(p[1:] if len(p) > 1 and p[0] == "\\" and p[1] in "*/!" else p for p in self.parts)


def looks_like_file(token: str) -> bool:
    """Ends in a name with an extension of up to ten letters and digits that begins with a letter."""
    if token.endswith("/") or has_wildcards(token):
        return False
    name, dot, ext = token.rpartition("/")[2].rpartition(".")
    return bool(dot) and 0 < len(ext) <= 10 and ext.isascii() and ext[0].isalpha() and ext.isalnum()


def _any_glob(token: str) -> bool:
    return has_wildcards(token)


def _code_glob(token: str) -> bool:
    """In content searches brackets and stars usually belong to code: only paths and lists of alternatives are globs."""
    if not has_wildcards(token):
        return False
    a, b = token.find("{"), token.rfind("}")
    inner = token[a + 1 : b] if 0 <= a < b else ""
    return "/" in token or ("," in inner and any(c.isascii() and c.isalpha() for c in inner))


def _agent_glob(token: str) -> bool:
    return _code_glob(token) or (len(token) >= 3 and token[0] == token[-1] == "*" and "*" not in token[1:-1])


@dataclass(frozen=True)
class Dialect:
    """Which constraints a kind of search knows."""

    extensions: bool = True
    segments: bool = True
    types: bool = True
    status: bool = True
    locations: bool = True
    files: bool = False
    is_glob: object = field(default=_any_glob)


FILE_SEARCH = Dialect(files=True)
GREP = Dialect(status=False, locations=False, is_glob=_code_glob)
AGENT_GREP = replace(GREP, files=True, is_glob=_agent_glob)
DIR_SEARCH = Dialect(extensions=False, segments=False, types=False, status=False)
MIXED_SEARCH = Dialect(segments=False)

STATUS_WORDS = ("modified", "untracked", "staged", "clean")


def _status(value: str) -> Constraint | None:
    """Any prefix of a status word, the first that fits; nothing after the colon is ``modified``."""
    found = next((w for w in STATUS_WORDS if w.startswith(value)), None)
    return Constraint("status", found) if found and value != "*" else None


def _positive(token: str, d: Dialect) -> Constraint | None:
    if not token or (token[0] == "\\" and len(token) > 1):
        return None
    if token[0] == "*" and d.extensions:
        if token.startswith("*.") and len(token) > 2 and not has_wildcards(token[2:]):
            return Constraint("extension", token[2:])
        return Constraint("glob", token) if d.is_glob(token) else None
    if d.segments and (token[0] == "/" or token[-1] == "/"):
        segment = token.strip("/") if token[0] == "/" else token.rstrip("/")
        return Constraint("segment", segment) if segment else None
    if d.is_glob(token):
        return Constraint("glob", token)
    key, colon, value = token.partition(":")
    if colon and key == "type" and d.types:
        return Constraint("type", value)
    if colon and key in ("status", "st", "g", "git") and d.status:
        return _status(value)
    return Constraint("file", token) if d.files and looks_like_file(token) else None


def parse_token(token: str, d: Dialect) -> Constraint | None:
    if token in ("*", "*.") and d.extensions:
        return None
    if token.startswith("!"):
        inner = _positive(token[1:], d)
        if inner is None and len(token) >= 4 and any(c.isalnum() for c in token):
            inner = Constraint("text", token[1:])
        return Constraint("not", inner=inner) if inner else None
    return _positive(token, d)


def _located(parts: list[str], d: Dialect) -> tuple[list[str], Location | None]:
    if not (d.locations and parts):
        return parts, None
    last, location = parse_location(parts[-1])
    return ([*parts[:-1], last], location) if location else (parts, None)


def parse(query: str, dialect: Dialect = FILE_SEARCH) -> Query:
    """Tokens are split at white space. One token that names a file is a constraint; more of them are text.

    A lone token that names a file or a path is what to search for, not where; so is the file among constraints without any text.
    """
    tokens = query.split()
    if len(tokens) == 1 and len(query.strip()) == len(tokens[0]):
        c = parse_token(tokens[0], dialect)
        if c and c.kind not in ("file", "segment"):
            return Query(query, (c,))
        parts, location = _located(tokens, dialect)
        return Query(query, (), tuple(parts) if any(parts) or location else (), location)
    constraints, parts, file_at = [], [], None
    for t in tokens:
        c = parse_token(t, dialect)
        if c is None or (c.kind == "file" and file_at is not None):
            parts.append(t)
        else:
            if c.kind == "file":
                file_at = len(constraints)
            constraints.append(c)
    if not parts and file_at is not None:
        parts.append(constraints.pop(file_at).value)
    parts, location = _located(parts, dialect)
    return Query(query, tuple(constraints), tuple(parts) if any(parts) else (), location)
