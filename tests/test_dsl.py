import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from skein.plans import dsl
from skein.plans.classify import Cursors, classify
from skein.plans.dsl import Constraint, parse
from skein.plans.glob import glob_regex
from skein.plans.location import Location, parse_location


def kinds(query, dialect=dsl.FILE_SEARCH):
    q = parse(query, dialect)
    return [(c.kind, c.value) if c.kind != "not" else ("not", (c.inner.kind, c.inner.value)) for c in q.constraints], q.parts


@pytest.mark.parametrize(
    "query,constraints,parts",
    [
        ("*.rs foo", [("extension", "rs")], ("foo",)),
        ("!test/ foo", [("not", ("segment", "test"))], ("foo",)),
        ("status:mod x", [("status", "modified")], ("x",)),
        ("git: x", [("status", "modified")], ("x",)),
        ("type:rust x", [("type", "rust")], ("x",)),
        ("score.rs search", [("file", "score.rs")], ("search",)),
        ("a.rs b.rs search", [("file", "a.rs")], ("b.rs", "search")),
        ("profile.h src/", [("segment", "src")], ("profile.h",)),
        ("score.rs", [], ("score.rs",)),
        ("src/", [], ("src/",)),
        ("src/**/*.rs foo", [("glob", "src/**/*.rs")], ("foo",)),
        ("\\*.rs foo", [], ("\\*.rs", "foo")),
        ("!ab foo", [], ("!ab", "foo")),
        ("!abc foo", [("not", ("text", "abc"))], ("foo",)),
        ("!*.md foo", [("not", ("extension", "md"))], ("foo",)),
        ("* foo", [], ("*", "foo")),
        ("", [], ()),
    ],
)
def test_file_search(query, constraints, parts):
    assert kinds(query) == (constraints, parts)


def test_dialects():
    assert kinds("a[0] x", dsl.GREP) == ([], ("a[0]", "x"))
    assert kinds("{a,b} x", dsl.GREP) == ([("glob", "{a,b}")], ("x",))
    assert kinds("status:modified x", dsl.GREP) == ([], ("status:modified", "x"))
    assert kinds("*foo* x", dsl.AGENT_GREP) == ([("glob", "*foo*")], ("x",))
    assert kinds("*.rs src/ x", dsl.DIR_SEARCH)[1] == ("src/", "x")
    assert parse("\\*.rs foo", dsl.GREP).search_text() == "*.rs foo"


def test_locations_in_queries():
    q = parse("search file:12")
    assert q.parts == ("search", "file") and q.location == Location("line", (12, 0))
    assert parse("/a/file.rs:12").location == Location("line", (12, 0))
    assert parse("file:12", dsl.GREP).parts == ("file:12",)


@pytest.mark.parametrize(
    "text,path,location",
    [
        ("f:12", "f", Location("line", (12, 0))),
        ("f:12:4", "f", Location("position", (12, 4))),
        ("f:12-114", "f", Location("range", (12, 0), (114, 0))),
        ("f:114-12", "f", Location("line", (114, 0))),
        ("f:12:4-20", "f", Location("range", (12, 4), (12, 20))),
        ("f:12:20-4", "f", Location("line", (12, 0))),
        ("f:12:4-14:20", "f", Location("range", (12, 4), (14, 20))),
        ("f:14:4-12:20", "f", Location("position", (14, 4))),
        ("f(12)", "f", Location("line", (12, 0))),
        ("f(12,4)", "f", Location("position", (12, 4))),
        ("f:12:", "f", Location("line", (12, 0))),
        ("f:x", "f:x", None),
        ("f", "f", None),
    ],
)
def test_locations(text, path, location):
    assert parse_location(text) == (path, location)


@pytest.mark.parametrize(
    "glob,crosses,yes,no",
    [
        ("*.rs", True, ["a.rs", "x/a.rs"], ["a.rsx"]),
        ("*.rs", False, ["a.rs"], ["x/a.rs"]),
        ("src/**/*.rs", False, ["src/a.rs", "src/x/y/a.rs"], ["a.rs"]),
        ("src/**", False, ["src/a", "src/x/y"], ["srcs/a"]),
        ("{a,b}/?.t[xy]t", False, ["a/1.txt", "b/2.tyt"], ["c/1.txt", "a/12.txt"]),
        ("[!a]b", True, ["cb"], ["ab"]),
        ("a{b", True, ["a{b"], ["ab"]),
    ],
)
def test_globs(glob, crosses, yes, no):
    rule = re.compile(glob_regex(glob, crosses))
    assert all(rule.match(x) for x in yes) and not any(rule.match(x) for x in no)


@given(st.text(max_size=30))
def test_any_query_parses(text):
    q = parse(text)
    assert all(isinstance(c, Constraint) for c in q.constraints)


def test_classification():
    exists = {"src/a.rs"}.__contains__
    assert [classify(x, exists) for x in ("src/a.rs:12", "src/a.rs", "*.rs", "Foo::bar", "how does it work", "a-b")] == ["location", "path", "glob", "symbol", "concept", "other"]


def test_cursors_forget_the_oldest():
    c = Cursors(2)
    marks = [c.put(i) for i in (10, 20, 30)]
    assert [c.get(m) for m in marks] == [None, 20, 30]
