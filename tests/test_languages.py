"""Declarations and imports of each language, and blocks against a plain scan."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.functions.languages import Blocks, imports
from skein.operators import bigram
from skein.operators.structure import read_generic

SOURCES = {
"java": "package a;\nimport java.util.List;\nimport static a.B.*;\npublic class Foo extends Bar {\n  private int x = make(1);\n  public Foo(int x) {\n    this.x = x;\n  }\n  public static List<String> names(int a,\n      int b) {\n    return run(a);\n  }\n  @Override\n  public void close() throws Exception {\n    if (x > 0) {\n      stop();\n    }\n  }\n}\ninterface I {\n  void go(int x);\n}\nenum E { A, B }\n",
"c": "#include <stdio.h>\n#include \"util.h\"\nint add(int a, int b);\nstatic int add(int a, int b)\n{\n  return a + b;\n}\nstruct point {\n  int x;\n};\ntypedef unsigned long word;\nint main(void) {\n  printf(\"%d\", add(1, 2));\n  for (int i = 0; i < 3; i++) { add(i, i); }\n}\n",
"go": "package main\nimport (\n  \"fmt\"\n  x \"a/b\"\n)\nimport \"os\"\ntype T struct {\n  a int\n}\nfunc (t *T) Run(a int) error {\n  return nil\n}\nfunc main() {\n  fmt.Println(1)\n}\n",
"typescript": "import { a } from './a';\nimport {\n  b,\n} from \"./b\";\nexport class A extends B {\n  async run(x: number): Promise<void> {\n    if (x) {\n      go();\n    }\n  }\n}\nexport const f = (x: number) => {\n  return x;\n};\ntype X = number;\nexport interface I {\n  a: string;\n}\n",
"elixir": "defmodule A.B do\n  alias C.D\n  def run(x) do\n    %{a: x}\n  end\n\n  defp hide?(x), do: x\nend\n",
"ruby": "require 'set'\nrequire_relative 'util'\nmodule M\n  class A < B\n    def self.make(x)\n      new(x)\n    end\n\n    def ok?\n      true\n    end\n  end\nend\n",
"kotlin": "import a.b.C\ndata class P(val x: Int)\nval y = 1\nfun go(x: Int): Int {\n  return x\n}\nobject O {\n  fun z() = 1\n}\n",
"php": "<?php\nnamespace A\\B;\nuse C\\D;\nclass X {\n  public function go($x) {\n    return 1;\n  }\n}\n",
"csharp": "using System.Text;\nnamespace A.B {\n  public class C {\n    public int Add(int a) => a + 1;\n    public override string ToString()\n    {\n      return base.ToString();\n    }\n  }\n}\n",
"rust": "use crate::a::{b, c};\npub use x::y as z;\npub struct S;\nimpl<T> Tr for S {\n  fn f(&self) {\n    g();\n  }\n}\nmod t {\n  fn h() {}\n}\n",
"swift": "import Foundation\nprotocol P {\n  func a()\n}\nstruct S: P {\n  let x = 1\n  func a() {\n    go()\n  }\n}\n",
"scala": "import a.b.{C, D}\ncase class P(x: Int)\nobject O {\n  def f(x: Int): Int = x\n}\n",
}

ENTRIES = {
    "java": [("class_declaration", "Foo", 4, 19, -1), ("method_declaration", "names", 9, 12, 0), ("method_declaration", "close", 14, 18, 0), ("interface_declaration", "I", 20, 22, -1), ("method_declaration", "go", 21, 21, 3), ("enum_declaration", "E", 23, 23, -1)],
    "c": [("function_definition", "add", 4, 7, -1), ("struct_item", "point", 8, 10, -1), ("type_definition", "word", 11, 11, -1), ("function_definition", "main", 12, 15, -1)],
    "go": [("type_declaration", "T", 7, 9, -1), ("method_declaration", "Run", 10, 12, -1), ("function_declaration", "main", 13, 15, -1)],
    "typescript": [("class_declaration", "A", 5, 11, -1), ("method_definition", "run", 6, 10, 0), ("lexical_declaration", "f", 12, 14, -1), ("type_alias_declaration", "X", 15, 15, -1), ("interface_declaration", "I", 16, 18, -1)],
    "elixir": [("elixir_def", "A.B", 1, 8, -1), ("elixir_def", "run", 3, 5, 0), ("elixir_def", "hide?", 7, 7, 0)],
    "ruby": [("mod_item", "M", 3, 13, -1), ("class_declaration", "A", 4, 12, 0), ("function_item", "make", 5, 7, 1), ("function_item", "ok?", 9, 11, 1)],
    "kotlin": [("class_declaration", "P", 2, 2, -1), ("property_declaration", "y", 3, 3, -1), ("function_declaration", "go", 4, 6, -1), ("object_declaration", "O", 7, 9, -1), ("function_declaration", "z", 8, 8, 3)],
    "php": [("namespace_definition", "A\\B", 2, 2, -1), ("class_declaration", "X", 4, 8, -1), ("function_definition", "go", 5, 7, 1)],
    "csharp": [("namespace_definition", "A.B", 2, 10, -1), ("class_declaration", "C", 3, 9, 0), ("method_declaration", "Add", 4, 4, 1), ("method_declaration", "ToString", 5, 8, 1)],
    "rust": [("struct_item", "S", 3, 3, -1), ("impl_item", "S", 4, 8, -1), ("function_item", "f", 5, 7, 1), ("mod_item", "t", 9, 11, -1), ("function_item", "h", 10, 10, 3)],
    "swift": [("interface_declaration", "P", 2, 4, -1), ("function_declaration", "a", 3, 3, 0), ("class_declaration", "S", 5, 10, -1), ("property_declaration", "x", 6, 6, 2), ("function_declaration", "a", 7, 9, 2)],
    "scala": [("class_definition", "P", 2, 2, -1), ("object_declaration", "O", 3, 5, -1), ("function_definition", "f", 4, 4, 1)],
}
SPECS = {
    "java": ["java.util.List", "a.B"], "c": ["stdio.h", "util.h"], "go": ["fmt", "a/b", "os"], "typescript": ["./a", "./b"], "elixir": ["C.D"], "ruby": ["set", "./util"],
    "kotlin": ["a.b.C"], "php": ["C\\D"], "csharp": ["System.Text"], "rust": ["crate::a", "x::y"], "swift": ["Foundation"], "scala": ["a.b"],
}


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_declarations(language):
    m = read_generic(SOURCES[language], language)
    assert [(e.kind, e.name, e.start, e.end, e.parent) for e in m.entries] == ENTRIES[language]
    assert [spec for _, spec in m.imports] == SPECS[language]


@pytest.mark.parametrize("language", [*sorted(SOURCES), "make", ""])
@pytest.mark.parametrize("source", ["", "\n\n", "}", "{", "}}{{", "x" * 100_000, "a b c (" * 20_000, "func (" * 5_000, "int f(int a;\n" * 3_000])
def test_odd_sources(language, source):
    """Empty, unbalanced and very long sources give entries within the file."""
    n = source.count("\n") + 1
    assert all(1 <= e.start <= e.end <= n for e in read_generic(source, language).entries)
    assert imports([], language) == []


@settings(deadline=None)
@given(st.lists(st.sampled_from(["{", "}", "a {", "} b {", "x", "", "{ }"]), max_size=30))
def test_brace_blocks(lines):
    blocks = Blocks(lines)
    for at, line in enumerate(lines):
        if "{" not in line:
            continue
        depth, want = 0, len(lines) - 1
        for i in range(at, len(lines)):
            depth += lines[i].count("{") - lines[i].count("}")
            if depth <= 0:
                want = i
                break
        assert blocks.end(at) == want


@settings(deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.booleans()), max_size=30))
def test_indented_blocks(shape):
    lines = [" " * k + "x" if filled else "" for k, filled in shape]
    blocks = Blocks(lines, braces=False)
    for at, (own, filled) in enumerate(shape):
        if filled:
            want = at
            for i in range(at + 1, len(lines)):
                if lines[i] and shape[i][0] <= own:
                    break
                want = i if lines[i] else want
            assert blocks.end(at) == want


def test_plans_lose_nothing():
    assert bigram.regex_plan("[a-z&&[aeiou]]bc") == bigram.ANY and bigram.regex_plan("[[ab]c]de") == bigram.ANY
    assert bigram.fuzzy_lines_plan("short", 1, 2) == bigram.ANY
    assert bigram.fuzzy_lines_plan("abcdefghijklmnop", 2, 5).least == 6
