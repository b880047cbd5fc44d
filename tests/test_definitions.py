"""Expected spans of the definition extractors, one small file per language."""

import pytest

from tallyweave.operators import chunking

CASES = {
    "go": (
        "package a\n\n// Store keeps\n// things.\ntype Store struct {\n\tm map[string]int\n}\n\ntype (\n\t// A is one.\n\tA int\n\tB struct {\n\t\tx int\n\t}\n)\n\n// Get reads.\nfunc (s *Store) Get(k string) int {\n\treturn s.m[k] // }\n}\n\nfunc free() { call(`}\n{`) }\n",
        {(3, 7, "Store"), (10, 11, "A"), (12, 14, "B"), (17, 20, "Store.Get"), (22, 23, "free")},
    ),
    "rust": (
        "use a::b;\n\n/// Doc.\n#[derive(Debug)]\npub struct S<'a> {\n    x: &'a str,\n}\n\nimpl<'a> fmt::Display for S<'a> {\n    fn fmt(&self) -> R {\n        ok('}')\n    }\n\n    /// Two.\n    pub async fn two(&self) {\n        if x { y() }\n    }\n}\n\nmod inner {\n    pub fn deep() {}\n}\n\nmacro_rules! m {\n    () => {};\n}\n",
        {(3, 7, "S"), (9, 9, "S"), (10, 12, "S.fmt"), (14, 17, "S.two"), (20, 20, "inner"), (21, 21, "inner.deep"), (24, 26, "m")},
    ),
    "java": (
        "package a;\n\n/** Doc. */\n@Service\npublic final class A<T> extends B {\n  private int x = 1;\n\n  @Override\n  public List<String> f(int n)\n      throws E {\n    if (n > 1) { g(\"}\"); }\n    return null;\n  }\n\n  static class In {\n    In(int a) {\n    }\n  }\n}\n",
        {(3, 7, "A"), (8, 13, "A.f"), (15, 15, "A.In"), (16, 17, "A.In.In")},
    ),
    "csharp": ("namespace N.M\n{\n    [Serializable]\n    public class A\n    {\n        public int P { get; set; }\n\n        /// Doc\n        public async Task<int> F(int x)\n        {\n            return x;\n        }\n    }\n}\n", {(1, 2, "N.M"), (3, 5, "N.M.A"), (6, 6, "N.M.A.P"), (8, 12, "N.M.A.F")}),
    "kotlin": ("class A(val x: Int) {\n    fun f(): Int {\n        return x\n    }\n\n    fun g() = 1\n}\n\nfun <T> top(a: T) {\n}\n", {(1, 1, "A"), (2, 4, "A.f"), (6, 6, "A.g"), (9, 10, "top")}),
    "scala": ("object O {\n  def f(x: Int): Int = {\n    x\n  }\n}\n\ntrait T {\n}\n", {(1, 1, "O"), (2, 4, "O.f"), (7, 8, "T")}),
    "swift": ("struct S {\n    var a = 1\n    init(a: Int) {\n        self.a = a\n    }\n    func f() -> Int {\n        return a\n    }\n}\n", {(1, 2, "S"), (3, 5, "S.init"), (6, 8, "S.f")}),
    "php": ("<?php\nclass A {\n    private $x; # a }\n    public function f($a) {\n        return \"}\";\n    }\n}\n\nfunction g() {\n}\n", {(2, 3, "A"), (4, 6, "A.f"), (9, 10, "g")}),
    "typescript": (
        "import { a } from 'b';\n\nexport interface I {\n  x: number;\n}\n\nexport class C extends D {\n  private n = 1;\n\n  constructor(x: number) {\n    super();\n  }\n\n  async f<T>(a: T): Promise<T> {\n    return `}`;\n  }\n\n  g = (a) => {\n    return a;\n  };\n}\n\nexport const h = async (x: number): Promise<void> => {\n  a(x);\n};\n",
        {(3, 5, "I"), (7, 9, "C"), (10, 12, "C.constructor"), (14, 16, "C.f"), (18, 20, "C.g"), (23, 25, "h")},
    ),
    "javascript": ("export default function f() {\n  return 1;\n}\nconst g = x => {\n  y();\n};\n", {(1, 3, "f"), (4, 6, "g")}),
    "c": ("#include <a.h>\n\n/* doc */\nstatic int *find(const char *k,\n                 int n)\n{\n    return 0;\n}\n\ntypedef struct {\n    int x;\n} point;\n\nstruct node {\n    int y;\n};\n\nint proto(int);\n", {(3, 8, "find"), (10, 12, "point"), (14, 16, "node")}),
    "cpp": ("namespace a {\n\nclass B : public C {\n public:\n  int f() {\n    return 1;\n  }\n};\n\ntemplate <typename T>\nT g(T x) {\n  return x;\n}\n\nint B::h(int x) {\n  return x;\n}\n\n}\n", {(1, 2, "a"), (3, 4, "a.B"), (5, 7, "a.B.f"), (10, 13, "a.g"), (15, 17, "a.B.h")}),
    "ruby": ("module M\n  # doc\n  class A\n    def f(x)\n      if x\n        1\n      end\n    end\n\n    def g = 2\n  end\nend\n", {(1, 1, "M"), (2, 3, "M.A"), (4, 8, "M.A.f"), (10, 10, "M.A.g")}),
    "elixir": ("defmodule A.B do\n  @doc \"x\"\n  def f(x) do\n    x\n  end\n\n  defp g(x), do: x\nend\n", {(1, 1, "A.B"), (2, 5, "A.B.f"), (7, 7, "A.B.g")}),
    "objc": ("@interface A : B\n- (int)f;\n@end\n\n@implementation A\n- (int)f {\n  return 1;\n}\n@end\n", {(1, 3, "A"), (5, 5, "A"), (6, 8, "A.f")}),
    "hcl": ('resource "aws_x" "main" {\n  a = 1\n}\n\nvariable "v" {\n}\n\ndata "aws_y" "d" {\n  b {\n  }\n}\n\nlocals {\n}\n', {(1, 3, "aws_x.main"), (5, 6, "var.v"), (8, 11, "data.aws_y.d"), (13, 14, "locals")}),
    "bash": ("f() {\n  a\n}\n\nfunction g {\n  b\n}\n", {(1, 3, "f"), (5, 7, "g")}),
    "sql": ("create table a (\n  x int\n);\n\nCREATE OR REPLACE VIEW s.v AS\nselect 1;\n", {(1, 4, "a"), (5, 6, "s.v")}),
    "json": ('{\n  "a": {\n    "deep": 1\n  },\n  "b": [1,\n    2]\n}\n', {(2, 4, "a"), (5, 6, "b")}),
    "toml": ("[a]\nx = 1\n[[b.c]]\ny = 2\n", {(1, 2, "a"), (3, 4, "b.c")}),
    "yaml": ("a:\n  b: 1\nc: 2\n", {(1, 2, "a"), (3, 3, "c")}),
    "dockerfile": ("FROM a AS build\nRUN x\nFROM b\nCOPY y z\n", {(1, 2, "build"), (3, 4, None)}),
    "xml": ("<p>\n" + "".join(f"  <d>\n    <x>{i}</x>\n  </d>\n" for i in range(20)) + "  <e/>\n</p>\n", {(1, 1, "p"), (2, 40, "p/d"), (41, 62, "p")}),
}


@pytest.mark.parametrize("lang", sorted(CASES))
def test_spans(lang):
    text, want = CASES[lang]
    lines = text.splitlines()
    spans = chunking.spans_of(text, lang, "code")
    named = {(a, b, s) for a, b, s, node in spans if node is not None}
    assert named == want, sorted(named)
    held = [0] * (len(lines) + 1)
    for a, b, *_ in spans:
        for i in range(a, b + 1):
            held[i] += 1
    assert all(held[i] == 1 for i in range(1, len(lines) + 1) if lines[i - 1].strip())


@pytest.mark.parametrize("lang", sorted(CASES))
def test_cut_files_keep_all_lines(lang):
    """Files that end anywhere, and lines in any order, neither fail nor lose a line."""
    text, _ = CASES[lang]
    lines = text.splitlines()
    for part in [lines[:n] for n in range(1, len(lines))] + [lines[::-1], lines[1:]]:
        spans = chunking.spans_of("\n".join(part), lang, "code")
        held = {i for a, b, *_ in spans for i in range(a, b + 1)}
        assert {i for i, x in enumerate(part, 1) if x.strip()} <= held <= set(range(1, len(part) + 1)), (lang, part, spans)
