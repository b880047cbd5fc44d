import random
from functools import reduce

import pytest

from tallyweave.llm import parsing as P
from tallyweave.llm.lexing import STATES, combine, entry_states, finish, lex, summarise

GOOD = {
    "javascript": [
        'import { a } from "./a";\nexport function f(x, y = 3) {\n  const re = /[({]+/g;\n  for (const r of x) {\n    g(r, `t ${r.id} ${ {a: 1}.a }`);\n  }\n  return x ?? y;\n}\n',
        "const a = 1\nlet b = a\n  + 2\nb++\nif (a) b = 3; else b = 4\n", "!function(a){a.b=\"c\"}(window);for(var i=0;i<9;i++)z(i);var k=[1,2],m={a:1,b:k?1:2};",
        "class A extends B { static x = 1; #p = 2; get v() { return this.#p } async *g() { yield* this.h() } }\nlabel: for (;;) { break label }\nexport default class {}\n",
        "switch (a) { case 1: b(); break; default: c() }\ntry { d() } catch { e() } finally { f() }\nconst { x, ...rest } = await g(), h = async (q) => q?.r?.[0];\n", "",
    ],
    "typescript": ["export interface A { readonly k: 0; v?: string; }\nexport function f(a: Row[], b: number = 1): Row[] {\n  const m = a as unknown as Map<string, number>;\n  let c: number | undefined = 3;\n  return a.filter((r) => r.size > 2);\n}\ntype T<K extends string> = { [P in K]?: Array<Map<P, number[]>> };\nenum E { A = 1, B }\n"],
    "go": ['package a\n\nimport (\n\t"fmt"\n\tx "y/z"\n)\n\ntype S struct {\n\tA int `json:"a"`\n}\n\nfunc (s *S) F(a []Row, n int) (int, error) {\n\tm := map[string]int{"a": 1}\n\tswitch {\n\tcase len(a) == 3:\n\t\treturn 1, nil\n\tdefault:\n\t\tdefer s.G(m, 4)\n\t}\n\tfor _, r := range a {\n\t\tfmt.Println(r, `raw\n` )\n\t}\n\tif x := n; x > 2 {\n\t\tgo func() { s.A++ }()\n\t}\n\treturn 0, nil\n}\n'],
    "rust": ['use crate::a::b;\n\n/// doc\n#[derive(Debug)]\npub struct S<\'a, T: Clone> { pub x: &\'a [T] }\n\nimpl<T> S<\'_, T> where T: Clone {\n    pub fn f(&mut self, n: usize) -> Option<u32> {\n        let mut v = Vec::with_capacity(n);\n        v.push(1u8);\n        for i in 0..n { println!("{} {}", i, \'x\'); }\n        let s = r#"raw " { "#;\n        match v.first() {\n            Some(x) if *x > 2 => Some(3),\n            _ => None,\n        }\n    }\n}\n'],
    "java": ['package a.b;\n\nimport java.util.*;\n\npublic final class A<T extends Comparable<T>> implements B {\n  private final int[] buf = new int[4096];\n  static final int[] D = {1, 2, 3,};\n  @Override\n  public List<Map<String, Integer>> f(List<Row> r, int n) throws E {\n    String s = """\n      text { block\n      """;\n    for (Row x : r) { g(x, "y"); }\n    try { h(); } catch (E | F e) { log.warn("z", e); }\n    return n > 3 ? a[0] : (int) b.c();\n  }\n}\n'],
    "python": ["x = 1\n"], "json": ['{"a": [1, 2.5e3, null, "keep { open ("]}'], "toml": ['a = 1\n[b]\nc = ["x"]\n'], "yaml": ["a:\n  b: [c, d]\n"],
}
BAD = {
    "javascript": ["export function f(a: Row[]): Row[] { return a }", "const a = ;", "def f(x):\n    return x\n", "a b c", "<<<<<<< HEAD\na()\n=======\nb()\n>>>>>>> x\n", "@@ -1,2 +1,2 @@\n a()\n", "f(1, 2", 'const s = "open;\n', "const t = `open", "let x = 061;", "import { a } from", "package a;\n", "/* never closed", "f(a b);", "x = {a: 1 b: 2};", "<!doctype html>\n<html></html>", "if (a { b() }"],
    "typescript": ["package x\n\nfunc F() {}\n", "const a: number = ;", "export function f( {", "let column = match x.first() {\n};"],
    "go": ["", "func F() {}\n", "package a\n\nfunc F() {\n<<<<<<< HEAD\n\treturn\n}\n", "package a\n\nfunc F(\n", "package a\n\nfunc F() {\n\tdafer g()\n}\n", '{"a": 1}', "package a\n\nvar x = 'ab'\n", "package a\n\nfunc F() {\n\tx := 1 +\n}\n"],
    "rust": ["package a\n", "pub fn f() {\n    raturn 45;\n}\n", "pub fn f() { let x = ; }", "fn f() {\n    g(1, 2;\n}\n", "x + 1\n", "fn f() {\n<<<<<<< ours\n    1\n}\n"],
    "java": ["use a::b;\n", "public class A {\n  int f() { return 1 }\n}\n", "public class A { int x = ; }", "class A { void f() { g(1,, 2); } }", 'class A { String s = "open;\n}', "class A { void f() { a b c = 3; } }"],
    "python": ["def f(:\n", 'print "x"\n', "x = (1\n", "return 1\n", "a\x00b"], "json": ["", "{'a': 1}", "[1,]", "NaN", '{"a": 1} x'], "toml": ["a = \n", "<<<<<<< HEAD\n"], "yaml": ["a: b: c\n", "a:\n\tb: 1\n"],
}


@pytest.mark.parametrize("lang", sorted(GOOD))
def test_valid(lang):
    for text in GOOD[lang]:
        assert P.fault(lang, text) is None, (lang, text, P.fault(lang, text))
        assert P.fault(lang, text.replace("\n", "\r\n")) is None or "raw" in text or '"""' in text


@pytest.mark.parametrize("lang", sorted(BAD))
def test_invalid(lang):
    for text in BAD[lang]:
        assert P.fault(lang, text) is not None, (lang, text)


HARD = {
    "javascript": "const t = `a ${[\n  { b: 1 },\n  `c ${ d(\n1) }\n e`,\n].join()} f\n`;\nconst s = \"it (\\\n  goes on }\\\n here\";\nconst q = a\n / 2 /\n 3;\nconst r = [\n/[)}]/g,\n];\n",
    "go": "package a\n/* { */\nvar r = `raw (\n\n{ `\n",
    "rust": "/* a /* b\n { */ /*\n */ c\n */\nconst S: &str = \"a \\\n \\\" ( \n b\";\nconst R: &str = r##\"a \"# {\n \"# b\n\"##;\nconst P: &str = r\"c\n{\";\nfn f<'a>() {\n}\n",
    "java": "class A {\n  String s = \"\"\"\n  { \\\"\"\" (\n  \"\"\";\n /* } \n */ }\n",
}
HARD["typescript"] = HARD["javascript"]


@pytest.mark.parametrize("lang", sorted(STATES))
def test_summaries_are_associative_and_say_what_the_whole_does(lang):
    rng = random.Random(7)
    text = HARD[lang] + "\n".join(GOOD[lang] * 2)
    lines = text.splitlines(keepends=True)
    whole = summarise(lang, text)
    entries = set(entry_states(lang, text)[0]) | {("comment", 3), ("text", 5)}
    for _ in range(40):
        cuts = sorted(rng.sample(range(1, len(lines)), min(rng.randint(1, 6), len(lines) - 1)))
        sums = [summarise(lang, "".join(lines[a:b])) for a, b in zip([0, *cuts], [*cuts, len(lines)])]
        left, right = reduce(combine, sums), sums[-1]
        for s in reversed(sums[:-1]):
            right = combine(s, right)
        for state in entries:
            for stack in ("", "{", "({$[{$", "$$${"):
                want = finish(whole, state, stack)
                for got in (finish(left, state, stack), finish(right, state, stack)):
                    assert (got[3] is None) == (want[3] is None) and (want[3] is not None or got == want), (state, stack)
    read = finish(whole)
    x = lex(lang, text)
    assert read[3] is None and x.error is None and (x.state, x.argument, x.closers, x.openers) == (*read[0], read[1], read[2])


def test_long_files_by_parts(spark):
    text = "package a\n\n" + "func F() int {\n\treturn 1\n}\n" * 6000
    assert len(text) > P.PART_CHARS and P.fault("go", text) is None and P.fault("go", text[:-3]) is not None
    nested = "const t = `a ${[\n" + "  {a: 1},\n" * 2000 + "].join()}`;\n"
    parts = [("x", "go", i, p) for i, p in enumerate(P.parts_of(text, 4000))] + [("y", "go", i, p) for i, p in enumerate(P.parts_of(text[:-3], 4000))] + [("z", "cobol", 0, "x")] + [("n", "javascript", i, p) for i, p in enumerate(P.parts_of(nested, 3000))]
    got = {r.file_id: r.open_end for r in P.reduce_parts(spark.createDataFrame(parts, "file_id string, lang string, part_no int, text string")).collect()}
    assert got["x"] is None and got["n"] is None and got["y"] is not None and "z" not in got


def test_rows_and_rates(spark):
    schema = "repo string, rel_path string, lang string, content string, fault int, unreadable string"
    rows = [("r", "a.py", "python", "x = 1\n"), ("r", "b.py", "python", "x = (\n"), ("r", "c.py", "python", None), ("r", "d.md", "markdown", "(("), (None, None, None, "(("), ("r", "e.x", "klingon", "((")]
    df = spark.createDataFrame([(*r, 1, "u") for r in [*rows, rows[1]]], schema)
    assert [(r.rel_path, r.lang) for r in P.unparsable(df).collect()] == [("b.py", "python")]
    got = {(r.repo, r.lang): (r.files, r.unreadable, r.unparsable, r.rate) for r in P.rates(P.judge_files(df)).collect()}
    assert got["r", "python"] == (3, 1, 1, 0.5) and got["r", "markdown"][2] == 0
    assert P.unparsable(spark.createDataFrame([], schema)).count() == 0


def test_tokens_of_odd_text():
    for lang in STATES:
        for text in ["", "\x00", "'", '"', "`", "/*", "//", "\\", "é😀", "🙂" * 10, "a" * 100_000, "(" * 5000]:
            lex(lang, text)
            P.fault(lang, text)


def test_size_does_not_change_the_verdict():
    many = P.PART_CHARS // 8
    long = {
        "string": ("rust", 'const S: &str = "' + "line it's\n" * many + '";\n'), "raw": ("rust", 'const S: &str = r##"' + 'a "# b\n' * 2 * many + '"##;\n'),
        "plain raw": ("rust", 'const S: &str = r"' + "a { b\n" * 2 * many + '";\n'), "nested": ("rust", "/* a /* b\n" + "x ( y\n" * 2 * many + "*/ c */\nfn f() {}\n"),
        "template": ("typescript", "const t = `a ${[\n" + "  call(1),\n" * many + "].join()} b`;\n"), "continued": ("javascript", 'const s = "' + "it (\\\n" * 2 * many + '";\n'),
    }
    for name, (lang, text) in long.items():
        assert len(text) > P.PART_CHARS and P.fault(lang, text) is None, (name, P.fault(lang, text))
        assert P.fault(lang, text + "(\n") is not None, name


@pytest.mark.parametrize("lang", sorted(STATES))
def test_small_parts_give_the_verdict_of_the_whole(lang):
    for text in [HARD[lang], *GOOD[lang], *BAD[lang]]:
        want = P.brace_fault(lang, text, 1 << 30)
        for size in (1, 20, 90):
            assert (P.brace_fault(lang, text, size) is None) == (want is None), (lang, text, size)


def test_size_and_depth_are_no_matter_of_syntax():
    deep = 200_000
    assert P.fault("json", "[" * deep + "]" * deep) is None and P.fault("json", "[" * deep + "]" * (deep - 1)) is not None
    assert P.fault("json", '{"a":' * deep + "1" + "}" * deep) is None and P.fault("json", '{"a":' * deep + "1," + "}" * deep) is not None
    assert P.fault("json", "9" * 5000) is None and P.fault("python", "x = " + "9" * 5000 + "\n") is None
    assert P.fault("python", "x = " + "+".join(["a"] * 200_000) + "\n") is None and P.fault("python", "x = (" + "+".join(["a"] * 200_000) + "\n") is not None
    P.fault("toml", "a = " + "[" * 5000 + "]" * 5000 + "\n"), P.fault("yaml", "[" * 5000 + "]" * 5000 + "\n")


def test_deep_toml_is_judged():
    deep, table = "[" * 5000 + "1" + "]" * 5000, "{b=" * 3000 + "[\n'''x]''', # ]\n]" + "}" * 3000
    for head in ("a = ", '[t."]"]\n"k=[" = "]" # [\nb = '):
        for value in (deep, table):
            assert P.fault("toml", head + value + "\nz = 1\n") is None
            for bad in (value[:-1], value + "]", value + "\nz = \n", value.replace("1", "1 2").replace("'''x", "''x"), value[:-1] + ("}" if value[-1] == "]" else "]")):
                assert P.fault("toml", head + bad + "\n") is not None, bad[-50:]
    assert P.fault("toml", "a = [" + deep + ", {c = 1, c = 2}]\n") is not None
    for shallow in ("a = [1, {b = [2, '#']}, \"\"\"q\"] \"\"\"\"\"]\n[c]\nd.e = 1\n", "a = '''x'''''\n"):
        P._deep_toml(shallow)
