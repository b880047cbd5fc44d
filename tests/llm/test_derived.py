import random
import string

from tallyweave.llm import derived as D

HAND = "from a.b import load_table\n\nLIMIT = 3\n\ndef read_rows(table, limit=3):\n    rows = load_table(table)\n    return [row for row in rows if row.size > limit]\n\ndef write_rows(rows, target):\n    for row in rows:\n        target.append(row)\n    return target\n"
CASES = {
    "src/a.py": (HAND, []),
    "src/banner.py": ("# Code generated by toolx v1. DO NOT EDIT.\n" + HAND, ["generated: banner"]),
    "src/french.py": ("# Ne pas modifier : fichier produit par outil 3\n" + HAND, ["generated: banner"]),
    "src/asks.py": ("# Do not edit without asking the owners of this area.\n" + HAND, []),
    "src/speaks.py": ("# Template used by the code generator, maintained manually.\n" + HAND + 'BANNER = "@generated by x"\n', []),
    "src/replaces.py": ("# Replaces the vendored helper we used to carry.\n" + HAND, []),
    "src/copy.py": ("# pebblex 1.4 - (c) the pebblex contributors, licensed under MIT\n" + HAND, ["vendored: banner", "vendored: foreign name"]),
    "src/third_party/pebblex/a.py": (HAND, ["vendored: folder", "vendored: foreign name"]),
    "src/vendor_portal/a.py": (HAND, []),
    "src/generators/gen_a.py": (HAND, []),
    "src/gen/a.py": (None, ["generated: folder"]),
    "src/many.py": ("".join(f"def get_field_{i:04d}(m): return m._buf[{i}]\n" for i in range(60)), ["generated: template names"]),
    "src/data.py": ("X = [\n" + "".join(f"  {i * 7919 % 100000}, {i * 31 % 977},\n" * 1 for i in range(200)) + "]\n", []),
    "src/numbers.py": ("X = [\n" + "".join("  " + ", ".join(str((i * 13 + j) * 7919 % 99999) for j in range(12)) + ",\n" for i in range(30)) + "]\n", ["data: literals"]),
    "src/blob.py": ('X = "' + "QUJD+/9" * 300 + '"\n', ["data: literals"]),
    "web/package-lock.json": ('{\n "lockfileVersion": 3\n}\n', ["lock: name", "lock: content"]),
    "src/words.py": ("W = {\n" + "".join(f'    "word{c}": "plain {c}",\n' for c in "abcdefghijklmnopqrstuvwxyz") + "}\n", []),
}


def test_signs(spark):
    rows = [("r", p, "python" if p.endswith("py") else "json", t, 1, "x") for p, (t, _) in CASES.items()]
    # Enough hand-written files for the name model.
    rows += [("r", f"lib/m{i}.py", "python", HAND.replace("rows", f"{w}_rows"), 1, "x") for i, w in enumerate(["old", "new", "late", "warm", "cold", "slow"] * 5)]
    df = spark.createDataFrame([*rows, rows[0]], "repo string, rel_path string, lang string, content string, signs int, n string")
    got = {r.rel_path: sorted(r.signs) for r in D.judge_files(df).collect()}
    assert {p: got[p] for p in CASES if p != "src/data.py"} == {p: sorted(s) for p, (_, s) in CASES.items() if p != "src/data.py"}


def test_foreign_names_need_no_list(spark):
    """Names of projects that folders and comments name and no code uses; own folders and names stay."""
    hand = [("r", f"tools/part{i % 3}/m{i}.py", "python", HAND.replace("rows", w)) for i, w in enumerate(["alpha", "beta", "gamma", "delta"] * 30)]
    copies = [("r", f"app/zorkwidget/a{i}.py", "python", HAND) for i in range(4)] + [("s", f"app/x/b{i}.py", "python", "# zorkwidget 2.1, with thanks\n" + HAND) for i in range(3)]
    speaks = [("s", "tools/c.py", "python", "# Speaks like zorkwidget does.\n" + HAND), ("s", "tools/d.py", "python", "# tools of the workspace\n" + HAND), ("s", "app/target/e.py", "python", "# target of the walk\n" + HAND)]
    readme = [("s", "README.md", "markdown", "We use zorkwidget here.\n")]
    df = spark.createDataFrame(hand + copies + speaks + readme, "repo string, rel_path string, lang string, content string")
    got = {(r.repo, r.rel_path): r.signs for r in D.derived_files(df).collect()}
    assert got == {(r, p): ["vendored: foreign name"] for r, p, _, _ in copies}
    counts = {r.sign: (r.files, r.by_names) for r in D.sign_counts(D.judge_files(df)).collect()}
    assert counts == {"vendored: foreign name": (7, 7)}


def test_lock_heads_and_long_names_anywhere():
    late = "# " + "x" * 900 + "\nlockfileVersion: 9\n"
    assert "lock: content" in D.content_signs(late, "yaml", None, {}) and D.content_signs("v = {\n lockfileVersion: 3 }\n", "javascript", None, {}) == []
    assert D.words_of("ZorkWidget_is-Fine2") == ["zork", "widget", "fine"] and D.words_of("a" * 1000) == ["a" * 1000]


def test_minified_by_cross_entropy(spark):
    rng = random.Random(4)
    hand = [("r", f"m{i}.js", "javascript", HAND.replace("rows", w)) for i, w in enumerate(["alpha", "beta", "gamma", "delta"] * 60)]
    name = lambda: rng.choice(string.ascii_letters) + rng.choice(string.ascii_letters + string.digits + "$_")
    short = "".join(f"!{name()}({name()},{name()});var {name()}={name()}[{name()}]({name()});" for _ in range(60))
    df = spark.createDataFrame([*hand, ("r", "squeezed.js", "javascript", short)], "repo string, rel_path string, lang string, content string")
    assert {r.rel_path for r in D.derived_files(df).collect()} == {"squeezed.js"}


def test_odd_input(spark):
    schema = "repo string, rel_path string, lang string, content string"
    assert D.derived_files(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, None, None), ("r", None, None, "x" * 100_000), ("r", "vendor/x/a", None, ""), ("r", "p", "go", "\x00é😀")]
    got = {(r.repo, r.rel_path) for r in D.derived_files(spark.createDataFrame(rows * 2, schema)).collect()}
    assert ("r", "vendor/x/a") in got and (None, None) not in got


def test_banners_behind_the_code_and_behind_long_licences():
    licence = "".join(f"# Licence line {i} of the workspace.\n" for i in range(40))
    go = "package a\n\nfunc F() string {\n\treturn `\n%s\n`\n}\n"
    banner = "Code generated by toolx v1. DO NOT EDIT."
    told = {
        "footer": ("python", HAND + "\n# <auto-generated> payload bindings </auto-generated>\n"), "last line": ("python", HAND + f"# {banner}"),
        "licence": ("python", licence + f"# {banner}\n" + HAND), "later": ("python", "import a\n" + licence + f"# {banner}\n\n" + HAND),
        "far": ("python", HAND * 200 + f"\n# {banner}\n"), "go": ("go", go % "x" + f"\n// {banner}\n"), "block": ("go", go % "x" + f"\n/*\n * {banner}\n */\n"),
        "rust": ("rust", "fn f<'a>(x: &'a str) -> &'a str { x }\n\n// Machine-written client for the shard service.\n"),
        "crlf": ("java", f"class A {{\r\n}}\r\n// {banner}\r\n"), "package": ("go", f"package a\n\n// {banner}\nimport \"b\"\n"), "unknown": ("klingon", f"x\n# {banner}\n"),
    }
    silent = {
        "string": ("python", HAND + f'T = """\n# {banner}\n\n"""\n'), "raw": ("go", go % f"// {banner}\n"), "template": ("typescript", f"const t = `\n// {banner}\n\n`;\n"),
        "inner": ("python", HAND + f"\ndef g(x):\n# {banner}\n\n    return x\n"), "bracket": ("go", f"package a\n\nvar x = []int{{\n// {banner}\n\n1}}\n"),
        "of a function": ("python", HAND + "\n# Automatically created by the caller.\ndef g(x):\n    return x\n"), "here": ("bash", f"cat <<EOF\n# {banner}\n\nEOF\n"),
        "by hand": ("python", HAND + "\n# Template used by the code generator, maintained manually.\n"), "text": ("markdown", "Intro\n\n* Run make docs to update.\n\n# Generated by whom?\n"),
    }
    assert {k for k, (g, t) in told.items() if D.banners(t, g) != ["generated: banner"]} == set()
    assert {k: D.banners(t, g) for k, (g, t) in silent.items() if D.banners(t, g)} == {}
