import subprocess

import pytest

from tallyweave import config
from tallyweave.operators.search import OverlapReranker
from tallyweave.operators.store import SearchFilter
from tallyweave.workspace import Workspace

CONFIG = """
[workspace]
name = "w"
store = "store"
[[repos]]
id = "core"
path = "core"
[[repos]]
id = "web"
path = "web"
ignore = ["skip/*"]
[[references]]
prefix = "TRK-"
url = "https://t.example/{key}"
"""


def commit(root, message, **files):
    root.mkdir(exist_ok=True)
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    if not (root / ".git").exists():
        run("init", "-q")
    for name, text in files.items():
        (root / name.replace("__", ".")).write_text(text)
    run("add", ".")
    run("commit", "-qm", message)


@pytest.fixture
def workspace(spark, tmp_path):
    (tmp_path / "tallyweave.toml").write_text(CONFIG)
    commit(tmp_path / "core", "Add the retry policy\n\nRefs: TRK-7", retry__py="def retry_policy(limit):\n    # first try\n    return limit\n\nclass BackoffWindow:\n    size = 3\n", pyproject__toml='[project]\nname = "core"\n')
    commit(tmp_path / "web", "Use it", app__js='import { retryPolicy } from "core";\nexport function startApp(x) {\n  return retryPolicy(x, BackoffWindow);\n}\n', package__json='{"name": "web", "dependencies": {"core": "1"}}')
    return Workspace(spark, config.load(tmp_path)), tmp_path


def test_index_search_and_reports(workspace):
    w, root = workspace
    assert {(r.repo, r.reason) for r in w.index().collect()} == {("core", "never indexed"), ("web", "never indexed")}
    assert w.index().count() == 0 and w.unsearched() == []
    lock = root / "store" / "writer.lock"
    lock.write_text("")
    with pytest.raises(RuntimeError, match="another pass"):
        w.index()
    lock.unlink()
    rows = w.search("retry policy limit", k=5).orderBy("place").collect()
    assert rows and rows[0].path == "retry.py"
    assert {r.repo for r in w.search_many(["retry"], 5, repo="web").collect()} <= {"web"}
    assert {r.lang for r in w.search_many(["retry"], 5, filters=SearchFilter(lang=("javascript",))).collect()} == {"javascript"}
    with pytest.raises(ValueError):
        w.search_many(["x"], repo="nowhere")
    refs = {(r.repo, r.kind) for r in w.references("retry_policy").collect()}
    assert ("core", "defines") in refs and ("web", "mentions") in refs
    because = w.why("retry.py:2").collect()
    assert because and because[0].reason.startswith("Add the retry policy") and because[0].refs == "TRK-7"
    assert {(r.status, r.user, r.owner) for r in w.deps().collect()} == {("used", "web", "core")}
    assert w.stats().first().searches == 1
    assert {r.rel_path: r.skip for r in w.explain("web").where("NOT rel_path LIKE '.git/%'").collect()} == {"app.js": None, "package.json": None}
    commit(root / "web", "More", more__js="export function another(a) {\n  return a;\n}\n")
    before = {(r.repo, r.path, r.id) for r in w.table("chunks").collect()}
    pass_ = w.index().collect()
    assert [(r.repo, r.reason, r.read) for r in pass_] == [("web", "new commits", 1)]
    now = {(r.repo, r.path, r.id) for r in w.table("chunks").collect()}
    assert before <= now and {p for _, p, _ in now - before if not p.startswith("commits/")} == {"more.js"} and pass_[0].embedded == len(now - before)
    assert {(r.status, r.user, r.owner) for r in w.deps().collect()} == {("used", "web", "core")}
    assert ("web", "mentions") in {(r.repo, r.kind) for r in w.references("retry_policy").collect()}
    assert w.why("more.js:2").collect()[0].reason == "More"
    # One file goes, one is renamed: their chunks follow, nothing that was stored is embedded again.
    (root / "web" / "more.js").rename(root / "web" / "other.js")
    commit(root / "web", "Move")
    moved = w.index().collect()
    paths = {r.path for r in w.table("chunks").where("repo = 'web' AND kind <> 'commit'").collect()}
    assert moved[0].read == 1 and paths == {"app.js", "package.json", "other.js"}
    (root / "web" / "other.js").rename(root / "web" / "more.js")
    commit(root / "web", "Move back")
    w.index()
    assert w.forget() == 1 and w.table("searches").count() == 0
    w.reranker = OverlapReranker()
    assert {r.path for r in w.search_many(["another function"], 3, rewordings=1).collect()} & {"more.js"}
    before, after = w.compact("links")
    assert before > 0 and after > 0


def test_config_is_strict(tmp_path):
    with pytest.raises(ValueError, match="unknown section"):
        config.parse("[nonsense]\na = 1\n", tmp_path)
    with pytest.raises(ValueError, match="unknown keys"):
        config.parse("[workspace]\nnam = 'x'\n", tmp_path)
    with pytest.raises(ValueError, match="same id"):
        config.parse("[[repos]]\nid='a'\npath='.'\n[[repos]]\nid='a'\npath='.'\n", tmp_path)
    one = config.parse("[[repos]]\nid='a'\npath='.'\nignore=['x']\n", tmp_path).repositories[0]
    assert one.markup_key != config.Repository("a", one.path).markup_key
