"""python -m tallyweave COMMAND ...: the workspace from a shell."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tallyweave import config
from tallyweave.operators.store import SearchFilter
from tallyweave.workspace import Workspace


def main() -> None:
    p = argparse.ArgumentParser(prog="tallyweave")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "status", "drift", "deps", "stats", "compact"):
        sub.add_parser(name)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("-k", type=int, default=20)
    s.add_argument("--repo")
    for f in ("lang", "kind", "path", "symbol"):
        s.add_argument(f"--{f}", action="append", default=[])
    for name, arg in (("refs", "name"), ("why", "target"), ("explain", "repo")):
        sub.add_parser(name).add_argument(arg)
    sub.add_parser("dupes").add_argument("--min", type=float, default=0.45)
    a = p.parse_args()
    w = Workspace(SparkSession.builder.appName("tallyweave").getOrCreate(), config.load())
    if a.command == "search":
        picked = SearchFilter(tuple(a.lang), tuple(a.kind), tuple(a.path), tuple(a.symbol))
        w.search(a.query, a.k, a.repo, picked).select("place", "repo", "path", "start_line", "end_line", "symbol", "score").orderBy("place").show(a.k, False)
    elif a.command == "compact":
        print("%d -> %d bytes" % w.compact())
    elif a.command == "status":
        print("not indexed:", ", ".join(w.unsearched()) or "none")
    else:
        made = {"index": w.index, "drift": w.drift, "deps": w.deps, "stats": w.stats}.get(a.command)
        rows = made() if made else w.references(a.name) if a.command == "refs" else w.why(a.target) if a.command == "why" else w.explain(a.repo) if a.command == "explain" else w.dupes(a.min)
        rows.show(50, False)


if __name__ == "__main__":
    main()
