"""Git repositories as tables: a Python data source for files, commits and blame.

One partition per repository (or per slice of files for blame). The stream form
offers the commits between two offsets, an offset being {repository: commit}.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

TIMEOUT = 120
#: Commits of a full pass, and those whose files are paired; options ``most_commits`` and
#: ``most_paired`` change them, 0 reads all.
MOST_COMMITS, MOST_PAIRED = 10_000, 400


def git(root: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, timeout=TIMEOUT).stdout


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def head(root: str) -> str:
    return _text(git(root, "rev-parse", "HEAD")).strip()


def is_dirty(root: str) -> bool:
    return bool(git(root, "status", "--porcelain", "-z"))


def name_status(raw: bytes) -> tuple[list[str], list[str]]:
    """(changed, deleted) of ``diff --name-status -z``; a rename counts on both sides."""
    parts = iter(_text(raw).split("\0"))
    changed, deleted = [], []
    for status in parts:
        if not status:
            continue
        letter = status[0]
        path = next(parts)
        if letter in "AMT":
            changed.append(path)
        elif letter == "D":
            deleted.append(path)
        elif letter == "R":
            deleted.append(path)
            changed.append(next(parts))
        elif letter == "C":
            changed.append(next(parts))
        else:
            raise ValueError(f"unknown status {status!r}")
    return changed, deleted


def diff_since(root: str, since: str | None = None) -> tuple[list[str], list[str]]:
    if since is None:
        return [p for p in _text(git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard")).split("\0") if p], []
    return name_status(git(root, "diff", "--name-status", "-z", since, "HEAD"))


def knows(root: str, sha: str) -> bool:
    """Whether a commit is still an ancestor of the head."""
    try:
        git(root, "merge-base", "--is-ancestor", sha, "HEAD")
    except subprocess.CalledProcessError:
        return False
    return True


def commits(root: str, since: str | None = None, most: int | None = MOST_COMMITS) -> Iterator[tuple[str, str, str]]:
    """(sha, author date, message), newest first; a full pass stops at ``most``, null for no bound."""
    span = [f"{since}..HEAD"] if since else [*([f"-n{most}"] if most else []), "HEAD"]
    for record in _text(git(root, "log", "--format=%H%x1f%aI%x1f%B%x1e", *span)).split("\x1e"):
        fields = record.strip("\n").split("\x1f")
        if len(fields) == 3:
            yield fields[0], fields[1], fields[2].strip()


def commit_files(root: str, most: int | None = MOST_PAIRED) -> Iterator[tuple[str, str]]:
    """(sha, path) of the last ``most`` commits, null for all."""
    sha = None
    for line in _text(git(root, "log", "--name-only", *([f"-n{most}"] if most else []), "--format=%x1e%H")).split("\n"):
        if line.startswith("\x1e"):
            sha = line[1:]
        elif line and sha:
            yield sha, line


def blame(root: str, path: str) -> Iterator[tuple[int, str]]:
    """(line, sha) of a file."""
    for line in _text(git(root, "blame", "--porcelain", "--", path)).split("\n"):
        parts = line.split(" ")
        if len(parts) >= 3 and len(parts[0]) == 40 and not line.startswith("\t"):
            yield int(parts[2]), parts[0]


SCHEMAS = {
    "files": "repo string, rel_path string, change string",
    "commits": "repo string, sha string, author_date string, message string",
    "commit_files": "repo string, sha string, path string",
    "blame": "repo string, path string, line int, sha string",
}


class _Slice(InputPartition):
    def __init__(self, repo: str, root: str, since: str | None = None, paths: tuple[str, ...] = (), most: tuple[int, int] = (MOST_COMMITS, MOST_PAIRED)) -> None:
        self.repo, self.root, self.since, self.paths, self.most = repo, root, since, paths, most


def rows_of(what: str, part: _Slice) -> Iterator[tuple]:
    if what == "files":
        changed, deleted = diff_since(part.root, part.since)
        for kind, paths in (("changed", changed), ("deleted", deleted)):
            yield from ((part.repo, p, kind) for p in paths)
    elif what == "commits":
        yield from ((part.repo, *c) for c in commits(part.root, part.since, part.most[0]))
    elif what == "commit_files":
        yield from ((part.repo, *c) for c in commit_files(part.root, part.most[1]))
    else:
        for p in part.paths:
            yield from ((part.repo, p, *x) for x in blame(part.root, p))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.what = options.get("table", "files")
        self.roots = json.loads(options["repos"])
        self.since = json.loads(options.get("since", "{}"))
        self.most = int(options.get("most_commits", MOST_COMMITS)), int(options.get("most_paired", MOST_PAIRED))

    def partitions(self) -> list[InputPartition]:
        if self.what != "blame":
            return [_Slice(r, root, self.since.get(r), most=self.most) for r, root in self.roots.items()]
        out: list[InputPartition] = []
        for r, root in self.roots.items():
            paths = sorted(diff_since(root, self.since.get(r))[0])
            out += [_Slice(r, root, None, tuple(paths[i : i + 64])) for i in range(0, len(paths), 64)]
        return out

    def read(self, partition: _Slice) -> Iterator[tuple]:
        yield from rows_of(self.what, partition)


class _StreamReader(DataSourceStreamReader):
    """Commits or changed files since the last offset; a dirty tree does not move it."""

    def __init__(self, options: dict) -> None:
        self.what = options.get("table", "commits")
        self.roots = json.loads(options["repos"])
        self.last: dict = {r: None for r in self.roots}

    def initialOffset(self) -> dict:
        return {r: None for r in self.roots}

    def latestOffset(self) -> dict:
        now = {r: (self.last.get(r) if is_dirty(root) else head(root)) for r, root in self.roots.items()}
        self.last = now
        return now

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Slice(r, root, start.get(r)) for r, root in self.roots.items() if end.get(r) and start.get(r) != end.get(r)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        yield from rows_of(self.what, partition)

    def commit(self, end: dict) -> None:
        self.last = end


class GitSource(DataSource):
    """``spark.read.format("git")`` with ``repos`` (JSON of name to folder) and ``table``."""

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "files")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitSource)
