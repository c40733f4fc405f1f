"""Git revisions and histories as Spark data sources: ``git_files`` and ``git_log``, ``git_changes``, ``git_hunks``, ``git_blame``.

Each partition runs one git process over its share.  The repository must be
reachable from every executor.
"""

from __future__ import annotations

import logging
import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import LANGUAGES, SKIPPED_DIRS

#: Fixed value: fields of a commit.
FIELDS = ("%H", "%an", "%ae", "%cn", "%ce", "%aI", "%cI", "%P", "%s")


_SKIPPED = re.compile(rf"(^|/)({'|'.join(SKIPPED_DIRS)}|\.[^/]+)/")


def is_source(path: str) -> bool:
    """What :func:`weftspark.functions.text.readable` says of a path, for lists that are made before there are rows."""
    name = path.rsplit("/", 1)[-1]
    return "." in name and name.rsplit(".", 1)[1] in LANGUAGES and not name.endswith(".d.ts") and not _SKIPPED.search(path)


def git(repo: str, *args: str, stdin: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-C", repo, *args], input=stdin, capture_output=True)
    if done.returncode:
        raise OSError(f"git {args[0]}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


class _Share(InputPartition):
    def __init__(self, items: list) -> None:
        self.items = items


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.repo, self.rev = options["repo"], options.get("rev", "HEAD")
        self.subdir, self.share = options.get("subdir", "").strip("/"), int(options.get("share", 200))

    def listed(self) -> list:
        raise NotImplementedError

    def partitions(self) -> list[InputPartition]:
        items = self.listed()
        return [_Share(items[i : i + self.share]) for i in range(0, len(items), self.share)] or [_Share([])]

    def own_path(self, path: str) -> str:
        return path.removeprefix(f"{self.subdir}/") if self.subdir else path

    def scope(self) -> tuple[str, ...]:
        return ("--", self.subdir) if self.subdir else ()


#: Bytes of blobs that one share reads at once, about.
SHARE_BYTES = 32 << 20


class FilesReader(_Reader):
    """Source files of a revision: others are left out of the list, before any blob is read."""

    def listed(self) -> list:
        out = git(self.repo, "ls-tree", "-r", "-z", "--long", "--full-tree", self.rev, *self.scope())
        rows = ((meta.split(), self.own_path(path.decode(errors="replace"))) for meta, path in (x.split(b"\t", 1) for x in out.split(b"\0") if x))
        return [(meta[2].decode(), path, int(meta[3])) for meta, path in rows if meta[1] == b"blob" and is_source(path)]

    def partitions(self) -> list[InputPartition]:
        shares, size = [[]], 0
        for sha, path, n in self.listed():
            if shares[-1] and (len(shares[-1]) >= self.share or size + n > SHARE_BYTES):
                shares.append([])
                size = 0
            shares[-1].append((sha, path))
            size += n
        return [_Share(x) for x in shares]

    def read(self, partition: _Share) -> Iterator[tuple]:
        if not partition.items:
            return
        out = git(self.repo, "cat-file", "--batch", stdin="".join(f"{sha}\n" for sha, _ in partition.items).encode())
        at = 0
        for sha, path in partition.items:
            end = out.index(b"\n", at)
            head = out[at:end].split()
            if head[1] == b"missing":
                raise OSError(f"no blob {sha} for {path}")
            size = int(head[2])
            yield path, sha, bytearray(out[end + 1 : end + 1 + size])
            at = end + size + 2


class LogReader(_Reader):
    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.limit, self.range = int(options.get("limit", 0)), options.get("range") or self.rev

    def shas(self) -> list[str]:
        most = (f"-n{self.limit}",) if self.limit else ()
        return git(self.repo, "log", "--date-order", "--format=%H", *most, self.range, *self.scope()).decode().split()

    def listed(self) -> list:
        return list(enumerate(self.shas()))

    def read(self, partition: _Share) -> Iterator[tuple]:
        if not partition.items:
            return
        place = {sha: pos for pos, sha in partition.items}
        out = git(self.repo, "log", "--use-mailmap", "--no-walk=unsorted", "--stdin", "--format=" + "%x1f".join(FIELDS), stdin="".join(f"{s}\n" for s in place).encode())
        for line in out.decode(errors="replace").split("\n"):
            if line:
                parts = line.split("\x1f")
                if len(parts) != len(FIELDS):
                    raise ValueError(f"{len(parts)} fields in a log row")
                yield (place[parts[0]], *parts)


class ChangesReader(LogReader):
    def read(self, partition: _Share) -> Iterator[tuple]:
        if not partition.items:
            return
        out = git(self.repo, "diff-tree", "--stdin", "-r", "--name-status", "-z", "-M", "-C", "--root", stdin="".join(f"{s}\n" for _, s in partition.items).encode())
        known, sha = {s for _, s in partition.items}, ""
        parts = iter(out.decode(errors="replace").split("\0"))
        for x in parts:
            x = x.strip("\n")
            if x in known:
                sha = x
            elif x:
                old = next(parts) if x[0] in "RC" else ""
                path = next(parts)
                if not self.subdir or path.startswith(f"{self.subdir}/"):
                    yield sha, x[0], self.own_path(path), self.own_path(old)


class BlameReader(FilesReader):
    def read(self, partition: _Share) -> Iterator[tuple]:
        for _, path in partition.items:
            full = f"{self.subdir}/{path}" if self.subdir else path
            try:
                out = git(self.repo, "blame", "--line-porcelain", "-w", "-M", "-C", self.rev, "--", full)
            except OSError as problem:
                logging.getLogger(__name__).warning("no owners of %s: %s", full, problem)
                continue
            row: dict[str, str] = {}
            for line in out.decode(errors="replace").split("\n"):
                if line.startswith("\t"):
                    yield path, int(row["line"]), row["sha"], row["author"], row["author-mail"].strip("<>"), int(row["author-time"])
                    row = {}
                else:
                    word, _, rest = line.partition(" ")
                    if not row and word:
                        row = {"sha": word, "line": rest.split()[1]}
                    else:
                        row[word] = rest


_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def _plain_path(path: str) -> str:
    """A path as git quotes it where it holds quotes, tabs or line ends."""
    if path.startswith('"') and path.endswith('"'):
        return path[1:-1].encode("latin-1", "backslashreplace").decode("unicode_escape").encode("latin-1", "replace").decode(errors="replace") if path.isascii() else path[1:-1]
    return path


def parse_patch(out: str, pairs: dict[tuple[str, str], tuple[str, str]]) -> Iterator[tuple]:
    """(base, head, status, path, old_path, side, first_line, last_line) of git's raw and patch output for pairs of trees.

    Each changed file has a row for the lines of each side of each hunk; without any
    (a rename alone, a binary file) one row without a side.
    """
    pair, files, at, told = ("", ""), [], -1, False

    def bare() -> Iterator[tuple]:
        if at >= 0 and not told:
            yield (*pair, *files[at], None, None, None)

    for line in out.split("\n"):
        words = line.split(" ")
        if len(words) == 2 and (words[0], words[1]) in pairs:
            yield from bare()
            pair, files, at, told = pairs[words[0], words[1]], [], -1, False
        elif line.startswith(":"):
            status, *names = line.split("\t")
            names = [_plain_path(n) for n in names]
            files.append((status.split(" ")[4][0], names[-1], names[0]))
        elif line.startswith("diff --git "):
            yield from bare()
            at, told = at + 1, False
        elif at >= 0 and (m := _HUNK.match(line)):
            for side, first, count in (("removed", m[1], m[2]), ("added", m[3], m[4])):
                n = int(count) if count is not None else 1
                if n:
                    told = True
                    yield (*pair, *files[at], side, int(first), int(first) + n - 1)
    yield from bare()


class HunksReader(_Reader):
    """Changed lines between pairs of revisions, ``pairs`` (``base head``, one a line) or ``base`` and ``head``; one git process for all pairs of a share."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        listed = options.get("pairs") or f"{options['base']} {options.get('head', 'HEAD')}"
        self.pairs = [tuple(x.split()) for x in listed.split("\n") if x.strip()]

    def listed(self) -> list:
        trees = git(self.repo, "rev-parse", *(f"{r}^{{tree}}" for pair in self.pairs for r in pair)).decode().split()
        return [(pair, (a, b)) for pair, a, b in zip(self.pairs, trees[::2], trees[1::2], strict=True)]

    def read(self, partition: _Share) -> Iterator[tuple]:
        asked: dict[tuple[str, str], list[tuple[str, str]]] = {}
        for pair, trees in partition.items:
            asked.setdefault(tuple(trees), []).append(tuple(pair))
        if not asked:
            return
        out = git(self.repo, "-c", "core.quotePath=false", "diff-tree", "--stdin", "-r", "--raw", "--patch", "-U0", "-M", "--no-color", "--no-ext-diff", "--abbrev=40", *self.scope(), stdin="".join(f"{a} {b}\n" for a, b in asked).encode())
        trees = {k: k for k in asked}
        for a, b, status, path, old, *lines in parse_patch(out.decode(errors="replace"), trees):
            for pair in asked[a, b]:
                yield (*pair, status, self.own_path(path), self.own_path(old), *lines)


def _source(title: str, columns: str, reader_type: type) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return title

        def schema(self) -> str:
            return columns

        def reader(self, schema) -> DataSourceReader:
            return reader_type(self.options)

    return Source


SOURCES = (
    _source("git_files", "path string, hash string, content binary", FilesReader),
    _source("git_log", "pos int, sha string, author_name string, author_email string, committer_name string, committer_email string, authored_at string, committed_at string, parents string, subject string", LogReader),
    _source("git_changes", "sha string, status string, path string, renamed_from string", ChangesReader),
    _source("git_hunks", "base string, head string, status string, path string, old_path string, side string, first_line int, last_line int", HunksReader),
    _source("git_blame", "path string, line int, sha string, author_name string, author_email string, author_time long", BlameReader),
)


def register(spark: SparkSession) -> None:
    for source in SOURCES:
        spark.dataSource.register(source)
