"""Discovery connectors: what a source holds now, without reading content.

Spark data sources ``file_tree``, ``git_repo`` and ``mail_labels``. Spark's own
binaryFile reader is no substitute: it skips dotfiles, underscore names and
empty files, and keeps modification times only to the millisecond.
"""

from __future__ import annotations

import os
import sqlite3
import subprocess
from collections import deque
from collections.abc import Iterator
from contextlib import closing, suppress
from pathlib import PurePosixPath
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gleanery.config import Source
from gleanery.functions.text import is_commit
from gleanery.sources.globs import selected

# Names that belong to the mirroring tools, not to the corpus.
LABEL_DB = "msg-db.sqlite"
IGNORED_FOLDERS = (".git",)
DEFAULT_BRANCH = "main"
_NAME_HINTS, _LABEL_HINTS = ("filename", "file_name", "fname"), ("labels", "label")

_SPLITS = 256  # tasks to share a tree among, at least
_FILES_PER_SHARE = 20_000  # files of one folder that one task looks at


class Folders(InputPartition):
    """Folders of one task, each with whether to walk below it, and which share of how many of its files is meant."""

    def __init__(self, entries: list[tuple[str, bool, int, int]]):
        self.entries = entries


def _listing(folder: str) -> tuple[list[os.DirEntry], list[str]]:
    """(files, subfolders); links to folders are not followed."""
    files, folders = [], []
    with os.scandir(folder) as entries:
        for entry in entries:
            if entry.is_dir(follow_symlinks=False):
                if entry.name not in IGNORED_FOLDERS:
                    folders.append(entry.path)
            elif entry.is_file():
                files.append(entry)
    return files, sorted(folders)


class FileTreeReader(DataSourceReader):
    """Folders are opened one by one until there are enough to share out; the
    tasks walk what lies below, so one deep branch does not become one task.
    A large folder among those opened is shared by a hash of its files' names."""

    def __init__(self, options: dict):
        self.root = options["root"].rstrip("/")
        self.suffix = options.get("suffix", "")
        self.splits = int(options.get("splits", _SPLITS))
        self.per_share = int(options.get("per_share", _FILES_PER_SHARE))

    def partitions(self) -> list[InputPartition]:
        opened, waiting = [], deque([self.root])
        while waiting and len(waiting) < self.splits:
            folder = waiting.popleft()
            files, below = _listing(folder)
            shares = len(files) // self.per_share + 1
            opened += [(folder, False, share, shares) for share in range(shares)]
            waiting += below
        entries = opened + [(folder, True, 0, 1) for folder in waiting]
        tasks = min(max(self.splits, len(opened)), len(entries))
        return [Folders(entries[i::tasks]) for i in range(tasks)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        todo = list(partition.entries)
        while todo:
            folder, deep, share, shares = todo.pop()
            files, below = _listing(folder)
            if deep:
                todo += [(sub, True, 0, 1) for sub in below]
            for entry in files:
                if entry.name == LABEL_DB or not entry.name.endswith(self.suffix):
                    continue
                if shares > 1 and crc32(os.fsencode(entry.name)) % shares != share:
                    continue
                stat = entry.stat()
                yield os.path.relpath(entry.path, self.root), f"{stat.st_mtime_ns}:{stat.st_size}", None


class FileTree(DataSource):
    """Options: ``root``, ``suffix`` (only names ending so), ``splits``, ``per_share``."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "path string, stat_sig string, git_sha string"

    def reader(self, schema) -> DataSourceReader:
        return FileTreeReader(self.options)


class Listing(InputPartition):
    def __init__(self, command: tuple[str, ...]):
        self.command = command


def git(root: str, *args: str) -> list[str]:
    return ["git", "-C", root, *args]


def _records(command: list[str], end: bytes) -> Iterator[str]:
    """The output of ``command``, split at ``end``, as it arrives."""
    with subprocess.Popen(command, stdout=subprocess.PIPE) as process:
        rest = b""
        while block := process.stdout.read(1 << 16):
            *whole, rest = (rest + block).split(end)
            for record in whole:
                yield record.decode("utf-8", "replace")
        if rest:
            yield rest.decode("utf-8", "replace")
    if process.returncode:
        raise RuntimeError(f"{' '.join(command)} failed with exit code {process.returncode}")


class GitReader(DataSourceReader):
    """One task lists the tracked files, another the commits; both stream."""

    def __init__(self, options: dict):
        self.root, self.branch = options["root"], options.get("branch", DEFAULT_BRANCH)

    def partitions(self) -> list[InputPartition]:
        return [
            Listing(("ls-tree", "-r", "-z", "--full-tree", self.branch)),
            Listing(("log", self.branch, "--format=%H")),
        ]

    def read(self, partition: Listing) -> Iterator[tuple]:
        tree = partition.command[0] == "ls-tree"
        for record in _records(git(self.root, *partition.command), b"\0" if tree else b"\n"):
            if not tree:
                yield f"commit/{record}", None, record
                continue
            entry, path = record.split("\t", 1)
            _, kind, sha = entry.split(" ")
            if kind == "blob":
                yield path, None, sha


class GitRepo(DataSource):
    """Options: ``root``, ``branch``."""

    @classmethod
    def name(cls) -> str:
        return "git_repo"

    def schema(self) -> str:
        return "path string, stat_sig string, git_sha string"

    def reader(self, schema) -> DataSourceReader:
        return GitReader(self.options)


#: The usual layout of the side database.
_USUAL = "SELECT message_filename, label FROM messages JOIN labels USING (message_num)"
#: Per table, its first column whose name holds one of the words for a file, and for labels.
_COLUMN = "(SELECT c.name FROM pragma_table_info(t.name) AS c WHERE {} ORDER BY c.cid LIMIT 1)"
_SHAPES = "SELECT t.name, {}, {} FROM sqlite_master AS t WHERE t.type = 'table' ORDER BY t.rowid".format(*[
    _COLUMN.format(" OR ".join(f"lower(c.name) LIKE '%{h.replace('_', '!_')}%' ESCAPE '!'" for h in hints))
    for hints in (_NAME_HINTS, _LABEL_HINTS)])


class MailLabelReader(DataSourceReader):
    """Label rows of the mail mirror's side database; unreadable ones hold no labels.

    The usual layout is a table of messages and one of labels. Where it gives no row, every
    table with a column for file names and one for labels serves, its labels split
    at commas; for a file named twice the last row counts.
    """

    def __init__(self, options: dict):
        self.file = os.path.join(options["root"], LABEL_DB)

    def read(self, partition) -> Iterator[tuple]:
        if not os.path.isfile(self.file):
            return
        with suppress(sqlite3.Error), closing(sqlite3.connect(f"file:{self.file}?mode=ro", uri=True)) as db:
            single = False
            with suppress(sqlite3.Error):
                for n, (name, label) in enumerate(db.execute(f"{_USUAL} WHERE message_filename <> '' AND label <> ''")):
                    single = True
                    yield PurePosixPath(str(name)).stem, n, [str(label).strip()], False
            if single:
                return
            fitting = [(table, name, labels) for table, name, labels in db.execute(_SHAPES) if name and labels]
            lists = " UNION ALL ".join('SELECT "{1}", "{2}" FROM "{0}"'.format(*(x.replace('"', '""') for x in shape)) for shape in fitting)
            for n, (name, labels) in enumerate(db.execute(lists) if lists else ()):
                items = list(filter(None, map(str.strip, str(labels or "").split(","))))
                if name and items:
                    yield PurePosixPath(str(name)).stem, n, items, True


class MailLabels(DataSource):
    """Option: ``root``. ``alone`` rows replace earlier ones of the same stem."""

    @classmethod
    def name(cls) -> str:
        return "mail_labels"

    def schema(self) -> str:
        return "stem string, n long, labels array<string>, alone boolean"

    def reader(self, schema) -> DataSourceReader:
        return MailLabelReader(self.options)


def probes(spark: SparkSession, source: Source) -> DataFrame:
    """``source, path, stat_sig, git_sha`` of everything the source holds now."""
    if source.type == "gitrepo":
        spark.dataSource.register(GitRepo)
        found = spark.read.format("git_repo").options(
            root=source.root, branch=source.branch or DEFAULT_BRANCH
        ).load()
    else:
        spark.dataSource.register(FileTree)
        suffix = ".eml" if source.type == "eml_tree" else ""
        splits = max(_SPLITS, 4 * spark.sparkContext.defaultParallelism)
        found = spark.read.format("file_tree").options(root=source.root, suffix=suffix, splits=splits).load()
    wanted = selected(F.col("path"), source.include, source.exclude)
    if source.type == "gitrepo":
        wanted = wanted | is_commit(F.col("path"))
    found = found.where(wanted)
    return found.select(F.lit(source.name).alias("source"), "path", "stat_sig", "git_sha")
