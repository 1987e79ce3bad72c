"""A directory tree as a table: a Python data source, one row an entry, contents read by the tasks.

``spark.dataSource.register(DirectorySource)``, then ``spark.read.format("loom_tree").option("root", ...).load()``.
Options: ``hidden`` (false), ``max_depth``, ``ignore`` (comma-separated patterns), ``excludes_file`` (a file of patterns for
all folders), ``contents`` (false), ``max_bytes`` of a content (64 MiB + 1; less is enough where texts are cut anyway),
``partitions`` (8). Columns as in ``SCHEMA``. Patterns also come from ``.gitignore`` and ``.ignore`` of each folder and
from ``.git/info/exclude``; the last one that fits decides, and ``!`` takes back. The driver lists folders only until
there are some for each task; the tasks walk what is below. Folders are pruned while walking, so what lies under an
ignored one is never listed. What can't be read is left out. Pass ``disk_size="size"`` to ``bounded_read``.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders for each task that the driver looks for before the tasks go on.
FOLDERS_A_TASK = 4
SCHEMA = "path string, is_dir boolean, depth int, size bigint, mtime_ms bigint, raw binary"


#: Bytes of a content that are read unless told otherwise: one more than the largest file that is read whole.
WHOLE_BYTES = (64 << 20) + 1


def _lines(file: str) -> list[str]:
    try:
        with open(file, encoding="utf-8", errors="replace") as f:
            return [x for line in f if (x := line.strip()) and not x.startswith("#")]
    except OSError:
        return []


def _patterns(folder: str) -> list[str]:
    return [p for name in (".git/info/exclude", ".gitignore", ".ignore") for p in _lines(os.path.join(folder, name))]


def _ignored(name: str, rel: str, is_dir: bool, patterns: list[tuple[str, str]]) -> bool:
    hit = False
    for base, p in patterns:
        wanted = not p.startswith("!")
        p = p if wanted else p[1:]
        if hit is wanted or p.endswith("/") and not is_dir:
            continue
        p = p.removesuffix("/")
        below = rel[len(base) :].lstrip("/") if rel.startswith(base) else rel
        if "/" in p:
            fits = fnmatch.fnmatchcase(below, p.lstrip("/")) or p.startswith("**/") and fnmatch.fnmatchcase(name, p[3:])
        else:
            fits = fnmatch.fnmatchcase(name, p)
        hit = wanted if fits else hit
    return hit


#: A folder that is still to be listed: path, depth, and the patterns that hold in it with the folder they come from.
Folder = tuple[str, int, list[tuple[str, str]]]


def walk(root: str, hidden: bool = False, max_depth: int | None = None, ignore: list[str] | None = None, todo: list[Folder] | None = None, until: int | None = None, seen: set[tuple[int, int]] | None = None) -> Iterator[tuple[str, bool, int, int | None, int | None]]:
    """(path, is_dir, depth, size, mtime_ms) of every entry below a folder; links are followed once.

    ``todo`` holds the folders to begin with, else the root. With ``until`` folders are listed level by level and the walk
    ends as soon as so many are left in ``todo``. ``seen`` holds what was listed before, so that no link leads back.
    """
    todo = [("", 0, [])] if todo is None else todo
    if until is not None and not todo:
        todo.append(("", 0, []))
    given = [("", p) for p in ignore or []]
    seen = set() if seen is None else seen
    while todo and (until is None or len(todo) < until):
        rel, depth, patterns = todo.pop(0 if until is not None else -1)
        folder = os.path.join(root, rel) if rel else root
        try:
            key = os.stat(folder)
            names = sorted(os.listdir(folder))
        except OSError:
            continue
        if (key.st_dev, key.st_ino) in seen:
            continue
        seen.add((key.st_dev, key.st_ino))
        patterns = patterns + [(rel, p) for p in _patterns(folder)]
        below = []
        for name in names:
            path = f"{rel}/{name}" if rel else name
            if not hidden and name.startswith("."):
                continue
            full = os.path.join(folder, name)
            try:
                is_dir = os.path.isdir(full)
                st = os.stat(full)
            except OSError:
                continue
            if _ignored(name, path, is_dir, given + patterns):
                continue
            if max_depth is not None and depth + 1 > max_depth:
                continue
            yield (path, True, depth + 1, None, None) if is_dir else (path, False, depth + 1, st.st_size, int(st.st_mtime * 1000))
            if is_dir:
                below.append((path, depth + 1, patterns))
        todo += below if until is not None else reversed(below)


class _Entries(InputPartition):
    def __init__(self, rows: list[tuple], folders: list[Folder], seen: set[tuple[int, int]]):
        self.rows, self.folders, self.seen = rows, folders, seen


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("root", ".")
        self.hidden = options.get("hidden", "false").lower() == "true"
        self.depth = int(options["max_depth"]) if "max_depth" in options else None
        self.ignore = (_lines(options["excludes_file"]) if "excludes_file" in options else []) + [x for x in options.get("ignore", "").split(",") if x]
        self.contents = options.get("contents", "false").lower() == "true"
        self.bytes = int(options.get("max_bytes", WHOLE_BYTES))
        self.n = max(1, int(options.get("partitions", 8)))

    def partitions(self):
        folders: list[Folder] = []
        seen: set[tuple[int, int]] = set()
        rows = list(walk(self.root, self.hidden, self.depth, self.ignore, folders, FOLDERS_A_TASK * self.n, seen))
        # by size, so that no task gets all large files
        order = sorted(range(len(rows)), key=lambda i: -(rows[i][3] or 0))
        n = min(self.n, max(1, len(rows) + len(folders)))
        return [_Entries([rows[i] for i in order[k::n]], folders[k::n], seen) for k in range(n)]

    def read(self, partition):
        below = walk(self.root, self.hidden, self.depth, self.ignore, list(partition.folders), seen=set(partition.seen)) if partition.folders else ()
        for path, is_dir, depth, size, mtime in chain(partition.rows, below):
            raw = None
            if self.contents and not is_dir:
                try:
                    with open(os.path.join(self.root, path), "rb") as f:
                        raw = f.read(self.bytes)
                except OSError:
                    raw = None
            yield (path, is_dir, depth, size, mtime, raw)


class DirectorySource(DataSource):
    """The data source ``loom_tree``."""

    @classmethod
    def name(cls) -> str:
        return "loom_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_tree(spark: SparkSession, root: str, **options):
    """A folder that driver and executors see, as a table."""
    spark.dataSource.register(DirectorySource)
    reader = spark.read.format("loom_tree").option("root", root)
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else v)
    return reader.load()
