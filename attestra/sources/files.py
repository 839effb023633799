"""Source trees as tables.

Spark's own file sources leave out names that begin with a dot or an underscore, and its
file stream reports neither changes nor deletions; both matter here.  A tree is listed by
the executors, which must see it: a frontier of folders is a table, a task walks down from
its folders until it has met ``WALK`` entries, and the folders that are left are the next
frontier.  A small tree takes one round; no process ever holds all names.  The files are
then dealt to tasks by their bytes and read.

A link to a folder is listed as the folder that it leads to only if it is the root.
"""

from __future__ import annotations

import fnmatch
import itertools
import os
from collections import deque
from collections.abc import Iterator, Sequence
from pathlib import Path, PurePath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..functions.tables import keep
from ..operators.algebra import EXCLUDED_DIRS
from ..plans.schema import FILES

SUFFIXES = (".py", ".md", ".yaml", ".yml", ".toml")
JS_SUFFIXES = (".js", ".ts", ".jsx", ".tsx")
WATCHED = (".py", ".md", ".rst", ".toml", ".yaml", ".yml")
#: The file of ignore rules, unless the caller names another.
IGNORE_FILE = ".docsignore"
BATCH_BYTES = 8 << 20
#: Entries that a task meets before it leaves the rest of its folders to the next round.
WALK = 2000


def rules(root: str, ignore_file: str = IGNORE_FILE) -> list[str]:
    try:
        lines = Path(root, ignore_file).read_text().splitlines()
    except OSError:
        return []
    return [s for line in lines if (s := line.strip()) and not s.startswith("#")]


def ignored(rel: str, patterns: Sequence[str], globs: Sequence[str] = ()) -> bool:
    """Globs: any hit drops.  Patterns: in order, the last match decides, ``!`` takes back."""
    name = rel.rsplit("/", 1)[-1]
    if any(fnmatch.fnmatch(rel if "/" in g else name, g) for g in globs):
        return True
    out = False
    for pattern in patterns:
        back, p = pattern.startswith("!"), pattern.lstrip("!")
        if p.endswith("/"):
            hit = p.rstrip("/") in PurePath(rel).parts[:-1] or rel.startswith(p)
        else:
            hit = PurePath(rel if "/" in p or "**" in p else name).match(p)
        out = (not back) if hit else out
    return out


def _wanted(name: str, rel: str, options: dict) -> bool:
    return name.endswith(tuple(options["suffixes"])) and not ignored(rel, options["patterns"], options["globs"])


def _walked(folders: list[str], options: dict) -> Iterator[tuple]:
    """(path, rel_path, size, mtime, is_folder): the wanted files below the folders, and the folders that are left after ``WALK`` entries.  What cannot be listed is empty."""
    queue, met = deque(folders), 0
    while queue:
        rel = queue.popleft()
        if met >= WALK:
            yield os.path.join(options["root"], rel), rel, 0, 0.0, True
            continue
        try:
            entries = sorted(os.scandir(os.path.join(options["root"], rel)), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            met += 1
            own = f"{rel}/{e.name}" if rel else e.name
            try:
                if e.is_dir(follow_symlinks=False):
                    if e.name not in EXCLUDED_DIRS:
                        queue.append(own)
                elif e.is_file() and _wanted(e.name, own, options):
                    s = e.stat()
                    yield os.path.join(options["root"], own), own, s.st_size, s.st_mtime, False
            except OSError:
                continue


LISTED = "path string, rel_path string, size long, mtime double, is_folder boolean"


def list_tree(spark: SparkSession, root: str, suffixes: Sequence[str] = SUFFIXES, globs: Sequence[str] = (), ignore_file: str = IGNORE_FILE) -> DataFrame:
    """path, rel_path, size, mtime of the files of a scan; of a single file, itself."""
    if set(Path(os.path.abspath(root)).parts) & set(EXCLUDED_DIRS):
        return spark.createDataFrame([], LISTED).drop("is_folder")
    if os.path.isfile(root):
        s = os.stat(root)
        rows = [(root, os.path.basename(root), s.st_size, s.st_mtime)] if root.endswith(tuple(suffixes)) else []
        return spark.createDataFrame(rows, LISTED.replace(", is_folder boolean", ""))
    options = {"root": root, "suffixes": list(suffixes), "globs": list(globs), "patterns": rules(root, ignore_file)}

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = _walked(list(batch["rel_path"]), options)
            while part := list(itertools.islice(rows, 10000)):
                yield pd.DataFrame(part, columns=[c.split(" ")[0] for c in LISTED.split(", ")])

    frontier, out = spark.createDataFrame([("",)], "rel_path string"), None
    while True:
        level = keep(frontier.mapInPandas(walk, LISTED), "tree-level")
        files = level.filter("NOT is_folder").drop("is_folder")
        out = files if out is None else out.unionByName(files)
        left = level.filter("is_folder")
        n = left.count()
        if not n:
            return out
        frontier = left.select("rel_path").repartition(min(n, 1 << 14))


def read_files(spark: SparkSession, root: str, suffixes: Sequence[str] = SUFFIXES, ignore: Sequence[str] = (), ignore_file: str = IGNORE_FILE) -> DataFrame:
    """The files of a tree with their texts (FILES); bytes that are not UTF-8 are replaced; a file that has gone since it was listed is left out."""
    listed = list_tree(spark, root, suffixes, ignore, ignore_file)
    total = listed.agg(F.sum(F.col("size") + 4096)).first()[0] or 0

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in FILES.split(", ")]
        for batch in batches:
            rows, room = [], BATCH_BYTES
            for path, rel, size, mtime in zip(batch["path"], batch["rel_path"], batch["size"], batch["mtime"]):
                try:
                    with open(path, encoding="utf-8", errors="replace") as f:
                        rows.append((path, rel, os.path.basename(path), os.path.splitext(path)[1], size, mtime, f.read()))
                except OSError:
                    continue
                room -= size
                if room <= 0:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, room = [], BATCH_BYTES
            yield pd.DataFrame(rows, columns=columns)

    return listed.repartition(max(1, min(1 << 16, -(-total // BATCH_BYTES)))).mapInPandas(read, FILES)


class _Ticks(SimpleDataSourceStreamReader):
    """One row a batch: when it is time to look again.  The offset is a number, whatever the tree holds."""

    def initialOffset(self) -> dict:
        return {"tick": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        return iter([(start["tick"],)]), {"tick": start["tick"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(i,) for i in range(start["tick"], end["tick"])])


class Ticks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ticks"

    def schema(self) -> str:
        return "tick long"

    def simpleStreamReader(self, schema) -> _Ticks:
        return _Ticks()
