"""What git says has changed; the answers are small and go into DataFrames."""

from __future__ import annotations

import os
import re
import subprocess
import time
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROBE_SECONDS, DIFF_SECONDS = 10, 30
HUNK = re.compile(r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@")


def _git(root: str, *args: str, seconds: int = PROBE_SECONDS) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=seconds)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def is_repo(root: str) -> bool:
    return _git(root, "rev-parse", "--git-dir") is not None


def ref_exists(root: str, ref: str) -> bool:
    return _git(root, "rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}") is not None


def merge_base(root: str, ref: str) -> str | None:
    out = _git(root, "merge-base", "HEAD", ref)
    return out.strip() if out else None


def changed_files(spark: SparkSession, root: str, ref: str) -> DataFrame | None:
    """path of every file that differs from ``ref``, under the repository's root; None if git fails."""
    top, out = _git(root, "rev-parse", "--show-toplevel"), _git(root, "diff", "--name-only", ref, seconds=DIFF_SECONDS)
    if top is None or out is None:
        return None
    return spark.createDataFrame([(os.path.join(top.strip(), p),) for p in out.splitlines() if p], "path string")


def hunks(diff: str) -> list[tuple[str, int, int]]:
    """(file, first line, lines) of the new side of each hunk that has any."""
    out, path = [], None
    for line in diff.splitlines():
        if line.startswith("+++ "):
            path = line[6:] if line.startswith("+++ b/") else None
        elif path and (m := HUNK.match(line)) and (n := int(m[2] or 1)):
            out.append((path, int(m[1]), n))
    return out


def changed_lines(spark: SparkSession, root: str, ref: str) -> DataFrame | None:
    """(path, line) of every line that differs from ``ref``."""
    top, out = _git(root, "rev-parse", "--show-toplevel"), _git(root, "diff", "--unified=0", ref, seconds=DIFF_SECONDS)
    if top is None or out is None:
        return None
    rows = spark.createDataFrame([(os.path.join(top.strip(), p), s, n) for p, s, n in hunks(out)], "path string, start int, n int")
    return rows.select("path", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("line"))


def cutoff(since: str, now: float | None = None) -> float:
    """Unix seconds of an ISO date, or of a span back from now: 30s, 5m, 2h, 7d, 1w."""
    if m := re.fullmatch(r"(\d+)([smhdw])", since.strip()):
        return (time.time() if now is None else now) - int(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}[m[2]]
    return datetime.fromisoformat(since).timestamp()


def modified_since(mtime: Column | str, since: str) -> Column:
    return (F.col(mtime) if isinstance(mtime, str) else mtime) > F.lit(cutoff(since))
