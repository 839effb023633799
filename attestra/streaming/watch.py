"""Watching a tree: each change re-runs the scan.

A stream of ticks says when to look.  What the tree looked like is a table of paths and
fingerprints beside the checkpoint, joined with the listing of now; its last version is
read again after a restart.  It is replaced after a change was handled, so that a run that
was cut short sees the change again.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.tables import keep
from ..operators.algebra import fingerprint
from ..plans.scan import Report, scan_all, versions
from ..sources.files import WATCHED, Ticks, list_tree


def changes(now: DataFrame, seen: DataFrame | None) -> DataFrame:
    """path, change (added, changed, deleted) between two tables of path and fingerprint."""
    if seen is None:
        return now.select("path", F.lit("added").alias("change"))
    both = now.join(seen.select("path", F.col("fingerprint").alias("before")), "path", "full")
    change = F.when(F.col("before").isNull(), "added").when(F.col("fingerprint").isNull(), "deleted").when(F.col("fingerprint") != F.col("before"), "changed")
    return both.select("path", change.alias("change")).filter("change IS NOT NULL")


def watch(
    spark: SparkSession, path: str | list[str], then: Callable[[Report, DataFrame], None], checkpoint: str, seconds: int = 2, once: bool = False, suffixes: tuple[str, ...] = WATCHED, **options,
) -> StreamingQuery:
    """Calls ``then`` with a fresh report and the changes, whenever a file was added, changed or deleted; ``options`` are those of a scan."""
    spark.dataSource.register(Ticks)
    paths, folder = [path] if isinstance(path, str) else list(path), f"{checkpoint}/seen"

    def look(_: DataFrame, __: int) -> None:
        now = None
        for p in paths:
            part = list_tree(spark, p, suffixes, options.get("ignore", ())).select("path", fingerprint("mtime", "size").alias("fingerprint"))
            now = part if now is None else now.unionByName(part)
        now = keep(now.dropDuplicates(["path"]), "watch-now")
        known = versions(spark, folder)[-1:]
        told = keep(changes(now, spark.read.parquet(f"{folder}/{known[0]}") if known else None), "watch-changes")
        if not told.isEmpty():
            then(scan_all(spark, paths, **options), told)
            now.write.parquet(f"{folder}/rows-{time.time_ns():020d}")

    writer = spark.readStream.format("ticks").load().writeStream.foreachBatch(look).option("checkpointLocation", f"{checkpoint}/ticks")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()
