"""Shared helpers: tables in the cluster's shared folder, null-safe keys, the word pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import keep, keep_small, shared_dir

__all__ = ["WORD", "fold", "keep", "keep_small", "only", "read_table", "shared_dir", "worker_cache"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_caches: list[dict] = []


def worker_cache() -> dict:
    """A dict that a Python worker fills over its tasks, for functions that are pickled by their name."""
    _caches.append({})
    return _caches[-1]


def only(own: dict) -> None:
    """Empties the other operators' caches: a worker goes from one operator to the next, and would hold them all."""
    for other in _caches:
        if other and other is not own:
            other.clear()


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % n


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
