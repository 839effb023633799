"""Exact top-k by Hamming distance: incremental multi-index hashing.

A binary code is cut into segments.  Two codes that differ in d bits differ in at most
d // segments bits of some segment, so buckets of segment values find every neighbour:
round s probes all buckets whose value differs from the query's in exactly s bits.
After it every code within segments * (s + 1) - 1 bits has been met and verified, and a
query ends as soon as its k-th verified distance is no more than that.

Codes go in blocks of about ``CODES`` by their hash; each block, with a block of queries, is
one task, which indexes its codes by segment and grows the radii of each query.  A round
that has more buckets to probe than the block has codes verifies all that are left
instead.  A block gives the k + 1 nearest codes of each query, and the nearest of all
blocks are ranked.  The work grows with queries times blocks, as every query is held
against all rows.

Equal codes share one entry that holds their k + 1 smallest ids, as no others can be in
a result (ties go to the smaller id, a query does not find itself); so copies fill no
bucket.  Codes at the same distance go by their smallest id, so k + 1 of them suffice.

Defined results: rows without an id, or whose vector is null, of another length or
holds null, are left out; of repeated ids one row per distinct code is kept; fewer than
k others give fewer rows; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keep

BITS, SEGMENTS, K = 64, 4, 10
#: Codes of a block; queries of a block at most, and blocks of queries that make enough tasks where they are few.
CODES, ASKED, TASKS = 1 << 18, 1 << 14, 64


def sign_code(vector: Column | str, bits: int = BITS, dimensions: int = 64) -> Column:
    """Bit i: whether the i-th run of ``dimensions // bits`` values has a positive sum."""
    run = dimensions // bits
    value = lambda i: F.element_at(vector, F.lit(i + 1)).cast("double")
    total = F.lit(0).cast("long")
    for i in range(bits):
        own = value(i * run)
        for j in range(1, run):
            own = own + value(i * run + j)
        total = total.bitwiseOR(F.when(own > 0, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long"))
    return total


def coded(vectors: DataFrame, bits: int = BITS, dimensions: int = 64) -> DataFrame:
    good = F.col("vec_id").isNotNull() & (F.size("embedding") == dimensions) & ~F.exists("embedding", lambda x: x.isNull())
    return vectors.filter(good).select("vec_id", sign_code("embedding", bits, dimensions).alias("code"))


@cache
def _flips(width: int, s: int) -> np.ndarray:
    """All values of ``width`` bits with ``s`` ones."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), s)], dtype=np.int64)


class Index:
    """The codes of a block, by the value of each segment."""

    def __init__(self, codes: np.ndarray, first: np.ndarray, bits: int, segments: int):
        self.codes, self.first, self.segments, self.width = codes, first, segments, bits // segments
        self.orders, self.starts = [], []
        for i in range(segments):
            value = self._values(codes, i)
            self.orders.append(np.argsort(value, kind="stable"))
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << self.width))]))

    def _values(self, codes: np.ndarray, segment: int) -> np.ndarray:
        return (codes >> np.uint64(segment * self.width) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def nearest(self, q: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, distances) of the n nearest codes, by distance and smallest id."""
        own = [int(self._values(np.array([q]), i)[0]) for i in range(self.segments)]
        met = np.zeros(len(self.codes), dtype=bool)
        found, far = [], []
        for s in range(self.width + 1):
            flips = _flips(self.width, s) if math.comb(self.width, s) * self.segments <= len(self.codes) else None
            new = []
            for i in range(self.segments if flips is not None else 0):
                probes = own[i] ^ flips
                low, n_in = self.starts[i][probes], self.starts[i][probes + 1] - self.starts[i][probes]
                at = np.repeat(low - np.cumsum(n_in) + n_in, n_in) + np.arange(n_in.sum())
                hits = self.orders[i][at]
                hits = hits[~met[hits]]
                met[hits] = True
                new.append(hits)
            if flips is None:
                new.append(np.flatnonzero(~met))
            found.append(np.concatenate(new))
            far.append(np.bitwise_count(self.codes[found[-1]] ^ q).astype(np.int64))
            distance = np.concatenate(far)
            if flips is None or (distance < self.segments * (s + 1)).sum() >= n:
                break
        place = np.concatenate(found)
        order = np.lexsort((self.first[place], distance))[:n]
        return place[order], distance[order]


def _search(k: int, bits: int, segments: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy()
        code = group["code"].to_numpy().view(np.uint64)
        index = Index(code[~asks], group["first"].to_numpy(dtype=np.int64, na_value=0)[~asks], bits, segments)
        rows = [(q, *index.nearest(q, k + 1)) for q in (code[asks] if len(index.codes) else ())]
        n = [len(place) for _, place, _ in rows]
        own = np.repeat(np.array([q for q, _, _ in rows], dtype=np.uint64), n).view(np.int64)
        place, distance = (np.concatenate([r[i] for r in rows] or [np.zeros(0, dtype=np.int64)]) for i in (1, 2))
        return pd.DataFrame({"q": own, "code": index.codes[place].view(np.int64), "first": index.first[place], "distance": distance.astype(np.int32)})

    return run


def top_k(codes: DataFrame, queries: DataFrame, k: int = K, bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """query_id, rank, vec_id, distance.  ``codes`` and ``queries`` hold vec_id and code."""
    first = Window.partitionBy("code").orderBy("vec_id")
    entries = codes.distinct().withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    entries = keep(entries.groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "hamming-entries")
    # Equal query codes search once; each takes k + 1 so that any of them can leave itself out.
    asked = keep(queries.select("vec_id", "code").distinct(), "hamming-queries")
    open_ = keep(asked.select(F.col("code").alias("q")).distinct(), "hamming-asked")
    m, n = -(-entries.count() // CODES) or 1, open_.count()
    n = max(-(-n // ASKED), min(-(-n // 64), -(-TASKS // m))) or 1
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = open_.select(F.lit(True).alias("asks"), F.col("q").alias("code"), F.lit(None).cast("long").alias("first"), part("q", n).alias("y"), all_of(m).alias("x"))
    right = entries.select(F.lit(False).alias("asks"), "code", F.col("ids")[0].alias("first"), part("code", m).alias("x"), all_of(n).alias("y"))
    met = left.unionByName(right).groupBy("x", "y").applyInPandas(_search(k, bits, segments), "q long, code long, first long, distance int")
    best = Window.partitionBy("q").orderBy("distance", "first")
    near = met.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1).select("q", "code", "distance")
    hits = near.join(entries, "code").select("q", "distance", F.explode("ids").alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    hits = asked.select(F.col("vec_id").alias("query_id"), F.col("code").alias("q")).join(hits, "q").filter("vec_id <> query_id")
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")
