"""Mixing sources to target weights.

Each source gets a number of words to give.  Its documents, in a seeded random
order, form blocks; a source gives all its blocks a whole number of times and
then a prefix of the order once more, to within half a document of its target.
The block quotas of all sources are dealt to the output shards by a
multivariate-hypergeometric splitting tree: a node holds the quotas of a range
of shards, draws what its left half gets, and leaves the rest to its right half.
Every shard walks from the root to its own leaf, with one seed per node, so the
tree needs no driver and reruns agree.  A shard then owns disjoint ranges of
each source's permuted draws, and shuffles its documents locally.

Texts are read twice, once for their sizes and once to be dealt, and shuffled once, to
their shards.  All planning is done on a kept table of sizes and on the table of blocks
(about the square root of the rows), which is broadcast only up to ``BROADCAST`` rows.
Sources meet in one task and their quotas go to every shard: a mix of up to some tens
of thousands of sources.  More than that, as web hosts, are to be grouped first.

Defined results: null text has size 0 and is dealt like any other document; null
source is a source of its own, after all others; a null id has its place by its text;
repeated rows are dealt row by row, but the last, partial pass takes rows of one id
together or not at all; an empty table gives an empty mix; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, keep, keep_small

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix-1"
#: Words that one output shard should hold.
SHARD_WORDS = 4_000_000
#: Rows of the table of blocks up to which it is broadcast.
BROADCAST = 400_000


def place(seed: str = SEED) -> Column:
    """A document's place in the seeded order: a digest of its id, or of its text where it has none."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.md5(F.coalesce("text", F.lit("")))))
    return F.md5(F.concat(F.lit(f"{seed}:"), own))


def word_sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size in words (null text: 0) and the document's place."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), place(seed).alias("place"))


def _block(bits: int) -> Column:
    return F.shiftright(F.conv(F.substring("place", 1, 8), 16, 10).cast("long"), 32 - bits)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size, target: shares of the total by weight, none above ``max_repeat`` times its size.

    Resharing what lies above a cap by weight ends at min(cap, level * weight)
    for one level, so the caps are taken in order of cap / weight.  There is
    one row per source, the only rows that meet in one task.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    caps = per.withColumn("weight", weight).withColumn("cap", F.lit(max_repeat) * F.col("source_size"))
    total = F.sum("source_size").over(Window.partitionBy())
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    since = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(since)
    ranked = caps.withColumn("total", total).withColumn("level", level)
    # The first source, in this order, whose cap is not reached sets the level for all after it.
    free = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))
    first = F.first(free, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("free", first).select(
        "source",
        "source_size",
        F.coalesce(F.col("free") * F.col("weight"), F.col("cap").cast("double")).alias("target"),
    )


def _split(node: str, quotas: np.ndarray, left: int) -> np.ndarray:
    """The left half's share of ``quotas`` when ``left`` blocks are drawn without replacement."""
    seed = int.from_bytes(hashlib.blake2b(node.encode(), digest_size=8).digest(), "big")
    rng = np.random.Generator(np.random.PCG64(seed))
    out, rest, need = np.zeros_like(quotas), int(quotas.sum()), int(left)
    for i, q in enumerate(quotas):
        q, rest = int(q), rest - int(q)
        # numpy's sampler takes populations below 1e9, far above the blocks of any mix
        out[i] = rng.hypergeometric(q, rest, need) if need and q and rest else min(q, need)
        need -= int(out[i])
    return out


def shard_ranges(shard: int, shards: int, quotas: np.ndarray, seed: str = SEED) -> tuple[np.ndarray, np.ndarray]:
    """For each source, the half-open range of its draws that ``shard`` owns."""
    at, counts, lo, hi = np.zeros_like(quotas), quotas.copy(), 0, shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        total = int(counts.sum())
        left = _split(f"{seed}:{lo}:{hi}", counts, total * (mid - lo) // (hi - lo))
        if shard < mid:
            counts, hi = left, mid
        else:
            at, counts, lo = at + left, counts - left, mid
    return at, at + counts


def _deal(quotas: DataFrame, shards: int, seed: str) -> DataFrame:
    """source, draw, shard: which shard owns each draw of each source.

    The quotas are one row per source of the mix; every shard needs them all.
    """
    rows = sorted(quotas.select("source", "quota").collect(), key=lambda r: (r.source is None, r.source or ""))
    names, counts = [r.source for r in rows], np.array([r.quota for r in rows], dtype=np.int64)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"] if names else ():
                start, end = shard_ranges(int(shard), shards, counts, seed)
                yield pd.DataFrame({"source": names, "shard": int(shard), "start": start, "end": end})

    spark = quotas.sparkSession
    ranges = spark.range(shards, numPartitions=min(shards, 64)).mapInPandas(walk, "source string, shard long, start long, end long")
    draws = F.explode(F.sequence("start", F.col("end") - 1)).alias("draw")
    return ranges.filter("end > start").select("source", "shard", draws)


def _plan(sizes: DataFrame, weights: Sequence[int], max_repeat: int, seed: str, shard_words: int) -> tuple[DataFrame, int]:
    """What each block gives, and the bits of a place that tell its block.

    source, block, source_size, target, passes, extra (it is in the last, partial pass),
    cutoff (of its documents those up to this place; null: all) and homes, one (copy,
    shard) for each time the block is drawn.
    """
    # Blocks per source and documents per block both grow with the square root of the rows.
    bits = min(24, math.ceil(math.log2(max(sizes.count(), 1)) / 2) + 1)
    sizes = sizes.withColumn("block", _block(bits))
    per_block = keep_small(sizes.groupBy("source", "block").agg(F.sum("size").alias("words")), "mix-blocks")
    targets = source_targets(per_block.select("source", F.col("words").alias("size")), weights, max_repeat)
    in_order = Window.partitionBy("source").orderBy("block")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    blocks = (
        per_block.alias("b")
        .join(targets.alias("t"), F.col("t.source").eqNullSafe(F.col("b.source")))
        .select("b.*", "source_size", "target")
        .withColumn("passes", passes)
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
        .withColumn("rank", (F.row_number().over(in_order) - 1).cast("long"))
        .withColumn("before", F.sum("words").over(so_far) - F.col("words"))
        .withColumn("n_blocks", F.count("*").over(Window.partitionBy("source")))
        .withColumn("extra", F.col("before") < F.col("rest"))
        .withColumn("ends", F.col("extra") & (F.col("before") + F.col("words") > F.col("rest")))
    )
    blocks = keep_small(blocks, "mix-quotas")
    # Only the block in which the prefix ends, one for each source, needs the order of its documents.
    ending = blocks.filter("ends").select(F.col("source").alias("s"), F.col("block").alias("b"), "before", "rest")
    of_end = sizes.join(F.broadcast(ending), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    groups = of_end.groupBy("s", "b", "before", "rest", "place").agg(F.sum("size").alias("words"))
    within = Window.partitionBy("s", "b").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("words").over(within) - F.col("words") / 2
    cutoffs = groups.withColumn("middle", middle).groupBy("s", "b").agg(F.max(F.when(F.col("middle") <= F.col("rest"), F.col("place"))).alias("cutoff"))
    quota = F.max("passes") * F.max("n_blocks") + F.sum(F.col("extra").cast("long"))
    quotas = blocks.groupBy("source").agg(quota.alias("quota"))
    words = blocks.groupBy("source").agg(F.max("target").alias("t")).agg(F.sum("t")).first()[0] or 0
    dealt = _deal(quotas.filter("quota > 0"), max(1, math.ceil(words / shard_words)), seed)
    # A source's draws: each whole pass over its blocks in order, then the prefix once more.
    copies = F.filter(F.sequence(F.lit(0), F.col("passes")), lambda c: (c < F.col("passes")) | F.col("extra"))
    drawn = blocks.select("source", "block", "rank", "n_blocks", F.explode(copies).alias("copy"))
    drawn = drawn.withColumn("draw", F.col("copy") * F.col("n_blocks") + F.col("rank"))
    homes = (
        drawn.alias("c")
        .join(dealt.alias("d"), F.col("c.source").eqNullSafe(F.col("d.source")) & (F.col("c.draw") == F.col("d.draw")))
        .groupBy("c.source", "c.block")
        .agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("homes"))
    )
    same = F.col("b.source").eqNullSafe(F.col("h.source")) & (F.col("b.block") == F.col("h.block"))
    where = blocks.alias("b").join(homes.alias("h"), same, "left")
    where = where.join(cutoffs.select("s", F.col("b").alias("end"), "cutoff"), F.col("b.source").eqNullSafe(F.col("s")) & (F.col("b.block") == F.col("end")), "left")
    cutoff = F.when(F.col("ends"), F.coalesce("cutoff", F.lit("")))
    where = where.select("b.source", "b.block", "source_size", "target", "passes", "extra", cutoff.alias("cutoff"), F.coalesce("h.homes", F.array()).alias("homes"))
    return keep_small(where, "mix-plan"), bits


def _dealt(rows: DataFrame, plan: DataFrame, bits: int) -> DataFrame:
    """``rows`` (with source and place) with the source_size, target and homes of each."""
    known = plan.select(F.struct(*plan.columns).alias("b"))
    known = F.broadcast(known) if plan.count() <= BROADCAST else known
    met = rows.join(known, rows["source"].eqNullSafe(F.col("b.source")) & (_block(bits) == F.col("b.block")))
    more = F.col("b.extra") & (F.col("b.cutoff").isNull() | (F.col("place") <= F.col("b.cutoff")))
    taken = F.filter("b.homes", lambda h: (h["copy"] < F.col("b.passes")) | more)
    return met.select(*[rows[c] for c in rows.columns], F.col("b.source_size").alias("source_size"), F.col("b.target").alias("target"), taken.alias("homes"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mix's plan: one row per document row.

    doc_id, source, size, source_size, target (its source's), homes: one (copy, shard)
    for each time the mix takes the document.
    """
    sizes = keep(word_sizes(docs, seed), "mix-sizes")
    return _dealt(sizes, *_plan(sizes, weights, max_repeat, seed, shard_words)).drop("place")


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents as the mix takes them: each shard together, in its own random order."""
    sizes = keep(word_sizes(docs, seed), "mix-sizes")
    plan, bits = _plan(sizes, weights, max_repeat, seed, shard_words)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", place(seed).alias("place"))
    drawn = _dealt(rows, plan, bits).select("row", "place", F.explode("homes").alias("home"))
    toss = F.md5(F.concat_ws(":", F.lit(seed), "home.shard", "home.copy", "place"))
    drawn = drawn.select("row", F.col("home.shard").alias("shard"), toss.alias("toss"))
    return drawn.repartition("shard").sortWithinPartitions("shard", "toss", F.xxhash64("row")).select("row.*")
