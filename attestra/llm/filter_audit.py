"""How filters interact: what each removes, in every order, with exact duplicates told by a counting-Bloom prepass.

Filters of a text (null: empty; words: ``WORD``), as the bits of a mask:

    A  fewer than 200 words                  B  100 * distinct words < 50 * words
    C  100 * capitals A-Z > 3 * characters   D  holds one of # $ % & * |
    E  identical to the text of a smaller doc_id

One pass over the texts gives masks of A to D and a hash; the rows without texts are kept.

E: every partition counts its hashes in a counting Bloom filter whose cells lie in blocks
(``CELLS`` cells, ``PROBES`` of them for a hash, all in one block) and writes the blocks that
it touched, sparsely: a cell once if it was hit once, twice if more often.  The blocks are
merged by key, and a merged block holds one bit a cell: hit at least twice.  A text with a
cell that is not is unique for certain.  Only the others - repeats, and about 3 % of the
unique ones by chance - are shuffled with their full texts, for the exact smallest id of each
text.  The filter has about ``CELLS / PER_BLOCK`` cells a row, so its blocks are as many as
the rows ask for; they are broadcast up to ``BROADCAST`` bytes, which is known beforehand, and
joined by block beyond that.

Flags and labels join by doc_id, and rows are counted by part, mask and label: at most 32
masks for each part and label.  Everything reported is a sum over masks, so that the 120
orders need no further pass.

Defined results: a null doc_id is smaller than none and larger than none, so such rows
neither fail E nor make others fail it; equal texts of the same doc_id do not fail each
other; a null lang is the part "", like the empty one; of several labels of a document
any 1 counts; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 3
CELLS, PER_BLOCK, PROBES, SEED = 1 << 16, 8192, 3, 23
BROADCAST = 64 << 20
_CAPITALS, _SYMBOLS = bytes(range(65, 91)), re.compile(rb"[#$%&*|]")


def mask_of(text: str | None) -> int:
    """Bits of A to D.  ``bytes.split`` splits at just the six ASCII spaces of ``WORD``."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
        | (100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > MAX_CAPITALS * len(text)) << 2
        | (_SYMBOLS.search(raw) is not None) << 3
    )


def _hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def flagged(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (A to D), hash of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "part": b["part"], "mask": [mask_of(t) for t in b["text"]], "hash": b["hash"]})

    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text", _hash().alias("hash"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    if id_type != "string":
        rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))  # a null among numbers would become a float in pandas
    done = rows.mapInPandas(run, "doc_id string, part string, mask int, hash long")
    return done.withColumn("doc_id", F.col("doc_id").cast(id_type))


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("hash", F.lit(SEED)), F.lit(blocks)).alias("block")


def _cells(hashes: np.ndarray) -> np.ndarray:
    """The cells of each hash within its block; ``_hit_twice`` reads the same ones."""
    return np.stack([(hashes.view(np.uint64) >> np.uint64(16 * i)) & np.uint64(CELLS - 1) for i in range(PROBES)], axis=1).astype(np.uint16)


def _hit_twice(probe: int) -> Column:
    """Whether the merged block says that this probe's cell was hit at least twice."""
    cell = F.shiftright("hash", 16 * probe).bitwiseAND(F.lit(CELLS - 1)).cast("int")
    return F.bit_get(F.get("twice", F.shiftright(cell, 6)), cell.bitwiseAND(F.lit(63))) == 1


def sketches(rows: DataFrame, blocks: int) -> DataFrame:
    """block, cells: what each partition hit, as sorted 16-bit cells, those hit more often twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            block, cells = b["block"].to_numpy(), _cells(b["hash"].to_numpy(dtype=np.int64))
            order = np.argsort(block, kind="stable")
            block, cells = block[order], cells[order]
            starts = np.flatnonzero(np.diff(block, prepend=-1))
            for at, end in zip(starts, [*starts[1:], len(block)]):
                key = int(block[at])
                own[key] = _capped(np.concatenate([own[key], cells[at:end].ravel()]) if key in own else cells[at:end].ravel())
        keys = sorted(own)
        for at in range(0, len(keys), 1024):
            yield pd.DataFrame({"block": keys[at : at + 1024], "cells": [own[k].tobytes() for k in keys[at : at + 1024]]})

    return rows.select(_block(blocks), "hash").mapInPandas(run, "block long, cells binary")


def _capped(cells: np.ndarray) -> np.ndarray:
    """Sorted cells, none more than twice."""
    cells = np.sort(cells)
    more = np.zeros(len(cells), dtype=bool)
    more[2:] = cells[2:] == cells[:-2]
    return cells[~more]


def merged(parts: DataFrame) -> DataFrame:
    """block, twice: the cells that all partitions together hit at least twice, 64 a number."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(CELLS, dtype=np.int64)
        for cells in group["cells"]:
            counts += np.bincount(np.frombuffer(cells, dtype=np.uint16), minlength=CELLS)
        twice = np.packbits(counts >= 2, bitorder="little").view(np.int64)
        return pd.DataFrame({"block": group["block"].iloc[:1].to_numpy(), "twice": [twice]})

    return parts.groupBy("block").applyInPandas(run, "block long, twice array<long>")


def _fits(blocks: int, broadcast: int) -> bool:
    return blocks * (CELLS // 8 + 64) <= broadcast


def told(rows: DataFrame, sketch: DataFrame, blocks: int, broadcast: int = BROADCAST) -> DataFrame:
    """``rows`` (with hash) and whether the merged sketch lets each be a repeat: possible."""
    # the size of a sketch follows from its number of blocks
    side = F.broadcast(sketch) if _fits(blocks, broadcast) else sketch.hint("merge")
    hit = _hit_twice(0)
    for probe in range(1, PROBES):
        hit = hit & _hit_twice(probe)
    joined = rows.select("*", _block(blocks)).join(side, "block")
    return joined.withColumn("possible", hit).drop("block", "twice")


def with_duplicates(docs: DataFrame, rows: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """``rows`` (what ``flagged`` gave, kept) with bit E in their masks."""
    blocks = max(1, -(-rows.count() // PER_BLOCK))
    sketch = keep(merged(sketches(rows, blocks)), "audit-sketch")
    rows = told(rows, sketch, blocks, broadcast)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter("doc_id IS NOT NULL").withColumn("hash", _hash())
    if _fits(blocks, broadcast):
        texts = told(texts, sketch, blocks, broadcast).filter("possible")
    else:  # hashes alone meet the sketch; only the texts of possible repeats follow
        texts = texts.join(rows.filter("possible").select("doc_id", "hash").distinct(), ["doc_id", "hash"], "left_semi")
    firsts = texts.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", _hash().alias("hash"), F.lit(True).alias("first"))
    # the smallest id of a text is one row in firsts, so that large groups of copies do not meet again
    rows = rows.join(firsts, ["doc_id", "hash"], "left")
    late = F.col("possible") & F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.select("doc_id", "part", F.col("mask").bitwiseOR(F.when(late, 16).otherwise(0)).alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters that they fail."""
    rows = with_duplicates(docs, keep(flagged(docs), "audit-flags"), broadcast)
    one = lambda c: F.max((F.col(c) == 1).cast("int"))
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    rows = rows.join(known, "doc_id", "left")
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """part, filter_order, step and the counts of that step, for all orders of the filters."""
    counts = mask_counts(docs, labels, broadcast).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    orders = F.array(*[F.lit("".join(o)) for o in itertools.permutations(FILTERS)])
    steps = F.array(*[F.lit(i) for i in range(1, len(FILTERS) + 1)])
    rows = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(steps))
    def bits(letters: Column) -> Column:
        return functools.reduce(Column.bitwiseOR, [F.when(letters.contains(f), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)])

    rows = rows.withColumn("own", bits(F.substr("filter_order", F.col("step"), F.lit(1)))).withColumn("before", bits(F.substr("filter_order", F.lit(1), F.col("step") - 1)))

    def total(value: str | None, test) -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda acc, m: acc + F.when(test(m["mask"]), m[value or "n"]).otherwise(F.lit(0)))

    own, before = F.col("own"), F.col("before")
    fails = lambda m: m.bitwiseAND(own) != 0
    reached = lambda m: m.bitwiseAND(before) == 0
    removed = lambda m: fails(m) & reached(m)
    # of the orders, a filter is the first among the k that a document fails in one of k
    share = F.aggregate("masks", F.lit(0).cast("long"), lambda acc, m: acc + F.when(fails(m["mask"]), m["n"] * F.floor(F.lit(math.factorial(len(FILTERS))) / F.bit_count(m["mask"]))).otherwise(F.lit(0)))
    return rows.select(
        "part", "filter_order", "step", total("n", lambda m: reached(m) & ~fails(m)).alias("kept"), total("n", removed).alias("removed"), total("n", lambda m: fails(m) & ~reached(m)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"), total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), share.alias("shapley"))
