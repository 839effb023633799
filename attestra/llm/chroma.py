"""Media columns: chroma fingerprints of recordings, and their alignment.

A recording is raw 8-bit mono sound.  Frames of its spectrum are folded into twelve
pitch classes; over this image, by its integral image, sixteen filters compare the sums
of rectangles, and their values in two bits each make one packed integer a frame.
Alignment takes landmarks, the frames whose hash is the least of their neighbourhood.
Their density follows the recording's length, down to every frame, and they are nested:
the sparser landmarks of a longer recording are among the denser ones that the same
frames give in a shorter one.  A landmark's key is its frame and the next one; single
frames are keys only of recordings of under ``SHORT`` frames, for those that have no
next one.  Equal keys of two recordings vote for an offset; every offset
voted for is tested by the share of bits that differ over the whole overlap, which
counts from ``LEAST`` frames on, or the whole of a shorter recording.  A sound that is
shorter than the filters forms a class with its equals.

Recordings with equal fingerprints form a class that is searched once, and copies are not
multiplied.  The smallest class with a key is its pivot, and all that share keys with one
pivot are its star.  Two classes that share a key meet in a star, where their frames,
which lie there once, are compared within a task, block against block in a large star; a
pair is told by the smallest pivot of its common keys only.  So what is shuffled grows
with the landmarks, not with the pairs of a group.  ``linked`` gives one row for each
recording with the number of its links; ``pairs`` all pairs of classes, and ``align``
those of recordings.

Defined results: null and empty sound aligns with nothing; short sound (less than one
fingerprint) has no frames and aligns with its equals only, with no votes; a null id is
left out; repeated rows of an id count as one where their sound is the same; a recording
has no link with itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import keep

RATE, FRAME, HOP, PITCHES = 8000, 256, 64, 12
FILTERS, LONGEST = 16, 16
#: Frames on each side within which a landmark has the least hash, at most; and landmarks that a recording is to have.
AROUND, LANDMARKS = 3, 36
#: Frames from a key's first frame to its second; number of frames below which single ones are keys too.
AHEAD, SHORT = 1, 24
#: Frames of the least overlap; share of bits that may differ in it.
LEAST, ERROR = 15, 0.2
#: Classes of a star that meet in one task, on each side.
BLOCK = 256


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames x pitch classes; every frame has unit length, or is silent."""
    n = max(0, (len(samples) - FRAME) // HOP + 1)
    if not n:
        return np.zeros((0, PITCHES))
    frames, window = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP], np.hanning(FRAME)
    out = np.empty((n, PITCHES))
    frequency = np.fft.rfftfreq(FRAME, 1 / RATE)
    used = np.flatnonzero((frequency >= 100) & (frequency <= 3520))
    pitch = np.round(12 * np.log2(frequency[used] / 440)).astype(int) % PITCHES
    fold = (pitch[:, None] == np.arange(PITCHES)).astype(float)
    for at in range(0, n, 4096):
        out[at : at + 4096] = (np.abs(np.fft.rfft(frames[at : at + 4096] * window)[:, used]) ** 2) @ fold
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """One packed integer for each frame with LONGEST frames ahead of it."""
    image = chroma(samples)
    n = len(image) - LONGEST + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    total = np.zeros((len(image) + 1, PITCHES + 1))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return total[t + t1, p1] - total[t + t0, p1] - total[t + t1, p0] + total[t + t0, p0]

    out = np.zeros(n, dtype=np.uint32)
    for i in range(FILTERS):
        wide, p0 = 4 + i * 5 % 13, i * 5 % 8
        high = 2 + i * 7 % (PITCHES - p0 - 1)
        t1, p1, th, ph = wide, p0 + high, wide // 2, p0 + high // 2
        if i % 4 == 0:  # earlier against later
            a, b = area(0, th, p0, p1), area(th, t1, p0, p1)
        elif i % 4 == 1:  # lower against higher
            a, b = area(0, t1, p0, ph), area(0, t1, ph, p1)
        elif i % 4 == 2:  # one diagonal against the other
            a, b = area(0, th, p0, ph) + area(th, t1, ph, p1), area(th, t1, p0, ph) + area(0, th, ph, p1)
        else:  # the middle against both sides
            third = wide // 3
            a, b = area(third, 2 * third, p0, p1), (area(0, third, p0, p1) + area(2 * third, t1, p0, p1)) / 2
        value = np.log1p(a) - np.log1p(b)
        level = (value > -0.1).astype(np.uint32) + (value > 0) + (value > 0.1)
        out = out << np.uint32(2) | (level ^ (level >> 1)).astype(np.uint32)  # neighbouring levels differ in one bit
    return out


def around(frames: int) -> int:
    """Frames on each side of a landmark in a recording of so many."""
    return min(AROUND, max(0, (frames // LANDMARKS - 1) // 2))


def landmarks(prints: np.ndarray) -> np.ndarray:
    """Places whose hash is the least within ``around`` places, the first of equals."""
    if not len(prints):
        return np.zeros(0, dtype=np.int64)
    h = prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    side = around(len(prints))
    padded = np.pad(h, side, constant_values=np.iinfo(np.uint64).max)
    least = np.lib.stride_tricks.sliding_window_view(padded, 2 * side + 1)
    return np.flatnonzero(least.argmin(axis=1) == side)


def prints(recordings: DataFrame, is_query: Column) -> DataFrame:
    """rec_id, asks, class (digest of the fingerprint, or of a sound too short for one), frames (packed integers)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [fingerprint(np.frombuffer(s, dtype=np.uint8).astype(float) - 128) for s in batch["sound"]]
            told = [hashlib.blake2b(f.tobytes() or bytes(s), digest_size=16, person=b"frames" if len(f) else b"sound").digest() for f, s in zip(found, batch["sound"])]
            yield pd.DataFrame({"rec_id": batch["rec_id"], "asks": batch["asks"], "class": told, "frames": [f.tobytes() for f in found]})

    known = recordings.filter(F.col("rec_id").isNotNull() & (F.length("sound") > 0))
    return known.select("rec_id", F.coalesce(is_query, F.lit(False)).alias("asks"), "sound").mapInPandas(run, "rec_id long, asks boolean, class binary, frames binary")


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) of the landmarks: the frame with the one ahead, and in short recordings the frame alone."""
    at = landmarks(prints)
    both = at[at + AHEAD < len(prints)]
    first = prints.astype(np.uint64)
    pair = first[both] << np.uint64(32) | first[both + AHEAD]
    own = at if len(prints) < SHORT else at[:0]
    mixed = [(k ^ (k >> np.uint64(31)) ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) for k, salt in ((pair, 0), (first[own], 0xD1B54A32D192ED03))]
    lowest = [(k << np.uint64(1) | np.uint64(single)).view(np.int64) for k, single in zip(mixed, (0, 1))]  # an odd key is a single frame's
    return np.concatenate(lowest), np.concatenate([both, own])


@F.pandas_udf(T.ArrayType(T.LongType()))
def _keys(frames: pd.Series) -> pd.Series:
    return pd.Series([np.unique(keys(np.frombuffer(raw, dtype=np.uint32))[0]) for raw in frames])


def confirmed(x: np.ndarray, y: np.ndarray, offsets: np.ndarray, votes: np.ndarray) -> list[dict]:
    """Of the offsets voted for, those with a long enough overlap and few enough differing bits."""
    found = []
    for k, v in zip(offsets.tolist(), votes.tolist()):
        start, stop = max(0, -k), min(len(x), len(y) - k)
        if stop - start < min(LEAST, len(x), len(y)):
            continue
        error = float(np.bitwise_count(x[start:stop] ^ y[start + k : stop + k]).sum()) / (32 * (stop - start))
        if error <= ERROR:
            found.append({"bit_error": error, "votes": v, "offset": k})
    return found


PAIRS = "q long, node long, offsets array<struct<bit_error:double,votes:long,offset:long>>"
LINKS = "node long, links long, bit_error double, less long, far long, offset long, q long"


def _star(counted: bool):
    """The aligned pairs of a block of a star: each, or their number and the best of each class."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        pivot = group["pivot"].iloc[0]
        asking, members = group[group["side"]], group[~group["side"]]
        frames = [np.frombuffer(f, dtype=np.uint32) for f in members["frames"]]
        told = [keys(f) for f in frames]
        key, at = np.concatenate([k for k, _ in told] or [np.zeros(0, np.int64)]), np.concatenate([p for _, p in told] or [np.zeros(0, np.int64)])
        own = np.repeat(np.arange(len(frames)), [len(k) for k, _ in told])
        order = np.argsort(key, kind="stable")
        key, at, own = key[order], at[order], own[order]
        lengths, nodes = np.array([len(f) for f in frames]), members["node"].to_numpy()
        rows, best = [], {}
        for q, raw, shared, pivots, n in zip(asking["node"].tolist(), asking["frames"], asking["keys"], asking["pivots"], asking["recordings"].tolist()):
            x = np.frombuffer(raw, dtype=np.uint32)
            k, place = keys(x)
            known = np.searchsorted(shared, k).clip(0, len(shared) - 1)
            listed = shared[known] == k
            k, place, of = k[listed], place[listed], pivots[known[listed]]
            low, high = np.searchsorted(key, k, "left"), np.searchsorted(key, k, "right")
            hits = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]) if len(k) else low, high - low) + np.arange((high - low).sum())
            mine = np.repeat(np.arange(len(k)), high - low)
            other = own[hits]
            ok = (nodes[other] != q) & ((k[mine] & 1 == 0) | (np.minimum(lengths[other], len(x)) <= AHEAD))
            hits, mine, other = hits[ok], mine[ok], other[ok]
            least = np.full(len(frames), np.iinfo(np.int64).max)
            np.minimum.at(least, other, of[mine])
            ok = least[other] == pivot
            offset = at[hits[ok]] - place[mine[ok]]
            codes, votes = np.unique(other[ok] << 32 | offset + (1 << 31), return_counts=True)
            whose = codes >> 32
            ends = np.flatnonzero(np.diff(whose, append=-1)) + 1
            for s, e in zip([0, *ends[:-1]], ends):
                j = int(whose[s])
                found = confirmed(x, frames[j], (codes[s:e] & 0xFFFFFFFF) - (1 << 31), votes[s:e])
                if found and counted:
                    top = min((f["bit_error"], -f["votes"], abs(f["offset"]), f["offset"], q) for f in found)
                    links, before = best.get(j, (0, top))
                    best[j] = (links + n, min(before, top))
                elif found:
                    rows.append((q, int(nodes[j]), found))
        if counted:
            rows = [(int(nodes[j]), links, *top) for j, (links, top) in best.items()]
            return pd.DataFrame(rows, columns=["node", "links", "bit_error", "less", "far", "offset", "q"])
        return pd.DataFrame(rows, columns=["q", "node", "offsets"])

    return run


def classed(recordings: DataFrame, is_query: Column) -> DataFrame:
    """The prints of ``prints``, once."""
    return keep(prints(recordings, is_query), "chroma-prints")


def members(own: DataFrame) -> DataFrame:
    """rec_id, class, asks: who is in which class."""
    return own.groupBy("rec_id", "class").agg(F.max("asks").alias("asks"))


def _classes(own: DataFrame) -> DataFrame:
    """node (a number), class, frames, recordings and askers (how many), n (frames)."""
    counts = members(own).groupBy("class").agg(F.count("*").alias("recordings"), F.sum(F.col("asks").cast("long")).alias("askers"))
    frames = own.groupBy("class").agg(F.first("frames").alias("frames"))  # equal in a class
    n = (F.length("frames") / 4).cast("long").alias("n")
    return keep(frames.join(counts, "class").select(F.monotonically_increasing_id().alias("node"), "class", "frames", "recordings", "askers", n), "chroma-classes")


def _stars(classes: DataFrame, counted: bool) -> DataFrame:
    marks = classes.select("node", (F.col("askers") > 0).alias("asks"), (F.col("n") <= AHEAD).alias("tiny"), F.explode(_keys("frames")).alias("key"))
    of = marks.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("several"), F.max("asks").alias("asked"), F.max("tiny").alias("tiny"))
    of = of.filter("several > 1 AND asked AND (key & 1 = 0 OR tiny)").select("key", "pivot")
    per = marks.select("node", "key").join(of, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("key", "pivot"))).alias("told"))
    per = keep(per, "chroma-keys")
    star = per.join(classes.select("node", "askers"), "node").select("node", "askers", F.explode(F.array_distinct(F.transform("told", lambda t: t["pivot"]))).alias("pivot"))
    star = keep(star, "chroma-stars")
    blocks = lambda n: F.ceil(n / BLOCK)
    shape = star.groupBy("pivot").agg(blocks(F.count("*")).alias("rows"), blocks(F.sum((F.col("askers") > 0).cast("long"))).alias("columns")).filter("columns > 0")
    placed = star.join(shape, "pivot")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = placed.filter("askers > 0").select("pivot", "node", F.lit(True).alias("side"), part("columns").alias("y"), all_of("rows").alias("x"))
    right = placed.select("pivot", "node", F.lit(False).alias("side"), part("rows").alias("x"), all_of("columns").alias("y"))
    told = per.select("node", F.transform("told", lambda t: t["key"]).alias("keys"), F.transform("told", lambda t: t["pivot"]).alias("pivots"))
    what = classes.select("node", "frames", F.col("askers").alias("recordings")).join(told, "node")
    return left.unionByName(right).join(what, "node").groupBy("pivot", "x", "y").applyInPandas(_star(counted), LINKS if counted else PAIRS)


def pairs(own: DataFrame) -> DataFrame:
    """query_class, class, offset (frames), votes, bit_error, offsets: every class with a query against every class that aligns.

    ``offsets`` holds all confirmed offsets, the first three columns the one of the least
    error.  A class of several recordings aligns with itself.
    """
    classes = _classes(own)
    names = classes.select("node", "class")
    found = _stars(classes, False).join(names, "node").drop("node").join(names.select(F.col("node").alias("q"), F.col("class").alias("query_class")), "q").drop("q")
    self_ = F.array(F.struct(F.lit(0.0).alias("bit_error"), F.col("n").alias("votes"), F.lit(0).cast("long").alias("offset")))
    same = classes.filter("askers > 0 AND recordings > 1").select(F.col("class").alias("query_class"), "class", self_.alias("offsets"))
    best = F.array_min(F.transform("offsets", lambda o: F.struct(o["bit_error"].alias("bit_error"), (-o["votes"]).alias("less"), F.abs(o["offset"]).alias("far"), o["offset"].alias("offset"))))
    rows = found.unionByName(same).withColumn("best", best)
    return rows.select("query_class", "class", "best.offset", (-F.col("best.less")).alias("votes"), "best.bit_error", F.array_sort("offsets").alias("offsets"))


def align(recordings: DataFrame, is_query: Column) -> DataFrame:
    """query_id, rank, rec_id, offset (frames), votes, bit_error: all aligned other recordings of each query, the best first."""
    own = classed(recordings, is_query)
    who = members(own)
    asked = who.filter("asks").select(F.col("class").alias("query_class"), F.col("rec_id").alias("query_id"))
    hits = asked.join(pairs(own), "query_class").join(who.select("class", "rec_id"), "class").filter("rec_id <> query_id")
    rank = Window.partitionBy("query_id").orderBy("bit_error", F.desc("votes"), "rec_id")
    return hits.withColumn("rank", F.row_number().over(rank)).select("query_id", "rank", "rec_id", "offset", "votes", "bit_error")


def aligned(recordings: DataFrame, is_query: Column) -> DataFrame:
    """All of ``members`` (rec_id, class, asks) and all of ``pairs`` (query_class, class, ...) in one table; what a row lacks is null."""
    own = classed(recordings, is_query)
    return members(own).unionByName(pairs(own), allowMissingColumns=True)


def linked(recordings: DataFrame, is_query: Column) -> DataFrame:
    """rec_id, class, links, query_class, offset, votes, bit_error: one row for each recording and class of its sound.

    ``links`` counts the other recordings that ask and align with it; the rest tells the
    class of a best one, how far it lies and how well it fits (the own class where another
    recording in it asks; null where nothing aligns).
    """
    own = classed(recordings, is_query)
    classes = _classes(own)
    top = F.min(F.struct("bit_error", "less", "far", "offset", "q"))
    found = _stars(classes, True).groupBy("node").agg(F.sum("links").alias("links"), top.alias("best"))
    found = found.join(classes.select(F.col("node").alias("best_q"), F.col("class").alias("query_class")), F.col("best.q") == F.col("best_q"))
    told = classes.select("node", "class", "askers", "n").join(found.select("node", "links", "best", "query_class"), "node", "left")
    out = members(own).join(told, "class")
    inside = F.col("askers") - F.col("asks").cast("long")
    pick = lambda mine, other: F.when(inside > 0, mine).otherwise(other)
    return out.select(
        "rec_id", "class", (F.coalesce("links", F.lit(0)) + inside).alias("links"), pick(F.col("class"), F.col("query_class")).alias("query_class"),
        pick(F.lit(0).cast("long"), F.col("best.offset")).alias("offset"), pick(F.col("n"), -F.col("best.less")).alias("votes"), pick(F.lit(0.0), F.col("best.bit_error")).alias("bit_error"),
    )
