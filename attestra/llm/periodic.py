"""Periodic runs of words: maximal stretches with smallest period q and at least max(6, 4 q) words.

Seed and extend along diagonals.  Words i and i + q agree on a diagonal of a run for at
least max(5, 3 q) places, so that every run with q up to k holds a k-gram that recurs q
later, where k goes up by doubling from 5 and a scale looks at lags q in (k / 2, k].  Two
occurrences of a k-gram that are closer than k and in one run of smallest period q are
exactly q apart (else a smaller period would divide q), so that the next occurrence of each
k-gram is all that must be looked at: at most one pair a place and scale, never all pairs of
a frequent gram.  A table of how far each lag is covered skips seeds that lie in what was
extended already.  Extension compares whole stretches of a diagonal, doubling its step.

k-grams are numbered exactly, by pairs of the numbers of two k/2-grams; a scale goes on with
the places whose gram recurs, so that text without repeats ends after the first one.  A
document is one row and is worked on by itself, in time n log n.

Defined results: a null or empty text has no words, no run and two digests of nothing;
repeated rows give repeated rows; a null doc_id counts as the empty text for its hash;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, TIMES, SEED_WORDS = 6, 4, 5


def numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))


def _pairs(places: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose pair of numbers occurs at another place too, in order, and the pairs' numbers."""
    order = np.lexsort((right, left))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (left[order][1:] != left[order][:-1]) | (right[order][1:] != right[order][:-1])
    number = np.cumsum(new) - 1
    again = np.bincount(number)[number] > 1
    at = order[again]
    back = np.argsort(at, kind="stable")
    return places[at[back]], number[again][back]


def _longer(places: np.ndarray, numbers: np.ndarray, shift: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of which the first part is at a place and the second one ``shift`` later."""
    table = np.full(n, -1, dtype=np.int64)
    table[places] = numbers
    inside = places + shift < n
    places, numbers = places[inside], numbers[inside]
    second = table[places + shift]
    there = second >= 0
    return _pairs(places[there], numbers[there], second[there])


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many entries from the start agree."""
    done, step = 0, 16
    while done < len(a):
        differ = np.flatnonzero(a[done : done + step] != b[done : done + step])
        if len(differ):
            return done + int(differ[0])
        done, step = done + step, step * 2
    return len(a)


def runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the words' numbers, by start and period."""
    n, found, k = len(w), [], SEED_WORDS
    if n < LEAST:
        return found
    places, numbers = np.arange(n), w
    for _ in range(SEED_WORDS - 1):  # a gram of one more word: the gram before it, and the one a word later
        places, numbers = _longer(places, numbers, 1, n)
    low = 0
    while len(places) and TIMES * (low + 1) <= n:
        order = np.lexsort((places, numbers))
        at, number = places[order], numbers[order]
        lag = at[1:] - at[:-1]
        near = (number[1:] == number[:-1]) & (lag > low) & (lag <= k)
        seeds, lags = at[:-1][near], lag[near]
        order = np.lexsort((seeds, lags))
        seeds, lags = seeds[order], lags[order]
        i, covered, of = 0, -1, -1
        while i < len(seeds):
            s, q = int(seeds[i]), int(lags[i])
            if q != of:
                of, covered = q, -1
            if s < covered:  # skip all seeds of the lag up to there at once
                i += max(1, int(np.searchsorted(seeds[i : np.searchsorted(lags, q, "right")], covered)))
                continue
            right = s + k + _agreeing(w[s + k : n - q], w[s + k + q : n])
            left = s - _agreeing(w[:s][::-1], w[q : q + s][::-1])
            covered = right
            length = right - left + q
            if length >= max(LEAST, TIMES * q):
                found.append((left, length, q))
            i += 1
        places, numbers = _longer(places, numbers, k, n)
        low, k = k, 2 * k
    return sorted(found, key=lambda r: (r[0], r[2]))


def varied(words: list[bytes], doc_id: str) -> list[bytes]:
    """Every tenth document by its hash goes on periodically from one of its words."""
    h, n = zlib.crc32(doc_id.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * (-(-(n - a) // p)))[: n - a]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """Without what any run holds after its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(change)) if d == 0]


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length by period; then the smallest start, then period."""
    best = None
    for r in found:  # in order of start and period, so that only more is better
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def words_of(text: str | None) -> list[bytes]:
    """``bytes.split`` splits at just the six ASCII spaces."""
    return (text or "").encode("utf-8", "surrogatepass").split()


RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def find_runs(docs: DataFrame, vary: bool = False) -> DataFrame:
    """doc_id, n_runs, the strongest run, digests of all runs and of the text without their repeats; ``vary`` plants periods first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = words_of(text)
                words = varied(words, doc_id or "") if vary else words
                found = runs(numbered(words))
                best = strongest(found)
                told = "".join(f"{s},{n},{q}\n" for s, n, q in found)
                out.append((doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest()))
            frame = pd.DataFrame(out, columns=["doc_id", *[c.split()[0] for c in RESULT.split(", ")]])
            yield frame.astype({c: "Int64" for c in ("n_runs", "start", "length", "period", "exponent_milli")})

    of = docs.schema["doc_id"].dataType.simpleString()
    done = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, f"doc_id string, {RESULT}")
    return done.withColumn("doc_id", F.col("doc_id").cast(of))
