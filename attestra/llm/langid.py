"""Language identification by the nearest of several centroids per language.

A text becomes the counts of its letter n-grams (one to three characters, lower
case, a run of anything but letters taken as one space), hashed to ``DIMENSIONS`` buckets,
with square-root term weights, inverse document frequencies and unit length.
Document frequencies count all documents one may learn from.  Centroids are fitted
on at most ``PER_LANGUAGE`` different documents of each language, the first by a seeded
hash: spherical k-means within the language.  A threshold on the hash, by the language's
number of documents, leaves about twice as many before they are ranked.  The prediction is the language of the
centroid with the highest cosine; a text that is farther from it than nearly all of
that language's own learnt documents is marked as rejected.

A letter is a character of a Unicode category L.

Defined results: a null text, or one without letters, is ``und`` with score 0; where
nothing can be learnt every text is ``und``; null lang is not learnt from; a null
doc_id counts as the empty text for its fold; repeated rows give repeated rows and are
learnt from once (but counted by row in the frequencies); a text with several languages
is learnt under each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fold, keep

DIMENSIONS = 4096
PER_LANGUAGE = 400
CENTROIDS = 3
STEPS = 12
#: Languages up to which their sizes are broadcast; texts are not shuffled by language.
LANGUAGES = 100_000
#: Share of a language's learnt documents that may lie beyond its rejection distance.
BEYOND = 0.005
PLAIN = re.compile("[A-Za-z]")
UNDETERMINED = "und"

_letters: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0][codes]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def has_letter(text: str) -> bool:
    return PLAIN.search(text) is not None or bool(_is_letter(_codes(text)).any())


def counts(text: str) -> np.ndarray:
    """Hashed counts of the text's n-grams."""
    c = _codes(text.lower())
    c = np.where(_is_letter(c), c, 32).astype(np.uint32)
    c = c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))[: len(c)]]
    shift, h = np.uint32(32 - (DIMENSIONS.bit_length() - 1)), np.zeros(len(c), dtype=np.uint32)
    total = np.zeros(DIMENSIONS)
    for n in range(min(3, len(c))):
        h = (h[: len(c) - n] + c[n:]) * np.uint32(0x9E3779B1)
        total += np.bincount(h >> shift, minlength=DIMENSIONS)
        h ^= h >> np.uint32(15)
    return total


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    x = np.stack([np.sqrt(counts(t)) for t in texts]) * idf
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each bucket occurs: one vector a task, then their sums."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                seen += counts(text) > 0
                n += 1
        yield pd.DataFrame({"bucket": np.arange(-1, DIMENSIONS), "n": np.concatenate([[n], seen])})

    per = docs.select("text").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMENSIONS + 1)
    for r in per:  # DIMENSIONS + 1 rows
        out[r["bucket"] + 1] = r["n"]
    return out[1:], int(out[0])


def centroids(x: np.ndarray, k: int = CENTROIDS, steps: int = STEPS) -> np.ndarray:
    """Spherical k-means; the first centres are spread out, each farthest from those before."""
    centres = [x.sum(axis=0)]
    centres[0] = centres[0] / max(np.linalg.norm(centres[0]), 1e-12)
    while len(centres) < min(k, len(x)):
        centres.append(x[(x @ np.stack(centres).T).max(axis=1).argmin()])
    c = np.stack(centres)
    for _ in range(steps):
        nearest = (x @ c.T).argmax(axis=1)
        for i in range(len(c)):
            if (nearest == i).any():
                mean = x[nearest == i].sum(axis=0)
                c[i] = mean / max(np.linalg.norm(mean), 1e-12)
    return c


class Model:
    def __init__(self, idf: np.ndarray, langs: list[str], centres: np.ndarray, floors: np.ndarray):
        self.idf, self.langs, self.centres, self.floors = idf, langs, centres, floors

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        cosine = vectors(texts, self.idf) @ self.centres.T
        best = cosine.argmax(axis=1)
        score = cosine[np.arange(len(texts)), best].clip(0, 1)
        return [self.langs[i] for i in best], score.astype(float), score < self.floors[best]


def fit(docs: DataFrame, learnable: Column) -> Model | None:
    """Learn from the rows of ``docs`` for which ``learnable`` holds."""
    known = docs.filter(learnable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    seen, n = _frequencies(known)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + seen)) + 1e-3
    told = known.select("lang", "text", F.xxhash64("doc_id", "text", F.lit(7)).alias("h"))
    sizes = told.groupBy("lang").agg((F.lit(2.0 * PER_LANGUAGE) / F.approx_count_distinct("h")).alias("share"))
    sizes = keep(sizes, "lang-sizes")
    few = told.join(F.broadcast(sizes) if sizes.count() <= LANGUAGES else sizes, "lang").filter(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    few = few.groupBy("lang", "h").agg(F.min("text").alias("text"))  # equal rows, before they are shuffled
    order = Window.partitionBy("lang").orderBy("h")
    sample = few.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= PER_LANGUAGE)

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        x = vectors(group.sort_values("h")["text"].tolist(), idf)
        c = centroids(x)
        floor = float(np.quantile((x @ c.T).max(axis=1), BEYOND))
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centre": list(c.astype(np.float64)), "floor": floor})

    rows = sample.groupBy("lang").applyInPandas(cluster, "lang string, centre array<double>, floor double").collect()
    rows.sort(key=lambda r: (r["lang"], list(r["centre"])))  # CENTROIDS rows for each language
    return Model(idf, [r["lang"] for r in rows], np.array([r["centre"] for r in rows], dtype=np.float32), np.array([r["floor"] for r in rows]))


def identify(docs: DataFrame, model: Model | None, *also: str) -> DataFrame:
    """doc_id, the columns ``also``, lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        out = pd.DataFrame({"lang_pred": UNDETERMINED, "score": 0.0, "rejected": True}, index=texts.index)
        told = [i for i, t in texts.items() if t is not None and has_letter(t)] if m else []
        for at in range(0, len(told), 512):
            own = told[at : at + 512]
            langs, score, far = m.predict([texts[i] for i in own])
            out.loc[own, "lang_pred"], out.loc[own, "score"], out.loc[own, "rejected"] = langs, score, far
        return out

    return docs.select("doc_id", *also, predict("text").alias("p")).select("doc_id", *also, "p.*")


def held_out(doc_id: str = "doc_id") -> Column:
    return fold(doc_id, 4) == 2
