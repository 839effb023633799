"""Toxicity by non-negative positive-unlabelled learning.

Texts are told by the words and the beginnings of words (4 to 7 letters) that set confirmed
toxic documents apart from unlabelled text.  A linear classifier g is fitted to minimise

    R(g) = p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)]),    l(z) = 1 / (1 + exp(z))

over confirmed toxic documents P and unlabelled documents U, where p is the share of toxic
documents.  The second term estimates the risk on clean text without any clean example;
where a batch makes it negative, the step goes against it (Kiryo et al. 2017).  At last g is
moved to where the same risk, with sides counted instead of l, is least.  p is the
share among all labels of the rows that may be learnt; clean labels serve for nothing else.

P and U are samples of at most ``POSITIVES`` and ``UNLABELLED`` documents, by a threshold on
a seeded hash; scoring covers every whole text.

Defined results: null text is the empty text, which is scored like any other; a document
with several labels is toxic if their mean is above a half; without a toxic example every
score is 0, and 1 where all that is known is toxic; of the texts of a repeated learnt id the
smallest counts; a null doc_id counts as the empty text for its fold; repeated rows give
repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold

POSITIVES, UNLABELLED = 3000, 6000
BEGINNINGS, MARKS, SEED = (4, 5, 6, 7), 600, 17
EPOCHS, BATCH, RATE, DECAY = 60, 256, 0.02, 1e-4
THRESHOLD = 0.5
WORD = re.compile(r"[^\W\d_]+")


def tokens(word: str) -> list[int]:
    """The ids of a word and of its beginnings."""
    code = lambda s: zlib.crc32(s.encode("utf-8", "surrogatepass"))
    return [code("=" + word), *[code(word[:n]) for n in BEGINNINGS if len(word) >= n]]


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids of tokens, how often each occurs, and the number of words."""
    words = Counter(WORD.findall((text or "").lower()))
    seen: Counter = Counter()
    for w, n in words.items():
        for t in tokens(w):
            seen[t] += n
    ids, counts = np.fromiter(seen.keys(), dtype=np.uint32, count=len(seen)), np.fromiter(seen.values(), dtype=np.float32, count=len(seen))
    return ids, counts, sum(words.values())


def values(counts: np.ndarray, words: int) -> np.ndarray:
    """Two values of each token: its count and its rate, both on a logarithmic scale; the rate of a short text is held back."""
    return np.concatenate([np.log1p(counts), np.log1p(200 * counts / (words + 50.0))])


def marks(pos: list, unl: list) -> np.ndarray:
    """The ids that set the positive texts apart most, by presence (likelihood ratio) or by rate (squared z), beyond what the best of so many ids reaches by chance."""
    ids = np.unique(np.concatenate([i for i, _, _ in (*pos, *unl)] or [np.zeros(0, np.uint32)]))

    def moments(side: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        there, rate, square = (np.zeros(len(ids)) for _ in range(3))
        for i, c, n in side:
            at, r = np.searchsorted(ids, i), np.log1p(200 * c / (n + 50.0))
            there[at] += 1
            rate[at] += r
            square[at] += r * r
        return there, rate / len(side), square / len(side)

    (tp, rp, sp), (tu, ru, su) = moments(pos), moments(unl)
    n, m = len(pos), len(unl)
    pool = (tp + tu) / (n + m)
    part = lambda seen, of: np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(of, 1e-9)), 0.0)
    by_presence = 2 * (part(tp, n * pool) + part(n - tp, n * (1 - pool)) + part(tu, m * pool) + part(m - tu, m * (1 - pool))) * (tp / n > tu / m)
    by_rate = np.where((rp > ru) & (tp >= 10), (rp - ru) ** 2 / ((sp - rp**2 + 1e-3) / n + (su - ru**2 + 1e-3) / m), 0.0)
    apart = np.where(tp >= 2, np.maximum(by_presence, by_rate), 0.0)
    best = np.argsort(-apart, kind="stable")[: min(MARKS, n)]
    return np.sort(ids[best[apart[best] > 2 * np.log(len(ids) + 1)]])


def row(doc: tuple[np.ndarray, np.ndarray, int], chosen: np.ndarray) -> np.ndarray:
    ids, counts, words = doc
    own = np.zeros(len(chosen), dtype=np.float32)
    if len(chosen) and len(ids):
        at = np.searchsorted(chosen, ids).clip(max=len(chosen) - 1)
        hit = chosen[at] == ids
        own[at[hit]] = counts[hit]
    return values(own, words)


def fit_classifier(pos: np.ndarray, unl: np.ndarray, prior: float) -> dict[str, np.ndarray]:
    """Adam on the non-negative risk; the values are scaled by their deviation in the unlabelled and the positive texts."""
    rng = np.random.default_rng(SEED)
    scale = np.sqrt(0.5 * (pos.var(axis=0) + unl.var(axis=0))) + 0.05
    pos, unl = pos / scale, unl / scale
    w = np.append(np.zeros(pos.shape[1]), -1.0)
    m, q, t = np.zeros_like(w), np.zeros_like(w), 0
    pos, unl = (np.hstack([x, np.ones((len(x), 1))]) for x in (pos, unl))
    mean = np.zeros_like(w)
    steps = max(1, -(-len(unl) // BATCH))
    for epoch in range(EPOCHS):
        for own in np.array_split(rng.permutation(len(unl)), steps):
            xu, xp = unl[own], pos[rng.integers(0, len(pos), min(BATCH, 4 * len(pos)))]
            su, sp = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) for x in (xu, xp))
            gu, gp = su * (1 - su) / len(su), sp * (1 - sp) / len(sp)
            clean = su.mean() - prior * sp.mean()
            rest = xu.T @ gu - prior * (xp.T @ gp)
            grad = (-prior * (xp.T @ gp) + rest if clean >= 0 else -rest) + DECAY * np.append(w[:-1], 0.0)
            t += 1
            m, q = 0.9 * m + 0.1 * grad, 0.999 * q + 0.001 * grad**2
            w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.999**t)) + 1e-8)
            w[:-1] = np.maximum(w[:-1], 0.0)  # a mark of toxic texts never speaks for a clean one
        if epoch >= EPOCHS // 2:
            mean += w / (EPOCHS - EPOCHS // 2)
    mean[-1] -= cut(pos @ mean, unl @ mean, prior)
    return {"w": mean[:-1] / scale, "w0": mean[-1:]}


def cut(pos: np.ndarray, unl: np.ndarray, prior: float) -> float:
    """Where to cut g: the least non-negative risk that counts wrong sides, in the widest gap where several are least."""
    g = np.unique(np.concatenate([pos, unl, [0.0]]))
    middle, wide = (g[1:] + g[:-1]) / 2, np.diff(g)
    if not len(middle):
        return 0.0
    lost = np.searchsorted(np.sort(pos), middle) / len(pos)
    above = 1 - np.searchsorted(np.sort(unl), middle) / len(unl)
    risk = prior * lost + np.maximum(0, above - prior * (1 - lost))
    best = np.flatnonzero(risk <= risk.min() + 1e-12)
    return float(middle[best[np.argmax(wide[best])]])


def fit(docs: DataFrame, labels: DataFrame, learnable: Column) -> dict[str, np.ndarray]:
    """Learn ``toxic`` from the rows for which ``learnable`` holds: confirmed examples, unlabelled texts and the share of toxic ones."""
    known = labels.filter(learnable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg((F.avg("toxic") > 0.5).alias("is_toxic"))
    counts = known.agg(F.count("*").alias("n"), F.count_if("is_toxic").alias("pos")).first()
    prior = counts["pos"] / counts["n"] if counts["n"] else 0.0
    none = {"marks": np.zeros(0, np.uint32), "w": np.zeros(0), "w0": np.array([np.log(prior / (1 - prior)) if 0 < prior < 1 else (30.0 if prior else -30.0)])}
    if not 0 < prior < 1:
        return none
    some = docs.filter(learnable & F.col("doc_id").isNotNull()).select("doc_id")
    total = some.count()
    place = F.xxhash64("doc_id", F.lit(SEED))

    def sample(rows: DataFrame, most: int, of: int, kind: int) -> DataFrame:
        few = rows.filter(F.pmod(place, F.lit(1 << 30)) < 2.0 * most / max(1, of) * (1 << 30)).select("doc_id").distinct()
        return few.orderBy(place, "doc_id").limit(most).withColumn("side", F.lit(kind))

    chosen = sample(known.filter("is_toxic"), POSITIVES, counts["pos"], 1).union(sample(some, UNLABELLED, total, 0))
    # at most POSITIVES + UNLABELLED ids are broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "side").agg(F.min("text").alias("text"))

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [counted(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "side": batch["side"], "ids": [i.tobytes() for i, _, _ in rows], "counts": [c.tobytes() for _, c, _ in rows], "words": [n for _, _, n in rows]})

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["side", "doc_id"])
        read = [(s, (np.frombuffer(i, np.uint32), np.frombuffer(c, np.float32), n)) for s, i, c, n in zip(group["side"], group["ids"], group["counts"], group["words"])]
        pos, unl = [d for s, d in read if s == 1], [d for s, d in read if s == 0]
        if not pos or not unl:
            return pd.DataFrame({"name": [], "value": []})
        own = marks(pos, unl)
        model = fit_classifier(np.stack([row(d, own) for d in pos]).astype(np.float64), np.stack([row(d, own) for d in unl]).astype(np.float64), prior)
        return pd.DataFrame({"name": ["marks", "w", "w0"], "value": [own.tobytes(), model["w"].tobytes(), model["w0"].tobytes()]})

    prepared = texts.mapInPandas(prepare, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, side int, ids binary, counts binary, words long")
    found = {r["name"]: r["value"] for r in prepared.withColumn("all", F.lit("")).groupBy("all").applyInPandas(train, "name string, value binary").collect()}  # one model
    return {k: np.frombuffer(v, np.uint32 if k == "marks" else np.float64) for k, v in found.items()} or none


def margin(text: str | None, model: dict[str, np.ndarray], places: dict[int, int], known: dict[str, tuple[int, ...]]) -> float:
    """g of one text; ``known`` keeps the marks of words of this model."""
    words = Counter(WORD.findall((text or "").lower()))
    own = np.zeros(len(model["marks"]), dtype=np.float32)
    if len(known) > 500_000:
        known.clear()
    for w, n in words.items():
        at = known.get(w)
        if at is None:
            at = known[w] = tuple(places[t] for t in tokens(w) if t in places)
        for i in at:
            own[i] += n
    return float(values(own, sum(words.values())) @ model["w"] + model["w0"][0]) if len(own) else float(model["w0"][0])


def scorer(docs: DataFrame, model: dict[str, np.ndarray]):
    """A column function of the text: the score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, places = shared.value, {int(t): i for i, t in enumerate(shared.value["marks"])}
        known: dict[str, tuple[int, ...]] = {}
        for texts in batches:
            g = np.fromiter((margin(t, own, places, known) for t in texts), dtype=float, count=len(texts))
            yield pd.Series(1 / (1 + np.exp(-np.clip(g, -30, 30))))

    return run


def held_out(doc_id: str = "doc_id") -> Column:
    return fold(doc_id, 5) == 0


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    run = scorer(docs, fit(docs, labels, ~held_out()))
    scored = docs.select("doc_id", held_out().alias("held_out"), run("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
