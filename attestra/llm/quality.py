"""Quality classifier: a factorisation machine over hashed words and structure.

Features of a text: its words, lower case, hashed to ``BUCKETS``, with log counts and
unit length; statistics of its structure (lengths, repeated lines and words, shares
of kinds of characters); its recorded length in characters.  The score is

    s = w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]

which weighs every pair of features by the product of their factors and takes time
linear in the features.  It is fitted by Adam on the logistic loss, on at most
``SAMPLE`` labelled documents, the first by a seeded hash, of which a threshold by the
number of labels leaves about twice as many before they are ranked; scoring covers all.

Defined results: null text is the empty text, which is scored like any other; of
several labels of a document the rounded mean counts; where nothing is labelled, or
only one class, every score is the share of label 1 (0.5 where none is known); of the
texts of a repeated labelled id the smallest is learnt; a negative length counts as 0; a
null doc_id counts as the empty text for its fold; repeated rows give repeated rows; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, only, worker_cache

BUCKETS, RANK, SAMPLE = 1024, 8, 6000
EPOCHS, BATCH, RATE, DECAY, SEED = 30, 256, 0.02, 1e-4, 11
THRESHOLD = 0.3

#: Words whose buckets a Python worker remembers.
WORDS = 200_000

_bucket: dict[str, int] = worker_cache()


def _capitals(text: str) -> int:
    """How many characters change in lower case."""
    low = text.lower()
    if len(low) != len(text):
        return sum(map(str.isupper, text))
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in (text, low))
    return int(np.count_nonzero(a != b))


def structure(text: str, n_chars: float | None, words: Counter) -> list[float]:
    n, total = max(len(text), 1), sum(words.values())
    lines = text.split("\n")
    upper = _capitals(text)
    letters = total and sum(len(w) * k for w, k in words.items())
    symbols = [sum(text.count(c) for c in group) / n for group in ("|", "#$%&*", "!?", ".,;:", "0123456789", "<>{}[]()/\\=+_@~^")]
    top = max(words.values(), default=0) / max(total, 1)
    return [
        np.log1p(len(text)) / 10, np.log1p(total) / 10, np.log1p(max(n_chars or 0, 0)) / 10,
        letters / max(total, 1) / 10, len(words) / max(total, 1), top, upper / n,
        len(set(lines)) / len(lines), np.log1p(len(lines)) / 10, min(1.0, max(map(len, lines)) / n),
        *[min(1.0, 5 * s) for s in symbols], float(not text),
    ]


WIDTH = BUCKETS + len(structure("", 0, Counter()))


def features(text: str | None, n_chars: float | None) -> np.ndarray:
    only(_bucket)
    text = text or ""
    words = Counter(text.lower().split())
    if len(_bucket) > WORDS:
        _bucket.clear()
    x = np.zeros(WIDTH, dtype=np.float32)
    at = np.fromiter((_bucket[w] if w in _bucket else _bucket.setdefault(w, zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS) for w in words), dtype=np.int64, count=len(words))
    x[:BUCKETS] = np.log1p(np.bincount(at, weights=np.fromiter(words.values(), dtype=float, count=len(words)), minlength=BUCKETS)) if words else 0
    x[:BUCKETS] /= max(np.linalg.norm(x[:BUCKETS]), 1e-12)
    x[BUCKETS:] = structure(text, None if n_chars is None or n_chars != n_chars else n_chars, words)
    return x


def score(x: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """The sum-of-squares identity: linear in the features, not in their pairs."""
    x = (x - model["mean"]) / model["scale"]
    s = x @ model["v"]
    return model["w0"] + x @ model["w"] + 0.5 * (s**2 - x**2 @ model["v"] ** 2).sum(axis=1)


def fit_machine(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    mean, scale = np.zeros(WIDTH, dtype=np.float32), np.ones(WIDTH, dtype=np.float32)
    mean[BUCKETS:], scale[BUCKETS:] = x[:, BUCKETS:].mean(axis=0), x[:, BUCKETS:].std(axis=0) + 1e-3
    z = ((x - mean) / scale).clip(-6, 6).astype(np.float32)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    p = {"w0": np.array([np.log(share / (1 - share))], dtype=np.float32), "w": np.zeros(WIDTH, dtype=np.float32), "v": rng.normal(0, 0.02, (WIDTH, RANK)).astype(np.float32)}
    m, q = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    t = 0
    for _ in range(EPOCHS if 0 < y.mean() < 1 else 0):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            own = order[at : at + BATCH]
            b, t = z[own], t + 1
            s, b2 = b @ p["v"], b**2
            out = p["w0"] + b @ p["w"] + 0.5 * (s**2 - b2 @ p["v"] ** 2).sum(axis=1)
            g = ((1 / (1 + np.exp(-out.clip(-30, 30))) - y[own]) / len(own)).astype(np.float32)
            grad = {"w0": g.sum(keepdims=True), "w": b.T @ g + DECAY * p["w"], "v": b.T @ (g[:, None] * s) - (b2.T @ g)[:, None] * p["v"] + DECAY * p["v"]}
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                q[k] = 0.999 * q[k] + 0.001 * grad[k] ** 2
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(q[k] / (1 - 0.999**t)) + 1e-8)
    return p | {"mean": mean, "scale": scale}


def fit(docs: DataFrame, labels: DataFrame, learnable: Column) -> dict[str, np.ndarray]:
    """Learn ``quality`` from labelled rows of ``docs`` for which ``learnable`` holds."""
    known = labels.filter(learnable & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("label"))
    share = 2.0 * SAMPLE / max(1, known.agg(F.approx_count_distinct("doc_id")).first()[0])
    place = F.xxhash64("doc_id", F.lit(SEED))
    chosen = known.filter(F.pmod(place, F.lit(1 << 30)) < share * (1 << 30)).orderBy(place, "doc_id").limit(SAMPLE)
    texts = docs.select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars")).join(F.broadcast(chosen), "doc_id")  # at most SAMPLE ids
    texts = texts.groupBy("doc_id", "label").agg(F.min(F.struct("text", "n_chars")).alias("t")).select("doc_id", "label", "t.*")  # rows that repeat, before they are shuffled

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [features(t, n).tobytes() for t, n in zip(batch["text"], batch["n_chars"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "x": rows})

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        model = fit_machine(np.stack([np.frombuffer(x, dtype=np.float32) for x in group["x"]]), group["label"].to_numpy(dtype=np.float32))
        return pd.DataFrame({"name": list(model), "value": [a.astype(np.float32).tobytes() for a in model.values()]})

    prepared = texts.mapInPandas(prepare, "doc_id long, label int, x binary")
    found = prepared.withColumn("all", F.lit("")).groupBy("all").applyInPandas(train, "name string, value binary").collect()  # one model
    if not found:
        return {"w0": np.zeros(1), "w": np.zeros(WIDTH), "v": np.zeros((WIDTH, RANK)), "mean": np.zeros(WIDTH), "scale": np.ones(WIDTH)}
    model = {r["name"]: np.frombuffer(r["value"], dtype=np.float32) for r in found}
    return model | {"v": model["v"].reshape(WIDTH, RANK)}


def scorer(docs: DataFrame, model: dict[str, np.ndarray]):
    """A column function of (text, n_chars): the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series, n_chars: pd.Series) -> pd.Series:
        out = np.zeros(len(texts))
        texts, n = texts.tolist(), n_chars.tolist()
        for at in range(0, len(texts), 512):
            x = np.stack([features(t, c) for t, c in zip(texts[at : at + 512], n[at : at + 512])])
            x[:, BUCKETS:] = np.clip(x[:, BUCKETS:], shared.value["mean"][BUCKETS:] - 6 * shared.value["scale"][BUCKETS:], shared.value["mean"][BUCKETS:] + 6 * shared.value["scale"][BUCKETS:])
            out[at : at + 512] = 1 / (1 + np.exp(-np.clip(score(x, shared.value), -30, 30)))
        return pd.Series(out)

    return run


def held_out(doc_id: str = "doc_id") -> Column:
    return fold(doc_id, 5) == 0


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    run = scorer(docs, fit(docs, labels, ~held_out()))
    scored = docs.select("doc_id", held_out().alias("held_out"), run("text", F.col("n_chars").cast("double")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected."""
    run = scorer(docs, fit(docs, labels, ~held_out()))
    return docs.filter(run("text", F.col("n_chars").cast("double")) >= THRESHOLD)
