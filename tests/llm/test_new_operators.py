"""Toxicity on held-out texts; the filter audit and periodic runs against brute force; odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestra.llm import filter_audit, periodic, toxicity
from tests.llm.test_operators import DOCS, ODD, SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(*r, "clash", "clash") for r in ODD], DOCS)
    return real.withColumn("size", F.lit("clash")).withColumn("block", F.lit("clash")).unionByName(odd).cache()


# --- toxicity ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def planted(spark):
    """1200 invented texts, a tenth of them with insults of which no text holds all; a half of the labels is known."""
    rng = random.Random(5)
    syllables = ["ra", "ti", "on", "bel", "du", "men", "so", "ki", "ver", "al", "nu", "po"]
    insults = ["zottel", "knirps", "lumpig", "trottel", "garstig"]
    rows, known = [], []
    for i in range(1200):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.choice([15, 60, 300]))]
        toxic = i % 10 == 3
        for _ in range(rng.randint(3, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        rows.append((i, " ".join(words), toxic))
        if i % 2 or not i % 3:
            known.append((i, int(toxic)))
    return rows, spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").cache(), spark.createDataFrame(known, "doc_id long, toxic int").cache()


def test_toxicity_on_held_out_texts(planted):
    rows, docs, labels = planted
    got = {r.doc_id: r for r in toxicity.rate(docs, labels).collect()}
    assert len(got) == len(rows)
    held = [(got[i], toxic) for i, _, toxic in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in held) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert sum(r.predicted for r, toxic in held if toxic) >= 0.9 * sum(t for _, t in held)
    assert sum(r.predicted for r, toxic in held if not toxic) <= 0.02 * len(held)


def test_toxicity_learns_nothing_from_clean_or_held_out_labels(spark, planted):
    """Clean labels count for the share only; labels of the held-out fold, even wrong ones, change nothing."""
    _, docs, labels = planted
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    clean = labels.filter("toxic = 0 AND NOT crc32(cast(doc_id AS string)) % 5 = 0")
    moved = labels.filter("toxic = 1").unionByName(clean.withColumn("doc_id", F.col("doc_id") + 1_000_000).filter("crc32(cast(doc_id AS string)) % 5 <> 0"))
    other = toxicity.fit(docs, moved, ~toxicity.held_out())
    assert (model["marks"] == other["marks"]).all()
    wrong = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs.repartition(5), wrong, ~toxicity.held_out())
    assert all((model[k] == again[k]).all() for k in model)


def test_non_negative_risk():
    """On overlapping samples, where the plain unbiased risk turns negative, the classifier's risk on clean text stays sane."""
    rng = np.random.default_rng(1)
    pos, clean = rng.normal(2, 1, (60, 3)), rng.normal(-2, 1, (540, 3))
    unl = np.vstack([rng.normal(2, 1, (60, 3)), clean])
    model = toxicity.fit_classifier(pos, unl, 0.1)
    g = lambda x: x @ model["w"] + model["w0"][0]
    assert (g(pos) > 0).mean() > 0.9 and (g(clean) > 0).mean() < 0.03


def test_toxicity_of_odd_rows(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.rate(docs, labels)
    assert got.count() == docs.count()
    scores = {r.doc_id: r.score for r in got.collect()}
    assert scores[900001] == scores[900002] and all(s is not None for s in scores.values())
    assert toxicity.rate(docs.limit(0), labels).count() == 0
    assert {r.score < 1e-6 for r in toxicity.rate(docs, labels.limit(0)).collect()} == {True}
    assert {r.predicted for r in toxicity.rate(docs, labels.withColumn("toxic", F.lit(1))).collect()} == {1}
    text = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert toxicity.rate(text, labels.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))).count() == docs.count()


# --- filter audit ----------------------------------------------------------------------


def fails(rows):
    least = {}
    for r in rows:
        if r.doc_id is not None:
            least[r.text or ""] = min(least.get(r.text or "", r.doc_id), r.doc_id)
    out = []
    for r in rows:
        t = r.text or ""
        words = WORD.findall(t)
        out.append({
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": r.doc_id is not None and least[t] < r.doc_id})
    return out


@pytest.mark.parametrize("broadcast", [filter_audit.BROADCAST, 0])
def test_audit(spark, docs, broadcast):
    copies = docs.filter("doc_id % 7 = 0").withColumn("doc_id", F.col("doc_id") + 5000)
    all_docs = docs.unionByName(copies).unionByName(copies.filter("doc_id % 2 = 0")).unionByName(docs.filter("doc_id IS NULL"))
    labels = spark.read.parquet(f"{SF}/labels.parquet").unionByName(spark.createDataFrame([(1, 1, 1), (None, 1, 1), (900004, None, 1)], "doc_id long, quality int, toxic int"))
    rows, known = all_docs.collect(), {}
    for r in labels.collect():
        good, toxic = known.get(r.doc_id, (0, 0))
        known[r.doc_id] = (max(good, int(r.quality == 1)), max(toxic, int(r.toxic == 1)))
    known.pop(None)
    told = [(r.lang or "", f, *known.get(r.doc_id, (0, 0))) for r, f in zip(rows, fails(rows))]
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(all_docs, labels, broadcast).collect()}
    parts = {t[0] for t in told}
    assert len(got) == len(parts) * 600
    removed_by = {}
    for part, order in itertools.product(parts, map("".join, itertools.permutations("ABCDE"))):
        left = [t for t in told if t[0] == part]
        everyone = left
        for step, f in enumerate(order, 1):
            own = [t for t in left if t[1][f]]
            left = [t for t in left if not t[1][f]]
            r = got[(part, order, step)]
            assert (r.kept, r.removed, r.redundant) == (len(left), len(own), sum(t[1][f] for t in everyone) - len(own))
            assert r.unique_fails == sum(t[1][f] and sum(t[1].values()) == 1 for t in everyone)
            assert (r.good_lost, r.toxic_lost) == (sum(t[2] for t in own), sum(t[3] for t in own))
            removed_by[part, f] = removed_by.get((part, f), 0) + len(own)
    assert all(r.shapley == removed_by[part, order[step - 1]] for (part, order, step), r in got.items())
    assert filter_audit.audit(all_docs.limit(0), labels).count() == 0


def test_prepass_clears_only_unique_texts(spark):
    """Small blocks, so that many cells collide: every repeat stays possible, most unique texts are cleared."""
    rows = spark.range(40000).select(F.xxhash64(F.when(F.col("id") % 10 == 0, F.col("id") % 1000).otherwise(F.col("id")).cast("string")).alias("hash")).repartition(7)
    blocks = -(-rows.count() // filter_audit.PER_BLOCK)
    sketch = filter_audit.merged(filter_audit.sketches(rows, blocks))
    assert sketch.count() == blocks
    got = filter_audit.told(rows, sketch, blocks).join(rows.groupBy("hash").count(), "hash")
    told = {(r.possible, r.repeats): r.n for r in got.groupBy("possible", (F.col("count") > 1).alias("repeats")).agg(F.count("*").alias("n")).collect()}
    assert (False, True) not in told and told[(False, False)] > 0.9 * (told[(False, False)] + told.get((True, False), 0))


def test_audit_of_text_ids(spark):
    docs = spark.createDataFrame([("b", "x", "en"), ("a", "x", "en"), ("c", "y", None)], "doc_id string, text string, lang string")
    labels = spark.createDataFrame([("b", 1, 0)], "doc_id string, quality int, toxic int")
    got = {r.part: r for r in filter_audit.audit(docs, labels).filter("filter_order = 'EABCD' AND step = 1").collect()}
    assert (got["en"].removed, got["en"].good_lost, got[""].removed) == (1, 1, 0)


# --- periodic runs ----------------------------------------------------------------------


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        j = 0
        while j < n - q:
            s = j
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - s + q
            if j > s and length >= max(6, 4 * q) and not any(all(w[s + x] == w[s + x + p] for x in range(length - p)) for p in range(1, q)):
                out.append((s, length, q))
            j = max(j, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 7)), max_size=8))
def test_runs(parts):
    w = [x for part, times in parts for x in part * times]
    assert periodic.runs(np.array(w, dtype=np.int64)) == brute_runs(w)


def test_runs_of_words_that_nest():
    """A run of runs, Fibonacci words and one long run."""
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    for w in (([1] * 6 + [2]) * 5, b[:600], list(range(50)) * 4, list(range(50)) * 4 + [7], [3] * 400, ([0, 1] * 5 + [2]) * 6 + [0, 1] * 9):
        assert periodic.runs(np.array(w, dtype=np.int64)) == brute_runs(w)


def expected(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    found = brute_runs([ids[w] for w in words])
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else None
    return (
        len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


def test_find_runs(docs):
    short = docs.filter("length(text) < 4000 OR text IS NULL")
    got = periodic.find_runs(short, vary=True).collect()
    assert len(got) == short.count()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((r.doc_id, *expected(r.doc_id, r.text))) for r in short.collect())
    assert periodic.find_runs(docs.limit(0)).count() == 0
    long = periodic.find_runs(docs.filter("doc_id = 900005")).first()
    assert (long.n_runs, long.start, long.length, long.period, long.exponent_milli) == (1, 0, 30000, 1, 30000000)
