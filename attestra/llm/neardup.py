"""Near-duplicate documents: bottom-k sketches from one hash function.

A document's set holds its distinct shingles of ``words`` words (A-Z lower-cased);
one with fewer words has the whole sequence as its one shingle, one without words an
empty set, linked with nothing.  Documents with equal sets form a class at once.  The
sketch keeps the ``SKETCH`` smallest shingle hashes.

Inverted lists map runs of three consecutive retained values to the classes that have
them, while a line or passage that many documents hold rarely fills a run alone.  No
list is ever expanded into its pairs:

1. every class meets, of the classes with the smallest document id of its lists, the one
   it shares most lists with; what is confirmed forms components.  What others were
   copied from tends to have the smallest id, so that few components are left;
2. lists that still span components are compared inside tasks, by matrix products of
   their sketches, and tell which classes may link to which larger component; a list of
   more than ``LIST`` classes is dealt out as blocks against blocks;
3. such a class meets all members of that component on full sets: pair by pair where
   they are few, else block against block, again by matrix products.

A pair is first estimated from the union of its sketches, then confirmed on full sets.
What may be missed, of pairs at the threshold: those that share no list, about 5e-8 of
them (of the smallest sets, two-value runs make it certain), and those whose estimate is
too low, at most ``MISS`` by the exact binomial sum.  Nothing else is left out.

A node is one class; it is told by the number of a row, so that rows of one id with
different texts are different nodes.

Defined results: null and empty texts have no shingles and are their own component;
a component's id is its smallest doc_id, null only if none of its rows has one; rows
of an id with different texts may lie in different components; repeated rows of a
document fall into one class, and ``deduplicated`` keeps one of them; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import keep, keep_small, only, worker_cache

SKETCH, RUN = 48, 3
#: Similarity in hundredths.
PERCENT = 80
#: Chance that a pair's estimate is too low to be confirmed, though its similarity is not.
MISS = 1e-6
#: Members up to which a component is compared pair by pair; classes in a block of a larger one.
FEW, BLOCK = 8, 1000
#: Classes of a list up to which it is compared in one task; longer ones go in blocks of half as many.
LIST = 4000

#: Words whose hashes a Python worker remembers.
WORDS = 200_000

_words: dict[bytes, int] = worker_cache()
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _hash(word: bytes) -> int:
    value = _words.get(word)
    if value is None:
        if len(_words) > WORDS:
            _words.clear()
        value = _words[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return value


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted hashes of the text's distinct shingles."""
    only(_words)
    told = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and white space only
    if not told:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_hash, told), dtype=np.uint64, count=len(told))
    size = min(words, len(told))
    total = np.full(len(told) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        total = _mix(total * _U(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i])
    return np.unique(total)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """row (a number), doc_id, told (digest of the text), n_shingles, class (a digest of the set; null for the empty one), sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                s = shingles(text, words)
                own = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                rows.append((len(s), own, s[:SKETCH].tobytes()))
            out = pd.DataFrame(rows, columns=["n_shingles", "class", "sketch"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            out.insert(1, "told", batch["told"])
            out.insert(2, "row", batch["row"])
            yield out.astype({"doc_id": "Int64"})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), *_named())
    return rows.mapInPandas(run, "doc_id long, told string, row long, n_shingles long, class binary, sketch binary")


def _named() -> list:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("told"), "text"]


def _keys(s: np.ndarray, n: int) -> np.ndarray:
    """The keys of a sketch's lists: hashes of its runs."""
    keys = [np.zeros(0, dtype=np.uint64)]
    for r in (RUN,) if n > 5 else (2, RUN):
        if len(s) >= r:
            k = np.full(len(s) - r + 1, r, dtype=np.uint64)
            for i in range(r):
                k = _mix(k * _U(0x9E3779B97F4A7C15) + s[i : len(s) - r + 1 + i])
            keys.append(k)
    return np.concatenate(keys).view(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _runs(sketches: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([_keys(np.frombuffer(raw, dtype=np.uint64), n) for raw, n in zip(sketches, sizes)])


def _estimates(sketches: list[np.ndarray], sizes: np.ndarray, rows: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """How many retained values of the union of rows x all are known, up to where both sketches reach."""
    lengths = np.array([len(s) for s in sketches])
    # a set that is retained whole reaches everywhere
    top = np.array([s[-1] if len(s) < n else np.iinfo(np.uint64).max for s, n in zip(sketches, sizes)], dtype=np.uint64)
    theirs = np.array([np.searchsorted(s, top[rows], side="right") for s in sketches]).T  # values of all up to the reach of rows
    ours = np.array([np.searchsorted(sketches[r], top, side="right") for r in rows])
    first = top[rows][:, None] <= top[None, :]
    return np.where(first, lengths[rows][:, None] + theirs, lengths[None, :] + ours) - shared


@cache
def _least() -> np.ndarray:
    """Per size of a union's sample, the fewest shared values that a pair at the threshold has, but for MISS of them."""
    out, p = [], PERCENT / 100
    for n in range(2 * SKETCH + 1):
        total, k = 0.0, 0
        while k < n:
            total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            if total > MISS:
                break
            k += 1
        out.append(k)
    return np.array(out)


def _likely(shared: np.ndarray, union: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return shared >= np.where(whole, PERCENT / 100 * union - 1e-6, _least()[union.astype(np.int64)])


def _across():
    """(rep, comp): classes that their sketches let link to a class of a larger component of a list."""

    def asks(key: int, group: dict[str, np.ndarray]) -> pd.DataFrame | None:
        named, n, rep, size = group["comp"], group["n"], group["rep"], group["size"]
        if (named == named[0]).all():
            return None
        sketches = [np.frombuffer(s, dtype=np.uint64) for s in group["sketch"]]
        # in blocks x and y of a long list, only pairs of the two are compared
        x, y = (np.flatnonzero(group["side"] == k) for k in (0, 1))
        pairs = [(x, y), (y, x)] if len(y) else [(x, x)]
        # A pair is told by the first list that both are in.
        earlier = [np.unique(k[k < key]) for k in map(_keys, sketches, n)]
        out = []
        for own, other in pairs:
            theirs, before = [sketches[j] for j in other], [earlier[j] for j in other]
            for at in range(0, len(own), 1024):
                rows = own[at : at + 1024]
                shared = _shared([sketches[i] for i in rows], theirs)
                union = _estimates([sketches[i] for i in rows] + theirs, np.concatenate([n[rows], n[other]]), np.arange(len(rows)), np.pad(shared, ((0, 0), (len(rows), 0))))[:, len(rows) :]
                a, b = n[rows][:, None], n[other][None, :]
                # by the whole component's size, then its number, so that all lists agree on the direction
                more = (size[rows][:, None] < size[other][None, :]) | (size[rows][:, None] == size[other][None, :]) & (named[rows][:, None] < named[other][None, :])
                ok = more & (100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b))
                ok &= (named[rows][:, None] != named[other][None, :]) & _likely(shared, union, (a <= SKETCH) & (b <= SKETCH))
                if ok.any():
                    ok &= _shared([earlier[i] for i in rows], before) == 0
                i, j = np.nonzero(ok)
                out.append(np.unique(np.stack([rep[rows[i]], named[other[j]]]), axis=1))
        r, c = np.concatenate(out, axis=1)
        return pd.DataFrame({"rep": r, "comp": c}) if len(r) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Lists, and pairs of blocks of long ones, arrive in order, and may go on in the next batch."""
        rest: list[pd.DataFrame] = []
        for batch in _ended(batches):
            if batch is not None:
                rest.append(batch)
                last, first = batch.iloc[-1], rest[0].iloc[0]
                if all(last[c] == first[c] for c in ("key", "x", "y")):
                    continue
            if not rest:
                continue
            rows = pd.concat(rest)
            columns = {c: rows[c].to_numpy() for c in ("key", "x", "y", "side", "rep", "comp", "size", "n", "sketch")}
            keys = np.stack([columns[c] for c in ("key", "x", "y")])
            ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            stop = len(rows) if batch is None else (ends[-1] if len(ends) else 0)
            bounds = [0, *ends[ends < stop], stop]
            for s, e in zip(bounds, bounds[1:]):
                if e - s > 1 and (found := asks(int(keys[0, s]), {c: v[s:e] for c, v in columns.items()})) is not None:
                    yield found
            rest = [rows.iloc[stop:]] if stop < len(rows) else []

    return run


def _ended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


@F.pandas_udf(T.BooleanType())
def _may_link(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    out = []
    for x, y, i, j in zip(a, b, n, m):
        if 100 * min(i, j) < PERCENT * max(i, j):
            out.append(False)
            continue
        s = [np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)]
        shared = np.array([[len(s[0]), len(np.intersect1d(*s, assume_unique=True))]])
        union = _estimates(s, np.array([i, j]), np.array([0]), shared)
        out.append(bool(_likely(shared[0, 1], union[0, 1], np.array(max(i, j) <= SKETCH))))
    return pd.Series(out)


@F.pandas_udf(T.BooleanType())
def _links(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(100 * both >= PERCENT * (len(x) + len(y) - both))
    return pd.Series(out)


def _shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many values each of x has in common with each of y, some thousand values at a time."""
    flat = np.concatenate([*x, *y])
    row = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in [*x, *y]])
    _, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    twice = n[at] > 1
    values, at = np.unique(at[twice], return_inverse=True)
    row, out = row[twice], np.zeros((len(x), len(y)), dtype=np.float32)
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    for low in range(0, len(values), 4096):
        s, e = np.searchsorted(at, [low, low + 4096])
        has = np.zeros((len(x) + len(y), 4096), dtype=np.float32)
        has[row[s:e], at[s:e] - low] = 1
        out += has[: len(x)] @ has[len(x) :].T
    return out


def _block(group: pd.DataFrame) -> pd.DataFrame:
    """Exact links of the asking classes to a block of a component's members: one for each that has any."""
    asking, members = group[group["asks"]], group[~group["asks"]]
    if not len(asking) or not len(members):
        return pd.DataFrame({"a": [], "b": []}).astype("int64")
    x, y = ([np.frombuffer(s, dtype=np.uint64) for s in part["set"]] for part in (asking, members))
    n, m = np.array([len(s) for s in x])[:, None], np.array([len(s) for s in y])[None, :]
    shared = _shared(x, y)
    linked = 100 * shared >= PERCENT * (n + m - shared)
    i = np.flatnonzero(linked.any(axis=1))
    own, other = asking["rep"].to_numpy()[i], members["rep"].to_numpy()[linked[i].argmax(axis=1)]
    return pd.DataFrame({"a": np.minimum(own, other), "b": np.maximum(own, other)})


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) for the nodes of ``links`` (a, b): least labels and pointer jumping."""
    edges = keep_small(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    labels = keep_small(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "near-labels")
    while True:
        around = edges.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        nearer = labels.join(around, "node").select("node", "comp", F.least("comp", "near").alias("next"))
        jump = nearer.select(F.col("node").alias("next"), F.col("next").alias("far"))
        moved = nearer.join(jump, "next", "left").select("node", "comp", F.least("next", F.coalesce("far", "next")).alias("next"))
        moved = keep_small(moved, "near-labels")
        labels = moved.select("node", F.col("next").alias("comp"))
        if moved.filter("next <> comp").isEmpty():
            return labels


def _grouped(docs: DataFrame, words: int) -> DataFrame:
    """row, doc_id, told, n_shingles and comp (the smallest node reachable; null for empty sets), one row per document row."""
    sets = keep(_sets(docs, words), "near-sets")
    first = F.min_by(F.struct("doc_id", "told"), F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    classes = sets.filter("class IS NOT NULL").groupBy("class").agg(F.min("row").alias("rep"), first.alias("of"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = keep(classes, "near-classes")
    runs = classes.select("rep", F.coalesce("of.doc_id", F.lit(2**63 - 1)).alias("id"), F.explode(F.array_distinct(_runs("sketch", "n"))).alias("key"))
    length = Window.partitionBy("key")
    lists = runs.withColumn("length", F.count("*").over(length)).withColumn("pivot", F.min(F.struct("id", "rep")).over(length)["rep"]).filter("length > 1").drop("id")
    lists = keep(lists, "near-lists")
    # Full sets of all that is in any list, once; where rows repeat, of one of them.
    ids = lists.select("rep").distinct().join(classes.select("rep", "of"), "rep").select("rep", F.col("of.doc_id").alias("i"), F.col("of.told").alias("t"))

    @F.pandas_udf("binary")
    def whole(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, words).tobytes() for t in texts])

    mine = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("told") == F.col("t"))
    texts = docs.select(*_named()).join(ids, mine)
    again = sets.groupBy("doc_id", "told").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("doc_id").alias("i"), F.col("told").alias("t"))
    alone = texts.drop("i", "t").join(again, mine, "left_anti").select("rep", "text")
    several = texts.drop("i", "t").join(again, mine, "left_semi").groupBy("rep").agg(F.first("text").alias("text"))  # equal texts
    full = keep(alone.unionByName(several).select("rep", whole("text").alias("set")), "near-full")
    sketches = classes.select("rep", "n", "sketch")

    def confirmed(pairs: DataFrame) -> DataFrame:
        x = sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
        y = sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
        return exact(pairs.join(x, "a").join(y, "b").filter(_may_link("sa", "sb", "na", "nb")).select("a", "b"))

    def exact(likely: DataFrame) -> DataFrame:
        x, y = full.select(F.col("rep").alias("a"), F.col("set").alias("ta")), full.select(F.col("rep").alias("b"), F.col("set").alias("tb"))
        return likely.join(x, "a").join(y, "b").filter(_links("ta", "tb")).select("a", "b")

    meets = lists.filter("rep <> pivot").groupBy("rep", "pivot").agg(F.count("*").alias("n"))
    best = meets.groupBy("rep").agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("pivot"))
    links = keep(confirmed(best.select(F.col("pivot").alias("a"), F.col("rep").alias("b"))), "near-links")
    labels = components(links)
    comps = sketches.select("rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("comp", "rep").alias("comp"))
    sizes = comps.groupBy("comp").agg(F.count("*").alias("size"))
    comps = keep_small(comps.join(sizes, "comp"), "near-comps")
    named = lists.select("key", "rep", "length").join(comps, "rep")
    spans = named.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least <> most").select("key")
    apart = named.join(spans, "key", "left_semi")
    apart = apart.withColumn("parts", F.when(F.col("length") > LIST, F.ceil(F.col("length") * 2 / LIST)).otherwise(1)).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    # Block x of a list meets block y: each row goes to all pairs of blocks that its own is in.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    apart = apart.select("key", "rep", "comp", "size", "part", other)
    apart = apart.select("key", "rep", "comp", "size", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), (F.col("part") > F.col("other")).cast("int").alias("side"))
    apart = apart.join(sketches, "rep").select("key", "x", "y", "side", "rep", "comp", "size", "n", "sketch")
    asks = apart.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInPandas(_across(), "rep long, comp long").distinct()
    asks = keep_small(asks.join(comps.select("comp", "size").distinct(), "comp"), "near-asks")
    members = comps.join(asks.select("comp").distinct(), "comp", "left_semi")
    # Small components: pairs, each confirmed alone.
    few = asks.filter(F.col("size") <= FEW).select("comp", F.col("rep").alias("y")).join(members.select("comp", F.col("rep").alias("x")), "comp")
    few = exact(few.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    # Large ones: blocks of members against blocks of those that ask, on full sets.
    many = asks.filter(F.col("size") > FEW)
    shape = many.groupBy("comp").agg(F.ceil(F.max("size") / BLOCK).alias("rows"), F.ceil(F.count("*") / BLOCK).alias("columns"))
    part = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = many.select("comp", "rep").join(shape, "comp").select("comp", "rep", F.lit(True).alias("asks"), part("columns").alias("y"), all_of("rows").alias("x"))
    right = members.select("comp", "rep").join(shape, "comp").select("comp", "rep", F.lit(False).alias("asks"), part("rows").alias("x"), all_of("columns").alias("y"))
    meet = left.unionByName(right).join(full, "rep")
    more = keep(few.unionByName(meet.groupBy("comp", "x", "y").applyInPandas(_block, "a long, b long")), "near-links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    named = classes.select("class", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("class", F.coalesce("comp", "rep").alias("comp"))
    return sets.select("row", "doc_id", "told", "n_shingles", "class").join(named, "class", "left").drop("class")


def near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document row."""
    grouped = keep(_grouped(docs, words), "near-grouped")
    least = grouped.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("least"))
    out = grouped.join(least, "comp", "left")
    component = F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, words: int = 5) -> DataFrame:
    """The documents, of each component one: the one with the smallest id, of its texts and rows the first."""
    grouped = keep(_grouped(docs, words).filter("comp IS NOT NULL"), "near-grouped")
    kept = grouped.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"))
    marked = grouped.join(kept, "comp").select("doc_id", "told", (F.col("row") == F.col("first.row")).alias("stays"))
    rows = marked.groupBy("doc_id", "told").agg(F.max("stays").alias("stays"), F.count("*").alias("k"))
    rows = keep_small(rows.filter("NOT stays OR k > 1"), "near-gone")
    i, t = F.col("doc_id").alias("i"), F.col("told").alias("t")
    mine = F.col("__id").eqNullSafe(F.col("i")) & (F.col("__told") == F.col("t"))
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("doc_id").cast("long").alias("__id"), F.md5(F.coalesce("text", F.lit(""))).alias("__told"))
    single = own.join(rows.select(i, t), mine, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    twice = rows.filter("stays")
    if twice.isEmpty():
        return single
    # Rows that repeat: one of them, by a digest of the whole row, found before anything is shuffled.
    several = own.join(twice.select(i, t), mine, "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    several = several.groupBy("__id", "__told").agg(F.min_by(whole, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias("row"))
    return single.unionByName(several.select("row.*"))
