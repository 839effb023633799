"""Renames: claims that hit nothing, against facts with the same parameter names.

A claim takes the most similar free fact (ratio of the normalised names at least 0.7,
the earliest among equals), else the only free fact, if the raw names' ratio is at least
0.35.  A fact is free until a claim before this one has taken its name or hit it
exactly.  Claims therefore go in order, but only within a group of parameter sets that
share fact names; groups are independent.

Similar pairs come from an equi-join: a ratio of 0.7 needs common characters, so two
names must share one of their first characters, the rarest in these names first, and no
pair is lost.  The ordered step then sees similar pairs, and of a set's other facts only
the two that stay free for the longest: while there are two, none is the only one left,
and when one is left it is among them.  (Facts whose name other sets have too all go
there.)  Claims without a similar fact, in a set of which two facts stay free for good,
cannot be settled and do not go there, so that large sets - that of no parameters above
all - bring few rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import py_round
from ..functions.similarity import name_ratio, normalize_name, ratio
from ..functions.tables import keep

SIMILAR, RENAMED = 0.7, 0.35
#: Characters that are ranked by how often names have them; rarer ones all come first.
RANKED = 2000


def _rarest_first(names: DataFrame) -> str:
    """The characters of ``x``, the rarest first; one row for each of them reaches the driver, at most RANKED."""
    counts = names.select(F.explode(F.split("x", "")).alias("c")).filter("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
    return "".join(r.c for r in reversed(counts.orderBy(F.desc("n"), "c").limit(RANKED).collect()))


def _tokens(name: Column, order: str) -> Column:
    """The first characters of a name in this order, each with its count so far, as many as the filter needs."""
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    marked = F.transform(chars, lambda c, i: F.struct(
        F.instr(F.lit(order), c).alias("common"), c.alias("char"), F.size(F.filter(F.slice(chars, 1, i + 1), lambda d: d == c)).alias("nth")
    ))
    keep = F.size(chars) - F.ceil(F.lit(SIMILAR / 2 * (1 + SIMILAR / (2 - SIMILAR)) - 1e-9) * F.size(chars)) + 1
    return F.transform(F.slice(F.array_sort(marked), 1, F.greatest(keep.cast("int"), F.lit(1))), lambda t: F.concat(t["char"], t["nth"]))


def _counted(name: Column) -> Column:
    """All characters of a name, each with its count so far."""
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, 1, i + 1), lambda d: d == c)).cast("string")))


def _shape(name: Column) -> Column:
    """The characters of a name in order, digits all as one: names of one shape have as many characters in common with a name, or fewer, as their shape has."""
    return F.array_join(F.array_sort(F.split(F.translate(name, "123456789", "000000000"), "")), "")


def _near_in_length(x: str, y: str) -> Column:
    return F.least(F.length(x), F.length(y)) * (2 - SIMILAR) >= F.greatest(F.length(x), F.length(y)) * SIMILAR - 1e-9


def similar_shapes(facts: DataFrame, claims: DataFrame) -> DataFrame:
    """key, fact_shape, claim_shape: shapes (key, shape) of the facts and claims of a key whose names can be similar.

    A ratio is at most twice the common characters over both lengths, and names have no more
    of them in common than their shapes.  Where names differ by numbers alone, shapes are few.
    """
    f, c = keep(facts.select("key", F.col("shape").alias("x")).distinct(), "rename-shapes"), keep(claims.select("key", F.col("shape").alias("y")).distinct(), "rename-shapes")
    order = _rarest_first(f.select("x").union(c.select("y")))
    pairs = f.withColumn("t", F.explode(_tokens(F.col("x"), order))).join(c.withColumn("t", F.explode(_tokens(F.col("y"), order))), ["key", "t"]).filter(_near_in_length("x", "y"))
    pairs = pairs.select("key", F.col("x").alias("fact_shape"), F.col("y").alias("claim_shape")).distinct()
    common = F.size(F.array_intersect(_counted(F.col("fact_shape")), _counted(F.col("claim_shape"))))
    return pairs.filter(2 * common >= SIMILAR * (F.length("fact_shape") + F.length("claim_shape")) - 1e-9)


def similar_pairs(facts: DataFrame, claims: DataFrame) -> DataFrame:
    """claim_seq, fact_seq, ratio of all pairs with equal keys and a ratio of at least 0.7."""
    f = facts.join(claims.select("key").distinct(), "key", "left_semi").select("key", F.col("fact.seq").alias("fact_seq"), normalize_name("fact.name").alias("x"))
    c = claims.select("key", F.col("claim.seq").alias("claim_seq"), normalize_name("claim.name").alias("y"))
    f, c = keep(f.withColumn("shape", _shape(F.col("x"))), "rename-facts"), keep(c.withColumn("shape", _shape(F.col("y"))), "rename-claims")
    shapes = keep(similar_shapes(f, c), "rename-shapes")
    # only names of shapes that can be similar meet; each pair of shapes is a group of its own
    f = f.join(shapes.withColumnRenamed("fact_shape", "shape"), ["key", "shape"]).withColumnRenamed("shape", "fact_shape")
    c = c.withColumnRenamed("shape", "claim_shape").join(shapes.select("key", "claim_shape").distinct(), ["key", "claim_shape"], "left_semi")
    f = keep(f, "rename-facts")
    order = _rarest_first(f.select("x").union(c.select("y")))
    f, c = f.withColumn("t", F.explode(_tokens(F.col("x"), order))), c.withColumn("t", F.explode(_tokens(F.col("y"), order)))
    pairs = f.join(c, ["key", "claim_shape", "t"]).filter(_near_in_length("x", "y"))
    pairs = pairs.select("claim_seq", "fact_seq", "x", "y").distinct()
    return pairs.withColumn("ratio", name_ratio("x", "y")).filter(F.col("ratio") >= SIMILAR).select("claim_seq", "fact_seq", "ratio")


def spread_names(facts: DataFrame) -> DataFrame:
    """name: the names that facts of several parameter sets have."""
    return facts.groupBy(F.col("fact.name").alias("name")).agg((F.min("key") < F.max("key")).alias("spread")).filter("spread").select("name")


def groups(facts: DataFrame) -> DataFrame:
    """key, grp: parameter sets that share fact names, by least labels; most sets are alone."""
    pairs = facts.select("key", F.col("fact.name").alias("name"))
    links = pairs.join(spread_names(facts), "name", "left_semi").distinct()
    labels = pairs.select("key", F.col("key").alias("grp")).distinct()
    if links.isEmpty():
        return labels
    while True:
        near = links.join(labels, "key").groupBy("name").agg(F.min("grp").alias("low"))
        down = links.join(near, "name").groupBy("key").agg(F.min("low").alias("low"))
        step = labels.join(down, "key", "left").select("key", "grp", F.least("grp", F.coalesce("low", "grp")).alias("next"))
        step = keep(step, "rename-groups")
        labels = step.select("key", F.col("next").alias("grp"))
        if step.filter("next <> grp").isEmpty():
            return labels


def renames(facts: DataFrame, claims: DataFrame, first: DataFrame) -> DataFrame:
    """claim_seq, fact, how (fuzzy or renamed), ratio."""
    claims = keep(claims, "rename-asks")
    if claims.isEmpty():
        return facts.sparkSession.createDataFrame([], PICKED).join(facts.select("fact", F.col("fact.seq").alias("fact_seq")), "fact_seq").select("claim_seq", "fact", "how", "ratio")
    edges = keep(similar_pairs(facts, claims), "rename-edges")
    grp = groups(facts)
    best = edges.groupBy("claim_seq").agg(F.collect_list(F.struct("fact_seq", "ratio")).alias("near"))
    empty = F.array().cast("array<struct<fact_seq:long,ratio:double>>")
    asks = claims.join(grp, "key").join(best, F.col("claim.seq") == F.col("claim_seq"), "left").select(
        "grp", F.lit("claim").alias("what"), F.col("claim.seq").alias("seq"), F.col("claim.name").alias("name"), F.col("claim.kind").alias("kind"), "key",
        F.coalesce("near", empty).alias("near"), F.lit(None).cast("long").alias("since"),
    )
    named = facts.join(first, F.col("fact.name") == F.col("name"), "left").join(grp, "key").select(
        "grp", F.lit("fact").alias("what"), F.col("fact.seq").alias("seq"), F.col("fact.name").alias("name"), F.col("fact.kind").alias("kind"), "key", empty.alias("near"), "since"
    )

    touched = edges.select(F.col("fact_seq").alias("seq"), F.lit(True).alias("touched")).distinct()
    spread = spread_names(facts).select("name", F.lit(True).alias("spread"))
    named = keep(named.join(touched, "seq", "left").join(spread, "name", "left").withColumn("own", F.col("touched").isNull() & F.col("spread").isNull()).drop("touched", "spread"), "rename-named")
    longest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc_nulls_first("since"), "seq"))
    has = named.filter("NOT own").unionByName(named.filter("own").withColumn("place", longest).filter("place <= 2").drop("place")).drop("own")
    full = named.filter("own AND since IS NULL").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.lit(True).alias("full"))
    asks = asks.join(full, "key", "left").filter((F.size("near") > 0) | F.col("full").isNull()).drop("full")
    # a group of which every set keeps two facts for good can have no only fact: similar pairs alone decide there, in rounds
    tight = named.select("grp", "key").distinct().join(full, "key", "left_anti").select("grp").distinct()
    asks = asks.join(tight.withColumn("tight", F.lit(True)), "grp", "left")
    open_ = asks.filter("tight IS NULL").select(F.col("seq").alias("claim_seq"), F.explode("near").alias("e")).select("claim_seq", "e.fact_seq", "e.ratio")
    open_ = open_.join(named.select(F.col("seq").alias("fact_seq"), "name", "since"), "fact_seq").filter("since IS NULL OR since >= claim_seq").drop("since")
    free = in_rounds(open_)
    asks = asks.filter("tight").drop("tight")
    has = has.join(asks.select("grp").distinct(), "grp", "left_semi")
    rows = keep(asks.unionByName(has), "rename-rows")
    count = max(1, -(-rows.count() // TOGETHER))
    picked = rows.groupBy(F.pmod(F.xxhash64("grp"), F.lit(count)).alias("together")).applyInPandas(_settle, PICKED)
    return picked.unionByName(free).join(facts.select("fact", F.col("fact.seq").alias("fact_seq")), "fact_seq").select("claim_seq", "fact", "how", "ratio")


PICKED = "claim_seq long, fact_seq long, how string, ratio double"
#: Rows of small groups that are settled by one call; a group is never split.
TOGETHER = 20000


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    """The claims of some groups, each group by itself and in order."""
    groups_: dict = {}
    for what, seq, name, kind, key, near, since, grp in zip(*(rows[c] for c in ("what", "seq", "name", "kind", "key", "near", "since", "grp"))):
        groups_.setdefault(grp, ([], []))[what == "claim"].append((seq, name, kind, key, near, since))
    out = []
    for f, c in groups_.values():
        out += _settle_group(sorted(f, key=lambda r: r[0]), sorted(c, key=lambda r: r[0]))
    return pd.DataFrame(out, columns=["claim_seq", "fact_seq", "how", "ratio"]).astype({"claim_seq": "int64", "fact_seq": "int64", "ratio": "float64"})


def _settle_group(facts: list[tuple], claims: list[tuple]) -> list[tuple]:
    by_seq = {seq: (name, since) for seq, name, _, _, _, since in facts}
    by_key: dict[str, list[int]] = {}
    for seq, _, _, key, _, _ in facts:
        by_key.setdefault(key, []).append(seq)
    taken: set[str] = set()
    out = []

    def free(seq: int, at: int) -> bool:
        name, since = by_seq[seq]
        return name not in taken and not since < at

    for at, name, kind, key, near, _ in claims:
        open_ = [(-round(e["ratio"] * 100, 1), e["fact_seq"]) for e in near if free(e["fact_seq"], at)]
        if open_:
            percent, seq = min(open_)
            out.append((at, seq, "fuzzy", -percent / 100.0))
        elif kind != "config_ref":
            alone = []
            for seq in by_key.get(key, []):
                if free(seq, at):
                    alone.append(seq)
                    if len(alone) > 1:
                        break
            if len(alone) != 1 or (own := ratio(by_seq[alone[0]][0], name)) < RENAMED:
                continue
            seq = alone[0]
            out.append((at, seq, "renamed", own))
        else:
            continue
        taken.add(by_seq[seq][0])
    return out


def in_rounds(edges: DataFrame) -> DataFrame:
    """claim_seq, fact_seq, how, ratio where only similar pairs decide: edges (claim_seq, fact_seq, name, ratio) of facts that are free when the claim asks.

    A claim's order is its priority.  In a round every claim that is the first to ask for the
    name of its best fact takes it, for nobody before it can; a taken name is lost to all
    others that ask for it, as they come later.  There are as many rounds as claims wait for
    each other in a chain.
    """
    out = None
    while True:
        edges = keep(edges, "rename-round")
        if out is not None and edges.isEmpty():
            return out
        first = edges.groupBy("name").agg(F.min("claim_seq").alias("first"))
        best = edges.groupBy("claim_seq").agg(F.min(F.struct((-py_round(F.col("ratio") * 100, 1)).alias("order"), "fact_seq", "name")).alias("b")).select("claim_seq", "b.*")
        settled = keep(best.join(first, "name").filter("first = claim_seq"), "rename-settled")
        told = settled.select("claim_seq", "fact_seq", F.lit("fuzzy").alias("how"), (-F.col("order") / 100.0).alias("ratio"))
        out = told if out is None else out.unionByName(told)
        edges = edges.join(settled.select("claim_seq"), "claim_seq", "left_anti").join(settled.select("name"), "name", "left_anti")
