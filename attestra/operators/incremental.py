"""Matching again only what a change touches.

``start`` matches all facts and claims and keeps, by the identity of their rows: which fact
each claim hits, what was taken for renamed, and the findings.  ``update`` takes the facts
and claims of the next scan.  A row is the same if all its columns but ``seq`` are; among
equal rows it goes by their order, so that rows that stay keep their order too.  Then

* claims are looked up again if they are new, or share their name, last segment or short
  flag with a fact that came or went, against the facts that bear those names alone;
* parameter sets are settled again if a fact of theirs came, went, or is hit by other claims
  than before, or if a claim without a hit came or went, together with all sets that share
  fact names with them, directly or through others;
* facts are told to be undocumented again if their name was touched by either.

All else is taken from what was kept.  The result equals a match from the start.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import last_segment, param_key
from ..functions.tables import keep
from . import match as M
from .renames import groups, renames

FOUND = ("place", "category", "severity", "subject", "message", "suggestion", "confidence", "signals")


@dataclass
class Matched:
    """facts and claims (id and the struct that matching reads), hits and moved (claim_id, fact_id, fact_name, key, ...), findings (claim_id, fact_id, ...); touched: how many rows were matched again."""

    facts: DataFrame
    claims: DataFrame
    hits: DataFrame
    moved: DataFrame
    findings: DataFrame
    touched: dict[str, int]


def identified(rows: DataFrame) -> DataFrame:
    """Adds id: all columns but seq, and the place among equal rows."""
    content = F.sha2(F.to_json(F.struct(*[c for c in rows.columns if c != "seq"])), 256)
    rows = rows.withColumn("content", content)
    place = F.row_number().over(Window.partitionBy("content").orderBy("seq"))
    return rows.withColumn("id", F.concat("content", F.lit(":"), place)).drop("content")


def _sides(facts: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    f, c = identified(facts), identified(claims)
    fact = F.struct(*M.FACT_SIDE, F.get_json_object("metadata", "$.short_flag").alias("short_flag"), "id")
    named = c.filter(F.col("name").isNotNull() & (F.lower(F.coalesce(F.get_json_object("metadata", "$.suppressed"), F.lit("false"))) != "true"))
    return keep(f.select("id", fact.alias("fact")), "delta-facts"), keep(named.select("id", F.struct(*M.CLAIM_SIDE, "id").alias("claim")), "delta-claims")


def _ids(rows: DataFrame, *more: Column | str) -> DataFrame:
    return rows.select(F.col("claim.id").alias("claim_id"), F.col("fact.id").alias("fact_id"), F.col("fact.name").alias("fact_name"), *more)


def _renamed(facts: DataFrame, residue: DataFrame, first: DataFrame) -> DataFrame:
    """claim, fact (or null), how, ratio, key of the claims without a hit."""
    open_facts = facts.filter("fact.kind <> 'cli_flag'").select("fact", param_key("fact.parameters").alias("key"))
    moved = renames(open_facts, residue.filter(~F.col("claim.kind").isin("cli_flag_ref", "cli_usage")), first)
    return residue.join(moved, F.col("claim.seq") == F.col("claim_seq"), "left").select("claim", "fact", "how", "ratio", "key")


def _residue(hits: DataFrame) -> DataFrame:
    return hits.filter("fact IS NULL").select("claim", param_key("claim.parameters").alias("key"))


def _stored(found: DataFrame) -> DataFrame:
    # the findings of one claim are told apart by the low bits of their order
    return found.withColumn("place", F.col("seq").bitwiseAND(F.lit((1 << 16) - 1)).cast("int")).select(F.col("claim.id").alias("claim_id"), F.col("fact.id").alias("fact_id"), F.col("fact.name").alias("fact_name"), *FOUND)


def start(facts: DataFrame, claims: DataFrame) -> Matched:
    f, c = _sides(facts, claims)
    hits = keep(M.lookup(f.select("fact"), c.select("claim")), "delta-hits")
    first = hits.filter("fact IS NOT NULL").groupBy(F.col("fact.name").alias("name")).agg(F.min("claim.seq").alias("since"))
    moved = keep(_renamed(f, _residue(hits), first), "delta-moved")
    found = M.differences(hits).unionByName(M.leftovers(moved)).unionByName(M.undocumented(f.select("fact"), _names(_ids(hits), _ids(moved)), hits))
    return Matched(f, c, keep(_ids(hits), "delta-hit-ids"), keep(_ids(moved, "how", "ratio", "key"), "delta-moved-ids"), keep(_stored(found), "delta-findings"), {"claims": c.count(), "facts": f.count()})


def _names(*hits: DataFrame) -> DataFrame:
    return functools.reduce(DataFrame.union, [h.filter("fact_name IS NOT NULL").select(F.col("fact_name").alias("name")) for h in hits]).distinct()


def _where(rows: DataFrame, values: DataFrame, on: Column | str, how: str = "left_semi") -> DataFrame:
    """The rows whose ``on`` is (or is not) in the only column of ``values``."""
    (name,) = values.columns
    told = values.filter(F.col(name).isNotNull()).select(F.col(name).alias("_of")).distinct()
    return rows.join(told, (F.col(on) if isinstance(on, str) else on) == F.col("_of"), how)


def update(old: Matched, facts: DataFrame, claims: DataFrame) -> Matched:
    f, c = _sides(facts, claims)
    came, went = f.join(old.facts.select("id"), "id", "left_anti"), old.facts.join(f.select("id"), "id", "left_anti")
    changed = keep(came.select("fact").unionByName(went.select("fact")).select(F.col("fact.name").alias("name"), last_segment("fact.name").alias("last"), F.when(F.col("fact.kind") == "cli_flag", F.col("fact.short_flag")).alias("short"), param_key("fact.parameters").alias("key")), "delta-changed")
    names, lasts, shorts = (changed.select(n).distinct() for n in ("name", "last", "short"))

    # claims that are looked up again
    flag = F.when(F.col("claim.kind") == "cli_flag_ref", F.col("claim.name"))
    again = [c.join(old.claims.select("id"), "id", "left_anti"), _where(c, names, "claim.name"), _where(c, lasts, last_segment("claim.name")), _where(c, shorts, flag)]
    asked = keep(functools.reduce(DataFrame.unionByName, again).dropDuplicates(["id"]), "delta-asked")
    near = [_where(f, asked.select("claim.name"), "fact.name"), _where(f, asked.select(last_segment("claim.name").alias("last")), last_segment("fact.name")), _where(f, asked.select("claim.name"), "fact.short_flag")]
    around = functools.reduce(DataFrame.unionByName, near).dropDuplicates(["id"]).select("fact")
    hits = keep(M.lookup(around, asked.select("claim")), "delta-hits")
    gone = old.claims.join(c.select("id"), "id", "left_anti").select("id", "claim")
    dropped = keep(asked.select("id").union(gone.select("id")).distinct(), "delta-dropped")
    kept_hits = _where(old.hits, dropped, "claim_id", "left_anti")
    all_hits = keep(kept_hits.unionByName(_ids(hits)), "delta-hit-ids")

    # parameter sets that are settled again
    touched = names.union(_names(_where(old.hits, dropped, "claim_id"), _ids(hits))).distinct()
    keys = changed.select("key").union(_where(f, touched, "fact.name").select(param_key("fact.parameters").alias("key"))).union(_residue(hits).select("key")).union(_where(old.moved, dropped, "claim_id").select("key")).distinct()
    open_facts = f.filter("fact.kind <> 'cli_flag'").select("id", "fact", param_key("fact.parameters").alias("key"))
    grouped = groups(open_facts.select("fact", "key"))
    keys = keep(keys.union(_where(grouped, _where(grouped, keys, "key").select("grp"), "grp").select("key")).distinct(), "delta-keys")
    own = _where(open_facts, keys, "key")
    loose = all_hits.filter("fact_id IS NULL").select(F.col("claim_id").alias("id")).join(c, "id").select("claim", param_key("claim.parameters").alias("key"))
    residue = keep(_where(loose, keys, "key"), "delta-residue")
    first = _where(all_hits, own.select("fact.name"), "fact_name").join(c.select(F.col("id").alias("claim_id"), F.col("claim.seq").alias("seq")), "claim_id").groupBy(F.col("fact_name").alias("name")).agg(F.min("seq").alias("since"))
    moved = keep(_renamed(own.select("id", "fact"), residue, first), "delta-moved")
    unsettled = _where(old.moved, keys, "key")
    kept_moved = _where(_where(old.moved, dropped, "claim_id", "left_anti"), keys, "key", "left_anti")
    all_moved = keep(kept_moved.unionByName(_ids(moved, "how", "ratio", "key")), "delta-moved-ids")

    # findings
    redone = dropped.union(residue.select("claim.id")).union(unsettled.select("claim_id")).distinct()
    retold = touched.union(_names(unsettled, _where(old.moved, dropped, "claim_id"), _ids(moved))).distinct()
    kept = _where(old.findings.filter("claim_id IS NOT NULL"), redone, "claim_id", "left_anti").unionByName(_where(old.findings.filter("claim_id IS NULL"), retold, "fact_name", "left_anti"))
    matched = _names(_where(all_hits, retold, "fact_name"), _where(all_moved, retold, "fact_name"))
    silent = M.undocumented(_where(f, retold, "fact.name").select("fact"), matched, hits)
    found = _stored(M.differences(hits).unionByName(M.leftovers(moved)).unionByName(silent))
    return Matched(f, c, all_hits, all_moved, keep(kept.unionByName(found), "delta-findings"), {"claims": asked.count(), "facts": around.count(), "settled": residue.count()})


def findings(state: Matched) -> DataFrame:
    """The findings with their facts and claims; place tells those of one claim apart."""
    f, c = state.facts.select(F.col("id").alias("fact_id"), F.col("fact").dropFields("id").alias("fact")), state.claims.select(F.col("id").alias("claim_id"), F.col("claim").dropFields("id").alias("claim"))
    return state.findings.drop("fact_name").join(f, "fact_id", "left").join(c, "claim_id", "left").drop("fact_id", "claim_id")
