"""Facts against claims: lookups, the parameter diff, and what is left over.

``match`` takes facts and claims, in the order of their ``seq``, and returns findings.
All lookups are equi-joins on a side that is unique by its key.  A hit and its claim
stand in one row, so the parameter diff needs no shuffle: one expression makes all of a
row's findings, which are then exploded.  Only renames depend on order; see renames.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import jaccard, last_param, last_segment, names_of, param_key, py_repr
from ..functions.tables import keep
from .renames import renames

SIGNALS = "struct<name_similarity:double,param_overlap:double,type_match:double,location_proximity:double,context_match:double>"
FACT_SIDE = ("seq", "name", "kind", "source_file", "line_number", "parameters", "return_type")
CLAIM_SIDE = ("seq", "name", "kind", "doc_file", "line_number", "parameters", "return_type", "raw_text")


def _meta(column: str, key: str) -> Column:
    return F.get_json_object(column, f"$.{key}")


def fact_side(facts: DataFrame) -> DataFrame:
    return facts.select(F.struct(*FACT_SIDE, _meta("metadata", "short_flag").alias("short_flag")).alias("fact"))


def claim_side(claims: DataFrame) -> DataFrame:
    """Claims that can match: named and not suppressed."""
    suppressed = F.lower(F.coalesce(_meta("metadata", "suppressed"), F.lit("false"))) == "true"
    return claims.filter(F.col("name").isNotNull() & ~suppressed).select(F.struct(*CLAIM_SIDE).alias("claim"))


def qualified(facts: DataFrame) -> DataFrame:
    """name, fact: the last fact of each name."""
    return facts.groupBy(F.col("fact.name").alias("name")).agg(F.max_by("fact", F.col("fact.seq")).alias("fact"))


def unqualified(facts: DataFrame) -> DataFrame:
    """last, fact: the only fact of each last name segment; segments with several facts are left out."""
    per = facts.groupBy(last_segment("fact.name").alias("last")).agg(F.count("*").alias("n"), F.min_by("fact", F.col("fact.seq")).alias("fact"))
    return per.filter("n = 1").select("last", "fact")


def short_flags(facts: DataFrame) -> DataFrame:
    """short, fact: the first flag of each short form."""
    flags = facts.filter((F.col("fact.kind") == "cli_flag") & F.col("fact.short_flag").isNotNull())
    return flags.groupBy(F.col("fact.short_flag").alias("short")).agg(F.min_by("fact", F.col("fact.seq")).alias("fact"))


#: Which fact counts for a claim: of its whole name, else of its short flag, else of its last segment.
NAME, SHORT, LAST = 0, 1, 2


def _bearers(facts: DataFrame) -> DataFrame:
    """by, key, seq: the fact that each name (the last), short flag (the first) and last segment (the only) stands for."""
    flag = (F.col("fact.kind") == "cli_flag") & F.col("fact.short_flag").isNotNull()
    rows = facts.select(F.col("fact.seq").alias("seq"), _keys(F.col("fact.name"), F.when(flag, F.col("fact.short_flag")), last_segment("fact.name"))).select("seq", "k.*").filter("key IS NOT NULL")
    per = rows.groupBy("by", "key").agg(F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high"))
    return per.filter((F.col("by") != LAST) | (F.col("n") == 1)).select("by", "key", F.when(F.col("by") == NAME, F.col("high")).otherwise(F.col("low")).alias("fact_seq"))


def _keys(name: Column, short: Column, last: Column) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(by).alias("by"), key.alias("key")) for by, key in ((NAME, name), (SHORT, short), (LAST, last))])).alias("k")


def lookup(facts: DataFrame, claims: DataFrame) -> DataFrame:
    """claim, fact (null: no hit), compare (whether the parameters are to be compared).

    All three kinds of keys are aggregated and joined at once, with nothing but the order of
    facts and claims; the rows themselves are joined where it is known which fact was hit.
    """
    kind, name = F.col("claim.kind"), F.col("claim.name")
    short = F.when((kind == "cli_flag_ref") & name.startswith("-"), name)
    asked = claims.select(F.col("claim.seq").alias("claim_seq"), _keys(name, short, last_segment("claim.name"))).select("claim_seq", "k.*").filter("key IS NOT NULL")
    # the kind of key stands above the order's bits, so that the least number tells both
    best = F.min(F.shiftleft(F.col("by").cast("long"), 61) + F.col("fact_seq"))
    hits = asked.join(_bearers(facts), ["by", "key"]).groupBy("claim_seq").agg(best.alias("best")).select("claim_seq", F.col("best").bitwiseAND(F.lit((1 << 61) - 1)).alias("fact_seq"))
    rows = claims.join(hits, F.col("claim.seq") == F.col("claim_seq"), "left").join(facts.select("fact", F.col("fact.seq").alias("_seq")), F.col("fact_seq") == F.col("_seq"), "left")
    settled = ((F.col("fact.kind") == "cli_flag") & (kind == "cli_flag_ref")) | ((F.col("fact.kind") == "config_key") & (kind == "config_ref"))
    return rows.select("claim", "fact", (F.col("fact").isNotNull() & ~F.coalesce(settled, F.lit(False))).alias("compare"))


def _finding(category: str, severity: str, message: Column, suggestion: Column, confidence: Column, signals: Column | None = None, subject: Column | None = None) -> Column:
    return F.struct(
        F.lit(category).alias("category"),
        F.lit(severity).alias("severity"),
        F.when(F.lit(subject is not None), subject if subject is not None else F.lit(None)).cast("string").alias("subject"),
        message.alias("message"),
        suggestion.alias("suggestion"),
        confidence.cast("double").alias("confidence"),
        (signals if signals is not None else F.lit(None)).cast(SIGNALS).alias("signals"),
    )


def _signals(name: float, overlap: Column, types: float) -> Column:
    return F.struct(F.lit(name).alias("name_similarity"), overlap.alias("param_overlap"), F.lit(types).alias("type_match"), F.lit(0.0).alias("location_proximity"), F.lit(0.0).alias("context_match"))


# Fixed values below: the texts of messages and suggestions.
def _param_findings(owner: Column, overlap: Column, pair: Column) -> Column:
    name, f, c = pair["name"], pair["f"], pair["c"]
    quoted = F.concat(F.lit("'"), name, F.lit("'"))
    missing = _finding("missing_param", "error", F.concat(F.lit("Parameter "), quoted, F.lit(" in "), owner, F.lit(" is not documented")), F.concat(F.lit("Add "), quoted, F.lit(" to docs for "), owner), F.lit(1.0), subject=name)
    extra = _finding("extra_param", "error", F.concat(F.lit("Parameter "), quoted, F.lit(" is documented for "), owner, F.lit(" but not in code")), F.concat(F.lit("Remove "), quoted, F.lit(" from docs or update implementation")), F.lit(1.0), subject=name)
    default = _finding("wrong_default", "warning", F.concat(F.lit("Parameter "), quoted, F.lit(" default differs: "), py_repr(c["default"]), F.lit(" (docs) vs "), py_repr(f["default"]), F.lit(" (code)")), F.concat(F.lit("Update docs for "), quoted, F.lit(" to default="), py_repr(f["default"])), F.lit(1.0), _signals(1.0, overlap, 0.0), name)
    types = _finding("wrong_type", "warning", F.concat(F.lit("Parameter "), quoted, F.lit(" type differs: "), py_repr(c["type_annotation"]), F.lit(" (docs) vs "), py_repr(f["type_annotation"]), F.lit(" (code)")), F.concat(F.lit("Update docs for "), quoted, F.lit(" type to "), py_repr(f["type_annotation"])), F.lit(1.0), _signals(1.0, overlap, 1.0), name)
    both = f.isNotNull() & c.isNotNull()
    return F.array(
        F.when(c.isNull(), missing),
        F.when(c.isNotNull() & f.isNull(), extra),
        F.when(both & ~f["default"].eqNullSafe(c["default"]), default),
        F.when(both & ~f["type_annotation"].eqNullSafe(c["type_annotation"]), types),
    )


def differences(hits: DataFrame) -> DataFrame:
    """seq, fact, claim and their findings: parameters and return types that differ."""
    fact, claim = F.col("fact"), F.col("claim")
    a, b = names_of("fact.parameters"), names_of("claim.parameters")
    rows = hits.filter("compare").withColumn("overlap", jaccard(a, b)).withColumn("names", F.array_union(a, b))
    returns = _finding("wrong_return_type", "warning", F.concat(F.lit("Return type differs: "), py_repr(claim["return_type"]), F.lit(" (docs) vs "), py_repr(fact["return_type"]), F.lit(" (code)")), F.concat(F.lit("Update return type to "), py_repr(fact["return_type"])), F.lit(1.0), _signals(1.0, F.col("overlap"), 0.0))
    # Both sides of each name first, so that the findings look at them and not for them.
    pairs = F.transform("names", lambda n: F.struct(n.alias("name"), last_param(fact["parameters"], n).alias("f"), last_param(claim["parameters"], n).alias("c")))
    rows = rows.withColumn("pairs", pairs)
    params = F.flatten(F.transform("pairs", lambda p: _param_findings(fact["name"], F.col("overlap"), p)))
    found = F.concat(params, F.array(F.when(~fact["return_type"].eqNullSafe(claim["return_type"]), returns)))
    return rows.select("fact", "claim", F.posexplode(F.filter(found, lambda x: x.isNotNull())).alias("at", "f")).select((F.shiftleft(F.col("claim.seq"), 16) + F.col("at")).alias("seq"), "fact", "claim", "f.*")


def match(facts: DataFrame, claims: DataFrame) -> DataFrame:
    """All findings: seq, fact, claim, category, severity, subject, message, suggestion, confidence, signals.

    Their order: what differs, by claim; what nothing was found for, by claim; what is not
    documented, by fact.
    """
    # both are read many times from here on
    facts, claims = keep(fact_side(facts), "match-facts"), keep(claim_side(claims), "match-claims")
    return findings(facts, keep(lookup(facts, claims), "match-hits"))


def findings(facts: DataFrame, hits: DataFrame) -> DataFrame:
    exact = hits.filter(F.col("fact").isNotNull())
    first = exact.groupBy(F.col("fact.name").alias("name")).agg(F.min("claim.seq").alias("since"))
    residue = hits.filter(F.col("fact").isNull()).select("claim", param_key("claim.parameters").alias("key"))
    open_facts = facts.filter(F.col("fact.kind") != "cli_flag").select("fact", param_key("fact.parameters").alias("key"))
    moved = renames(open_facts, residue.filter(~F.col("claim.kind").isin("cli_flag_ref", "cli_usage")), first)
    moved = keep(residue.join(moved, F.col("claim.seq") == F.col("claim_seq"), "left").select("claim", "fact", "how", "ratio"), "match-moved")
    leftover = leftovers(moved)
    names = exact.select(F.col("fact.name").alias("name")).union(moved.filter("fact IS NOT NULL").select("fact.name")).distinct()
    return differences(hits).unionByName(leftover).unionByName(undocumented(facts, names, hits))


def leftovers(moved: DataFrame) -> DataFrame:
    """Findings of the claims without a hit: perhaps renamed (fact, how, ratio), or missing."""
    doc, code = F.concat(F.lit("'"), F.col("claim.name"), F.lit("'")), F.concat(F.lit("'"), F.col("fact.name"), F.lit("'"))
    percent = F.format_string("%.1f", F.col("ratio") * 100)
    fuzzy = _finding("fuzzy_renamed", "warning", F.concat(doc, F.lit(" (docs) may match "), code, F.lit(" (code) — "), percent, F.lit("% confidence")), F.concat(F.lit("Consider renaming "), code, F.lit(" to "), doc, F.lit(" or update docs")), F.col("ratio"))
    renamed = _finding("renamed", "error", F.concat(doc, F.lit(" (docs) may have been renamed to "), code), F.concat(F.lit("Update docs to reference "), code), F.col("ratio"))
    absent = _finding("documented_but_missing", "error", F.concat(doc, F.lit(" is documented but not found in code")), F.concat(F.lit("Add implementation for "), doc, F.lit(" or update docs")), F.lit(0.0), _signals(0.0, F.lit(0.0), 0.0))
    silent = (F.col("claim.kind") == "cli_usage") | ((F.col("claim.kind") == "cli_flag_ref") & F.col("claim.name").isin("--help", "--version"))
    left = F.when(F.col("how") == "fuzzy", fuzzy).when(F.col("how") == "renamed", renamed).when(~silent, absent)
    return moved.withColumn("f", left).filter("f IS NOT NULL").select((F.lit(1 << 61) + F.col("claim.seq")).alias("seq"), "fact", "claim", "f.*")


def undocumented(facts: DataFrame, names: DataFrame, hits: DataFrame) -> DataFrame:
    """Each fact whose name nothing matched; flags are errors."""
    rest = facts.join(names.select(F.col("name").alias("matched")), F.col("fact.name") == F.col("matched"), "left_anti")
    code = F.concat(F.lit("'"), F.col("fact.name"), F.lit("'"))
    told = _finding("undocumented", "warning", F.concat(code, F.lit(" exists in code but is not documented")), F.concat(F.lit("Add documentation for "), F.col("fact.name")), F.lit(0.0))
    told = told.withField("severity", F.when(F.col("fact.kind") == "cli_flag", "error").otherwise("warning"))
    return rest.select("fact", F.lit(None).cast(hits.schema["claim"].dataType).alias("claim"), told.alias("f")).select((F.lit(1 << 62) + F.col("fact.seq")).alias("seq"), "fact", "claim", "f.*")
