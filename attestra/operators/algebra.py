"""Selections, joins and aggregates over findings, files and lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import py_round, severity_rank
from ..plans.schema import CATEGORIES, SEVERITIES

REACH = 5  # lines around a change that count as changed
# Folders that a scan leaves out.
EXCLUDED_DIRS = (".git", "__pycache__", ".venv", "node_modules", ".tox", ".pytest_cache", ".mypy_cache")


# --- files -----------------------------------------------------------------------


def outside_excluded(files: DataFrame, path: str = "path") -> DataFrame:
    """Files none of whose path parts is an excluded folder."""
    return files.filter(~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, EXCLUDED_DIRS))))


def fingerprint(mtime: Column | str, size: Column | str) -> Column:
    return F.format_string("%.6f:%d", mtime, size)


def changed_since(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files whose (path, fingerprint) the state does not hold."""
    now = files.withColumn("fingerprint", fingerprint("mtime", "size"))
    return now.join(state.select("path", "fingerprint"), ["path", "fingerprint"], "left_anti")


def restricted(files: DataFrame, changed: DataFrame) -> DataFrame:
    return files.join(changed.select("path"), "path", "left_semi")


def near_changes(rows: DataFrame, changed: DataFrame, path: str, line: str) -> DataFrame:
    """Rows within five lines of a changed line of their file: the changed lines are widened, so the join is on equality."""
    wide = changed.select(F.col("path").alias(path), F.explode(F.sequence(F.col("line") - REACH, F.col("line") + REACH)).alias(line))
    return rows.join(wide.withColumn(line, F.col(line).cast(rows.schema[line].dataType)).distinct(), [path, line], "left_semi")


# --- findings ---------------------------------------------------------------------


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    if severity not in SEVERITIES:
        raise ValueError(f"severity is none of {', '.join(SEVERITIES)}: {severity}")
    return findings.filter(severity_rank(F.col("severity")) <= SEVERITIES.index(severity))


def confident(findings: DataFrame, least: float) -> DataFrame:
    return findings.filter(F.col("confidence") >= least)


def without_categories(findings: DataFrame, categories: Sequence[str]) -> DataFrame:
    names = [c.strip().lower() for c in categories]
    if unknown := sorted(set(names) - set(CATEGORIES)):
        raise ValueError(f"unknown categories: {', '.join(unknown)}; valid: {', '.join(sorted(CATEGORIES))}")
    return findings.filter(~F.lower("category").isin(names))


def fails(findings: DataFrame, fail_on: str = "error") -> bool:
    """Whether a finding reaches the severity, or is of one of the comma-separated categories."""
    if fail_on in SEVERITIES:
        hits = at_least(findings, fail_on)
    else:
        names = [c.strip() for c in fail_on.split(",")]
        hits = findings.filter(F.col("category").isin(names)) if not set(names) & set(SEVERITIES) else findings.limit(0)
    return not hits.isEmpty()


def fixable(findings: DataFrame) -> DataFrame:
    kinds = ("parameter_description", "return_description")
    return findings.filter((F.col("category") == "documented_but_missing") & F.col("claim.kind").isin(*kinds))


# What a patch of the document can mend.
PATCHABLE = ("wrong_default", "wrong_type", "wrong_return_type", "documented_but_missing")


def patchable(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("category").isin(*PATCHABLE))


BASELINE_KEY = ("fact_name", "claim_name", "category")


def _not_in(rows: DataFrame, others: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key, null being a value, the others lack; repeated rows stay."""
    seen = others.select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()
    same = None
    for k in key:
        equal = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = equal if same is None else same & equal
    return rows.join(seen, same, "left_anti")


def new_findings(current: DataFrame, baseline: DataFrame) -> DataFrame:
    return _not_in(current, baseline, BASELINE_KEY)


def resolved_findings(current: DataFrame, baseline: DataFrame) -> DataFrame:
    return _not_in(baseline, current, BASELINE_KEY)


def merged(findings: DataFrame, order: str = "seq") -> DataFrame:
    """Findings of several reports, the first of each (file, fact, claim, category)."""
    key = [F.coalesce("source_file", F.lit("")), F.coalesce("fact_name", F.lit("")), F.col("claim_name"), F.col("category")]
    first = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return findings.withColumn("_first", first).filter("_first = 1").drop("_first")


# --- aggregates --------------------------------------------------------------------


def category_histogram(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(F.count("*").alias("n"))


def totals(findings: DataFrame) -> DataFrame:
    """items, errors, warnings, has_errors, mean_confidence: one row, also of nothing."""
    return findings.agg(
        F.count("*").alias("items"),
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)).alias("has_errors"),
        F.avg("confidence").alias("mean_confidence"),
    )


def health(claims: DataFrame, findings: DataFrame) -> DataFrame:
    """claims, matched, score: a claim is unmatched if its (name, kind) is among the missing; no claims score 100; to one decimal."""
    gone = findings.filter("category = 'documented_but_missing'").select("claim_name", F.col("claim_kind").alias("kind"))
    matched = _not_in(claims.select(F.col("name").alias("claim_name"), "kind"), gone, ("claim_name", "kind")).agg(F.count("*").alias("matched"))
    total = claims.agg(F.count("*").alias("claims"))
    score = F.when(F.col("claims") == 0, 100.0).otherwise(F.try_divide(F.col("matched").cast("double"), F.col("claims").cast("double")) * 100)
    score = py_round(score, 1)
    return total.crossJoin(matched).select("claims", "matched", score.alias("score"))  # one row each


def rules(findings: DataFrame, order: str = "seq") -> DataFrame:
    """category, the message of its first finding and how many there are."""
    return findings.groupBy("category").agg(F.min_by("message", order).alias("message"), F.count("*").alias("n"))
