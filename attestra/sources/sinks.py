"""Findings as files and texts.

NDJSON, CSV and baselines are written by Spark, in as many files as there are
partitions.  Reports that are one document (SARIF, JSON, Markdown, HTML) come from rows
that Spark has already made into JSON or text, streamed one by one.
"""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import last_param, signature
from ..operators import algebra

# The columns of the export, and the levels of the exchange format.
EXPORT = ("fact_name", "fact_kind", "fact_file", "fact_line", "claim_name", "claim_kind", "claim_file", "claim_line", "severity", "category", "message")
LEVELS = {"error": "error", "warning": "warning", "info": "note"}


def flat(findings: DataFrame) -> DataFrame:
    return findings.select(
        "seq", F.col("fact.name").alias("fact_name"), F.col("fact.kind").alias("fact_kind"), F.col("fact.source_file").alias("fact_file"), F.col("fact.line_number").alias("fact_line"),
        F.col("claim.name").alias("claim_name"), F.col("claim.kind").alias("claim_kind"), F.col("claim.doc_file").alias("claim_file"), F.col("claim.line_number").alias("claim_line"),
        "severity", "category", "message", "suggestion", "confidence",
    )


def write_ndjson(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").json(path)


def write_csv(findings: DataFrame, path: str) -> None:
    flat(findings).select(*EXPORT).na.fill("").write.mode("overwrite").option("header", True).csv(path)


def write_json(findings: DataFrame, path: str) -> None:
    """The export's columns, one object a line; nulls are empty texts as in the other form."""
    flat(findings).select(*EXPORT).withColumns({c: F.col(c).cast("string") for c in ("fact_line", "claim_line")}).na.fill("").write.mode("overwrite").json(path)


def save_baseline(findings: DataFrame, path: str) -> None:
    flat(findings).withColumn("created_at", F.current_timestamp()).write.mode("overwrite").parquet(path)


def load_baseline(spark, path: str) -> DataFrame | None:
    """The stored findings; None if there are none to read."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _rows(findings: DataFrame, row: Column) -> Iterator[str]:
    for r in findings.select(row.alias("r")).toLocalIterator(prefetchPartitions=True):
        yield r.r


def json_report(findings: DataFrame, scanned: str, facts: int, claims: int) -> Iterator[str]:
    t = algebra.totals(findings).first()
    head = {"scanned_path": scanned, "summary": {"facts": facts, "claims": claims, "findings": t["items"], "errors": t.errors, "warnings": t.warnings}, "has_errors": t.has_errors}
    yield json.dumps(head)[:-1] + ', "findings": ['
    for i, row in enumerate(_rows(findings, F.to_json(F.struct(*findings.columns)))):
        yield ("," if i else "") + row
    yield "]}"


def sarif(findings: DataFrame, order: str = "seq") -> Iterator[str]:
    """One rule per category, told by the message of its first finding."""
    f = flat(findings)
    found = [{"id": r.category, "shortDescription": {"text": r.message}} for r in algebra.rules(f, order).orderBy("category").collect()]  # one per category
    yield json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json"})[:-1]
    yield ', "runs": [{"tool": {"driver": {"name": "attestra", "rules": ' + json.dumps(found) + '}}, "results": ['
    place = lambda file, line: F.when(F.col(file).isNotNull(), F.struct(F.struct(F.struct(F.col(file).alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.coalesce(F.col(line), F.lit(1)), F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation")))
    level = F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.col("severity"))
    row = F.to_json(F.struct(
        F.col("category").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.array_compact(F.array(place("fact_file", "fact_line"), place("claim_file", "claim_line"))).alias("locations"), (F.col("confidence") * 100).alias("rank"),
    ))
    for i, r in enumerate(_rows(f, row)):
        yield ("," if i else "") + r
    yield "]}]}"


def console(findings: DataFrame) -> Iterator[str]:
    f = flat(findings)
    for severity in ("error", "warning", "info"):
        where = F.concat_ws(":", F.coalesce("claim_file", "fact_file"), F.coalesce("claim_line", "fact_line"))
        yield from _rows(f.filter(F.col("severity") == severity), F.concat_ws("  ", F.upper("severity"), where, F.concat(F.lit("["), "category", F.lit("]")), "message"))
    for r in algebra.category_histogram(f).orderBy("category").collect():  # one per category
        yield f"{r.category}: {r.n}"
    t = algebra.totals(f).first()
    yield f"{t['items']} findings, {t.errors} errors, {t.warnings} warnings" + (f", mean confidence {t.mean_confidence:.2f}" if t.mean_confidence is not None else "")


def markdown_summary(findings: DataFrame) -> Iterator[str]:
    t = algebra.totals(findings).first()
    yield f"## Documentation check\n\n{t['items']} findings, {t.errors} errors, {t.warnings} warnings\n\n| severity | category | message |\n|-|-|-|\n"
    yield from _rows(flat(findings), F.concat(F.lit("| "), "severity", F.lit(" | "), "category", F.lit(" | "), F.replace("message", F.lit("|"), F.lit("\\|")), F.lit(" |\n")))


def html_report(findings: DataFrame, title: str) -> Iterator[str]:
    yield f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table>"
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    cells = [F.concat(F.lit("<td>"), safe(c), F.lit("</td>")) for c in ("severity", "category", "fact_name", "claim_name", "message", "suggestion", "confidence")]
    yield from _rows(flat(findings), F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")))
    yield "</table>"


def patches(findings: DataFrame, doc_lines: DataFrame, around: int = 3) -> DataFrame:
    """claim_file, claim_line, category, patch: a unified patch of the document for each finding that one can mend.

    What is documented but missing goes with its line; a default, type or return type that
    is wrong is replaced by the code's.  Findings whose line a replacement would not change
    have no row.  Return types and types are followed by one line less.
    """
    f = algebra.patchable(findings).filter("claim IS NOT NULL").withColumn("id", F.col("seq"))
    after = F.when(F.col("category").isin("wrong_type", "wrong_return_type"), around - 1).otherwise(around)
    f = f.select("id", "category", "fact", "claim", F.col("claim.doc_file").alias("claim_file"), F.col("claim.line_number").alias("claim_line"), after.alias("after"))
    near = f.select("id", "claim_file", F.explode(F.sequence(F.col("claim_line") - around, F.col("claim_line") + F.col("after"))).alias("line"))
    lines = doc_lines.select(F.col("path").alias("claim_file"), "line", F.rtrim("text").alias("text"))
    hunks = near.join(lines, ["claim_file", "line"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("lines"))
    f = f.join(hunks, "id").withColumn("old", F.get(F.filter("lines", lambda x: x["line"] == F.col("claim_line")), F.lit(0))["text"]).filter("old IS NOT NULL")

    def swapped(line: Column, mark: str, old: Column, new: Column) -> Column:
        return F.when(line.contains(F.concat(F.lit(mark), old)), F.replace(line, F.concat(F.lit(mark), old), F.concat(F.lit(mark), new))).when(line.contains(old), F.replace(line, old, new)).otherwise(line)

    def params(field: str, mark: str) -> Column:
        of = lambda p: last_param(F.col("claim.parameters"), p["name"])[field]
        wrong = F.filter(F.transform("fact.parameters", lambda p: F.struct(of(p).alias("old"), p[field].alias("new"))), lambda x: (x["old"] != "") & (x["new"] != "") & (x["old"] != x["new"]))
        return F.aggregate(wrong, F.col("old"), lambda line, x: swapped(line, mark, x["old"], x["new"]))

    a, b = F.col("claim.return_type"), F.col("fact.return_type")
    returned = F.when((a != "") & (b != "") & F.col("old").contains(F.concat(F.lit("-> "), a)), F.replace("old", F.concat(F.lit("-> "), a), F.concat(F.lit("-> "), b))).otherwise(F.col("old"))
    new = F.when(F.col("category") == "wrong_default", params("default", "= ")).when(F.col("category") == "wrong_type", params("type_annotation", ": ")).when(F.col("category") == "wrong_return_type", returned)
    f = f.withColumn("new", new).filter("new IS NULL OR new <> old")
    side = lambda before: F.transform(F.filter("lines", lambda x: x["line"] < F.col("claim_line") if before else x["line"] > F.col("claim_line")), lambda x: F.concat(F.lit(" "), x["text"]))
    own = F.when(F.col("new").isNull(), F.array(F.concat(F.lit("-"), "old"))).otherwise(F.array(F.concat(F.lit("-"), "old"), F.concat(F.lit("+"), "new")))
    first, n = F.get("lines", F.lit(0))["line"].cast("string"), F.size("lines")
    span = F.concat(F.lit("@@ -"), first, F.lit(","), n.cast("string"), F.lit(" +"), first, F.lit(","), (n - F.col("new").isNull().cast("int")).cast("string"), F.lit(" @@ ["), "category", F.lit("]"))
    head = F.concat(F.lit("diff --git a/"), "claim_file", F.lit(" b/"), "claim_file", F.lit("\n--- a/"), "claim_file", F.lit("\n+++ b/"), "claim_file", F.lit("\n"), span, F.lit("\n"))
    return f.select("claim_file", "claim_line", "category", F.concat(head, F.array_join(F.concat(side(True), own, side(False)), "\n"), F.lit("\n")).alias("patch"))


def diff_view(findings: DataFrame) -> Iterator[str]:
    """Each finding as what the document says (-) against what the code says (+)."""
    def shown(side: str, mark: str) -> Column:
        own = F.coalesce(F.col(f"{side}.return_type"), F.lit(""))
        return F.when(F.col(f"{side}.name").isNotNull(), F.concat(F.lit(mark), signature(F.col(f"{side}.name"), F.col(f"{side}.parameters"), own), F.lit("\n"))).otherwise("")

    where = F.concat_ws(":", F.coalesce("claim.doc_file", "fact.source_file"), F.coalesce("claim.line_number", "fact.line_number").cast("string"))
    yield from _rows(findings.orderBy("seq"), F.concat(F.lit("["), "category", F.lit("] "), where, F.lit("\n"), shown("claim", "- "), shown("fact", "+ "), F.coalesce(F.concat(F.lit("  "), "suggestion", F.lit("\n")), F.lit("")), F.lit("\n")))
