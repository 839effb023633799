"""Commands: scan, check, summary, init, fix, explain, list-extractors, baseline-save, baseline-export."""

from __future__ import annotations

import argparse
import contextlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import algebra
from .operators import lines as L
from .operators.python_facts import RULES
from .operators.registry import TEXT_RULES
from .plans.scan import Report, scan_all
from .plans.schema import CATEGORIES
from .sources import git, settings, sinks

FORMATS = ("console", "json", "json-lines", "sarif", "html", "markdown", "diff-output", "patch")
BASELINE = ".attestra/baseline"
#: What each category means, for people.
LABELS = {
    "documented_but_missing": "documented, but not in the code", "undocumented": "in the code, but not documented", "missing_param": "a parameter is not documented", "extra_param": "a documented parameter does not exist",
    "wrong_default": "another default is documented", "wrong_type": "another type is documented", "wrong_return_type": "another return type is documented", "renamed": "probably renamed", "fuzzy_renamed": "perhaps renamed",
}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="attestra", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("scan", "check", "summary", "fix", "baseline-save", "baseline-export"):
        c = commands.add_parser(name)
        c.add_argument("paths", nargs="*", default=["."])
        c.add_argument("--format", choices=FORMATS)
        c.add_argument("-o", "--output")
        c.add_argument("--config")
        c.add_argument("-s", "--severity", default="info")
        c.add_argument("--min-confidence", type=float, help="the settings' threshold unless given")
        c.add_argument("--exclude-category", action="append", default=[])
        c.add_argument("--fail-on")
        c.add_argument("--strict", action="store_true", help="warnings fail too")
        c.add_argument("--extractor", action="append", default=[])
        c.add_argument("--without-extractor", action="append", default=[])
        c.add_argument("--include-js", action="store_true")
        c.add_argument("--full", action="store_true")
        c.add_argument("--since")
        c.add_argument("--diff", help="a git reference: only files that differ from it")
        c.add_argument("--diff-lines", action="store_true", help="with --diff: only near lines that differ")
        c.add_argument("--state", help="folder that keeps the rows of parsed files")
        c.add_argument("--baseline", action="store_true")
        c.add_argument("--update-baseline", action="store_true")
        c.add_argument("--baseline-path", default=BASELINE)
        c.add_argument("--watch", action="store_true")
        c.add_argument("--once", action="store_true", help="with --watch: look once and end")
        c.add_argument("-q", "--quiet", action="store_true")
    i = commands.add_parser("init")
    i.add_argument("path", nargs="?", default=".")
    i.add_argument("--force", action="store_true")
    commands.add_parser("list-extractors")
    e = commands.add_parser("explain")
    e.add_argument("category", nargs="?", choices=[*LABELS])
    return parser


def options_of(spark: SparkSession, args: argparse.Namespace, config: settings.Settings) -> dict:
    """The options of a scan; with --diff each path has the changes of its own repository."""
    options = {"only": args.extractor or config.enabled or (), "without": (*args.without_extractor, *config.disabled), "ignore": config.ignore_patterns, "include_js": args.include_js, "full": args.full, "since": args.since, "state": args.state}

    def changes(path: str) -> dict:
        base = git.merge_base(path, args.diff) or args.diff
        changed = git.changed_files(spark, path, base)
        if changed is None:
            raise SystemExit(f"{path}: git knows no {args.diff}")
        return {"changed": changed, "changed_lines": git.changed_lines(spark, path, base) if args.diff_lines else None}

    return options | {"own": changes if args.diff else None}


def report_of(spark: SparkSession, args: argparse.Namespace, config: settings.Settings) -> Report:
    return scan_all(spark, args.paths, **options_of(spark, args, config))


def chosen(spark: SparkSession, report: Report, args: argparse.Namespace) -> DataFrame | None:
    """The findings that the options leave; None if there is no baseline to compare with."""
    found = report.findings
    if args.baseline:
        old = sinks.load_baseline(spark, args.baseline_path)
        if old is None:
            return None
        named = found.select("*", found["fact.name"].alias("fact_name"), found["claim.name"].alias("claim_name"))
        found = algebra.new_findings(named, old).select(*found.columns)
    return algebra.without_categories(algebra.confident(algebra.at_least(found, args.severity), args.min_confidence), args.exclude_category)


def told(report: Report, found: DataFrame, args: argparse.Namespace, form: str):
    lines = lambda parts: (line + "\n" for line in parts)
    if form == "json":
        return sinks.json_report(found, ", ".join(args.paths), report.facts.count(), report.claims.count())
    if form == "json-lines":
        return lines(r.r for r in found.select(F.to_json(F.struct(*found.columns)).alias("r")).toLocalIterator())
    if form == "patch":
        return (r.patch for r in sinks.patches(found, L.lines(report.files)).orderBy("claim_file", "claim_line", "category").toLocalIterator())
    parts = {"sarif": sinks.sarif, "markdown": sinks.markdown_summary, "diff-output": sinks.diff_view, "html": lambda f: sinks.html_report(f, ", ".join(args.paths))}
    return parts[form](found) if form in parts else lines(sinks.console(found))


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "list-extractors":
        print("\n".join([*RULES, *TEXT_RULES]))
        return 0
    if args.command == "explain":
        print("\n".join(f"{c}: {LABELS[c]}" for c in ([args.category] if args.category else [c for c in CATEGORIES if c in LABELS])))
        return 0
    if args.command == "init":
        print(settings.init(args.path, args.force))
        return 0
    spark, config = SparkSession.builder.getOrCreate(), settings.load(args.config, args.paths[0])
    if args.min_confidence is None:
        args.min_confidence = config.threshold
    if args.watch:
        from .streaming.watch import watch

        def again(report: Report, _: DataFrame) -> None:
            found = chosen(spark, report, args)
            sys.stdout.writelines(["no baseline\n"] if found is None else told(report, found, args, args.format or "console"))
            sys.stdout.flush()

        watch(spark, args.paths, again, f"{args.state or BASELINE}-watch", once=args.once, **options_of(spark, args, config)).awaitTermination()
        return 0
    report = report_of(spark, args, config)
    found = chosen(spark, report, args)
    if found is None:
        print("no baseline", file=sys.stderr)
        return 2
    if args.command == "baseline-save" or args.update_baseline:
        sinks.save_baseline(report.findings, args.baseline_path)
    if args.command == "baseline-save":
        return 0
    if args.command == "baseline-export":
        as_json = args.format == "json"
        (sinks.write_json if as_json else sinks.write_csv)(found, args.output or f"{args.baseline_path}.{'json' if as_json else 'csv'}")
        return 0
    if args.command == "summary":
        h, t = algebra.health(report.claims, sinks.flat(found)).first(), algebra.totals(found).first()
        print(f"{report.files.count()} files, {report.facts.count()} facts, {h.claims} claims, {t['items']} findings, {t.errors} errors, {t.warnings} warnings, health {h.score:.1f}")
        return 0
    form = args.format or ("patch" if args.command == "fix" else "json" if config.output_format == "json" else "console")
    if args.command in ("scan", "fix") and not args.quiet:
        with open(args.output, "w") if args.output else contextlib.nullcontext(sys.stdout) as out:
            out.writelines(told(report, found, args, form))
    if args.command == "fix":
        return 0
    return int(algebra.fails(found, "warning" if args.strict else args.fail_on or config.fail_on))


if __name__ == "__main__":
    sys.exit(main())
