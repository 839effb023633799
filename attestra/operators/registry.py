"""Rules of one's own.

``register`` takes what turns the rows of Python sources into facts by DataFrame operations.
``register_text`` takes a function of a file's path and text; it becomes a Python UDTF that
Spark calls by a LATERAL join over all files with one of its suffixes.  Its facts take part
in scans and in their lists of rules; what it raises becomes an error row of that file.
"""

from __future__ import annotations

import json
import logging
import threading
import uuid
from collections.abc import Callable, Iterable
from importlib.metadata import entry_points

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..plans.schema import FACT_KINDS, PARAMS
from .python_facts import RULES, module_of

Rule = Callable[[DataFrame], DataFrame]
ENTRY_POINTS = "attestra.rules"
_lock = threading.Lock()


def register(name: str) -> Callable[[Rule], Rule]:
    """``@register("MyRule")`` on a function from node rows to facts; a name can be taken once."""

    def add(rule: Rule) -> Rule:
        with _lock:
            if RULES.get(name, rule) is not rule:
                raise ValueError(f"a rule is named {name} already")
            RULES[name] = rule
        return rule

    return add


TextRule = Callable[[str, str], Iterable[dict]]
TEXT_RULES: dict[str, tuple[tuple[str, ...], TextRule]] = {}
FOUND = "name string, kind string, line_number int, metadata string, error string"


def register_text(name: str, *suffixes: str) -> Callable[[TextRule], TextRule]:
    """``@register_text("SqlTables", ".sql")`` on a function from (path, text) to dicts with name, kind, line and, if wanted, metadata; a name can be taken once, among all rules."""
    if not suffixes:
        raise ValueError("a rule over texts names the suffixes that it reads")

    def add(rule: TextRule) -> TextRule:
        with _lock:
            if name in RULES or TEXT_RULES.get(name, (suffixes, rule)) != (suffixes, rule):
                raise ValueError(f"a rule is named {name} already")
            TEXT_RULES[name] = (suffixes, rule)
        return rule

    return add


def _chosen(only: tuple[str, ...], without: tuple[str, ...]) -> dict[str, tuple[tuple[str, ...], TextRule]]:
    return {n: r for n, r in TEXT_RULES.items() if n not in without and (not only or n in only)}


def text_suffixes(only: tuple[str, ...] = (), without: tuple[str, ...] = ()) -> tuple[str, ...]:
    return tuple(sorted({s for suffixes, _ in _chosen(only, without).values() for s in suffixes}))


def _table_function(rule: TextRule):
    class Found:
        @staticmethod
        def analyze(path: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
            for argument in (path, text):
                if argument.dataType != T.StringType():
                    raise ValueError("a rule over texts takes a path and a text")
            fields = [T.StructField(n, T.IntegerType() if k == "int" else T.StringType()) for n, k in (f.split(" ") for f in FOUND.split(", "))]
            return AnalyzeResult(T.StructType(fields))

        def eval(self, path: str, text: str):
            try:
                for d in rule(path, text or ""):
                    if d["kind"] not in FACT_KINDS:
                        raise ValueError(f"no kind of fact: {d['kind']}")
                    yield str(d["name"]), d["kind"], int(d.get("line", 1)), json.dumps(d.get("metadata", {})), None
            except Exception as e:  # noqa: BLE001 - another package's code
                yield None, None, 1, None, f"{type(e).__name__}: {e}"

    return F.udtf(Found)


def text_facts(files: DataFrame, only: tuple[str, ...] = (), without: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Facts of the rules over texts that apply (with rank and extractor), and path, line, error of what they raised."""
    spark, rows = files.sparkSession, None
    for name, (suffixes, rule) in _chosen(only, without).items():
        function, view = f"rule_{uuid.uuid4().hex}", f"files_{uuid.uuid4().hex}"
        spark.udtf.register(function, _table_function(rule))
        files.filter(F.col("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")).createOrReplaceTempView(view)
        found = spark.sql(f"SELECT f.path, r.* FROM {view} f, LATERAL {function}(f.path, f.text) r").withColumn("extractor", F.lit(name))
        spark.catalog.dropTempView(view)
        rows = found if rows is None else rows.unionByName(found)
    if rows is None:
        rows = spark.createDataFrame([], f"path string, {FOUND}, extractor string")
    none = F.lit(None).cast("string")
    facts = rows.filter("error IS NULL").select(
        "name", "kind", F.col("path").alias("source_file"), "line_number", F.array().cast(PARAMS).alias("parameters"), none.alias("return_type"), F.array().cast("array<string>").alias("decorators"), module_of(F.col("path")).alias("module"),
        none.alias("docstring"), "metadata", F.lit(102).alias("rank"), "extractor")
    return facts, rows.filter("error IS NOT NULL").select("path", F.col("line_number").alias("line"), "error")


def discover() -> list[str]:
    """Registers the rules that installed packages offer; one that fails to load is logged and left out."""
    found = []
    for point in entry_points(group=ENTRY_POINTS):
        try:
            rule = point.load()
            # a rule over texts says which suffixes it reads
            suffixes = getattr(rule, "suffixes", ())
            (register_text(point.name, *suffixes) if suffixes else register(point.name))(rule)
            found.append(point.name)
        except Exception:  # noqa: BLE001 - another package's code
            logging.getLogger(__name__).warning("rule %s cannot be loaded", point.name, exc_info=True)
    return found
