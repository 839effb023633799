"""What the rules for other texts find, as rows of the facts and claims tables, so that it can be matched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import lines as L
from ..operators import other_docs as D
from ..operators.python_facts import module_of
from ..operators.jsdoc import jsdoc
from ..operators.rst import rst
from ..sources.config_files import openapi_facts, pyproject_facts, yaml_facts
from .schema import PARAMS

#: Ends of the names of files that a full scan reads besides.
FULL_SUFFIXES = (".ts", ".tsx", ".graphql", ".gql", ".tf", "Dockerfile", "Makefile", ".mk", ".env", ".rst")


def _text(value: str | None) -> Column:
    return F.lit(value).cast("string")


def _facts(
    rows: DataFrame, extractor: str, kind: Column | str = "config_key", metadata: list[Column | str] = ("value",), params: Column | None = None, source: str | None = None, returns: Column | None = None, module: Column | None = None,
) -> DataFrame:
    return rows.select(
        "name", (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (F.lit(source) if source else F.col("path")).alias("source_file"), (F.col("line").cast("int") if "line" in rows.columns else F.lit(1)).alias("line_number"),
        (params if params is not None else F.array().cast(PARAMS)).alias("parameters"), (_text(None) if returns is None else returns).alias("return_type"), F.array().cast("array<string>").alias("decorators"), F.coalesce(*([] if module is None else [module]), module_of(F.col("path"))).alias("module"), _text(None).alias("docstring"),
        (F.col("metadata") if "metadata" in rows.columns else F.to_json(F.struct(*metadata))).alias("metadata"), F.lit(101).alias("rank"), F.lit(extractor).alias("extractor"))


def _param(name: Column, type_: Column, optional: Column, readonly: Column, default: Column | None = None, kind: str = "positional") -> Column:
    return F.struct(name.alias("name"), type_.alias("type_annotation"), (_text(None) if default is None else default).alias("default"), F.lit(kind).alias("kind"), optional.alias("is_optional"), readonly.alias("is_readonly"))


def _typescript(files: DataFrame) -> DataFrame:
    names, enum = F.transform("members", lambda m: m["name"]), F.col("kind") == "ts_enum"
    told = [F.upper("kind").alias("ts_kind"), F.when(~enum, names).alias("properties"), F.when(enum, names).alias("members"), F.col("parent").alias("extends"), F.col("expression").alias("type_expression"), "is_const"]
    return _facts(D.typescript(files), "TypeScriptExtractor", F.col("kind"), told, _members("positional"))


def _members(kind: str) -> Column:
    return F.transform("members", lambda m: _param(m["name"], m["type"], m["is_optional"], m["is_readonly"], m["default"], kind)).cast(PARAMS)


def _graphql(files: DataFrame) -> DataFrame:
    called, enum = F.col("kind") == "api_endpoint", F.col("what") == "enum"
    told = [
        F.when(called, F.col("what")).alias("operation_type"), F.col("type").endswith("!").alias("is_required"), F.col("type").contains("[").alias("is_list"), F.when(~called, F.col("what")).alias("graphql_kind"),
        F.when(enum, F.transform("members", lambda m: m["name"])).alias("values")]
    return _facts(D.graphql(files), "GraphQLExtractor", F.col("kind"), told, F.when(enum, F.array().cast(PARAMS)).otherwise(_members("keyword")), returns=F.rtrim("type", F.lit("!")), module=F.when(called, F.col("module")))


def _terraform(files: DataFrame) -> DataFrame:
    return _facts(D.terraform(files).withColumn("line", F.lit(0)), "TerraformExtractor", source="<terraform>")


def _dockerfile(files: DataFrame) -> DataFrame:
    return _facts(L.dockerfile(files), "DockerfileExtractor", metadata=["value", F.upper(F.split_part("name", F.lit("."), F.lit(1))).alias("instruction")])


def _makefile(files: DataFrame) -> DataFrame:
    return _facts(L.makefile(files), "MakefileExtractor", metadata=["value", F.substring("name", 6, 1 << 30).alias("target"), "description", F.when(F.col("phony"), True).alias("phony"), F.split("value", r"\s+").alias("prerequisites")])


def _dotenv(files: DataFrame) -> DataFrame:
    kind = F.when(F.col("value").isNull(), "empty").when(F.col("value").rlike(r"^[+-]?\d+(\.\d+)?$"), "number").when(F.lower("value").isin("true", "false"), "boolean").otherwise("string")
    return _facts(L.dotenv(files), "DotenvExtractor", metadata=["value", F.col("name").alias("env_var"), F.lit("dotenv").alias("source"), kind.alias("value_type")])


#: Rules over texts, by the ends of the paths that they read.
RULES = {r"\.tsx?$": _typescript, r"\.(graphql|gql)$": _graphql, r"\.tf$": _terraform, r"Dockerfile$": _dockerfile, r"(Makefile|\.mk)$": _makefile, r"\.env[^/]*$": _dotenv}


def _present(files: DataFrame, patterns: list[str]) -> set[str]:
    """Which of the patterns any path fits, so that rules without files plan nothing."""
    found = files.agg(*[F.bool_or(F.col("path").rlike(p)).alias(str(i)) for i, p in enumerate(patterns)]).first()
    return {p for i, p in enumerate(patterns) if found[i]}


def other_facts(files: DataFrame, docs: DataFrame) -> DataFrame:
    """Facts of TypeScript, GraphQL, Dockerfile, Makefile, dotenv and Terraform files (path, text), and of the documents of configuration files: operations of OpenAPI, items of YAML, the keys of a project."""
    plain = docs.filter(~F.col("path").endswith(".toml"))
    out = _facts(pyproject_facts(docs), "PyprojectExtractor").unionByName(openapi_facts(plain)).unionByName(yaml_facts(plain))
    there = _present(files, list(RULES))
    for pattern, rule in RULES.items():
        if pattern in there:
            out = out.unionByName(rule(files.filter(F.col("path").rlike(pattern))))
    return out


def other_claims(files: DataFrame, params_of: Callable[[Column], Column]) -> DataFrame:
    """Claims of JSDoc blocks and of reStructuredText."""
    script, document = r"\.[jt]sx?$", r"\.rst$"
    there = _present(files, [script, document])
    told = jsdoc(files.filter(F.col("path").rlike(script)))
    if document in there:
        told = told.unionByName(rst(files.filter(F.col("path").rlike(document)), params_of))
    return told.select("raw_text", "kind", F.col("path").alias("doc_file"), F.col("line").alias("line_number"), "name", "parameters", "return_type", "metadata", "rule")
