r"""Facts of TypeScript, GraphQL and Terraform texts: selections over blocks by depth; see blocks.

Types without a block are found by a pattern over the whole file.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B


SHAPE = r"(?:(?:export|declare|default|const)\s+)*(?:interface\s+([\w$]+)(?:\s*<[^{]*?>)?(?:\s+extends\s+([^{]+?))?|enum\s+([\w$]+)|type\s+([\w$]+)(?:\s*<[^=]*>)?\s*=[^;{}]*)\s*\{$"
MEMBER = "struct<name:string,type:string,default:string,is_optional:boolean,is_readonly:boolean>"


def _member(name: Column, type_: Column | None = None, default: Column | None = None, optional: Column | None = None, readonly: Column | None = None) -> Column:
    text = lambda c: (F.lit(None) if c is None else F.nullif(F.trim(c), F.lit(""))).cast("string")
    flag = lambda c: F.lit(False) if c is None else c
    return F.struct(name.alias("name"), text(type_).alias("type"), text(default).alias("default"), flag(optional).alias("is_optional"), flag(readonly).alias("is_readonly"))


def _read(members: Column | str, pattern: str, one: Callable[[Callable[[int], Column]], Column]) -> Column:
    """The members that match a pattern, made by ``one`` of its groups."""
    fit = F.filter(members, lambda m: m["text"].rlike(pattern))
    return F.transform(fit, lambda m: one(lambda k: F.regexp_extract(m["text"], pattern, k))).cast(f"array<{MEMBER}>")


def typescript(files: DataFrame) -> DataFrame:
    """path, line, kind (ts_interface, ts_type, ts_enum), name, members, parent, expression (of a type, its first 50 characters), is_const.

    Members stand directly in the block; the type of a member holds its own members as text.
    Methods and index signatures are no members.
    """
    alias = r"(?m)^[ \t]*((?:(?:export|declare)\s+)*type\s+([\w$]+)(?:\s*<[^=]*>)?\s*=[^;{}]+;)"
    rows = B.declarations(files, "typescript", SHAPE, body=True, plain=alias)
    part = lambda k: F.nullif(F.regexp_extract("head", SHAPE, k), F.lit(""))
    kind = F.when(part(1).isNotNull(), "ts_interface").when(part(3).isNotNull(), "ts_enum").otherwise("ts_type")
    field = r"(?s)^(readonly\s+)?([\w$]+)(\?)?\s*:\s*(.+)$"
    fields = _read("members", field, lambda g: _member(g(2), F.regexp_replace(g(4), r"\s+", " "), None, g(3) != "", g(1) != ""))
    values = F.transform("members", lambda m, i: _member(F.regexp_extract(m["text"], r"^([^=\s]+)", 1), F.coalesce(F.nullif(F.regexp_extract(m["text"], r"(?s)=\s*(.+)$", 1), F.lit("")), i.cast("string")))).cast(f"array<{MEMBER}>")
    whole = F.concat("head", "body", F.lit("};"))
    out = rows.withColumn("kind", kind).select(
        "path", "line", "block", "head", "kind", F.coalesce(part(1), part(3), part(4)).alias("name"), F.when(F.col("kind") == "ts_enum", values).otherwise(fields).alias("members"), F.trim(part(2)).alias("parent"),
        F.when(F.col("kind") == "ts_type", F.substring(F.ltrim(whole), 1, 50)).alias("expression"), F.when(F.col("kind") == "ts_enum", F.col("head").rlike(r"\bconst\s+enum\b")).alias("is_const"))
    # types without a block
    is_plain = F.col("block").isNull()
    own = lambda k: F.nullif(F.regexp_extract("head", alias, k), F.lit(""))
    return out.select(
        "path", "line", F.when(is_plain, "ts_type").otherwise(F.col("kind")).alias("kind"), F.when(is_plain, own(2)).otherwise(F.col("name")).alias("name"), F.when(is_plain, F.array().cast(f"array<{MEMBER}>")).otherwise(F.col("members")).alias("members"),
        F.when(~is_plain, F.col("parent")).alias("parent"), F.when(is_plain, F.substring(own(1), 1, 50)).otherwise(F.col("expression")).alias("expression"), F.when(~is_plain, F.col("is_const")).alias("is_const"))


OPERATIONS = ("Query", "Mutation", "Subscription")


def graphql(files: DataFrame) -> DataFrame:
    """path, line, kind, name, module, type, members, what: a row for each field of the operations, with its arguments; one for each input, with its fields; one for each enum, with its values.  Other types are left out."""
    head = r"(?:extend\s+)?\b(type|input|enum)\s+(\w+)[^{}]*\{$"
    rows = B.declarations(files, "graphql", head).withColumn("what", F.regexp_extract("head", head, 1)).withColumn("owner", F.regexp_extract("head", head, 2))
    described = r'^(?:"""(?s:.*?)"""|"[^"]*")\s*'
    rows = rows.withColumn("members", F.transform("members", lambda m: F.struct(m["line"].alias("line"), F.regexp_replace(m["text"], described, "").alias("text"))))
    rows = rows.withColumn("members", F.filter("members", lambda m: m["text"].rlike(r"^\w")))
    typed = r"(?s)^(\w+)\s*(?:\((.*)\))?\s*:\s*([\[\]\w!\s]+?)\s*(?:=\s*([^@]+?)\s*)?(?:@.*)?$"
    bare = lambda t: F.rtrim(F.regexp_replace(t, r"\s+", ""), F.lit("!"))
    argument = r"(\w+)\s*:\s*([\[\]\w!]+)(?:\s*=\s*(\"[^\"]*\"|\[[^\]]*\]|\{[^}]*\}|[^\s,()]+))?"
    arg = lambda t, k: F.regexp_extract(t, argument, k)
    # a file is read once: what a block tells stands in one array
    row = lambda line, kind, name, module, type_, members, what: F.struct(line.alias("line"), F.lit(kind).alias("kind"), name.alias("name"), module.alias("module"), type_.alias("type"), members.alias("members"), what.alias("what"))
    part = lambda m, k: F.regexp_extract(m["text"], typed, k)
    arguments = lambda m: F.transform(F.regexp_extract_all(part(m, 2), F.lit(argument), F.lit(0)), lambda t: _member(arg(t, 1), bare(arg(t, 2)), arg(t, 3))).cast(f"array<{MEMBER}>")
    operations = F.transform(F.filter("members", lambda m: m["text"].rlike(typed)), lambda m: row(m["line"], "api_endpoint", part(m, 1), F.col("owner"), F.regexp_replace(part(m, 3), r"\s+", ""), arguments(m), F.lower("owner")))
    fields = _read("members", typed, lambda g: _member(g(1), bare(g(3)), g(4)))
    values = F.flatten(F.transform("members", lambda m: F.transform(F.regexp_extract_all(F.regexp_replace(m["text"], r"@\w+(?:\([^)]*\))?", ""), F.lit(r"\w+"), F.lit(0)), lambda v: _member(v)))).cast(f"array<{MEMBER}>")
    owned = F.array(row(F.col("line"), "class", F.col("owner"), F.lit(""), F.lit(None).cast("string"), F.when(F.col("what") == "input", fields).otherwise(values), F.col("what")))
    told = F.when(F.col("what") != "type", owned).when(F.col("owner").isin(*OPERATIONS), operations)
    return rows.select("path", F.explode(told).alias("x")).select("path", "x.*")


def _hcl_value(text: Column) -> Column:
    """A value as text: strings without quotes, true and false with a capital, other expressions in ``${}``; lists and heredocs as they stand; null is none."""
    return (
        F.when(text.rlike(r'(?s)^"[^"]*"$'), F.regexp_extract(text, r'(?s)^"(.*)"$', 1)).when(text == "true", "True").when(text == "false", "False").when(text == "null", F.lit(None).cast("string"))
        .when(text.rlike(r"(?s)^(?:-?\d[\d.eE+-]*$|\[|\{|<<|\")"), text).otherwise(F.concat(F.lit("${"), text, F.lit("}"))))


def terraform(files: DataFrame) -> DataFrame:
    """path, name, metadata (JSON) of variables, outputs, data sources, resources and the resources' attributes, objects in them flattened to dotted keys."""
    head = r'(?:^|[\s}])(variable|output|data|resource)\s+"([^"]+)"(?:\s+"([^"]+)")?\s*\{$'
    blocks = B.declarations(files, "hcl", head, pairs="resource").filter("level = 0 AND closed")
    part = lambda k: F.nullif(F.regexp_extract("head", head, k), F.lit(""))
    kind, first, second = part(1), part(2), part(3)
    own = lambda key: F.get(F.filter(F.transform("members", lambda m: F.when(F.regexp_extract(m["text"], B.ATTRIBUTE, 1) == key, F.regexp_extract(m["text"], B.ATTRIBUTE, 2))), lambda v: v.isNotNull()), F.lit(0))
    blocks = blocks.withColumn("kind", kind).withColumn("first", first).withColumn("second", second)
    value, yes, col = lambda k: _hcl_value(own(k)), F.lit(True), F.col
    told = {
        "resource": [col("first").alias("resource_type"), col("second").alias("resource_name"), yes.alias("is_resource")],
        "variable": [col("first").alias("variable_name"), F.coalesce(F.regexp_replace(own("type"), '"', ""), F.lit("any")).alias("variable_type"), value("default").alias("default"), value("description").alias("description"), yes.alias("is_variable")],
        "output": [col("first").alias("output_name"), value("value").alias("value"), value("description").alias("description"), yes.alias("is_output")],
        "data": [col("first").alias("data_type"), col("second").alias("data_name"), yes.alias("is_data")],
    }
    meta = functools.reduce(lambda w, k: w.when(col("kind") == k, F.to_json(F.struct(*told[k]))), told, F)
    prefix = F.when(col("kind") == "variable", "var").when(col("kind") == "resource", F.lit(None)).otherwise(col("kind"))
    # a block and its attributes are told where they stand, so that a file is read once
    whole = F.struct(F.concat_ws(".", prefix, "first", "second").alias("name"), meta.alias("metadata"))
    told_ = lambda p: F.struct(F.concat_ws(".", "first", "second", p["key"]).alias("name"), F.to_json(F.struct(col("first").alias("resource_type"), col("second").alias("resource_name"), p["key"].alias("attribute"), _hcl_value(p["value"]).alias("value"))).alias("metadata"))
    attributes = F.transform(F.filter("pairs", lambda p: (p["key"] != "") & ~p["key"].startswith("_")), told_)
    return blocks.select("path", F.explode(F.concat(F.array(whole), attributes)).alias("x")).select("path", "x.name", "x.metadata")
