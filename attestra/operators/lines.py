r"""Facts and claims from line-oriented texts, without Python.

A text becomes rows (path, line, text); rules are regular expressions over lines, and
what depends on earlier lines (fences, comments above) is a window within the file.
Claims have path, line, kind, name and what their rule adds.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The marker of suppressing comments, unless the caller names another.
MARKER = "docs:ignore"
# Fixed value: the tags of shell fences.
SHELL_TAGS = ("bash", "shell", "sh", "zsh", "")


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), text of every line."""
    return files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")


def _in_file() -> Window:
    return Window.partitionBy("path").orderBy("line")


def _is_fence() -> Column:
    return F.ltrim("text").startswith("```")


def fenced(rows: DataFrame, marker: str = MARKER) -> DataFrame:
    """The lines inside fences, with the fence's line, tag, whether it is closed and what suppresses it (null: nothing; empty: everything)."""
    before = _in_file().rowsBetween(Window.unboundedPreceding, 0)
    comment = rf"<!--\s*\Q{marker}\E\s*(\S*?)\s*-->"
    target = F.when(F.col("line") > 1, F.nullif(F.regexp_extract("text", comment, 0), F.lit("")))
    names = F.regexp_extract("text", comment, 1)
    rows = (
        rows.withColumn("fence", _is_fence())
        .withColumn("count", F.sum(F.col("fence").cast("int")).over(before))
        .withColumn("all", F.sum(F.col("fence").cast("int")).over(Window.partitionBy("path")))
        .withColumn("above", F.last(F.when(target.isNotNull(), names), ignorenulls=True).over(_in_file().rowsBetween(-5, -1)))
    )
    start = F.last(F.when(F.col("fence"), F.struct("line", "text", "above")), ignorenulls=True).over(before)
    inside = rows.withColumn("start", start).filter("count % 2 = 1 AND NOT fence")
    tag = F.regexp_extract(F.ltrim("start.text"), r"^```\s*([^\s`]*)", 1)
    return inside.select("path", "line", "text", F.col("start.line").alias("fence_line"), F.lower(tag).alias("tag"), F.col("start.above").alias("suppress"), (F.col("count") < F.col("all")).alias("closed"))


DEF = r"(?dm)^def\s+([a-zA-Z_]\w*)\s*\(([^)]*)\)\s*(?:->\s*([^:\n]+))?\s*:?"


def bodies(rows: DataFrame, marker: str = MARKER) -> DataFrame:
    """path, fence_line, tag, suppress, text: what each fence that is closed holds, as one text; a fence that never closes holds nothing."""
    return fenced(rows, marker).filter("closed").groupBy("path", "fence_line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"), F.first("tag").alias("tag"), F.first("suppress").alias("suppress"))


def occurrences(rows: DataFrame, pattern: str, *keys: str) -> DataFrame:
    """All columns of ``rows`` (unique by the keys), number, own (each match of the pattern in text) and feeds (line feeds before it)."""
    feeds = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("own"), F.split("text", pattern, -1).alias("gap"))
    rows = rows.filter(F.col("text").rlike(pattern)).select("*", F.posexplode(found).alias("number", "o"))
    before = Window.partitionBy(*keys).orderBy("number")
    count = F.sum(feeds(F.col("o.gap"))).over(before.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum(feeds(F.col("o.own"))).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("feeds", count.cast("int")).withColumn("own", F.col("o.own")).drop("o").filter("own IS NOT NULL")


def fenced_signatures(rows: DataFrame, marker: str = MARKER) -> DataFrame:
    """Signatures in fences, over lines: name, params (text up to the first closing parenthesis), return_type (null if none), suppressed, raw_text."""
    found = occurrences(bodies(rows, marker), DEF, "path", "fence_line")
    group = lambda k: F.regexp_extract("own", DEF, k)
    suppressed = F.coalesce((F.col("suppress") == "") | (F.col("suppress") == group(1)), F.lit(False))
    return found.select(
        "path", (F.col("fence_line") + 1 + F.col("feeds")).cast("int").alias("line"), F.lit("function_signature").alias("kind"), group(1).alias("name"), group(2).alias("params"), F.nullif(F.trim(group(3)), F.lit("")).alias("return_type"),
        suppressed.alias("suppressed"), F.col("own").alias("raw_text"))


# --- references: every rule is an array of what it finds in a line ---------------------------

REFERENCE = "array<struct<rule:int,kind:string,name:string,raw_text:string,params:string,default:string,args:string,action:string>>"
FLAG = r"(?<![\w-])(--[A-Za-z][\w-]*|-[A-Za-z])(?![\w-])((?:[=:][^`\s]*)?)"


def _found(rule: int, kind: str, name: Column, raw: Column | None = None, params: Column | None = None, default: Column | None = None, args: Column | None = None, action: Column | None = None) -> Column:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    return F.struct(
        F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), name.alias("name"), (name if raw is None else raw).alias("raw_text"),
        text(params).alias("params"), text(default).alias("default"), text(args).alias("args"), text(action).alias("action"))


def _filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _inline() -> Column:
    """What stands in backticks: an identifier, or one with arguments; fences are read like any other line."""
    call, name = r"^([a-zA-Z_][a-zA-Z0-9_]*)\s*\((.*)\)$", r"^[a-zA-Z_][a-zA-Z0-9_]*$"
    texts = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(r"`([^`]+)`"), F.lit(1))), lambda t: (F.length(t) >= 2) & (t.rlike(call) | t.rlike(name)))
    return F.transform(texts, lambda t: _found(1, "code_example", F.regexp_extract(t, r"^(\w+)", 1), t, F.when(t.rlike(call), F.regexp_extract(t, call, 2))))


# Subcommands that tell a command without a prompt.
SUBCOMMANDS = ("scan", "run", "exec", "check", "version", "help")


def _usages() -> Column:
    """A command after a prompt, or with a usual subcommand, at the start of a line."""
    line = F.trim("text")
    prompted = line.rlike(r"^\$\s")
    rest = F.when(prompted, F.ltrim(F.regexp_replace(line, r"^\$\s+", ""))).otherwise(line)
    command = F.regexp_extract(rest, r"^([A-Za-z_][\w-]*)", 1)
    after = lambda text, word: F.regexp_replace(F.substr(text, F.length(word) + 1), r"^\s+", "")
    tail = after(rest, command)
    spaced = F.substr(rest, F.length(command) + 1, F.lit(1)).rlike(r"\s")
    action = F.when(~prompted & spaced, functools.reduce(lambda w, a: w.when(tail.startswith(a), a), SUBCOMMANDS, F))
    found = F.array(_found(2, "cli_usage", command, line, args=F.when(prompted, tail).otherwise(after(tail, action)), action=action))
    return F.when((command != "") & (prompted | action.isNotNull()), found).otherwise(F.array().cast(REFERENCE))


def _flags() -> Column:
    """Flags on prompt lines and in shell fences, the first of a name, with what follows an equals sign or a colon."""
    told = F.regexp_extract_all("text", F.lit(FLAG), F.lit(0))
    found = F.transform(told, lambda t: _found(3, "cli_flag_ref", F.regexp_extract(t, r"^(-{1,2}[\w-]+)", 1), default=F.trim(_filled(F.regexp_extract(t, r"^[\w-]+[=:](.*)$", 1)), F.lit("\"'"))))
    return F.when(F.col("in_shell"), _first_of(found)).otherwise(F.array().cast(REFERENCE))


def _first_of(found: Column) -> Column:
    """The first entry of each name."""
    names = F.transform(found, lambda x: x["name"])
    return F.filter(found, lambda x, i: F.array_position(names, x["name"]) == i + 1)


def _variables() -> Column:
    """``$VAR``, ``${VAR}`` and upper-case names in backticks."""
    dollar = F.regexp_extract_all("text", F.lit(r"\$\{?((?<=\{)[A-Z_][A-Z0-9_]*(?=\})|(?<!\{)[A-Z_][A-Z0-9_]*)"), F.lit(1))
    ticked = F.regexp_extract_all("text", F.lit(r"`([A-Z_][A-Z0-9_]*)`"), F.lit(1))
    return F.transform(F.array_distinct(F.concat(dollar, ticked)), lambda n: _found(4, "config_ref", n))


def _table_flags() -> Column:
    """Flags in the cells of a table, by commas; their default may stand behind an equals sign or in the column that the document's first table row calls so."""
    usual = F.filter(F.transform("header", lambda h, i: F.when(F.lower(h).contains("default") | F.lower(h).contains("dflt"), i)), lambda i: i.isNotNull())

    def of(cell: Column, own: Column) -> Column:
        elsewhere = F.get(F.filter(F.transform(usual, lambda i: F.when(i != own, _filled(F.get("cells", i)))), lambda d: d.isNotNull() & ~d.startswith("-")), F.lit(0))
        sides = F.transform(F.split(cell, ","), lambda p: F.transform(F.split(p, "=", 2), lambda x: F.trim(x)))
        flags = F.filter(sides, lambda x: x[0].rlike(r"^-[-\w]+$") & ((F.size(x) == 1) | F.get(x, F.lit(1)).rlike(r"^\S+$")))
        return F.transform(flags, lambda x: _found(5, "cli_flag_ref", x[0], default=F.coalesce(F.get(x, F.lit(1)), elsewhere)))

    found = F.flatten(F.transform("cells", lambda c, i: F.when(c.startswith("-"), of(c, i)).otherwise(F.array().cast(REFERENCE))))
    return F.when(F.col("is_row") & (F.col("line") > F.col("header_line")), _first_of(found)).otherwise(F.array().cast(REFERENCE))


def _at(header: Column, words: tuple[str, ...]) -> Column:
    """The first column whose heading holds one of the words."""
    hits = F.transform(header, lambda h, i: F.when(F.lower(h).rlike("|".join(words)), i))
    return F.get(F.filter(hits, lambda i: i.isNotNull()), F.lit(0))


# Words in the headings of columns with names and with defaults.
NAMED, DEFAULTED = ("variable", "env", "name", "key"), ("default", "dflt", "value")


def _table_variables() -> Column:
    """Names in the name column of a table whose heading has one: upper-case ones and dotted keys."""
    name = F.get("cells", _at(F.col("heading"), NAMED))
    told = ~name.startswith("-") & (name.rlike(r"^[A-Z_][A-Z0-9_]+$") | name.rlike(r"(?i)^[a-z_][a-z0-9_]*(\.[a-z_][a-z0-9_]*)+$"))
    default = _filled(F.get("cells", _at(F.col("heading"), DEFAULTED)))
    row = (F.col("line") > F.col("heading_line")) & ~F.trim("text").rlike(r"^\|[-:|\s]+\|$")
    return F.when(row & told, F.array(_found(6, "config_ref", name, default=default))).otherwise(F.array().cast(REFERENCE))


def _marked(rows: DataFrame) -> DataFrame:
    """The lines with what earlier lines of the file mean for them.

    Only shell fences (by tag, or without one) toggle ``in_shell``, so that the closing
    fence of another language's block opens it; documents rely on this.
    """
    so_far = _in_file().rowsBetween(Window.unboundedPreceding, 0)
    tag = F.lower(F.regexp_extract(F.ltrim("text"), r"^```\s*([^\s`]*)", 1))
    toggles = _is_fence() & tag.isin(*SHELL_TAGS)
    line = F.trim("text")
    parts = F.split(line, r"\|")
    cells = F.when(line.startswith("|"), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda c: F.trim(c))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("cells", cells).withColumn("is_row", (F.size("cells") > 0) & ~line.rlike(r"^\|[\s|-]+\|[\s|-]+\|$"))
    rows = rows.withColumn("state", F.sum(toggles.cast("int")).over(so_far)).withColumn("table", F.sum((~line.startswith("|")).cast("int")).over(so_far))
    rows = rows.withColumn("in_shell", ~_is_fence() & ((F.col("state") % 2 == 1) | F.col("text").rlike(r"^\s*[$>]")))
    top = F.first(F.when(F.col("is_row"), F.struct("line", "cells")), ignorenulls=True).over(so_far)
    named = (F.size("cells") > 0) & _at(F.col("cells"), NAMED).isNotNull()
    own = F.first(F.when(named, F.struct("line", "cells")), ignorenulls=True).over(Window.partitionBy("path", "table").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("top", top).withColumn("own", own)
    return rows.select("path", "line", "text", "in_shell", "is_row", "cells", F.col("top.line").alias("header_line"), F.col("top.cells").alias("header"), F.col("own.line").alias("heading_line"), F.col("own.cells").alias("heading"))


PLAIN, WINDOWED = {"inline": _inline, "usages": _usages, "variables": _variables}, {"flags": _flags, "table_flags": _table_flags, "table_variables": _table_variables}


def references(rows: DataFrame, *only: str) -> DataFrame:
    """path, line, rule, kind, name, raw_text, params (text; null without arguments), default, args: what the rules named find, or all.

    A configuration name that a line's text holds is not taken from its table cell again.
    """
    chosen = only or (*PLAIN, *WINDOWED)
    rows = _marked(rows) if set(chosen) & set(WINDOWED) else rows
    found = F.concat(*[(PLAIN | WINDOWED)[n]().cast(REFERENCE) for n in chosen])
    rows = rows.select("path", "line", found.alias("found"))
    told = lambda x: F.exists("found", lambda y: (y["rule"] == 4) & (y["name"] == x["name"]))
    return rows.select("path", "line", F.explode(F.filter("found", lambda x: (x["rule"] != 6) | ~told(x))).alias("r")).select("path", "line", "r.*")


def inline_code(rows: DataFrame) -> DataFrame:
    return references(rows, "inline")


def cli_usages(rows: DataFrame) -> DataFrame:
    return references(rows, "usages")


def cli_flags(rows: DataFrame) -> DataFrame:
    return references(rows, "flags", "table_flags")


def variables(rows: DataFrame) -> DataFrame:
    return references(rows, "variables", "table_variables")


# --- build and environment files ----------------------------------------------------------


def _facts(rows: DataFrame, name: Column, value: Column) -> DataFrame:
    return rows.select("path", "line", name.alias("name"), F.nullif(value, F.lit("")).alias("value"))


def continued(files: DataFrame) -> DataFrame:
    """Lines with their continuations joined; the line number is that of the first."""
    rows = files.select("path", F.posexplode(F.split(F.regexp_replace("text", r"\\\r?\n", "\u0001"), "\r?\n")).alias("at", "text"))
    more = F.length("text") - F.length(F.replace("text", F.lit("\u0001"), F.lit("")))
    shift = F.coalesce(F.sum(more).over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("path", (F.col("at") + 1 + shift).alias("line"), F.trim(F.regexp_replace("text", "\u0001", " ")).alias("text"))


def dockerfile(files: DataFrame) -> DataFrame:
    """from.x, env.X, label.k, expose.p, arg.n, entrypoint, cmd, workdir, user, copy, add."""
    word = F.upper(F.regexp_extract("text", r"^([A-Za-z]+)\s", 1))
    rows = continued(files).filter(~F.col("text").startswith("#")).withColumn("word", word).withColumn("rest", F.regexp_extract("text", r"^[A-Za-z]+\s+(.*)$", 1))
    stage, image = F.regexp_extract("rest", r"(?i)\sAS\s+(\S+)", 1), F.regexp_extract("rest", r"^([^\s:]+)", 1)
    base = _facts(rows.filter("word = 'FROM'"), F.concat(F.lit("from."), F.coalesce(F.nullif(stage, F.lit("")), image)), F.regexp_extract("rest", r"^(\S+)", 1))
    pairs = rows.filter("word IN ('ENV', 'LABEL', 'ARG') AND rest LIKE '%=%'").select("path", "line", "word", F.explode(F.regexp_extract_all("rest", F.lit(r"[^\s=]+=(?:\"[^\"]*\"|\S*)"), F.lit(0))).alias("pair"))
    keyed = _facts(pairs, F.concat(F.lower("word"), F.lit("."), F.regexp_extract("pair", r"^([^=]+)=", 1)), F.regexp_replace(F.regexp_extract("pair", r"=(.*)$", 1), '^"|"$', ""))
    plain = rows.filter("word IN ('ENV', 'ARG') AND rest NOT LIKE '%=%'")
    plain = _facts(plain, F.concat(F.lower("word"), F.lit("."), F.regexp_extract("rest", r"^(\S+)", 1)), F.regexp_extract("rest", r"^\S+\s+(.*)$", 1))
    ports = rows.filter("word = 'EXPOSE'").select("path", "line", F.explode(F.regexp_extract_all("rest", F.lit(r"\S+"), F.lit(0))).alias("port"))
    ports = _facts(ports, F.concat(F.lit("expose."), "port"), F.col("port"))
    whole = rows.filter("word IN ('ENTRYPOINT', 'CMD', 'WORKDIR', 'USER', 'COPY', 'ADD')")
    return base.union(keyed).union(plain).union(ports).union(_facts(whole, F.lower("word"), F.col("rest")))


def makefile(files: DataFrame) -> DataFrame:
    """make:target with its prerequisites as value, description and phony; special targets are left out.

    A description is the run of comments right above a target, unless another target or its
    recipe stands right above that; phony targets are those of the file's first such list.
    """
    pattern = r"^([a-zA-Z_-][\w-]*)\s*:(?!=)\s*(.*)$"
    rows = continued_raw(files).withColumn("comment", F.ltrim("text").startswith("#"))
    # a run of comments and the line after it share a number
    run = F.coalesce(F.sum((~F.col("comment")).cast("int")).over(_in_file().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = F.when(F.col("comment"), F.struct("line", F.regexp_replace(F.trim("text"), r"^#+\s*", "").alias("text")))
    runs = rows.withColumn("run", run).groupBy("path", "run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(told)), lambda c: c["text"]), " ").alias("above"), F.max("line").alias("line"), F.max_by("text", "line").alias("text"))
    over = F.lag("text").over(Window.partitionBy("path").orderBy("run"))
    free = over.isNull() | ~(over.rlike(pattern) | over.rlike(r"^(\t|\.PHONY\s*:)"))
    listed = F.first(F.when(F.ltrim("text").startswith(".PHONY:"), F.split(F.trim(F.regexp_replace("text", r"^\s*\.PHONY:", "")), r"\s+")), ignorenulls=True).over(Window.partitionBy("path").orderBy("run").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    runs = runs.withColumn("free", free).withColumn("listed", listed).filter(F.col("text").rlike(pattern))
    target = F.regexp_extract("text", pattern, 1)
    described = F.when(F.col("free") & (F.col("above") != ""), F.col("above")).otherwise(F.concat(F.lit("Makefile target: "), target))
    return runs.select("path", "line", F.concat(F.lit("make:"), target).alias("name"), F.nullif(F.trim(F.regexp_extract("text", pattern, 2)), F.lit("")).alias("value"), described.alias("description"), F.coalesce(F.array_contains("listed", target), F.lit(False)).alias("phony"))


def continued_raw(files: DataFrame) -> DataFrame:
    """Lines as they stand, but for trailing spaces."""
    return lines(files).withColumn("text", F.rtrim("text"))


def dotenv(files: DataFrame) -> DataFrame:
    """KEY=value lines: ``export`` and quotes are taken off, comments after unquoted values too."""
    pattern = r"^(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*)$"
    rows = continued(files).filter(F.col("text").rlike(pattern))
    raw = F.trim(F.regexp_extract("text", pattern, 2))
    value = F.when(raw.rlike(r"^(?:\".*\"|'.*')$"), F.regexp_replace(raw, r"^[\"']|[\"']$", "")).otherwise(F.regexp_replace(raw, r"\s+#.*$", ""))
    return _facts(rows, F.regexp_extract("text", pattern, 1), value)


def markers(files: DataFrame) -> DataFrame:
    """TODO, FIXME and NOTE comments: the example of a plug-in rule."""
    pattern = r"(?://|#)\s*(TODO|FIXME|NOTE)\b:?\s*(.*)$"
    rows = lines(files).filter(F.col("text").rlike(pattern))
    return rows.select("path", "line", F.lit("code_example").alias("kind"), F.concat(F.lit("//"), F.regexp_extract("text", pattern, 1)).alias("name"))
