"""Rules over texts that differ from row to row, and what SQL says they must find.

Each order is a file whose parts are its line items: their forms - nested types, comments
and strings with brackets, separators, signatures over lines, fences that stay open - follow
from columns, so that SQL derives what is to be found from the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import keep
from ..operators import lines as L
from ..operators import other_docs as D
from ..operators.jsdoc import jsdoc
from ..operators.python_facts import django_urls
from ..operators.rst import rst
from ..sources.config_files import documents, operations, yaml_facts
from ..sources.python_ast import balanced, python_nodes
from .scan import params_of


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, n, q, s, flag: one row for each line of an order.

    They are dealt by the order alone, before they become texts, so that its file is made and
    read where its lines are, and nothing but these five columns is shuffled.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("q"), F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("flag"))
    return dealt(items, "k").groupBy("k", "n").agg(F.max("q").alias("q"), F.max("s").alias("s"), F.max("flag").alias("flag"))


#: Rows that a task makes texts of, about.
SHARE = 200000


def dealt(rows: DataFrame, *by: str, share: int = SHARE) -> DataFrame:
    """The rows over as many tasks as their number asks for, by columns if any are given."""
    n = rows.count()
    return rows.repartition(max(-(-n // share), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // 1000)), 1), *by)


ITEMS = "items AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_quantity::INT) AS q, max(l_suppkey) AS s, max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2)"


def _cat(*parts: Column | str | int) -> Column:
    """Texts and columns, one after the other; ``@name`` is a column."""
    return F.concat(*[F.col(p[1:]).cast("string") if isinstance(p, str) and p.startswith("@") else p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def _files(items: DataFrame, line: Column, ending: str, before: Column, after: Column) -> DataFrame:
    """A file for each k: what stands before, the lines of its items in order, what stands after."""
    lines = items.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("text")))), lambda x: x["text"]), "").alias("lines"))
    return lines.select("k", _cat("src/o", "@k", ending).alias("path"), F.concat(before, "lines", after).alias("text"))


def _shown(params: Column | str) -> Column:
    return F.array_join(F.transform(params, lambda p: F.concat_ws("|", p["name"], F.coalesce(p["type_annotation"], F.lit("-")), F.coalesce(p["default"], F.lit("-")))), ";")


# --- TypeScript ------------------------------------------------------------------------------


def _typescript(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("q") % 4 == 0, _cat("{ a: string; b: { c: number } }")).when(F.col("q") % 4 == 1, "Map<string, number[]>").when(F.col("q") % 4 == 2, "(x: number, y: string) => void").otherwise(F.col("flag"))
    note = F.when(F.col("n") % 2 == 0, _cat("  // } ", "@q", " {\n")).when(F.col("n") % 3 == 0, "  /* { lost: string;\n */\n").otherwise("")
    line = _cat(note, "  ", F.when(F.col("s") % 2 == 0, "readonly ").otherwise(""), "p", "@n", F.when(F.col("q") % 3 == 0, "?").otherwise(""), ": ", kind, F.when(F.col("s") % 3 == 0, ";").when(F.col("s") % 3 == 1, ",").otherwise(""), "\n")
    before = _cat("const t = \"interface No { x: string }\";\nexport interface I", "@k", "<T>", F.when(F.col("k") % 2 == 0, _cat(" extends Base", F.col("k") % 7)).otherwise(""), " {\n")
    after = _cat("}\nexport ", F.when(F.col("k") % 3 == 0, "const ").otherwise(""), "enum E", "@k", " { Up, Down = ", F.col("k") % 9, ", Note = \"},{\" }\ntype U", "@k", " = string\n  | number;\n", F.when(F.col("k") % 5 == 0, "interface Open { a: string\n").otherwise(""))
    return _files(_items(spark, sf_dir), line, ".ts", before, after)


def typescript_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations with their lines, and their members; a declaration without members has one row."""
    found = D.typescript(_typescript(spark, sf_dir))
    return found.select("path", "line", "kind", "name", "parent", "is_const", "expression", F.explode_outer("members").alias("m")).select("path", "line", "kind", "name", "parent", "is_const", "expression", F.col("m.name").alias("member"), F.col("m.type").alias("type"), F.col("m.is_optional").alias("is_optional"), F.col("m.is_readonly").alias("is_readonly"))


TYPESCRIPT_SQL = f"""
WITH {ITEMS},
files AS (SELECT k, 'src/o' || k || '.ts' AS path, sum(1 + CASE WHEN n % 2 = 0 THEN 1 WHEN n % 3 = 0 THEN 2 ELSE 0 END)::INT AS height FROM items GROUP BY 1),
shapes AS (
  SELECT k, path, 2 AS line, 'ts_interface' AS kind, 'I' || k AS name, CASE WHEN k % 2 = 0 THEN 'Base' || (k % 7) END AS parent, NULL::BOOLEAN AS is_const, NULL AS expression FROM files
  UNION ALL SELECT k, path, 4 + height, 'ts_enum', 'E' || k, NULL, k % 3 = 0, NULL FROM files
  UNION ALL SELECT k, path, 5 + height, 'ts_type', 'U' || k, NULL, NULL, 'type U' || k || E' = string\\n  | number;' FROM files
  UNION ALL SELECT k, path, 7 + height, 'ts_interface', 'Open', NULL, NULL, NULL FROM files WHERE k % 5 = 0),
members AS (
  SELECT k, 'I' || k AS name, 'p' || n AS member, CASE q % 4 WHEN 0 THEN '{{ a: string; b: {{ c: number }} }}' WHEN 1 THEN 'Map<string, number[]>' WHEN 2 THEN '(x: number, y: string) => void' ELSE flag END AS type, q % 3 = 0 AS is_optional, s % 2 = 0 AS is_readonly FROM items
  UNION ALL SELECT k, 'E' || k, m, t, false, false FROM files, (VALUES ('Up', '0'), ('Down', NULL), ('Note', '"}},{{"')) v(m, t))
SELECT path, line, kind, s.name, parent, is_const, expression, member, CASE WHEN member = 'Down' THEN (s.k % 9)::VARCHAR ELSE type END AS type, is_optional, is_readonly
FROM shapes s LEFT JOIN members m ON m.k = s.k AND m.name = s.name
"""


# --- GraphQL ---------------------------------------------------------------------------------


def _graphql(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    note = F.when(F.col("n") % 2 == 0, _cat("  # { ", "@q", "\n")).when(F.col("n") % 3 == 0, "  \"\"\"Shown {\n  later\"\"\"\n").otherwise("")
    arguments = F.when(F.col("q") % 3 == 0, "").when(F.col("q") % 3 == 1, _cat("(id: ID!, limit: Int = ", "@q", ")")).otherwise("(filter: In = {a: 1, b: [2]},\n      last: Boolean)")
    line = _cat(note, "  f", "@n", arguments, ": ", F.when(F.col("s") % 2 == 0, "[Item!]!").otherwise("Item"), F.when(F.col("s") % 3 == 0, " @deprecated(reason: \"} old\")").otherwise(""), "\n")
    before = _cat("scalar Date\ntype Item { id: ID! }\n", F.when(F.col("k") % 2 == 0, "type Query {\n").otherwise("extend type Mutation @auth {\n"))
    after = _cat("}\ninput In", "@k", " { a: String!, b: [Int] = [", F.col("k") % 9, ", 2]\n  c: Boolean }\nenum S", "@k", " { ON OFF\n  # NO {\n  MID", F.col("k") % 5, " @deprecated }\n")
    return _files(items, line, ".graphql", before, after)


def graphql_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations with their arguments, inputs with their fields, enums with their values."""
    found = D.graphql(_graphql(spark, sf_dir))
    shown = F.array_join(F.transform("members", lambda m: F.concat_ws("|", m["name"], F.coalesce(m["type"], F.lit("-")), F.coalesce(m["default"], F.lit("-")))), ";")
    return found.select("path", "kind", "name", "module", "type", "what", shown.alias("members"))


GRAPHQL_SQL = f"""
WITH {ITEMS}, files AS (SELECT DISTINCT k, 'src/o' || k || '.graphql' AS path FROM items)
SELECT 'src/o' || k || '.graphql' AS path, 'api_endpoint' AS kind, 'f' || n AS name, CASE WHEN k % 2 = 0 THEN 'Query' ELSE 'Mutation' END AS module, CASE WHEN s % 2 = 0 THEN '[Item!]!' ELSE 'Item' END AS type,
       CASE WHEN k % 2 = 0 THEN 'query' ELSE 'mutation' END AS what, CASE q % 3 WHEN 0 THEN '' WHEN 1 THEN 'id|ID|-;limit|Int|' || q ELSE 'filter|In|{{a: 1, b: [2]}};last|Boolean|-' END AS members FROM items
UNION ALL SELECT path, 'class', 'In' || k, '', NULL, 'input', 'a|String|-;b|[Int]|[' || (k % 9) || ', 2];c|Boolean|-' FROM files
UNION ALL SELECT path, 'class', 'S' || k, '', NULL, 'enum', 'ON|-|-;OFF|-|-;MID' || (k % 5) || '|-|-' FROM files
"""


# --- Terraform -------------------------------------------------------------------------------


def _terraform(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = (
        F.when(F.col("q") % 6 == 0, _cat("\"v-${lookup(var.m, \"", "@flag", "\")}-{\"")).when(F.col("q") % 6 == 1, F.col("q").cast("string")).when(F.col("q") % 6 == 2, "true").when(F.col("q") % 6 == 3, _cat("var.x", "@n"))
        .when(F.col("q") % 6 == 4, _cat("{\n    one = ", "@s", " # } no\n    \"two\" : { deep = \"", "@flag", "\", list = [1,\n      2] }\n  }")).otherwise("<<EOT\n{ \"not\": 1 }\nEOT"))
    line = _cat(F.when(F.col("n") % 2 == 0, "  // { note\n").otherwise(""), "  a", "@n", " = ", value, "\n")
    before = _cat("# resource \"no\" \"no\" {\nvariable \"v", "@k", "\" {\n  type = string\n  default = \"d", F.col("k") % 7, "\"\n}\n", "resource \"kind", F.col("k") % 4, "\" \"r", "@k", "\" {\n")
    after = _cat("  disk {\n    size = 1\n  }\n  _own = 1\n}\noutput \"o", "@k", "\" { value = kind.r.id }\ndata \"d", F.col("k") % 3, "\" \"x\" {}\n")
    return _files(_items(spark, sf_dir), line, ".tf", before, after)


def terraform_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, and the attributes of resources by dotted keys."""
    found = D.terraform(_terraform(spark, sf_dir))
    told = lambda key: F.get_json_object("metadata", f"$.{key}")
    return found.select("path", "name", told("attribute").alias("attribute"), F.coalesce(told("value"), told("default")).alias("value"))


TERRAFORM_SQL = f"""
WITH {ITEMS}, files AS (SELECT DISTINCT k, 'src/o' || k || '.tf' AS path, 'kind' || (k % 4) || '.r' || k AS name FROM items),
told AS (
  SELECT k, 'a' || n AS attribute, CASE q % 6 WHEN 0 THEN '"v-${{lookup(var.m, "' || flag || '")}}-{{"' WHEN 1 THEN q::VARCHAR WHEN 2 THEN 'True' WHEN 3 THEN '${{var.x' || n || '}}' ELSE E'<<EOT\\n{{ "not": 1 }}\\nEOT' END AS value FROM items WHERE q % 6 <> 4
  UNION ALL SELECT k, 'a' || n || '.one', s::VARCHAR FROM items WHERE q % 6 = 4
  UNION ALL SELECT k, 'a' || n || '.two.deep', flag FROM items WHERE q % 6 = 4
  UNION ALL SELECT k, 'a' || n || '.two.list', E'[1,\\n      2]' FROM items WHERE q % 6 = 4
  UNION ALL SELECT k, 'disk', E'{{\\n    size = 1\\n  }}' FROM files)
SELECT path, name || '.' || attribute AS name, attribute, value FROM told JOIN files USING (k)
UNION ALL SELECT path, name, NULL, NULL FROM files
UNION ALL SELECT path, 'var.v' || k, NULL, 'd' || (k % 7) FROM files
UNION ALL SELECT path, 'output.o' || k, NULL, '${{kind.r.id}}' FROM files
UNION ALL SELECT path, 'data.d' || (k % 3) || '.x', NULL, NULL FROM files
"""


# --- Markdown fences -------------------------------------------------------------------------


def _fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with two fences: signatures on one line, over lines, cut short at a bracket of a default, several in a fence; every fifth page's last fence stays open."""
    items = _items(spark, sf_dir)
    part = _cat(F.when(F.col("k") % 3 == 0, "\n    ").when(F.col("n") > 1, " ").otherwise(""), "p", "@n", F.when(F.col("q") % 3 == 0, _cat(": ", "@flag")).otherwise(""), F.when(F.col("q") % 2 == 0, _cat(" = ", "@q")).otherwise(""), ",")
    before = _cat("# Page\n", F.when(F.col("k") % 4 == 0, "<!-- docs:ignore -->\n").otherwise(""), "```python\nimport x\ndef f", "@k", "(")
    after = _cat(F.when(F.col("k") % 3 == 0, "\n").otherwise(""), ")", F.when(F.col("k") % 2 == 0, " -> dict[str, int]").otherwise(""), ":\n    def inner(a): pass\n\ndef cut", "@k", "(a, f=(1, 2), b): pass\n```\nText `f`.\n```\ndef last", "@k", "()\n", F.when(F.col("k") % 5 == 0, "").otherwise("```\n"))
    return _files(items, part, ".md", before, after)


def markdown_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of fences with their lines, parameters and what suppresses them."""
    found = L.fenced_signatures(L.lines(_fences(spark, sf_dir)))
    return found.select("path", "line", "name", _shown(params_of(F.col("params"))).alias("parameters"), "return_type", "suppressed")


FENCES_SQL = f"""
WITH {ITEMS},
pages AS (
  SELECT k, 'src/o' || k || '.md' AS path, count(*) AS n, CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END + 4 AS line, CASE WHEN k % 3 = 0 THEN count(*) + 1 ELSE 0 END AS feeds,
         string_agg('p' || n || '|' || CASE WHEN q % 3 = 0 THEN flag ELSE '-' END || '|' || CASE WHEN q % 2 = 0 THEN q::VARCHAR ELSE '-' END, ';' ORDER BY n) AS parameters
  FROM items GROUP BY k)
SELECT path, line::INT AS line, 'f' || k AS name, parameters, CASE WHEN k % 2 = 0 THEN 'dict[str, int]' END AS return_type, k % 4 = 0 AS suppressed FROM pages
UNION ALL SELECT path, (line + feeds + 3)::INT, 'cut' || k, 'a|-|-;f|-|(1, 2', NULL, k % 4 = 0 FROM pages
UNION ALL SELECT path, (line + feeds + 7)::INT, 'last' || k, '', NULL, false FROM pages WHERE k % 5 <> 0
"""


# --- included URLs ---------------------------------------------------------------------------


def _url_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as a module: its own page, and the lists of customers 3 k and 3 k + 1; every seventh also that of k / 3, which is a cycle."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))
    text = _cat(
        "from django.urls import include, path\nurlpatterns = [\n    path(\"u", "@k", "/<int:pk>/\", views.show, name=\"u", "@k", "\"),\n    path(\"n", "@nation", "/\", include(\"app.m", F.col("k") * 3, ".urls\")),\n    include(\"app.m", F.col("k") * 3 + 1, ".urls\"),\n",
        F.when(F.col("k") % 7 == 0, _cat("    path(\"up/\", include((\"app.m", F.floor(F.col("k") / 3), ".urls\", \"up\"))),\n")).otherwise(""), "    path(\"in/\", include([path(\"<slug:x>/\", views.X.as_view())])),\n]\n")
    return c.select(_cat("site/app/m", "@k", F.when(F.col("k") % 2 == 0, "/urls.py").otherwise("/urls/__init__.py")).alias("path"), text.alias("text"))


def url_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints of every module and of all that it includes."""
    nodes = keep(python_nodes(balanced(_url_modules(spark, sf_dir))), "query-nodes")
    found = django_urls(nodes)
    told = lambda key: F.get_json_object("metadata", f"$.{key}")
    return found.select("name", F.col("line_number").alias("line"), told("view_name").alias("view_name"), told("view_function").alias("view_function"), F.array_join(F.transform("parameters", lambda p: p["name"]), ";").alias("parameters"))


URLS_SQL = """
WITH RECURSIVE mods AS (SELECT c_custkey AS k, c_nationkey AS nation FROM customer),
steps AS (
  SELECT a.k, b.k AS j, 'n' || a.nation || '/' AS step FROM mods a JOIN mods b ON b.k = 3 * a.k
  UNION ALL SELECT a.k, b.k, '' FROM mods a JOIN mods b ON b.k = 3 * a.k + 1
  UNION ALL SELECT a.k, b.k, 'up/' FROM mods a JOIN mods b ON b.k = a.k // 3 WHERE a.k % 7 = 0),
walk AS (
  SELECT k AS root, k, '' AS before, [k] AS seen FROM mods
  UNION ALL SELECT w.root, s.j, w.before || s.step, list_append(w.seen, s.j) FROM walk w JOIN steps s ON s.k = w.k WHERE NOT list_contains(w.seen, s.j)),
own AS (
  SELECT k, 3 AS line, 'u' || k || '/<int:pk>/' AS route, 'u' || k AS view_name, 'views.show' AS view_function, 'pk' AS parameters FROM mods
  UNION ALL SELECT k, 4, 'n' || nation || '/', NULL, NULL, '' FROM mods
  UNION ALL SELECT k, 6, 'up/', NULL, NULL, '' FROM mods WHERE k % 7 = 0
  UNION ALL SELECT k, CASE WHEN k % 7 = 0 THEN 7 ELSE 6 END, 'in/', NULL, NULL, '' FROM mods
  UNION ALL SELECT k, CASE WHEN k % 7 = 0 THEN 7 ELSE 6 END, 'in/<slug:x>/', NULL, NULL, 'x' FROM mods)
SELECT 'GET ' || before || route AS name, line, view_name, view_function, parameters FROM walk JOIN own USING (k)
"""


# --- reStructuredText ------------------------------------------------------------------------


def _rst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class with a method for each line of the order: fields of one or two lines, an inner note, code and literal blocks, roles."""
    method = _cat(
        "\n   .. py:method:: C", "@k", ".m", "@n", "(a", F.when(F.col("q") % 2 == 0, _cat(", b: int = ", "@q")).otherwise(""), ")", F.when(F.col("q") % 3 == 0, " -> str").otherwise(""), "\n\n      :param a: first",
        F.when(F.col("s") % 2 == 0, _cat("\n         and ", "@s")).otherwise(""), "\n      :type a: ", "@flag", "\n", F.when(F.col("q") % 2 == 0, "      .. note::\n\n         :param b: inner\n").otherwise(""), F.when(F.col("s") % 3 == 0, _cat("      :returns: r", "@q", "\n")).otherwise(""))
    before = _cat("Title\n=====\n\n:param lost: no owner\n\n.. py:class:: C", "@k", "\n   :module: x\n")
    after = _cat(
        "\nExample::\n\n    # note(1)\n    x = 1\n\n    run", F.col("k") % 5, "(2)\n\nout(4)\n\n.. code-block:: python\n\n   def f", F.col("k") % 3, "(a):\n       g(b)\n\nSee :func:`~a.b.C", "@k", "` and :mod:`a.b`.\n\n.. automodule:: pkg.m", "@k", "\n   :members:\n\n   alpha\n   beta", F.col("k") % 2, "\n")
    return _files(_items(spark, sf_dir), method, ".rst", before, after)


def rst_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directives and the fields that they own, blocks, references, modules."""
    found = rst(_rst(spark, sf_dir), params_of)
    told = lambda key: F.get_json_object("metadata", f"$.{key}")
    return found.select("path", "kind", "name", _shown("parameters").alias("parameters"), "return_type", told("description").alias("description"), told("directive").alias("directive"), F.coalesce(told("source"), F.lit("")).alias("source"))


RST_SQL = f"""
WITH {ITEMS}, files AS (SELECT DISTINCT k, 'src/o' || k || '.rst' AS path FROM items), methods AS (SELECT *, 'src/o' || k || '.rst' AS path, 'C' || k || '.m' || n AS name FROM items)
SELECT path, 'function_signature' AS kind, 'C' || k AS name, '' AS parameters, NULL AS return_type, NULL AS description, NULL AS directive, '' AS source FROM files
UNION ALL SELECT path, 'function_signature', name, 'a|-|-' || CASE WHEN q % 2 = 0 THEN ';b|int|' || q ELSE '' END, CASE WHEN q % 3 = 0 THEN 'str' END, NULL, NULL, '' FROM methods
UNION ALL SELECT path, 'parameter_description', 'a', 'a|' || flag || CASE WHEN q % 2 = 0 THEN E'\\n.. note::' ELSE '' END || '|-', NULL, 'first' || CASE WHEN s % 2 = 0 THEN E'\\nand ' || s ELSE '' END, name, '' FROM methods
UNION ALL SELECT path, 'parameter_description', 'b', 'b|-|-', NULL, 'inner', name, '' FROM methods WHERE q % 2 = 0
UNION ALL SELECT path, 'return_description', name, '', NULL, 'r' || q, name, '' FROM methods WHERE s % 3 = 0
UNION ALL SELECT path, 'code_example', 'run' || (k % 5), '', NULL, NULL, NULL, 'literal-block' FROM files
UNION ALL SELECT path, 'code_example', 'f' || (k % 3), '', NULL, NULL, NULL, 'code-block' FROM files
UNION ALL SELECT path, 'function_ref', 'C' || k, '', NULL, NULL, NULL, 'cross_ref' FROM files
UNION ALL SELECT path, 'function_ref', 'a.b', '', NULL, NULL, NULL, 'cross_ref' FROM files
UNION ALL SELECT path, 'function_ref', unnest(['pkg.m' || k, 'alpha', 'beta' || (k % 2)]), '', NULL, NULL, NULL, 'automodule' FROM files
"""


# --- JSDoc -----------------------------------------------------------------------------------


def _jsdoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of several forms, with blocks right before them, too far away, without tags, or without a block."""
    block = F.when(F.col("q") % 4 == 0, _cat("/**\n * @param {", "@flag", "} a - first\n * @returns {void} none\n */\n")).when(F.col("q") % 4 == 1, _cat("/** Bare ", "@q", ". */\n")).when(F.col("q") % 4 == 2, _cat("/** far */\n// ", "@s", " stands between them\n")).otherwise("")
    form = F.when(F.col("s") % 3 == 0, _cat("const f", "@n", " = (a, b: T = ", "@s", ") => a;\n")).when(F.col("s") % 3 == 1, _cat("async function f", "@n", "(a) { }\n")).otherwise(_cat("const f", "@n", " = function(a) { };\n"))
    return _files(_items(spark, sf_dir), _cat(block, F.when(F.col("n") % 2 == 0, "export ").otherwise(""), form, "\n"), ".js", F.lit("// start\n"), F.lit(""))


def jsdoc_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which block each function has, and what its tags claim."""
    found = jsdoc(_jsdoc(spark, sf_dir))
    told = lambda key: F.get_json_object("metadata", f"$.{key}")
    return found.select("path", "line", "kind", "name", "raw_text", _shown("parameters").alias("parameters"), "return_type", told("category").alias("category"), told("description").alias("description"))


JSDOC_SQL = f"""
WITH {ITEMS},
texts AS (
  SELECT *, CASE q % 4 WHEN 0 THEN '/**' || chr(10) || ' * @param {{' || flag || '}} a - first' || chr(10) || ' * @returns {{void}} none' || chr(10) || ' */' WHEN 1 THEN '/** Bare ' || q || '. */' WHEN 2 THEN '/** far */' END AS block,
         CASE q % 4 WHEN 2 THEN chr(10) || '// ' || s || ' stands between them' || chr(10) WHEN 3 THEN '' ELSE chr(10) END || CASE WHEN n % 2 = 0 THEN 'export ' ELSE '' END AS gap,
         CASE s % 3 WHEN 0 THEN 'const f' || n || ' = (a, b: T = ' || s || ') => a;' WHEN 1 THEN 'async function f' || n || '(a) {{ }}' ELSE 'const f' || n || ' = function(a) {{ }};' END || chr(10) || chr(10) AS form
  FROM items),
placed AS (
  SELECT *, 9 + coalesce(sum(length(coalesce(block, '') || gap || form)) OVER w, 0) AS begins, 2 + coalesce(sum(length(coalesce(block, '') || gap || form) - length(replace(coalesce(block, '') || gap || form, chr(10), ''))) OVER w, 0) AS line FROM texts
  WINDOW w AS (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
blocks AS (SELECT k, n, block, line, begins + length(block) AS stop FROM placed WHERE block IS NOT NULL),
starts AS (
  SELECT k, n, q, s, flag, 'f' || n AS name, begins + length(coalesce(block, '') || gap) AS place, line + length(coalesce(block, '') || gap) - length(replace(coalesce(block, '') || gap, chr(10), '')) AS own_line, n % 2 = 0 AS exported FROM placed
  UNION ALL SELECT k, n, q, s, flag, CASE s % 3 WHEN 1 THEN 'f' || n ELSE 'function' END, begins + length(coalesce(block, '') || gap) + CASE s % 3 WHEN 1 THEN 15 ELSE 10 + length('' || n) END, 0, false FROM placed WHERE s % 3 <> 0),
near AS (SELECT a.*, b.block, b.line, b.stop FROM starts a ASOF LEFT JOIN blocks b ON a.k = b.k AND a.place >= b.stop - 1),
met AS (SELECT *, 'src/o' || k || '.js' AS path, block IS NOT NULL AND place - (stop - 1) <= 15 AS has, 'a|-|-' || CASE WHEN s % 3 = 0 THEN ';b|T|' || s ELSE '' END AS params FROM near)
SELECT path, line::INT AS line, 'parameter_description' AS kind, name, '@param ' || flag || ' a - first' AS raw_text, 'a|-|-' AS parameters, NULL AS return_type, NULL AS category, 'first' AS description FROM met WHERE has AND block LIKE '%@param%'
UNION ALL SELECT path, line::INT, 'return_description', name, '@returns {{void}} none', '', 'void', NULL, 'none' FROM met WHERE has AND block LIKE '%@param%'
UNION ALL SELECT path, line::INT, 'function_signature', name, trim(block[4:-3]), params, NULL, 'docstring', trim(block[4:-3]) FROM met WHERE has AND block NOT LIKE '%@param%'
UNION ALL SELECT path, own_line::INT, 'function_signature', name, '', params, NULL, 'no_jsdoc', NULL FROM met WHERE NOT coalesce(has, false) AND exported
"""


# --- OpenAPI and YAML ------------------------------------------------------------------------


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifications with a path for each line of the order, parameters of the path and of its operations; every fifth file does not parse."""
    path = _cat("  /p", "@n", "/{id}:\n", F.when(F.col("q") % 2 == 0, _cat("    parameters:\n      - {name: id, in: path, required: true, schema: {type: integer}}\n")).otherwise(""), F.when(F.col("s") % 2 == 0, "    get").otherwise("    post"), ":\n      operationId: op", "@q", "\n",
                F.when(F.col("q") % 3 == 0, _cat("      summary: \"s: ", "@flag", "\"\n      parameters: [{name: q, in: query, description: d", "@s", "}]\n")).otherwise(""), "    x-note: {get: {a: 1}}\n")
    before = F.when(F.col("k") % 2 == 0, _cat("openapi: 3.0.", F.col("k") % 4, "\nservers: [{url: \"https://h", F.col("k") % 3, "/v1/\"}]\npaths:\n")).otherwise(_cat("swagger: '2.0'\nbasePath: /b", F.col("k") % 3, "/\npaths:\n"))
    return _files(_items(spark, sf_dir), path, ".yaml", before, F.when(F.col("k") % 5 == 0, "bad: [1\n").otherwise(""))


def openapi_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations with what they say and the parameters of their paths and their own."""
    found = operations(documents(_specs(spark, sf_dir), leaves_too=False))
    shown = F.array_join(F.transform("given", lambda p: F.concat_ws("|", p["name"], p["in"], p["description"], p["required"].cast("string"))), ";")
    return found.select("path", "name", "method", "operation_id", "summary", shown.alias("parameters"), F.array_join("path_param_names", ";").alias("path_params"), "openapi_version")


OPENAPI_SQL = f"""
WITH {ITEMS}
SELECT 'src/o' || k || '.yaml' AS path, upper(m) || ' ' || CASE WHEN k % 2 = 0 THEN 'https://h' || (k % 3) || '/v1' ELSE '/b' || (k % 3) END || '/p' || n || '/{{id}}' AS name, upper(m) AS method, 'op' || q AS operation_id, CASE WHEN q % 3 = 0 THEN 's: ' || flag ELSE '' END AS summary,
       concat_ws(';', CASE WHEN q % 2 = 0 THEN 'id|path||true' END, CASE WHEN q % 3 = 0 THEN 'q|query|d' || s || '|false' END) AS parameters, 'id' AS path_params, CASE WHEN k % 2 = 0 THEN '3.0.' || (k % 4) ELSE '2.0' END AS openapi_version
FROM (SELECT *, CASE WHEN s % 2 = 0 THEN 'get' ELSE 'post' END AS m FROM items) WHERE k % 5 <> 0
"""


def yaml_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier as a YAML file of one of four kinds, with lists by number."""
    k = F.col("s_suppkey")
    head = F.when(k % 4 == 0, "services:\n  db: {image: x}\nkind: y\n").when(k % 4 == 1, _cat("stages: [a, ", k, "]\n")).when(k % 4 == 2, "apiVersion: v1\n").otherwise("")
    text = _cat(head, "size: ", "@s_nationkey", "\nnested: {list: [{a: 1.5}, null, [true]]}\n")
    files = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(_cat("conf/", k, ".yml").alias("path"), text.alias("text"))
    told = lambda key: F.get_json_object("metadata", f"$.{key}")
    return yaml_facts(documents(balanced(files))).select(F.col("source_file").alias("path"), "name", told("value").alias("value"), told("value_type").alias("value_type"), told("yaml_kind").alias("yaml_kind"))


YAML_SQL = """
WITH s AS (SELECT *, 'conf/' || s_suppkey || '.yml' AS path, ['docker-compose', 'gitlab-ci', 'kubernetes', 'generic'][s_suppkey % 4 + 1] AS yaml_kind FROM supplier),
own AS (
  SELECT 0 AS r, 'services.db.image' AS name, '''x''' AS value, 'str' AS value_type UNION ALL SELECT 0, 'kind', '''y''', 'str' UNION ALL SELECT 1, 'stages.0', '''a''', 'str' UNION ALL SELECT 2, 'apiVersion', '''v1''', 'str')
SELECT path, name, value, value_type, yaml_kind FROM s JOIN own ON r = s_suppkey % 4
UNION ALL SELECT path, 'stages.1', s_suppkey::VARCHAR, 'int', yaml_kind FROM s WHERE s_suppkey % 4 = 1
UNION ALL SELECT path, 'size', s_nationkey::VARCHAR, 'int', yaml_kind FROM s
UNION ALL SELECT path, n, v, t, yaml_kind FROM s, (VALUES ('nested.list.0.a', '1.5', 'float'), ('nested.list.1', 'None', 'null'), ('nested.list.2', '[True]', 'list')) x(n, v, t)
"""


NAMES = (typescript_members, graphql_members, terraform_keys, markdown_fences, url_includes, rst_claims, jsdoc_claims, openapi_operations, yaml_items)
SQL = {
    "typescript_members": TYPESCRIPT_SQL, "graphql_members": GRAPHQL_SQL, "terraform_keys": TERRAFORM_SQL, "markdown_fences": FENCES_SQL, "url_includes": URLS_SQL, "rst_claims": RST_SQL, "jsdoc_claims": JSDOC_SQL, "openapi_operations": OPENAPI_SQL,
    "yaml_items": YAML_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in NAMES}
