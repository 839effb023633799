"""The same queries as SQL."""

from __future__ import annotations

from . import text_queries
from .queries import EVENTS, SPLIT, VIEWS

_PAGES = "(SELECT k, name, ret FROM facts) p"
_WITH = "WITH" + VIEWS
_EV = "WITH" + EVENTS
_FRESH = f"SELECT * FROM ev WHERE ts >= '{SPLIT}'"
_OLD = f"SELECT * FROM ev WHERE ts < '{SPLIT}'"


def _anti(a: str, b: str) -> str:
    return f"""{_EV}, a AS ({a}), b AS ({b})
SELECT seq, fact_name, claim_name, category FROM a WHERE NOT EXISTS (
  SELECT 1 FROM b WHERE b.fact_name IS NOT DISTINCT FROM a.fact_name AND b.claim_name IS NOT DISTINCT FROM a.claim_name AND b.category IS NOT DISTINCT FROM a.category)"""


_PARAMS = """(SELECT k, string_agg(pname || ': ' || t || CASE WHEN coalesce(d, '') <> '' THEN ' = ' || d ELSE '' END, ', ' ORDER BY pname) AS params FROM fp GROUP BY k)"""


def _rounded(x: str, digits: int) -> str:
    """A number as Python rounds it: as an integer over a power of two, halves to even."""
    bits = f"(60 - ceil(log2(greatest({x}, 1e-6))))"
    n, unit = f"((({x}) * pow(2.0, {bits}))::HUGEINT * {10**digits})", f"(pow(2.0, {bits})::HUGEINT)"
    rest = f"(2 * ({n} % {unit}))"
    return f"""(CASE WHEN {x} <= 1e-6 THEN 0.0::DOUBLE ELSE ({n} // {unit} + CASE WHEN {rest} > {unit} OR ({rest} = {unit} AND ({n} // {unit}) % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / {10**digits}::DOUBLE END)"""


def _per_part(columns: str, rows: list[tuple]) -> str:
    """Rows for each part; <k> stands for its key, <s> for its size."""
    def value(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, int):
            return f"{x}::INT"
        quoted = str(x).replace("'", "''")
        return f"replace(replace('{quoted}', '<k>', p_partkey::VARCHAR), '<s>', p_size::VARCHAR)"

    return f"SELECT v.* FROM part, LATERAL (VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) v({columns})"


# What each rule is to find in the module of a part: line, name, parameters (name|type|default|kind), return type, metadata.
IN_MODULE = {
    "facts_of_definitions": [
        ("function", 7, "load_<k>", "path|str|-|positional;size|int|<s>|positional;rest|-|-|varargs", "bool", "{}"), ("class", 18, "Part<k>", "", None, "{}"), ("method", 23, "Part<k>.grow", "self|-|-|positional;by|-|-|positional", None, "{}"),
        ("function", 29, "view_<k>", "", None, "{}"), ("class", 31, "Settings<k>", "", None, "{}"), ("class", 34, "Row<k>", "", None, "{}"), ("function", 40, "old_<k>", "", None, "{}"), ("function", 43, "cli_<k>", "level|-|-|positional", None, "{}"),
        ("class", 45, "Closes<k>", "", None, "{}"), ("method", 46, "Closes<k>.close", "self|-|-|positional", "None", "{}"), ("function", 50, "item_<k>", "item_id|int|-|positional;q|str|'a'|positional", "dict", "{}"), ("function", 54, "page_<k>", "", None, "{}"),
        ("function", 59, "run_<k>", "size|int|typer.Option(<s>, '--size-<k>', '-s', help='how')|positional;name|str|typer.Argument(...)|positional", None, "{}")],
    "facts_of_argparse": [
        ("cli_flag", 4, "--opt-<k>", "", None, '{"short_flag":"-o","action":"store_true","required":false,"help_text":"size <s>","is_flag":true}'),
        ("cli_flag", 5, "file_<k>", "file_<k>|int|<s>|positional", None, '{"required":false,"is_flag":false}')],
    "facts_of_click": [("cli_flag", 43, "--level-<k>", "", None, '{"short_flag":"-l","is_flag":false,"required":true,"help_text":"x","multiple":false}')],
    "facts_of_typer": [
        ("cli_flag", 59, "--name", "", None, '{"is_flag":false,"required":true,"python_name":"name"}'),
        ("cli_flag", 59, "--size-<k>", "", None, '{"is_flag":true,"help_text":"how","required":false,"python_name":"size","short_flag":"-s"}')],
    "facts_of_dataclasses": [
        ("config_key", 19, "Part<k>.name", "", None, '{"class_name":"Part<k>","field_name":"name","field_type":"str"}'),
        ("config_key", 20, "Part<k>.size", "", None, '{"class_name":"Part<k>","field_name":"size","field_type":"int","default":"<s>"}')],
    "facts_of_decorators": [
        ("decorator", line, path, "", None, f'{{"decorator_name":"{path.split(".")[-1]}","decorator_path":"{path}","decorated_function":"{of}","is_async":false,{args}"category":"{category}"{framework}}}')
        for line, path, of, args, category, framework in (
            (25, "app.route", "view_<k>", '"arguments":{"methods":"[\'GET\', \'POST\']"},', "routing", ',"framework":"Flask"'), (26, "login_required", "view_<k>", "", "auth", ',"framework":"common"'),
            (27, "tools.cached", "view_<k>", '"arguments":{"size":"<s>"},', "caching", ',"framework":"common"'), (28, "own", "view_<k>", "", "custom", ""),
            (39, "deprecated", "old_<k>", '"arguments":{"version":"\'<s>\'"},', "deprecation", ',"framework":"common"'), (42, "click.option", "cli_<k>", '"arguments":{"required":"True","help":"\'x\'"},', "custom", ""),
            (49, "router.get", "item_<k>", '"arguments":{"status_code":"201"},', "custom", ""), (53, "pages.route", "page_<k>", "", "routing", ',"framework":"Flask"'), (58, "app.command", "run_<k>", "", "custom", ""))],
    "facts_of_deprecation": [("deprecated", 40, "m<k>.old_<k>", "", None, '{"deprecation_type":"decorator","version":"<s>","reason":"use load_<k>"}')],
    "facts_of_environment": [
        ("config_key", 2, "MODE_<k>", "", None, '{"env_var":"MODE_<k>","required":true,"source":"os.environ"}'),
        ("config_key", 3, "PORT_<k>", "", None, '{"env_var":"PORT_<k>","required":false,"default":"\'<s>\'","source":"os.getenv"}')],
    "facts_of_settings": [("config_key", 32, "Settings<k>.debug", "", None, '{"env_var":"DEBUG_<k>","description":"d","field_type":"bool","class_name":"Settings<k>","field_name":"debug","default":"False"}')],
    "facts_of_fastapi": [("api_endpoint", 50, "GET /api<s>/items/{item_id}", "item_id|int|-|path;q|str|'a'|query", "dict", '{"methods":["GET"],"endpoint":"/api<s>/items/{item_id}","router":"router","status_code":"201","function_name":"item_<k>"}')],
    "facts_of_flask": [
        *[("api_endpoint", 29, f"{verb} /parts/<k>", "", None, f'{{"methods":["{verb}"],"endpoint":"/parts/<k>","function_name":"view_<k>"}}') for verb in ("GET", "POST")],
        ("api_endpoint", 50, "GET /items/{item_id}", "", None, '{"methods":["GET"],"endpoint":"/items/{item_id}","function_name":"item_<k>"}'),
        ("api_endpoint", 54, "GET /p<s>/x<k>", "", None, '{"methods":["GET"],"endpoint":"/p<s>/x<k>","blueprint":"pages","function_name":"page_<k>"}')],
    "facts_of_django": [
        ("api_endpoint", 56, "GET users/<int:pk>/<k>", "pk|-|-|path", None, '{"view_name":"user-<k>","view_function":"views.user_<k>","parameters":[{"name":"pk","kind":"path"}]}'), ("api_endpoint", 56, "GET more/", "", None, '{"parameters":[]}')],
    "facts_of_tables": [
        ("table_schema", 36, "rows_<k>.id", "", None, '{"table":"rows_<k>","column_type":"Integer","nullable":true,"primary_key":true,"index":false,"is_relationship":false}'),
        ("table_schema", 37, "rows_<k>.other", "", None, '{"table":"rows_<k>","column_type":"Integer","nullable":false,"primary_key":false,"index":false,"foreign_key":"others.id","is_relationship":false}')],
    "facts_of_protocols": [("function", 46, "Closes<k>.close", "self|-|-|positional", "None", '{"method_category":"protocol","is_runtime_checkable":false}')],
}
SOURCES = {"facts_of_django": "<django_urls>", "facts_of_tables": "<sqlalchemy>"}


def sql() -> dict[str, str]:
    modules = {
        name: _per_part("source_file, kind, line_number, name, parameters, return_type, metadata", [(SOURCES.get(name, "src/m<k>.py"), *r) for r in rows]) for name, rows in IN_MODULE.items()
    }
    return modules | text_queries.SQL | {
        "parameter_diff": _WITH + "SELECT ck, fname, subject, category, severity FROM found",
        "category_histogram": _WITH + "SELECT category, count(*)::BIGINT AS n FROM found GROUP BY category",
        "claim_lookup": _WITH + "SELECT h.ck, h.cname, h.fk, c.ck IS NOT NULL AS compare FROM hits h LEFT JOIN compared c ON c.ck = h.ck",
        "last_fact_wins": "SELECT p_name AS name, max(p_partkey) AS seq, arg_max(p_size, p_partkey) AS size FROM part GROUP BY p_name",
        "only_fact_of_segment": "SELECT (c_custkey % 1400)::VARCHAR AS segment, min(c_custkey) AS seq FROM customer GROUP BY 1 HAVING count(*) = 1",
        "undocumented_facts": _WITH + """SELECT k, name, CASE WHEN kind = 'cli_flag' THEN 'error' ELSE 'warning' END AS severity,
  '''' || name || ''' exists in code but is not documented' AS message
  FROM facts WHERE name NOT IN (SELECT f.name FROM hits h JOIN facts f ON f.k = h.fk)""",
        "rename_findings": f"""WITH k AS (SELECT p_partkey AS k, 'alpha' || p_partkey AS f, 5 + length(p_partkey::VARCHAR) AS n FROM part)
  SELECT 'fuzzy_renamed' AS category, 'warning' AS severity, f AS fact_name, 'alphax' || k AS claim_name, round(2.0::DOUBLE * n / (2 * n + 1)::DOUBLE * 100, 1) / 100.0::DOUBLE AS confidence FROM k WHERE k % 4 = 1
  UNION ALL SELECT 'renamed', 'error', f, 'alphawwwwwwwwww', 10.0::DOUBLE / (n + 15)::DOUBLE FROM k WHERE k % 4 = 2
  UNION ALL SELECT 'documented_but_missing', 'error', NULL, 'omega' || k, 0.0::DOUBLE FROM k WHERE k % 4 = 3
  UNION ALL SELECT 'undocumented', 'warning', f, NULL, 0.0::DOUBLE FROM k WHERE k % 4 = 3""",
        "param_overlap": _WITH + """, n AS (
  SELECT ck, pname, max(x) AS x, max(y) AS y, max(aty) AS aty, max(bty) AS bty FROM (
    SELECT m.ck, pname, 1 AS x, 0 AS y, t AS aty, NULL AS bty FROM compared m JOIN fp ON fp.k = m.fk
    UNION ALL SELECT m.ck, pname, 0, 1, NULL, t FROM compared m JOIN cp ON cp.k = m.ck) GROUP BY 1, 2)
  SELECT m.ck, coalesce(sum(x * y)::DOUBLE / count(n.ck)::DOUBLE, 0.0) AS overlap,
    coalesce(count(*) FILTER (x * y = 1 AND aty = bty)::DOUBLE / nullif(count(*) FILTER (x * y = 1), 0)::DOUBLE, 0.0) AS types
  FROM compared m LEFT JOIN n ON n.ck = m.ck GROUP BY m.ck""".replace("coalesce(sum(x * y)::DOUBLE / count(n.ck)::DOUBLE, 0.0)", "coalesce(sum(x * y)::DOUBLE / nullif(count(n.ck), 0)::DOUBLE, 0.0)"),
        "path_scores": _WITH + """SELECT ck,
  CASE WHEN a[2] = b[2] AND a[3] = b[3] THEN 1.0::DOUBLE WHEN a[2] <> b[2] THEN 0.333::DOUBLE ELSE 0.667::DOUBLE END AS location,
  """ + _rounded("(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b)))::DOUBLE)", 3) + """ AS context
  FROM (SELECT ck, string_split(ffile, '/')[1:3] AS a, string_split(cfile, '/')[1:3] AS b FROM compared)""",
        "health_score": _WITH + """, gone AS (SELECT DISTINCT cname, ckind FROM hits WHERE fk IS NULL AND ckind <> 'cli_usage'),
  m AS (SELECT count(*)::BIGINT AS matched FROM claims0 c WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.cname = c.name AND g.ckind = c.kind))
  SELECT (SELECT count(*) FROM claims0)::BIGINT AS claims, matched, """ + _rounded("(matched::DOUBLE / (SELECT count(*) FROM claims0)::DOUBLE * 100)", 1) + " AS score FROM m",
        "signature_text": _WITH + f"SELECT f.k, f.name || '(' || coalesce(p.params, '') || ') -> ' || f.ret AS signature FROM facts f LEFT JOIN {_PARAMS} p ON p.k = f.k",
        "weighted_confidence": f"""SELECT event_id, {_rounded("x", 3)} AS confidence FROM (SELECT event_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE,
  0.0::DOUBLE + 0.35::DOUBLE * ((event_id % 2)::DOUBLE / 2) + 0.30::DOUBLE * ((event_id % 4)::DOUBLE / 4) + 0.15::DOUBLE * ((event_id % 8)::DOUBLE / 8)
  + 0.10::DOUBLE * ((event_id % 16)::DOUBLE / 16) + 0.10::DOUBLE * ((event_id % 32)::DOUBLE / 32))) AS x FROM events)""",
        "new_findings": _anti(_FRESH, _OLD),
        "resolved_findings": _anti(_OLD, _FRESH),
        "merged_reports": _EV + """SELECT seq, source_file, fact_name, claim_name, category FROM (
  SELECT *, row_number() OVER (PARTITION BY source_file, fact_name, claim_name, category ORDER BY seq) AS n FROM ev) WHERE n = 1""",
        "filtered_findings": _EV + "SELECT seq, category, severity, confidence FROM ev WHERE severity IN ('error', 'warning') AND confidence >= 0.25 AND lower(category) <> 'click'",
        "report_totals": _EV + """SELECT count(*)::BIGINT AS items, (count(*) FILTER (severity = 'error'))::BIGINT AS errors, (count(*) FILTER (severity = 'warning'))::BIGINT AS warnings,
  coalesce(bool_or(severity = 'error'), false) AS has_errors, avg((seq % 4)::DOUBLE) AS mean_confidence FROM ev""",
        "rule_messages": _EV + "SELECT category, arg_min(message, seq) AS message, count(*)::BIGINT AS n FROM ev GROUP BY category",
        "near_changed_lines": """SELECT l_linestatus AS path, l_orderkey AS line, l_partkey AS part, l_linenumber AS number FROM lineitem l WHERE EXISTS (
  SELECT 1 FROM (SELECT DISTINCT o_orderstatus AS path, o_custkey * 23 AS line FROM orders) c WHERE c.path = l.l_linestatus AND c.line BETWEEN l.l_orderkey - 5 AND l.l_orderkey + 5)""",
        "markdown_tables": """SELECT 'docs/' || p_partkey || '.md' AS path, line::INT AS line, kind, name, d AS "default", args FROM part, LATERAL (VALUES
  (3, 'cli_flag_ref', CASE WHEN p_partkey % 3 = 0 THEN '-s' END, CASE WHEN p_partkey % 2 = 0 THEN (p_size + 1)::VARCHAR END, NULL),
  (3, 'cli_flag_ref', CASE WHEN p_partkey % 3 < 2 THEN '--size-' || p_partkey END, CASE WHEN p_partkey % 3 = 1 THEN p_size::VARCHAR WHEN p_partkey % 2 = 0 THEN (p_size + 1)::VARCHAR END, NULL),
  (7, 'config_ref', CASE WHEN p_partkey % 5 > 0 THEN 'SIZE_' || p_partkey END, p_size::VARCHAR, NULL), (8, 'config_ref', CASE WHEN p_partkey % 5 > 0 THEN 'part.n' || p_partkey END, NULL, NULL),
  (9, 'cli_flag_ref', '--no', CASE WHEN p_partkey % 2 = 0 THEN '1' END, NULL), (12, 'cli_usage', 'tool', NULL, 'run --mode=' || p_size || ' -q'),
  (12, 'cli_flag_ref', '--mode', p_size::VARCHAR, NULL), (12, 'cli_flag_ref', '-q', NULL, NULL)) v(line, kind, name, d, args) WHERE name IS NOT NULL""",
        "inline_calls": _per_part("path, line, name, raw_text, parameters", [("docs/<k>.md", 11, "load_<k>", "load_<k>(path, size: int = <s>)", "path|-|-;size|int|<s>")]),
        "docstring_claims": _per_part("doc_file, line_number, name, kind, parameters", [("src/m<k>.py", 7, "load_<k>", "function_signature", "path;size")]),
        "changed_files": "SELECT 'src/' || c_name AS path, c_custkey AS size FROM customer WHERE c_custkey % 9 = 0",
        "kept_paths": """SELECT 'home/' || ['src', '.git', 'node_modules', 'venv', '__pycache__'][(p_partkey % 5 + 1)::INT] || '/' || p_name AS path, p_partkey
  FROM part WHERE p_partkey % 5 IN (0, 3)""",
        "markdown_signatures": _WITH + f"""SELECT 'docs/' || f.k || '.md' AS path, 4::INT AS line, 'f' || f.k AS name, coalesce(p.params, '') AS params,
  regexp_replace(f.ret, '[^A-Za-z]', '', 'g') AS return_type, f.k % 6 IN (0, 1) AS suppressed FROM facts f LEFT JOIN {_PARAMS} p ON p.k = f.k""",
        "markdown_references": _WITH + """SELECT kind, name, count(*)::BIGINT AS n FROM (
  SELECT 'code_example' AS kind, 'f' || k AS name FROM facts UNION ALL SELECT 'code_example', 'g' || (k % 10) FROM facts
  UNION ALL SELECT 'cli_flag_ref', '--flag-' || (k % 30) FROM facts UNION ALL SELECT 'cli_flag_ref', '-v' FROM facts
  UNION ALL SELECT 'config_ref', 'VAR_' || (k % 50) FROM facts UNION ALL SELECT 'cli_usage', 'tool' FROM facts) GROUP BY 1, 2""",
        "build_file_facts": """SELECT s_suppkey || '/' || path AS path, line::INT AS line, name, value FROM supplier, LATERAL (VALUES
  ('Dockerfile', 1, 'from.stage' || s_suppkey, 'base:' || s_suppkey), ('Dockerfile', 2, 'env.KEY_' || s_suppkey, s_nationkey::VARCHAR),
  ('Dockerfile', 3, 'expose.80', '80'), ('Dockerfile', 3, 'expose.443', '443'), ('Dockerfile', 6, 'workdir', '/app'),
  ('Makefile', 3, 'make:build', 'dep' || s_suppkey), ('Makefile', 5, 'make:t' || s_suppkey, NULL),
  ('.env', 2, 'NAME', s_name), ('.env', 3, 'N_' || s_suppkey, s_nationkey::VARCHAR), ('.env', 4, 'EMPTY', NULL)) v(path, line, name, value)""",
    }
