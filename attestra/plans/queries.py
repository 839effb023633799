"""Queries over the driver's tables, seen as facts, claims, findings and files.

Orders are facts and claims (named by key), their line items parameters; events are
findings of two reports.  The views are only a way to run the operators on data that
grows with the tables; each query is one operator and a projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.tables import keep
from ..operators import algebra, match, python_facts
from ..operators import lines as L
from ..sources.python_ast import python_nodes
from . import text_queries
from .scan import params_of


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- views ---------------------------------------------------------------------------


def _params(spark: SparkSession, sf_dir: str, drop: int, shift: bool) -> DataFrame:
    items = _read(spark, sf_dir, "lineitem").filter(F.col("l_partkey") % drop != 0).select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("t"), F.col("l_quantity").cast("int").alias("d"), F.col("l_suppkey").alias("s"))
    # dealt by the order alone, so that its parameters need no further shuffle
    per = text_queries.dealt(items, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.max("t").alias("t"), F.max("d").alias("d"), F.max("s").alias("s"))
    kind = F.when((F.col("s") % 11 == 0) & F.lit(shift), F.concat("t", F.lit("x"))).otherwise(F.col("t"))
    default = F.when((F.col("s") % 5 == 0) & F.lit(shift), (F.col("d") + 1).cast("string")).when(F.col("s") % 3 == 0, F.lit(None)).otherwise(F.col("d").cast("string"))
    param = F.struct(
        F.concat(F.lit("p"), "l_linenumber").alias("name"), kind.alias("type_annotation"), default.alias("default"),
        F.lit("positional").alias("kind"), F.lit(False).alias("is_optional"), F.lit(False).alias("is_readonly"),
    )
    return per.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(param)).alias("parameters"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return _read(spark, sf_dir, "orders").join(_params(spark, sf_dir, 7, False), "o_orderkey", "left").select(
        key.alias("seq"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("--flag-"), key)).otherwise(F.concat(F.lit("m"), key % 7, F.lit(".f"), key)).alias("name"),
        F.when(F.col("o_orderstatus") == "P", "cli_flag").when(key % 10 == 3, "config_key").otherwise("function").alias("kind"),
        F.concat(F.lit("src/d"), key % 5, F.lit("/e"), key % 3, F.lit("/m.py")).alias("source_file"),
        (key % 1000).cast("int").alias("line_number"),
        F.coalesce("parameters", F.array().cast("array<struct<name:string,type_annotation:string,default:string,kind:string,is_optional:boolean,is_readonly:boolean>>")).alias("parameters"),
        F.col("o_orderpriority").alias("return_type"),
        F.array().cast("array<string>").alias("decorators"), F.lit("").alias("module"), F.lit(None).cast("string").alias("docstring"),
        F.to_json(F.struct(F.concat(F.lit("-"), key).alias("short_flag"))).alias("metadata"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return _read(spark, sf_dir, "orders").filter(key % 11 != 0).join(_params(spark, sf_dir, 5, True), "o_orderkey", "left").select(
        key.alias("seq"), F.lit("").alias("raw_text"),
        F.when(F.col("o_orderstatus") == "P", "cli_flag_ref").when(key % 10 == 3, "config_ref").when(key % 23 == 0, "cli_usage").otherwise("function_signature").alias("kind"),
        F.concat(F.lit("src/d"), key % 4, F.lit("/e"), key % 3, F.lit("/doc.md")).alias("doc_file"),
        (key % 1000).cast("int").alias("line_number"),
        F.when(F.col("o_orderstatus") == "P", F.when(key % 2 == 0, F.concat(F.lit("-"), key)).otherwise(F.concat(F.lit("--flag-"), key)))
        .when(key % 13 == 0, F.concat(F.lit("x.f"), key))
        .when(key % 17 == 0, F.concat(F.lit("gone"), key))
        .otherwise(F.concat(F.lit("m"), key % 7, F.lit(".f"), key)).alias("name"),
        F.coalesce("parameters", F.array().cast("array<struct<name:string,type_annotation:string,default:string,kind:string,is_optional:boolean,is_readonly:boolean>>")).alias("parameters"),
        F.when(key % 19 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("return_type"),
        F.to_json(F.struct((key % 29 == 0).alias("suppressed"))).alias("metadata"),
    )


VIEWS = r"""
fp AS (SELECT l_orderkey AS k, 'p' || l_linenumber AS pname, max(l_returnflag) AS t,
         CASE WHEN max(l_suppkey) % 3 = 0 THEN NULL ELSE max(l_quantity::INT)::VARCHAR END AS d
       FROM lineitem WHERE l_partkey % 7 <> 0 GROUP BY l_orderkey, l_linenumber),
cp AS (SELECT l_orderkey AS k, 'p' || l_linenumber AS pname,
         max(l_returnflag) || CASE WHEN max(l_suppkey) % 11 = 0 THEN 'x' ELSE '' END AS t,
         CASE WHEN max(l_suppkey) % 5 = 0 THEN (max(l_quantity::INT) + 1)::VARCHAR WHEN max(l_suppkey) % 3 = 0 THEN NULL ELSE max(l_quantity::INT)::VARCHAR END AS d
       FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY l_orderkey, l_linenumber),
facts AS (SELECT o_orderkey AS k,
         CASE WHEN o_orderstatus = 'P' THEN '--flag-' || o_orderkey ELSE 'm' || (o_orderkey % 7) || '.f' || o_orderkey END AS name,
         CASE WHEN o_orderstatus = 'P' THEN 'cli_flag' WHEN o_orderkey % 10 = 3 THEN 'config_key' ELSE 'function' END AS kind,
         'src/d' || (o_orderkey % 5) || '/e' || (o_orderkey % 3) || '/m.py' AS file, (o_orderkey % 1000)::INT AS line, o_orderpriority AS ret
       FROM orders),
claims0 AS (SELECT o_orderkey AS k,
         CASE WHEN o_orderstatus = 'P' THEN 'cli_flag_ref' WHEN o_orderkey % 10 = 3 THEN 'config_ref' WHEN o_orderkey % 23 = 0 THEN 'cli_usage' ELSE 'function_signature' END AS kind,
         'src/d' || (o_orderkey % 4) || '/e' || (o_orderkey % 3) || '/doc.md' AS file,
         CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN '-' || o_orderkey ELSE '--flag-' || o_orderkey END
              WHEN o_orderkey % 13 = 0 THEN 'x.f' || o_orderkey WHEN o_orderkey % 17 = 0 THEN 'gone' || o_orderkey
              ELSE 'm' || (o_orderkey % 7) || '.f' || o_orderkey END AS name,
         CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderpriority END AS ret
       FROM orders WHERE o_orderkey % 11 <> 0),
claims AS (SELECT * FROM claims0 WHERE k % 29 <> 0),
uniq AS (SELECT split_part(name, '.', -1) AS last, min(name) AS fname FROM facts GROUP BY 1 HAVING count(*) = 1),
hits AS (
  SELECT c.k AS ck, c.name AS cname, c.kind AS ckind, c.ret AS cret, c.file AS cfile, coalesce(f.k, s.k, u.k) AS fk
  FROM claims c LEFT JOIN facts f ON f.name = c.name
  LEFT JOIN facts s ON c.kind = 'cli_flag_ref' AND f.k IS NULL AND c.name LIKE '-%' AND s.kind = 'cli_flag' AND c.name = '-' || s.k
  LEFT JOIN uniq n ON f.k IS NULL AND s.k IS NULL AND n.last = split_part(c.name, '.', -1)
  LEFT JOIN facts u ON u.name = n.fname),
compared AS (
  SELECT h.*, f.name AS fname, f.ret AS fret, f.file AS ffile FROM hits h JOIN facts f ON f.k = h.fk
  WHERE NOT (f.kind = 'cli_flag' AND h.ckind = 'cli_flag_ref') AND NOT (f.kind = 'config_key' AND h.ckind = 'config_ref')),
diff AS (
  SELECT m.ck, m.fname, coalesce(a.pname, b.pname) AS subject, a.pname AS ap, b.pname AS bp, a.t AS aty, b.t AS bty, a.d AS ad, b.d AS bd
  FROM compared m
  JOIN (SELECT ck, pname FROM compared JOIN fp ON fp.k = fk UNION SELECT ck, pname FROM compared JOIN cp ON cp.k = ck) n ON n.ck = m.ck
  LEFT JOIN fp a ON a.k = m.fk AND a.pname = n.pname LEFT JOIN cp b ON b.k = m.ck AND b.pname = n.pname),
found AS (
  SELECT ck, fname, subject, 'missing_param' AS category, 'error' AS severity FROM diff WHERE bp IS NULL
  UNION ALL SELECT ck, fname, subject, 'extra_param', 'error' FROM diff WHERE ap IS NULL
  UNION ALL SELECT ck, fname, subject, 'wrong_default', 'warning' FROM diff WHERE ap IS NOT NULL AND bp IS NOT NULL AND ad IS DISTINCT FROM bd
  UNION ALL SELECT ck, fname, subject, 'wrong_type', 'warning' FROM diff WHERE ap IS NOT NULL AND bp IS NOT NULL AND aty IS DISTINCT FROM bty
  UNION ALL SELECT ck, fname, NULL, 'wrong_return_type', 'warning' FROM compared WHERE fret IS DISTINCT FROM cret)
"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return match.fact_side(facts(spark, sf_dir)), match.claim_side(claims(spark, sf_dir))


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.differences(match.lookup(*_sides(spark, sf_dir)))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings: user the fact, value band the claim (null for some), type the category."""
    e = _read(spark, sf_dir, "events")
    claim = F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("c"), F.floor("value") % 20))
    return e.select(
        F.col("event_id").alias("seq"), "ts", F.concat(F.lit("u"), F.col("user_id") % 50).alias("fact_name"), claim.alias("claim_name"),
        F.col("event_type").alias("category"), F.concat(F.lit("f"), F.col("user_id") % 3).alias("source_file"),
        F.when(F.col("event_id") % 3 == 0, "error").when(F.col("event_id") % 3 == 1, "warning").otherwise("info").alias("severity"),
        (F.col("event_id") % 100 / 100.0).alias("confidence"), F.concat(F.lit("m"), "event_id").alias("message"),
    )


EVENTS = """
ev AS (SELECT event_id AS seq, ts, 'u' || (user_id % 50) AS fact_name,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'c' || (floor(value)::BIGINT % 20) END AS claim_name,
         event_type AS category, 'f' || (user_id % 3) AS source_file,
         CASE event_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity,
         (event_id % 100)::DOUBLE / 100.0 AS confidence, 'm' || event_id AS message
       FROM events)
"""
SPLIT = "2024-01-16"


def _reports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _events(spark, sf_dir)
    return e.filter(F.col("ts") >= SPLIT), e.filter(F.col("ts") < SPLIT)


# --- the queries -----------------------------------------------------------------------


def parameter_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir).select(F.col("claim.seq").alias("ck"), F.col("fact.name").alias("fname"), "subject", "category", "severity")


def category_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.category_histogram(_diff(spark, sf_dir))


def claim_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = match.lookup(*_sides(spark, sf_dir))
    return hits.select(F.col("claim.seq").alias("ck"), F.col("claim.name").alias("cname"), F.col("fact.seq").alias("fk"), "compare")


def last_fact_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part").select(F.struct(F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), "p_size").alias("fact"))
    return match.qualified(part).select("name", F.col("fact.seq").alias("seq"), F.col("fact.p_size").alias("size"))


def only_fact_of_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "customer").select(F.struct(F.col("c_custkey").alias("seq"), F.concat("c_mktsegment", F.lit("."), F.col("c_custkey") % 1400).alias("name")).alias("fact"))
    return match.unqualified(s).select(F.col("last").alias("segment"), F.col("fact.seq").alias("seq"))


def undocumented_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts_, claims_ = _sides(spark, sf_dir)
    hits = match.lookup(facts_, claims_)
    names = hits.filter(F.col("fact").isNotNull()).select(F.col("fact.name").alias("name")).distinct()
    return match.undocumented(facts_, names, hits).select(F.col("fact.seq").alias("k"), F.col("fact.name").alias("name"), "severity", "message")


def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match.match(facts(spark, sf_dir), claims(spark, sf_dir))
    return found.select(F.col("fact.name").alias("fact_name"), F.col("claim.name").alias("claim_name"), "category", "severity", "subject", "message", "suggestion", "confidence")


def rename_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as functions with a parameter of their own, and claims that hit, resemble, replace or miss them."""
    k = F.col("p_partkey")
    param = lambda name: F.array(F.struct(name.alias("name"), F.lit(None).cast("string").alias("type_annotation"), F.lit(None).cast("string").alias("default"), F.lit("positional").alias("kind"), F.lit(False).alias("is_optional"), F.lit(False).alias("is_readonly")))
    part, none = _read(spark, sf_dir, "part"), F.lit(None).cast("string")
    f = part.select(k.alias("seq"), F.concat(F.lit("alpha"), k).alias("name"), F.lit("function").alias("kind"), F.lit("m.py").alias("source_file"), F.lit(1).alias("line_number"), param(F.concat(F.lit("p"), k)).alias("parameters"), none.alias("return_type"), F.lit("{}").alias("metadata"))
    name = F.when(k % 4 == 0, F.concat(F.lit("alpha"), k)).when(k % 4 == 1, F.concat(F.lit("alphax"), k)).when(k % 4 == 2, F.lit("alphawwwwwwwwww")).otherwise(F.concat(F.lit("omega"), k))
    c = part.select(k.alias("seq"), F.lit("").alias("raw_text"), F.lit("function_signature").alias("kind"), F.lit("d.md").alias("doc_file"), F.lit(1).alias("line_number"), name.alias("name"), param(F.concat(F.when(k % 4 == 3, "q").otherwise("p"), k)).alias("parameters"), none.alias("return_type"), F.lit("{}").alias("metadata"))
    found = match.match(f, c)
    return found.select("category", "severity", F.col("fact.name").alias("fact_name"), F.col("claim.name").alias("claim_name"), "confidence")


def param_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = match.lookup(*_sides(spark, sf_dir)).filter("compare")
    a, b = C.names_of("fact.parameters"), C.names_of("claim.parameters")
    return hits.select(F.col("claim.seq").alias("ck"), C.jaccard(a, b).alias("overlap"), C.type_match(F.col("fact.parameters"), F.col("claim.parameters")).alias("types"))


def path_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = match.lookup(*_sides(spark, sf_dir)).filter("compare")
    a, b = F.col("fact.source_file"), F.col("claim.doc_file")
    return hits.select(F.col("claim.seq").alias("ck"), C.location_proximity(a, b).alias("location"), C.context_match(a, b).alias("context"))


def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir)
    hits = match.lookup(*_sides(spark, sf_dir))
    gone = hits.filter(F.col("fact").isNull() & (F.col("claim.kind") != "cli_usage")).select(F.lit("documented_but_missing").alias("category"), F.col("claim.name").alias("claim_name"), F.col("claim.kind").alias("claim_kind"))
    return algebra.health(c, gone)


def signature_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    return f.select(F.col("seq").alias("k"), C.signature(F.col("name"), F.col("parameters"), F.col("return_type")).alias("signature"))


def weighted_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda n: (F.col("event_id") % n).cast("double") / n
    signals = F.struct(*[part(n).alias(name) for n, (name, _) in zip((2, 4, 8, 16, 32), C.WEIGHTS)])
    return _read(spark, sf_dir, "events").select("event_id", C.weighted_confidence(signals).alias("confidence"))


def new_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.new_findings(*_reports(spark, sf_dir)).select("seq", "fact_name", "claim_name", "category")


def resolved_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.resolved_findings(*_reports(spark, sf_dir)).select("seq", "fact_name", "claim_name", "category")


def merged_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.merged(_events(spark, sf_dir)).select("seq", "source_file", "fact_name", "claim_name", "category")


def filtered_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = algebra.confident(algebra.at_least(_events(spark, sf_dir), "warning"), 0.25)
    told = e.withColumn("told", F.col("category")).withColumn("category", F.when(F.col("told") == "click", "Missing_Param").otherwise(F.col("told")))
    return algebra.without_categories(told, [" missing_PARAM "]).select("seq", F.col("told").alias("category"), "severity", "confidence")


def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.totals(_events(spark, sf_dir).withColumn("confidence", (F.col("seq") % 4).cast("double")))


def rule_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.rules(_events(spark, sf_dir))


def near_changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as lines of their status' file, near the lines that orders have changed."""
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("path"), F.col("l_orderkey").alias("line"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("number"))
    changed = _read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("path"), (F.col("o_custkey") * 23).alias("line"))
    return algebra.near_changes(rows, changed, "path", "line").select("path", "line", "part", "number")


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select(F.concat(F.lit("src/"), "c_name").alias("path"), F.col("c_acctbal").alias("mtime"), F.col("c_custkey").alias("size"))
    state = c.withColumn("size", F.when(F.col("size") % 9 == 0, F.col("size") + 1).otherwise(F.col("size"))).select("path", algebra.fingerprint("mtime", "size").alias("fingerprint"))
    return algebra.changed_since(c, state).select("path", "size")


def kept_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = F.array(F.lit("src"), F.lit(".git"), F.lit("node_modules"), F.lit("venv"), F.lit("__pycache__"))
    p = _read(spark, sf_dir, "part").select(F.concat_ws("/", F.lit("home"), F.element_at(dirs, (F.col("p_partkey") % 5 + 1).cast("int")), F.col("p_name")).alias("path"), "p_partkey")
    return algebra.outside_excluded(p)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a Markdown page: prose, a suppressed or plain fence with the signature, inline code, a flag, a variable."""
    f = facts(spark, sf_dir)
    key = F.col("seq")
    sig = C.signature(F.concat(F.lit("f"), key), F.col("parameters"), F.regexp_replace("return_type", "[^A-Za-z]", ""))
    text = F.concat_ws(
        "\n", F.concat(F.lit("# Order "), key),
        F.when(key % 6 == 0, F.lit("<!-- docs:ignore -->")).when(key % 6 == 1, F.concat(F.lit("<!-- docs:ignore f"), key, F.lit(" -->"))).otherwise("text"),
        F.lit("```python"), F.concat(F.lit("def "), sig, F.lit(":")), F.lit("```"),
        F.concat(F.lit("Call `f"), key, F.lit("(a, b)` or `g"), key % 10, F.lit("`; set $VAR_"), key % 50, F.lit(" first.")),
        F.concat(F.lit("$ tool run --flag-"), key % 30, F.lit(" -v")),
    )
    return f.select(F.concat(F.lit("docs/"), key, F.lit(".md")).alias("path"), text.alias("text"), "seq")


def markdown_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.fenced_signatures(L.lines(_pages(spark, sf_dir)))
    return found.select("path", F.col("line").cast("int").alias("line"), "name", "params", "return_type", "suppressed")


def markdown_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each inline code, flag, variable and command is named."""
    lines = L.lines(_pages(spark, sf_dir))
    refs = L.references(lines)
    return refs.groupBy("kind", "name").agg(F.count("*").alias("n"))


def _table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a page with a table of flags and one of variables, calls and commands; what is in them differs by key."""
    k, size = F.col("p_partkey"), F.col("p_size")
    flag = F.when(k % 3 == 0, F.concat(F.lit("-s, --size-"), k)).when(k % 3 == 1, F.concat(F.lit("--size-"), k, F.lit("="), size)).otherwise(F.concat(F.lit("`--size-"), k, F.lit("`")))
    text = F.concat_ws(
        "\n", F.when(k % 2 == 0, F.lit("| Flag | Default |")).otherwise(F.lit("| Flag | Note |")), F.lit("|---|---|"), F.concat(F.lit("| "), flag, F.lit(" | "), size + 1, F.lit(" |")),
        F.lit("Text."), F.when(k % 5 == 0, F.lit("| Meaning | Use |")).otherwise(F.lit("| Variable | Value |")), F.lit("|:--|--:|"),
        F.concat(F.lit("| SIZE_"), k, F.lit(" | "), size, F.lit(" |")), F.concat(F.lit("| part.n"), k, F.lit(" |  |")), F.lit("| --no | 1 |"), F.lit(""),
        F.concat(F.lit("Call `load_"), k, F.lit("(path, size: int = "), size, F.lit(")`, `part.n"), k, F.lit("` or `f`.")), F.concat(F.lit("$ tool run --mode="), size, F.lit(" -q")),
    )
    return _read(spark, sf_dir, "part").select(F.concat(F.lit("docs/"), k, F.lit(".md")).alias("path"), text.alias("text"))


def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags and configuration names of tables, commands and their flags, with defaults and arguments."""
    found = L.references(L.lines(_table_pages(spark, sf_dir)), "usages", "flags", "table_flags", "table_variables")
    return found.select("path", F.col("line").cast("int").alias("line"), "kind", "name", "default", "args")


def inline_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in backticks, with the names, types and defaults of its parameters."""
    found = L.references(L.lines(_table_pages(spark, sf_dir)), "inline").filter("line = 11")
    shown = F.array_join(F.transform(params_of(F.col("params")), lambda p: F.concat_ws("|", p["name"], F.coalesce(p["type_annotation"], F.lit("-")), F.coalesce(p["default"], F.lit("-")))), ";")
    return found.select("path", F.col("line").cast("int").alias("line"), "name", "raw_text", shown.alias("parameters"))


MODULE = """import os
MODE = os.environ["MODE_<k>"]
PORT = os.getenv("PORT_<k>", "<s>")
parser.add_argument("--opt-<k>", "-o", action="store_true", help="size <s>")
parser.add_argument("file_<k>", type=int, default=<s>)

def load_<k>(path: str, size: int = <s>, *rest) -> bool:
    \"\"\"Load.

    Args:
        path: where
        size: how much
    \"\"\"

def _hidden_<k>(): pass

@dataclass
class Part<k>:
    name: str
    size: int = <s>
    kind: ClassVar[int] = 0

    def grow(self, by): pass

@app.route("/parts/<k>", methods=["GET", "POST"])
@login_required
@tools.cached(size=<s>)
@own
def view_<k>(): pass

class Settings<k>(BaseSettings):
    debug: bool = Field(False, env="DEBUG_<k>", description="d")

class Row<k>(Base):
    __tablename__ = "rows_<k>"
    id = Column(Integer, primary_key=True)
    other = Column(Integer, ForeignKey("others.id"), nullable=False)

@deprecated("use load_<k>", version="<s>")
def old_<k>(): pass

@click.option("--level-<k>", "-l", required=True, help="x")
def cli_<k>(level): pass

class Closes<k>(Protocol):
    def close(self) -> None: ...

router = APIRouter(prefix="/api<s>")
@router.get("/items/{item_id}", status_code=201)
def item_<k>(item_id: int, q: str = "a") -> dict: pass

pages = Blueprint("pages", __name__, url_prefix="/p<s>/")
@pages.route("/x<k>")
def page_<k>(): pass

urlpatterns = [path("users/<int:pk>/<k>", views.user_<k>, name="user-<k>"), path("more/", include("more.urls"))]

@app.command()
def run_<k>(size: int = typer.Option(<s>, "--size-<k>", "-s", help="how"), name: str = typer.Argument(...)): pass
"""


#: Modules that a task parses, about.
MODULES = 5000


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a Python module; parts are dealt before they become texts."""
    parts = text_queries.dealt(_read(spark, sf_dir, "part").select("p_partkey", "p_size"), share=MODULES)
    text = F.replace(F.replace(F.lit(MODULE), F.lit("<k>"), F.col("p_partkey").cast("string")), F.lit("<s>"), F.col("p_size").cast("string"))
    return parts.select(F.concat(F.lit("src/m"), "p_partkey", F.lit(".py")).alias("path"), text.alias("text"))


def _facts_of(rule: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = python_facts.RULES[rule](keep(python_nodes(_modules(spark, sf_dir), python_facts.READS.get(rule)), "query-nodes"))
        shown = F.array_join(F.transform("parameters", lambda p: F.concat_ws("|", p["name"], F.coalesce(p["type_annotation"], F.lit("-")), F.coalesce(p["default"], F.lit("-")), p["kind"])), ";")
        return found.select("source_file", "line_number", "name", "kind", shown.alias("parameters"), "return_type", "metadata")

    return query


def docstring_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = python_facts.docstring_claims(python_nodes(_modules(spark, sf_dir)))
    return found.select("doc_file", "line_number", "name", "kind", F.array_join(F.transform("parameters", lambda p: p["name"]), ";").alias("parameters"))


#: Queries that apply one rule to all modules.
FACT_QUERIES = {
    "facts_of_definitions": "PythonExtractor", "facts_of_argparse": "ArgparseExtractor", "facts_of_click": "ClickExtractor", "facts_of_typer": "TyperExtractor", "facts_of_dataclasses": "DataclassFieldsExtractor",
    "facts_of_decorators": "DecoratorExtractor", "facts_of_deprecation": "DeprecatedExtractor", "facts_of_environment": "EnvVarExtractor", "facts_of_settings": "PydanticExtractor", "facts_of_fastapi": "FastAPIRoutesExtractor",
    "facts_of_flask": "FlaskRoutesExtractor", "facts_of_django": "DjangoURLsExtractor", "facts_of_tables": "SQLAlchemyExtractor", "facts_of_protocols": "ProtocolExtractor",
}


def _recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier as a Dockerfile, a Makefile and an environment file."""
    k = F.col("s_suppkey")
    s = _read(spark, sf_dir, "supplier")
    docker = F.concat_ws("\n", F.concat(F.lit("FROM base:"), k, F.lit(" AS stage"), k), F.concat(F.lit("ENV KEY_"), k, F.lit("="), "s_nationkey"), F.lit("EXPOSE 80 \\"), F.lit("  443"), F.lit("RUN true"), F.lit("WORKDIR /app"))
    make = F.concat_ws("\n", F.lit(".PHONY: build"), F.lit("# builds it"), F.concat(F.lit("build: dep"), k), F.lit("\ttrue"), F.concat(F.lit("t"), k, F.lit(":")))
    env = F.concat_ws("\n", F.lit("# note"), F.concat(F.lit("export NAME=\""), "s_name", F.lit("\"")), F.concat(F.lit("N_"), k, F.lit("="), "s_nationkey", F.lit(" # n")), F.lit("EMPTY="))
    return s.select(k.alias("k"), F.explode(F.array(
        F.struct(F.concat(k, F.lit("/Dockerfile")).alias("path"), docker.alias("text")),
        F.struct(F.concat(k, F.lit("/Makefile")).alias("path"), make.alias("text")),
        F.struct(F.concat(k, F.lit("/.env")).alias("path"), env.alias("text")),
    )).alias("f")).select("k", "f.path", "f.text")


def build_file_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _recipes(spark, sf_dir)
    found = L.dockerfile(files.filter("path LIKE '%Dockerfile'")).unionByName(L.makefile(files.filter("path LIKE '%Makefile'")).select("path", "line", "name", "value")).unionByName(L.dotenv(files.filter("path LIKE '%.env'")))
    return found.select("path", F.col("line").cast("int").alias("line"), "name", "value")


NAMES = (
    parameter_diff, category_histogram, claim_lookup, last_fact_wins, only_fact_of_segment, undocumented_facts, all_findings, rename_findings, param_overlap, path_scores,
    health_score, signature_text, weighted_confidence, new_findings, resolved_findings, merged_reports, filtered_findings, report_totals, rule_messages,
    near_changed_lines, changed_files, kept_paths, markdown_signatures, markdown_references, markdown_tables, inline_calls, docstring_claims, build_file_facts,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in NAMES} | text_queries.queries() | {name: _facts_of(rule) for name, rule in FACT_QUERIES.items()}
