import json

from attestra.operators import other_docs as D
from attestra.operators.jsdoc import jsdoc
from attestra.operators.rst import rst
from attestra.plans.scan import params_of
from attestra.sources.config_files import config_errors, config_facts, documents, openapi_facts, yaml_facts


def files(spark, text):
    return spark.createDataFrame([("f", text)], "path string, text string")


def test_typescript(spark):
    got = {r.name: r for r in D.typescript(files(spark, "// x\nexport interface User extends Base {\n  readonly id: number;\n  name?: string;\n}\nenum Color { Red, Green = 2 }\ntype Id = string | number;\n")).collect()}
    assert [(m.name, m.type, m.is_optional, m.is_readonly) for m in got["User"].members] == [("id", "number", False, True), ("name", "string", True, False)]
    assert (got["User"].line, got["User"].parent) == (2, "Base") and [(m.name, m.type) for m in got["Color"].members] == [("Red", "0"), ("Green", "2")] and got["Id"].expression == "type Id = string | number;"


TS = """// interface Fake { x: number }
const x = "interface B { y: string }", y = `a {
`;
export interface A<T> extends Base, Other<T> {
  /** doc { brace */
  readonly a: { b: string; inner: { q: number } };
  c?: number
  m: Map<string, number>;
  u:
    | 'x{'
    | "y}";
  f: (n: number, s: string) => void;
  greet(name: string): string;
  [key: string]: unknown;
}
export type P = { guest: true; name: string };
declare namespace N { interface In { z: string[] } }
export const enum E { Up, Down = 5, Left = "L,{" }
interface Empty {}
interface Open { a: string
"""


def test_typescript_blocks(spark):
    """Nested types, brackets in comments, strings and templates, unions over lines, a namespace, and a block that stays open."""
    got = {r.name: r for r in D.typescript(files(spark, TS)).collect()}
    shown = {n: [(m.name, m.type, m.is_optional) for m in r.members] for n, r in got.items()}
    assert shown == {
        "A": [("a", "{ b: string; inner: { q: number } }", False), ("c", "number", True), ("m", "Map<string, number>", False), ("u", "| 'x{' | \"y}\"", False), ("f", "(n: number, s: string) => void", False)],
        "P": [("guest", "true", False), ("name", "string", False)], "In": [("z", "string[]", False)], "E": [("Up", "0", False), ("Down", "5", False), ("Left", "\"L,{\"", False)], "Empty": [], "Open": []}
    assert (got["A"].parent, got["A"].line, got["E"].is_const, got["E"].line, got["P"].expression) == ("Base, Other<T>", 4, True, 18, "export type P = { guest: true; name: string };")


def test_graphql(spark):
    text = "type Query {\n  users(first: Int): [User!]!\n}\ntype User { id: ID }\ninput New {\n  name: String!\n}\nenum Role {\n  ADMIN\n}\n"
    got = {(r.kind, r.name, r.module, r.type): [(m.name, m.type) for m in r.members] for r in D.graphql(files(spark, text)).collect()}
    assert got == {("api_endpoint", "users", "Query", "[User!]!"): [("first", "Int")], ("class", "New", "", None): [("name", "String")], ("class", "Role", "", None): [("ADMIN", None)]}


def test_graphql_fields(spark):
    """Arguments over lines, descriptions and comments with braces, directives, an extension; a field is where it begins."""
    text = '"""Has { braces }"""\nextend type Mutation @auth {\n  "one {"\n  add(id: ID!, f: F = {a: 1},\n      n: Int = 2): User!\n  # no(x: Int): Y\n  drop: [ID!] @deprecated(reason: "}")\n}\n'
    got = {r.name: (r.line, r.type, r.what, [(m.name, m.type, m.default) for m in r.members]) for r in D.graphql(files(spark, text)).collect()}
    assert got == {"add": (4, "User!", "mutation", [("id", "ID", None), ("f", "F", "{a: 1}"), ("n", "Int", "2")]), "drop": (7, "[ID!]", "mutation", [])}


def test_empty_texts(spark):
    odd = spark.createDataFrame([("a", None), ("b", ""), ("c", "}}}((\n"), ("d", "interface L { a: string }\n" + "// {\n" * 20000)], "path string, text string")
    assert [(r.path, r.name, len(r.members)) for r in D.typescript(odd).collect()] == [("d", "L", 1)]
    assert D.graphql(odd).count() == 0 and D.terraform(odd).count() == 0


def test_jsdoc(spark):
    text = """/**
 * Greets.
 * @param {string} who - name
 * @param {number} [n=2] - count
 * @returns {void} nothing
 * @throws {Error} bad
 */
export function greet(who, n = 2) {}

/** Just text. */
const add = (a: number, b: string = "x") => a;

/** far */
// this is a long comment line
function lost(a) {}

export const g = function(x) { return x };
export async function noDoc(...rest) {}
class C {
  /** @name other
   * @type {Map} m */
  run({ a, b: T }) { }
}
/** near */ function f() {
}
"""
    got = sorted((r.line, r.kind, r.name, r.raw_text, [(p.name, p.type_annotation, p.default) for p in r.parameters], r.return_type) for r in jsdoc(files(spark, text)).collect())
    sig, both = "function_signature", [("who", None, None), ("n", None, "2")]
    assert got == sorted([
        (1, "parameter_description", "greet", "@param string who - name", both[:1], None), (1, "parameter_description", "greet", "@param number n - count", both[1:], None), (1, "return_description", "greet", "@returns {void} nothing", [], "void"),
        (1, sig, "greet", "@throws {Error} bad", both, None), (10, sig, "add", "Just text.", [("a", "number", None), ("b", "string", '"x"')], None), (17, sig, "g", "", [("x", None, None)], None), (18, sig, "noDoc", "", [("...rest", None, None)], None),
        (20, sig, "other", "@type {Map} m", [("a", None, None), ("b", "T", None)], "Map"), (24, sig, "f", "near", [], None), (24, sig, "f", "near", [], None)])
    assert jsdoc(spark.createDataFrame([("a", None), ("b", ""), ("c", "/** open")], "path string, text string")).count() == 0


RST = """Title
=====

:param lost: nobody's

.. py:function:: greet(who, n: int = 2) -> str

   Says it.

   :param who: name of
     somebody
   :type who: str
   :param str n: count

   .. note::

      :param deep: inner
   :returns: text

.. py:class:: K

   .. py:method:: K.m(a)

      :param a: first

Example::

    # no(1)
    x = 1
    run(2)

out(4)

.. code-block:: python

   def f(a):
       g(b)

See :func:`~a.b.greet` and :mod:`a.b`.

.. automodule:: pkg.mod
   :members:

   alpha
"""


def test_rst(spark):
    """Fields belong to the innermost directive, blocks end where their indentation does."""
    got = {(r.line, r.kind, r.name, tuple((p.name, p.type_annotation) for p in r.parameters), json.loads(r.metadata).get("directive")) for r in rst(files(spark, RST), params_of).collect()}
    assert got == {
        (6, "function_signature", "greet", (("who", None), ("n", "int")), None), (10, "parameter_description", "who", (("who", "str"),), "greet"), (13, "parameter_description", "n", (("n", None),), "greet"),
        (17, "parameter_description", "deep", (("deep", None),), "greet"), (18, "return_description", "greet", (), "greet"), (20, "function_signature", "K", (), None), (22, "function_signature", "K.m", (("a", None),), None),
        (24, "parameter_description", "a", (("a", None),), "K.m"), (26, "code_example", "run", (), None), (34, "code_example", "f", (), None), (39, "function_ref", "greet", (), None), (39, "function_ref", "a.b", (), None),
        (41, "function_ref", "pkg.mod", (), None), (41, "function_ref", "alpha", (), None)}
    texts = {r.name: json.loads(r.metadata)["description"] for r in rst(files(spark, RST), params_of).filter("kind = 'parameter_description'").collect()}
    assert texts["who"] == "name of\nsomebody" and texts["a"] == "first"
    assert rst(spark.createDataFrame([("a", None), ("b", ""), ("c", "\n \n")], "path string, text string"), params_of).count() == 0


SPEC = """openapi: "3.0.1"
servers: [{url: "https://x/v1/"}]
paths:
  /users/{id}:
    parameters:
      - {name: id, in: path, required: true, schema: {type: integer}}
    get:
      operationId: getUser
      parameters: [{name: q, in: query}, nope]
    delete: {parameters: nope}
    x-ext: {get: {}}
  /b.c/get.x:
    post: {description: d}
    put: nope
  /bad: 3
"""


def test_config_documents(spark):
    """Operations keep what they say; kinds of YAML; what does not parse is a row."""
    texts = [("a.yaml", SPEC), ("b.yml", "swagger: '2.0'\nbasePath: /api/\npaths: {/x: {get: {}}}\n"), ("c.yml", "services:\nl: [1, {b: [2]}]"), ("d.yml", "a: [1\n"), ("e.yml", None), ("q.yml", "paths: []"), ("f.toml", "x = 1979-05-27\n"), ("g.toml", "x =")]
    docs = documents(spark.createDataFrame(texts, "path string, text string")).cache()
    got = {r.name: json.loads(r.metadata) for r in openapi_facts(docs).collect()}
    assert set(got) == {"GET https://x/v1/users/{id}", "DELETE https://x/v1/users/{id}", "POST https://x/v1/b.c/get.x", "GET /api/x"}
    user = got["GET https://x/v1/users/{id}"]
    assert user["operation_id"] == "getUser" and user["path_param_names"] == ["id"] and user["openapi_version"] == "3.0.1" and got["GET /api/x"]["openapi_version"] == "2.0"
    assert user["parameters"] == [{"name": "id", "in": "path", "description": "", "required": True, "schema": {"type": "integer"}}, {"name": "q", "in": "query", "description": "", "required": False, "schema": {}}]
    assert [p["name"] for p in got["DELETE https://x/v1/users/{id}"]["parameters"]] == ["id"] and got["POST https://x/v1/b.c/get.x"]["description"] == "d"
    items = {(r.name, json.loads(r.metadata)["value"], json.loads(r.metadata)["yaml_kind"]) for r in yaml_facts(docs).filter("source_file = 'c.yml'").collect()}
    assert items == {("services", "None", "docker-compose"), ("l.0", "1", "docker-compose"), ("l.1.b.0", "2", "docker-compose")}
    assert {r.name for r in config_facts(docs).filter("source_file IN ('c.yml', 'f.toml')").collect()} == {"services", "l", "x"}
    assert sorted(r.path for r in config_errors(docs).collect()) == ["d.yml", "g.toml"]


def test_terraform(spark):
    text = 'variable "region" {\n  type = string\n  default = "eu"\n}\n# resource "no" "no" {\nresource "aws_s3" "b" {\n  acl = "a{" # }\n  on = true\n  tags = {\n    Name = "x"\n    "Env" : var.env\n    deep = { k = 1, l = [1,\n 2] }\n  }\n  disk { size = 1 }\n  policy = <<EOF\n{ "a": 1 }\nEOF\n  _own = 1\n}\noutput "o" { value = aws_s3.b.id }\ndata "ami" "u" {}\nvariable "open" {\n'
    got = {r.name: json.loads(r.metadata) for r in D.terraform(files(spark, text)).collect()}
    assert {n: m.get("value") for n, m in got.items()} == {
        "var.region": None, "aws_s3.b": None, "aws_s3.b.acl": "a{", "aws_s3.b.on": "True", "aws_s3.b.tags.Name": "x", "aws_s3.b.tags.Env": "${var.env}", "aws_s3.b.tags.deep.k": "1", "aws_s3.b.tags.deep.l": "[1,\n 2]",
        "aws_s3.b.disk": "{ size = 1 }", "aws_s3.b.policy": '<<EOF\n{ "a": 1 }\nEOF', "output.o": "${aws_s3.b.id}", "data.ami.u": None}
    assert (got["var.region"]["default"], got["var.region"]["variable_type"], got["aws_s3.b"]["is_resource"]) == ("eu", "string", True)


def test_blocks_are_read_where_their_file_is(spark):
    """No token is shuffled, and a file is read once."""
    some = spark.createDataFrame([("a", "type Query { a: B }")], "path string, text string")
    for rule in (D.typescript, D.graphql, D.terraform):
        plan = rule(some)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_terraform_objects(spark):
    """Objects in objects by dotted keys, of a key that comes twice the first, a nested block as one key, an object that is computed as it stands."""
    text = 'resource "a" "b" {\n  x = { y = { z = 1, w = "s" }\n e = {} }\n  x = 2\n  x = 3\n  disk {\n    size = 1 # }\n  }\n  all = { for k in v : k => 1 }\n}\n'
    got = [(r.name, json.loads(r.metadata).get("value")) for r in D.terraform(files(spark, text)).collect()]
    assert got[0] == ("a.b", None) and sorted(got[1:]) == [("a.b.all", "{ for k in v : k => 1 }"), ("a.b.disk", "{\n    size = 1 \n  }"), ("a.b.x", "2"), ("a.b.x.e", "{}"), ("a.b.x.y.w", "s"), ("a.b.x.y.z", "1")]


def test_yaml_by_either_parser():
    """The parser in C, where it is there, reads what the one in Python reads; what it reads in its own way it does not get; errors are those of Python where they are asked for."""
    import pytest
    import yaml

    from attestra.sources.config_files import _yaml

    for text in ("a: {b: [1, null, 2.5], c: 2001-01-01}\n---\n- x: &y [yes, ~]\n- *y\n", "\n\n\ufeff", "é: \"\\u0041\"\n", "? k\n: v\n", ""):
        assert _yaml("f", text, True) == _yaml("f", text, False) == list(yaml.safe_load_all(text))
    for text in ("~\t", ">-#c", "bad: [1\n"):
        with pytest.raises(yaml.YAMLError) as told:
            _yaml("f", text, True)
        with pytest.raises(yaml.YAMLError) as own:
            list(yaml.safe_load_all(text))
        assert str(told.value) == str(own.value)
        with pytest.raises(yaml.YAMLError):
            _yaml("f", text, False)


def test_specifications_are_parsed_in_c(spark, monkeypatch):
    """Where it is there, the parser in Python sees no file that the one in C reads."""
    import yaml

    from attestra.sources import config_files

    monkeypatch.setattr(yaml, "safe_load_all", lambda text: 1 / 0)
    assert not hasattr(yaml, "CSafeLoader") or config_files._yaml("f", "openapi: 3.0.1\npaths: {}\n", True) == [{"openapi": "3.0.1", "paths": {}}]


def test_rst_is_read_where_its_file_is(spark):
    """No line is shuffled; what hangs below a line is found whatever lies between, and a page of many levels is one pass."""
    plan = rst(files(spark, "x"), params_of)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    deep = ".. py:function:: f(a)\n" + "".join(" " * i + "x\n" for i in range(1, 400)) + " " * 401 + ":param a: far\n\n.. py:function:: 9\n\n   :param b: nobody's\n"
    got = [(r.kind, r.name, json.loads(r.metadata).get("directive")) for r in rst(files(spark, deep), params_of).collect()]
    assert sorted(got) == [("function_signature", "f", None), ("parameter_description", "a", "f")]
