from attestra.operators import lines as L
from attestra.plans.scan import markdown_claims
from attestra.sources.files import ignored, read_files


def test_markdown(spark):
    text = "# T\n<!-- docs:ignore g -->\n```python\ndef g(a):\ndef f(a, b=1) -> int:\n```\nUse `f(1)` and `MAX_SIZE` or ${HOME}.\n$ tool run --all -v\n"
    rows = L.lines(spark.createDataFrame([("d.md", text)], "path string, text string"))
    sig = {r.name: (r.line, r.params, r.return_type, r.suppressed) for r in L.fenced_signatures(rows).collect()}
    assert sig == {"g": (4, "a", None, True), "f": (5, "a, b=1", "int", False)}
    assert {(r.line, r.name, r.params) for r in L.inline_code(rows).collect()} == {(7, "f", "1"), (7, "MAX_SIZE", None)}
    assert {r.name for r in L.variables(rows).collect()} == {"HOME", "MAX_SIZE"}
    assert {r.name for r in L.cli_flags(rows).collect()} == {"--all", "-v"}
    assert [r.name for r in L.cli_usages(rows).collect()] == ["tool"]


def test_fences(spark):
    """Signatures over lines, cut at the first closing parenthesis, several in a fence; a fence that stays open holds none."""
    text = "```py\ndef load(\n    path: str,\n    mode='r',\n) -> int:\n    pass\ndef open_(a, f=(1, 2)):\n  def inner(b): pass\n```\n~~~\ndef no(): pass\n~~~\n```\ndef last()\n```\n```\ndef lost(a): pass\n"
    rows = L.lines(spark.createDataFrame([("d.md", text), ("n.md", None), ("e.md", "")], "path string, text string"))
    got = {r.name: (r.line, r.params, r.return_type, r.raw_text) for r in L.fenced_signatures(rows).collect()}
    assert got == {"load": (2, "\n    path: str,\n    mode='r',\n", "int", "def load(\n    path: str,\n    mode='r',\n) -> int:"), "open_": (7, "a, f=(1, 2", None, "def open_(a, f=(1, 2)"), "last": (14, "", None, "def last()\n"[:-1])}
    params = {r.name: [(p.name, p.type_annotation, p.default) for p in r.parameters] for r in markdown_claims(spark.createDataFrame([("d.md", text)], "path string, text string")).filter("kind = 'function_signature'").collect()}
    assert params == {"load": [("path", "str", None), ("mode", None, "'r'")], "open_": [("a", None, None), ("f", None, "(1, 2")], "last": []}


def test_usages(spark):
    text = "$ tool --x\ntool check all --y\ncheck only\n$ ./no\n  make  runner x\ntoolrun"
    rows = L.lines(spark.createDataFrame([("d.md", text)], "path string, text string"))
    assert {(r.line, r.name, r.args, r.action) for r in L.cli_usages(rows).collect()} == {(1, "tool", "--x", None), (2, "tool", "all --y", "check"), (5, "make", "ner x", "run")}


def test_markdown_tables(spark):
    text = "\n".join([
        "| Flag | Default | Note |", "|---|---|---|", "| -v, --verbose=2 | 5 | -x |", "| --port | 80 | `--no` |", "| `--ticked` | 1 | |", "prose", "",
        "| Variable | Value |", "|:--|--:|", "| DB_URL | x |", "| db.pool.Size |  |", "| --flag | 3 |", "| lower | 4 |", "", "| A | B |", "| KEY | Z |", "| C_D | 7 |",
    ])
    rows = L.lines(spark.createDataFrame([("d.md", text)], "path string, text string"))
    flags = {(r.line, r.name, r.default) for r in L.references(rows, "table_flags").collect()}
    assert flags == {(3, "-v", "5"), (3, "--verbose", "2"), (3, "-x", "5"), (4, "--port", "80"), (12, "--flag", "3")}
    names = {(r.line, r.name, r.default) for r in L.references(rows, "table_variables").collect()}
    assert names == {(10, "DB_URL", "x"), (11, "db.pool.Size", None), (17, "C_D", None)}


def test_references_of_a_line(spark):
    text = "Call `load(path, mode)` or `a.b` or `x y`, twice `load(path, mode)`\n$ tool run --out=a.txt --out=b -v\nmake check all\n```python\nuse `fenced_name` and ${A} $B `C_D`\n```\n| $E_F | `E_F` |"
    rows = L.lines(spark.createDataFrame([("d.md", text)], "path string, text string"))
    got = {(r.line, r.kind, r.name, r.params, r.default, r.args) for r in L.references(rows).collect()}
    assert got == {
        (1, "code_example", "load", "path, mode", None, None), (2, "cli_usage", "tool", None, None, "run --out=a.txt --out=b -v"), (2, "cli_flag_ref", "--out", None, "a.txt", None), (2, "cli_flag_ref", "-v", None, None, None),
        (3, "cli_usage", "make", None, None, "all"), (5, "code_example", "fenced_name", None, None, None), (5, "config_ref", "A", None, None, None), (5, "config_ref", "B", None, None, None), (5, "config_ref", "C_D", None, None, None),
        (5, "code_example", "C_D", None, None, None), (7, "config_ref", "E_F", None, None, None), (7, "code_example", "E_F", None, None, None),
    }


def test_build_files(spark):
    files = spark.createDataFrame([("Dockerfile", 'FROM a:1 AS b\nENV X=1 Y="z"\n# c\nEXPOSE 80 \\\n 90\nCMD run')], "path string, text string")
    assert sorted((r.line, r.name, r.value) for r in L.dockerfile(files).collect()) == [
        (1, "from.b", "a:1"), (2, "env.X", "1"), (2, "env.Y", "z"), (4, "expose.80", "80"), (4, "expose.90", "90"), (6, "cmd", "run")]
    env = spark.createDataFrame([(".env", "A=1 # x\nexport B='q r'\n#C=1\nD=")], "path string, text string")
    assert sorted((r.line, r.name, r.value) for r in L.dotenv(env).collect()) == [(1, "A", "1"), (2, "B", "q r"), (4, "D", None)]


def test_ignore_rules():
    assert ignored("a/b.py", ["*.py"]) and not ignored("a/b.py", ["*.py", "!b.py"]) and ignored("out/x/b.py", ["out/"])
    assert ignored("a/b.py", [], ["a/*"]) and ignored("a/b.py", [], ["b*"]) and not ignored("a/b.py", [], ["a*.md"])


def test_hidden_names_are_read(spark, tmp_path):
    for name in ("__init__.py", "_p.py", "a.py", "n.txt"):
        (tmp_path / name).write_text("x = 1\n")
    assert {r["name"] for r in read_files(spark, str(tmp_path)).collect()} == {"__init__.py", "_p.py", "a.py"}


def test_watch_sees_every_change(spark, tmp_path):
    from attestra.streaming.watch import watch

    root, seen = tmp_path / "tree", []
    root.mkdir()
    (root / "a.py").write_text("def f(): pass\n")

    def run():
        watch(spark, str(root), lambda report, changes: seen.append((sorted((r.change for r in changes.collect())), report.facts.count())), f"file://{tmp_path}/ck", once=True).awaitTermination(120)

    run()
    (root / "b.py").write_text("def g(): pass\n")
    run()
    (root / "a.py").unlink()
    run()
    assert [s[0] for s in seen] == [["added"], ["added"], ["deleted"]] and [s[1] for s in seen] == [1, 2, 1]


def test_makefile_descriptions(spark):
    text = ".PHONY: build test\n.PHONY: late\n# builds\n## it all\nbuild: a b\n\tgo\n# after the recipe\ntest:\n\n# far\n\nlate:\nX = 1\n# own\nfree: build\n"
    got = {r.name: (r.line, r.value, r.description, r.phony) for r in L.makefile(spark.createDataFrame([("Makefile", text), ("n.mk", None)], "path string, text string")).collect()}
    assert got == {
        "make:build": (5, "a b", "Makefile target: build", True), "make:test": (8, None, "Makefile target: test", True), "make:late": (12, None, "Makefile target: late", False), "make:free": (15, "build", "own", False)}
