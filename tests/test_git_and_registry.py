import subprocess

import pytest

from attestra.operators import registry
from attestra.operators.python_facts import RULES
from attestra.sources import git


def test_hunks():
    diff = "+++ b/a.py\n@@ -1 +1 @@\n@@ -5,2 +6,0 @@\n@@ -9,0 +10,3 @@\n+++ /dev/null\n@@ -1 +0,0 @@\n"
    assert git.hunks(diff) == [("a.py", 1, 1), ("a.py", 10, 3)]


def test_cutoff():
    assert git.cutoff("2h", 10000.0) == 2800.0 and git.cutoff("1w", 604800.0) == 0.0
    with pytest.raises(ValueError):
        git.cutoff("soon")


def test_changes(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\ny = 2\n")
    run("add", ".")
    run("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("x = 1\ny = 3\nz = 4\n")
    root = str(tmp_path)
    assert git.is_repo(root) and git.ref_exists(root, "HEAD") and not git.ref_exists(root, "nothing")
    assert [r.path.rsplit("/", 1)[1] for r in git.changed_files(spark, root, "HEAD").collect()] == ["a.py"]
    assert sorted(r.line for r in git.changed_lines(spark, root, "HEAD").collect()) == [2, 3]
    assert git.changed_files(spark, root, "nothing") is None


def test_registry():
    rule = lambda n: n
    try:
        assert registry.register("Own")(rule) is rule and RULES["Own"] is rule
        with pytest.raises(ValueError):
            registry.register("Own")(lambda n: n)
    finally:
        RULES.pop("Own", None)


def test_text_rules(spark, tmp_path):
    """A rule over another kind of file takes part in a scan; what it raises is a row."""
    from attestra.plans.scan import scan

    def tables(path, text):
        for i, line in enumerate(text.split("\n"), 1):
            if line.startswith("CREATE TABLE "):
                yield {"name": line.split()[2], "kind": "table_schema", "line": i, "metadata": {"dialect": "any"}}
            elif line.startswith("BAD"):
                raise RuntimeError("bad line")

    (tmp_path / "a.sql").write_text("-- x\nCREATE TABLE users (id int)\n")
    (tmp_path / "b.sql").write_text("CREATE TABLE t (x int)\nBAD\n")
    (tmp_path / "d.md").write_text("See `users`.\n")
    try:
        registry.register_text("SqlTables", ".sql")(tables)
        with pytest.raises(ValueError):
            registry.register_text("SqlTables", ".ddl")(tables)
        report = scan(spark, str(tmp_path))
        assert sorted((r.name, r.kind, r.line_number, r.extractor) for r in report.facts.collect()) == [("t", "table_schema", 1, "SqlTables"), ("users", "table_schema", 2, "SqlTables")]
        assert [(r.path.rsplit("/", 1)[1], r.error) for r in report.errors.collect()] == [("b.sql", "RuntimeError: bad line")]
        assert [(r.category, r.fact.name) for r in report.findings.collect()] == [("undocumented", "t")]
        assert registry.text_suffixes(without=("SqlTables",)) == () and registry.text_suffixes() == (".sql",)
    finally:
        registry.TEXT_RULES.pop("SqlTables", None)


def test_tree_by_rounds(spark, tmp_path, monkeypatch):
    """A listing in many rounds equals a walk; excluded folders and ignored files are left out, rules take back."""
    import os

    from attestra.sources import files

    for name in ("a.py", ".hidden.py", "_p/b.py", "_p/q/c.md", "_p/q/r/s/d.py", ".git/e.py", "node_modules/f.py", "skip/g.py", "skip/keep.py", "h.txt", "gen/x.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / ".docsignore").write_text("skip/*\n!skip/keep.py\n# no\n")
    want = sorted(["a.py", ".hidden.py", "_p/b.py", "_p/q/c.md", "_p/q/r/s/d.py", "skip/keep.py"])
    monkeypatch.setattr(files, "WALK", 2)
    assert sorted(r.rel_path for r in files.list_tree(spark, str(tmp_path), globs=("gen/*",)).collect()) == want
    read = {r.rel_path: (r.text, r.size) for r in files.read_files(spark, str(tmp_path), ignore=("gen/*",)).collect()}
    assert read == {w: (w, len(w)) for w in want}
    assert [r.rel_path for r in files.list_tree(spark, str(tmp_path / "a.py")).collect()] == ["a.py"] and files.list_tree(spark, str(tmp_path / ".git")).count() == 0
    assert os.path.basename(files.read_files(spark, str(tmp_path / "a.py")).first().path) == "a.py"
