"""The command line, by calling main."""

import json

from attestra.cli import main


def test_commands(spark, tmp_path, capsys, monkeypatch):
    """Two commands in one process, an export, a baseline, and a watch with the options of a scan."""
    monkeypatch.chdir(tmp_path)
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "m.py").write_text("def load(path: str, mode='r'): pass\ndef save(): pass\n")
    (tree / "d.md").write_text("```\ndef load(path: str, mode='w')\n```\n`gone()`\n")
    assert main(["list-extractors"]) == 0 and "PythonExtractor" in capsys.readouterr().out
    assert main(["scan", str(tree), "--format", "json-lines"]) == 1
    rows = [json.loads(line) for line in capsys.readouterr().out.splitlines()]
    assert sorted(r["category"] for r in rows) == ["documented_but_missing", "undocumented", "wrong_default"]
    assert main(["baseline-export", str(tree), "--format", "json", "-o", f"{tmp_path}/out", "--exclude-category", "undocumented"]) == 0
    told = sorted(r.category for r in spark.read.json(f"{tmp_path}/out").collect())
    assert told == ["documented_but_missing", "wrong_default"]
    (tree / "d.md").write_text("`save()`\n")
    assert main(["scan", str(tree), "--watch", "--once", "--state", f"file://{tmp_path}/state", "--format", "json-lines", "--severity", "error"]) == 0
    assert capsys.readouterr().out == ""
