import json
import random

import pytest
from pyspark.sql import functions as F

from attestra.operators import algebra, match
from attestra.plans.scan import scan
from attestra.plans.schema import CLAIMS, FACTS
from attestra.sources import sinks


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "__init__.py").write_text("def documented(a: int, b: str = 'x') -> bool:\n    pass\n\n\ndef undocumented_func(a, b):\n    pass\n")
    (root / "docs.md").write_text("# Doc\n\n```python\ndef documented(a: int, b: str = 'x') -> bool:\ndef fake_function(a, b):\n```\n")
    (root / "conf.toml").write_text("[db]\nport = 5\n")
    (root / "skip.py").write_text("def skipped(): pass\n")
    (root / ".docsignore").write_text("# none\nskip*.py\n")
    (root / "node_modules").mkdir()
    (root / "node_modules" / "m.py").write_text("def never(): pass\n")
    return root


def test_scan_finds_the_rename(spark, tree):
    report = scan(spark, str(tree))
    found = report.findings.filter("category <> 'undocumented'").collect()
    assert [(r.category, r.severity, r.fact.name, r.claim.name, round(r.confidence, 6)) for r in found] == [("renamed", "error", "undocumented_func", "fake_function", round(0.4, 6))]
    assert {r.name for r in report.facts.collect()} == {"documented", "undocumented_func", "db.port"}
    doc = json.loads("".join(sinks.sarif(report.findings)))
    assert {r["ruleId"] for r in doc["runs"][0]["results"]} == {"renamed", "undocumented"}
    whole = json.loads("".join(sinks.json_report(report.findings, "x", 1, 1)))
    assert whole["summary"]["errors"] == 1 and whole["has_errors"]
    assert algebra.fails(report.findings) and not algebra.fails(report.findings.limit(0))
    assert any("renamed: 1" in line for line in sinks.console(report.findings))


def sequential(facts, claims):
    """The matcher's rules, one claim after the other."""
    from attestra.functions.similarity import normalized, ratio

    last, by_last = {f["name"]: f for f in facts}, {}
    for f in facts:
        by_last.setdefault(f["name"].split(".")[-1], []).append(f)
    names, out, taken = lambda x: {p[0] for p in x["params"]}, [], set()
    for c in claims:
        if c["name"] is None or c["suppressed"]:
            continue
        f = last.get(c["name"])
        if c["kind"] == "cli_flag_ref":
            g = f or next((x for x in facts if c["name"].startswith("-") and x["kind"] == "cli_flag" and x["short"] == c["name"]), None)
            if g and g["kind"] == "cli_flag":
                taken.add(g["name"])
                continue
        if f is None and len(same := by_last.get(c["name"].split(".")[-1], [])) == 1:
            f = same[0]
        if f is not None:
            taken.add(f["name"])
            if (f["kind"], c["kind"]) in (("cli_flag", "cli_flag_ref"), ("config_key", "config_ref")):
                continue
            a, b = {p[0]: p for p in f["params"]}, {p[0]: p for p in c["params"]}
            for n in a.keys() | b.keys():
                if n not in b:
                    out.append((f["name"], c["name"], "missing_param", n))
                elif n not in a:
                    out.append((f["name"], c["name"], "extra_param", n))
                else:
                    out += [(f["name"], c["name"], k, n) for k, i in (("wrong_type", 1), ("wrong_default", 2)) if a[n][i] != b[n][i]]
            if f["ret"] != c["ret"]:
                out.append((f["name"], c["name"], "wrong_return_type", None))
            continue
        free = [x for x in facts if x["name"] not in taken and x["kind"] != "cli_flag" and names(x) == names(c)]
        if c["kind"] not in ("cli_flag_ref", "cli_usage"):
            near = [(-round(r * 100, 1), i, x) for i, x in enumerate(free) if (r := ratio(normalized(x["name"]), normalized(c["name"]))) >= 0.7]
            if near:
                x = min(near, key=lambda n: n[:2])[2]
                taken.add(x["name"])
                out.append((x["name"], c["name"], "fuzzy_renamed", None))
                continue
            if c["kind"] != "config_ref" and len(free) == 1 and ratio(free[0]["name"], c["name"]) >= 0.35:
                taken.add(free[0]["name"])
                out.append((free[0]["name"], c["name"], "renamed", None))
                continue
        if c["kind"] != "cli_usage" and not (c["kind"] == "cli_flag_ref" and c["name"] in ("--help", "--version")):
            out.append((None, c["name"], "documented_but_missing", None))
    return out + [(f["name"], None, "undocumented", None) for f in facts if f["name"] not in taken]


def test_match_equals_the_sequential_rules(spark):
    rng = random.Random(4)
    words = ["load", "save", "get_user", "getUser", "user.get", "read_file", "read_files", "a.load", "b.load", "run", "--out", "-o", "--help", "DB_URL"]
    for _ in range(4):
        def params():
            return [(rng.choice("ab"), rng.choice([None, "int"]), rng.choice([None, "1"])) for _ in range(rng.randrange(3))]

        facts = [{"name": rng.choice(words) + rng.choice(["", "2"]), "kind": rng.choice(["function", "cli_flag", "config_key"]), "params": params(), "ret": rng.choice([None, "x"]), "short": rng.choice([None, "-o"])} for _ in range(14)]
        claims = [
            {"name": rng.choice([*words, None]), "kind": rng.choice(["function_signature", "cli_flag_ref", "config_ref", "cli_usage"]), "params": params(), "ret": rng.choice([None, "x"]), "suppressed": rng.random() < 0.1}
            for _ in range(14)
        ]
        p = lambda ps: [(n, t, d, "positional", False, False) for n, t, d in ps]
        f = spark.createDataFrame([(i, x["name"], x["kind"], "s.py", 1, p(x["params"]), x["ret"], [], "", None, json.dumps({"short_flag": x["short"]})) for i, x in enumerate(facts)], FACTS)
        c = spark.createDataFrame([(i, "", x["kind"], "d.md", 1, x["name"], p(x["params"]), x["ret"], json.dumps({"suppressed": x["suppressed"]})) for i, x in enumerate(claims)], CLAIMS)
        key = lambda r: tuple(str(v) for v in r)
        got = sorted(((r.fact.name if r.fact else None, r.claim.name if r.claim else None, r.category, r.subject) for r in match.match(f, c).collect()), key=key)
        assert got == sorted(sequential(facts, claims), key=key)


def test_several_paths_and_state(spark, tmp_path):
    from attestra.plans.scan import scan_all

    for name, body in (("a", "def f(x): pass\ndef g(): pass\n"), ("b", "def h(): pass\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "m.py").write_text(body)
        (tmp_path / name / "d.md").write_text("Call `f(y)` and `gone()`.\n")
    state = f"file://{tmp_path}/state"
    report = scan_all(spark, [str(tmp_path / "a"), str(tmp_path / "b")], state=state)
    found = sorted((r.category, r.fact.name if r.fact else None, r.claim.name if r.claim else None, r.subject) for r in report.findings.collect())
    assert report.facts.count() == 3 and report.claims.count() == 4
    # of equal findings one stays: both parameters of f lie under other categories
    assert [x for x in found if x[0] in ("missing_param", "extra_param")] == [("extra_param", "f", "f", "y"), ("missing_param", "f", "f", "x")]
    assert sum(x[:3] == ("documented_but_missing", None, "gone") for x in found) <= 1 and sum(x[0] == "undocumented" and x[1] == "g" for x in found) <= 1
    assert [r.seq for r in report.findings.collect()] and len({r.seq for r in report.findings.collect()}) == report.findings.count()
    (tmp_path / "b" / "m.py").write_text("def h2(): pass\ndef gone(): pass\n")
    again = scan_all(spark, [str(tmp_path / "b")], state=state)
    assert {r.name for r in again.facts.collect()} == {"h2", "gone"}
    shown = lambda found: sorted((r.category, r.fact.name if r.fact else "", r.claim.name if r.claim else "") for r in found.collect())
    assert shown(again.findings) == [("documented_but_missing", "", "f"), ("undocumented", "h2", "")]
    # nothing is as recent as tomorrow: all is scanned
    assert {r.name for r in scan_all(spark, [str(tmp_path / "b")], state=state, since="2999-01-01").facts.collect()} == {"h2", "gone"}


def test_other_files_are_facts_and_claims(spark, tmp_path):
    from attestra.plans.scan import scan

    for name, text in {
        "u.ts": "export interface User {\n  id: number;\n  name?: string;\n}\n/**\n * Hi.\n * @param {string} who - x\n * @returns {void} y\n */\nexport function greet(who) {}\n",
        "s.graphql": "type Query {\n  users(first: Int): [User!]!\n}\n", "Dockerfile": "FROM a:1 AS b\nENV X=1\n", "Makefile": "build: dep\n\ttrue\n", ".env": "KEY=1\n", "m.tf": 'variable "region" {\n}\n',
        "r.rst": ".. py:function:: greet(who)\n", "pyproject.toml": "[project]\nname = 'p'\n",
    }.items():
        (tmp_path / name).write_text(text)
    report = scan(spark, str(tmp_path), full=True)
    facts = {(r.name, r.kind, r.line_number) for r in report.facts.collect()}
    assert {("User", "ts_interface", 1), ("users", "api_endpoint", 2), ("from.b", "config_key", 1), ("env.X", "config_key", 2), ("make:build", "config_key", 1), ("KEY", "config_key", 1), ("var.region", "config_key", 0), ("project.name", "config_key", 1)} <= facts
    claims = {(r.name, r.kind, tuple(p.name for p in r.parameters), r.return_type) for r in report.claims.collect()}
    assert {("greet", "parameter_description", ("who",), None), ("greet", "return_description", (), "void"), ("greet", "function_signature", ("who",), None)} <= claims
    assert report.findings.count() > 0


def test_patches(spark):
    from attestra.operators import lines as L
    from attestra.operators import match
    from attestra.sources import sinks

    p = lambda *x: [(n, t, d, "positional", False, False) for n, t, d in x]
    facts = spark.createDataFrame([(0, "f", "function", "s.py", 1, p(("a", "int", "2")), "str", [], "", None, "{}")], FACTS)
    claims = spark.createDataFrame([(0, "f", "function_signature", "d.md", 4, "f", p(("a", "float", "1")), "int", "{}"), (1, "zz", "config_ref", "d.md", 6, "ZZ_TOP", [], None, "{}")], CLAIMS)
    found = match.match(facts, claims)
    text = "one\ntwo\n```python\ndef f(a: float = 1) -> int:\n```\nset ZZ_TOP\nend\n"
    out = {r.category: r.patch for r in sinks.patches(found, L.lines(spark.createDataFrame([("d.md", text)], "path string, text string"))).collect()}
    head = "diff --git a/d.md b/d.md\n--- a/d.md\n+++ b/d.md\n"
    assert out["wrong_default"] == head + "@@ -1,7 +1,7 @@ [wrong_default]\n one\n two\n ```python\n-def f(a: float = 1) -> int:\n+def f(a: float = 2) -> int:\n ```\n set ZZ_TOP\n end\n"
    assert "+def f(a: int = 1) -> int:\n" in out["wrong_type"] and "@@ -1,6 +1,6 @@" in out["wrong_type"] and "+def f(a: float = 1) -> str:\n" in out["wrong_return_type"]
    assert out["documented_but_missing"] == head + "@@ -3,6 +3,5 @@ [documented_but_missing]\n ```python\n def f(a: float = 1) -> int:\n ```\n-set ZZ_TOP\n end\n \n"
    assert "".join(sinks.diff_view(found)).startswith("[wrong_default] d.md:4\n- f(a: float = 1) -> int\n+ f(a: int = 2) -> str\n")


def test_settings(tmp_path):
    from attestra.sources import settings

    assert settings.load(start=str(tmp_path)) == settings.Settings()
    (tmp_path / "in").mkdir()
    assert settings.load(str(settings.init(str(tmp_path)))) == settings.Settings()
    with pytest.raises(FileExistsError):
        settings.init(str(tmp_path))
    (tmp_path / settings.NAME).write_text('fail_on = "renamed"\n[scan]\nignore_patterns = ["*.txt"]\n[extractors]\nenabled = ["A"]\n')
    got = settings.load(start=str(tmp_path / "in"))
    assert (got.fail_on, got.ignore_patterns, got.enabled) == ("renamed", ["*.txt"], ["A"])
    for bad in ("threshold = 2\n", 'output_format = "x"\n', "[scan\n", "[extractors]\nenabled = 3\n"):
        (tmp_path / settings.NAME).write_text(bad)
        with pytest.raises(ValueError):
            settings.load(str(tmp_path / settings.NAME))


def test_rounding(spark):
    from attestra.functions.columns import py_round

    values = [0.0005, 0.0015, 0.0025, 0.1235, 0.12345, 0.0625, 0.1875, 2.675, 0.35, 1 / 3, 2 / 3, 1.0, 0.0, 91.65, 99.95, 33.25, 1e-9, 0.3125]
    table = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (1, 3):
        got = [r.y for r in table.select(py_round(F.col("x"), digits).alias("y")).collect()]
        assert got == [round(v, digits) for v in values], digits


def test_names_that_differ_by_numbers_do_not_meet(spark):
    """Of names whose shapes have too little in common no pair is made; those that are similar are all found, whatever their digits."""
    from difflib import SequenceMatcher

    from attestra.functions.similarity import normalized
    from attestra.operators import renames

    facts = [("k", i, f"m{i % 7}.f{100000 + 7919 * i % 900000}") for i in range(300)] + [("k", 1000, "load_file_1"), ("k", 1001, "loadFile2"), ("j", 1002, "load_file_3"), ("k", 1003, "")]
    claims = [("k", i, f"gone{100000 + 104729 * i % 900000}") for i in range(300)] + [("k", 1000, "load_files_9"), ("j", 1001, "load_fil_77"), ("k", 1002, facts[5][2] + "0"), ("k", 1003, "")]
    f = spark.createDataFrame([(k, (seq, name)) for k, seq, name in facts], "key string, fact struct<seq:long,name:string>")
    c = spark.createDataFrame([(k, (seq, name)) for k, seq, name in claims], "key string, claim struct<seq:long,name:string>")
    got = {(r.claim_seq, r.fact_seq) for r in renames.similar_pairs(f, c).collect()}
    alike = lambda a, b: SequenceMatcher(None, normalized(a), normalized(b)).ratio() >= 0.7
    assert got == {(q, p) for k, p, a in facts for j, q, b in claims if k == j and a and alike(a, b)} and (1000, 1000) in got
    shaped = lambda rows, side: rows.select("key", renames._shape(renames.normalize_name(f"{side}.name")).alias("shape"))
    met = renames.similar_shapes(shaped(f, "fact"), shaped(c, "claim")).collect()
    assert not [r for r in met if "g" in r.claim_shape and "n" in r.claim_shape] and len(met) < 10
