"""Matching after edits equals matching from the start."""

import json
import random

from attestra.operators import incremental
from attestra.operators.match import match
from attestra.plans.schema import CLAIMS, FACTS

WORDS = ["load", "save", "get_user", "getUser", "user.get", "read_file", "read_files", "a.load", "b.load", "run", "--out", "-o", "--help", "DB_URL"]


def made(spark, rng, facts, claims):
    p = lambda ps: [(n, None, d, "positional", False, False) for n, d in ps]
    f = spark.createDataFrame([(i, x[1], x[0], "s.py", 1, p(x[2]), None, [], "", None, json.dumps({"short_flag": x[3]})) for i, x in enumerate(facts)], FACTS)
    c = spark.createDataFrame([(i, "", x[0], "d.md", 1, x[1], p(x[2]), None, json.dumps({"suppressed": x[3]})) for i, x in enumerate(claims)], CLAIMS)
    return f, c


def one_fact(rng):
    return rng.choice(["function", "cli_flag", "config_key"]), rng.choice(WORDS) + rng.choice(["", "2"]), tuple((rng.choice("ab"), rng.choice([None, "1"])) for _ in range(rng.randrange(3))), rng.choice([None, "-o"])


def one_claim(rng):
    return rng.choice(["function_signature", "cli_flag_ref", "config_ref", "cli_usage"]), rng.choice([*WORDS, None]), tuple((rng.choice("ab"), None) for _ in range(rng.randrange(3))), rng.random() < 0.1


def edited(rng, rows, one):
    """Some rows go, some come anywhere, one repeats."""
    rows = [r for r in rows if rng.random() > 0.12]
    for _ in range(2):
        rows.insert(rng.randrange(len(rows) + 1), one(rng))
    return rows + rows[:1]


def shown(found):
    return sorted(str((r.fact.name if r.fact else None, r.claim.name if r.claim else None, r.category, r.severity, r.subject, round(r.confidence, 6))) for r in found.collect())


def test_updates_equal_matches_from_the_start(spark):
    rng = random.Random(11)
    facts, claims = [one_fact(rng) for _ in range(16)], [one_claim(rng) for _ in range(18)]
    state = incremental.start(*made(spark, rng, facts, claims))
    for _ in range(2):
        facts, claims = edited(rng, facts, one_fact), edited(rng, claims, one_claim)
        now = made(spark, rng, facts, claims)
        state = incremental.update(state, *now)
        assert shown(incremental.findings(state)) == shown(match(*now))


def test_an_edit_touches_little(spark):
    facts = [("function", f"name{i}", ((f"p{i}", None),), None) for i in range(60)]
    claims = [("function_signature", f"name{i}", ((f"p{i}", None),), False) for i in range(0, 60, 2)] + [("function_signature", "nameX", (("p3", None),), False)]
    state = incremental.start(*made(spark, random.Random(0), facts, claims))
    facts[3] = ("function", "other3", (("p3", None),), None)
    now = made(spark, random.Random(0), facts, [*claims, ("function_signature", "name5", (), False)])
    state = incremental.update(state, *now)
    assert state.touched == {"claims": 1, "facts": 1, "settled": 1}
    changed = {(r.category, r.fact.name if r.fact else None, r.claim.name if r.claim else None) for r in incremental.findings(state).collect()}
    assert {x for x in changed if x[1] == "other3" or x[2] in ("nameX", "name5")} == {("documented_but_missing", None, "nameX"), ("missing_param", "name5", "name5"), ("undocumented", "other3", None)}
