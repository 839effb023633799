r"""Personal data: fixed formats, and boosted trees over candidates.  DataFrame functions only.

A pattern's matches and their places come from ``regexp_extract_all`` and
``split``, which cut the text at the same matches.  Patterns start only where a
run begins or the last match ended and never give characters back, so that long
runs cost no more than their length.

The method adds spans.  Two high-recall generators propose candidates: strings around an
at sign (or its spelled forms), and groups of digits.  Each has format and context
features in a few bins, counted with the marks that decide a base format masked: the
spelled at is read as the sign, and a plus with its country code is taken away.  Base
addresses and grouped base phone numbers, so masked, are the positive cases of the
boosted trees; other candidates whose form tells that they are none (an at sign without
a host, cards, addresses of machines, plain runs of digits) are the negative ones.
Spelled addresses and grouped numbers without a plus are not labelled: they are what the
trees judge.  A few written cases (``POSITIVE``, ``NEGATIVE``) count besides, so that
small inputs have cases of both kinds.  All cases are counted per combination of bins, at
most a few thousand rows; the trees fitted on these counts become one column expression.
The trees learn from three quarters of the documents.  Per generator, the threshold is
the lowest score from which at least ``PRECISION`` of the labelled cases of the other
quarter (and of the written ones) are positive; what is not labelled and scores above it
is added.

Documents are read once to count and once to find; nothing but counts leaves the tasks.
Places, coverage and redaction come from running sums and running largest ends over
the sorted spans (``_running``, chunk by chunk, about n ** 1.5 short steps for n spans).

Defined results: null text is the empty text, with no spans; repeated rows give
repeated rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LOCAL, HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{HOST}]++(?:\.[{HOST}]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
GENERATORS = {
    "address": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++(?:@|\x20?[\[(]at[\])]\x20?)[{LOCAL}]++",
    "number": r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6}(?:[\x20().-]?[0-9])*+",
}
GENERATOR_NEEDS = {"address": r"@|[\[(]at[\])]", "number": r"[0-9](?:[\x20().-]{0,2}[0-9]){6}"}
#: Characters on each side of a candidate in which context words count.
CONTEXT = 24
CONTEXT_WORD = r"(?i)mail|contact|phone|tel|call|mobile|fax|card|visa|account|iban|ssn|passport|address|name"
ROUNDS, RATE, PRECISION = 12, 0.5, 0.98
#: Written cases, each counted WEIGHT times: what candidates without a base format look like when they are personal data, and when not.
WEIGHT = 20
POSITIVE = {
    "address": ("write to jane@example.com now", "(max.muster@mail.example.org)", "a.b@x.example.net, or"),
    "number": ("call (555) 555-0100 now", "tel. 555-555-0100.", "phone 030 5550 1001", "reach us at 555 555 0100, or", "at (0555) 555-0100."),
}
NEGATIVE = {
    "address": ("run user@host now", "a@b", "x1@y2, then", "name@localhost"),
    "number": ("on 2024-01-02 it", "at 01.02.2024, then", "2024-01-02 10 20", "of 1 000 000 000 or", "ISBN 978-3-16-148410-0", "a 10.1.2.3.4 b", "up to 3.14159265 of", "in 1990-1999 and", "12345678", "id 5693240340017844 was", "1 2 3 4 5 6 7 8 9 10"),
}


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _chunks(values: Column) -> Column:
    """The array in about as many chunks as a chunk has elements."""

    def cut(v: Column, c: Column) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(0), F.floor(F.size(v) / c).cast("int")), lambda i: i * c < F.size(v)), lambda i: F.slice(v, i * c + 1, c))

    return _let(values, lambda v: _let(F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(v))).cast("int")), lambda c: cut(v, c)))


def _running(values: Column, kind: str, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """What ``add`` makes of all elements up to each one (of type ``kind``), from the chunks' own and those of the chunks before."""
    start = F.struct(zero.cast(kind).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return _let(add(acc["at"], x).cast(kind), lambda at: F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out")))

    own = lambda chunk: F.aggregate(chunk, start, step)
    before = lambda parts: F.concat(F.array(zero.cast(kind)), F.aggregate(F.transform(parts, lambda p: p["at"]), start, step, lambda acc: acc["out"]))
    return _let(F.transform(_chunks(values), own), lambda parts: F.flatten(_let(before(parts), lambda b: F.transform(
        parts, lambda p, i: F.transform(p["out"], lambda x: add(F.get(b, i), x).cast(kind))))))


def _matches(text: Column, pattern: str, needs: str) -> Column:
    """Array of (start, end, own, before, after): the matches of ``pattern``, with the text between them."""
    holds = text.contains(needs) if len(needs) == 1 else text.rlike(needs)
    empty = F.array().cast("array<struct<start:long,end:long,own:string,before:string,after:string>>")

    def placed(own: Column, gaps: Column) -> Column:
        lengths = F.transform(own, lambda m, i: (F.length(F.get(gaps, i)) + F.length(m)).cast("long"))
        return _let(_running(lengths, "long", F.lit(0), lambda x, y: x + y), lambda ends: F.transform(own, lambda m, i: F.struct(
            (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("own"),
            F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("after"))))

    whole = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda own: F.when(F.size(own) > 0, _let(F.split(text, pattern, -1), lambda gaps: placed(own, gaps))).otherwise(empty))
    return F.when(holds, whole).otherwise(empty)


def _digits(own: Column) -> Column:
    return F.regexp_replace(own, "[^0-9]", "")


def _valid(kind: str, own: Column) -> Column:
    if kind == "ip":
        return own.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.length(_digits(own)).between(13, 19) & F.call_function("luhn_check", _digits(own))
    if kind == "phone":
        return F.length(_digits(own)).between(9, 15)
    return F.lit(True)


def _masked(own: Column, kind: str) -> Column:
    """Without what decides a base format: a spelled at becomes the sign, a plus goes with its country code."""
    if kind == "address":
        return F.regexp_replace(own, r"\x20?[\[(]at[\])]\x20?", "@")
    return F.regexp_replace(own, r"^\+[0-9]{1,3}[\x20.-]?", "")


def _features(own: Column, before: Column, after: Column, kind: str) -> dict[str, Column]:
    """Binned features of the masked candidate; none tells whether a base format holds."""
    own = _masked(own, kind)
    digits = F.length(_digits(own))
    return {
        "kind": F.lit(list(GENERATORS).index(kind)),
        "digits": F.least(F.lit(6), F.floor(digits / 3)).cast("int"),
        "length": F.least(F.lit(5), F.floor(F.length(own) / 6)).cast("int"),
        "paren": own.startswith("(").cast("int"),
        "dots": own.contains(".").cast("int"),
        "groups": F.least(F.lit(3), F.length(F.regexp_replace(own, r"[^\x20.()-]", ""))).cast("int"),
        "dot_after_at": own.rlike(r"@.+\..").cast("int"),
        "left_open": before.rlike(r"(?:^|[\s(\[<:,;])$").cast("int"),
        "right_open": after.rlike(r"^(?:$|[\s)\]>:,;.!?])").cast("int"),
        "context": F.concat_ws(" ", before, after).rlike(CONTEXT_WORD).cast("int"),
    }


FEATURES = ("kind", "digits", "length", "paren", "dots", "groups", "dot_after_at", "left_open", "right_open", "context")


def _base(kind: str) -> Column:
    valid = F.filter(kind, lambda m: _valid(kind, m["own"]))
    return F.transform(valid, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def _form(own: Column, generator: str) -> Column:
    """grouped or plain, for numbers with a plus: plus_grouped or plus_plain; sign or spelled."""
    if generator == "address":
        return F.when(own.contains("@"), "sign").otherwise("spelled")
    grouped = F.when(_masked(own, generator).rlike(r"[0-9)][\x20().-]+[0-9]"), "grouped").otherwise("plain")
    return F.concat(F.when(own.startswith("+"), "plus_").otherwise(""), grouped)


def _candidates(generator: str) -> Column:
    features = lambda m: _features(m["own"], m["before"], m["after"], generator)
    return F.transform(generator, lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), F.lit(generator).alias("generator"), _form(m["own"], generator).alias("form"), *[c.alias(n) for n, c in features(m).items()]
    ))


def _added(trees: list[tuple], generator: str, limit: float) -> Column:
    chosen = F.filter("candidates", lambda c: (c["generator"] == generator) & c["label"].isNull() & (_score(trees, c) >= limit))
    return F.transform(chosen, lambda c: F.struct(c["generator"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))


COVERED = "struct<email:long,phone:long,any:long>"


def _covered(base: Column, candidates: Column) -> Column:
    """The candidates by start, with ``over``: whether a base email, a base phone number or any base span overlaps each."""
    far = 2**62

    def event(start: Column, kind: Column | None, end: Column, own: Column) -> Column:
        reach = lambda *kinds: F.when(kind.isin(*kinds), end).otherwise(0) if kind is not None else F.lit(0)
        begin = lambda *kinds: F.when(kind.isin(*kinds), start).otherwise(far) if kind is not None else F.lit(far)
        of = lambda f: F.struct(f("email").cast("long").alias("email"), f("phone").cast("long").alias("phone"), f(*KINDS).cast("long").alias("any"))
        return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), of(reach).alias("reach"), of(begin).alias("begin"), own.cast("int").alias("own"))

    events = F.array_sort(F.concat(
        F.transform(base, lambda b: event(b["start"], b["kind"], b["end"], F.lit(-1))), F.transform(candidates, lambda c, i: event(c["start"], None, c["end"], i))))
    each = lambda f: lambda x, y: F.struct(*[f(x[k], y[k]).alias(k) for k in ("email", "phone", "any")])
    same = lambda value: F.struct(*[F.lit(value).cast("long").alias(k) for k in ("email", "phone", "any")])

    def marked(e: Column) -> Column:
        ends = _running(F.transform(e, lambda x: x["reach"]), COVERED, same(0), each(F.greatest))
        begins = F.reverse(_running(F.transform(F.reverse(e), lambda x: x["begin"]), COVERED, same(far), each(F.least)))
        return _let(ends, lambda E: _let(begins, lambda B: F.filter(F.transform(e, lambda x, i: F.struct(
            x["own"].alias("own"), F.struct(*[((F.get(E, i)[k] > x["start"]) | (F.get(B, i)[k] < x["end"])).alias(k) for k in ("email", "phone", "any")]).alias("over"))), lambda x: x["own"] >= 0)))

    none = F.struct(*[F.lit(False).alias(k) for k in ("email", "phone", "any")])
    plain = F.transform(candidates, lambda c: c.withField("over", none))
    whole = _let(events, lambda e: F.transform(marked(e), lambda x: F.get(candidates, x["own"]).withField("over", x["over"])))
    return F.when((F.size(base) > 0) & (F.size(candidates) > 0), whole).otherwise(plain)


def _spans(docs: DataFrame, carry: bool) -> DataFrame:
    """doc_id, base spans by kind and start, and candidates with their features and label (null: to be judged; -1: neither counted nor judged)."""
    text = F.coalesce("text", F.lit(""))
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    found = docs.select(
        *own,
        F.col("doc_id").cast("long").alias("doc_id"),
        *[_matches(text, PATTERNS[k], NEEDS[k]).alias(k) for k in KINDS],
        *[_matches(text, GENERATORS[k], GENERATOR_NEEDS[k]).alias(k) for k in GENERATORS],
    )
    base = F.concat(*map(_base, KINDS))
    candidates = F.concat(*map(_candidates, GENERATORS))
    kept = ["row"] * carry
    found = found.select(*kept, "doc_id", base.alias("base"), candidates.alias("candidates"))
    label = lambda c: (
        F.when((c["generator"] == "address") & c["over"]["email"], 1)
        .when((c["generator"] == "number") & c["over"]["phone"], F.when(c["form"] == "plus_grouped", 1).otherwise(-1))
        .when(c["over"]["any"], 0)
        .when(~c["form"].isin("spelled", "grouped"), 0)
    )
    marked = F.transform(_covered(F.col("base"), F.col("candidates")), lambda c: c.withField("label", label(c)))
    return found.select(*kept, "doc_id", "base", marked.alias("candidates"))


def _written(docs: DataFrame) -> DataFrame:
    """The features of the written cases, with n and pos."""
    rows = [(g, text, label) for label, cases in ((1, POSITIVE), (0, NEGATIVE)) for g, texts in cases.items() for text in texts]
    table = docs.sparkSession.createDataFrame(rows, "generator string, text string, label int")
    own = [_matches(F.col("text"), GENERATORS[g], GENERATOR_NEEDS[g]).alias(g) for g in GENERATORS]
    cases = table.select("generator", "label", *own).select("generator", "label", F.explode(F.concat(*map(_candidates, GENERATORS))).alias("c"))
    cases = cases.filter("c.generator = generator")
    return cases.groupBy(*[F.col(f"c.{f}").alias(f) for f in FEATURES]).agg((F.count("*") * WEIGHT).alias("n"), (F.sum("label") * WEIGHT).alias("pos"))


def fit(cube: list[dict], rounds: int = ROUNDS, rate: float = RATE) -> list[tuple]:
    """Depth-two trees, boosted on logistic loss over counted cases: (f, t, g, u, four leaves)."""
    score, trees = [0.0] * len(cube), []
    cuts = [(f, t) for f in FEATURES for t in sorted({r[f] for r in cube})[:-1]]
    for _ in range(rounds):
        prob = [1 / (1 + math.exp(-s)) for s in score]
        grad = [r["pos"] - r["n"] * p for r, p in zip(cube, prob)]
        hess = [r["n"] * p * (1 - p) + 1e-6 for r, p in zip(cube, prob)]

        def best(rows: list[int]) -> tuple[float, str, int] | None:
            found, g, h = None, sum(grad[i] for i in rows), sum(hess[i] for i in rows)
            for f, t in cuts:
                left = [i for i in rows if cube[i][f] <= t]
                gl, hl = sum(grad[i] for i in left), sum(hess[i] for i in left)
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if gain > 1e-9 and (found is None or gain > found[0]):
                    found = (gain, f, t)
            return found

        rows = list(range(len(cube)))
        root = best(rows)
        if root is None:
            break
        sides, leaves = [], []
        for side in (True, False):
            own = [i for i in rows if (cube[i][root[1]] <= root[2]) == side]
            split = best(own)
            f, t = (split[1], split[2]) if split else (root[1], root[2])
            parts = [[i for i in own if (cube[i][f] <= t) == s] for s in (True, False)]
            value = [rate * sum(grad[i] for i in p) / (sum(hess[i] for i in p) + 1) for p in parts]
            sides.append((f, t))
            leaves.append(value)
            for p, v in zip(parts, value):
                for i in p:
                    score[i] += v
        trees.append((root[1], root[2], sides, leaves))
    return trees


def predict(trees: list[tuple], row: dict) -> float:
    total = 0.0
    for f, t, sides, leaves in trees:
        k = 0 if row[f] <= t else 1
        total += leaves[k][0 if row[sides[k][0]] <= sides[k][1] else 1]
    return total


def thresholds(trees: list[tuple], cube: list[dict], precision: float = PRECISION) -> dict[str, float]:
    """Per generator, the lowest score from which enough of the counted cases are positive."""
    out = {}
    for k, generator in enumerate(GENERATORS):
        rows = sorted(((predict(trees, r), r["n"], r["pos"]) for r in cube if r["kind"] == k), reverse=True)
        n = pos = 0
        out[generator] = math.inf
        for i, (s, m, p) in enumerate(rows):
            n, pos = n + m, pos + p
            if (i + 1 == len(rows) or rows[i + 1][0] < s) and pos >= precision * n:
                out[generator] = s
    return out


def _score(trees: list[tuple], c: Column) -> Column:
    total = F.lit(0.0)
    for f, t, sides, leaves in trees:
        side = [F.when(c[g] <= u, F.lit(v[0])).otherwise(F.lit(v[1])) for (g, u), v in zip(sides, leaves)]
        total = total + F.when(c[f] <= t, side[0]).otherwise(side[1])
    return total


def cases(docs: DataFrame) -> tuple[list[dict], list[dict]]:
    """The labelled cases by combination of bins, with n and pos: those to learn from, and the quarter of the documents that is held out.

    Both hold the written cases.
    """
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    # The outer form, as the plain one would have Spark push a filter, and with it all of the expression once more, below.
    labelled = _spans(docs, False).select(held.alias("held"), F.explode_outer("candidates").alias("c")).filter("c.label >= 0")
    counted = labelled.groupBy("held", *[F.col(f"c.{f}").alias(f) for f in FEATURES]).agg(F.count("*").alias("n"), F.sum("c.label").alias("pos"))
    rows = [r.asDict() for r in counted.collect()]  # two rows at most for each combination of bins
    written = [r.asDict() for r in _written(docs).collect()]
    out = []
    for side in (False, True):
        cube: dict[tuple, dict] = {}
        for r in [*(r for r in rows if r["held"] == side), *written]:
            of = cube.setdefault(tuple(r[f] for f in FEATURES), {f: r[f] for f in FEATURES} | {"n": 0, "pos": 0})
            of["n"], of["pos"] = of["n"] + r["n"], of["pos"] + r["pos"]
        out.append([cube[k] for k in sorted(cube)])
    return out[0], out[1]


def find(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id and its spans: array of (kind, start, end), base kinds as listed, then added ones; by start within a kind."""
    learnt, held = cases(docs)
    trees = fit(learnt)
    limit = thresholds(trees, held)
    added = [_added(trees, g, limit[g]) for g in GENERATORS if limit[g] < math.inf]
    return _spans(docs, carry).select(*["row"] * carry, "doc_id", F.concat("base", *added).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind, as ``[EMAIL]``; what overlaps goes under the first span's kind.

    Null texts stay null; ``n_chars``, where there is one, is that of the new text.
    """
    found = find(docs, carry=True)
    text = F.col("row.text")
    spans = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), F.upper(s["kind"]).alias("kind"))))
    ends = lambda s: F.concat(F.array(F.lit(0).cast("long")), _running(F.transform(s, lambda x: -x["end"]), "long", F.lit(0), F.greatest))
    # A span is told where it starts after all before it have ended; from there on the text is read.
    told = lambda s, e: F.filter(F.transform(s, lambda x, i: F.struct(F.get(e, i).alias("from"), x["start"].alias("start"), F.get(e, i + 1).alias("end"), x["kind"].alias("kind"))), lambda x: x["start"] >= x["from"])

    def written(chunk: Column) -> Column:
        """The chunk's pieces of text, cut from the part of the text that it covers."""
        first = F.get(chunk, F.lit(0))["from"]
        part = F.substr(text, first + 1, F.element_at(chunk, -1)["start"] - first)
        return _let(part, lambda t: F.array_join(F.transform(chunk, lambda x: F.concat(
            F.substr(t, x["from"] - first + 1, x["start"] - x["from"]), F.lit("["), x["kind"], F.lit("]"))), ""))

    whole = lambda s, e: F.concat(_let(told(s, e), lambda x: F.array_join(F.transform(_chunks(x), written), "")), F.substr(text, F.element_at(e, -1) + 1))
    done = _let(spans, lambda s: _let(ends(s), lambda e: whole(s, e)))
    new = F.when(F.size("spans") == 0, text).otherwise(done)
    out = found.select("row", new.alias("clean"))
    columns = {"text": F.col("clean"), "n_chars": F.when(F.col("clean").isNull(), F.col("row.n_chars")).otherwise(F.length("clean").cast("long"))}
    return out.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
