"""Column functions: names, texts and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_round(value: Column, digits: int) -> Column:
    """A number from 0 to 2**40, rounded as Python rounds: by its exact binary value, halves to even.

    ``round`` goes by the decimal that a number is shown as.  Here the number, times a power
    of two that makes it an integer, is divided as an integer.
    """
    bits = 60 - F.ceil(F.log2(F.greatest(value, F.lit(1e-6)))).cast("int")
    low, high = F.least(bits, F.lit(40)), F.greatest(bits - 40, F.lit(0))
    whole = lambda b: F.pow(F.lit(2.0), b).cast("long").cast("decimal(20,0)")
    unit = (whole(low) * whole(high)).cast("decimal(38,0)")
    n = ((value * F.pow(F.lit(2.0), low) * F.pow(F.lit(2.0), high)).cast("long").cast("decimal(20,0)") * F.lit(10**digits).cast("decimal(10,0)")).cast("decimal(38,0)")
    down = F.call_function("div", n, unit)
    rest = (n - down.cast("decimal(38,0)") * unit) * F.lit(2).cast("decimal(1,0)")
    up = F.when((rest > unit) | ((rest == unit) & (down % 2 == 1)), 1).otherwise(0)
    return F.when(value <= 1e-6, 0.0).otherwise((down + up).cast("double") / F.lit(float(10**digits)))


def last_segment(name: Column | str) -> Column:
    return F.substring_index(name, ".", -1)


def names_of(params: Column | str) -> Column:
    """Distinct parameter names, sorted; null parameters count as none."""
    return F.array_sort(F.array_distinct(F.transform(F.coalesce(params, F.array()), lambda p: p["name"])))


def param_key(params: Column | str) -> Column:
    """One text for a set of parameter names."""
    return F.to_json(names_of(params))


def last_param(params: Column | str, name: Column) -> Column:
    """The last parameter of that name, null if there is none."""
    return F.try_element_at(F.filter(params, lambda p: p["name"] == name), F.lit(-1))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0.0 where both are empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.coalesce(F.try_divide(both, F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def py_repr(value: Column) -> Column:
    """A text as Python shows it."""
    body = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for char, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(char), F.lit(shown))
    single = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    double = F.concat(F.lit('"'), body, F.lit('"'))
    return F.when(value.isNull(), "None").when(value.contains("'") & ~value.contains('"'), double).otherwise(single)


def signature(name: Column, params: Column, returns: Column) -> Column:
    """``name(p: T = d, ...) -> r``; an empty default is not shown."""
    shown = F.transform(params, lambda p: F.concat(
        p["name"],
        F.when(F.coalesce(p["type_annotation"], F.lit("")) != "", F.concat(F.lit(": "), p["type_annotation"])).otherwise(""),
        F.when(F.coalesce(p["default"], F.lit("")) != "", F.concat(F.lit(" = "), p["default"])).otherwise(""),
    ))
    tail = F.when(F.coalesce(returns, F.lit("")) != "", F.concat(F.lit(" -> "), returns)).otherwise("")
    return F.concat(name, F.lit("("), F.array_join(shown, ", "), F.lit(")"), tail)


# The weights of the five signals.
WEIGHTS = (("name_similarity", 0.35), ("param_overlap", 0.30), ("type_match", 0.15), ("location_proximity", 0.10), ("context_match", 0.10))


def weighted_confidence(signals: Column) -> Column:
    """The weighted sum of the signals, held to [0, 1], to three decimals; a null signal counts as 0."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS:
        total = total + F.lit(weight) * F.coalesce(signals[name], F.lit(0.0))
    return py_round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 3)


def type_match(fact: Column, claim: Column) -> Column:
    """Of the parameters annotated on both sides, the share whose types agree; 0.0 if there are none."""
    shared = F.filter(F.array_intersect(names_of(fact), names_of(claim)), lambda n: last_param(fact, n)["type_annotation"].isNotNull() & last_param(claim, n)["type_annotation"].isNotNull())
    equal = F.filter(shared, lambda n: last_param(fact, n)["type_annotation"] == last_param(claim, n)["type_annotation"])
    return F.coalesce(F.try_divide(F.size(equal).cast("double"), F.size(shared).cast("double")), F.lit(0.0))


def directories(path: Column) -> Column:
    """The path's parts less the file name."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def location_proximity(a: Column, b: Column) -> Column:
    """1.0 in one directory, else the common leading directories over the greater depth (0.0 for none), to three decimals."""
    x, y = directories(a), directories(b)
    pairs = F.arrays_zip(x.alias("x"), y.alias("y"))
    common = F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, p: F.struct(
        (s["n"] + (s["on"] & p["x"].eqNullSafe(p["y"])).cast("int")).alias("n"), (s["on"] & p["x"].eqNullSafe(p["y"])).alias("on")
    ), lambda s: s["n"])
    return F.when(x == y, 1.0).otherwise(py_round(F.coalesce(F.try_divide(common.cast("double"), F.greatest(F.size(x), F.size(y)).cast("double")), F.lit(0.0)), 3))


def context_match(a: Column, b: Column) -> Column:
    """Overlap of the directories as sets, to three decimals; 1.0 where both are empty."""
    x, y = F.array_distinct(directories(a)), F.array_distinct(directories(b))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(py_round(jaccard(x, y), 3))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).when(severity == "info", 2)
