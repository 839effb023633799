"""URL patterns through the graph of modules that include each other.

The elements of every ``urlpatterns`` list are patterns or edges to other modules, with the
path that stands before them.  A walk starts at each module; every round joins where the
walks stand with the edges from there and appends the edge's path, until no walk goes on.
A walk never enters a module twice, so that cycles end.

A module is named by its file's folders and stem, dotted, from any folder on (``a.b`` is
``x/a/b.py`` and ``x/a/b/__init__.py``); of several files that fit a name, the one with the
fewest folders, then the first by path.

Defined results: a module that no file has is not followed; its including element stays a
pattern of its own, as do all ``path`` elements; patterns of several elements alike stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import keep

# The calls that make patterns; the second kind takes regular expressions.
PATHS, REGEXES = ("path",), ("url", "re_path")
INCLUDED = r"^include\(\s*\(?\s*'([\w.]+)'"


def elements(nodes: DataFrame) -> DataFrame:
    """The elements of urlpatterns with route (null without one), regex and included (a module's name, or null)."""
    rows = nodes.filter("what = 'element' AND target = 'urlpatterns'").withColumn("own", F.col("name") == "include")
    rows = rows.filter(F.col("own") | F.col("name").isin(*PATHS, *REGEXES))
    text = lambda i: F.get("args", F.lit(i))["text"]
    by_name = F.when(F.col("own"), F.regexp_extract(text(0), r"^\(?\s*'([\w.]+)'", 1)).otherwise(F.regexp_extract(text(1), INCLUDED, 1))
    route = F.when(~F.col("own"), F.get("args", F.lit(0))["literal"])
    return rows.withColumn("regex", F.col("name").isin(*REGEXES)).withColumn("route", route).withColumn("included", F.nullif(by_name, F.lit("")))


def modules(paths: DataFrame) -> DataFrame:
    """module, path: the file of each dotted name."""
    parts = F.split(F.regexp_replace(F.regexp_replace("path", r"(?:/__init__)?\.py$", ""), r"^/+", ""), "/+")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))
    rows = paths.select("path").distinct().select("path", F.size(parts).alias("folders"), F.explode(names).alias("module"))
    return rows.groupBy("module").agg(F.min_by("path", F.struct("folders", "path")).alias("path"))


def edges(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """path, to, step: which module's list goes on in which other one, below what."""
    # of a regular expression, what stands between its anchors
    route = F.coalesce(F.when(F.col("regex"), F.regexp_replace("route", r"^\^|\$$", "")).otherwise(F.col("route")), F.lit(""))
    told = rows.filter("included IS NOT NULL").select("path", F.concat("below", route).alias("step"), "included")
    return told.join(modules(paths).select(F.col("module").alias("included"), F.col("path").alias("to")), "included").select("path", "to", "step")


def walks(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """root, path, before: every way from a module to one that it includes, with the path that leads there; each module reaches itself."""
    steps = keep(edges(rows, paths), "url-edges")
    alone = rows.select("path").distinct().select(F.col("path").alias("root"), "path", F.lit("").alias("before"))
    if steps.isEmpty():
        return alone
    at = keep(alone.withColumn("seen", F.array("path")), "url-walks")
    out = at
    while True:
        on = at.join(steps, "path").filter(~F.array_contains("seen", F.col("to")))
        at = keep(on.select("root", F.col("to").alias("path"), F.concat("before", "step").alias("before"), F.concat("seen", F.array("to")).alias("seen")), "url-walks")
        if at.isEmpty():
            return out.drop("seen")
        out = out.unionByName(at)


def resolved(nodes: DataFrame) -> DataFrame:
    """All patterns of every module and of what it includes: the columns of nodes (path is the module that the walk began at), whole (what stands before the route), route, regex."""
    rows = keep(elements(nodes), "url-elements")
    found = rows.filter("route <> ''").join(walks(rows, nodes.select("path").distinct()), "path")
    return found.withColumn("whole", F.concat("before", "below")).withColumn("path", F.col("root")).drop("root", "before")
