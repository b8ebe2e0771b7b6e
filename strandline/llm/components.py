"""Consolidating pairwise matches into groups (problem 3).

Randomised contraction: in each round every vertex hooks to the member of its
closed neighbourhood with the smallest hash under a fresh seed; edges are
relabelled to the hooks, self loops and repeats dropped, and the round repeats
on what is left. The expected number of vertices shrinks by a constant factor a
round whatever the shape of the graph (chains included), so the work is linear
and the rounds are logarithmic. The mappings of the rounds are then expanded
from the last to the first.

Vertices are the surfaces themselves, so nothing rests on hashes being unique.
Every round's tables are written to the shared folder. A hub's edges are cut by
the map-side minimum in the hook step and by the adaptive skew join in the
relabel step; no component or neighbourhood is ever gathered in one place.

Defined results: null ends or elements link nothing; self pairs and repeated
pairs change nothing; a vertex only in self pairs belongs to no group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.runtime import discard, materialize


def match_edges(merges: DataFrame, clusters: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Edges (a, b) from accepted merges and, as stars, from cluster rows."""
    pairs = merges.where(F.col("veto").isNull() & (F.col("score") >= threshold) & ~F.isnan("score")).select(F.col("left_surface").alias("a"), F.col("right_surface").alias("b"))
    members = F.array_distinct(F.filter("surfaces", lambda s: s.isNotNull()))
    stars = clusters.select(members.alias("m")).where(F.size("m") > 1).select(F.array_min("m").alias("a"), F.explode("m").alias("b"))
    return pairs.unionByName(stars).where("a is not null and b is not null and a <> b")


def connected(edges: DataFrame, seed: int = 17, max_rounds: int = 200) -> DataFrame:
    """(vertex, root): one root per connected component of edges (a, b)."""
    def ordered(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    spark = edges.sparkSession
    live = materialize(ordered(edges), "edges")
    maps: list[DataFrame] = []
    for i in range(max_rounds):
        rank = lambda c, i=i: F.struct(F.xxhash64(F.lit(seed + i), F.col(c)).alias("h"), F.col(c).alias("v"))
        both = live.select(F.col("a").alias("u"), rank("b").alias("n")).unionByName(live.select(F.col("b").alias("u"), rank("a").alias("n")))
        hooks = both.groupBy("u").agg(F.min("n").alias("n")).select("u", F.least(rank("u"), F.col("n"))["v"].alias("r"))
        hooks = materialize(hooks, f"hooks{i}")
        if not hooks.take(1):
            discard(hooks)
            break
        maps.append(hooks)
        on_a = live.join(hooks.select(F.col("u").alias("a"), F.col("r").alias("ra")), "a").select("b", "ra")
        on_b = on_a.join(hooks.select(F.col("u").alias("b"), F.col("r").alias("rb")), "b")
        after = materialize(ordered(on_b.select(F.col("ra").alias("a"), F.col("rb").alias("b"))), f"edges{i}")
        discard(live)
        live = after
    else:
        raise RuntimeError("contraction didn't end")
    if not maps:
        return spark.createDataFrame([], f"vertex {edges.schema['a'].dataType.simpleString()}, root {edges.schema['a'].dataType.simpleString()}")
    labels = maps[-1].select(F.col("u").alias("vertex"), F.col("r").alias("root"))
    for hooks in reversed(maps[:-1]):
        up = labels.select(F.col("vertex").alias("r"), "root")
        labels = hooks.join(up, "r", "left").select(F.col("u").alias("vertex"), F.coalesce("root", "r").alias("root"))
    return labels


def groups(edges: DataFrame) -> DataFrame:
    """(surface, group_surface): the smallest surface names the group."""
    labels = materialize(connected(edges), "labels")
    names = labels.groupBy("root").agg(F.min("vertex").alias("group_surface"))
    return labels.join(names, "root").select(F.col("vertex").alias("surface"), "group_surface")


def found(merges: DataFrame, clusters: DataFrame) -> DataFrame:
    return groups(match_edges(merges, clusters))


FOUND_SQL = """WITH RECURSIVE p AS (SELECT left_surface AS a, right_surface AS b FROM merges WHERE veto IS NULL AND score >= 0.75 AND NOT isnan(score)
  UNION SELECT m[1], x FROM (SELECT list_sort(list_distinct(list_filter(surfaces, lambda s: s IS NOT NULL))) AS m FROM clusters), unnest(m) t(x)),
e AS (SELECT a, b FROM p WHERE a <> b UNION SELECT b, a FROM p WHERE a <> b),
r(s, t) AS (SELECT a, b FROM e UNION SELECT r.s, e.b FROM r JOIN e ON r.t = e.a)
SELECT s AS surface, min(t) AS group_surface FROM r GROUP BY s"""
