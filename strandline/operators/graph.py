"""The claim graph as tables: assembly, upserts, traversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import slugify
from strandline.runtime import broadcast_up_to, discard, materialize

SCALARS = {"string", "int", "bigint", "double", "float", "boolean", "smallint", "tinyint"}


def label_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(vertex, root): smallest vertex of each component of edges (a, b), by alternating star contractions.

    Every round links larger neighbours to the smallest one, then smaller ones
    to the smallest; both steps are map-side-combined minima and joins.
    """
    live, mark = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "stars"), None
    for _ in range(rounds):
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("x"), "m").distinct()
        large = materialize(large.where("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b")), "large")
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = materialize(small, "stars")
        # two 64-bit sums of hashes tell equal sets of edges
        last, mark = mark, tuple(after.agg(F.count(F.lit(1)), *[F.sum(F.xxhash64(F.lit(i), "a", "b").cast("decimal(38,0)")) for i in (1, 2)]).first())
        discard(large)
        discard(live)
        live = after
        if mark == last:
            break
    else:
        raise RuntimeError(f"components weren't finished after {rounds} rounds")
    roots = live.select(F.col("b").alias("vertex"), F.col("a").alias("root"))
    return roots.unionByName(live.select(F.col("a").alias("vertex"), F.col("a").alias("root"))).distinct()


def check_scalars(df: DataFrame) -> DataFrame:
    """Raises if a column holds anything but strings, numbers and booleans."""
    bad = [f"{c} {t}" for c, t in df.dtypes if t not in SCALARS]
    if bad:
        raise TypeError("only scalar properties can be stored: " + ", ".join(bad))
    return df


def upsert_nodes(stored: DataFrame, new: DataFrame, order: str = "version") -> DataFrame:
    """Nodes after an upsert by (label, id): per property the newest non-null value; properties unknown to one side are null there.

    `order` is a column of new that ranks its rows; stored rows rank lowest.
    """
    check_scalars(stored), check_scalars(new)
    x = stored.withColumn("_v", F.lit(-1).cast("bigint")).unionByName(new.withColumn("_v", F.col(order).cast("bigint")).drop(order), allowMissingColumns=True)
    props = [c for c in x.columns if c not in ("label", "id", "_v")]
    return x.groupBy("label", "id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_v"))).alias(c) for c in props])


def append_edges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Edges (type, src, dst) after an append without repeats."""
    return stored.select("type", "src", "dst").unionByName(new.select("type", "src", "dst")).dropDuplicates(["type", "src", "dst"])


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes by label and edges by type as parquet, replacing what was there."""
    check_scalars(nodes)
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{folder}/edges")


def entity_label(key: Column) -> Column:
    """Node label of a key's prefix; unknown prefixes are topics."""
    prefix = F.initcap(F.substring_index(key, ":", 1))
    return F.when(prefix.isin("Person", "Team", "Project", "Account", "Artifact", "Decision", "Topic", "Group"), prefix).otherwise("Topic")


def assemble_nodes(docs: DataFrame, claims: DataFrame, people: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """(label, key, name): artifacts, groups, entities of claims, claims; people (key, name) and aliases (alias) where given.

    Names are kept as their source has them: an entity bears the literal of a claim
    about it; without one the part of its key behind the first colon, hyphens as blanks.
    """
    artifact = docs.where("doc_id is not null").select(F.lit("Artifact").alias("label"), F.concat(F.lit("artifact:"), "tool", F.lit(":"), slugify(F.col("doc_id"))).alias("key"), F.coalesce(F.when(F.trim("title") != "", F.col("title")), F.col("doc_id")).alias("name"))
    group = docs.select(F.explode("acl_groups").alias("name")).where("name is not null").select(F.lit("Group").alias("label"), F.concat(F.lit("group:"), slugify(F.col("name"))).alias("key"), "name")
    literal = F.col("object_literal") if "object_literal" in claims.columns else F.lit(None).cast("string")
    pair = lambda k, n: F.struct(k.alias("key"), n.alias("literal"))
    ends = claims.select(F.explode(F.array(pair(F.col("subject_key"), F.lit(None).cast("string")), pair(F.col("object_key"), F.when(literal != "", literal)))).alias("e")).select("e.*").where("key is not null")
    tail = F.replace(F.regexp_replace("key", r"^[^:]*:", ""), F.lit("-"), F.lit(" "))
    entity = ends.where(~F.col("key").startswith("artifact:")).select(entity_label(F.col("key")).alias("label"), "key", F.coalesce("literal", tail).alias("name"), F.when(F.col("literal").isNull(), 1).otherwise(0).alias("rank"))
    claim = claims.where("claim_key is not null").select(F.lit("Claim").alias("label"), F.col("claim_key").alias("key"), F.col("predicate").alias("name"))
    rows = artifact.unionByName(group).unionByName(claim)
    if people is not None:
        rows = rows.unionByName(people.select(F.lit("Person").alias("label"), "key", "name"))
    if aliases is not None:
        rows = rows.unionByName(aliases.select(F.lit("Alias").alias("label"), alias_key(F.col("alias")).alias("key"), F.col("alias").alias("name")))
    rows = rows.withColumn("rank", F.lit(0)).unionByName(entity)
    return rows.groupBy("label", "key").agg(F.min(F.struct("rank", "name")).alias("r")).select("label", "key", "r.name")


def alias_key(alias: Column) -> Column:
    return F.concat(F.lit("alias:"), slugify(alias))


def assemble_edges(docs: DataFrame, claims: DataFrame) -> DataFrame:
    """(type, src, dst): visibility, claim ends, provenance, one fast edge per claim, and the decisions of arbitrated claims."""
    key = F.concat(F.lit("artifact:"), "tool", F.lit(":"), slugify(F.col("doc_id")))
    visible = docs.where("doc_id is not null").select(F.lit("VISIBLE_TO").alias("type"), key.alias("src"), F.explode("acl_groups").alias("g")).where("g is not null").select("type", "src", F.concat(F.lit("group:"), slugify(F.col("g"))).alias("dst"))
    fast = F.when(F.col("status") == "superseded", F.concat("predicate", F.lit("_SUPERSEDED"))).otherwise(F.col("predicate"))
    per = F.array(*[F.struct(F.lit(t).alias("type"), F.col("claim_key").alias("src"), F.col(c).alias("dst")) for t, c in (("ABOUT", "subject_key"), ("OBJECT", "object_key"), ("SOURCED_FROM", "source_artifact_key"), ("ASSERTED_BY", "asserted_by_key"))], F.struct(fast.alias("type"), F.col("subject_key").alias("src"), F.col("object_key").alias("dst")))
    of_claims = claims.where("claim_key is not null").select(F.explode(per).alias("e")).select("e.*").where("src is not null and dst is not null")
    edges = visible.unionByName(of_claims)
    if "winner_key" in claims.columns:
        decided = F.when(F.col("status") == "contested", "CONTRADICTS").otherwise("SUPERSEDES")
        edges = edges.unionByName(claims.where("status <> 'current' and winner_key is not null").select(decided.alias("type"), F.col("winner_key").alias("src"), F.col("claim_key").alias("dst")))
    return edges.distinct()


def neighbors(edges: DataFrame, starts: DataFrame, types: list[str], direction: str = "both", limit: int | None = None) -> DataFrame:
    """(id, type, neighbor) of each start id. limit: the first so many neighbours per id and type, in order of their ids."""
    if not types:
        raise ValueError("neighbors needs at least one edge type")
    e = edges.where(F.col("type").isin(*types))
    out = e.select("type", F.col("src").alias("id"), F.col("dst").alias("neighbor"))
    into = e.select("type", F.col("dst").alias("id"), F.col("src").alias("neighbor"))
    x = {"out": out, "in": into, "both": out.unionByName(into)}[direction].distinct().join(starts.select("id").distinct(), "id")
    if limit is not None:
        x = x.withColumn("rn", F.row_number().over(Window.partitionBy("id", "type").orderBy("neighbor"))).where(F.col("rn") <= limit).drop("rn")
    return x.select("id", "type", "neighbor")


def expand(edges: DataFrame, starts: DataFrame, types: list[str], hops: int) -> DataFrame:
    """(start, node, depth, path): one row per directed path of 1 to hops edges."""
    e = edges.where(F.col("type").isin(*types)).select("src", "dst")
    level = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("path")).distinct()
    out = None
    for depth in range(1, hops + 1):
        level = level.join(e, level["node"] == e["src"]).select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        one = level.withColumn("depth", F.lit(depth))
        out = one if out is None else out.unionByName(one)
    return out.select("start", "node", "depth", "path")


def peel(edges: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame | None]:
    """(core, chains) of undirected edges (a, b), a < b, each once: vertices with one neighbour are cut off, round by round.

    core has the edges that stay. chains has (vertex, path) of every vertex cut off: itself, its only
    neighbour at that time and so on, up to a vertex that stays; None if nothing was cut off.
    Both are exact after any number of rounds.
    """
    live, cut = materialize(edges, "live_edges"), []
    for _ in range(rounds):
        ends = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        leaf = materialize(ends.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b")).where("n = 1").select(F.col("a").alias("vertex"), F.col("b").alias("parent")), "leaves")
        if leaf.isEmpty():
            discard(leaf)
            break
        gone = leaf.select(F.least("vertex", "parent").alias("a"), F.greatest("vertex", "parent").alias("b"))
        seen = materialize(live.unionByName(gone).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n <> 2"), "seen_edges")
        # an edge seen thrice has a leaf at both ends: its smaller vertex stays
        alone = seen.where("n = 3").select(F.col("a").alias("vertex"), F.col("b").alias("parent"))
        cut.append(leaf.join(alone, ["vertex", "parent"], "left_anti"))
        live = seen.where("n = 1").select("a", "b")
    chains = None
    for leaf in reversed(cut):
        up = F.array("parent")
        if chains is not None:
            leaf, up = leaf.join(chains.select(F.col("vertex").alias("parent"), "path"), "parent", "left"), F.coalesce("path", up)
        step = materialize(leaf.select("vertex", F.concat(F.array("vertex"), up).alias("path")), "chains")
        chains = step if chains is None else chains.unionByName(step)
    return live, chains


def shortest_paths(edges: DataFrame, pairs: DataFrame, types: list[str], longest: int = 4, count: int = 5) -> DataFrame:
    """(src, dst, length, path): up to count shortest undirected simple paths of each pair (src, dst), in order of length and path.

    Trees that hang off the graph are cut off first: inside them a path is the only one and follows
    from the ways of both ends towards the rest, so a hub's leaves are never walked. Only pairs
    whose ways reach different vertices of the rest are searched there, once per pair of such vertices.
    """
    e = edges.where(F.col("type").isin(*types)).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a < b").distinct()
    core, chains = peel(e, longest)
    # by dst already, so that the distinct pairs and the join with their chains share a shuffle
    asked = pairs.select("src", "dst").where("src <> dst").repartition("dst").distinct()
    if chains is None:
        return grown_paths(core, asked, longest, count)
    up = pairs.select("src").where("src is not null").distinct().join(chains.select(F.col("vertex").alias("src"), F.col("path").alias("up")), "src", "left").select("src", F.coalesce("up", F.array("src")).alias("up"))
    x = asked.join(broadcast_up_to(materialize(up, "up"), 200_000), "src").join(chains.select(F.col("vertex").alias("dst"), F.col("path").alias("down")), "dst", "left")
    x = x.select("src", "dst", "up", F.coalesce("down", F.array("dst")).alias("down")).withColumn("meet", F.get(F.array_intersect("up", "down"), F.lit(0)))
    back = lambda n: F.reverse(F.slice("down", F.lit(1), n))
    inside = F.concat(F.slice("up", F.lit(1), F.array_position("up", F.col("meet")).cast("int")), back(F.array_position("down", F.col("meet")).cast("int") - 1))
    found = x.where("meet is not null").select("src", "dst", inside.alias("path")).select("src", "dst", (F.size("path") - 1).alias("length"), "path").where(F.col("length") <= longest)
    if core.isEmpty():
        return found
    far = materialize(x.where("meet is null").where(F.size("up") + F.size("down") - 2 < longest).select("src", "dst", "up", "down", F.element_at("up", -1).alias("a"), F.element_at("down", -1).alias("b")), "far_pairs")
    between = grown_paths(core, far.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), longest, count).select(F.col("src").alias("a"), F.col("dst").alias("b"), "path")
    whole = far.join(between, ["a", "b"]).select("src", "dst", F.concat(F.slice("up", F.lit(1), F.size("up") - 1), "path", back(F.size("down") - 1)).alias("path"))
    return found.unionByName(whole.select("src", "dst", (F.size("path") - 1).alias("length"), "path").where(F.col("length") <= longest))


def grown_paths(edges: DataFrame, pairs: DataFrame, longest: int, count: int) -> DataFrame:
    """(src, dst, length, path) of pairs over undirected edges (a, b), as shortest_paths().

    Both ends grow towards each other, a step at a time, and meet in the middle, so the frontier
    holds paths of half the length. Pairs that have `count` paths grow no further.
    """
    two = materialize(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"))), "both_ways")
    open_ = materialize(pairs.select("src", "dst").distinct(), "open_pairs")
    start = lambda c: open_.select(F.col(c).alias("start")).distinct().select("start", F.col("start").alias("node"), F.array("start").alias("path"))
    sides, found = {"src": start("src"), "dst": start("dst")}, None
    for length in range(1, longest + 1):
        side = "src" if length % 2 else "dst"
        level = sides[side].join(open_.select(F.col(side).alias("start")).distinct(), "start", "left_semi")
        level = level.join(two.select(F.col("src").alias("node"), F.col("dst").alias("to")), "node").where(~F.array_contains("path", F.col("to")))
        sides[side] = materialize(level.select("start", F.col("to").alias("node"), F.concat("path", F.array("to")).alias("path")), "frontier")
        left = sides["src"].select(F.col("start").alias("src"), "node", F.col("path").alias("lp"))
        right = sides["dst"].select(F.col("start").alias("dst"), "node", F.col("path").alias("rp"))
        back = F.reverse(F.slice(F.col("rp"), F.lit(1), F.size("rp") - 1))
        met = left.join(open_, "src").join(right, ["dst", "node"]).select("src", "dst", F.concat("lp", back).alias("path")).where(F.size(F.array_distinct("path")) == F.size("path"))
        w = Window.partitionBy("src", "dst").orderBy("path")
        met = met.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= count).select("src", "dst", F.lit(length).alias("length"), "path")
        found = materialize(met if found is None else found.unionByName(met), "paths")
        full = found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)
        open_ = materialize(open_.join(full, ["src", "dst"], "left_anti"), "open_pairs")
    w = Window.partitionBy("src", "dst").orderBy("length", "path")
    return found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= count).select("src", "dst", "length", "path")


def keyset_page(df: DataFrame, key: str, after: object, n: int = 1000) -> DataFrame:
    """The n rows that follow key `after` in key order."""
    return (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(n)


def label_of(key: Column, name: Column) -> Column:
    """Shown name of a key: its name, else its tail, hyphens as blanks unless it has a digit."""
    tail = F.regexp_replace(key, r"^[^:]*:", "")
    return F.when(F.coalesce(key, F.lit("")) == "", "?").otherwise(F.coalesce(name, F.when(tail.rlike("[0-9]"), tail).otherwise(F.replace(tail, F.lit("-"), F.lit(" ")))))
