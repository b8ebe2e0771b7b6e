"""Entity resolution: mentions, blocking, scored pairs with vetoes, constrained clusters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import blocking_keys, is_email, is_handle, jaro_winkler, norm, slugify, surface_tokens
from strandline.operators.arbitrate import half_up
from strandline.operators.graph import label_components
from strandline.runtime import materialize

# Thresholds of the merge decision.
MERGE, REJECT = 0.75, 0.45


def mentions(docs: DataFrame, extracted: DataFrame) -> DataFrame:
    """(surface, email, tool, doc_key, thread): every mention of a person."""
    key = F.concat(F.lit("artifact:"), "tool", F.lit(":"), slugify(F.col("doc_id")))
    d = docs.where("doc_id is not null").select("tool", key.alias("doc_key"), F.when(F.col("tool") == "slack", F.concat(F.lit("slack:"), F.coalesce("title", F.lit("")))).otherwise(key).alias("thread"), "author_raw", "author_email", "participants_raw").distinct()
    author = d.select(F.col("author_raw").alias("surface"), F.coalesce("author_email", F.lit("")).alias("email"), "tool", "doc_key", "thread")
    part = d.select(F.explode("participants_raw").alias("surface"), F.lit("").alias("email"), "tool", "doc_key", "thread")
    c = extracted.select("source_tool", F.concat(F.lit("artifact:"), "source_tool", F.lit(":"), slugify(F.col("source_doc_id"))).alias("doc_key"), F.explode(F.array(F.struct(F.col("subject_type").alias("t"), F.col("subject_surface").alias("s")), F.struct(F.col("object_type").alias("t"), F.col("object_surface").alias("s")))).alias("x")).where("x.t = 'Person'")
    c = c.join(d.select("doc_key", "thread").distinct(), "doc_key", "left").select(F.col("x.s").alias("surface"), F.lit("").alias("email"), F.col("source_tool").alias("tool"), "doc_key", F.coalesce("thread", F.lit("")).alias("thread"))
    x = author.unionByName(part).unionByName(c).where(F.trim(F.coalesce("surface", F.lit(""))) != "").withColumn("surface", F.trim("surface"))
    return x.withColumn("email", F.lower(F.when((F.col("email") == "") & is_email(F.col("surface")), F.col("surface")).otherwise(F.col("email"))))


def candidates(found: DataFrame) -> DataFrame:
    """(surface_norm, email, surfaces, tools, threads, docs, mentions, display) grouped by normalised surface and address."""
    g = found.withColumn("surface_norm", norm(F.col("surface"))).groupBy("surface_norm", "email").agg(F.array_sort(F.collect_set("surface")).alias("surfaces"), F.array_sort(F.collect_set("tool")).alias("tools"), F.array_sort(F.collect_set(F.when(F.col("thread") != "", F.col("thread")))).alias("threads"), F.countDistinct("doc_key").alias("docs"), F.count(F.lit(1)).alias("mentions"))
    best = F.array_sort(F.transform("surfaces", lambda s: F.struct(F.when(F.size(F.split(F.trim(s), r"\s+")) > 1, 0).otherwise(1).alias("multi"), is_email(s).cast("int").alias("mail"), (-F.length(s)).alias("len"), s.alias("s"))))
    return g.withColumn("display", F.get(best, F.lit(0))["s"])


def candidate_pairs(cands: DataFrame, cap: int | None = 200) -> DataFrame:
    """(a, b): ids of candidates that share a blocking key, each pair once, a < b.

    cands: id, surface, email. Buckets of more than `cap` candidates are too unspecific to
    propose pairs (their members still meet through their other keys); cap=None keeps all.
    """
    b = cands.select("id", F.explode(blocking_keys(F.col("surface"), F.col("email"))).alias("key"))
    n = b.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    n = n.where(F.col("n") <= cap) if cap is not None else n
    b = b.join(n.select("key"), "key")
    x, y = b.select("key", F.col("id").alias("a")), b.select("key", F.col("id").alias("b"))
    return x.join(y, "key").where("a < b").select("a", "b").distinct()


def addressed(docs: DataFrame) -> DataFrame:
    """(author_norm, token): known name tokens that an author writes without bearing them."""
    known = docs.select(F.explode(F.concat(F.array("author_raw"), F.coalesce("participants_raw", F.array().cast("array<string>")))).alias("s")).select(F.explode(surface_tokens(F.col("s"))).alias("token")).where(F.length("token") > 2).distinct()
    own = F.concat(surface_tokens(F.col("author_raw")), surface_tokens(F.coalesce("author_email", F.lit(""))))
    said = docs.where((F.coalesce("author_raw", F.lit("")) != "") & (F.coalesce("body", F.lit("")) != "")).select(norm(F.col("author_raw")).alias("author_norm"), F.explode(F.array_except(F.split(norm(F.col("body")), " "), own)).alias("token")).distinct()
    return said.join(known, "token", "left_semi").select("author_norm", "token")


# The weights of the pieces of evidence.
SAME_MAIL, SPELLED, IDENTICAL, SAME_BOTH, INITIAL, SIMILAR, PER_TOKEN, MOST_TOKENS, CLOSE, NEAR, PER_THREAD, MOST_THREADS = 1.0, 0.6, 0.8, 0.7, 0.55, 0.45, 0.18, 0.35, 0.25, 0.10, 0.02, 0.10


def vetoed_pairs(pairs: DataFrame, cands: DataFrame, spoken: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) with the surfaces, addresses and tokens of both and their veto ('' if none).

    Addresses and words said are equi-joins; surnames are compared once per different pair of surnames.
    """
    side = lambda p: cands.select(F.col("id").alias(p), F.col("surface").alias(f"s_{p}"), F.lower(F.coalesce("email", F.lit(""))).alias(f"e_{p}"), surface_tokens(F.col("surface")).alias(f"t_{p}"), norm(F.col("surface")).alias(f"n_{p}"))
    end = lambda c, i: F.coalesce(F.element_at(F.when(F.size(c) > 0, F.col(c)), i), F.lit(""))
    lit = lambda p: materialize(side(p), f"side_{p}")
    x = pairs.join(lit("a"), "a").join(lit("b"), "b")
    x = x.select("*", end("t_a", -1).alias("la"), end("t_b", -1).alias("lb"), end("t_a", 1).alias("fa"), end("t_b", 1).alias("fb"))
    mails = (F.col("e_a") != "") & (F.col("e_b") != "")
    if spoken is not None:
        x = materialize(x, "sides")
        said = lambda p, q: x.select("a", "b", F.col(f"n_{p}").alias("author_norm"), F.explode(f"t_{q}").alias("token"))
        apart = said("a", "b").unionByName(said("b", "a")).join(spoken.select("author_norm", "token").distinct(), ["author_norm", "token"], "left_semi").select("a", "b").distinct()
        x = x.join(apart.withColumn("apart", F.lit(True)), ["a", "b"], "left")
    else:
        x = x.withColumn("apart", F.lit(None).cast("boolean"))
    first = F.when(mails & (F.col("e_a") != F.col("e_b")), "email_conflict").when(F.col("apart"), "distinct_speakers").otherwise("")
    full = (F.size("t_a") > 1) & (F.size("t_b") > 1) & (F.length("la") > 1) & (F.length("lb") > 1) & (F.col("la") != F.col("lb"))
    x = materialize(x.withColumn("veto", first).withColumn("ask", full & (F.col("veto") == "")).drop("apart"), "first_vetoes")
    surnames = materialize(x.where("ask").select("la", "lb").distinct(), "surnames").withColumn("jl", jaro_winkler("la", "lb"))
    x = x.join(surnames, ["la", "lb"], "left")
    return x.withColumn("veto", F.when(F.col("ask") & (F.col("jl") < 0.92), "surname_conflict").otherwise(F.col("veto"))).drop("ask", "jl")


def score_pairs(pairs: DataFrame, cands: DataFrame, spoken: DataFrame | None = None) -> DataFrame:
    """(a, b, score, evidence, veto, decision) of pairs (a, b). cands: id, surface, email, threads.

    Vetoes come first and are absolute; only pairs without one reach threads and string similarity.
    """
    every = materialize(vetoed_pairs(pairs, cands, spoken), "vetoed")
    none = F.array().cast("array<string>")
    barred = every.where("veto <> ''").select("a", "b", F.lit(0.0).alias("score"), none.alias("evidence"), "veto", F.lit("reject").alias("decision"))
    threads = lambda p: cands.select(F.col("id").alias(p), F.col("threads").alias(f"th_{p}"))
    x = every.where("veto = ''").join(threads("a"), "a").join(threads("b"), "b").withColumn("n_threads", F.size(F.array_intersect("th_a", "th_b"))).drop("th_a", "th_b")
    both = (F.size("t_a") > 0) & (F.size("t_b") > 0)
    initial = (F.length("fa") == 1) | (F.length("fb") == 1)
    need = (F.col("la") != "") & (F.col("la") == F.col("lb")) & (F.col("fa") != F.col("fb")) & ~initial
    x = materialize(x.withColumn("need", need), "open")
    names = materialize(x.where("need").select("fa", "fb").distinct(), "names").withColumn("jf", jaro_winkler("fa", "fb"))
    x = x.join(names, ["fa", "fb"], "left").withColumn("jn", jaro_winkler(F.array_join("t_a", " "), F.array_join("t_b", " ")))
    mails = (F.col("e_a") != "") & (F.col("e_b") != "")
    spells = lambda e, t: (F.col(e) != "") & (F.size(t) > 0) & (F.size(F.array_except(t, surface_tokens(F.col(e)))) == 0) & F.exists(t, lambda w: F.length(w) > 2)
    same_mail = F.when(mails & (F.col("e_a") == F.col("e_b")), SAME_MAIL).otherwise(0.0)
    spelled = F.when(spells("e_a", "t_b") | spells("e_b", "t_a"), SPELLED).otherwise(0.0)
    short = F.when(F.length("la") == 1, F.col("la")).otherwise(F.col("lb"))
    long_ = F.when(F.length("la") == 1, F.col("lb")).otherwise(F.col("la"))
    name = (
        F.when(both & (F.col("t_a") == F.col("t_b")), IDENTICAL)
        .when((F.col("la") != "") & (F.col("la") == F.col("lb")), F.when(F.col("fa") == F.col("fb"), SAME_BOTH).when(initial, F.when(F.substring("fa", 1, 1) == F.substring("fb", 1, 1), INITIAL).otherwise(0.0)).when(F.col("jf") > 0.85, SIMILAR).otherwise(0.0))
        .when(both & (F.col("fa") == F.col("fb")) & (is_handle(F.col("s_a")) | is_handle(F.col("s_b"))) & (F.length(short) == 1) & long_.startswith(short), INITIAL)
        .otherwise(0.0)
    )
    x = materialize(x.select("a", "b", "n_threads", same_mail.alias("mail"), spelled.alias("spelled"), name.alias("name"), F.size(F.filter(F.array_intersect("t_a", "t_b"), lambda w: F.length(w) > 2)).alias("shared"), F.when(both & (F.col("jn") > 0.90), CLOSE).when(both & (F.col("jn") > 0.80), NEAR).otherwise(0.0).alias("close")), "features")
    name = F.col("name")
    raw = F.col("mail") + F.col("spelled") + name + F.least(F.lit(MOST_TOKENS), F.col("shared") * F.lit(PER_TOKEN)) + F.col("close") + F.least(F.lit(MOST_THREADS), F.col("n_threads") * F.lit(PER_THREAD))
    evidence = F.filter(F.array(F.when(F.col("mail") > 0, "same email"), F.when(F.col("spelled") > 0, "email local part spells the name"), F.when(name == IDENTICAL, "identical normalized name").when(name == SAME_BOTH, "same surname and given name").when(name == INITIAL, "initial matches").when(name == SIMILAR, "given names similar"), F.when(F.col("shared") > 0, F.concat(F.col("shared").cast("string"), F.lit(" shared name tokens"))), F.when(F.col("close") > 0, "Jaro-Winkler close"), F.when(F.col("n_threads") > 0, F.concat(F.lit("co-occurred in "), F.col("n_threads").cast("string"), F.lit(" thread(s)")))), lambda e: e.isNotNull())
    score = half_up(F.least(F.lit(1.0), raw), 3)
    decision = F.when(score < REJECT, "reject").when(score >= MERGE, "merge").otherwise("adjudicate")
    return x.select("a", "b", score.alias("score"), evidence.alias("evidence"), F.lit("").alias("veto"), decision.alias("decision")).unionByName(barred)


def _greedy(p: pd.DataFrame) -> pd.DataFrame:
    """Merges of one component in order of score, refused where any two members are vetoed."""
    root: dict[str, str] = {}
    members: dict[str, set[str]] = {}
    banned: dict[str, set[str]] = {}
    for a, b, v in zip(p["a"], p["b"], p["veto"], strict=True):
        for x in (a, b):
            root.setdefault(x, x)
            members.setdefault(x, {x})
        if v != "":
            banned.setdefault(a, set()).add(b)
            banned.setdefault(b, set()).add(a)

    def find(x: str) -> str:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    m = p[(p["veto"] == "") & (p["decision"] == "merge")].sort_values(["score", "a", "b"], ascending=[False, True, True])
    for a, b in zip(m["a"], m["b"], strict=True):
        x, y = find(a), find(b)
        if x == y or any(banned.get(u, set()) & members[y] for u in members[x]):
            continue
        x, y = min(x, y), max(x, y)
        root[y] = x
        members[x] |= members.pop(y)
    ids = sorted(set(m["a"]) | set(m["b"]))
    return pd.DataFrame({"id": ids, "cluster": [find(i) for i in ids]})


def clusters(scored: DataFrame) -> DataFrame:
    """(id, cluster): greedy merging by score under vetoes, exact. scored: as of score_pairs(), best written already.

    Merges act inside components of the merge graph only. A component without a
    veto between its members is one cluster and needs no further work; the others
    run the greedy loop in one task each, whose size is their own number of pairs.
    """
    merge = scored.where("decision = 'merge'")
    comp = materialize(label_components(merge.select("a", "b")), "components")
    inside = scored.where("decision = 'merge' or veto <> ''").join(comp.select(F.col("vertex").alias("a"), F.col("root").alias("ra")), "a").join(comp.select(F.col("vertex").alias("b"), F.col("root").alias("rb")), "b").where("ra = rb")
    barred = inside.where("veto <> ''").select(F.col("ra").alias("root")).distinct()
    free = comp.join(barred, "root", "left_anti").select(F.col("vertex").alias("id"), F.col("root").alias("cluster"))
    hard = inside.join(barred.withColumnRenamed("root", "ra"), "ra", "left_semi")
    return free.unionByName(hard.groupBy("ra").applyInPandas(_greedy, "id string, cluster string"))


def roll_up(cands: DataFrame, member: DataFrame) -> DataFrame:
    """(cluster, key, canonical, surfaces, emails, tools, mentions): clusters with their canonical spelling. cands: id, surfaces, email, tools, mentions."""
    x = cands.join(member, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    s = x.select("cluster", F.explode("surfaces").alias("surface"))
    t = surface_tokens(F.col("surface"))
    good = F.struct((F.size(t) > 1).cast("int").alias("m"), (~F.exists(t, lambda w: F.length(w) == 1)).cast("int").alias("i"), (~is_email(F.col("surface"))).cast("int").alias("e"), (~is_handle(F.col("surface"))).cast("int").alias("h"), F.length("surface").alias("l"))
    ranked = s.groupBy("cluster").agg(F.max(good).alias("g"))
    canon = s.withColumn("g2", good).join(ranked, "cluster").where("g = g2").groupBy("cluster").agg(F.min("surface").alias("canonical"))
    g = x.groupBy("cluster").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("surfaces")))).alias("surfaces"), F.array_sort(F.collect_set(F.when(F.col("email") != "", F.col("email")))).alias("emails"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tools")))).alias("tools"), F.sum("mentions").alias("mentions"))
    return g.join(canon, "cluster").select("cluster", F.concat(F.lit("person:"), slugify(F.col("canonical"))).alias("key"), "canonical", "surfaces", "emails", "tools", "mentions")


def surface_index(rolled: DataFrame) -> DataFrame:
    """(surface_norm, key, mentions, emails): every spelling and the clusters it may mean."""
    return rolled.select(F.explode("surfaces").alias("s"), "key", "mentions", "emails").select(norm(F.col("s")).alias("surface_norm"), "key", "mentions", "emails").distinct()


def lookup(asked: DataFrame, index: DataFrame) -> DataFrame:
    """Adds key to asked (surface, email): the cluster with the address, else the most mentioned, else none."""
    q = asked.select("surface", "email").distinct().withColumn("surface_norm", norm(F.col("surface")))
    x = q.join(index, "surface_norm").withColumn("mail", F.array_contains("emails", F.lower(F.coalesce("email", F.lit("")))).cast("int"))
    best = x.groupBy("surface", "email").agg(F.min(F.struct((-F.col("mail")).alias("a"), (-F.col("mentions")).alias("b"), F.col("key").alias("key"))).alias("t"))
    best = best.select(F.col("surface").alias("_s"), F.col("email").alias("_e"), F.col("t.key").alias("key"))
    return asked.join(best, F.col("surface").eqNullSafe(F.col("_s")) & F.col("email").eqNullSafe(F.col("_e")), "left").drop("_s", "_e")


def resolve_parts(docs: DataFrame, extracted: DataFrame, cap: int | None = 200) -> dict[str, DataFrame]:
    """Clusters of people over documents and claims, with their candidates, scored pairs and members."""
    c = candidates(mentions(docs, extracted)).withColumn("id", F.concat_ws("|", "surface_norm", "email")).withColumnRenamed("display", "surface")
    c = materialize(c, "candidates")
    pairs = materialize(candidate_pairs(c, cap), "pairs")
    scored = materialize(score_pairs(pairs, c, addressed(docs)), "scored")
    member = clusters(scored)
    return {"clusters": roll_up(c, member), "scored": scored, "member": member, "candidates": c}


def resolve(docs: DataFrame, extracted: DataFrame, cap: int | None = 200) -> DataFrame:
    """Clusters of people over documents and claims."""
    return resolve_parts(docs, extracted, cap)["clusters"]
