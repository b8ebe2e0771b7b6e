"""From extracted statements to canonical claims, and the whole build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import norm, slugify
from strandline.operators import align, arbitrate, graph, resolve
from strandline.plans.ontology import DEFAULT_AUTHORITY, Schema
from strandline.runtime import materialize
from strandline.sources.records import field_map_claims, hedged

# Specificity of structured and of free-text statements.
SPECIFICITY = {"A": 0.80, "B": 0.55}


def claim_key(*parts: Column) -> Column:
    """Key of a claim: equal parts give equal keys."""
    return F.concat(F.lit("claim:"), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 16))


def _keyed(x: DataFrame, surface: str, kind: Column, email: Column, index: DataFrame, out: str) -> DataFrame:
    """Adds column `out`: the entity key of a surface of a kind."""
    asked = x.where(kind == "Person").select(F.col(surface).alias("surface"), F.coalesce(email, F.lit("")).alias("email")).distinct()
    found = resolve.lookup(asked, index).select(F.col("surface").alias("_s"), F.col("email").alias("_e"), F.col("key").alias("_k"))
    x = x.join(found, (kind == "Person") & F.col(surface).eqNullSafe(F.col("_s")) & F.coalesce(email, F.lit("")).eqNullSafe(F.col("_e")), "left")
    artifact = F.when(F.col(surface).startswith("artifact:"), F.col(surface)).otherwise(F.concat(F.lit("artifact:"), "source_tool", F.lit(":"), slugify(F.col(surface))))
    key = F.when(kind == "Person", F.coalesce("_k", F.concat(F.lit("person:"), slugify(F.col(surface))))).when(kind == "Artifact", artifact).otherwise(F.concat(F.lower(kind), F.lit(":"), slugify(F.col(surface))))
    return x.withColumn(out, key).drop("_s", "_e", "_k")


def build_claims(extracted: DataFrame, docs: DataFrame, index: DataFrame, schema: Schema | None = None) -> DataFrame:
    """Canonical claims of extracted statements, one row per key (smallest evidence first).

    index: surface_norm, key, mentions, emails of resolved people. Statements whose
    document is missing keep their claim, without author and address hint.
    """
    schema = schema or Schema()
    doc_key = lambda tool, i: F.concat(F.lit("artifact:"), F.col(tool), F.lit(":"), slugify(F.col(i)))
    d = docs.where("doc_id is not null").groupBy(doc_key("tool", "doc_id").alias("_dk")).agg(F.max(F.struct(*(["loaded_at"] if "loaded_at" in docs.columns else []), "author_raw", "author_email", "body")).alias("_d"))
    names = ["subject_surface", "subject_type", "predicate", "object_surface", "object_type", "source_tool", "source_doc_id", "asserted_at", "confidence", "evidence_span", "tier"]
    x = extracted.select(*names).where("subject_surface is not null and object_surface is not null and predicate is not null").withColumn("source_artifact_key", doc_key("source_tool", "source_doc_id"))
    x = x.join(d, F.col("source_artifact_key") == F.col("_dk"), "left").withColumn("_author", F.col("_d.author_raw")).withColumn("_mail", F.col("_d.author_email"))
    x = _keyed(x, "subject_surface", F.col("subject_type"), F.col("_mail"), index, "subject_key")
    x = _keyed(x, "object_surface", F.col("object_type"), F.lit(""), index, "object_key")
    x = _keyed(x, "_author", F.lit("Person"), F.col("_mail"), index, "_by")
    trust = F.create_map(*[F.lit(v) for kv in schema.authority.items() for v in kv])
    tiers = F.create_map(*[F.lit(v) for kv in SPECIFICITY.items() for v in kv])
    x = x.select(
        claim_key(F.col("subject_key"), F.col("predicate"), F.col("object_key"), F.col("source_artifact_key"), F.col("asserted_at")).alias("claim_key"), "predicate", "subject_key", "object_key",
        F.when(F.col("object_type") == "Topic", F.col("object_surface")).otherwise("").alias("object_literal"), "source_artifact_key", "source_tool", F.when(F.coalesce("_author", F.lit("")) != "", F.col("_by")).otherwise("").alias("asserted_by_key"), "asserted_at",
        F.coalesce(trust[F.col("source_tool")], F.lit(DEFAULT_AUTHORITY)).alias("authority"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce(tiers[F.coalesce("tier", F.lit(""))], F.lit(0.5)).alias("specificity"),
        F.when(hedged(F.concat_ws(" ", "evidence_span", "_d.body"), schema.hedges), 1.0).otherwise(0.0).alias("hedging"), F.coalesce("evidence_span", F.lit("")).alias("evidence_span"), "tier",
    )
    rest = [c for c in x.columns if c not in ("claim_key", "evidence_span")]
    return x.groupBy("claim_key").agg(F.min(F.struct("evidence_span", *rest)).alias("r")).select("claim_key", "r.*")


_FACT = ["subject_surface", "subject_type", "predicate", "object_surface", "object_type", "source_tool", "source_doc_id", "asserted_at", "confidence", "evidence_span", "tier"]


def united_facts(docs: DataFrame, extracted: DataFrame | None, schema: Schema) -> DataFrame:
    """Statements of the field maps together with extracted ones, which are aligned with what the maps and titles establish; dropped ones are left out."""
    parts = []
    if "structured" in docs.columns:
        parts.append(materialize(field_map_claims(docs, schema).select(*_FACT), "mapped"))
    if extracted is not None:
        key = F.concat(F.lit("artifact:"), "tool", F.lit(":"), slugify(F.col("doc_id")))
        sure = extracted.select(*_FACT).where("tier = 'A'")
        known = align.known_entities(parts[0].unionByName(sure) if parts else sure, docs.where("doc_id is not null and trim(title) <> ''").select("title", key.alias("key")))
        parts.append(align.align(extracted.select(*_FACT), known, schema).where("action <> 'dropped'").select(*_FACT))
    if not parts:
        raise ValueError("build needs documents with native records, or extracted statements")
    return materialize(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), "facts")


def build(docs: DataFrame, extracted: DataFrame | None = None, schema: Schema | None = None, cap: int | None = 200) -> dict[str, DataFrame]:
    """Claims, decisions, clusters, people, nodes, edges and aliases of a corpus.

    docs may hold native records (structured), whose field maps give statements; extracted
    statements are aligned and added. cap: bucket limit of the resolution, None for none.
    """
    schema = schema or Schema()
    docs = latest_docs(docs)
    facts = united_facts(docs, extracted, schema)
    parts = resolve.resolve_parts(docs, facts, cap)
    clusters = materialize(parts["clusters"], "clusters")
    claims = materialize(arbitrate.arbitrate(build_claims(facts, docs, resolve.surface_index(clusters), schema), schema), "claims")
    aliases = clusters.select("key", "canonical", F.explode("surfaces").alias("alias")).where(norm(F.col("alias")) != norm(F.col("canonical"))).select("key", "alias")
    named = clusters.groupBy("key").agg(F.min("canonical").alias("name"))
    evidence = merge_evidence(parts["scored"], parts["member"])
    count = F.size(F.filter("surfaces", lambda s: norm(s) != norm(F.col("canonical"))))
    people = clusters.join(evidence, "cluster", "left").select("key", F.col("canonical").alias("name"), F.coalesce(F.get("emails", F.lit(0)), F.lit("")).alias("email"), count.alias("alias_count"), F.col("mentions").alias("mention_count"), F.array_join("tools", ",").alias("tools"), F.coalesce("evidence", F.lit("")).alias("merge_evidence"))
    edges = graph.assemble_edges(docs, claims).unionByName(aliases.select(F.lit("ALIAS_OF").alias("type"), graph.alias_key(F.col("alias")).alias("src"), F.col("key").alias("dst"))).distinct()
    return {"claims": claims, "decisions": arbitrate.decided(claims, schema), "clusters": clusters, "people": people, "nodes": graph.assemble_nodes(docs, claims, named, aliases), "edges": edges, "aliases": aliases}


def latest_docs(docs: DataFrame) -> DataFrame:
    """One row per (tool, doc_id): the last loaded where loads are known; rows without id drop out."""
    if "loaded_at" not in docs.columns:
        return docs.where("doc_id is not null").dropDuplicates(["tool", "doc_id"])
    w = Window.partitionBy("tool", "doc_id").orderBy(F.col("loaded_at").desc_nulls_last(), F.xxhash64(*[c for c in docs.columns]))
    return materialize(docs.where("doc_id is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n"), "docs")


def stats(built: dict[str, DataFrame]) -> DataFrame:
    """(what, name, n): nodes by label, edges by type, claims by status."""
    count = lambda t, c: built[t].groupBy(F.lit(t).alias("what"), F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return count("nodes", "label").unionByName(count("edges", "type")).unionByName(count("claims", "status"))


def people(built: dict[str, DataFrame], limit: int = 50) -> DataFrame:
    """The most mentioned people with their spellings."""
    return built["clusters"].select("key", "canonical", "surfaces", "mentions").orderBy(F.col("mentions").desc(), "key").limit(limit)


def merge_evidence(scored: DataFrame, member: DataFrame) -> DataFrame:
    """(cluster, evidence): different lines `a = b: reason` of the merges inside each cluster, joined and cut to 400."""
    m = scored.where("decision = 'merge'").join(member.select(F.col("id").alias("a"), F.col("cluster").alias("ca")), "a").join(member.select(F.col("id").alias("b"), F.col("cluster").alias("cb")), "b").where("ca = cb")
    lines = m.select(F.col("ca").alias("cluster"), F.concat("a", F.lit(" = "), "b", F.lit(": "), F.array_join("evidence", ", ")).alias("line"), "score").groupBy("cluster", "line").agg(F.max("score").alias("score"))
    # 400 characters hold no more than the first 100 lines, as each has four at least
    w = Window.partitionBy("cluster").orderBy(F.col("score").desc(), "line")
    top = lines.withColumn("rn", F.row_number().over(w)).where("rn <= 100")
    return top.groupBy("cluster").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda v: v["line"]), " | "), 1, 400).alias("evidence"))


def thread_records(messages: DataFrame) -> DataFrame:
    """Messages with their replies folded in: record (JSON text) gives body and participants.

    body is the message's text followed by those of its replies; participants are the repliers.
    """
    r = "struct<Message:struct<User:struct<userId:string,text:string>>,ThreadReplies:array<struct<User:struct<userId:string,text:string>>>>"
    x = messages.withColumn("_m", F.from_json("record", r))
    replies = F.coalesce(F.col("_m.ThreadReplies"), F.array().cast("array<struct<User:struct<userId:string,text:string>>>"))
    texts = F.concat(F.array(F.col("_m.Message.User.text")), F.transform(replies, lambda y: y["User"]["text"]))
    who = F.filter(F.transform(replies, lambda y: y["User"]["userId"]), lambda u: u.isNotNull() & (u != ""))
    return x.withColumn("body", F.trim(F.array_join(F.filter(texts, lambda t: t.isNotNull()), " "))).withColumn("participants", who).drop("_m")


def citations(docs: DataFrame) -> DataFrame:
    """(src, dst): documents that name another one as /docs/<id> in title or body, in any case."""
    ids = docs.select(F.lower("doc_id").alias("low"), F.col("doc_id").alias("dst")).where("dst is not null").distinct()
    text = F.concat_ws(" ", "title", "body") if "title" in docs.columns else F.col("body")
    said = docs.where("doc_id is not null").select(F.col("doc_id").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"/docs/([a-z0-9_\-]+)"), F.lit(1)))).alias("low"))
    return said.join(ids, "low").where("src <> dst").select("src", "dst").distinct()
