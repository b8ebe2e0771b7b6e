"""Queries of the claim-graph operators over the shared tables, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.functions.time import parse_ts, parse_ts_sql
from strandline.operators import align, arbitrate, build, evaluate, graph, induce, resolve
from strandline.plans import ask
from strandline.plans.ontology import HEDGES, PREDICATES, Schema
from strandline.runtime import materialize, table
from strandline.sources import records
from strandline.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# --- orders as claims ---------------------------------------------------------------------------
# Invented for test data: the customer's order status is a functional fact, the priority its source.
_TRUST = {"1-URGENT": 1.0, "2-HIGH": 0.9, "3-MEDIUM": 0.8, "4-NOT SPECIFIED": 0.6, "5-LOW": 0.5}


def order_claims(s: SparkSession, d: str) -> DataFrame:
    trust = F.create_map(*[F.lit(x) for kv in _TRUST.items() for x in kv])
    return table(s, d, "orders").select(
        F.col("o_orderkey").alias("claim_key"), F.col("o_custkey").alias("subject_key"), F.lit("STATUS_IS").alias("predicate"), F.col("o_orderstatus").alias("object_key"), F.col("o_orderpriority").alias("source_tool"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("asserted_at"),
        F.coalesce(trust[F.col("o_orderpriority")], F.lit(0.5)).alias("authority"), F.lit(0.8).alias("specificity"), F.when(F.col("o_orderstatus") == "P", 1.0).otherwise(0.0).alias("hedging"),
    )


_ORDER_CLAIMS = """c AS (SELECT o_orderkey AS claim_key, o_custkey AS subject_key, o_orderstatus AS object_key, o_orderpriority AS source_tool, o_orderdate AS dated,
  CASE o_orderpriority WHEN '1-URGENT' THEN 1.0::DOUBLE WHEN '2-HIGH' THEN 0.9::DOUBLE WHEN '3-MEDIUM' THEN 0.8::DOUBLE WHEN '4-NOT SPECIFIED' THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS authority,
  CASE WHEN o_orderstatus = 'P' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hedging FROM orders {where})"""
_SCORED = """g AS (SELECT *, epoch_us(dated) AS ts, min(epoch_us(dated)) OVER w AS lo, max(epoch_us(dated)) OVER w AS hi, min(object_key) OVER w <> max(object_key) OVER w AS differ FROM c WINDOW w AS (PARTITION BY subject_key)),
k AS (SELECT subject_key, object_key, count(DISTINCT source_tool) AS corroboration FROM c GROUP BY ALL),
s AS (SELECT g.*, k.corroboration, floor((0.35::DOUBLE * authority + 0.30::DOUBLE * CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE (ts - lo)::DOUBLE / (hi - lo)::DOUBLE END + 0.15::DOUBLE * 0.8::DOUBLE + 0.15::DOUBLE * least(1.0::DOUBLE, (corroboration - 1)::DOUBLE / 2.0::DOUBLE) + (-0.05)::DOUBLE * hedging) * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE AS score
  FROM g JOIN k USING (subject_key, object_key)),
r AS (SELECT *, first_value(claim_key) OVER z AS winner_key, first_value(object_key) OVER z AS wo, first_value(score) OVER z AS wscore FROM s WINDOW z AS (PARTITION BY subject_key ORDER BY score DESC, strftime(dated, '%Y-%m-%d %H:%M:%S'), claim_key ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
a AS (SELECT *, CASE WHEN NOT differ OR wo = object_key THEN 'current' WHEN floor((wscore - score) * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE < 0.05::DOUBLE THEN 'contested' ELSE 'superseded' END AS status, floor((wscore - score) * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE AS gap FROM r)"""
_ARB = "WITH " + _ORDER_CLAIMS.format(where="") + ", " + _SCORED


@query("arbitrate_orders", _ARB + " SELECT claim_key, subject_key, object_key, corroboration, score, status FROM a")
def arbitrate_orders(s: SparkSession, d: str) -> DataFrame:
    return arbitrate.arbitrate(order_claims(s, d)).select("claim_key", "subject_key", "object_key", "corroboration", "score", "status")


@query("current_value", _ARB + " SELECT subject_key, any_value(object_key) AS object_key, count(*) AS n_support, max(score) AS score FROM a WHERE status = 'current' GROUP BY subject_key")
def current_value(s: SparkSession, d: str) -> DataFrame:
    x = arbitrate.arbitrate(order_claims(s, d)).where("status = 'current'")
    return x.groupBy("subject_key").agg(F.min("object_key").alias("object_key"), F.count(F.lit(1)).alias("n_support"), F.max("score").alias("score"))


@query("decisions_orders", _ARB + " SELECT winner_key AS winner, claim_key AS loser, CASE WHEN status = 'contested' THEN 'CONTRADICTS' ELSE 'SUPERSEDES' END AS relation, gap FROM a WHERE status <> 'current'")
def decisions_orders(s: SparkSession, d: str) -> DataFrame:
    return arbitrate.decisions(order_claims(s, d)).select("winner", "loser", "relation", "gap")


@query("as_of_orders", "WITH " + _ORDER_CLAIMS.format(where="WHERE o_orderdate <= TIMESTAMP '1998-01-01 00:00:00'") + ", " + _SCORED + " SELECT claim_key, subject_key, object_key, score, status FROM a")
def as_of_orders(s: SparkSession, d: str) -> DataFrame:
    return arbitrate.as_of(order_claims(s, d), "1998-01-01").select("claim_key", "subject_key", "object_key", "score", "status")


@query("status_histogram", _ARB + " SELECT source_tool, status, count(*) AS n FROM a GROUP BY ALL")
def status_histogram(s: SparkSession, d: str) -> DataFrame:
    return arbitrate.arbitrate(order_claims(s, d)).groupBy("source_tool", "status").agg(F.count(F.lit(1)).alias("n"))


@query("sufficiency_gate", _ARB + " SELECT subject_key, max(score) AS top_score, CASE WHEN max(score) < 0.35::DOUBLE THEN 'sufficiency' ELSE '' END AS gate FROM a WHERE status = 'current' GROUP BY subject_key")
def sufficiency_gate(s: SparkSession, d: str) -> DataFrame:
    x = arbitrate.arbitrate(order_claims(s, d)).where("status = 'current'").groupBy("subject_key").agg(F.max("score").alias("top_score"))
    return x.withColumn("gate", F.when(F.col("top_score") < Schema().sufficiency, "sufficiency").otherwise(""))


@query("coverage_gate", "SELECT c_custkey AS subject_key, c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def coverage_gate(s: SparkSession, d: str) -> DataFrame:
    held = order_claims(s, d).where("object_key = 'P'").select("subject_key")
    return table(s, d, "customer").select(F.col("c_custkey").alias("subject_key"), F.col("c_name").alias("name")).join(held, "subject_key", "left_anti")


# --- the claims table ------------------------------------------------------------------------------
_FUNCTIONAL = ", ".join(f"'{p}'" for p, v in PREDICATES.items() if v[2] and v[3] == "one")
_LATEST = """l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_key ORDER BY loaded_at DESC) AS rn FROM claims WHERE claim_key IS NOT NULL) WHERE rn = 1)"""
_CLAIM_SCORES = f"""WITH {_LATEST},
t AS (SELECT *, {parse_ts_sql('asserted_at')} AS ts, coalesce(CASE WHEN isnan(authority) THEN 0 ELSE authority END, 0)::DOUBLE AS au FROM l),
g AS (SELECT *, min(ts) OVER w AS lo, max(ts) OVER w AS hi, min(object_key) OVER w <> max(object_key) OVER w AS differ FROM t WINDOW w AS (PARTITION BY subject_key, predicate)),
k AS (SELECT subject_key, predicate, object_key, count(DISTINCT source_tool) AS support FROM t GROUP BY ALL),
s AS (SELECT g.*, support, floor((0.35::DOUBLE * au + 0.30::DOUBLE * CASE WHEN ts IS NULL THEN 0::DOUBLE WHEN hi = lo THEN 1::DOUBLE ELSE (ts - lo)::DOUBLE / (hi - lo)::DOUBLE END + 0.15::DOUBLE * coalesce(specificity, 0)::DOUBLE + 0.15::DOUBLE * least(1::DOUBLE, (support - 1)::DOUBLE / 2::DOUBLE) + (-0.05)::DOUBLE * coalesce(hedging, 0)::DOUBLE) * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE AS sc FROM g JOIN k USING (subject_key, predicate, object_key)),
r AS (SELECT *, differ AND predicate IN ({_FUNCTIONAL}) AS competes, first_value(object_key) OVER z AS wo, first_value(claim_key) OVER z AS wk, first_value(sc) OVER z AS ws FROM s WINDOW z AS (PARTITION BY subject_key, predicate ORDER BY sc DESC, coalesce(asserted_at, ''), claim_key ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
a AS (SELECT *, CASE WHEN NOT competes OR wo = object_key THEN 'current' WHEN floor((ws - sc) * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE < 0.05::DOUBLE THEN 'contested' ELSE 'superseded' END AS st FROM r)"""


def latest(s: SparkSession, d: str) -> DataFrame:
    return arbitrate.latest_claims(table(s, d, "claims"))


@query("arbitrate_claims", _CLAIM_SCORES + " SELECT claim_key, support AS corroboration, sc AS score, st AS status FROM a")
def arbitrate_claims(s: SparkSession, d: str) -> DataFrame:
    return arbitrate.arbitrate(latest(s, d)).select("claim_key", "corroboration", "score", "status")


@query("claim_counts", "SELECT source_tool, predicate, tier, count(*) AS n_rows, count(DISTINCT claim_key) AS n_claims FROM claims GROUP BY ALL")
def claim_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "claims").groupBy("source_tool", "predicate", "tier").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("claim_key").alias("n_claims"))


@query("corroborated_pairs", f"WITH {_LATEST} SELECT subject_key, predicate, object_key, count(DISTINCT source_tool) AS corroboration FROM l GROUP BY ALL HAVING count(DISTINCT source_tool) >= 2")
def corroborated_pairs(s: SparkSession, d: str) -> DataFrame:
    return latest(s, d).groupBy("subject_key", "predicate", "object_key").agg(F.countDistinct("source_tool").alias("corroboration")).where("corroboration >= 2")


_CARD = """per AS (SELECT predicate, lower(trim(s)) AS s, count(DISTINCT lower(trim(o))) AS k FROM t WHERE s IS NOT NULL AND o IS NOT NULL GROUP BY ALL)
SELECT predicate, count(*) AS n_subjects, floor(avg(k)::DOUBLE * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE AS avg_objects, floor(avg(CASE WHEN k > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE AS multi_share,
CASE WHEN count(*) < 3 THEN NULL WHEN avg(k) < 1.35 AND avg(CASE WHEN k > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) < 0.25 THEN 'one' ELSE 'many' END AS cardinality FROM per GROUP BY predicate"""


@query("cardinality_claims", "WITH t AS (SELECT predicate, subject_surface AS s, object_surface AS o FROM extracted_claims), " + _CARD)
def cardinality_claims(s: SparkSession, d: str) -> DataFrame:
    return induce.cardinality(table(s, d, "extracted_claims").select(F.col("subject_surface").alias("subject"), "predicate", F.col("object_surface").alias("object")))


@query("cardinality_orders", "WITH t AS (SELECT 'part_supplier' AS predicate, l_partkey::VARCHAR AS s, l_suppkey::VARCHAR AS o FROM lineitem UNION ALL SELECT 'order_part', l_orderkey::VARCHAR, l_partkey::VARCHAR FROM lineitem UNION ALL SELECT 'customer_nation', c_custkey::VARCHAR, c_nationkey::VARCHAR FROM customer), " + _CARD)
def cardinality_orders(s: SparkSession, d: str) -> DataFrame:
    li, cu = table(s, d, "lineitem"), table(s, d, "customer")
    t = lambda df, p, a, b: df.select(F.lit(p).alias("predicate"), F.col(a).cast("string").alias("subject"), F.col(b).cast("string").alias("object"))
    return induce.cardinality(t(li, "part_supplier", "l_partkey", "l_suppkey").unionByName(t(li, "order_part", "l_orderkey", "l_partkey")).unionByName(t(cu, "customer_nation", "c_custkey", "c_nationkey")))


_TEMPORAL = ", ".join(f"('{p}', {str(v[2]).upper()})" for p, v in PREDICATES.items())


@query("infer_cardinality", "WITH t AS (SELECT predicate, subject_surface AS s, object_surface AS o FROM extracted_claims), c AS (WITH " + _CARD + f") SELECT v.p AS predicate, CASE WHEN NOT temporal THEN 'many' ELSE coalesce(cardinality, 'one') END AS cardinality FROM (VALUES {_TEMPORAL}) v(p, temporal) LEFT JOIN c ON v.p = c.predicate")
def infer_cardinality(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "extracted_claims").select(F.col("subject_surface").alias("subject"), "predicate", F.col("object_surface").alias("object"))
    return induce.infer_cardinality(t, Schema().predicate_table(s).select("predicate", "temporal"))


_VOCAB = ", ".join(f"('{p}')" for p in PREDICATES)


@query("unused_predicates", f"SELECT p AS predicate FROM (VALUES {_VOCAB}) v(p) WHERE p NOT IN (SELECT predicate FROM claims WHERE predicate IS NOT NULL)")
def unused_predicates(s: SparkSession, d: str) -> DataFrame:
    return induce.unused_predicates(table(s, d, "claims"))


@query("relation_histogram", """WITH x AS (SELECT predicate_raw, concat_ws('->', subject_type, object_type) AS pair, count(*) AS k FROM extracted_claims WHERE predicate_raw IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY predicate_raw ORDER BY k DESC, pair) AS rn FROM x)
SELECT predicate_raw, sum(k)::BIGINT AS n, string_agg(CASE WHEN rn <= 3 THEN pair END, ', ' ORDER BY rn) AS type_pairs FROM r GROUP BY predicate_raw ORDER BY n DESC, predicate_raw LIMIT 120""")
def relation_histogram(s: SparkSession, d: str) -> DataFrame:
    return induce.relation_histogram(table(s, d, "extracted_claims"))


# --- records, envelopes, rules ---------------------------------------------------------------------
@query("field_map_events", "SELECT event_id, json_extract_string(props, '$.k') AS k, event_type FROM events WHERE coalesce(json_extract(props, '$.k')::VARCHAR, 'null') NOT IN ('null', '""', '0', '0.0', '-0.0', 'false', '[]', '{}')")
def field_map_events(s: SparkSession, d: str) -> DataFrame:
    v = F.try_parse_json("props")
    x = table(s, d, "events").select("event_id", F.try_variant_get(v, "$.k", "string").alias("k"), "event_type", F.to_json(F.try_variant_get(v, "$.k", "variant")).alias("j"))
    return x.where(records.truthy(F.col("j"))).drop("j")


def _side_sql(path: str, name: str) -> str:
    if path == "__self__":
        return f"self AS {name}, '\"x\"' AS j{name}"
    return f"json_extract_string(j, '$.{path}') AS {name}, coalesce(json_extract(j, '$.{path}')::VARCHAR, 'null') AS j{name}"


_FALSY = "('null', '\"\"', '0', '0.0', '-0.0', 'false', '[]', '{}')"
_RULES = "\nUNION ALL ".join(f"SELECT tool, doc_id, created_at, updated_at, {_side_sql(subj, 's')}, '{st}' AS st, '{p}' AS p, {_side_sql(obj, 'o')}, '{ot}' AS ot, {f"json_extract_string(j, '$.{at}')" if at else 'NULL'} AS said_at FROM k WHERE tool = '{t}'" for t, x in Schema().sources.items() for subj, st, p, obj, ot, at in x["rules"])
_MAPPED = ["source_tool", "source_doc_id", "subject_surface", "subject_type", "predicate", "object_surface", "object_type", "asserted_at"]


@query("field_map_claims", f"""WITH v AS (SELECT DISTINCT doc_id, tool, created_at, updated_at, structured::JSON AS j FROM raw_docs WHERE doc_id IS NOT NULL AND structured IS NOT NULL AND json_valid(structured) AND json_type(structured) = 'OBJECT'),
k AS (SELECT *, 'artifact:' || tool || ':' || {T.slug_sql('doc_id')} AS self FROM v),
r AS ({_RULES})
SELECT tool AS source_tool, doc_id AS source_doc_id, s AS subject_surface, st AS subject_type, p AS predicate, o AS object_surface, ot AS object_type,
  coalesce(strftime(make_timestamp({parse_ts_sql('said_at')}), '%Y-%m-%dT%H:%M:%S+00:00'), CASE WHEN updated_at <> '' THEN updated_at END, created_at) AS asserted_at FROM r WHERE js NOT IN {_FALSY} AND jo NOT IN {_FALSY}""")
def field_map_claims(s: SparkSession, d: str) -> DataFrame:
    """The rules of every tool of the schema over all of raw_docs."""
    docs = table(s, d, "raw_docs").select("doc_id", "tool", "structured", "created_at", "updated_at").distinct()
    return records.field_map_claims(docs).select(*_MAPPED)


def _acl_sql(paths: list[str]) -> str:
    one = lambda p: f"CASE json_type(j, '$.{p}') WHEN 'ARRAY' THEN from_json(json_extract(j, '$.{p}'), '[\"VARCHAR\"]') WHEN 'NULL' THEN []::VARCHAR[] ELSE CASE WHEN json_extract_string(j, '$.{p}') IS NULL THEN []::VARCHAR[] ELSE [json_extract_string(j, '$.{p}')] END END"
    return f"list_filter({' || '.join(map(one, paths))}, lambda x: x IS NOT NULL)" if paths else "[]::VARCHAR[]"


def _text_sql(path: str | None) -> str:
    return f"coalesce(json_extract_string(j, '$.{path}'), '')" if path else "''"


_ENVELOPES = "\nUNION ALL ".join(f"SELECT tool, doc_id, '{x['kind']}' AS kind, {_text_sql(x.get('title'))} AS title, {_text_sql(x.get('author'))} AS author_raw, {_acl_sql(x.get('acl', []))} AS acl_groups FROM v WHERE tool = '{t}' AND NOT list_contains(json_keys(j), '{x['doc_id']}')" for t, x in Schema().sources.items())


@query("envelope_all", f"WITH v AS (SELECT tool, doc_id, structured::JSON AS j FROM raw_docs WHERE doc_id IS NOT NULL AND json_valid(structured) AND json_type(structured) = 'OBJECT') {_ENVELOPES}")
def envelope_all(s: SparkSession, d: str) -> DataFrame:
    """Envelopes of every tool of the schema; the id, which the given records lack, is written into them."""
    docs, parts = table(s, d, "raw_docs").where("doc_id is not null"), []
    for tool, x in Schema().sources.items():
        head = F.regexp_replace(F.to_json(F.struct(F.col("doc_id").alias(x["doc_id"]))), r"\}$", "")
        rest = F.regexp_replace("structured", r"^\s*\{\s*", "")
        record = F.when(F.col("structured").rlike(r"^\s*\{"), F.concat(head, F.when(rest.startswith("}"), F.lit("")).otherwise(F.lit(", ")), rest))
        parts.append(records.envelope(docs.where(F.col("tool") == tool).select(record.alias("record")), tool).select("tool", "doc_id", "kind", "title", "author_raw", "acl_groups"))
    return reduce(DataFrame.unionByName, parts)


@query("artifact_rows", f"SELECT DISTINCT 'artifact:' || tool || ':' || {T.slug_sql('doc_id')} AS key, left(coalesce(CASE WHEN trim(title) <> '' THEN title END, doc_id), 300) AS name, left(coalesce(body, ''), 500) AS excerpt, kind, coalesce(CASE WHEN trim(updated_at) <> '' THEN updated_at END, created_at, '') AS updated FROM raw_docs WHERE doc_id IS NOT NULL")
def artifact_rows(s: SparkSession, d: str) -> DataFrame:
    return records.artifact_rows(table(s, d, "raw_docs")).select("key", "name", "excerpt", "kind", "updated").distinct()


_HEDGE = " OR ".join(f"contains(lower(coalesce(text, '')), '{m}')" for m in HEDGES)


@query("hedged_docs", f"SELECT doc_id, CASE WHEN {_HEDGE} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hedging FROM documents")
def hedged_docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.when(records.hedged(F.col("text")), 1.0).otherwise(0.0).alias("hedging"))


@query("worth_extracting", "SELECT doc_id, length(trim(text, ' ')) AS n FROM documents WHERE length(trim(text, ' ')) >= 40")
def worth_extracting(s: SparkSession, d: str) -> DataFrame:
    x = records.worth_extracting(table(s, d, "documents").withColumnRenamed("text", "body"))
    return x.select("doc_id", F.length(F.trim("body")).cast("bigint").alias("n"))


@query("keyset_page", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 1000")
def keyset_page(s: SparkSession, d: str) -> DataFrame:
    return graph.keyset_page(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 500, 1000)


@query("spread_sample", """WITH n AS (SELECT greatest(3, 40 // count(DISTINCT source)) AS cap FROM documents WHERE source IS NOT NULL), r AS (SELECT doc_id, source AS tool, length(text) AS len, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rn FROM documents WHERE text IS NOT NULL)
SELECT doc_id, tool, len FROM r, n WHERE rn <= cap ORDER BY len DESC, doc_id LIMIT 40""")
def spread_sample(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(F.col("source").alias("tool"), "doc_id", F.col("text").alias("body"))
    return induce.spread_sample(docs).select("doc_id", "tool", F.length("body").cast("bigint").alias("len"))


@query("profile_paths")
def profile_paths(s: SparkSession, d: str) -> DataFrame:
    return induce.profile_paths(table(s, d, "raw_docs").select("tool", F.col("structured").alias("record")))


@query("field_inventory")
def field_inventory(s: SparkSession, d: str) -> DataFrame:
    p = induce.profile_paths(table(s, d, "raw_docs").select("tool", F.col("structured").alias("record")))
    used = [(t, x) for t, c in Schema().sources.items() for x in {c[k] for k in ("doc_id", "title", "body", "author", "created_at", "updated_at") if c.get(k)} | {y for r in c["rules"] for y in (r[0], r[3], r[5]) if y}]
    return induce.field_inventory(p, s.createDataFrame(used, "tool string, path string"))


# --- text, blocking, resolution ----------------------------------------------------------------------
@query("norm_slug", f"SELECT DISTINCT author_raw, {T.norm_sql('author_raw')} AS n, {T.slug_sql('author_raw')} AS slug FROM raw_docs WHERE author_raw IS NOT NULL")
def norm_slug(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "raw_docs").where("author_raw is not null").select("author_raw").distinct().select("author_raw", T.norm(F.col("author_raw")).alias("n"), T.slugify(F.col("author_raw")).alias("slug"))


@query("name_tokens", f"SELECT DISTINCT surface, {T.tokens_sql('surface')} AS tokens FROM (SELECT subject_surface AS surface FROM extracted_claims WHERE subject_type = 'Person') WHERE surface IS NOT NULL")
def name_tokens(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "extracted_claims").where("subject_type = 'Person' and subject_surface is not null").select(F.col("subject_surface").alias("surface")).distinct()
    return x.select("surface", T.tokens(F.col("surface")).alias("tokens"))


_PARTS = "p AS (SELECT DISTINCT p_name AS id FROM part), t AS (SELECT id, " + T.tokens_sql("id") + " AS t FROM p)"
_KEYS = _PARTS + """, k AS (SELECT DISTINCT id, unnest(list_concat(['full:' || array_to_string(t, ' ')], CASE WHEN length(t[-1]) > 2 THEN ['last:' || t[-1], 'lastpre:' || left(t[-1], 4), 'li:' || left(t[1], 1) || t[-1]] ELSE [] END, list_transform(list_filter(t, lambda x: length(x) > 2), lambda x: 'tok:' || x))) AS key FROM t WHERE len(t) > 0)"""


@query("blocking_pairs", "WITH " + _KEYS + ", b AS (SELECT key FROM k GROUP BY key HAVING count(*) BETWEEN 2 AND 200) SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y USING (key) JOIN b USING (key) WHERE x.id < y.id")
def blocking_pairs(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "part").select(F.col("p_name").alias("id")).distinct().select("id", F.col("id").alias("surface"), F.lit("").alias("email"))
    return resolve.candidate_pairs(c)


@query("jw_pairs", "WITH " + _KEYS + ", b AS (SELECT key FROM k GROUP BY key HAVING count(*) BETWEEN 2 AND 200), q AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y USING (key) JOIN b USING (key) WHERE x.id < y.id) SELECT a, b, floor(jaro_winkler_similarity(a, b) * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE AS jw FROM q")
def jw_pairs(s: SparkSession, d: str) -> DataFrame:
    return blocking_pairs(s, d).select("a", "b", arbitrate.half_up(T.jaro_winkler("a", "b")).alias("jw"))


def _people(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(s, d, "raw_docs"), table(s, d, "extracted_claims")


def _is_email(x: str) -> str:
    return f"regexp_matches(trim(coalesce({x}, '')), '^[\\w.+-]+@[\\w-]+\\.[\\w.-]+$')"


def _surface_tokens(x: str) -> str:
    return T.tokens_sql(f"CASE WHEN {_is_email(x)} THEN lower(split_part({x}, '@', 1)) ELSE {x} END")


_CANDIDATES = f"""dd AS (SELECT DISTINCT tool, 'artifact:' || tool || ':' || {T.slug_sql('doc_id')} AS dk, title, author_raw, author_email, participants_raw FROM raw_docs WHERE doc_id IS NOT NULL),
d AS (SELECT DISTINCT *, CASE WHEN tool = 'slack' THEN 'slack:' || coalesce(title, '') ELSE dk END AS thread FROM (SELECT * EXCLUDE title, title FROM dd)),
dt AS (SELECT DISTINCT dk, thread FROM d), dm AS (SELECT DISTINCT tool, dk, thread, author_raw, author_email, participants_raw FROM d),
e AS (SELECT source_tool AS tool, 'artifact:' || source_tool || ':' || {T.slug_sql('source_doc_id')} AS dk, subject_surface AS s, subject_type AS t FROM extracted_claims UNION ALL SELECT source_tool, 'artifact:' || source_tool || ':' || {T.slug_sql('source_doc_id')}, object_surface, object_type FROM extracted_claims),
m AS (SELECT author_raw AS s, coalesce(author_email, '') AS mail, tool, dk, thread FROM dm UNION ALL SELECT unnest(participants_raw), '', tool, dk, thread FROM dm UNION ALL SELECT s, '', e.tool, e.dk, coalesce(thread, '') FROM e LEFT JOIN dt USING (dk) WHERE t = 'Person'),
x AS (SELECT trim(s) AS surface, lower(CASE WHEN mail = '' AND {_is_email('s')} THEN trim(s) ELSE mail END) AS email, tool, dk, thread FROM m WHERE trim(coalesce(s, '')) <> ''),
g AS (SELECT {T.norm_sql('surface')} AS surface_norm, email, list_sort(list(DISTINCT surface)) AS surfaces, list_sort(list(DISTINCT tool)) AS tools, list(DISTINCT CASE WHEN thread <> '' THEN thread END) AS threads, count(DISTINCT dk) AS docs, count(*) AS mentions FROM x GROUP BY 1, 2),
c AS (SELECT *, concat_ws('|', surface_norm, email) AS id, list_sort(list_transform(surfaces, lambda s: {{'a': CASE WHEN len(string_split_regex(trim(s), '\\s+')) > 1 THEN 0 ELSE 1 END, 'b': ({_is_email('s')})::INT, 'c': -length(s), 's': s}}))[1].s AS display FROM g)"""


@query("mention_candidates", f"WITH {_CANDIDATES} SELECT surface_norm, email, surfaces, tools, docs, mentions, display FROM c")
def mention_candidates(s: SparkSession, d: str) -> DataFrame:
    return resolve.candidates(resolve.mentions(*_people(s, d))).select("surface_norm", "email", "surfaces", "tools", "docs", "mentions", "display")


# Written from the rules of the survey's sections ER1-ER6, not from the code.
_SCORED_PAIRS = f"""WITH {_CANDIDATES},
u AS (SELECT id, display, email, list_filter(threads, lambda v: v IS NOT NULL) AS threads, {_surface_tokens('display')} AS t, {_surface_tokens('email')} AS et, {T.norm_sql('display')} AS n FROM c),
k AS (SELECT DISTINCT id, unnest(list_concat(CASE WHEN email <> '' THEN list_concat(['email:' || email], list_transform(list_filter(et, lambda v: length(v) > 2), lambda v: 'tok:' || v)) ELSE [] END, CASE WHEN len(t) > 0 THEN ['full:' || array_to_string(t, ' ')] ELSE [] END,
  CASE WHEN length(coalesce(t[-1], '')) > 2 THEN ['last:' || t[-1], 'lastpre:' || left(t[-1], 4), 'li:' || left(t[1], 1) || t[-1]] ELSE [] END, list_transform(list_filter(t, lambda v: length(v) > 2), lambda v: 'tok:' || v))) AS key FROM u),
b AS (SELECT key FROM k GROUP BY key HAVING count(*) BETWEEN 2 AND 200), p AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y USING (key) JOIN b USING (key) WHERE x.id < y.id),
names AS (SELECT author_raw AS s FROM raw_docs UNION ALL SELECT unnest(participants_raw) FROM raw_docs), known AS (SELECT DISTINCT unnest({_surface_tokens('s')}) AS token FROM names WHERE s IS NOT NULL),
said AS (SELECT DISTINCT {T.norm_sql('author_raw')} AS n, unnest(string_split({T.norm_sql('body')}, ' ')) AS token, list_concat({_surface_tokens('author_raw')}, {_surface_tokens("coalesce(author_email, '')")}) AS own FROM raw_docs WHERE coalesce(author_raw, '') <> '' AND coalesce(body, '') <> ''),
spoken AS (SELECT DISTINCT n, token FROM said JOIN known USING (token) WHERE length(token) > 2 AND NOT list_contains(own, token)),
ut AS (SELECT id, n, unnest(t) AS token FROM u),
apart AS (SELECT DISTINCT a, b FROM (SELECT a, b, x.n, y.token FROM p JOIN u x ON x.id = a JOIN ut y ON y.id = b UNION ALL SELECT a, b, y.n, x.token FROM p JOIN ut x ON x.id = a JOIN u y ON y.id = b) SEMI JOIN spoken USING (n, token)),
q AS (SELECT p.a, p.b, x.display AS da, y.display AS db, x.email AS ea, y.email AS eb, x.t AS ta, y.t AS tb, coalesce(x.t[-1], '') AS la, coalesce(y.t[-1], '') AS lb, coalesce(x.t[1], '') AS fa, coalesce(y.t[1], '') AS fb, len(list_intersect(x.threads, y.threads)) AS th, apart.a IS NOT NULL AS apart FROM p JOIN u x ON x.id = p.a JOIN u y ON y.id = p.b LEFT JOIN apart ON apart.a = p.a AND apart.b = p.b),
v AS (SELECT *, CASE WHEN ea <> '' AND eb <> '' AND ea <> eb THEN 'email_conflict' WHEN apart THEN 'distinct_speakers' WHEN len(ta) > 1 AND len(tb) > 1 AND length(la) > 1 AND length(lb) > 1 AND la <> lb AND jaro_winkler_similarity(la, lb) < 0.92 THEN 'surname_conflict' ELSE '' END AS veto FROM q),
f AS (SELECT *, len(ta) > 0 AND len(tb) > 0 AS both_, jaro_winkler_similarity(array_to_string(ta, ' '), array_to_string(tb, ' ')) AS jn, CASE WHEN length(la) = 1 THEN la ELSE lb END AS short, CASE WHEN length(la) = 1 THEN lb ELSE la END AS long_,
  (trim(da) NOT LIKE '% %' AND NOT {_is_email('da')}) OR (trim(db) NOT LIKE '% %' AND NOT {_is_email('db')}) AS handle,
  (ea <> '' AND len(tb) > 0 AND list_has_all({_surface_tokens('ea')}, tb) AND len(list_filter(tb, lambda w: length(w) > 2)) > 0) OR (eb <> '' AND len(ta) > 0 AND list_has_all({_surface_tokens('eb')}, ta) AND len(list_filter(ta, lambda w: length(w) > 2)) > 0) AS spelled FROM v),
r AS (SELECT a, b, veto, CASE WHEN ea <> '' AND ea = eb THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN spelled THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN both_ AND ta = tb THEN 0.8::DOUBLE WHEN la <> '' AND la = lb THEN CASE WHEN fa = fb THEN 0.7::DOUBLE WHEN length(fa) = 1 OR length(fb) = 1 THEN CASE WHEN left(fa, 1) = left(fb, 1) THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END WHEN jaro_winkler_similarity(fa, fb) > 0.85 THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END WHEN both_ AND fa = fb AND handle AND length(short) = 1 AND starts_with(long_, short) THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END
  + least(0.35::DOUBLE, len(list_filter(list_intersect(ta, tb), lambda w: length(w) > 2)) * 0.18::DOUBLE) + CASE WHEN both_ AND jn > 0.90 THEN 0.25::DOUBLE WHEN both_ AND jn > 0.80 THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END + least(0.10::DOUBLE, th * 0.02::DOUBLE) AS raw FROM f),
z AS (SELECT a, b, veto, CASE WHEN veto <> '' THEN 0.0::DOUBLE ELSE floor(least(1.0::DOUBLE, raw) * 1000::DOUBLE + 0.5::DOUBLE) / 1000::DOUBLE END AS score FROM r)
SELECT a, b, score, veto, CASE WHEN veto <> '' OR score < 0.45 THEN 'reject' WHEN score >= 0.75 THEN 'merge' ELSE 'adjudicate' END AS decision FROM z"""


@query("scored_pairs", _SCORED_PAIRS)
def scored_pairs(s: SparkSession, d: str) -> DataFrame:
    c = resolve.candidates(resolve.mentions(*_people(s, d))).withColumn("id", F.concat_ws("|", "surface_norm", "email")).withColumnRenamed("display", "surface")
    return resolve.score_pairs(resolve.candidate_pairs(c), c, resolve.addressed(table(s, d, "raw_docs"))).select("a", "b", "score", "veto", "decision")


@query("resolve_people")
def resolve_people(s: SparkSession, d: str) -> DataFrame:
    return resolve.resolve(*_people(s, d))


@query("merge_decisions", "SELECT merge_id, CASE WHEN veto IS NOT NULL OR score < 0.45 THEN 'reject' WHEN score >= 0.75 THEN 'merge' ELSE 'adjudicate' END AS decision FROM merges WHERE score IS NOT NULL")
def merge_decisions(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "merges").where("score is not null")
    return x.select("merge_id", F.when(F.col("veto").isNotNull() | (F.col("score") < resolve.REJECT), "reject").when(F.col("score") >= resolve.MERGE, "merge").otherwise("adjudicate").alias("decision"))


@query("cluster_lookup", f"""WITH i AS (SELECT DISTINCT {T.norm_sql('x')} AS n, canonical, mention_count AS m FROM (SELECT canonical, mention_count, unnest(surfaces) AS x FROM clusters) WHERE x IS NOT NULL),
q AS (SELECT DISTINCT left_surface AS surface FROM merges WHERE left_surface IS NOT NULL),
r AS (SELECT surface, canonical, row_number() OVER (PARTITION BY surface ORDER BY coalesce(m, 0) DESC, canonical) AS rn FROM q JOIN i ON i.n = {T.norm_sql('surface')})
SELECT q.surface, r.canonical AS key FROM q LEFT JOIN r ON q.surface = r.surface AND rn = 1""")
def cluster_lookup(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "clusters").select(F.explode("surfaces").alias("x"), F.col("canonical").alias("key"), F.coalesce("mention_count", F.lit(0)).alias("mentions")).where("x is not null")
    index = c.select(T.norm(F.col("x")).alias("surface_norm"), "key", "mentions", F.array().cast("array<string>").alias("emails")).distinct()
    asked = table(s, d, "merges").where("left_surface is not null").select(F.col("left_surface").alias("surface"), F.lit("").alias("email")).distinct()
    return resolve.lookup(asked, index).select("surface", "key")


# --- alignment ---------------------------------------------------------------------------------------
@query("oriented_claims", """WITH spec AS (SELECT * FROM (VALUES """ + ", ".join(f"('{p}', {list(v[0])!r}, {list(v[1])!r}, '{v[3]}', {repr(v[4]) if v[4] else 'NULL'})" for p, v in PREDICATES.items()) + """) v(p, dom, rng, card, inv)),
x AS (SELECT e.*, dom, rng, card, inv, list_contains(dom, subject_type) AND list_contains(rng, object_type) AS fits, list_contains(dom, object_type) AND list_contains(rng, subject_type) AS turned FROM extracted_claims e LEFT JOIN spec ON predicate = p),
y AS (SELECT xc_id, loaded_at, predicate, dom IS NOT NULL AS known, coalesce(fits, FALSE) AS fits, coalesce(turned, FALSE) AS turned, card, inv, CASE WHEN dom IS NOT NULL AND NOT coalesce(fits, FALSE) AND coalesce(turned, FALSE) THEN object_type ELSE subject_type END AS st, CASE WHEN dom IS NOT NULL AND NOT coalesce(fits, FALSE) AND coalesce(turned, FALSE) THEN subject_type ELSE object_type END AS ot FROM x),
z AS (SELECT *, known AND NOT fits AND NOT turned AS dropped, known AND (fits OR turned) AND predicate = 'ASSIGNED_TO' AND st IN ('Project', 'Account') AND ot IN ('Person', 'Team') AS remapped FROM y),
w AS (SELECT *, CASE WHEN remapped THEN 'OWNED_BY' ELSE predicate END AS p2 FROM z),
u AS (SELECT w.*, spec.card AS c2, i.card AS ci, i.dom AS di, i.rng AS ri, spec.inv AS i2 FROM w LEFT JOIN spec ON p2 = spec.p LEFT JOIN spec i ON spec.inv = i.p)
SELECT xc_id, CASE WHEN known AND NOT dropped AND c2 <> 'one' AND ci = 'one' AND list_contains(di, ot) AND list_contains(ri, st) THEN i2 ELSE p2 END AS predicate,
CASE WHEN NOT known THEN 'unmapped' WHEN dropped THEN 'dropped' WHEN c2 <> 'one' AND ci = 'one' AND list_contains(di, ot) AND list_contains(ri, st) THEN 'inverted' WHEN remapped THEN 'remapped' WHEN NOT fits AND turned THEN 'flipped' ELSE 'kept' END AS action FROM u""")
def oriented_claims(s: SparkSession, d: str) -> DataFrame:
    return align.orient(table(s, d, "extracted_claims")).select("xc_id", "predicate", "action")


@query("aligned_claims")
def aligned_claims(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "extracted_claims")
    return align.align(x, align.known_entities(x.where("tier = 'A'"))).select("xc_id", "subject_surface", "subject_type", "predicate", "object_surface", "object_type", "action")


# --- graph ----------------------------------------------------------------------------------------------
def star_edges(s: SparkSession, d: str) -> DataFrame:
    e = lambda t, ty, a, pa, b, pb: table(s, d, t).select(F.lit(ty).alias("type"), F.concat(F.lit(pa), F.col(a).cast("string")).alias("src"), F.concat(F.lit(pb), F.col(b).cast("string")).alias("dst"))
    x = e("nation", "IN_REGION", "n_nationkey", "nation:", "n_regionkey", "region:").unionByName(e("customer", "IN_NATION", "c_custkey", "customer:", "c_nationkey", "nation:")).unionByName(e("supplier", "IN_NATION", "s_suppkey", "supplier:", "s_nationkey", "nation:"))
    return x.unionByName(e("orders", "PLACED_BY", "o_orderkey", "order:", "o_custkey", "customer:")).distinct()


_STAR = """e AS (SELECT 'IN_REGION' AS type, 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation UNION SELECT 'IN_NATION', 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer UNION SELECT 'IN_NATION', 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION SELECT 'PLACED_BY', 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders)"""


@query("graph_edge_counts", "WITH " + _STAR + " SELECT type, count(*) AS n, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM e GROUP BY type")
def graph_edge_counts(s: SparkSession, d: str) -> DataFrame:
    return star_edges(s, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"))


@query("neighbors_both", "WITH " + _STAR + " SELECT dst AS id, type, src AS neighbor FROM e WHERE type IN ('IN_NATION', 'IN_REGION') AND dst LIKE 'nation:%' UNION SELECT src, type, dst FROM e WHERE type IN ('IN_NATION', 'IN_REGION') AND src LIKE 'nation:%'")
def neighbors_both(s: SparkSession, d: str) -> DataFrame:
    starts = table(s, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"))
    return graph.neighbors(star_edges(s, d), starts, ["IN_NATION", "IN_REGION"])


@query("neighbors_limited", "WITH " + _STAR + ", r AS (SELECT dst AS id, type, src AS neighbor, row_number() OVER (PARTITION BY dst, type ORDER BY src) AS rn FROM e WHERE type = 'PLACED_BY') SELECT id, type, neighbor FROM r WHERE rn <= 3")
def neighbors_limited(s: SparkSession, d: str) -> DataFrame:
    starts = table(s, d, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))
    return graph.neighbors(star_edges(s, d), starts, ["PLACED_BY"], "in", limit=3)


@query("expand_k", "WITH " + _STAR + " SELECT a.src AS start, a.dst AS node, 1 AS depth FROM e a WHERE a.src LIKE 'order:%' UNION ALL SELECT a.src, b.dst, 2 FROM e a JOIN e b ON a.dst = b.src WHERE a.src LIKE 'order:%' UNION ALL SELECT a.src, c.dst, 3 FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src WHERE a.src LIKE 'order:%'")
def expand_k(s: SparkSession, d: str) -> DataFrame:
    starts = table(s, d, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"))
    return graph.expand(star_edges(s, d), starts, ["IN_REGION", "IN_NATION", "PLACED_BY"], 3).select("start", "node", "depth")


@query("shortest_paths", "SELECT DISTINCT 'supplier:' || s_suppkey AS src, 'order:' || o_orderkey AS dst, 3 AS length, ['supplier:' || s_suppkey, 'nation:' || s_nationkey, 'customer:' || c_custkey, 'order:' || o_orderkey] AS path FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey AND c_nationkey = s_nationkey UNION ALL SELECT DISTINCT 'supplier:' || s_suppkey, 'order:' || o_orderkey, 5, ['supplier:' || s_suppkey, 'nation:' || s_nationkey, 'region:' || x.n_regionkey, 'nation:' || c_nationkey, 'customer:' || c_custkey, 'order:' || o_orderkey] FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey AND c_nationkey <> s_nationkey JOIN nation x ON x.n_nationkey = s_nationkey JOIN nation y ON y.n_nationkey = c_nationkey AND y.n_regionkey = x.n_regionkey")
def shortest_paths(s: SparkSession, d: str) -> DataFrame:
    """From every supplier to the orders it delivers, over all kinds of edges; five of them lead through the region, and no way is longer."""
    pairs = table(s, d, "lineitem").select(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("dst"))
    return graph.shortest_paths(star_edges(s, d), pairs, ["IN_REGION", "IN_NATION", "PLACED_BY"], longest=5)


@query("graph_nodes", f"""WITH {_LATEST}, d AS (SELECT * FROM raw_docs WHERE doc_id IS NOT NULL),
e AS (SELECT subject_key AS k, NULL AS literal FROM l UNION ALL SELECT object_key, CASE WHEN object_literal <> '' THEN object_literal END FROM l),
n AS (SELECT 'Artifact' AS label, 'artifact:' || tool || ':' || {T.slug_sql('doc_id')} AS key, coalesce(CASE WHEN trim(title) <> '' THEN title END, doc_id) AS name, 0 AS rank FROM d
UNION ALL SELECT 'Group', 'group:' || {T.slug_sql('g')}, g, 0 FROM (SELECT unnest(acl_groups) AS g FROM raw_docs) WHERE g IS NOT NULL
UNION ALL SELECT CASE split_part(k, ':', 1) WHEN 'person' THEN 'Person' WHEN 'team' THEN 'Team' WHEN 'project' THEN 'Project' WHEN 'account' THEN 'Account' WHEN 'decision' THEN 'Decision' WHEN 'group' THEN 'Group' ELSE 'Topic' END, k, coalesce(literal, replace(regexp_replace(k, '^[^:]*:', ''), '-', ' ')), (literal IS NULL)::INT FROM e WHERE k IS NOT NULL AND NOT starts_with(k, 'artifact:')
UNION ALL SELECT 'Claim', claim_key, predicate, 0 FROM l) SELECT label, key, name FROM (SELECT *, row_number() OVER (PARTITION BY label, key ORDER BY rank, name) AS rn FROM n) WHERE rn = 1""")
def graph_nodes(s: SparkSession, d: str) -> DataFrame:
    return graph.assemble_nodes(table(s, d, "raw_docs"), latest(s, d))


@query("graph_edges", _CLAIM_SCORES + f""", v AS (SELECT DISTINCT 'VISIBLE_TO' AS type, 'artifact:' || tool || ':' || {T.slug_sql('doc_id')} AS src, g FROM (SELECT tool, doc_id, unnest(acl_groups) AS g FROM raw_docs WHERE doc_id IS NOT NULL) WHERE g IS NOT NULL),
q AS (SELECT type, src, 'group:' || {T.slug_sql('g')} AS dst FROM v UNION SELECT 'ABOUT', claim_key, subject_key FROM a UNION SELECT 'OBJECT', claim_key, object_key FROM a UNION SELECT 'SOURCED_FROM', claim_key, source_artifact_key FROM a UNION SELECT 'ASSERTED_BY', claim_key, asserted_by_key FROM a UNION SELECT CASE WHEN st = 'superseded' THEN predicate || '_SUPERSEDED' ELSE predicate END, subject_key, object_key FROM a UNION SELECT CASE WHEN st = 'contested' THEN 'CONTRADICTS' ELSE 'SUPERSEDES' END, wk, claim_key FROM a WHERE st <> 'current')
SELECT type, count(*) AS n, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM q WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY type""")
def graph_edges(s: SparkSession, d: str) -> DataFrame:
    e = graph.assemble_edges(table(s, d, "raw_docs"), arbitrate.arbitrate(latest(s, d)))
    return e.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"))


@query("claims_touching", f"WITH {_LATEST}, t AS (SELECT subject_key AS entity, claim_key FROM l UNION SELECT object_key, claim_key FROM l) SELECT entity, count(*) AS n_claims FROM t WHERE entity IS NOT NULL GROUP BY entity")
def claims_touching(s: SparkSession, d: str) -> DataFrame:
    x = latest(s, d).select("claim_key", F.explode(F.array_distinct(F.array("subject_key", "object_key"))).alias("entity")).where("entity is not null")
    return x.groupBy("entity").agg(F.count(F.lit(1)).alias("n_claims"))


@query("citing_artifacts", f"WITH {_LATEST} SELECT DISTINCT r.object_key AS anchor, c.claim_key FROM l r JOIN l c ON c.source_artifact_key = r.subject_key WHERE r.predicate = 'REFERENCES' AND r.object_key IS NOT NULL")
def citing_artifacts(s: SparkSession, d: str) -> DataFrame:
    x = latest(s, d)
    cites = x.where("predicate = 'REFERENCES' and object_key is not null").select(F.col("object_key").alias("anchor"), F.col("subject_key").alias("source_artifact_key"))
    return cites.join(x.select("claim_key", "source_artifact_key"), "source_artifact_key").select("anchor", "claim_key").distinct()


@query("day_siblings", "WITH d AS (SELECT DISTINCT doc_id, title, left(created_at, 10) AS day FROM raw_docs WHERE tool = 'slack' AND created_at IS NOT NULL AND title IS NOT NULL AND doc_id IS NOT NULL), g AS (SELECT title, day, count(*) AS n FROM d GROUP BY ALL) SELECT doc_id, n - 1 AS n_siblings FROM d JOIN g USING (title, day) WHERE n > 1")
def day_siblings(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "raw_docs").where("tool = 'slack' and created_at is not null and title is not null and doc_id is not null").select("doc_id", "title", F.substring("created_at", 1, 10).alias("day")).distinct()
    n = x.groupBy("title", "day").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return x.join(n, ["title", "day"]).select("doc_id", (F.col("n") - 1).alias("n_siblings"))


@query("people_by_mentions", "SELECT canonical, max(mention_count) AS mentions FROM clusters WHERE mention_count IS NOT NULL GROUP BY canonical ORDER BY mentions DESC, canonical LIMIT 50")
def people_by_mentions(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "clusters").where("mention_count is not null").groupBy("canonical").agg(F.max("mention_count").alias("mentions"))
    return x.orderBy(F.col("mentions").desc(), "canonical").limit(50)


def _ref_sql(surface: str, kind: str) -> str:
    slug = T.slug_sql(surface)
    return f"CASE {kind} WHEN 'Person' THEN 'person:' || {slug} WHEN 'Artifact' THEN CASE WHEN starts_with({surface}, 'artifact:') THEN {surface} ELSE 'artifact:' || source_tool || ':' || {slug} END ELSE lower({kind}) || ':' || {slug} END"


_HEDGED = " OR ".join(f"contains(lower(concat_ws(' ', evidence_span, body)), '{m}')" for m in HEDGES)


@query("built_claims", f"""WITH d AS (SELECT 'artifact:' || tool || ':' || {T.slug_sql('doc_id')} AS dk, arg_max(body, loaded_at) AS body FROM raw_docs WHERE doc_id IS NOT NULL GROUP BY 1),
x AS (SELECT *, 'artifact:' || source_tool || ':' || {T.slug_sql('source_doc_id')} AS sak, {_ref_sql('subject_surface', 'subject_type')} AS sk, {_ref_sql('object_surface', 'object_type')} AS ok FROM extracted_claims WHERE subject_surface IS NOT NULL AND object_surface IS NOT NULL AND predicate IS NOT NULL)
SELECT 'claim:' || left(sha256(concat_ws('|', sk, predicate, ok, coalesce(sak, ''), coalesce(asserted_at, ''))), 16) AS claim_key, sk AS subject_key, predicate, ok AS object_key, max(CASE WHEN {_HEDGED} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hedging FROM x LEFT JOIN d ON sak = dk GROUP BY ALL""")
def built_claims(s: SparkSession, d: str) -> DataFrame:
    """Claims keyed by their own surfaces, as before any person is resolved."""
    none = s.createDataFrame([], "surface_norm string, key string, mentions bigint, emails array<string>")
    x = build.build_claims(table(s, d, "extracted_claims"), table(s, d, "raw_docs"), none)
    return x.select("claim_key", "subject_key", "predicate", "object_key", "hedging")


@query("built_graph")
def built_graph(s: SparkSession, d: str) -> DataFrame:
    """The whole build over documents and statements: counts of nodes, edges and claims."""
    return build.stats(build.build(table(s, d, "raw_docs"), table(s, d, "extracted_claims")))


# --- time and evaluation -----------------------------------------------------------------------------
@query("parsed_stamps", f"SELECT DISTINCT asserted_at, {parse_ts_sql('asserted_at')} AS us FROM claims WHERE asserted_at IS NOT NULL")
def parsed_stamps(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "claims").where("asserted_at is not null").select("asserted_at").distinct().select("asserted_at", F.unix_micros(parse_ts(F.col("asserted_at"))).alias("us"))


_TFIDF = r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents WHERE doc_id IS NOT NULL), n AS (SELECT count(DISTINCT doc_id) AS n FROM d),
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM eval_items) GROUP BY ALL), wanted AS (SELECT DISTINCT term FROM q),
f AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d) JOIN wanted USING (term) GROUP BY ALL), i AS (SELECT term, ln((n + 1)::DOUBLE / (count(DISTINCT doc_id) + 1)::DOUBLE) + 1.0::DOUBLE AS idf FROM f, n GROUP BY term, n),
s AS (SELECT query_id, doc_id, floor(sum(qtf::DOUBLE * tf::DOUBLE * idf / sqrt(len::DOUBLE)) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE AS score FROM f JOIN i USING (term) JOIN q USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM s WHERE score > 0) """


@query("tfidf_topk", _TFIDF + "SELECT query_id, doc_id, rank FROM r WHERE rank <= 5")
def tfidf_topk(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "eval_items").select(F.col("item_id").alias("query_id"), "text")
    return evaluate.tfidf_topk(table(s, d, "documents").select("doc_id", "text"), q).select("query_id", "doc_id", "rank")


_PRF = """h AS (SELECT DISTINCT source_doc_id AS query_id, subject_surface AS doc_id FROM extracted_claims WHERE tier = 'A' AND source_doc_id IS NOT NULL AND subject_surface IS NOT NULL), t AS (SELECT DISTINCT source_doc_id AS query_id, source_tool AS kind, subject_surface AS doc_id FROM extracted_claims WHERE source_doc_id IS NOT NULL AND subject_surface IS NOT NULL),
nh AS (SELECT query_id, count(*) AS n_hit FROM h GROUP BY ALL), p AS (SELECT t.query_id, kind, count(*) AS n_true, count(h.doc_id) AS n_both FROM t LEFT JOIN h ON t.query_id = h.query_id AND t.doc_id = h.doc_id GROUP BY ALL),
x AS (SELECT kind, CASE WHEN n_hit > 0 THEN n_both / n_hit::DOUBLE ELSE 0 END AS p, n_both / n_true::DOUBLE AS r, n_both FROM p LEFT JOIN nh USING (query_id))"""


@query("retrieval_metrics", "WITH " + _PRF + " SELECT kind, count(*) AS n, floor(avg(p) * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE AS precision, floor(avg(r) * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE AS recall, floor(avg(CASE WHEN n_both > 0 THEN 2 * p * r / (p + r) ELSE 0 END) * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE AS f1, floor(avg((n_both > 0)::INT::DOUBLE) * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE AS any_hit FROM x GROUP BY kind")
def retrieval_metrics(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "extracted_claims").where("source_doc_id is not null and subject_surface is not null").select(F.col("source_doc_id").alias("query_id"), F.col("source_tool").alias("kind"), F.col("subject_surface").alias("doc_id"), "tier")
    return evaluate.retrieval_metrics(x.where("tier = 'A'"), x)


@query("abstention_metrics", "WITH o AS (SELECT merge_id, veto IS NOT NULL AS s, score < 0.45 AS a FROM merges WHERE score IS NOT NULL), c AS (SELECT count(*) FILTER (s AND a) AS tp, count(*) FILTER (NOT s AND a) AS fp, count(*) FILTER (s AND NOT a) AS fn FROM o) SELECT tp, fp, fn, floor(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 1 END * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE AS precision, floor(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 1 END * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE AS recall FROM c")
def abstention_metrics(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "merges").where("score is not null")
    return evaluate.abstention(x.select(F.col("veto").isNotNull().alias("should_abstain"), (F.col("score") < resolve.REJECT).alias("abstained")))


@query("index_percentiles", "WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, any_value(n) AS n, max(CASE WHEN i = n // 2 THEN value END) AS p50, max(CASE WHEN i = greatest(floor(n * 0.95)::BIGINT - 1, 0) THEN value END) AS p95 FROM o GROUP BY event_type")
def index_percentiles(s: SparkSession, d: str) -> DataFrame:
    return evaluate.index_percentiles(table(s, d, "events"), "event_type", "value")


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def event_windows(s: SparkSession, d: str) -> DataFrame:
    x = incremental.windowed_counts(table(s, d, "events").where("ts is not null"))
    return x.withColumn("total", arbitrate.half_up(F.col("total"), 2))


# --- questions ------------------------------------------------------------------------------------------
def _asked_graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Arbitrated claims and the entities they name, written once for the many reads of a batch."""
    claims = materialize(arbitrate.arbitrate(latest(s, d)), "arbitrated")
    nodes = graph.assemble_nodes(table(s, d, "raw_docs").where("false"), claims).where("label <> 'Claim'")
    return claims, materialize(nodes, "entities")


def _batch(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """Three questions about every project that anything is claimed of, with all that answering draws on."""
    claims, nodes = _asked_graph(s, d)
    said = F.explode(F.array(F.concat(F.lit("Who owns the "), F.col("name"), F.lit("?")), F.concat(F.lit("List all people who work on "), F.col("name"), F.lit("?")), F.concat(F.lit("Which customer is behind "), F.col("name"), F.lit(" as of 2025-06-30?"))))
    qs = nodes.where("label = 'Project'").select("key", said.alias("question")).select(F.concat_ws("|", "key", "question").alias("question_id"), "question")
    spelled = table(s, d, "clusters").where("canonical is not null").select(F.explode("surfaces").alias("alias"), F.concat(F.lit("person:"), T.slugify(F.col("canonical"))).alias("key")).where("alias is not null").distinct()
    cites = claims.where("predicate = 'REFERENCES'").select(F.col("subject_key").alias("src"), F.col("object_key").alias("dst")).distinct()
    belongs = claims.where("predicate = 'DISCUSSED_IN' and subject_key like 'project:%'").select(F.col("object_key").alias("key"), F.col("subject_key").alias("project")).distinct()
    return {"questions": qs, "claims": claims, "entities": nodes, "aliases": spelled, "references": cites, "artifact_project": belongs}


@query("ask_batch")
def ask_batch(s: SparkSession, d: str) -> DataFrame:
    return ask.ask(**_batch(s, d))


@query("ask_evidence")
def ask_evidence(s: SparkSession, d: str) -> DataFrame:
    return ask.ask_evidence(**_batch(s, d))


@query("question_plans")
def question_plans(s: SparkSession, d: str) -> DataFrame:
    return ask.plan(table(s, d, "eval_items").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))).select("question_id", "predicates", "set_mode", "words")


@query("suggestions")
def suggestions(s: SparkSession, d: str) -> DataFrame:
    return ask.suggestions(*_asked_graph(s, d))
