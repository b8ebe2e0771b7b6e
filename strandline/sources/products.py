"""Product bundles: one JSON file a product, whose sections hold the records of its tools.

A product is the unit that keeps a team, its threads and its documents together,
so a part of a collection is a number of whole products, in order of their names.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.build import thread_records
from strandline.plans.ontology import Schema
from strandline.sources import records

# Sections of a product file, the paths of their records, and their rules.
_T = "Artifact"
SECTIONS: dict[str, dict] = {
    "slack": dict(tool="bundle_slack", kind="message", doc_id="id", title="Channel.name", body="Message.User.text", author="Message.User.userId", created_at="Message.User.timestamp", acl=["Channel.name"], rules=[("Message.User.userId", "Person", "AUTHORED", "__self__", _T, None)]),
    "documents": dict(tool="bundle_doc", kind="doc", doc_id="id", title="type", body="content", author="author", created_at="date", rules=[("author", "Person", "AUTHORED", "__self__", _T, None)]),
    "meeting_transcripts": dict(tool="bundle_transcript", kind="transcript", doc_id="id", title="document_type", body="transcript", created_at="date", participants=["participants"], rules=[]),
    "meeting_chats": dict(tool="bundle_chat", kind="message", doc_id="id", body="text", rules=[]),
    "urls": dict(tool="bundle_url", kind="doc", doc_id="id", title="link", body="description", rules=[]),
    "prs": dict(tool="bundle_pr", kind="pr", doc_id="id", title="title", body="summary", author="user.login", created_at="created_at", rules=[("user.login", "Person", "AUTHORED", "__self__", _T, None), ("__self__", _T, "STATUS_IS", "state", "Topic", None)]),
}
#: Fixed value: form of employee ids in texts.
EMPLOYEE = r"\b(?:eid_[0-9a-f]{6,}|EMP_[0-9]{6,})\b"
_CLAIM = ["subject_surface", "subject_type", "predicate", "object_surface", "object_type", "source_tool", "source_doc_id", "asserted_at", "evidence_span"]


def bundle_schema(schema: Schema | None = None) -> Schema:
    return replace(schema or Schema(), sources={s["tool"]: s for s in SECTIONS.values()})


def read_bundles(spark: SparkSession, folder: str, products: int | None = None) -> DataFrame:
    """(product, bundle): the files of a folder as JSON text; the first `products` of them by name, whole."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json$", "").alias("product"), F.col("content").cast("string").alias("bundle"))
    if products is None:
        return x
    keep = x.select("product").orderBy("product").limit(products)
    return x.join(keep, "product", "left_semi")


def bundle_documents(bundles: DataFrame, schema: Schema | None = None) -> DataFrame:
    """Envelopes of all records with an id, with their product; replies are folded into the message they answer."""
    own = bundle_schema(schema)
    rows = bundles.select("product", F.explode(F.from_json("bundle", "map<string,string>")).alias("section", "rows")).where(F.col("rows").startswith("["))
    rows = rows.select("product", "section", F.explode(F.from_json("rows", "array<string>")).alias("record")).where(F.get_json_object("record", "$.id").isNotNull())
    parts = []
    for section, s in SECTIONS.items():
        x = rows.where(F.col("section") == section)
        envelope = records.envelope(x.select("record"), s["tool"], own).join(x.select("product", F.col("record").alias("structured")).distinct(), "structured")
        if section == "slack":
            told = thread_records(envelope.select("doc_id", "product", F.col("structured").alias("record"))).select("doc_id", "product", F.col("body").alias("_b"), F.col("participants").alias("_p"))
            envelope = envelope.join(told.dropDuplicates(["doc_id", "product"]), ["doc_id", "product"]).withColumn("body", F.col("_b")).withColumn("participants_raw", F.col("_p")).drop("_b", "_p")
        parts.append(envelope)
    return reduce(DataFrame.unionByName, parts)


def _stated(x: DataFrame, subject: Column, st: str, predicate: str, obj: Column, ot: str, why: Column, at: Column | None = None) -> DataFrame:
    return x.select(subject.alias("subject_surface"), F.lit(st).alias("subject_type"), F.lit(predicate).alias("predicate"), obj.alias("object_surface"), F.lit(ot).alias("object_type"), F.col("tool").alias("source_tool"), F.col("doc_id").alias("source_doc_id"), (F.col("created_at") if at is None else at).alias("asserted_at"), why.alias("evidence_span"))


def _key() -> Column:
    return F.concat(F.lit("artifact:"), "tool", F.lit(":"), records.slugify(F.col("doc_id")))


def reference_claims(docs: DataFrame) -> DataFrame:
    """REFERENCES of documents that link to another by /docs/<id>, and of the whole conversation of a linking message.

    A conversation is the messages of one channel and day. docs: product, tool, doc_id, title, body, created_at.
    """
    text = F.lower(F.concat_ws(" ", "title", "body"))
    links = docs.withColumn("low", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"/docs/([a-z0-9_\-]+)"), F.lit(1)))))
    ids = docs.select("product", F.lower("doc_id").alias("low"), _key().alias("target"), F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("doc_id")).alias("target_name"), F.col("doc_id").alias("target_id")).distinct()
    links = links.withColumn("key", _key()).join(ids, ["product", "low"]).where("key <> target")
    own = _stated(links, F.col("key"), _T, "REFERENCES", F.col("target"), _T, F.concat(F.lit("links to "), "target_name"))
    day = F.substring("created_at", 1, 10)
    talks = links.where("tool = 'bundle_slack'").select("product", "title", day.alias("day"), F.col("key").alias("linking"), "target", "target_id").distinct()
    others = docs.where("tool = 'bundle_slack'").withColumn("key", _key()).withColumn("day", day).join(talks, ["product", "title", "day"]).where("key <> linking and key <> target")
    fan = _stated(others, F.col("key"), _T, "REFERENCES", F.col("target"), _T, F.concat(F.lit("same conversation as the message sharing "), "target_id"))
    return own.unionByName(fan).distinct()


def bundle_claims(docs: DataFrame, bundles: DataFrame, org: DataFrame | None = None, schema: Schema | None = None) -> DataFrame:
    """Tier A statements of product bundles: field maps, people named or taking part, reviews, products, links, teams, and the org chart (employee, manager, why)."""
    own = bundle_schema(schema)
    mapped = records.field_map_claims(docs, own).select(*_CLAIM)
    named = docs.withColumn("who", F.explode(F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "title", "body"), F.lit(EMPLOYEE), F.lit(0))))).where("who <> coalesce(author_raw, '')")
    there = docs.withColumn("who", F.explode("participants_raw")).where(F.col("who").rlike(f"^{EMPLOYEE}$"))
    review = "array<struct<user:struct<login:string>,state:string,submitted_at:string>>"
    reviews = docs.withColumn("v", F.explode(F.from_json(F.get_json_object("structured", "$.reviews"), review))).where("coalesce(v.user.login, '') <> ''")
    parts = [
        mapped,
        _stated(named, _key(), _T, "MENTIONS", F.col("who"), "Person", F.concat(F.lit("named in "), "tool", F.lit(" text"))),
        _stated(there, _key(), _T, "MENTIONS", F.col("who"), "Person", F.lit("meeting participant")),
        _stated(reviews, _key(), _T, "REVIEWED_BY", F.col("v.user.login"), "Person", F.concat(F.lit("PR review: "), F.coalesce("v.state", F.lit(""))), F.coalesce("v.submitted_at", "created_at")),
        _stated(docs, F.col("product"), "Project", "DISCUSSED_IN", _key(), _T, F.concat("product", F.lit(" artifact"))),
        reference_claims(docs),
    ]
    org_source = lambda x, i: x.withColumn("tool", F.lit("bundle_org")).withColumn("doc_id", i).withColumn("created_at", F.lit(""))
    team = org_source(bundles.select("product", F.explode(F.from_json(F.get_json_object("bundle", "$.team"), "array<string>")).alias("who")).where("who not like '{%'"), F.concat(F.lit("team:"), "product"))
    parts.append(_stated(team, F.col("who"), "Person", "MEMBER_OF", F.col("product"), "Project", F.concat(F.lit("listed on the "), "product", F.lit(" team"))))
    if org is not None:
        parts.append(_stated(org_source(org, F.lit("org_chart")), F.col("employee"), "Person", "REPORTS_TO", F.col("manager"), "Person", F.col("why")))
    x = reduce(DataFrame.unionByName, parts)
    return x.distinct().withColumn("confidence", F.lit(1.0)).withColumn("tier", F.lit("A"))


def org_reports(org_files: DataFrame) -> DataFrame:
    """(employee, manager, why) of org charts (JSON text in column record), however deep; people without id have no reports of their own."""
    import json
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["record"]:
                try:
                    tree = json.loads(text or "null")
                except ValueError:
                    continue
                stack = [n for n in (tree if isinstance(tree, list) else [tree]) if isinstance(n, dict)]
                while stack:
                    boss = stack.pop()
                    for group in ("engineering_leads", "engineers", "reports", "team"):
                        for one in boss.get(group) or []:
                            if isinstance(one, dict):
                                stack.append(one)
                                if one.get("employee_id") and boss.get("employee_id"):
                                    rows.append((one["employee_id"], boss["employee_id"], f"org chart: {one.get('role', 'report')} under {boss.get('role', 'manager')}"))
            yield pd.DataFrame(rows, columns=["employee", "manager", "why"])

    return org_files.mapInPandas(run, "employee string, manager string, why string")
