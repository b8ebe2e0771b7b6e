"""Native JSON records to document envelopes and deterministic claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import slugify
from strandline.functions.time import parse_ts
from strandline.plans.ontology import Schema


def dotted(record: Column, path: str | None) -> Column:
    """Text of a dotted path in a JSON text; null if a link is missing or is no object."""
    if not path:
        return F.lit(None).cast("string")
    return F.get_json_object(record, "$" + "".join(f"['{k}']" for k in path.split(".")))


def truthy(c: Column) -> Column:
    """Of a value's JSON text: neither null, empty, zero nor false. The strings "0" and "false" are no such values."""
    return c.isNotNull() & ~c.isin("null", '""', "0", "0.0", "-0.0", "false", "[]", "{}")


def _many(record: Column, paths: list[str]) -> Column:
    """Values of paths in order; a list gives its elements, a scalar itself, nulls drop out."""
    none = F.array().cast("array<string>")
    parts = [F.when(dotted(record, p).startswith("["), F.from_json(dotted(record, p), "array<string>")).when(dotted(record, p).isNotNull(), F.array(dotted(record, p))).otherwise(none) for p in paths]
    return F.filter(F.concat(none, *parts), lambda x: x.isNotNull())


def envelope(records: DataFrame, tool: str, schema: Schema | None = None) -> DataFrame:
    """Document envelopes of one tool's records (column record, JSON text); records without id or that can't be parsed drop out."""
    s = (schema or Schema()).sources[tool]
    r = F.col("record")
    text = lambda k: F.coalesce(dotted(r, s.get(k)), F.lit(""))
    stamp = lambda k: F.coalesce(F.date_format(parse_ts(dotted(r, s.get(k))), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit(""))
    return records.where(F.expr("try_parse_json(record)").isNotNull() & dotted(r, s["doc_id"]).isNotNull()).select(
        dotted(r, s["doc_id"]).alias("doc_id"), F.lit(tool).alias("tool"), F.lit(s["kind"]).alias("kind"), text("title").alias("title"), text("body").alias("body"), text("author").alias("author_raw"), text("author_email").alias("author_email"),
        _many(r, s.get("participants", [])).alias("participants_raw"), stamp("created_at").alias("created_at"), stamp("updated_at").alias("updated_at"), _many(r, s.get("acl", [])).alias("acl_groups"), r.alias("structured"),
    )


def field_map_claims(docs: DataFrame, schema: Schema | None = None) -> DataFrame:
    """Deterministic (tier A) claims of documents: tool, doc_id, structured, created_at, updated_at.

    Each record is parsed once, and the rules of its tool read the parsed form. A rule gives nothing where
    either side is null, empty, zero or false. A rule's own time counts if it can be read, else the document's.
    """
    schema = schema or Schema()
    x = docs.where("doc_id is not null and structured is not null").select("tool", "doc_id", "created_at", "updated_at", F.concat(F.lit("artifact:"), F.col("tool"), F.lit(":"), slugify(F.col("doc_id"))).alias("doc_key"), F.try_parse_json("structured").alias("v")).where("v is not null")
    path = lambda p: "$" + "".join(f"['{k}']" for k in p.split("."))
    own = F.lit(None).cast("string")

    def side(p: str) -> tuple[Column, Column]:
        if p == "__self__":
            return F.col("doc_key"), F.lit('"x"')
        return F.try_variant_get("v", path(p), "string"), F.to_json(F.try_variant_get("v", path(p), "variant"))

    of_tool = None
    for tool, s in schema.sources.items():
        rules = []
        for subj, st, pred, obj, ot, at in s["rules"]:
            if pred not in schema.predicates:
                raise ValueError(f"rule of {tool}: unknown predicate {pred}")
            (a, ja), (b, jb) = side(subj), side(obj)
            rules.append(F.struct(a.alias("subject_surface"), ja.alias("js"), F.lit(st).alias("subject_type"), F.lit(pred).alias("predicate"), b.alias("object_surface"), jb.alias("jo"), F.lit(ot).alias("object_type"), (F.try_variant_get("v", path(at), "string") if at else own).alias("at"), F.lit(f"{tool}.{obj} = ").alias("told")))
        if rules:
            of_tool = F.when(F.col("tool") == tool, F.array(*rules)) if of_tool is None else of_tool.when(F.col("tool") == tool, F.array(*rules))
    x = x.select("tool", "doc_id", "created_at", "updated_at", F.explode(of_tool).alias("r")).select("tool", "doc_id", "created_at", "updated_at", "r.*").where(truthy(F.col("js")) & truthy(F.col("jo")))
    read = F.date_format(parse_ts(F.col("at")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    stamp = F.coalesce(read, F.when(F.col("updated_at") != "", F.col("updated_at")), F.col("created_at"))
    return x.select("subject_surface", "subject_type", "predicate", "object_surface", "object_type", stamp.alias("asserted_at"), F.concat("told", F.substring("object_surface", 1, 70)).alias("evidence_span"), F.col("tool").alias("source_tool"), F.col("doc_id").alias("source_doc_id"), F.lit(1.0).alias("confidence"), F.lit("A").alias("tier"))


def artifact_rows(docs: DataFrame) -> DataFrame:
    """Artifact nodes: key, name (title or id, 300), excerpt (500), kind, tool, created, updated or created."""
    blank = lambda c: F.when(F.trim(c) != "", c)
    return docs.where("doc_id is not null").select(
        F.concat(F.lit("artifact:"), "tool", F.lit(":"), slugify(F.col("doc_id"))).alias("key"), F.substring(F.coalesce(blank(F.col("title")), "doc_id"), 1, 300).alias("name"), F.substring(F.coalesce("body", F.lit("")), 1, 500).alias("excerpt"), "kind", "tool",
        F.coalesce("created_at", F.lit("")).alias("created"), F.coalesce(blank(F.col("updated_at")), "created_at", F.lit("")).alias("updated"),
    )


def hedged(text: Column, markers: tuple[str, ...] | None = None) -> Column:
    """Whether a lower-cased text contains a hedging marker anywhere."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for m in markers or Schema().hedges:
        out = out | low.contains(m)
    return out


def worth_extracting(docs: DataFrame, least: int = 40) -> DataFrame:
    return docs.where(F.length(F.trim("body")) >= least)


def extracted_rows(rows: DataFrame, schema: Schema | None = None) -> DataFrame:
    """Model output kept as tier B claims: known predicate or UNMAPPED, known types, both surfaces; evidence cut to 400, confidence 0.8 by default."""
    schema = schema or Schema()
    ok = F.col("predicate").isin(*schema.predicates, "UNMAPPED") & F.col("subject_type").isin(*schema.node_types) & F.col("object_type").isin(*schema.node_types)
    x = rows.where(ok & (F.trim(F.coalesce("subject_surface", F.lit(""))) != "") & (F.trim(F.coalesce("object_surface", F.lit(""))) != ""))
    return x.withColumn("evidence_span", F.substring(F.coalesce("evidence_span", F.lit("")), 1, 400)).withColumn("confidence", F.coalesce("confidence", F.lit(0.8))).withColumn("tier", F.lit("B"))
