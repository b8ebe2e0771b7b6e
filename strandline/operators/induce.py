"""Schema induction by counting: paths, cardinality, samples, validation."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.arbitrate import half_up
from strandline.plans.ontology import PREDICATES


def flat_paths(record: str | None, deepest: int = 4) -> list[tuple[str, str]]:
    """(dotted path, example) of a JSON record: objects to four levels, of a list its first object or first three scalars."""
    try:
        root = json.loads(record or "")
    except (ValueError, RecursionError):
        return []
    out: list[tuple[str, str]] = []
    stack = [("", root, 0)]
    while stack:
        path, v, depth = stack.pop()
        if isinstance(v, dict):
            if depth <= deepest:
                stack.extend((f"{path}.{k}" if path else k, x, depth + 1) for k, x in reversed(v.items()))
        elif isinstance(v, list):
            if v and isinstance(v[0], dict):
                stack.append((path, v[0], depth))
            elif v and path:
                out.append((path, ", ".join(str(x) for x in v[:3])))
        elif v is not None and path:
            out.append((path, str(v)))
    return out


def profile_paths(records: DataFrame) -> DataFrame:
    """(tool, path, n, example): how many records of a tool have a path, and the smallest example. records: tool, record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(t, p, e[:200]) for t, r in zip(b["tool"], b["record"], strict=True) for p, e in flat_paths(r)], columns=["tool", "path", "example"])

    flat = records.select("tool", "record").where("record is not null").mapInPandas(run, "tool string, path string, example string")
    return flat.groupBy("tool", "path").agg(F.count(F.lit(1)).alias("n"), F.min("example").alias("example"))


def field_inventory(profile: DataFrame, consumed: DataFrame, most: int = 18) -> DataFrame:
    """(tool, unused): paths that no envelope or rule reads, most frequent first, up to `most` a tool. consumed: tool, path."""
    left = profile.join(consumed.distinct(), ["tool", "path"], "left_anti")
    w = Window.partitionBy("tool").orderBy(F.col("n").desc(), "path")
    top = left.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    return top.groupBy("tool").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "path"))), lambda x: x["path"]), ", ").alias("unused"))


def cardinality(triples: DataFrame) -> DataFrame:
    """(predicate, n_subjects, avg_objects, multi_share, cardinality) by counting. triples: subject, predicate, object.

    'one' iff on average below 1.35 objects and below a quarter of subjects with several; under 3 subjects no verdict.
    """
    t = triples.select("predicate", F.lower(F.trim("subject")).alias("s"), F.lower(F.trim("object")).alias("o")).where("s is not null and o is not null")
    per = t.groupBy("predicate", "s").agg(F.countDistinct("o").alias("k"))
    x = per.groupBy("predicate").agg(F.count(F.lit(1)).alias("n_subjects"), F.avg("k").alias("a"), F.avg(F.when(F.col("k") > 1, 1.0).otherwise(0.0)).alias("m"))
    verdict = F.when(F.col("n_subjects") < 3, F.lit(None).cast("string")).when((F.col("a") < 1.35) & (F.col("m") < 0.25), "one").otherwise("many")
    return x.select("predicate", "n_subjects", half_up(F.col("a"), 2).alias("avg_objects"), half_up(F.col("m"), 2).alias("multi_share"), verdict.alias("cardinality"))


def infer_cardinality(triples: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(predicate, cardinality) for a vocabulary (predicate, temporal): counted, else many unless temporal; never 'one' for timeless predicates."""
    c = cardinality(triples).select("predicate", F.col("cardinality").alias("c"))
    x = vocabulary.join(c, "predicate", "left")
    return x.select("predicate", F.when(~F.col("temporal"), "many").otherwise(F.coalesce("c", F.lit("one"))).alias("cardinality"))


def relation_histogram(claims: DataFrame, relations: int = 120, pairs: int = 3) -> DataFrame:
    """(predicate_raw, n, type_pairs): the most frequent raw relations with their top type pairs."""
    x = claims.where("predicate_raw is not null").groupBy("predicate_raw", F.concat_ws("->", "subject_type", "object_type").alias("pair")).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("predicate_raw").orderBy(F.col("k").desc(), "pair")
    top = x.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= pairs)
    lists = top.groupBy("predicate_raw").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "pair"))), lambda v: v["pair"]), ", ").alias("type_pairs"))
    n = x.groupBy("predicate_raw").agg(F.sum("k").alias("n")).orderBy(F.col("n").desc(), "predicate_raw").limit(relations)
    return n.join(lists, "predicate_raw").select("predicate_raw", "n", "type_pairs")


def spread_sample(docs: DataFrame, limit: int = 40, tools: int | None = None) -> DataFrame:
    """Longest texts first, at most max(3, limit // tools) a tool and limit in all. docs: tool, doc_id, body."""
    n = tools if tools is not None else docs.select("tool").distinct().count()
    cap = max(3, limit // max(1, n))
    w = Window.partitionBy("tool").orderBy(F.length("body").desc(), "doc_id")
    x = docs.where("body is not null").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap)
    return x.orderBy(F.length("body").desc(), "doc_id").limit(limit).drop("rn")


def valid_rules(rules: DataFrame, paths: DataFrame, predicates: DataFrame) -> DataFrame:
    """Rules whose predicate, paths and types exist; an unknown time path is dropped, the rule kept.

    rules: tool, subject, subject_type, predicate, object, object_type, asserted_at; paths: tool, path.
    """
    p = paths.select("tool", "path").distinct().unionByName(rules.select("tool", F.lit("__self__").alias("path")).distinct())
    at = lambda c: p.select("tool", F.col("path").alias(c))
    x = rules.join(at("subject"), ["tool", "subject"], "left_semi").join(at("object"), ["tool", "object"], "left_semi")
    x = x.join(predicates.select("predicate", "domain", "range"), "predicate").where(F.array_contains("domain", F.col("subject_type")) & F.array_contains("range", F.col("object_type"))).drop("domain", "range")
    known = p.select("tool", F.col("path").alias("asserted_at"), F.lit(True).alias("ok"))
    return x.join(known, ["tool", "asserted_at"], "left").withColumn("asserted_at", F.when(F.col("ok"), F.col("asserted_at"))).drop("ok").select("tool", "subject", "subject_type", "predicate", "object", "object_type", "asserted_at")


def valid_envelope(mapping: DataFrame, paths: DataFrame) -> DataFrame:
    """(tool, field, path) of a mapping that was observed; a missing doc_id falls back to the smallest path that ends like an identifier."""
    tails = ["id", "key", "identifier", "number", "ts", "message_id", "uuid"]
    kept = mapping.join(paths.select("tool", "path").distinct(), ["tool", "path"], "left_semi").select("tool", "field", "path")
    ident = paths.where(F.element_at(F.split("path", r"\."), -1).isin(*tails)).groupBy("tool").agg(F.min("path").alias("path")).withColumn("field", F.lit("doc_id"))
    lacking = ident.join(kept.where("field = 'doc_id'").select("tool"), "tool", "left_anti")
    return kept.unionByName(lacking.select("tool", "field", "path"))


def source_authority(kind: str, has_updated: bool) -> float:
    """Trust of an unknown source from its kind, a little more where records carry their update time."""
    # Trust by kind of artifact.
    base = {"ticket": 1.00, "deal": 0.95, "pr": 0.90, "doc": 0.80, "meeting": 0.70, "transcript": 0.65, "email": 0.60, "message": 0.50}
    return round(min(1.0, base.get(kind, 0.6) + (0.05 if has_updated else 0.0)), 2)


def unused_predicates(claims: DataFrame) -> DataFrame:
    spark = claims.sparkSession
    vocabulary = spark.createDataFrame([(p,) for p in PREDICATES], "predicate string")
    return vocabulary.join(claims.select("predicate").distinct(), "predicate", "left_anti")
