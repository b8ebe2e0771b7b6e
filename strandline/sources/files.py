"""Readers of folders: JSON lines, JSON, CSV and text, each file one or more record sources."""

from __future__ import annotations

import json
import re
from functools import reduce
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.text import slugify
from strandline.plans.ontology import Schema
from strandline.runtime import materialize
from strandline.sources import records

_SKIP = re.compile(r"question|answer|ground_truth|label|eval|qa", re.I)


def read_jsonl(spark: SparkSession, path: str, tool: str) -> DataFrame:
    """(tool, record) of a JSON-lines file; blank lines are skipped, a missing file is empty."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "tool string, record string")
    return spark.read.text(path).where(F.trim("value") != "").select(F.lit(tool).alias("tool"), F.col("value").alias("record"))


def read_corpus(spark: SparkSession, folder: str, tools: list[str]) -> DataFrame:
    """Records of all tools, one <tool>.jsonl each, in one table."""
    out = None
    for t in tools:
        one = read_jsonl(spark, f"{folder}/{t}.jsonl", t)
        out = one if out is None else out.unionByName(one)
    return out


def json_sections(text: str, stem: str) -> list[tuple[str, dict]]:
    """(section, record) of a JSON file: a list, list-valued sections of three objects or more, or an id-keyed map of three or more."""
    try:
        v = json.loads(text)
    except (ValueError, RecursionError):
        return []
    if isinstance(v, list):
        return [(stem, r) for r in v if isinstance(r, dict)]
    if not isinstance(v, dict):
        return []
    out = []
    for k, rows in v.items():
        dicts = [r for r in rows if isinstance(r, dict)] if isinstance(rows, list) else []
        if len(dicts) >= 3 and not _SKIP.search(k):
            out += [(f"{stem}_{k}", r) for r in dicts]
    if out:
        return out
    values = list(v.values())
    if len(values) >= 3 and all(isinstance(r, dict) for r in values):
        return [(stem, r) for r in values]
    return []


def read_folder(spark: SparkSession, folder: str, longest_text: int = 20000) -> DataFrame:
    """(tool, path, section, record): records of all readable files under a folder, each record as JSON text.

    Files that can't be decoded or parsed give nothing; text files give one record of title and content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io
        import posixpath

        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                base = posixpath.basename(path)
                stem, ext = posixpath.splitext(base)
                parent = posixpath.basename(posixpath.dirname(path))
                try:
                    text = bytes(content).decode("utf-8")
                except UnicodeDecodeError:
                    continue
                ext = ext.lower()
                if ext in (".jsonl", ".ndjson"):
                    for line in text.splitlines():
                        try:
                            v = json.loads(line)
                        except ValueError:
                            continue
                        if isinstance(v, dict):
                            rows.append((stem, path, stem, json.dumps(v)))
                elif ext == ".json":
                    rows += [(s, path, s, json.dumps(r)) for s, r in json_sections(text, stem)]
                elif ext == ".csv":
                    rows += [(stem, path, stem, json.dumps(r)) for r in csv.DictReader(io.StringIO(text))]
                elif ext in (".md", ".txt", ".text"):
                    rows.append((parent, path, parent, json.dumps({"id": stem, "title": stem, "content": text[:longest_text]})))
            yield pd.DataFrame(rows, columns=["tool", "path", "section", "record"])

    return files.mapInPandas(run, "tool string, path string, section string, record string").withColumn("tool", slugify(F.col("tool")))


def read_documents(spark: SparkSession, folder: str, schema: Schema | None = None) -> tuple[DataFrame, DataFrame]:
    """Envelopes of all records under a folder whose tool the schema knows, and (tool, n) of those it doesn't."""
    schema = schema or Schema()
    found = materialize(read_folder(spark, folder), "records")
    docs = reduce(DataFrame.unionByName, [records.envelope(found.where(F.col("tool") == t).select("record"), t, schema) for t in schema.sources])
    return docs, found.where(~F.col("tool").isin(*schema.sources)).groupBy("tool").agg(F.count(F.lit(1)).alias("n"))
