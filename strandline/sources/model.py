"""Hook for a model that reads statements out of free text; which model is the caller's business."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.plans.ontology import Schema
from strandline.sources import records

_FENCE = re.compile(r"```[a-z]*\s(.*?)```", re.S)
_ROW = "subject_surface string, subject_type string, predicate string, object_surface string, object_type string, source_tool string, source_doc_id string, asserted_at string, confidence double, evidence_span string, predicate_raw string"


def read_json(text: str | None) -> object | None:
    """The JSON value of an answer: alone, in a code fence, or from the first to the last brace; None if there is none."""
    text = (text or "").strip()
    fence = _FENCE.search(text)
    lo, hi = text.find("{"), text.rfind("}")
    for part in (text, fence[1] if fence else "", text[lo : hi + 1] if 0 <= lo < hi else ""):
        try:
            return json.loads(part)
        except (ValueError, RecursionError):
            continue
    return None


def statements(docs: DataFrame, model: Callable[[list[str]], list[str]], schema: Schema | None = None) -> DataFrame:
    """Tier B statements of documents of 40 characters or more (tool, doc_id, title, body, created_at, updated_at).

    model takes the texts of a batch and gives an answer for each, JSON with a list `claims` of subject, subject_type,
    predicate, object, object_type and, optionally, asserted_at, evidence, confidence and predicate_raw. Answers
    that hold no JSON give nothing; rows outside the vocabulary drop out. It runs on the executors, once a batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for tool, doc, at, answer in zip(b["tool"], b["doc_id"], b["at"], model(b["text"].tolist()), strict=True):
                value = read_json(answer)
                for c in (value.get("claims") if isinstance(value, dict) else None) or []:
                    if isinstance(c, dict):
                        text = lambda k, c=c: c.get(k) if isinstance(c.get(k), str) else None
                        sure = c.get("confidence")
                        rows.append((text("subject"), text("subject_type"), text("predicate"), text("object"), text("object_type"), tool, doc, text("asserted_at") or at, float(sure) if isinstance(sure, int | float) else None, text("evidence"), text("predicate_raw")))
            yield pd.DataFrame(rows, columns=[x.split(" ")[0] for x in _ROW.split(", ")])

    stamp = F.coalesce(F.when(F.col("updated_at") != "", F.col("updated_at")), F.col("created_at"))
    said = records.worth_extracting(docs).select("tool", "doc_id", stamp.alias("at"), F.concat_ws("\n\n", "title", "body").alias("text"))
    return records.extracted_rows(said.mapInPandas(run, _ROW), schema)
