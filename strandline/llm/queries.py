"""Queries of the llm problems and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import components, leakage, mailtext, names, packing, sharedspans, survivors, turns
from strandline.runtime import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: survivors.found(table(s, d, "claims")),
        "p1_best_record": lambda s, d: survivors.best_record(table(s, d, "claims")).select("subject_key", "predicate", "object_key", "claim_key", "complete"),
        "p2_found": lambda s, d: mailtext.found(table(s, d, "raw_docs"), table(s, d, "tool_clocks")),
        "p2_inherited": lambda s, d: mailtext.inherited(table(s, d, "raw_docs"), table(s, d, "tool_clocks")),
        "p3_found": lambda s, d: components.found(table(s, d, "merges"), table(s, d, "clusters")),
        "p4_found": lambda s, d: turns.found(table(s, d, "raw_docs")),
        "p7_found": lambda s, d: names.found(table(s, d, "raw_docs"), table(s, d, "extracted_claims")),
        "p8_packing": lambda s, d: packing.found(table(s, d, "documents"), table(s, d, "container_sizes")),
        "p8_quality": lambda s, d: packing.quality(table(s, d, "documents"), table(s, d, "container_sizes")),
        "p9_found": lambda s, d: leakage.found(table(s, d, "documents"), table(s, d, "eval_items")),
        "p9_leaked_items": lambda s, d: leakage.leaked_items(table(s, d, "documents"), table(s, d, "eval_items")),
        "p10_found": lambda s, d: sharedspans.found(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": survivors.FOUND_SQL,
        "p1_best_record": survivors.BEST_SQL,
        "p3_found": components.FOUND_SQL,
        "p9_found": leakage.FOUND_SQL,
        "p9_leaked_items": leakage.LEAKED_SQL,
        "p10_found": sharedspans.FOUND_SQL,
    }
