"""Registry of named queries over a folder of parquet tables, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.operators import nested, timestamps
from strandline.plans import query_pack
from strandline.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def general_queries() -> dict[str, Query]:
    """Queries of the general training-data problems."""
    return {
        "p5_found": lambda s, d: nested.found(table(s, d, "raw_docs"), table(s, d, "sources")),
        "p6_found": lambda s, d: timestamps.found(table(s, d, "raw_docs"), table(s, d, "extracted_claims"), table(s, d, "tool_clocks")),
    }


def queries() -> dict[str, Query]:
    return query_pack.QUERIES | general_queries()


def oracle_sql() -> dict[str, str]:
    return dict(query_pack.SQL)
