"""Best representative of each duplicate group (problem 1).

Claims that state one triple form a group. Each usable field value is one
ranked record; a window orders the records of (triple, field) by trust or
recency with the claim key as tie-break and keeps the top one. row_number() <= 1
lets Spark cut every map task to one row per group before the shuffle
(WindowGroupLimit), so a group holding a third of all rows costs one row per
task, not one huge partition.

Defined results: null claim keys name no claim and are left out; nulls in the
triple compare equal; NaN, null and out-of-range values are unusable; a group
without a usable value for a field has null there; repeated rows don't count as
further claims; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRIPLE = ["subject_key", "predicate", "object_key"]
ISO = r"^\d{4}-\d{2}-\d{2}([Tt ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?\s*([Zz]|[+-]\d{2}(:?\d{2})?)?)?$"
STATUSES = ("current", "superseded", "contested")
FIELDS = ("status", "authority", "asserted_at", "corroboration")


def iso_instant(c: Column) -> Column:
    """Instant of an ISO date or date-time; no zone means UTC; otherwise null."""
    t = F.upper(F.trim(c))
    t = F.regexp_replace(F.regexp_replace(t, ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2")
    t = F.regexp_replace(t, r"(\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)\s*([+-]\d{2})$", "$1$2:00")
    zoned = F.when(t.rlike(r"(Z|\d{2}:\d{2}[+-]\d{2}:\d{2}|\.\d+[+-]\d{2}:\d{2}|:\d{2}[+-]\d{2}:\d{2})$"), t).otherwise(F.when(F.length(t) > 10, F.concat(t, F.lit("Z"))).otherwise(F.concat(t, F.lit("T00:00:00Z"))))
    return F.when(c.isNotNull() & F.trim(c).rlike(ISO), F.try_to_timestamp(F.regexp_replace(zoned, r"^(\d{4}-\d{2}-\d{2}) ", "$1T")))


def usable(claims: DataFrame) -> DataFrame:
    """Per claim row the usable value of each field, else null."""
    at = iso_instant(F.col("asserted_at"))
    status = F.lower(F.trim(F.col("status")))
    return claims.where(F.col("claim_key").isNotNull()).select(
        *TRIPLE,
        "claim_key",
        F.when(status.isin(*STATUSES), status).alias("status"),
        F.when((F.col("authority") > 0) & (F.col("authority") <= 1), F.col("authority").cast("double")).alias("authority"),
        F.when((at >= F.lit("2000-01-01T00:00:00Z").cast("timestamp")) & (at <= F.col("loaded_at")), at).alias("asserted_at"),
        F.when(F.col("corroboration").between(1, 9), F.col("corroboration").cast("double")).alias("corroboration"),
    )


def survivors(claims: DataFrame) -> DataFrame:
    """One row per triple: surviving value and giving claim of each field, n_claims kept as flag `several`."""
    u = usable(claims)
    us = F.unix_micros("asserted_at").cast("double")
    records = u.select(
        *TRIPLE,
        "claim_key",
        F.explode(
            F.array(
                F.struct(F.lit("status").alias("field"), F.coalesce(us, F.lit(-1e300)).alias("rank_by"), F.col("status").alias("value"), F.col("status").isNotNull().alias("ok")),
                F.struct(F.lit("authority").alias("field"), F.col("authority").alias("rank_by"), F.col("authority").cast("string").alias("value"), F.col("authority").isNotNull().alias("ok")),
                F.struct(F.lit("asserted_at").alias("field"), us.alias("rank_by"), F.date_format("asserted_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("value"), F.col("asserted_at").isNotNull().alias("ok")),
                F.struct(F.lit("corroboration").alias("field"), F.col("corroboration").alias("rank_by"), F.col("corroboration").cast("bigint").cast("string").alias("value"), F.col("corroboration").isNotNull().alias("ok")),
            )
        ).alias("r"),
    ).where("r.ok").select(*TRIPLE, "claim_key", "r.field", "r.rank_by", "r.value")
    w = Window.partitionBy(*TRIPLE, "field").orderBy(F.col("rank_by").desc(), F.col("claim_key").asc())
    top = records.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    keys = u.groupBy(*TRIPLE).agg(F.min("claim_key").alias("lo"), F.max("claim_key").alias("hi"))
    none = F.lit(None).cast("string")
    both = top.select(*TRIPLE, "field", "claim_key", "value", none.alias("lo"), none.alias("hi")).unionByName(
        keys.select(*TRIPLE, none.alias("field"), none.alias("claim_key"), none.alias("value"), "lo", "hi")
    )
    out = [F.max(F.when(F.col("field") == f, F.col("claim_key"))).alias(f"{f}_from") for f in FIELDS]
    out += [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS]
    return both.groupBy(*TRIPLE).agg(*out, F.min("lo").alias("lo"), F.max("hi").alias("hi")).withColumn("several", F.col("lo") != F.col("hi")).drop("lo", "hi")


def best_record(claims: DataFrame) -> DataFrame:
    """The one surviving whole claim per triple: most complete, then most trusted, then latest, then smallest key."""
    u = usable(claims)
    complete = sum((F.col(f).isNotNull().cast("int") for f in FIELDS), F.lit(0))
    w = Window.partitionBy(*TRIPLE).orderBy(F.col("complete").desc(), F.col("authority").desc_nulls_last(), F.col("asserted_at").desc_nulls_last(), F.col("claim_key").asc(), F.col("status").asc_nulls_last(), F.col("corroboration").desc_nulls_last())
    return u.withColumn("complete", complete).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def found(claims: DataFrame) -> DataFrame:
    return survivors(claims).where("several").select(*TRIPLE, *[f"{f}_from" for f in FIELDS])


_USABLE_SQL = r"""
WITH u AS (
  SELECT subject_key, predicate, object_key, claim_key,
    CASE WHEN lower(trim(status)) IN ('current','superseded','contested') THEN lower(trim(status)) END AS st,
    CASE WHEN authority > 0 AND authority <= 1 THEN authority END AS au,
    CASE WHEN regexp_full_match(trim(asserted_at), '\d{4}-\d{2}-\d{2}([Tt ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?\s*([Zz]|[+-]\d{2}(:?\d{2})?)?)?')
      AND epoch_us(TRY_CAST(CASE WHEN length(trim(asserted_at)) = 10 THEN trim(asserted_at) || ' 00:00:00+00' WHEN regexp_matches(trim(asserted_at), '([Zz]|[+-]\d{2}(:?\d{2})?)$') AND length(trim(asserted_at)) > 16 THEN trim(asserted_at) ELSE trim(asserted_at) || '+00' END AS TIMESTAMPTZ)) BETWEEN 946684800000000 AND epoch_us(loaded_at)
      THEN epoch_us(TRY_CAST(CASE WHEN length(trim(asserted_at)) = 10 THEN trim(asserted_at) || ' 00:00:00+00' WHEN regexp_matches(trim(asserted_at), '([Zz]|[+-]\d{2}(:?\d{2})?)$') AND length(trim(asserted_at)) > 16 THEN trim(asserted_at) ELSE trim(asserted_at) || '+00' END AS TIMESTAMPTZ)) END AS at_us,
    CASE WHEN corroboration BETWEEN 1 AND 9 THEN corroboration END AS co
  FROM claims WHERE claim_key IS NOT NULL)
"""

FOUND_SQL = _USABLE_SQL + """
SELECT subject_key, predicate, object_key,
  (array_agg(claim_key ORDER BY coalesce(at_us, -1) DESC, claim_key) FILTER (WHERE st IS NOT NULL))[1] AS status_from,
  (array_agg(claim_key ORDER BY au DESC, claim_key) FILTER (WHERE au IS NOT NULL))[1] AS authority_from,
  (array_agg(claim_key ORDER BY at_us DESC, claim_key) FILTER (WHERE at_us IS NOT NULL))[1] AS asserted_at_from,
  (array_agg(claim_key ORDER BY co DESC, claim_key) FILTER (WHERE co IS NOT NULL))[1] AS corroboration_from
FROM u GROUP BY ALL HAVING count(DISTINCT claim_key) > 1
"""

BEST_SQL = _USABLE_SQL + """
SELECT subject_key, predicate, object_key, claim_key, complete FROM (
  SELECT *, (st IS NOT NULL)::INT + (au IS NOT NULL)::INT + (at_us IS NOT NULL)::INT + (co IS NOT NULL)::INT AS complete,
    row_number() OVER (PARTITION BY subject_key, predicate, object_key ORDER BY (st IS NOT NULL)::INT + (au IS NOT NULL)::INT + (at_us IS NOT NULL)::INT + (co IS NOT NULL)::INT DESC, au DESC NULLS LAST, at_us DESC NULLS LAST, claim_key) AS rn
  FROM u) WHERE rn = 1
"""
