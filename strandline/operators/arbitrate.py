"""Conflict arbitration between claims, now or as of a past moment.

Scores need facts of whole groups (newest and oldest stamp, distinct tools of an
object). They come from aggregations with map-side combine, joined back to the claims;
no window gathers a hot subject in one task, and the adaptive skew join
splits its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.time import parse_ts
from strandline.plans.ontology import Schema

_GROUP = ["subject_key", "predicate"]


def half_up(c: Column, digits: int = 4) -> Column:
    """Rounding that every engine does alike."""
    k = 10.0**digits
    return F.floor(c * F.lit(k) + F.lit(0.5)) / F.lit(k)


def latest_claims(claims: DataFrame) -> DataFrame:
    """One row per claim_key: the last loaded, ties by the whole row; rows without key drop out."""
    rest = [c for c in claims.columns if c not in ("claim_key", "loaded_at")]
    r = claims.where("claim_key is not null").groupBy("claim_key").agg(F.max(F.struct("loaded_at", *rest)).alias("r"))
    return r.select("claim_key", "r.*")


def score_claims(claims: DataFrame, schema: Schema | None = None) -> DataFrame:
    """Adds ts, recency, corroboration, score and competes to claims.

    claims: claim_key, subject_key, predicate, object_key, source_tool,
    asserted_at (ISO text), authority, specificity, hedging. Null numbers count
    0; undated claims have recency 0; every group is scored.
    """
    schema = schema or Schema()
    w = schema.weights
    x = claims.withColumn("ts", F.unix_micros(parse_ts(F.col("asserted_at"))) if dict(claims.dtypes)["asserted_at"] == "string" else F.unix_micros(F.col("asserted_at").cast("timestamp")))
    # facts of the groups come from the facts of their objects, so the claims are aggregated once
    agree = x.groupBy(*_GROUP, "object_key").agg(F.countDistinct("source_tool").alias("corroboration"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    span = agree.groupBy(*_GROUP).agg(F.min("lo").alias("oldest"), F.max("hi").alias("newest"), (F.min("object_key") != F.max("object_key")).alias("differ"))
    same = lambda left, right: [left[c].eqNullSafe(right[f"_{c}"]) for c in _GROUP]
    span = span.select(*[F.col(c).alias(f"_{c}") for c in _GROUP], "oldest", "newest", "differ")
    facts = agree.select(*_GROUP, "object_key", "corroboration").join(span, same(agree, span)).select(*[F.col(c).alias(f"_{c}") for c in (*_GROUP, "object_key")], "corroboration", "oldest", "newest", "differ")
    x = x.drop("corroboration")
    x = x.join(facts, [*same(x, facts), x["object_key"].eqNullSafe(facts["_object_key"])]).drop(*[f"_{c}" for c in (*_GROUP, "object_key")])
    zero = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    recency = F.when(F.col("ts").isNull(), 0.0).when(F.col("newest") == F.col("oldest"), 1.0).otherwise((F.col("ts") - F.col("oldest")).cast("double") / (F.col("newest") - F.col("oldest")).cast("double"))
    x = x.withColumn("recency", recency)
    support = F.least(F.lit(1.0), (F.col("corroboration") - 1).cast("double") / F.lit(2.0))
    raw = F.lit(w["authority"]) * zero("authority") + F.lit(w["recency"]) * F.col("recency") + F.lit(w["specificity"]) * zero("specificity") + F.lit(w["corroboration"]) * support + F.lit(w["hedging"]) * zero("hedging")
    arbitrated = schema.arbitrated()
    return x.withColumn("score", half_up(raw)).withColumn("competes", F.coalesce(F.col("differ"), F.lit(False)) & F.col("predicate").isin(*arbitrated)).drop("oldest", "newest", "differ")


def arbitrate(claims: DataFrame, schema: Schema | None = None) -> DataFrame:
    """Scored claims with status and the winner of their group (null where nothing competes).

    The winner has the highest score, then the oldest text of asserted_at, then the smallest key.
    """
    schema = schema or Schema()
    scored = score_claims(claims, schema)
    order = F.struct((-F.col("score")).alias("s"), F.coalesce(F.col("asserted_at").cast("string"), F.lit("")).alias("at"), F.col("claim_key").alias("key"), F.col("object_key").alias("object"), F.col("source_tool").alias("tool"), F.col("authority").alias("authority"))
    winners = scored.where("competes").groupBy(*_GROUP).agg(F.min(order).alias("w"))
    x = scored.drop("status").join(winners, _GROUP, "left")
    gap = half_up(-F.col("w.s") - F.col("score"))
    status = F.when(F.col("w").isNull() | (F.col("w.object") == F.col("object_key")), "current").when(gap < schema.margin, "contested").otherwise("superseded")
    return x.withColumn("status", status).withColumn("gap", F.when(F.col("w").isNotNull(), gap)).withColumn("winner_key", F.col("w.key")).withColumn("winner_score", -F.col("w.s")).withColumn("winner_tool", F.col("w.tool")).withColumn("winner_at", F.col("w.at")).withColumn("winner_authority", F.col("w.authority")).drop("w")


def decisions(claims: DataFrame, schema: Schema | None = None) -> DataFrame:
    """(winner, loser, relation, gap, reason) of every competing pair with different objects."""
    return decided(arbitrate(claims, schema), schema)


def decided(arbitrated: DataFrame, schema: Schema | None = None) -> DataFrame:
    """Decisions of claims that are arbitrated already."""
    schema = schema or Schema()
    x = arbitrated.where("status <> 'current'")
    two = lambda c: F.format_string("%.2f", F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    contested = F.concat(F.lit("contested: "), "winner_tool", F.lit(" "), two("winner_score"), F.lit(" vs "), "source_tool", F.lit(" "), two("score"), F.lit(" (gap "), two("gap"), F.lit(f" < {schema.margin})"))
    side = lambda tool, at, auth, score: [tool, F.lit(" ("), F.substring(F.coalesce(F.col(at).cast("string"), F.lit("")), 1, 10), F.lit(", authority "), two(auth), F.lit(", score "), two(score), F.lit(")")]
    beats = F.concat(*side("winner_tool", "winner_at", "winner_authority", "winner_score"), F.lit(" beats "), *side("source_tool", "asserted_at", "authority", "score"))
    return x.select(F.col("winner_key").alias("winner"), F.col("claim_key").alias("loser"), F.when(F.col("status") == "contested", "CONTRADICTS").otherwise("SUPERSEDES").alias("relation"), "gap", F.when(F.col("status") == "contested", contested).otherwise(beats).alias("reason"))


def as_of(claims: DataFrame, when: str, schema: Schema | None = None) -> DataFrame:
    """Arbitration from scratch over what was asserted by `when`; undated claims stay visible."""
    import datetime

    try:
        datetime.datetime.fromisoformat(when.replace("Z", "+00:00"))
    except ValueError as e:
        raise ValueError(f"as_of needs an ISO date or time, not {when!r}") from e
    ts = parse_ts(F.col("asserted_at")) if dict(claims.dtypes)["asserted_at"] == "string" else F.col("asserted_at").cast("timestamp")
    cutoff = F.lit(when if len(when) > 10 else f"{when}T00:00:00Z").cast("timestamp")
    return arbitrate(claims.where(ts.isNull() | (ts <= cutoff)), schema)
