"""Mixed timestamp formats and time zones to one instant (problem 6).

Every value is matched against a mixture of formats. Values that fit one format
settle themselves; those that fit several (3/4/2025) count for each in
proportion to how often its source uses it. Those shares are the mixture
weights of expectation-maximisation: the table of (source, set of valid
formats, count) is gathered by Spark, EM runs on the few counts of one source,
and the posterior chooses the reading. A posterior below `sure` leaves the value
unresolved, and marks it so instead of guessing. A clock table, if given, is
the Dirichlet prior on the order of slashed dates.

Local times are read in the clock of the value's source. In the hour repeated
when daylight saving ends, a standard-time abbreviation picks the second pass,
anything else the first; times skipped in spring are read with the offset
before the change.

Defined results: null, blank, word ("TBD") and impossible values (month 13) are
`unparsed`, without an instant; sources missing from the clock table are read
as UTC with no preferred order; parts finer than a microsecond are cut off.
All parsing stays in JVM expressions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.runtime import materialize

_ZONE = r"(Z|(?:UTC|GMT)?[+-]\d{2}:?\d{2}|[A-Z]{2,5})?"
_TAIL = r"\s*" + _ZONE + r"\s*(?:\[[A-Z0-9_/+\-]+\])?$"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*(AM|PM)?"
#: family -> shape that lets the pattern be tried, pattern, replacement giving year|month|day|hour|minute|second|fraction|half of day|zone
FAMILIES = {
    "iso": (r"^\d{4}-", r"^(\d{4})-(\d{2})-(\d{2})(?:[T ]+" + _CLOCK + ")?" + _TAIL, "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    "compact": (r"^\d{8}(\D|$)", r"^(\d{4})(\d{2})(\d{2})(?:[T ]+(\d{2}):?(\d{2}):?(\d{2})(?:[.,](\d+))?())?" + _TAIL, "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    "mail": (r"^([A-Z]{3,9},? )?\d{1,2} [A-Z]", r"^(?:[A-Z]{3,9},?\s+)?(\d{1,2})\s+([A-Z]{3,9})\s+(\d{4})(?:\s+" + _CLOCK + ")?" + _TAIL, "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    "text": (r"^[A-Z]{3,9} \d", r"^([A-Z]{3,9})\s+(\d{1,2}),?\s+(\d{4})(?:,?\s+" + _CLOCK + ")?" + _TAIL, "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    "dotted": (r"^\d{1,2}\.\d{1,2}\.", r"^(\d{1,2})\.(\d{1,2})\.(\d{4})(?:,?\s+" + _CLOCK + ")?" + _TAIL, "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    "slash": (r"^\d{1,2}/", r"^(\d{1,2})/(\d{1,2})/(\d{4})(?:,?\s+" + _CLOCK + ")?" + _TAIL, "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
}
EPOCHS = {"epoch_s": 10**6, "epoch_ms": 10**3, "epoch_us": 1}
#: Instants outside are no plausible reading of a bare number.
EARLIEST_US, LATEST_US = 631152000000000, 4102444800000000
#: Zone abbreviations of standard time; these pick the second pass of a repeated hour.
STANDARD = ("EST", "CST", "MST", "PST", "AKST", "HST", "CET", "WET", "EET", "GMT", "AEST", "ACST", "AWST", "NZST", "IST", "JST", "KST", "SAST")
UNIVERSAL = ("UTC", "Z", "UT")
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]


def _instant(p: Column, m: Column, d: Column, tz: Column) -> Column:
    """Microseconds of the parts p (in FAMILIES' order) with month m and day d, null if impossible."""
    number = lambda c: F.when(c == "", 0).otherwise(c.try_cast("int"))
    month = F.when(m.rlike(r"^\d"), m.try_cast("int")).otherwise(F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(m, 1, 3)).cast("int"))
    half, zone = p[7], p[8]
    hour = F.when(half == "", number(p[3])).when(number(p[3]).between(1, 12), number(p[3]) % 12 + F.when(half == "PM", 12).otherwise(0))
    second = F.concat(F.when(p[5] == "", "00").otherwise(p[5]), F.lit("."), F.substring(F.rpad(p[6], 6, "0"), 1, 6)).try_cast("decimal(8,6)")
    fits = month.between(1, 12) & (hour < 24) & (number(p[4]) < 60) & (number(p[5]) < 60)
    local = F.try_make_timestamp(p[0].try_cast("int"), month, d.try_cast("int"), hour, number(p[4]), second, F.lit("UTC"))
    offset = F.when(zone.rlike(r"[+-]\d{2}:?\d{2}$"), F.replace(F.right(zone, F.lit(6)), F.lit(":"), F.lit("")))
    minutes = F.substring(F.right(offset, F.lit(4)), 1, 2).try_cast("bigint") * 60 + F.right(offset, F.lit(2)).try_cast("bigint")
    us = F.unix_micros(local)
    first = F.to_utc_timestamp(local, tz)
    again = first + F.expr("interval 1 hour")
    late = zone.isin(*STANDARD) & (F.from_utc_timestamp(again, tz) == local)
    in_clock = F.when(late, F.unix_micros(again)).otherwise(F.unix_micros(first))
    exact = us - F.when(zone.contains("-"), -minutes).otherwise(minutes) * 60000000
    return F.when(fits, F.when(offset.isNotNull(), exact).when(zone.isin(*UNIVERSAL), us).otherwise(in_clock))


def _epoch(v: Column, scale: int) -> Column:
    whole = F.regexp_extract(v, r"^(\d{9,19})(?:\.(\d+))?$", 1).try_cast("bigint")
    frac = F.substring(F.rpad(F.regexp_extract(v, r"^(\d{9,19})(?:\.(\d+))?$", 2), 6, "0"), 1, 6).try_cast("bigint")
    ok = v.rlike(r"^\d{9,19}(\.\d+)?$") & (whole <= LATEST_US // scale) & (whole >= EARLIEST_US // scale)
    return F.when(ok, whole * scale + F.floor(frac * scale / 1000000).cast("bigint"))


def readings(values: DataFrame, clocks: DataFrame) -> DataFrame:
    """Adds tz, day_first and `fits` map<format, epoch_us> of all valid readings. values: value, source, ..."""
    c = clocks.where("tool is not null").groupBy("tool").agg(F.max("tz_name").alias("_tz"), F.max("day_first").alias("_first")).withColumnRenamed("tool", "_tool")
    x = values.join(c, F.col("source") == F.col("_tool"), "left").drop("_tool").withColumn("_tz", F.coalesce("_tz", F.lit("UTC")))
    x = x.withColumn("_v", F.upper(F.trim(F.regexp_replace("value", r"[\s ]+", " "))))
    v = F.col("_v")
    digits = v.rlike(r"^\d{9,19}(\.\d+)?$")
    family = F.when(digits, "epoch")
    for f, (shape, _, _) in FAMILIES.items():
        family = family.when(v.rlike(shape), f)
    x = x.withColumn("_family", family)
    parts = F.lit(None).cast("string")
    for f, (_, pattern, order) in FAMILIES.items():
        parts = F.when(F.col("_family") == f, F.regexp_replace(v, pattern, order)).otherwise(parts)
    x = x.withColumn("_p", F.split(parts, r"\|")).withColumn("_p", F.when(F.size("_p") == 9, F.col("_p")))
    p, tz, slash = F.col("_p"), F.col("_tz"), F.col("_family") == "slash"
    # written order for all families; for slashes, day first and then month first
    x = x.withColumn("_a", F.when(p.isNotNull(), _instant(p, p[1], p[2], tz))).withColumn("_b", F.when(slash & p.isNotNull(), _instant(p, p[2], p[1], tz)))
    named = [F.struct(F.when(slash, "slash_dmy").otherwise(F.col("_family")).alias("f"), F.col("_a").alias("us")), F.struct(F.lit("slash_mdy").alias("f"), F.col("_b").alias("us"))]
    named += [F.struct(F.lit(f).alias("f"), F.when(digits, _epoch(v, s)).alias("us")) for f, s in EPOCHS.items()]
    return x.withColumn("fits", F.filter(F.array(*named), lambda r: r["us"].isNotNull())).drop("_v", "_tz", "_family", "_p", "_a", "_b")


def _em(prior_day_first: bool | None, sets: list[list[str]], counts: list[float], strength: float = 20.0, rounds: int = 60) -> dict[str, float]:
    """Mixture weights of one source from counts of sets of valid formats."""
    names = sorted({f for s in sets for f in s})
    alpha = dict.fromkeys(names, 0.5)
    if prior_day_first is not None:
        alpha |= {"slash_dmy": strength if prior_day_first else 0.02, "slash_mdy": 0.02 if prior_day_first else strength}
    weight = {f: 1.0 / max(1, len(alpha)) for f in alpha}
    for _ in range(rounds):
        mass = dict(alpha)
        for s, n in zip(sets, counts, strict=True):
            whole = sum(weight[f] for f in s)
            for f in s:
                mass[f] += n * weight[f] / whole if whole else 0.0
        total = sum(mass.values())
        weight = {f: m / total for f, m in mass.items()}
    return weight


def mixture(read: DataFrame) -> DataFrame:
    """(source, weights map<format, weight>) by EM over the counts of each source."""
    counts = read.select("source", "_first", F.transform("fits", lambda r: r["f"]).alias("s")).where(F.size("s") > 0).groupBy("source", "_first", "s").agg(F.count(F.lit(1)).cast("double").alias("n"))

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        first = p["_first"].iloc[0]
        w = _em(None if first is None or pd.isna(first) else bool(first), [list(s) for s in p["s"]], p["n"].tolist())
        return pd.DataFrame({"src": [p["source"].iloc[0]], "weights": [w]})

    return materialize(counts.groupBy("source").applyInPandas(fit, "src string, weights map<string,double>"), "mixture")


def normalise(values: DataFrame, clocks: DataFrame, sure: float = 0.9) -> DataFrame:
    """Adds epoch_us, format, posterior and state (resolved, ambiguous, unparsed) to values(value, source, ...).

    Ambiguous values keep the likelier format and posterior but have no epoch_us.
    """
    # written once for both passes; it also keeps filters on the outcome from being rewritten into the parsing
    read = materialize(readings(values, clocks), "readings")
    x = read.join(mixture(read), F.col("source").eqNullSafe(F.col("src")), "left").drop("src")
    scored = F.transform("fits", lambda r: F.struct(F.coalesce(F.element_at("weights", r["f"]), F.lit(0.0)).alias("w"), r["f"].alias("f"), r["us"].alias("us")))
    x = x.withColumn("_s", scored)
    x = x.withColumn("_all", F.aggregate("_s", F.lit(0.0), lambda a, r: a + r["w"])).withColumn("_best", F.array_max("_s"))
    # readings that agree on the instant count together
    x = x.withColumn("_mass", F.aggregate("_s", F.lit(0.0), lambda a, r: a + F.when(r["us"] == F.col("_best.us"), r["w"]).otherwise(0.0)))
    x = x.withColumn("posterior", F.when(F.size("fits") > 0, F.when(F.col("_all") > 0, F.col("_mass") / F.col("_all")).otherwise(1.0 / F.size("fits"))))
    x = x.withColumn("state", F.when(F.size("fits") == 0, "unparsed").when(F.col("posterior") >= sure, "resolved").otherwise("ambiguous"))
    x = x.withColumn("format", F.col("_best.f")).withColumn("epoch_us", F.when(F.col("state") == "resolved", F.col("_best.us")))
    return x.drop("fits", "weights", "_s", "_all", "_best", "_mass", "_first")


def stamped_values(raw_docs: DataFrame, extracted: DataFrame) -> DataFrame:
    """(table_name, row_key, field, source, value) of all time fields, repeats once."""
    docs = raw_docs.select(F.lit("raw_docs").alias("table_name"), F.col("doc_id").alias("row_key"), F.col("tool").alias("source"), F.explode(F.array(F.struct(F.lit("created_at").alias("field"), F.col("created_at").alias("value")), F.struct(F.lit("updated_at").alias("field"), F.col("updated_at").alias("value")))).alias("x")).select("table_name", "row_key", "x.field", "source", "x.value")
    claims = extracted.select(F.lit("extracted_claims").alias("table_name"), F.col("xc_id").cast("string").alias("row_key"), F.lit("asserted_at").alias("field"), F.col("source_tool").alias("source"), F.col("asserted_at").alias("value"))
    return docs.unionByName(claims).where("value is not null and row_key is not null").distinct()


def found(raw_docs: DataFrame, extracted: DataFrame, clocks: DataFrame) -> DataFrame:
    x = normalise(stamped_values(raw_docs, extracted), clocks)
    return x.where("state = 'resolved'").select("table_name", "row_key", "field", "epoch_us").distinct()
