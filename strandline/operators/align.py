"""Alignment of extracted (tier B) claims with known entities and the vocabulary."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import DETERMINERS, norm, strip_determiners, token_set_ratio_of
from strandline.plans.ontology import Schema
from strandline.runtime import materialize

RATIO, SHARED = 90.0, 4


def known_entities(tier_a: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(known_norm, display, known_type): surfaces that structured fields establish, then document titles standing for their key. Smallest display wins."""
    x = tier_a.select(F.explode(F.array(F.struct(F.col("subject_surface").alias("s"), F.col("subject_type").alias("t")), F.struct(F.col("object_surface").alias("s"), F.col("object_type").alias("t")))).alias("e")).where("e.s is not null and e.s <> '' and e.t not in ('Person', 'Artifact')")
    x = x.select(norm(F.col("e.s")).alias("known_norm"), F.col("e.s").alias("display"), F.col("e.t").alias("known_type"), F.lit(0).alias("rank"))
    if docs is not None:
        x = x.unionByName(docs.where("title is not null").select(norm(F.col("title")).alias("known_norm"), F.col("key").alias("display"), F.lit("Artifact").alias("known_type"), F.lit(1).alias("rank")))
    return x.where("known_norm <> ''").groupBy("known_norm").agg(F.min(F.struct("rank", "display", "known_type")).alias("r")).select("known_norm", "r.display", "r.known_type")


# Most surfaces, and most known entities, that one task compares.
TILE = 4000
# Pairs that aren't worth counting letters for, and groups that words are put into.
FEW, GROUPS = 16, 256
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _bags(texts: list[str], most: int) -> np.ndarray:
    """Letters and digits of each text as flags: whether it has the letter once, twice and so on. A product of two rows counts the letters that both have."""
    counts = np.array([[t.count(c) for c in _LETTERS] for t in texts])
    return np.concatenate([counts > n for n in range(most)], axis=1).astype("float32")


def _near_all(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """_near() of each word of one type; words come together in a group, as most have few texts."""
    names = dict(tuple(right.groupby("w")))
    done = [_near(key, x, names[w]) for w, x in left.groupby("w") if w in names]
    return pd.concat(done, ignore_index=True) if done else pd.DataFrame([], columns=["s", "k", "score", "type"])


def _near(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Pairs of texts (s, k) of one type and one common word, each with its ratio of RATIO or more.

    Letters that only one of two texts has bound the ratio from above; that settles most pairs by arithmetic.
    """
    a, b, out = left["s"].tolist(), right["k"].tolist(), []
    if len(a) * len(b) <= FEW:
        out = [(p, q, r) for p in a for q in b if (r := token_set_ratio_of(p, q)) >= RATIO]
    else:
        most = min(max(max(map(t.count, _LETTERS)) for t in side) for side in (a, b))
        x, y = _bags(a, most), _bags(b, most)
        used = x.any(0) & y.any(0)
        x, y = x[:, used], y[:, used].T.copy()
        letters = lambda side: np.array([len(t) - t.count(" ") for t in side])
        la, lb, na, nb = np.array([len(t) for t in a]), np.array([len(t) for t in b]), letters(a), letters(b)
        # what both texts may have apart; what one may have beside the words that both have
        apart, beside = 1 - RATIO / 100, (q := 2 * (100 - RATIO) / RATIO) / (1 + q)
        for i in range(0, len(a), step := max(1, 2_000_000 // len(b))):
            both = x[i : i + step] @ y
            only_a, only_b, n = na[i : i + step, None] - both, nb - both, la[i : i + step, None]
            maybe = (only_a + only_b <= apart * (n + lb) + 1e-3) | (only_a + 1 <= beside * n + 1e-3) | (only_b + 1 <= beside * lb + 1e-3)
            for p, q in zip(*np.nonzero(maybe), strict=True):
                if (r := token_set_ratio_of(a[i + p], b[q])) >= RATIO:
                    out.append((a[i + p], b[q], r))
    return pd.DataFrame(out, columns=["s", "k", "score"]).assign(type=key[0])


def best_matches(surfaces: DataFrame, known: DataFrame) -> DataFrame:
    """(surface, type, display, known_type): the best known entity of each (surface, type), if any.

    A match must share a word of four letters or more. Where one side's words hold the other's, the pair meets at
    the rarest long word of the smaller side. The rest must have the same type, and are compared as different texts
    per common word in tiles, however frequent the word is.
    """
    words = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(c, " "), lambda w: (w != "") & ~w.isin(*DETERMINERS))))
    long = lambda c: F.filter(c, lambda w: F.length(w) >= SHARED)
    s = materialize(surfaces.select("surface", "type").distinct().withColumn("ws", words(norm(F.col("surface")))).withColumn("s", F.array_join("ws", " ")), "surface_words")
    k = materialize(known.withColumn("wk", words(F.col("known_norm"))).where(F.size("wk") > 0).withColumn("k", F.array_join("wk", " ")), "known_words")
    texts = s.select("s", "ws").distinct()
    names = k.select("k", "wk").distinct()
    by_s, by_k = (materialize(x.select(t, F.explode(long(F.col(w))).alias("w")), "long_words") for x, t, w in ((texts, "s", "ws"), (names, "k", "wk")))

    def rarest(small: DataFrame, t: str, large: DataFrame) -> DataFrame:
        """The text's long word that fewest of the other side have; none if one of them is in no text there."""
        n = large.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
        least = small.join(n, "w", "left").groupBy(t).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w")).alias("r"))
        return least.where("r.n > 0").select(t, F.col("r.w").alias("w"))

    holds = lambda large, small: F.size(F.array_except(small, large)) == 0
    split = lambda c: F.split(c, " ")
    inside = rarest(by_k, "k", by_s).join(by_s, "w").where(holds(split("s"), split("k"))).select("s", "k")
    around = rarest(by_s, "s", by_k).join(by_k, "w").where(holds(split("k"), split("s"))).select("s", "k")
    whole = s.select("surface", "type", "s").join(inside.unionByName(around).distinct(), "s").withColumn("score", F.lit(100.0)).join(k.select("k", "known_norm", "display", "known_type"), "k")
    typed = lambda x, t, c, kind: materialize(x.select(F.col(kind).alias("type"), t, c).distinct().select("type", t, F.explode(long(F.col(c))).alias("w")), "typed_words")
    left, right = typed(s, "s", "ws", "type"), typed(k, "k", "wk", "known_type")
    n = lambda x, c: x.groupBy("type", "w").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias(c))
    tiles = materialize(n(left, "ns").join(n(right, "nk"), ["type", "w"]), "tiles")
    tile = lambda t, c: F.pmod(F.xxhash64(t), F.col(c)).cast("int")
    left = left.join(tiles, ["type", "w"]).select("type", "w", "s", tile("s", "ns").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nk") - 1)).alias("j"))
    right = right.join(tiles, ["type", "w"]).select("type", "w", "k", tile("k", "nk").alias("j"), F.explode(F.sequence(F.lit(0), F.col("ns") - 1)).alias("i"))
    at = ["type", "g", "i", "j"]
    # their number of tasks is fixed, as their bytes don't tell their work
    dealt = lambda x: x.withColumn("g", F.pmod(F.xxhash64("w"), F.lit(GROUPS))).repartition(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), *at)
    near = dealt(left).groupBy(*at).cogroup(dealt(right).groupBy(*at)).applyInPandas(_near_all, "s string, k string, score double, type string").where("score < 100").distinct()
    like = s.select("surface", "type", "s").join(near, ["s", "type"]).join(k.select("k", "known_norm", "display", "known_type", F.col("known_type").alias("type")), ["k", "type"])
    x = whole.unionByName(like)
    best = x.groupBy("surface", "type").agg(F.max(F.struct("score", (F.col("known_type") == F.col("type")).alias("own"), F.length("known_norm").alias("len"), "known_norm", "display", "known_type")).alias("r"))
    return best.select("surface", "type", "r.display", "r.known_type")


def orient(claims: DataFrame, schema: Schema | None = None) -> DataFrame:
    """Claims put the way the vocabulary wants them, with columns `action` (kept, flipped, remapped, inverted, dropped, unmapped).

    Orientation, then remapping by subject type, then rewriting to the functional inverse. Dropped claims stay as rows for the report.
    """
    schema = schema or Schema()
    spark = claims.sparkSession
    spec = F.broadcast(schema.predicate_table(spark))  # one row per predicate of the vocabulary
    x = claims.join(spec, "predicate", "left")
    fits = F.array_contains("domain", F.col("subject_type")) & F.array_contains("range", F.col("object_type"))
    turned = F.array_contains("domain", F.col("object_type")) & F.array_contains("range", F.col("subject_type"))
    x = x.withColumn("known", F.col("domain").isNotNull()).withColumn("swap1", F.col("known") & ~F.coalesce(fits, F.lit(False)) & F.coalesce(turned, F.lit(False))).withColumn("drop", F.col("known") & ~F.coalesce(fits, F.lit(False)) & ~F.coalesce(turned, F.lit(False)))

    def swapped(df: DataFrame, flag: str) -> DataFrame:
        return df.withColumns({a: F.when(F.col(flag), F.col(b)).otherwise(F.col(a)) for a, b in (("subject_surface", "object_surface"), ("object_surface", "subject_surface"), ("subject_type", "object_type"), ("object_type", "subject_type"))})

    x = swapped(x, "swap1")
    target = spec.select(F.col("predicate").alias("p2"), F.col("domain").alias("d2"), F.col("range").alias("r2"), F.col("cardinality").alias("c2"), F.col("inverse").alias("i2"), F.col("temporal").alias("t2"))
    x = x.withColumn("to", F.when(F.col("known") & ~F.col("drop"), F.try_element_at("remap", F.col("subject_type")))).join(target, F.col("to") == F.col("p2"), "left")
    x = x.withColumn("remapped", F.coalesce(F.array_contains("d2", F.col("subject_type")) & F.array_contains("r2", F.col("object_type")), F.lit(False)))
    x = x.withColumn("predicate", F.when(F.col("remapped"), F.col("p2")).otherwise(F.col("predicate"))).withColumn("inverse", F.when(F.col("remapped"), F.col("i2")).otherwise(F.col("inverse"))).withColumn("one", F.when(F.col("remapped"), F.col("c2")).otherwise(F.col("cardinality")) == "one").drop("p2", "d2", "r2", "c2", "i2", "t2", "to")
    inv = spec.select(F.col("predicate").alias("p3"), F.col("domain").alias("d3"), F.col("range").alias("r3"), F.col("cardinality").alias("c3"))
    x = x.join(inv, F.col("inverse") == F.col("p3"), "left")
    x = x.withColumn("invert", F.coalesce(F.col("known") & ~F.col("drop") & ~F.col("one") & (F.col("c3") == "one") & F.array_contains("d3", F.col("object_type")) & F.array_contains("r3", F.col("subject_type")), F.lit(False)))
    x = swapped(x, "invert").withColumn("predicate", F.when(F.col("invert"), F.col("p3")).otherwise(F.col("predicate")))
    action = F.when(~F.col("known"), "unmapped").when(F.col("drop"), "dropped").when(F.col("invert"), "inverted").when(F.col("remapped"), "remapped").when(F.col("swap1"), "flipped").otherwise("kept")
    return x.withColumn("action", action).select(*claims.columns, "action")


def align(claims: DataFrame, known: DataFrame, schema: Schema | None = None) -> DataFrame:
    """Aligned claims with `action`; tier A passes untouched, people keep their surface. Each different surface of a type is cleaned and matched once."""
    b = claims.where("tier = 'B'")
    end = lambda side: b.select(F.col(f"{side}_surface").alias("raw"), F.col(f"{side}_type").alias("type"))
    ends = materialize(end("subject").unionByName(end("object")).distinct().withColumn("surface", strip_determiners(F.col("raw"))), "surfaces")
    m = best_matches(ends.where("type <> 'Person'").select("surface", "type"), known)
    m = ends.join(m, ["surface", "type"], "left").select("raw", F.col("type").alias("old"), F.coalesce("display", "surface").alias("new_surface"), F.coalesce("known_type", "type").alias("new_type"))
    m = materialize(m, "matches")
    for side in ("subject", "object"):
        b = b.join(m, F.col(f"{side}_surface").eqNullSafe(F.col("raw")) & F.col(f"{side}_type").eqNullSafe(F.col("old")), "left").withColumn(f"{side}_surface", F.col("new_surface")).withColumn(f"{side}_type", F.col("new_type")).select(*claims.columns)
    a = claims.where("tier is null or tier <> 'B'").withColumn("action", F.lit("untouched"))
    return a.unionByName(orient(b, schema))
