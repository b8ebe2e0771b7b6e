"""TF-IDF retrieval and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.arbitrate import half_up
from strandline.runtime import broadcast_up_to, materialize


def terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0))


def tfidf_topk(docs: DataFrame, queries: DataFrame, k: int = 5, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query.

    docs: doc_id, text; queries: query_id, text. score is the sum over query
    tokens, repeats counting, of tf * idf / sqrt(document tokens) with
    idf = ln((n + 1) / (df + 1)) + 1; ties go to the higher doc_id.

    Weighted query terms are written, and go to all executors if they have at most `broadcast_rows` rows. The documents are then
    scored where they are read: the partial sums of a (query, document) meet in its own task, which ranks and keeps k a query, so
    no pair is shuffled. Beyond that number the terms are joined by a shuffle. Rows repeated for one doc_id are scored together.
    """
    d = docs.where("doc_id is not null").select("doc_id", terms(F.col("text")).alias("t"))
    d = materialize(d.select("doc_id", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf")).repartition("doc_id"), "terms")
    asked = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    wanted = broadcast_up_to(materialize(asked.select("term").distinct(), "wanted"), broadcast_rows)
    n_docs = docs.where("doc_id is not null").agg(F.countDistinct("doc_id")).first()[0]
    df = d.join(wanted, "term").groupBy("term").agg(F.countDistinct("doc_id").alias("df"))
    idf = F.log(F.lit(float(n_docs + 1)) / (F.col("df") + 1).cast("double")) + F.lit(1.0)
    weights = broadcast_up_to(materialize(asked.join(df, "term").select("query_id", "term", "qtf", idf.alias("idf")), "weights"), broadcast_rows)
    weight = F.col("qtf").cast("double") * F.col("tf").cast("double") * F.col("idf") / F.sqrt(F.col("len").cast("double"))
    # the rows of one document are brought together once; its sums then need no exchange
    scored = d.join(wanted, "term", "left_semi").repartition("doc_id").join(weights, "term").groupBy("doc_id", "query_id").agg(half_up(F.sum(weight), 6).alias("score")).where("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").desc())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def retrieval_metrics(hits: DataFrame, truth: DataFrame, kind: str = "kind") -> DataFrame:
    """Macro precision, recall, f1 and any-hit per question kind.

    hits: query_id, doc_id; truth: query_id, <kind>, doc_id. Questions without truth don't count; without hits they count 0.
    """
    h, t = hits.select("query_id", "doc_id").distinct(), truth.select("query_id", kind, "doc_id").distinct()
    n_hit = h.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hit"))
    per = t.join(h.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left").groupBy("query_id", kind).agg(F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("both")).join(n_hit, "query_id", "left")
    p = F.when(F.coalesce("n_hit", F.lit(0)) > 0, F.col("both") / F.col("n_hit")).otherwise(0.0)
    r = F.col("both") / F.col("n_true")
    per = per.withColumn("p", p).withColumn("r", r).withColumn("f1", F.when(F.col("both") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)).withColumn("any", (F.col("both") > 0).cast("double"))
    return per.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), *[half_up(F.avg(c)).alias(a) for c, a in (("p", "precision"), ("r", "recall"), ("f1", "f1"), ("any", "any_hit"))])


def abstention(outcomes: DataFrame) -> DataFrame:
    """Precision and recall of declining. outcomes: should_abstain, abstained (booleans); 1.0 where nothing is declined or due."""
    s, a = F.col("should_abstain"), F.col("abstained")
    x = outcomes.agg(F.count(F.when(s & a, 1)).alias("tp"), F.count(F.when(~s & a, 1)).alias("fp"), F.count(F.when(s & ~a, 1)).alias("fn"))
    return x.select("tp", "fp", "fn", half_up(F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(1.0)).alias("precision"), half_up(F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(1.0)).alias("recall"))


def index_percentiles(values: DataFrame, key: str, value: str, ranges: int = 64) -> DataFrame:
    """(key, n, p50, p95): the values at places n // 2 and int(n * 0.95) - 1 of the ascending order, null values left out.

    The different values are cut into ranges of all keys together; counts of (key, range) say which range holds a
    place, and only the values of that range are ordered, a (key, range) at a time. So no key, however
    hot or continuous, is ordered as a whole.
    """
    c = values.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    c = materialize(c.repartitionByRange(ranges, value).withColumn("range", F.spark_partition_id()), "counts")
    per = c.groupBy(key, "range").agg(F.sum("c").alias("m"))
    w = Window.partitionBy(key).orderBy("range")
    per = per.withColumn("upto", F.sum("m").over(w)).withColumn("before", F.col("upto") - F.col("m"))
    n = per.groupBy(key).agg(F.max("upto").alias("n"))
    places = n.select(key, "n", F.explode(F.array(F.struct(F.lit("p50").alias("p"), F.floor(F.col("n") / 2).alias("place")), F.struct(F.lit("p95").alias("p"), F.greatest(F.floor(F.col("n") * F.lit(0.95)) - 1, F.lit(0)).alias("place")))).alias("x")).select(key, "n", "x.p", "x.place")
    held = places.join(per, key).where((F.col("before") <= F.col("place")) & (F.col("place") < F.col("upto"))).select(key, "n", "p", "place", "range", "before")
    inside = held.join(c, [key, "range"])
    order = Window.partitionBy(key, "p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    hit = inside.withColumn("at", F.sum("c").over(order) + F.col("before")).where(F.col("at") > F.col("place"))
    return hit.groupBy(key).agg(F.first("n").alias("n"), F.min(F.when(F.col("p") == "p50", F.col(value))).alias("p50"), F.min(F.when(F.col("p") == "p95", F.col(value))).alias("p95"))
