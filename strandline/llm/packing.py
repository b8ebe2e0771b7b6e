"""Filling fixed-capacity containers with items (problem 8).

Bound-certified repacking. Texts are sized in tokens once. A text longer than
a container gives full pieces, which fill containers alone, and a rest. Items
fall by hash into partitions of bounded size; each is packed by best-fit
decreasing, and a lower bound from dual-feasible functions certifies its number
of bins. Certified partitions are done. The others keep their full bins and
put the items of the rest back; what came back is mixed over fewer new
partitions and packed again, until all is certified or the rounds are over.
Everything but the bounded partition runs as joins and aggregations.

Defined results: null texts and ids are no items; an empty text has size 0 and
lies in some container; repeated rows of one id are one item (the longest text); capacities null or below 1
are ignored.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.runtime import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenisation pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _sizer(path: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": [len(enc.encode_ordinary(t)) for t in b["text"]]})

    return run


def token_sizes(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of every text."""
    idt = documents.schema["doc_id"].dataType.simpleString()
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    return docs.mapInPandas(_sizer(path), f"doc_id {idt}, tokens bigint").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Bins needed at least, the best of two families of dual-feasible functions.

    Thresholds e <= c/2: sizes above c - e count as c, below e as 0. And for
    k = 1..30: size x counts as floor((k+1)x/c)/k of a bin, x/c where (k+1)x/c is whole.
    """
    c = int(capacity)
    n = np.zeros(c + 1, np.int64)
    np.add.at(n, sizes.astype(np.int64), 1 if counts is None else counts.astype(np.int64))
    n[0] = 0
    count, volume = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * np.arange(c + 1))])
    e = np.arange(0, c // 2 + 1)
    large = count[c + 1] - count[c - e + 1]
    best = max(int(len(sizes) > 0), int((large * c + volume[c - e + 1] - volume[e] + c - 1).max() // c))
    s = np.flatnonzero(n)
    for k in range(1, 31):
        whole = (k + 1) * s % c == 0
        scaled = np.where(whole, s * k, (k + 1) * s // c * c)  # in units of 1 / (k c)
        best = max(best, -(-int((scaled * n[s]).sum()) // (k * c)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item; a fitting bin with least free space is taken, else a new one."""
    bins = np.zeros(len(sizes), np.int64)
    free: list[int] = []  # distinct free amounts, ascending
    holders: dict[int, list[int]] = {}
    made = 0
    for i in np.argsort(-sizes, kind="stable"):
        need = int(sizes[i])
        k = bisect_left(free, need)
        if k < len(free):
            room = free[k]
            b = holders[room].pop()
            if not holders[room]:
                del holders[room], free[k]
        else:
            b, room, made = made, capacity, made + 1
        bins[i] = b
        left = room - need
        if left in holders:
            holders[left].append(b)
        else:
            holders[left] = [b]
            insort(free, left)
    return bins


def _pack(round_no: int, final: bool, slack: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        capacity, sizes = int(p["capacity"].iloc[0]), p["tokens"].to_numpy()
        bins = best_fit_decreasing(sizes, capacity)
        made, bound = int(bins.max()) + 1, lower_bound(sizes, capacity)
        fill = np.bincount(bins, weights=sizes, minlength=made)
        keep = np.full(made, final or made == bound) | (fill >= capacity * (1 - slack))
        part = p["part"].iloc[0]
        return pd.DataFrame({"container": p["container"], "capacity": p["capacity"], "doc_id": p["doc_id"], "piece": p["piece"], "tokens": p["tokens"], "bin": [f"r{round_no}-{part}-{b}" for b in bins], "done": keep[bins]})

    return run


def pack(sizes: DataFrame, capacities: DataFrame, per_partition: int = 20000, rounds: int = 4, slack: float = 0.002) -> DataFrame:
    """(container, capacity, bin, doc_id, piece, tokens): every item in one bin of each container kind."""
    idt = sizes.schema["doc_id"].dataType.simpleString()
    caps = capacities.where("container is not null and capacity_tokens >= 1").groupBy("container").agg(F.max("capacity_tokens").cast("bigint").alias("capacity"))
    pieces = sizes.join(caps, F.lit(True)).withColumn("full", F.expr("tokens div capacity")).withColumn("rest", F.expr("tokens % capacity"))
    full = pieces.where("full > 0").select("container", "capacity", "doc_id", F.explode(F.sequence(F.lit(1).cast("bigint"), "full")).alias("piece"))
    out = full.select("container", "capacity", F.concat(F.lit("whole-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("bin"), "doc_id", "piece", F.col("capacity").alias("tokens"))
    pool = pieces.where("rest > 0 or full = 0").select("container", "capacity", "doc_id", (F.col("full") + 1).alias("piece"), F.col("rest").alias("tokens"))
    schema = f"container string, capacity bigint, doc_id {idt}, piece bigint, tokens bigint, bin string, done boolean"
    for r in range(rounds):
        n = pool.groupBy("container").count().agg(F.max("count")).first()[0] or 0
        if not n:
            break
        parts = -(-n // per_partition)
        x = pool.withColumn("part", F.pmod(F.xxhash64(F.lit(r), "doc_id", "piece"), F.lit(parts)).cast("int"))
        packed = materialize(x.groupBy("container", "part").applyInPandas(_pack(r, r == rounds - 1, slack), schema), f"pack{r}")
        out = out.unionByName(packed.where("done").drop("done"))
        pool = packed.where("not done").drop("bin", "done")
    return out


def found(documents: DataFrame, capacities: DataFrame, path: str = VOCABULARY) -> DataFrame:
    return pack(materialize(token_sizes(documents, path), "tokens"), capacities).select("container", "bin", "doc_id", "piece", "tokens")


def quality(documents: DataFrame, capacities: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Per container kind: bins made, dual-feasible lower bound over all items, and share of space used."""
    packed = materialize(pack(materialize(token_sizes(documents, path), "tokens"), capacities), "packed")
    bins = packed.groupBy("container", "capacity").agg(F.countDistinct("bin").alias("n_bins"), F.sum("tokens").alias("n_tokens"))
    sizes = packed.groupBy("container", "capacity", "tokens").agg(F.count(F.lit(1)).alias("n"))  # at most capacity + 1 rows each

    def bound(p: pd.DataFrame) -> pd.DataFrame:
        low = lower_bound(p["tokens"].to_numpy(), int(p["capacity"].iloc[0]), p["n"].to_numpy())
        return pd.DataFrame({"container": [p["container"].iloc[0]], "lower_bound": [low]})

    low = sizes.groupBy("container").applyInPandas(bound, "container string, lower_bound bigint")
    return bins.join(low, "container").select("container", "n_bins", "lower_bound", F.round(F.col("n_tokens") / (F.col("n_bins") * F.col("capacity")), 6).alias("used"))
