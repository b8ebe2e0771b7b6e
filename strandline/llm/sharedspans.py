"""Long exact spans shared between records (problem 10).

A difference cover D modulo v holds, for every difference d, two members d
apart. If one text is cut at positions i and another at j, some k < v puts both
i + k and j + k on D; so windows of w = length - v + 1 characters hashed only at
positions in D meet in every pair of matching spans of `length` characters.

1. Exact copies collapse to one class each; a class of several records is
   shared as a whole and stands for its records.
2. Anchors (hash, class, position) are grouped by hash with map-side minimum
   and maximum of the class; hashes with one class drop out. What is left is written and counted: where it is small it
   goes to all executors, and no anchor is shuffled with its position; where not, a (skew-splitting) shuffle joins it.
3. A shared anchor extends: every span of `length` characters around it is
   hashed with two independent 64-bit hashes, and the spans that occur in a second class are kept. Their union
   is the shared part. No pairs of records are formed, so a passage held by a
   third of all records costs only its own length in each of them.

Positions are code points. Defined results: null texts and ids give nothing;
spans repeated inside one record only are not shared; repeated rows of one id
are one record; texts shorter than `length` share nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.runtime import broadcast_up_to, materialize

#: A perfect difference set, every difference modulo 91 once.
COVER, MODULUS = (0, 1, 3, 9, 27, 49, 56, 61, 77, 81), 91
#: Shared hashes up to this number (about 70 MB in memory) are sent to all executors; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_CHUNK = 1 << 18
_POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse modulo 2**64."""
    n = 1 << max(10, (n - 1).bit_length())
    if (base, n) not in _POWERS:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            f = np.full(n, b, np.uint64)
            f[0] = 1
            both.append(np.multiply.accumulate(f))
        for key in [k for k in _POWERS if k[0] == base]:
            del _POWERS[key]
        _POWERS[base, n] = (both[0], both[1])
    return _POWERS[base, n]


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def window_hashes(points: np.ndarray, starts: np.ndarray, width: int, base: int = _BASES[0]) -> np.ndarray:
    """Hashes of the windows of `width` code points at starts."""
    power, inverse = _powers(base, len(points) + 1)
    g = _mix(points.astype(np.uint64) + np.uint64(base & 0xFFFFFFFF)) | np.uint64(1)
    s = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(g * power[: len(points)], out=s[1:])
    return _mix((s[starts + width] - s[starts]) * inverse[starts]).view(np.int64)


def _chunks(b: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """Runs of rows of bounded text: code points, starts and lengths of the texts, first and last row."""
    texts = b["text"].tolist()
    sizes, first = np.array([len(t) for t in texts], np.int64), 0
    while first < len(texts):
        last, total = first, 0
        while last < len(texts) and (last == first or total + sizes[last] <= _CHUNK):
            total += sizes[last]
            last += 1
        n = sizes[first:last]
        yield code_points(texts[first:last]), np.cumsum(n) - n, n, first, last
        first = last


def _anchors(length: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    width = length - MODULUS + 1
    cover = np.array(COVER, np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for points, start, n, first, last in _chunks(b):
                turns = int((n.max() - width) // MODULUS) + 1
                grid = (np.arange(turns)[:, None] * MODULUS + cover).ravel()
                count = np.searchsorted(grid, n - width, side="right")
                row = np.repeat(np.arange(len(n)), count)
                at = grid[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
                h = window_hashes(points, start[row] + at, width)
                yield pd.DataFrame({"h": h, "cid": b["cid"].to_numpy()[first:last][row], "pos": at.astype(np.int32)})

    return run


def _spans(length: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for points, start, n, first, last in _chunks(b):
                open_ = np.zeros(len(points) + 1, np.int64)  # starts of spans that hold a shared anchor
                for k, pos in enumerate(b["pos"].iloc[first:last]):
                    a = np.asarray(pos, np.int64)
                    lo, hi = np.maximum(a - MODULUS + 1, 0), np.minimum(a, n[k] - length) + 1
                    ok = hi > lo
                    np.add.at(open_, start[k] + lo[ok], 1)
                    np.add.at(open_, start[k] + hi[ok], -1)
                at = np.flatnonzero(np.cumsum(open_) > 0)
                row = np.searchsorted(start, at, side="right") - 1
                yield pd.DataFrame({"h": window_hashes(points, at, length), "g": window_hashes(points, at, length, _BASES[1]), "cid": b["cid"].to_numpy()[first:last][row], "pos": (at - start[row]).astype(np.int32)})

    return run


def text_classes(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cid, several, text): one row per different text; (doc_id, cid): membership."""
    t = documents.where("doc_id is not null and text is not null").select("doc_id", F.sha2("text", 256).alias("k"), "text")
    classes = t.groupBy("k").agg(F.min("doc_id").alias("cid"), (F.min("doc_id") != F.max("doc_id")).alias("several"), F.first("text").alias("text"))
    classes = materialize(classes, "classes")
    members = t.select("doc_id", "k").distinct().join(classes.select("k", "cid"), "k").select("doc_id", "cid")
    return classes.select("cid", "several", "text"), members


def found(documents: DataFrame, length: int = 200, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, shared_chars) of the documents with shared_chars > 0."""
    if length < MODULUS + 32:
        raise ValueError(f"length must be at least {MODULUS + 32}")
    classes, members = text_classes(documents)
    idt = classes.schema["cid"].dataType.simpleString()
    texts = classes.where(F.length("text") >= length)
    anchors = texts.select("cid", "text").mapInPandas(_anchors(length), f"h bigint, cid {idt}, pos int")
    shared = anchors.groupBy("h").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo <> hi").select("h")
    where = anchors.join(broadcast_up_to(materialize(shared, "shared"), broadcast_rows), "h").groupBy("cid").agg(F.collect_list("pos").alias("pos"))
    open_ = materialize(texts.select("cid", "text").join(where, "cid"), "open")
    spans = open_.mapInPandas(_spans(length), f"h bigint, g bigint, cid {idt}, pos int")
    twice = spans.groupBy("h", "g").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo <> hi").select("h", "g")
    starts = spans.join(broadcast_up_to(materialize(twice, "twice"), broadcast_rows), ["h", "g"]).groupBy("cid").agg(F.array_sort(F.collect_list("pos")).alias("s"))
    covered = F.aggregate("s", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-length).cast("bigint").alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(length).cast("bigint"), x - a["last"])).alias("n"), x.cast("bigint").alias("last")), lambda a: a["n"])
    parts = starts.select("cid", covered.alias("n"))
    whole = texts.where("several").select("cid", F.length("text").cast("bigint").alias("n"))
    per_class = parts.unionByName(whole).groupBy("cid").agg(F.max("n").alias("shared_chars"))
    return members.join(per_class, "cid").select("doc_id", "shared_chars")


FOUND_SQL = """WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 200),
w AS (SELECT doc_id, i, substr(text, i, 200) AS s FROM d, unnest(range(1, length(text) - 198)) t(i)),
m AS (SELECT s FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)),
x AS (SELECT doc_id, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM w SEMI JOIN m USING (s))
SELECT doc_id, sum(coalesce(least(200, gap), 200))::BIGINT AS shared_chars FROM x GROUP BY doc_id"""
