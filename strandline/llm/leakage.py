"""Evaluation texts leaking into training text (problem 9).

Wu-Manber multi-pattern search over words. The test strings are all runs of
`m` (10) consecutive words of the items. A shift table over blocks of two
words tells how far a cursor may jump; a block that ends no test string lets it
skip up to m - 1 words. Where the shift is 0, the block's bucket names the few
test strings with that suffix, and they are compared word by word. The cursors
of all documents of a batch move together as one array.

Items are read in blocks of at most `block` items; each block's tables travel
with the task, so their size is bounded by parameters, and all documents are
searched against every block.

Defined results: null texts and items with fewer than m words give nothing;
an item that repeats a passage is reported once per document; equal passages
of several items report each of them; repeated rows count once.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁤⁪-⁯︀-️﻿]")
_BROKEN_WORD = re.compile(r"(?<=[^\W\d_])[-‐‑][ \t]*\r?\n(?:[ \t]*[>|])*[ \t]*(?=[^\W\d_])")
_SOFT_BREAK = re.compile("­[ \t]*\r?\n(?:[ \t]*[>|])*[ \t]*")
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>\n]{0,200})?/?>")
_WORD = re.compile(r"[^\W_]+")
_TABLE_BITS = 20


def words(text: str) -> list[str]:
    """Words of a text as problem 9 counts them."""
    if not text.isascii():
        text = _INVISIBLE.sub("", _SOFT_BREAK.sub("", unicodedata.normalize("NFC", text)))
    if "\n" in text:
        text = _BROKEN_WORD.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(text.casefold())


class WuManber:
    """Shift, bucket and pattern tables for equal-length word strings."""

    def __init__(self, items: list[tuple[int, str]], m: int = 10) -> None:
        if m < 3:
            raise ValueError("m must be at least 3")
        self.m, self.vocabulary, rows, owners = m, {}, [], []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            for k in range(len(ids) - m + 1):
                rows.append(ids[k : k + m])
                owners.append(item)
        self.patterns = np.array(rows, np.int64).reshape(-1, m)
        owner = np.array(owners, np.int64)
        size = 1 << _TABLE_BITS
        self.shift = np.full(size, m - 1, np.int64)
        for end in range(1, m):
            np.minimum.at(self.shift, self._block(self.patterns[:, end - 1], self.patterns[:, end]), m - 1 - end)
        suffix = self._block(self.patterns[:, m - 2], self.patterns[:, m - 1]) if len(rows) else np.zeros(0, np.int64)
        order = np.argsort(suffix, kind="stable")
        self.patterns, self.owner = self.patterns[order], owner[order]
        self.bucket = np.searchsorted(suffix[order], np.arange(size + 1))

    @staticmethod
    def _block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * 0x9E3779B1 + b * 0x85EBCA77) >> 7) & ((1 << _TABLE_BITS) - 1)

    def search(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, item) of every occurrence, without repeats."""
        ids: list[np.ndarray] = []
        get = self.vocabulary.get
        for t in texts:
            w = words(t) if t else []
            ids.append(np.fromiter((get(x, 0) for x in w), np.int64, len(w)))
        lengths = np.array([len(x) for x in ids], np.int64)
        stream = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        stop = np.cumsum(lengths)
        doc = np.flatnonzero(lengths >= self.m)
        at = (stop - lengths)[doc] + self.m - 1
        hits: list[np.ndarray] = []
        while len(doc):
            block = self._block(stream[at - 1], stream[at])
            jump = self.shift[block]
            stopped = np.flatnonzero(jump == 0)
            if len(stopped):
                where, b = at[stopped], block[stopped]
                window = stream[where[:, None] + np.arange(1 - self.m, 1)]
                first, count = self.bucket[b], self.bucket[b + 1] - self.bucket[b]
                for k in range(int(count.max())):
                    left = np.flatnonzero(count > k)
                    p = first[left] + k
                    same = (self.patterns[p] == window[left]).all(axis=1)
                    hits.append(np.stack([doc[stopped][left[same]], self.owner[p[same]]]))
            at = at + np.maximum(jump, 1)
            alive = at < stop[doc]
            doc, at = doc[alive], at[alive]
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.concatenate(hits, axis=1), axis=1)
        return both[0], both[1]


def _searcher(items: list[tuple[int, str]], m: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = WuManber(items, m)
        for b in batches:
            for k in range(0, len(b), 2000):
                part = b.iloc[k : k + 2000]
                row, item = tables.search(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[row], "item_id": item})

    return run


def found(documents: DataFrame, items: DataFrame, m: int = 10, block: int = 20000) -> DataFrame:
    """(doc_id, item_id) where the document holds m consecutive words of the item."""
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    out, part = None, []

    def search(some: list[tuple[int, str]]) -> DataFrame:
        return docs.mapInPandas(_searcher(some, m), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id bigint")

    for r in items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint"), "text").toLocalIterator():
        part.append((r[0], r[1]))
        if len(part) == block:
            out, part = search(part) if out is None else out.unionByName(search(part)), []
    if part or out is None:
        out = search(part) if out is None else out.unionByName(search(part))
    return out.distinct()


def leaked_items(documents: DataFrame, items: DataFrame, m: int = 10) -> DataFrame:
    """Report per item: in how many documents it leaked (0 if none)."""
    n = found(documents, items, m).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    ids = items.select(F.col("item_id").cast("bigint").alias("item_id"), "category").distinct()
    return ids.join(n, "item_id", "left").select("item_id", "category", F.coalesce("n_docs", F.lit(0)).cast("bigint").alias("n_docs"))


_WORDS_SQL = r"""regexp_extract_all(lower(regexp_replace(regexp_replace({x}, '[\x{{00AD}}\x{{200B}}-\x{{200F}}\x{{2060}}-\x{{2064}}\x{{FEFF}}]', '', 'g'), '(\pL)-[ \t]*\r?\n(?:[ \t]*[>|])*[ \t]*(\pL)', '\1\2', 'g')), '[\pL\pN]+')"""
FOUND_SQL = f"""WITH i AS (SELECT item_id, {_WORDS_SQL.format(x="text")} AS w FROM eval_items WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 9], ' ') AS s FROM i, unnest(range(1, len(w) - 8)) t(k)),
d AS (SELECT doc_id, {_WORDS_SQL.format(x="text")} AS w FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, array_to_string(w[k:k + 9], ' ') AS s FROM d, unnest(range(1, len(w) - 8)) t(k))
SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (s)"""
LEAKED_SQL = f"""SELECT e.item_id, e.category, count(DISTINCT f.doc_id) AS n_docs FROM (SELECT DISTINCT item_id, category FROM eval_items) e LEFT JOIN ({FOUND_SQL}) f ON e.item_id = f.item_id GROUP BY ALL"""
