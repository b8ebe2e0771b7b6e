"""Deeply nested semi-structured records as linked flat rows (problem 5).

Records of an Arrow batch are laid end to end in one byte buffer and indexed
with whole-array operations: a bitmap of quotes that no backslash run escapes, its running
parity (inside a string or not), a bitmap of structural brackets, colons and
commas outside strings, and nesting depth as a prefix sum over brackets. For
each depth, binary search links every bracket to the container it lies in and
counts the commas before it, which is its array index. Strings that hold JSON
arrays (or a whole record) are cut out and indexed in the next sweep under the path of the
string, so text-in-text nests to any depth.

Which lone objects count as element 0 depends on all records of a tool. The
batch pass therefore emits object paths as segments with an open choice at each
lone object; the distinct array paths of (table, tool) settle the choices in
one join. That side is as small as the schema; Spark broadcasts it only if its
written size allows, and sorts and merges otherwise.

Defined results: null, empty and unparseable records give nothing; null
elements give no row but count as positions; repeated rows count once, the
latest loaded one of an owner wins; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_QUOTE, _SLASH = ord('"'), ord("\\")
_OPEN, _CLOSE = np.zeros(256, bool), np.zeros(256, bool)
_OPEN[[ord("{"), ord("[")]] = True
_CLOSE[[ord("}"), ord("]")]] = True
_SCHEMA = "kind string, tbl string, tool string, owner_id string, segs array<string>, alts array<string>"


def structural_index(docs: list[bytes]) -> dict[str, np.ndarray]:
    """Index of valid JSON texts laid end to end.

    Returns, for every structural token outside strings: `pos` in the joined
    buffer, `ch`, `depth` (containers around it, an opener not counting
    itself), `inside` (token number of the opener of its container, -1 at the
    root) and `index` (commas of that container before it); besides `start`
    (of each text), `quotes` (positions of real quotes) and the buffer `buf`.
    """
    start = np.cumsum([0] + [len(d) + 1 for d in docs])
    buf = np.frombuffer(b"\n".join(docs) + b"\n", np.uint8)
    at = np.arange(len(buf))
    quote = np.flatnonzero(buf == _QUOTE)
    plain = np.maximum.accumulate(np.where(buf != _SLASH, at, -1))  # last byte that is no backslash
    before = np.where(quote > 0, plain[quote - 1], quote - 1)
    quotes = quote[(quote - 1 - before) % 2 == 0]
    parity = np.zeros(len(buf), np.int64)
    parity[quotes] = 1
    outside = (np.cumsum(parity) - parity) % 2 == 0  # valid texts close their strings, so parity needs no restart
    marks = (_OPEN | _CLOSE)[buf] | (buf == ord(":")) | (buf == ord(","))
    pos = np.flatnonzero(marks & outside & (parity == 0))
    ch = buf[pos]
    step = _OPEN[ch].astype(np.int64) - _CLOSE[ch]
    after = np.cumsum(step)
    depth = np.where(_OPEN[ch], after - 1, np.where(_CLOSE[ch], after, after))
    inside, index = np.full(len(pos), -1), np.zeros(len(pos), np.int64)
    token = np.arange(len(pos))
    commas = ch == ord(",")
    for d in range(1, int(after.max(initial=0)) + 1):
        openers = token[_OPEN[ch] & (depth == d - 1)]
        here = token[(depth == d)]
        if not len(here):
            continue
        owner = openers[np.searchsorted(openers, here) - 1]
        inside[here] = owner
        run = np.cumsum(commas[here])
        first = np.searchsorted(here, openers, side="right")  # place of each container's first token
        base = np.where(first > 0, run[np.maximum(first - 1, 0)], 0)
        index[here] = run - base[np.searchsorted(openers, owner)]
    return {"buf": buf, "start": start, "pos": pos, "ch": ch, "depth": depth, "inside": inside, "index": index, "quotes": quotes}


_BLANKS = re.compile(rb"[ \t]*")


def _pointer(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def _parses(text: bytes | str, kinds: tuple[type, ...]) -> object | None:
    try:
        v = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, kinds) else None


def linked_paths(texts: list[str | None]) -> tuple[list[tuple[int, list[str], list[str]]], set[tuple[int, str]]]:
    """Objects of each text, and the array paths of each text.

    An object is (text number, segments, alternatives): one segment per object
    from the root to it; its alternative is '' if it is an array element, else
    the array path at which it would count as element 0.
    """
    objects: list[tuple[int, list[str], list[str]]] = []
    arrays: set[tuple[int, str]] = set()
    work: list[tuple[int, bytes, str, str, list[str], list[str]]] = []  # text no., JSON, open path, array path, segs, alts
    for i, text in enumerate(texts):
        if not text or not text.strip():
            continue
        v = _parses(text, (dict, list, str))
        while isinstance(v, str):  # whole records stored as text, however often; each time the text gets shorter
            text, v = v, _parses(v, (dict, list, str))
        if isinstance(v, dict | list):
            work.append((i, text.encode("utf-8", "surrogatepass"), "", "", [], []))
    while work:
        x = structural_index([w[1] for w in work])
        buf, pos, ch, inside, index, quotes = x["buf"].tobytes(), x["pos"], x["ch"], x["inside"].tolist(), x["index"].tolist(), x["quotes"]
        doc_of = (np.searchsorted(x["start"], pos, side="right") - 1).tolist()
        n_quotes = np.searchsorted(quotes, pos).tolist()
        chars, places, quote_at = ch.tolist(), pos.tolist(), quotes.tolist()
        state: dict[int, tuple[str, str, list[str], list[str], bool]] = {}
        later: list[tuple[int, bytes, str, str, list[str], list[str]]] = []

        def key_before(t: int) -> str:
            """Key whose colon is token t."""
            a, b = quote_at[n_quotes[t] - 2], quote_at[n_quotes[t] - 1]
            raw = buf[a + 1 : b]
            return json.loads(buf[a : b + 1]) if b"\\" in raw else raw.decode("utf-8", "surrogatepass")

        def place(t: int, holder: int) -> tuple[str, str, list[str], list[str], bool]:
            """Open path, array path, segments, alternatives of a value after token t in container holder; whether it is an array's element."""
            path, kp, segs, alts, is_array = state[holder]
            if is_array:
                return f"{path}/{index[t]}", kp, segs, alts, True
            step = "/" + _pointer(key_before(t))
            return path + step, kp + step, segs, alts, False

        for t, c in enumerate(chars):
            if c == 123 or c == 91:
                i, _, path0, kp0, segs0, alts0 = work[doc_of[t]]
                if inside[t] < 0:
                    path, kp, segs, alts, element, root = path0, kp0, segs0, alts0, False, True
                else:
                    path, kp, segs, alts, element = place(t if chars[inside[t]] == 91 else t - 1, inside[t])
                    root = False
                if c == 91:
                    kp = kp + "[]" if element else kp
                    arrays.add((i, kp))
                    state[t] = (path, kp, segs, alts, True)
                elif root:
                    state[t] = (path, kp, segs, alts, False)
                else:
                    segs, alts = [*segs, path], [*alts, "" if element else kp]
                    objects.append((i, segs, alts))
                    state[t] = ("", kp, segs, alts, False)
            if c in (58, 91, 44) and n_quotes[t] + 1 < len(quote_at):  # a string may follow
                holder = t if c == 91 else inside[t]
                if c == 44 and (holder < 0 or chars[holder] == 123):
                    continue
                a, b = quote_at[n_quotes[t]], quote_at[n_quotes[t] + 1]
                end = places[t + 1] if t + 1 < len(places) else len(buf)
                if a < end and buf[_BLANKS.match(buf, a + 1).end()] in b"[\\":
                    inner = json.loads(buf[a : b + 1])
                    if inner.lstrip()[:1] == "[" and _parses(inner, (list,)) is not None:
                        if c == 91:
                            path, kp, segs, alts, is_array = state[t]
                            spot = (f"{path}/0", kp + "[]", segs, alts)
                        else:
                            path, kp, segs, alts, element = place(t, holder)
                            spot = (path, kp + "[]" if element else kp, segs, alts)
                        later.append((work[doc_of[t]][0], inner.encode("utf-8", "surrogatepass"), *spot))
        work = later
    return objects, arrays


def _pieces(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `most` characters, so that the index arrays stay small."""
    first = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t or "") > most:
            yield first, i
            first, total = i, 0
        total += len(t or "")
    if first < len(texts):
        yield first, len(texts)


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        records = b["record"].tolist()
        for lo, hi in _pieces(records):
            part = b.iloc[lo:hi]
            tbl, tool, owner = part["tbl"].tolist(), part["tool"].tolist(), part["owner_id"].tolist()
            objects, arrays = linked_paths(records[lo:hi])
            seen = sorted({(tbl[i], tool[i] or "", kp) for i, kp in arrays})
            rows = [("array", t, tl, None, None, [kp]) for t, tl, kp in seen] + [("object", tbl[i], tool[i] or "", owner[i], segs, alts) for i, segs, alts in objects]
            yield pd.DataFrame(rows, columns=["kind", "tbl", "tool", "owner_id", "segs", "alts"])


def records_of(raw_docs: DataFrame, sources: DataFrame) -> DataFrame:
    """(tbl, tool, owner_id, record), the latest loaded record of each owner."""
    docs = (
        raw_docs.where("doc_id is not null and structured is not null")
        .select("doc_id", F.struct("loaded_at", "structured", "tool").alias("r"))
        .groupBy("doc_id")
        .agg(F.max("r").alias("r"))
        .select(F.lit("raw_docs").alias("tbl"), "r.tool", F.col("doc_id").alias("owner_id"), F.col("r.structured").alias("record"))
    )
    src = sources.where("source_id is not null and paths is not null").groupBy("source_id").agg(F.max(F.struct("paths", "tool")).alias("r"))
    return docs.unionByName(src.select(F.lit("sources").alias("tbl"), "r.tool", F.col("source_id").alias("owner_id"), F.col("r.paths").alias("record")))


def flatten_records(records: DataFrame) -> DataFrame:
    """(tbl, tool, owner_id, child_path, parent_path) for every object that is an element of an array."""
    from strandline.runtime import materialize

    flat = materialize(records.mapInPandas(_emit, _SCHEMA), "nested")
    arrays = flat.where("kind = 'array'").select("tbl", "tool", F.col("alts")[0].alias("kp")).distinct()
    objects = flat.where("kind = 'object'").select("tbl", "tool", "owner_id", "segs", "alts")
    shapes = objects.select("tbl", "tool", "alts").distinct()
    asked = shapes.select("tbl", "tool", "alts", F.posexplode("alts").alias("n", "kp"))
    told = asked.join(arrays.withColumn("yes", F.lit(True)), ["tbl", "tool", "kp"], "left")
    flags = told.groupBy("tbl", "tool", "alts").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("yes", F.lit(False)).alias("yes")))), lambda s: s["yes"]).alias("lone"))
    flags = materialize(flags, "lone")
    x = objects.join(flags, ["tbl", "tool", "alts"])
    x = x.select(
        "tbl",
        "tool",
        "owner_id",
        F.zip_with("segs", "lone", lambda s, y: F.when(y, F.concat(s, F.lit("/0"))).otherwise(s)).alias("step"),
        F.zip_with("alts", "lone", lambda a, y: (a == "") | y).alias("element"),
    ).where(F.element_at("element", -1))
    last = F.array_position(F.reverse(F.slice("element", 1, F.size("element") - 1)), True)
    keep = F.when(last > 0, F.size("element") - last).otherwise(0)
    return x.select("tbl", "tool", "owner_id", F.array_join("step", "").alias("child_path"), F.array_join(F.slice(F.col("step"), F.lit(1), keep.cast("int")), "").alias("parent_path"))


def found(raw_docs: DataFrame, sources: DataFrame) -> DataFrame:
    return flatten_records(records_of(raw_docs, sources)).select("owner_id", "child_path", "parent_path")
