"""Variant spellings of names typed by people (problem 7).

1. The different spellings are counted. The letters of each are read as a ring:
   its least rotation is the same for exchanged parts, other capitals, accents, marks,
   and lost or moved blanks, so such spellings are one form at once. Forms that
   several orders of a spelling support are read in those; others both ways.
2. A form is (part, root): given name or initial with a family name, or the line of
   business with an organisation's name. All words are points of a metric space.
   They are blocked by what one typing error must leave whole; in each
   block pivots are drawn, every word goes to its nearest pivot and, by the
   triangle inequality, also to each pivot that is at most 2r further away, again
   until cells are small; inside each cell an exact join of radius r = 2 under the
   Levenshtein metric runs, and pairs one typing error apart are kept (an
   exchange of neighbours is one error and two edits).
3. Every form looks for the best supported form of equal or near root whose part is the
   same, near, or what its own part may stand for: an initial, a short form by rule, a short
   form that mail addresses of the corpus show, or an abbreviation. Two forms that are
   both well supported aren't joined over a typing error, so relatives and namesakes one letter
   apart stay apart. A short form by rule that mostly stands without any full form on its
   families is a name of its own. A bare organisation's name is linked if only one line of business bears it.
4. Linked forms give groups of spellings; pairs are listed in each.

No list of given names, families or lines of business is used, only the table of irregular short
forms of `namekit` and the words of legal forms. README says why one set of
pivots doesn't serve the whole space.

Defined results: null, blank and placeholder names ("unknown", bots) and names
with fewer than three letters link to nothing; a spelling as person and as organisation is
two names; repeated rows only add to counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.components import connected
from strandline.llm.namekit import SHORT, edits_swapped, parts, plain, short_of, stems
from strandline.runtime import materialize

#: Entries that name nobody.
PLACEHOLDERS = frozenset("unknown none null nil na n/a tbd nobody anonymous system admin root user test calendar-sync deploy-bot bot ci-bot build-bot github-actions dependabot noreply no-reply automation".split())
#: Legal forms of organisations.
LEGAL = frozenset("incorporated inc corporation corp company co limited ltd gmbh llc llp plc ag sa bv nv kg se oy ab as spa srl the and".split())
_MOVED = re.compile(r"^[^\W\d_]+(?:[a-z]([A-Z]) [a-z]|[a-z] [a-z][A-Z])[a-z]+$")
_LONG_LEGAL = ("incorporated", "corporation", "company", "limited")

Reading = tuple[str, str, int]  # part, root, votes


def ring(letters: str) -> str:
    """Least rotation: equal for all rotations of a string."""
    n, i, j, k = len(letters), 0, 1, 0
    while i < n and j < n and k < n:
        a, b = letters[(i + k) % n], letters[(j + k) % n]
        if a == b:
            k += 1
            continue
        if a > b:
            i += k + 1
        else:
            j += k + 1
        if i == j:
            j += 1
        k = 0
    at = min(i, j)
    return letters[at:] + letters[:at]


@lru_cache(maxsize=50_000)
def _legal(word: str) -> bool:
    return word in LEGAL or len(word) > 4 and any(edits_swapped(word, x, 1) == 1 for x in _LONG_LEGAL)


def _org(surface: str) -> tuple[str, list[Reading]]:
    words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"g\.\s?m\.\s?b\.\s?h\.?", "gmbh", plain(surface))) if w]
    words = [w for w in words if not _legal(w)] or [w for w in words if w not in LEGAL]
    whole = "".join(words)
    long = [w for w in words if len(w) > 1]
    if len(long) == 1 and len(words) > 1:  # initials before or behind the name
        initials = [w for w in words if len(w) == 1]
        mine = next((w for w in initials if w != long[0][0]), initials[0])
        return ring(mine + long[0]), [(mine, long[0], 1)]
    if len(words) == 1:
        return ring(whole), [("", whole, 1), ("*", whole, 1)]
    return ring(whole), [(words[-1], "".join(words[:-1]), 1), (words[0], "".join(words[1:]), 0), ("*", whole, 0)]


def _person(surface: str) -> tuple[str, list[Reading]]:
    s = surface.strip()
    words = parts(s)
    if len(words) > 2:
        words = [words[0], *[w for w in words[1:-1] if len(w) > 1], words[-1]]
    whole = "".join(words)
    if len(words) == 1:
        split = re.split(r"(?<=[a-z])(?=[A-Z])", s.lstrip("@"))
        out = [(whole[0], whole[1:], 1), (whole[-1], whole[:-1], 0)] if len(whole) > 3 else []
        if len(split) == 2 and "@" not in s[1:]:
            out.append((plain(split[0]), plain(split[1]), 1))
        return ring(whole), [x for x in out if len(x[1]) > 1]
    if len(words) == 2 and min(map(len, words)) == 1:
        a, b = words if len(words[0]) == 1 else words[::-1]
        return ring(whole), [(a, b, 2)]
    head, _, tail = s.partition(",")
    raw = s.split()
    sure = bool(head.strip() and tail.strip()) or (len(raw) == 2 and raw[0].isupper() != raw[1].isupper())
    vote = 4 if sure else 1
    out = [(words[0], "".join(words[1:]), vote)]
    if not sure:
        out.append((words[-1], "".join(words[:-1]), 0))
    if len(words) > 2:
        out += [("".join(words[:-1]), words[-1], 0), (words[0], words[-1], 0)]
    elif m := _MOVED.search(s):  # the capital shows that a blank stands one letter off
        at = len(words[0]) + (1 if m[1] is None else -1)
        out.append((whole[:at], whole[at:], 0))
    return ring(whole), out


def readings_of(surface: str | None, kind: str) -> tuple[str, list[Reading]] | None:
    """The ring of a spelling and what it may mean, or None if it names nobody."""
    if not surface or plain(surface).strip() in PLACEHOLDERS or not re.search(r"[^\W\d_]", surface):
        return None
    key, out = _org(surface) if kind == "org" else _person(surface)
    return (key, [x for x in dict.fromkeys(out) if x[1]]) if len(key) > 2 else None


_READ = "kind string, surface string, n bigint, ring string, part string, root string, votes int, one int"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for k, s, n in zip(b["kind"], b["surface"], b["n"], strict=True):
            got = readings_of(s, k)
            if got:
                rows += [(k, s, n, got[0], p, r, v, int(i == 0)) for i, (p, r, v) in enumerate(got[1] or [("", got[0], 0)])]
        yield pd.DataFrame(rows, columns=["kind", "surface", "n", "ring", "part", "root", "votes", "one"])


def name_counts(raw_docs: DataFrame, extracted: DataFrame) -> DataFrame:
    """(kind, surface, n): every different spelling and its mentions."""
    docs = raw_docs.select(F.lit("person").alias("kind"), F.explode(F.concat(F.array("author_raw"), F.coalesce("participants_raw", F.array().cast("array<string>")))).alias("surface"))
    ends = extracted.select(F.explode(F.array(F.struct(F.col("subject_type").alias("t"), F.col("subject_surface").alias("s")), F.struct(F.col("object_type").alias("t"), F.col("object_surface").alias("s")))).alias("x"))
    claims = ends.where(F.col("x.t").isin("Person", "Account")).select(F.when(F.col("x.t") == "Person", "person").otherwise("org").alias("kind"), F.col("x.s").alias("surface"))
    return docs.unionByName(claims).where("surface is not null").groupBy("kind", "surface").agg(F.count(F.lit(1)).alias("n"))


def _addressed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for raw, email in zip(b["author_raw"], b["author_email"], strict=True):
            mine, theirs = readings_of(raw, "person"), readings_of(email, "person")
            if mine and theirs:
                rows += [(p, q, r) for p, r, _ in mine[1] for q, t, _ in theirs[1] if r == t and p != q and min(len(p), len(q)) > 1]
        yield pd.DataFrame(rows, columns=["short", "full", "root"])


def shown_forms(raw_docs: DataFrame, families: int = 2) -> DataFrame:
    """(short, full): given names that authors of `families` families or more use beside the one in their address."""
    pairs = raw_docs.where("author_raw is not null and author_email is not null").select("author_raw", "author_email").distinct()
    seen = pairs.mapInPandas(_addressed, "short string, full string, root string").distinct()
    return seen.where(F.levenshtein("short", "full") > 1).groupBy("short", "full").agg(F.count(F.lit(1)).alias("families")).where(F.col("families") >= families).select("short", "full")


# --- the metric join --------------------------------------------------------------------------------------


def blocks_of(word: Column) -> Column:
    """Keys of which two words one typing error apart always share one.

    Words of eight letters or more: beginnings and ends of just under half; words up to seven: what is left without any one letter.
    """
    n = F.length(word)
    half = [F.floor((n - k) / 2).cast("int") for k in (1, 2)]
    long = F.when(n >= 7, F.array(*[F.concat(F.lit(side), F.substring(word, F.lit(1), m) if side == "<" else F.right(word, m)) for m in half for side in "<>"])).otherwise(F.array().cast("array<string>"))
    drop = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("-"), F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    short = F.when(n <= 7, F.concat(F.array(F.concat(F.lit("-"), word)), drop)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(long, short))


def one_error(a: Column, b: Column) -> Column:
    """One letter more, less or other, or two neighbours exchanged."""
    n, d = F.length(a), F.levenshtein(a, b, 2)
    swapped = F.exists(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n)) == b)
    return (d == 1) | ((d == 2) & (n == F.length(b)) & (n > 1) & swapped)


def radius_pairs(words: DataFrame, radius: int = 2, cell: int = 8, fan: int = 8) -> DataFrame:
    """(kind, a, b), a < b: words one typing error apart, by metric-space partitioning within blocks.

    words: kind, root, without repeats. Cells above `cell` words are cut by up to `fan` pivots,
    and their parts again, as long as that makes them smaller. Exact for any values.
    """
    done, open_ = None, words.where("length(root) > 1").select("kind", "root", F.explode(blocks_of(F.col("root"))).alias("block"))
    depth = 0
    while True:
        sized = open_.groupBy("kind", "block").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        parts_ = materialize(open_.hint("merge").join(sized.hint("merge"), ["kind", "block"]), "cells")
        large = parts_.where(F.col("size") > cell)
        small = parts_.where(F.col("size") <= cell).select("kind", "block", "root")
        done = small if done is None else done.unionByName(small)
        if not large.take(1):
            break
        draw = Window.partitionBy("kind", "block").orderBy(F.xxhash64("root", F.lit(depth)), "root")
        drawn = large.withColumn("rn", F.row_number().over(draw)).where(F.col("rn") <= fan)
        drawn = drawn.where(F.col("rn") <= F.ceil(F.col("size") / cell)).groupBy("kind", "block").agg(F.collect_list("root").alias("pivots"))
        x = large.hint("merge").join(drawn.hint("merge"), ["kind", "block"])
        x = x.withColumn("far", F.transform("pivots", lambda p: F.levenshtein(F.col("root"), p))).withColumn("near", F.array_min("far"))
        at = F.filter(F.transform("far", lambda d, i: F.when(d <= F.col("near") + 2 * radius, i)), lambda i: i.isNotNull())
        x = materialize(x.select("kind", "root", "size", F.explode(at).alias("i"), "block").withColumn("part", F.concat_ws("|", "block", F.lit(depth), "i")), "parts")
        # a cell whose largest part is hardly smaller than itself is as fine as pivots make it
        gain = x.groupBy("kind", "block", "part").agg(F.count(F.lit(1)).alias("m"), F.first("size").alias("size")).groupBy("kind", "block").agg((F.max("m") <= 0.8 * F.first("size")).alias("cut"))
        x = x.hint("merge").join(gain.hint("merge"), ["kind", "block"])
        done = done.unionByName(x.where("not cut").select("kind", "block", "root").distinct())
        open_ = x.where("cut").select("kind", F.col("part").alias("block"), "root")
        depth += 1
    a, b = done.alias("a"), done.alias("b")
    same = (F.col("a.kind") == F.col("b.kind")) & (F.col("a.block") == F.col("b.block"))
    close = (F.col("a.root") < F.col("b.root")) & (F.abs(F.length("a.root") - F.length("b.root")) <= 1) & F.levenshtein(F.col("a.root"), F.col("b.root"), radius).between(0, radius)
    pairs = a.hint("merge").join(b, same & close).where(one_error(F.col("a.root"), F.col("b.root")))
    return pairs.select(F.col("a.kind").alias("kind"), F.col("a.root").alias("a"), F.col("b.root").alias("b")).distinct()


# --- linking ----------------------------------------------------------------------------------------------

#: How a part may stand for another, with its cost: the same, by name, by initial.
_SAME, _BY_NAME, _BY_INITIAL = 0, 1, 2


def _target_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys under which a part can be found: itself, initial, short forms."""
    for b in batches:
        rows = []
        for kind, part in zip(b["kind"], b["part"], strict=True):
            rows += [(kind, part, "=" + part, _SAME), (kind, part, "i" + part[0], _BY_INITIAL)]
            if kind == "org":
                rows.append((kind, part, "a" + part[0], _BY_NAME))
                continue
            cut = {"<" + part[:k] for k in range(2, len(part) + 1)} | {">" + part[-k:] for k in range(4, len(part))}
            rows += [(kind, part, x, _BY_NAME) for x in cut]
        yield pd.DataFrame(rows, columns=["kind", "full", "key", "how"])


def _source_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys by which a part looks for what it may stand for."""
    for b in batches:
        rows = []
        for kind, part in zip(b["kind"], b["part"], strict=True):
            rows.append((kind, part, ("i" if len(part) == 1 and part != "*" else "=") + part))
            if len(part) == 1:
                rows.append((kind, part, "=" + part))
            elif kind == "org":
                rows.append((kind, part, "a" + part[0]))
            else:
                rows += [(kind, part, "<" + t) for t in stems(part)] + [(kind, part, ">" + t) for t in stems(part) if len(t) > 3]
                rows += [(kind, part, "=" + full) for full in SHORT.get(part, ())]
        yield pd.DataFrame(rows, columns=["kind", "part", "key"])


@lru_cache(maxsize=50_000)
def abbreviates(short: str, full: str) -> bool:
    """Letters of a word in their order, first one first: svcs, intl, mfg."""
    if not 1 < len(short) < len(full) - 1 or short[0] != full[0]:
        return False
    rest = iter(full)
    return all(c in rest for c in short)


def _stands_for(kind: str, part: str, full: str) -> int:
    """How a part stands for another, or -1."""
    if part == full:
        return _SAME
    if len(part) == 1:
        return _BY_INITIAL if part != "*" and full[0] == part else -1
    if kind == "org":
        return _BY_NAME if abbreviates(part, full) else -1
    return _BY_NAME if short_of(part, full) else -1


_HIT = ["kind", "ring", "part", "root", "full", "near", "target", "typos", "slips", "cost"]


def _part_relations(parts_: DataFrame, near: DataFrame, shown: DataFrame) -> DataFrame:
    """(kind, part, seen, key, slips): keys by which each part is looked up as `seen`: itself or a word one typing error away."""
    seen = parts_.withColumn("seen", F.col("part")).withColumn("slips", F.lit(0))
    slips = near.where("length(a) > 2 and length(b) > 2").select("kind", F.col("a").alias("part"), F.col("b").alias("seen"), F.lit(1).alias("slips"))
    seen = seen.unionByName(parts_.where("length(part) > 1").hint("merge").join(slips, ["kind", "part"]))
    words = seen.select("kind", F.col("seen").alias("part")).distinct()
    keys = words.mapInPandas(_source_keys, "kind string, part string, key string").withColumn("shown", F.lit(False))
    by_address = words.where("kind = 'person'").join(shown.select(F.col("short").alias("part"), "full"), "part").select("kind", "part", F.concat(F.lit("="), "full").alias("key"), F.lit(True).alias("shown"))
    keys = keys.unionByName(by_address).groupBy("kind", F.col("part").alias("seen"), "key").agg(F.max("shown").alias("shown"))
    return seen.hint("merge").join(keys.hint("merge"), ["kind", "seen"])


def _costs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys are only candidates: here it is decided whether and how a part stands for another."""
    for b in batches:
        cost = [_BY_NAME if shown and key == "=" + full else _stands_for(kind, seen, full) for kind, seen, full, key, shown in zip(b["kind"], b["seen"], b["full"], b["key"], b["shown"], strict=True)]
        out = b.assign(cost=cost)
        yield out[out["cost"] >= 0][_HIT]


def form_links(read: DataFrame, shown: DataFrame, strong: int = 3) -> DataFrame:
    """(kind, ring, target): the form each form is linked to.

    read: readings of spellings. Forms of `strong` or more spellings each are never joined over a typing error.
    """
    stats = read.groupBy("kind", "ring").agg(F.sum("one").alias("support"), F.sum(F.col("one") * F.col("n")).alias("mentions"))
    forms = read.groupBy("kind", "ring", "part", "root").agg(F.sum("votes").alias("votes"))
    forms = materialize(forms.hint("merge").join(stats.hint("merge"), ["kind", "ring"]), "forms")
    near = radius_pairs(_words(forms))
    near = materialize(near.unionByName(near.select("kind", F.col("b").alias("a"), F.col("a").alias("b"))), "near")
    top = forms.groupBy("kind", "ring").agg(F.max("votes").alias("top"))
    # the orders in which a form is read as a whole name: those that at least a quarter of the best one's votes support
    ids = materialize(forms.hint("merge").join(top.hint("merge"), ["kind", "ring"]).where("part <> '' and ((votes > 0 and votes * 4 >= top) or part = '*')").drop("top"), "ids")
    parts_ = materialize(forms.where("part <> ''").select("kind", "part").distinct(), "parts")
    keys = ids.select("kind", "part").distinct().mapInPandas(_target_keys, "kind string, full string, key string, how int").select("kind", "full", "key").distinct()
    targets = ids.select("kind", F.col("ring").alias("target"), F.col("part").alias("full"), F.col("root").alias("near")).hint("merge").join(keys, ["kind", "full"])
    src = forms.where("part <> ''").select("kind", "ring", "part", "root")
    looks = _part_relations(parts_, near, shown)
    src = src.hint("merge").join(looks.hint("merge"), ["kind", "part"])
    over = near.select("kind", F.col("a").alias("root"), F.col("b").alias("near"))
    over = src.where("slips = 0 and length(root) > 4").hint("merge").join(over, ["kind", "root"]).withColumn("typos", F.lit(1))
    met = src.withColumn("near", F.col("root")).withColumn("typos", F.lit(0)).unionByName(over).hint("merge").join(targets.hint("merge"), ["kind", "near", "key"]).where("ring <> target")
    met = met.groupBy("kind", "ring", "part", "root", "full", "near", "target", "seen", "key", "typos", "slips").agg(F.max("shown").alias("shown"))
    hits = met.mapInPandas(_costs, "kind string, ring string, part string, root string, full string, near string, target string, typos int, slips int, cost int").distinct()
    mine = forms.select("kind", "ring", "support", "mentions").distinct()
    them = mine.select("kind", F.col("ring").alias("target"), F.col("support").alias("s2"), F.col("mentions").alias("m2"))
    hits = materialize(hits.hint("merge").join(mine.hint("merge"), ["kind", "ring"]).hint("merge").join(them.hint("merge"), ["kind", "target"]), "hits")
    # a short form by rule that mostly stands without a full form on its families, and a near name that
    # mostly stands without a better supported one, is a name of its own
    uses = ids.where("length(part) > 1").groupBy("kind", "part").agg(F.count_distinct("root").alias("roots"))
    by = lambda what, root: F.count_distinct(F.when(F.expr(what), F.col(root)))
    beside = hits.where("typos = 0").groupBy("kind", "part").agg(by(f"cost = {_BY_NAME} and slips = 0", "root").alias("by_name"), by(f"cost = {_SAME} and slips = 1 and s2 > support", "root").alias("by_slip"))
    alone = uses.hint("merge").join(beside.hint("merge"), ["kind", "part"], "left")
    alone = materialize(alone.select("kind", "part", (F.coalesce("by_name", F.lit(0)) * 2 < F.col("roots")).alias("own_name"), ((F.coalesce("by_slip", F.lit(0)) * 2 < F.col("roots")) & (F.col("roots") >= strong)).alias("common")), "alone")
    h = hits.hint("merge").join(alone.hint("merge"), ["kind", "part"], "left").hint("merge").join(alone.select("kind", F.col("part").alias("full"), F.col("common").alias("common2")), ["kind", "full"], "left")
    weak = (F.col("support") < strong) | (F.col("s2") < strong)
    up = F.struct("s2", "m2", F.col("target").alias("r")) > F.struct("support", "mentions", F.col("ring").alias("r"))
    errors = F.col("typos") + F.col("slips")
    allowed = (
        F.when(F.col("cost") == _BY_INITIAL, errors <= 1)
        .when((F.col("cost") == _BY_NAME) & (errors == 0), ~F.coalesce("own_name", F.lit(False)))
        .when(F.col("cost") == _BY_NAME, (F.col("support") < strong) & up)
        .otherwise((errors == 1) & weak & up & ((F.col("slips") == 0) | (F.least(F.length("part"), F.length("full")) > 3) & ~(F.coalesce("common", F.lit(False)) & F.coalesce("common2", F.lit(False)))))
    )
    h = h.where(allowed)
    rank = F.struct((errors * 2 + F.col("cost")).alias("cost"), (-F.col("s2")).alias("s"), (-F.col("m2")).alias("m"), F.col("target").alias("target"))
    best = materialize(h.groupBy("kind", "ring").agg(F.min(rank).alias("t")).select("kind", "ring", F.col("t.target").alias("target")), "best")
    return best.unionByName(_bare_links(forms, ids, near, best))


def _words(forms: DataFrame) -> DataFrame:
    """Roots, parts and irregular short forms as points of the metric space."""
    own = forms.select("kind", F.explode(F.array("part", "root")).alias("root")).where("length(root) > 2")
    known = forms.sparkSession.createDataFrame([("person", x) for x in sorted(SHORT)], "kind string, root string")
    return own.unionByName(known).distinct()


def _bare_links(forms: DataFrame, ids: DataFrame, near: DataFrame, best: DataFrame) -> DataFrame:
    """Organisations named without their line of business, if just one form of that root links no further."""
    heads = ids.where("kind = 'org' and length(part) > 1").select("kind", "ring", F.col("root").alias("near")).distinct().hint("merge").join(best.select("kind", "ring"), ["kind", "ring"], "left_anti")
    one = heads.groupBy("kind", "near").agg(F.count(F.lit(1)).alias("n"), F.min("ring").alias("target")).where("n = 1").select("kind", "near", "target")
    bare = forms.where("kind = 'org' and part = ''").select("kind", "ring", "root").hint("merge").join(best.select("kind", "ring"), ["kind", "ring"], "left_anti")
    reach = bare.select("kind", "ring", F.col("root").alias("near"), F.lit(0).alias("typos")).unionByName(bare.where("length(root) > 4").hint("merge").join(near.select("kind", F.col("a").alias("root"), F.col("b").alias("near")), ["kind", "root"]).select("kind", "ring", "near", F.lit(1).alias("typos")))
    hit = reach.hint("merge").join(one, ["kind", "near"]).groupBy("kind", "ring").agg(F.min(F.struct("typos", "target")).alias("t"))
    return hit.select("kind", "ring", F.col("t.target").alias("target"))


def spelling_groups(counts: DataFrame, shown: DataFrame, strong: int = 3) -> DataFrame:
    """(kind, surface, entity): the group of each spelling that names somebody.

    counts: kind, surface, n. shown: short, full (may be empty).
    """
    read = materialize(counts.mapInPandas(_read, _READ), "readings")
    links = form_links(read, shown, strong)
    name = lambda c: F.concat_ws("\x01", "kind", c)
    labels = connected(links.select(name("ring").alias("a"), name("target").alias("b")))
    own = read.where("one = 1").select("kind", "surface", name("ring").alias("vertex"))
    return own.hint("merge").join(labels.hint("merge"), "vertex", "left").select("kind", "surface", F.coalesce("root", "vertex").alias("entity"))


def found(raw_docs: DataFrame, extracted: DataFrame) -> DataFrame:
    """(surface_a, surface_b): different spellings of one entity, surface_a < surface_b."""
    shown = materialize(shown_forms(raw_docs), "shown")
    g = materialize(spelling_groups(name_counts(raw_docs, extracted), shown), "groups")
    a, b = g.select("entity", F.col("surface").alias("surface_a")), g.select("entity", F.col("surface").alias("surface_b"))
    return a.hint("merge").join(b, "entity").where("surface_a < surface_b").select("surface_a", "surface_b").distinct()
