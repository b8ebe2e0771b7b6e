import datetime as dt
import glob
import itertools
import os
import random
import re
import string

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import components, leakage, mailtext, names, packing, sharedspans, survivors, turns
from strandline.llm.namekit import edits_swapped
from strandline.llm.queries import oracle_sql, queries

rnd = random.Random(11)
DAY = dt.datetime(2025, 6, 1, tzinfo=dt.UTC)


def rows(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


# --- 1 survivors ---------------------------------------------------------------------------------
CLAIMS = "claim_key string, subject_key string, predicate string, object_key string, status string, authority double, asserted_at string, corroboration bigint, loaded_at timestamp, value string, ok int, r int"


def claim(spark, data):
    return spark.createDataFrame([(*x, "v", 1, 1) for x in data], CLAIMS)


def test_survivors_by_field(spark):
    data = [
        ("b", "s", "p", "o", " Current ", 0.5, "2025-01-01", 3, DAY),
        ("a", "s", "p", "o", "tbd", 0.5, "2025-05-01T00:00:00+02:00", 3, DAY),
        ("c", "s", "p", "o", "CONTESTED", 75.0, "2025-07-01", 999, DAY),  # after loading, out of range
        ("d", "s", "p", "o", "superseded", float("nan"), "junk", None, DAY),
        ("e", "s", "p", "lone", "current", 1.0, "2025-01-01", 1, DAY),
        (None, "s", "p", "lone", "current", 1.0, "2025-01-01", 1, DAY),
        ("f", None, "p", "o", None, None, None, None, None),
        ("g", None, "p", "o", None, None, None, None, None),
    ]
    got = rows(survivors.found(claim(spark, data + data)))
    assert got == {("s", "p", "o", "b", "a", "a", "a"), (None, "p", "o", None, None, None, None)}
    assert survivors.found(claim(spark, [])).count() == 0
    assert {r["claim_key"] for r in survivors.best_record(claim(spark, data)).collect()} >= {"b", "e"}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, data, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    df = queries()[name](spark, data)
    cur = con.execute(oracle_sql()[name])
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(str([r[cols.index(c)] for c in df.columns]) for r in cur.fetchall())
    assert want == sorted(str(list(r)) for r in df.collect())


# --- 3 components -------------------------------------------------------------------------------
def union_find(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    low = {}
    for x in list(root):
        low[find(x)] = min(low.get(find(x), x), x)
    return {(x, low[find(x)]) for x in root}


def test_components_of_chains_stars_and_noise(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(150)]
    star = [("hub", f"s{i}") for i in range(200)]
    loose = [(f"r{rnd.randrange(80)}", f"r{rnd.randrange(80)}") for _ in range(60)]
    pairs = chain + star + loose
    merges = [(i, *((a, b) if i % 2 else (b, a)), 0.75, None, None) for i, (a, b) in enumerate(pairs)]
    merges += [(900, "x", "y", 0.74, None, None), (901, "x", "z", 0.9, "veto", None), (902, None, "x", 0.9, None, None), (903, "q", "q", 1.0, None, None), (904, "x", "z", None, None, None), (905, "x", "z", float("nan"), None, None)]
    m = spark.createDataFrame(merges + merges, "merge_id bigint, left_surface string, right_surface string, score double, veto string, u string")
    c = spark.createDataFrame([(1, ["k1", None, "k2", "k2"]), (2, ["k2", "hub"]), (3, None), (4, []), (5, ["alone"])], "cluster_id bigint, surfaces array<string>")
    want = union_find([p for p in pairs if p[0] != p[1]] + [("k1", "k2"), ("k2", "hub")])
    assert rows(components.found(m, c)) == want
    assert components.found(m.where("false"), c.where("false")).count() == 0


# --- 2 mail ---------------------------------------------------------------------------------------
MAIL_ROWS = "doc_id string, kind string, body string, author_email string, author_raw string, loaded_at timestamp"
MAIL = """Hi Anna,

The budget line was moved to week 12.
On Friday I wrote: nothing moves before the audit.
-- or do we skip it? --

Best,
Otto Brandt
Account Lead | Quillmere

Sent from my phone

On Tue, Nov 4, 2025 at 10:35 AM Anna Lee <anna.lee@x.example> wrote:
> Please look at the list.

I did that on Monday already.

> Thanks,
> Anna
P.S. Latency went > 900 ms."""


def test_places_of_lines():
    got = {n: p for n, p, _ in mailtext.places(MAIL, "otto.brandt@x.example")}
    assert [n for n in sorted(got) if got[n] == "fresh"] == [1, 3, 4, 5, 16, 20]
    assert got[7] == "closing" and got[8] == got[9] == "signature" and got[11] == "notice" and got[13] == "intro"


def test_mail_inheritance_is_found_without_marks(spark):
    a = "The first shared sentence describes the rollout plan for week twelve in detail.\nThe second shared sentence lists the owners of the seven remaining open tasks."
    own = "My own words come before the copied part of this mail.\n"
    m = [
        ("m1", "email", a, "a@x.example", "A", DAY),
        ("m2", "email", own + a.replace("seven", "Seven,"), "b@x.example", "B", DAY + dt.timedelta(days=1)),
        ("m3", "email", None, None, None, DAY),
        ("m4", "email", " \n", None, None, None),
        ("m5", "message", a, None, None, DAY),
        ("m1", "email", a, "a@x.example", "A", DAY + dt.timedelta(days=9)),
    ]
    df = spark.createDataFrame(m, "doc_id string, kind string, body string, author_email string, author_raw string, loaded_at timestamp")
    assert rows(mailtext.found(df)) == {("m1", 1), ("m1", 2), ("m2", 1)}
    assert mailtext.found(df.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300))
def test_any_body_is_placed_once(body):
    got = mailtext.places(body)
    assert [n for n, _, _ in got] == [i for i, x in enumerate(body.split("\n"), 1) if x.strip()]


def test_hamming_tables_miss_nothing():
    for _ in range(400):
        x = y = rnd.getrandbits(64)
        for k in rnd.sample(range(64), rnd.randint(0, 3)):
            y ^= 1 << k
        a, b = mailtext.hamming_keys(np.array([x, y], np.uint64))
        assert set(a.tolist()) & set(b.tolist())


def test_long_sentences_are_hashed_whole(monkeypatch):
    text = "".join(rnd.choice("abcdef ") for _ in range(5000))
    want = mailtext.window_keys([text, "a second sentence of six words", text[::-1]], [0, 1], [1, 2])
    monkeypatch.setattr(mailtext, "_CHUNK", 700)
    assert mailtext.window_keys([text, "a second sentence of six words", text[::-1]], [0, 1], [1, 2]) == want


def scrambled(s, edits):
    for i in rnd.sample(range(len(s)), edits):
        s = s[:i] + rnd.choice(("", "x", s[i : i + 1] + "y")) + s[i + 1 :]
    return " ".join(s.split())


def two_line_mails(spark, windows):
    """lines_of() and held windows of mails of two sentences each, in order."""
    m = [(f"m{i:05d}", "email", f"{x}\n{y}", f"s{i}@x.example", None, DAY + dt.timedelta(minutes=i)) for i, (x, y) in enumerate(windows)]
    lines = mailtext.lines_of(spark.createDataFrame(m, MAIL_ROWS))
    w = lines.select("doc_id", "at", "sender", F.col("line_no").alias("l1"), F.explode("windows").alias("w"))
    return lines, w.select("w.c", "at", "sender", "doc_id", "l1", "w.l2")


def near_mails(spark, windows):
    lines, held = two_line_mails(spark, windows)
    at = {r["c"]: int(r["doc_id"][1:]) for r in held.collect()}
    return {(at[c], at[src]) for c, src in mailtext.near_windows(lines, held).collect()}


def test_edited_windows_are_near(spark):
    words = ["".join(rnd.choices(string.ascii_lowercase, k=rnd.randint(2, 9))) for _ in range(400)]
    base = [(" ".join(rnd.choices(words, k=rnd.randint(10, 20))), " ".join(rnd.choices(words, k=rnd.randint(10, 20)))) for _ in range(300)]
    for edits, at_least in ((1, 1.0), (2, 0.99), (4, 0.9)):  # in each of the two sentences
        got = near_mails(spark, base + [(scrambled(x, edits), scrambled(y, edits)) for x, y in base])
        assert all(c == src + 300 for c, src in got)
        assert len(got) >= at_least * len(base)


def test_hot_templates_find_their_earliest(spark):
    """Every filled-in template near-matches the earliest one; pairs grow with the rows, not their square."""
    t = ("the nightly report {} is ready and can be read in the usual place by all", "please tell the owner {} if anything in the list looks odd to you")
    names_ = ["".join(x) for x in itertools.product("abcdefgh", repeat=3)]
    got = near_mails(spark, [(t[0].format(x), t[1].format(x)) for x in names_])
    assert {c for c, _ in got} == set(range(1, len(names_))) and len(got) < len(names_) * 40
    assert not near_mails(spark, [(t[0].format(i), t[1].format(i)) for i in range(50)])


def test_really_edited_copies_are_inherited(spark):
    a = "The first shared sentence describes the rollout plan for week twelve in detail.\nThe second shared sentence lists the owners of the seven remaining open tasks."
    m = [("m1", "email", a, "a@x.example", "A", DAY), ("m2", "email", "My own words.\n" + a.replace("seven", "eleven").replace("rollout", "rolout"), "b@x.example", "B", DAY + dt.timedelta(days=1))]
    assert rows(mailtext.found(spark.createDataFrame(m, MAIL_ROWS))) == {("m1", 1), ("m1", 2), ("m2", 1)}


S1 = "The first shared sentence describes the rollout plan for week twelve in detail."
S2 = "The second shared sentence lists the owners of the seven remaining open tasks."


def test_the_time_of_the_mail_decides_not_its_load(spark):
    m = [("m1", "email", f"{S1}\n{S2}", "a@x.example", "A", DAY + dt.timedelta(days=9), "2026-01-02T10:00:00Z"), ("m2", "email", f"Mine.\n{S1}\n{S2}", "b@x.example", "B", DAY, "2026-01-03T10:00:00Z")]
    df = spark.createDataFrame(m, MAIL_ROWS + ", created_at string")
    assert rows(mailtext.found(df)) == {("m1", 1), ("m1", 2), ("m2", 1)}


@pytest.mark.parametrize("more", [1, 3, 30])
def test_copies_by_any_number_of_senders_are_inherited(spark, more):
    got = rows(mailtext.found(mails(spark, ("a", f"{S1}\n{S2}"), *[(f"b{i}", f"Word from {i}.\n{S1}\n{S2}") for i in range(more)])))
    assert got == {("m0", 1), ("m0", 2)} | {(f"m{i + 1}", 1) for i in range(more)}


def test_quoted_lines_are_sources(spark):
    got = rows(mailtext.found(mails(spark, ("a", f"See below.\n> {S1}\n> {S2}"), ("c", f"I pass on:\n{S1}\n{S2}"))))
    assert got == {("m0", 1), ("m1", 1)}


def test_own_earlier_text_is_no_inheritance(spark):
    got = rows(mailtext.found(mails(spark, ("a", f"{S1}\n{S2}"), ("b", f"{S1}\n{S2}"), ("a", f"Again.\n{S1}\n{S2}"))))
    assert got == {("m0", 1), ("m0", 2), ("m2", 1), ("m2", 2), ("m2", 3)}


def test_inherited_marks_what_only_fingerprints_find(spark):
    got = rows(mailtext.inherited(mails(spark, ("a", f"{S1}\n{S2}"), ("b", f"{S1}\n{S2}"), ("c", f"{S1.replace('weke', 'week').replace('plan', 'plans')}\n{S2}"))))
    assert got == {("m1", 1, False), ("m1", 2, False), ("m2", 1, True), ("m2", 2, True)}


def test_closings_of_any_language():
    for closing in ("Atenciosamente,", "Met vriendelijke groet,", "Z poważaniem,", "Vennlig hilsen,"):
        got = [p for _, p, _ in mailtext.places(f"Novo texto aqui.\n\n{closing}\nOtto Brandt", "otto.brandt@x.example", "Otto Brandt")]
        assert got == ["fresh", "closing", "signature"]


def mails(spark, *mails):
    return spark.createDataFrame([(f"m{i}", "email", body, f"{who}@x.example", who, DAY + dt.timedelta(days=i)) for i, (who, body) in enumerate(mails)], MAIL_ROWS)


def test_every_earlier_mail_of_a_sentence_counts(spark):
    got = rows(mailtext.found(mails(spark, ("a", S1), ("a", S1 + "\n" + S2), ("b", S1 + "\n" + S2))))
    assert got == {("m0", 1), ("m1", 1), ("m1", 2)}


def test_copies_by_many_senders_are_inherited(spark):
    stock = ["On Friday I wrote that nothing moves before the audit.", "Latency went above nine hundred in the old portal."]
    own = [f"Sender {w} has this to say about the {w} {w} matter." for w in ("alpha", "bravo", "delta", "gamma", "kappa", "omega")]
    alone = [(w, line + "\n" + own[i]) for i, w in enumerate("uvwxyz") for line in stock]
    both = [("p", stock[0] + "\n" + stock[1]), ("q", stock[0] + "\n" + stock[1])]
    got = rows(mailtext.found(mails(spark, *[(w, S1 + "\n" + S2) for w in "abcdefg"], *alone, *both)))
    assert got == {("m0", 1), ("m0", 2)} | {(f"m{i}", n) for i in range(7, 21) for n in (1, 2)}


def test_runs_pass_over_short_lines(spark):
    got = rows(mailtext.found(mails(spark, ("a", f"{S1}\nAs agreed.\n{S2}"), ("b", f"{S1}\nAs agreed.\n{S2}"), ("c", f"{S1}\nI object!\n{S2}"))))
    assert got == {("m0", 1), ("m0", 2), ("m0", 3), ("m2", 2)}


def test_whole_footers_are_boilerplate(spark):
    footer = "we sell good tools\nask me for the new list"
    bodies = [f"Number {w} of the {w} reports tells about {w} things." for w in ("alpha", "bravo", "delta", "gamma")]
    got = rows(mailtext.found(mails(spark, *[("a", f"{b}\n{footer}") for b in bodies])))
    assert got == {(f"m{i}", 1) for i in range(4)}
    assert rows(mailtext.found(mails(spark, *[("a", f"{S1}\n{S2}") for _ in range(3)]))) >= {(f"m{i}", 1) for i in range(3)}


# --- 4 transcripts -----------------------------------------------------------------------------------
def test_turns():
    body = "[00:00:05] ANNA LEE: Hello (laughs) um, all.\n[00:00:20] OB: Note: the plan (the new one, I mean) is\nready. [Music]\n[00:00:12] anna: uh.\n[00:00:15] Anna L.: More words."
    assert turns.clean_turns(body, ["Lee, Anna", "Otto Brandt"], None) == [("Lee, Anna", 4), ("Otto Brandt", 10)]
    inline = "(recording begins) Otto B.: Yes. Lee, Anna: One question: who holds it? otto: hm. A. Lee: Me."
    assert turns.clean_turns(inline, ["Lee, Anna", "Otto Brandt"], None) == [("Otto Brandt", 1), ("Lee, Anna", 6)]
    assert turns.clean_turns(None, ["A"], None) == turns.clean_turns("A: x", None, None) == turns.clean_turns("A: x", [None, ""], None) == []


def test_boundaries_on_held_out_transcripts(spark, data):
    got = spark.read.parquet(data.replace("0.001", "0.01") + "/raw_docs.parquet").where("kind = 'transcript'").dropDuplicates(["doc_id"]).select("doc_id", "body", "participants_raw").orderBy("doc_id").collect()
    marked = [(r["body"], r["participants_raw"]) for r in got if re.search(r"(?m)^\[\d\d:\d\d", r["body"])]
    model = turns.train(marked[::2])
    right = total = 0
    for body, people in marked[1::2]:
        cast = turns.Cast(list(people))
        segs = turns.segments(body, cast)
        yes = model.chance(turns.features(segs, cast)) >= 0.5
        right += sum(bool(y) == (s.marked and bool(s.label)) for s, y in zip(segs, yes, strict=True))
        total += len(segs)
    assert total > 20 and right / total > 0.97


def test_turn_query_edges(spark):
    d = [("t", "transcript", "A Bee: " + "hi " * 3000, ["A Bee"], None), ("u", "transcript", None, None, None), ("v", "email", "A: x", ["A"], None)]
    df = spark.createDataFrame(d, "doc_id string, kind string, body string, participants_raw array<string>, loaded_at timestamp")
    assert rows(turns.found(df)) == {("t", 1, "A Bee", 3000)}
    assert turns.found(df.where("false")).count() == 0


# --- 7 names ------------------------------------------------------------------------------------------
def linked(spark, people, orgs=(), emails=None):
    docs = spark.createDataFrame([(p, emails.get(p) if emails else None, [p]) for p in people] + [(None, None, None)], "author_raw string, author_email string, participants_raw array<string>")
    xc = spark.createDataFrame([(o, "Account", "Atlas", "Project") for o in orgs], "subject_surface string, subject_type string, object_surface string, object_type string")
    return rows(names.found(docs, xc))


def pairs_of(*groups):
    return {(a, b) for g in groups for a in g for b in g if a < b}


def test_name_variants_and_relatives(spark):
    people = ["Giuseppe Notonluvirri", "Notonluvirri, Giuseppe", "Beppo Notonluvirri", "NOTONLUVIRRI Giuseppe", "Dr. Giuseppe Notonluvirri", "Giuseppe Notnoluvirri", "@giuseppe.notonluvirri", "notonluvirri_giuseppe"]
    others = ["Leopold Notonluvirri", "Leo Notonluvirri", "Notonluvirri, Leopold", "L. Notonluvirri"]
    misc = ["unknown", "deploy-bot", "", None, "x" * 20000]
    orgs = ["Fesunimume Services Incorporated", "Fesunimume Svcs, Inc.", "fesunimumeservices", "The Fesunimume Services", "Services Fesunimume"]
    assert linked(spark, people + others + misc, orgs) == pairs_of(people, others, orgs)
    assert linked(spark, []) == set()


def test_names_that_stand_in_no_source_file(spark):
    """Reorderings, initials, short forms, slips, handles, moved blanks; relatives and namesakes stay apart."""
    people = [
        ["Maria Gonzalez", "Gonzalez, Maria", "M. Gonzalez", "Maria Gonzales", "@mgonzalez", "GONZALEZ Maria", "Gonzalez Maria"],
        ["Michael Johnson", "Mike Johnson", "Johnson, Michael", "Micheal Johnson"],
        ["David Miller", "Dave Miller", "miller_david", "DavidMiller"],
        ["Mohammed Haddadi", "Mohamed Haddadi", "Haddadi Mohammed", "Mohammed Hadaddi", "Mohamme dHaddadi"],
        ["Siobhan O'Rourke-Quin", "Siobhan ORourke Quin", "ORourke-Quin, Siobhan", "Siobhán O’Rourke-Quin", "Siobhan K. O'Rourke-Quin"],
        ["Oluwaseun Adeyemi-Cole", "O. Adeyemi-Cole", "Oluwaseun Adeyemi-Coel"],
        ["Declan Johnson", "D. Johnson"],
        ["Paula Miller"],
    ]
    orgs = [
        ["Acme Logistics", "ACME LOGISTICS LTD", "Acme Logist.", "acmelogistics", "Logistics Acme"],
        ["Acme Instruments", "Acme Instr. Inc"],
        ["Acme Holdings GmbH", "Acme Hldgs", "Acme-Holdings"],
        ["Zorvane Shipbuilding", "Zorvane", "The Zorvane Shipbuilding Company", "Zorvanne Shipbuilding", "zorvaneshipbulding", "Z.S. Zorvane"],
        ["Acme"],  # of three firms
    ]
    got = linked(spark, [x for g in people for x in g], [x for g in orgs for x in g])
    want = pairs_of(*people, *orgs)
    assert not got - want
    assert len(got & want) >= 0.95 * len(want), want - got


def test_near_given_names_of_one_family_stay_apart(spark):
    common = [f"{g} {r}" for g in ("Maria", "Mario", "Paul", "Paula") for r in ("Bradevic", "Stolzenau", "Quintarelli")]
    apart = ["Paul Okonjo", "Paula Okonjo", "Maria Lopez", "Mario Lopez"]
    whole = [f"Paul {r}" for r in ("Aldertree", "Benwick", "Corstorphine", "Dunmore")]
    assert not {x for x in linked(spark, common + apart + whole) if x[0] in apart}


def test_short_forms_shown_by_addresses(spark):
    """A form no rule or table knows is learned where two families use it beside one given name."""
    fam = ["Harkonnen", "Osterreich"]
    people = [x for f in fam for x in (f"Bartholomew {f}", f"Tolly {f}")] + ["Bartholomew Vasquezi", "Tolly Vasquezi"]
    mails = {f"Tolly {f}": f"bartholomew.{f.lower()}@x.example" for f in fam}
    assert linked(spark, people) == set()
    assert linked(spark, people, emails=mails) == pairs_of(*[[f"Bartholomew {f}", f"Tolly {f}"] for f in [*fam, "Vasquezi"]])


def test_radius_join_is_exact(spark):
    roots = {"".join(rnd.choice("abcd") for _ in range(rnd.randint(4, 9))) for _ in range(400)}
    df = spark.createDataFrame([("k", r) for r in roots], "kind string, root string")
    want = {(a, b) for a in roots for b in roots if a < b and edits_swapped(a, b, 1) <= 1}
    for cell in (1000, 8):  # one pivot a block, and many
        assert {tuple(r)[1:] for r in names.radius_pairs(df, cell=cell).collect()} == want


# --- 8 packing -----------------------------------------------------------------------------------------
@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=60), st.integers(60, 100))
def test_bound_and_fit(sizes, capacity):
    s = np.array(sizes)
    bins = packing.best_fit_decreasing(s, capacity)
    fill = np.bincount(bins, weights=s)
    assert fill.max() <= capacity and max(-(-s.sum() // capacity), 1) <= packing.lower_bound(s, capacity) <= len(fill)


def test_packing_is_whole(spark):
    docs = [(i, rnd.randint(0, 900)) for i in range(3000)] + [(9999, 5000)]
    sizes = spark.createDataFrame(docs, "doc_id bigint, tokens bigint")
    caps = spark.createDataFrame([("s", 512), ("m", 2048), ("bad", 0), (None, 5)], "container string, capacity_tokens int")
    got = packing.pack(sizes, caps, per_partition=400).collect()
    for name, cap in (("s", 512), ("m", 2048)):
        fill, per = {}, {}
        for r in got:
            if r["container"] == name:
                fill[r["bin"]] = fill.get(r["bin"], 0) + r["tokens"]
                per.setdefault(r["doc_id"], []).append(r["tokens"])
        assert max(fill.values()) <= cap
        assert {i: sum(per[i]) for i, _ in docs} == dict(docs) and all(len(per[i]) == max(1, -(-t // cap)) for i, t in docs)
        singles = [t % cap for _, t in docs if t % cap or not t]
        bound = packing.lower_bound(np.array(singles), cap) + sum(t // cap for _, t in docs)
        assert len(fill) <= bound * 1.02 + 2
    assert packing.pack(sizes.where("false"), caps).count() == 0


def test_token_sizes(spark):
    d = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (None, "x"), (1, "Hello world"), (4, "<|endoftext|> é漢" * 2000)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["tokens"] for r in packing.token_sizes(d).collect()}
    assert got[1] == 2 and got[2] == 0 and set(got) == {1, 2, 4}


# --- 9 leakage -----------------------------------------------------------------------------------------
def plain_leaks(docs, items, m=10):
    out = set()
    for i, t in items:
        w = leakage.words(t)
        grams = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)}
        for d, x in docs:
            v = leakage.words(x or "")
            if any(tuple(v[k : k + m]) in grams for k in range(len(v) - m + 1)):
                out.add((d, i))
    return out


def test_leaks(spark):
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(5, 40)))) for i in range(40)]
    docs = []
    for d in range(150):
        t = items[rnd.randrange(40)][1].split()
        k = rnd.randrange(len(t))
        docs.append((d, " ".join(rnd.choice(vocab) for _ in range(5)) + " " + " ".join(t[k : k + rnd.randint(8, 14)]) + " tail"))
    docs += [(500, None), (501, ""), (502, docs[0][1])]
    df = spark.createDataFrame([(d, x, 1) for d, x in docs + docs[:3]], "doc_id bigint, text string, item_id int")
    it = spark.createDataFrame([*items, (None, "x"), (77, None)], "item_id bigint, text string")
    for block in (20000, 7):
        assert rows(leakage.found(df, it, block=block)) == plain_leaks(docs, items)
    assert leakage.found(df.where("false"), it).count() == leakage.found(df, it.where("false")).count() == 0


def test_word_forms():
    text = "> The **amber** wit-\n> ness\u200b am\u200bber \u201cone\u201d\xa0_two_ <b>three</b> &amp; WEISS wei\u00df"
    assert leakage.words(text) == ["the", "amber", "witness", "amber", "one", "two", "three", "weiss", "weiss"]


# --- 10 shared spans -----------------------------------------------------------------------------------
def plain_shared(docs, n):
    owner = {}
    for d, t in docs:
        for k in range(len(t) - n + 1):
            owner.setdefault(t[k : k + n], set()).add(d)
    out = {}
    for d, t in docs:
        hit = set()
        for k in range(len(t) - n + 1):
            if len(owner[t[k : k + n]]) > 1:
                hit |= set(range(k, k + n))
        if hit:
            out[d] = len(hit)
    return set(out.items())


def test_shared_spans(spark):
    assert {(a - b) % sharedspans.MODULUS for a in sharedspans.COVER for b in sharedspans.COVER} == set(range(sharedspans.MODULUS))
    noise = lambda k: "".join(rnd.choice(string.ascii_letters + "é漢😀 ") for _ in range(k))
    shared = [noise(k) for k in (150, 199, 200, 201, 260, 500)]
    docs = [(d, "".join(noise(rnd.randint(0, 90)) + rnd.choice(shared) for _ in range(rnd.randint(1, 4)))) for d in range(60)]
    docs += [(100, docs[0][1]), (101, docs[0][1]), (102, shared[1]), (103, shared[1]), (104, noise(250) * 2), (105, "a" * 3000), (106, "a" * 230), (107, "")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs + docs[:2]] + [(None, "a" * 300, "x", 1), (108, None, "x", 1)], "doc_id bigint, text string, cid string, h int")
    assert rows(sharedspans.found(df)) == rows(sharedspans.found(df, broadcast_rows=0)) == plain_shared(docs, 200)
    assert sharedspans.found(df.where("false")).count() == 0
