"""Answering batches of questions over the claim graph: plan, gates, evidence, rendering.

Every question is one row; the whole batch runs as one plan. Entity names are
found in questions by equi-joins: on beginnings of names of a few fixed lengths for
literal mentions, on shared words and character trigrams for the rest. Nothing is compared with everything.
Normalised texts are written once, as they are read many times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import norm, token_set_ratio
from strandline.functions.time import detect_as_of, parse_ts
from strandline.operators.arbitrate import arbitrate
from strandline.operators.graph import label_of
from strandline.plans.ontology import Schema
from strandline.runtime import materialize

# Phrases of questions and the predicates they ask for, in order.
HINTS = [
    ("reports to", ("REPORTS_TO",)), ("report to", ("REPORTS_TO",)), ("manager", ("REPORTS_TO",)), ("assigned", ("ASSIGNED_TO",)), ("assignee", ("ASSIGNED_TO",)), ("owns", ("OWNED_BY", "OWNS",)),
    ("owner", ("OWNED_BY", "OWNS",)), ("responsible", ("OWNED_BY", "ASSIGNED_TO",)), ("in charge", ("OWNED_BY", "ASSIGNED_TO",)), ("carrying", ("OWNED_BY", "ASSIGNED_TO",)),
    ("budget", ("BUDGET_IS",)), ("cost", ("BUDGET_IS",)), ("status", ("STATUS_IS",)), ("state of", ("STATUS_IS",)), ("due", ("DUE_ON", "SCHEDULED_FOR",)), ("deadline", ("DUE_ON", "SCHEDULED_FOR",)),
    ("launch", ("SCHEDULED_FOR", "DUE_ON",)), ("ship", ("SCHEDULED_FOR", "DUE_ON",)), ("when", ("SCHEDULED_FOR", "DUE_ON",)), ("blocking", ("BLOCKS",)), ("blocked", ("BLOCKS",)),
    ("blocks", ("BLOCKS",)), ("depends", ("DEPENDS_ON",)), ("priority", ("PRIORITY_IS",)), ("risk", ("RISK_OF",)), ("customer", ("CUSTOMER_OF",)), ("works on", ("WORKS_ON",)),
    ("working on", ("WORKS_ON",)), ("work on", ("WORKS_ON",)), ("member", ("MEMBER_OF",)), ("wrote", ("AUTHORED",)), ("written", ("AUTHORED",)), ("author", ("AUTHORED",)),
    ("reviewed", ("REVIEWED_BY",)), ("reviewer", ("REVIEWED_BY",)), ("approved", ("REVIEWED_BY",)), ("mentioned", ("MENTIONS",)), ("discussed", ("DISCUSSED_IN", "MENTIONS",)),
    ("involved", ("MENTIONS", "MEMBER_OF",)), ("team member", ("MEMBER_OF",)), ("worked on", ("WORKS_ON", "MEMBER_OF",)), ("escalat", ("ESCALATED_TO",)), ("decided", ("DECIDED",)),
    ("resolved", ("RESOLVED_BY",)),
]
# Words of predicate names without meaning of their own; words of
# questions that name nothing; cues that ask for a set; readable predicate names.
GLUE = {
    "has", "was", "the", "and", "for", "its", "are", "out", "off", "per", "via", "not", "with", "from", "into", "that", "this", "been", "have", "upon", "about",
}
STOP = {
    "who", "what", "when", "where", "which", "whom", "whose", "the", "is", "are", "was", "were", "of", "on", "for", "to", "in", "at", "a", "an", "does", "do", "did", "and", "or", "s", "it", "that",
    "how", "much", "many", "currently", "now", "by", "with", "from", "this", "these", "those", "there", "be", "been", "has", "have", "had", "owns", "own", "assigned", "status", "due", "author",
    "authors", "reviewer", "reviewers", "reviewed", "reports", "report", "member", "members", "team", "find", "list", "show", "give", "tell", "provide", "identify", "please", "all", "any",
    "employee", "employees", "id", "ids", "identifier", "identifiers", "name", "names", "person", "people", "product", "products", "key", "main", "primary", "related", "associated", "involved",
    "during", "about", "regarding", "their", "pull", "request", "pr", "ticket", "issue", "document", "doc", "file", "page", "thread", "channel", "message", "meeting", "deal", "record", "number",
    "item",
}
SET_CUES = ("ids", "employee id", "employees", "who are", "list", "find ", "all ", "members", "reviewers", "authors", "everyone", "people", "which people", "team members", "participants")
PHRASES = {"BUDGET_IS": "budget", "STATUS_IS": "status", "DUE_ON": "due date", "SCHEDULED_FOR": "scheduled date", "PRIORITY_IS": "priority", "REPORTS_TO": "reporting line", "ASSIGNED_TO": "assignee", "OWNED_BY": "owner", "RESOLVED_BY": "resolver", "REVIEWED_BY": "reviewer", "RISK_OF": "risks", "BLOCKS": "blockers", "DEPENDS_ON": "dependencies", "MEMBER_OF": "membership", "CUSTOMER_OF": "customer relationship", "WORKS_ON": "work", "AUTHORED": "authorship", "DISCUSSED_IN": "discussion"}


def phrase(predicate: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv])
    return F.coalesce(m[predicate], F.lower(F.replace(predicate, F.lit("_"), F.lit(" "))))


def predicates_of(q: Column, schema: Schema) -> Column:
    """Predicates a normalised question asks for: hint phrases in order, then words of the vocabulary."""
    none = F.array().cast("array<string>")
    found = [F.when(q.contains(p), F.array(*[F.lit(x) for x in names if x in schema.predicates])).otherwise(none) for p, names in HINTS]
    for name in schema.predicates:
        words = [w for w in name.lower().split("_") if len(w) >= 3 and w not in GLUE]
        pattern = "|".join([name.lower().replace("_", " "), *[rf"\b{w}" for w in words]])
        found.append(F.when(q.rlike(pattern), F.array(F.lit(name))).otherwise(none))
    return F.array_distinct(F.concat(*found))


def plan(questions: DataFrame, schema: Schema | None = None) -> DataFrame:
    """Adds as_of_ts, q (normalised, without the date), words, predicates, set_mode to questions (question_id, question)."""
    schema = schema or Schema()
    when, rest = detect_as_of(F.col("question"))
    given = F.col("as_of") if "as_of" in questions.columns else F.lit(None).cast("string")
    x = materialize(questions.withColumn("as_of_ts", F.coalesce(parse_ts(given), when)).withColumn("q", F.coalesce(norm(rest), F.lit(""))), "asked")
    x = x.withColumn("words", F.filter(F.split("q", " "), lambda t: ~t.isin(*STOP) & (F.length(t) > 1))).withColumn("predicates", predicates_of(F.col("q"), schema))
    low = F.lower("question")
    cue = F.lit(False)
    for c in SET_CUES:
        cue = cue | low.contains(c)
    return x.withColumn("set_mode", cue)


#: Lengths of the beginnings of names that are looked up at every place of a question.
LADDER = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128)


def _mentions(planned: DataFrame, names: DataFrame) -> DataFrame:
    """Questions joined with the names (c, ...) that stand in them literally."""
    length = F.lit(LADDER[0])
    for n in LADDER[1:]:
        length = F.when(F.length("c") >= n, n).otherwise(length)
    keyed = names.withColumn("begin", F.substring(F.col("c"), F.lit(1), length))
    at = planned.select("question_id", "q", F.explode(F.sequence(F.lit(1), F.greatest(F.length("q"), F.lit(1)))).alias("i"))
    rungs = F.filter(F.array(*[F.lit(n) for n in LADDER]), lambda n: n <= F.length("q") - F.col("i") + 1)
    begins = at.select("question_id", F.explode(F.transform(rungs, lambda n: F.substring(F.col("q"), F.col("i"), n))).alias("begin")).distinct()
    return begins.join(keyed, "begin").join(planned.select("question_id", "q"), "question_id").where(F.col("q").contains(F.col("c"))).drop("begin")


def _trigrams(c: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))


def match_entities(planned: DataFrame, entities: DataFrame, aliases: DataFrame | None = None, artifact_project: DataFrame | None = None, top: int = 4) -> DataFrame:
    """(question_id, key, name, label, score, matched_text, rank): the best entities of each planned question.

    entities: key, name, label; aliases: alias, key; artifact_project: key, project.
    """
    e = entities.where("key is not null").withColumn("c", F.explode(F.array_distinct(F.array(norm(F.col("name")), norm(F.regexp_replace("key", r"^[^:]*:", "")), norm(F.substring_index("key", ":", -1)))))).where("c <> ''")
    e = materialize(e.select("key", "name", "label", "c"), "names")
    literal = _mentions(planned, e).select("question_id", "key", "name", "label", (F.lit(0.9) + F.least(F.lit(0.09), F.length("c") / F.lit(200.0))).alias("score"), F.col("c").alias("text"))
    if aliases is not None:
        a = materialize(aliases.select(norm(F.col("alias")).alias("c"), "key").where("c <> ''").distinct().join(entities.select("key", "name", "label"), "key"), "aliases")
        literal = literal.unionByName(_mentions(planned, a).select("question_id", "key", "name", "label", F.lit(1.0).alias("score"), F.col("c").alias("text")))
    ew = e.withColumn("cw", F.filter(F.split("c", " "), lambda t: (t != "") & ~t.isin(*STOP))).where(F.size("cw") > 0)
    pw = planned.select("question_id", "q", "words", F.array_join("words", " ").alias("said"))
    shared = pw.withColumn("w", F.explode("words")).join(ew.withColumn("w", F.explode("cw")), "w").drop("w")
    # without a shared word only the whole texts can be alike, so they have nine tenths of their length and a trigram in common
    near = pw.withColumn("w", F.explode(_trigrams(F.col("said")))).join(ew.withColumn("w", F.explode(_trigrams(F.col("c")))), "w").drop("w").where(F.least(F.length("said"), F.length("c")) >= 0.8 * F.greatest(F.length("said"), F.length("c")))
    meet = shared.unionByName(near).dropDuplicates(["question_id", "key", "c"]).where(~F.col("q").contains(F.col("c")))
    meet = materialize(meet.withColumn("all", F.size(F.array_except("cw", "words")) == 0), "meet")
    worded = meet.withColumn("r", token_set_ratio("c", F.col("said")) / 100)
    worded = worded.withColumn("score", F.when(F.col("all"), 0.8).when(F.col("r") > 0.9, F.col("r") * 0.75)).where("score is not null").select("question_id", "key", "name", "label", "score", F.col("c").alias("text"))
    best = literal.unionByName(worded).groupBy("question_id", "key", "name", "label").agg(F.max(F.struct("score", F.length("text").alias("l"), "text")).alias("m"))
    best = best.select("question_id", "key", "name", "label", "m.score", F.col("m.text").alias("matched_text"))
    if artifact_project is not None:
        named = best.where("label = 'Project'").select("question_id", F.col("key").alias("project")).distinct()
        own = artifact_project.groupBy("key").agg(F.max("project").alias("project"))
        best = best.join(own, "key", "left").join(named.select("question_id", F.lit(True).alias("asks")).distinct(), "question_id", "left").join(named.withColumn("fits", F.lit(True)), ["question_id", "project"], "left")
        best = best.where((F.col("label") != "Artifact") | F.col("asks").isNull() | F.col("project").isNull() | F.col("fits").isNotNull()).drop("asks", "project", "fits")
    w = Window.partitionBy("question_id").orderBy(F.col("score").desc(), F.length("matched_text").desc(), "key")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def _understood(questions: DataFrame, entities: DataFrame, aliases: DataFrame | None, artifact_project: DataFrame | None, schema: Schema) -> DataFrame:
    """Planned questions with anchor `a`, `keys` of matched entities and `unmatched` words."""
    p = materialize(plan(questions, schema), "planned")
    m = materialize(match_entities(p, entities, aliases, artifact_project), "matches")
    hint_words = sorted({w for h, _ in HINTS for w in h.split()})
    told = m.select("question_id", F.explode(F.split(F.concat_ws(" ", norm(F.col("name")), norm(F.col("key")), norm(F.col("matched_text"))), " ")).alias("w")).groupBy("question_id").agg(F.collect_set("w").alias("seen"))
    seen = m.groupBy("question_id").agg(F.min(F.struct("rank", "key", "name")).alias("a"), F.collect_set("key").alias("keys"))
    x = materialize(p.join(seen.join(told, "question_id"), "question_id", "left"), "understood")
    phrases = " ".join(h for h, _ in HINTS)
    spoken = F.flatten(F.transform("predicates", lambda q: F.split(F.lower(F.replace(q, F.lit("_"), F.lit(" "))), " ")))
    x = x.withColumn("spoken", F.array_union(F.coalesce("seen", F.array().cast("array<string>")), spoken))
    # every word counts as often as it is said
    return x.withColumn("unmatched", F.filter("words", lambda t: ~F.array_contains("spoken", t) & ~F.lit(f" {phrases} ").contains(t) & ~t.isin(*hint_words)))


def _evidence(x: DataFrame, claims: DataFrame, references: DataFrame | None, schema: Schema) -> DataFrame:
    """(question_id, claim_key, hops, from_key, via, predicate, subject_key, object_key, source_tool, asserted_at, score, status) of the claims asked for.

    Questions ask for their predicates, and those that want a set of people for mentions too.
    Questions with a date re-arbitrate their own evidence as of it.
    """
    of_people = F.array(*[F.lit(p) for p, v in schema.predicates.items() if "Person" in v[1]])
    wanted = F.when(F.col("set_mode") & F.arrays_overlap("predicates", of_people), F.array_union("predicates", F.array(F.lit("MENTIONS")))).otherwise(F.col("predicates"))
    open_ = x.where(F.col("a").isNotNull() & (F.size("predicates") > 0) & (F.size("unmatched") < 2)).select("question_id", "as_of_ts", "set_mode", wanted.alias("targets"), F.explode("keys").alias("e"))
    asks = open_.select("question_id", "as_of_ts", "e", F.explode("targets").alias("predicate"), F.lit(0).alias("hops"), F.lit("").alias("via"))
    if references is not None:
        cited = open_.where(F.col("set_mode") & F.col("e").startswith("artifact:")).withColumnRenamed("e", "dst").join(references.select("src", "dst"), "dst")
        asks = asks.unionByName(cited.select("question_id", "as_of_ts", F.col("src").alias("e"), F.explode("targets").alias("predicate"), F.lit(1).alias("hops"), F.lit("REFERENCES").alias("via")))
    ends = claims.withColumn("e", F.explode(F.array_distinct(F.array("subject_key", "object_key"))))
    touch = asks.distinct().join(ends, ["e", "predicate"])
    rest = [c for c in touch.columns if c not in ("question_id", "claim_key", "hops", "e", "via")]
    touch = touch.groupBy("question_id", "claim_key").agg(F.min(F.struct("hops", F.col("e").alias("from_key"), "via")).alias("h"), *[F.first(c).alias(c) for c in rest])
    hits = materialize(touch.select("question_id", "claim_key", "h.hops", "h.from_key", "h.via", *rest), "evidence")
    cols = ["question_id", "claim_key", "hops", "from_key", "via", "predicate", "subject_key", "object_key", "source_tool", "asserted_at", "score", "status"]
    now = hits.where("as_of_ts is null").select(cols)
    past = hits.where("as_of_ts is not null").where(parse_ts(F.col("asserted_at")).isNull() | (parse_ts(F.col("asserted_at")) <= F.col("as_of_ts")))
    # each question is its own competing set: its id becomes part of the subject while arbitrating
    again = arbitrate(past.withColumn("subject_key", F.concat_ws("\x01", F.col("question_id").cast("string"), "subject_key")).drop("score", "status", "corroboration"), schema)
    return now.unionByName(again.withColumn("subject_key", F.regexp_replace("subject_key", "^[^\x01]*\x01", "")).select(cols))


def _labelled(ev: DataFrame, entities: DataFrame) -> DataFrame:
    """Evidence with shown names subj and obj."""
    names = entities.groupBy("key").agg(F.min("name").alias("name"))
    for key, name in (("object_key", "oname"), ("subject_key", "sname")):
        ev = ev.join(names.select(F.col("key").alias(key), F.col("name").alias(name)), key, "left")
    return ev.withColumn("obj", label_of(F.col("object_key"), F.col("oname"))).withColumn("subj", label_of(F.col("subject_key"), F.col("sname"))).drop("oname", "sname")


def ask_evidence(questions: DataFrame, claims: DataFrame, entities: DataFrame, aliases: DataFrame | None = None, artifact_project: DataFrame | None = None, references: DataFrame | None = None, schema: Schema | None = None) -> DataFrame:
    """(question_id, rank, status, claim_key, hops, score, path): the evidence of each question, best first within a status.

    path: "subject > PREDICATE > object", behind the step that led from the anchor to a citing document where there is one.
    """
    schema = schema or Schema()
    x = _understood(questions, entities, aliases, artifact_project, schema)
    ev = _labelled(_evidence(x, claims, references, schema), entities)
    ev = ev.join(x.select("question_id", F.col("a.name").alias("anchor")), "question_id")
    hop = F.concat_ws(" > ", "subj", "predicate", "obj")
    path = F.when(F.col("via") != "", F.concat(F.concat_ws(" > ", "anchor", "via", label_of(F.col("from_key"), F.lit(None).cast("string"))), F.lit(" | "), hop)).otherwise(hop)
    rank = F.row_number().over(Window.partitionBy("question_id", "status").orderBy("hops", F.col("score").desc(), "claim_key"))
    return ev.select("question_id", rank.alias("rank"), "status", "claim_key", "hops", "score", path.alias("path"))


def ask(questions: DataFrame, claims: DataFrame, entities: DataFrame, aliases: DataFrame | None = None, artifact_project: DataFrame | None = None, references: DataFrame | None = None, schema: Schema | None = None) -> DataFrame:
    """(question_id, status, gate, anchor, text, n_current, n_superseded, n_contested): one row per question.

    claims: arbitrated claims with claim_key, subject_key, predicate,
    object_key, source_tool, asserted_at, authority, specificity, hedging, score, status.
    """
    schema = schema or Schema()
    x = _understood(questions, entities, aliases, artifact_project, schema)
    ev = materialize(_labelled(_evidence(x, claims, references, schema), entities), "labelled")
    order = F.struct("hops", (-F.col("score")).alias("s"), "claim_key", "subj", "predicate", "obj", "score", "source_tool", "asserted_at")
    per = ev.groupBy("question_id").agg(F.min(F.when(F.col("status") == "current", order)).alias("top"), *[F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s}") for s in ("current", "superseded", "contested")])
    # the first four different objects; a question's other evidence is only counted
    objects = ev.where("status = 'current'").groupBy("question_id", "obj").agg(F.min(F.struct("hops", (-F.col("score")).alias("s"), "claim_key")).alias("o"))
    objects = objects.withColumn("rn", F.row_number().over(Window.partitionBy("question_id").orderBy("o"))).where("rn <= 4")
    shown = objects.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "obj"))), lambda r: r["obj"]).alias("objects"))
    # what is recorded directly, for questions that find nothing
    kinds = claims.select(F.explode(F.array_distinct(F.array("subject_key", "object_key"))).alias("e"), "predicate").distinct()
    direct = x.select("question_id", F.explode("keys").alias("e")).join(kinds, "e").groupBy("question_id").agg(F.array_sort(F.collect_set("predicate")).alias("recorded"))
    x = materialize(x.join(per, "question_id", "left").join(shown, "question_id", "left").join(direct, "question_id", "left"), "judged")
    gate = (
        F.when(F.col("a").isNull(), "entity").when((F.size("predicates") == 0) | (F.size("unmatched") >= 2), "coverage").when(F.col("top").isNull(), "coverage").when(F.col("top.score") < schema.sufficiency, "sufficiency").otherwise("")
    )
    others = F.filter("objects", lambda o: o != F.col("top.obj"))
    line = F.concat(F.col("top.subj"), F.lit(" : "), F.lower(F.replace(F.col("top.predicate"), F.lit("_"), F.lit(" "))), F.lit(" : "), F.col("top.obj"), F.when(F.size(others) > 0, F.concat(F.lit("  (also: "), F.array_join(F.slice(others, 1, 3), ", "), F.lit(")"))).when(F.col("n_current") > 1, F.concat(F.lit("  ["), F.col("n_current").cast("string"), F.lit(" sources agree]"))).otherwise(""))
    unknown = F.array_join(F.slice("unmatched", 1, 4), " ")
    extra = F.when(F.size(F.coalesce("recorded", F.array().cast("array<string>"))) > 0, F.concat(F.lit(" Recorded for "), F.col("a.name"), F.lit(": "), F.array_join(F.transform(F.slice("recorded", 1, 6), phrase), ", "), F.lit("."))).otherwise("")
    # The sentences of abstentions.
    text = (
        F.when(F.col("a").isNull(), F.concat(F.lit("Not in the data: no record of "), F.when(unknown != "", F.concat(F.lit('"'), unknown, F.lit('"'))).otherwise("the subject of that question"), F.lit(" in the corpus.")))
        .when(F.size("predicates") == 0, F.concat(F.lit("Not in the data: "), F.col("a.name"), F.lit(" is in the corpus, but the question does not map to any recorded relationship.")))
        .when(F.size("unmatched") >= 2, F.concat(F.lit("Not in the data: found "), F.col("a.name"), F.lit(", but nothing recorded about "), F.array_join(F.slice(F.array_distinct("unmatched"), 1, 4), ", "), F.lit(".")))
        .when(F.col("top").isNull(), F.concat(F.lit("Not in the data: found "), F.col("a.name"), F.lit(", but no "), phrase(F.col("predicates")[0]), F.lit(" is recorded."), extra))
        .when(gate == "sufficiency", F.concat(F.lit("Not in the data with sufficient confidence: the only statement is an unconfirmed mention in "), F.col("top.source_tool"), F.lit(" ("), F.substring("top.asserted_at", 1, 10), F.lit(", score "), F.format_string("%.2f", F.col("top.score")), F.lit(f" < {schema.sufficiency}).")))
        .otherwise(line)
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return x.select("question_id", F.when(gate == "", "answered").otherwise("abstained").alias("status"), gate.alias("gate"), F.col("a.key").alias("anchor"), text.alias("text"), zero("n_current"), zero("n_superseded"), zero("n_contested"))


def cited_only(text: Column, known: Column) -> Column:
    """Whether a text cites something, and nothing but known claim keys in square brackets."""
    cited = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(claim:[0-9a-f]+)\]"), F.lit(1)))
    return (F.size(cited) > 0) & (F.size(F.array_except(cited, known)) == 0)


# Words in predicate names, and the question about a thing and about a person.
SHAPES = (
    (("assign",), "who is {s} assigned to?", "what is assigned to {s}?"),
    (("report",), "who reports to {s}?", "who does {s} report to?"),
    (("own",), "who owns {s}?", "what does {s} own?"),
    (("author", "wrote"), "who authored {s}?", "what has {s} authored?"),
    (("review", "approv"), "who reviewed {s}?", "what has {s} reviewed?"),
    (("status", "state"), "what is the status of {s}?", "what is the status of {s}?"),
    (("due", "schedul", "launch"), "when is {s} due?", "when is {s} due?"),
    (("block",), "what blocks {s}?", "what does {s} block?"),
    (("budget", "cost"), "what is the budget for {s}?", "what is the budget for {s}?"),
    (("member", "team"), "who is on {s}?", "what is {s} a member of?"),
    (("customer", "account", "company"), "which customer is {s} linked to?", "which customers does {s} cover?"),
    (("mention", "discuss", "reference", "involve"), "what does {s} mention?", "where is {s} mentioned?"),
    (("work",), "who works on {s}?", "what does {s} work on?"),
    (("priorit",), "what is the priority of {s}?", "what is the priority of {s}?"),
    (("escalat",), "who is {s} escalated to?", "what is escalated to {s}?"),
)
# Words of names that would be read as part of the question.
ASKING = ("launch", "due", "status", "owner", "assigned", "report", "budget", "block", "review", "author", "member", "work", "priority", "escalate")


def phrase_question(predicate: Column, subject: Column, person: Column) -> Column:
    """The question that a predicate answers about a subject."""
    low = F.lower(F.replace(predicate, F.lit("_"), F.lit(" ")))
    put = lambda shape: F.replace(F.lit(shape), F.lit("{s}"), subject)
    out = F.concat(F.lit("what is the "), low, F.lit(" of "), subject, F.lit("?"))
    for needles, thing, who in reversed(SHAPES):
        hit = F.lit(False)
        for n in needles:
            hit = hit | low.contains(n)
        out = F.when(hit, F.when(person, put(who)).otherwise(put(thing))).otherwise(out)
    return out


def suggestions(claims: DataFrame, entities: DataFrame, limit: int = 6, schema: Schema | None = None) -> DataFrame:
    """(question, tag): up to `limit` questions worth asking, each verified by asking it.

    One on which sources disagree, one without an answer (a predicate no statement uses, about a known subject), the
    rest lookups, one a predicate. The smallest claim keys are taken.
    """
    schema = schema or Schema()
    names = entities.groupBy("key").agg(F.min("name").alias("name"))
    c = claims.join(names.withColumnRenamed("key", "subject_key"), "subject_key", "left").withColumn("name", label_of(F.col("subject_key"), F.col("name"))).where("subject_key is not null and length(name) between 1 and 48")
    c = materialize(c.select("claim_key", "subject_key", "predicate", "status", "name"), "named")
    row = F.struct("claim_key", "subject_key", "predicate", "name")
    disagree = c.where("status = 'superseded'").agg(F.min(row).alias("r")).where("r is not null").select("r.*", F.lit("sources disagree").alias("tag"))
    look_up = c.where("status = 'current' and predicate not in ('MENTIONS', 'DISCUSSED_IN')").join(disagree.select("predicate"), "predicate", "left_anti").groupBy("predicate").agg(F.min(row).alias("r")).select("r.*", F.lit("look up").alias("tag"))
    used = {r[0] for r in claims.where("predicate is not null").select("predicate").distinct().where(F.col("predicate").isin(*schema.predicates)).collect()}  # at most the vocabulary
    unused = [p for p in schema.predicates if p not in used][:4] or ["BUDGET_IS"]
    dirty = F.arrays_overlap(F.split(F.lower("name"), " "), F.array(*map(F.lit, ASKING)))
    anchor = c.where("status = 'current'").agg(F.min(F.struct(dirty.alias("d"), F.col("subject_key").startswith("artifact:").alias("a"), F.length("name").alias("n"), "subject_key", "name")).alias("r")).where("r is not null")
    no_answer = anchor.select(F.explode(F.array(*[F.lit(p) for p in unused])).alias("predicate"), "r.subject_key", "r.name").select(F.lit("").alias("claim_key"), "subject_key", "predicate", "name", F.lit("no answer exists").alias("tag"))
    qs = disagree.unionByName(look_up).unionByName(no_answer).withColumn("question", phrase_question(F.col("predicate"), F.col("name"), F.col("subject_key").startswith("person:")))
    qs = materialize(qs.withColumn("question_id", F.concat_ws("|", "tag", "predicate")), "suggested")
    done = ask(qs.select("question_id", "question"), claims, entities, schema=schema).select("question_id", "status", "n_superseded")
    x = qs.join(done, "question_id").where((F.col("tag") == "no answer exists") == (F.col("status") == "abstained"))
    x = x.withColumn("tag", F.when((F.col("tag") == "sources disagree") & (F.col("n_superseded") == 0), "look up").otherwise(F.col("tag")))
    x = x.withColumn("rn", F.row_number().over(Window.partitionBy("tag").orderBy("claim_key", "predicate")))
    order = F.when(F.col("tag") == "sources disagree", 0).when(F.col("tag") == "no answer exists", 1).otherwise(2)
    return x.where("tag = 'look up' or rn = 1").orderBy(order, "rn").limit(limit).select("question", "tag")
