import json

from strandline.operators.arbitrate import arbitrate, latest_claims
from strandline.plans import query_pack
from strandline.plans.ontology import SOURCES
from strandline.sources import files, model, products, records
from strandline.streaming import incremental


def test_folder_profile(spark, tmp_path):
    (tmp_path / "slack.jsonl").write_text('{"ts": "1", "text": "hi"}\n\nnot json\n{"ts": "2"}\n')
    (tmp_path / "a.json").write_text(json.dumps({"rows": [{"id": i} for i in range(3)], "questions": [{"q": i} for i in range(5)], "few": [{"x": 1}]}))
    (tmp_path / "m.json").write_text(json.dumps({str(i): {"id": i} for i in range(4)}))
    (tmp_path / "c.csv").write_text("id,name\n1,x\n2,y\n")
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "n.md").write_text("z" * 30000)
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\x00bad")
    got = files.read_folder(spark, str(tmp_path)).collect()
    n = {}
    for r in got:
        n[r["tool"]] = n.get(r["tool"], 0) + 1
    assert n == {"slack": 2, "a-rows": 3, "m": 4, "c": 2, "notes": 1}
    assert len(json.loads(next(r["record"] for r in got if r["tool"] == "notes"))["content"]) == 20000
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), "x").count() == 0
    assert files.read_corpus(spark, str(tmp_path), ["slack", "gmail"]).count() == 3


def test_product_bundles(spark, tmp_path):
    user = lambda i, t, at: {"User": {"userId": i, "text": t, "timestamp": at}}
    one = {
        "slack": [{"id": "s1", "Channel": {"name": "lift"}, "Message": user("eid_aaaaaa", "see /docs/PLAN_1", "2026-01-01T10:00:00Z"), "ThreadReplies": [user("eid_bbbbbb", "fine, eid_cccccc", "")]}, {"id": "s2", "Channel": {"name": "lift"}, "Message": user("eid_dddddd", "so it is", "2026-01-01T11:00:00Z")}, {"Message": {}}],
        "documents": [{"id": "plan_1", "type": "Plan", "content": "x", "author": "eid_aaaaaa", "date": "2026-01-01"}],
        "prs": [{"id": "9", "title": "t", "summary": "s", "user": {"login": "eid_bbbbbb"}, "state": "open", "created_at": "2026-02-01T00:00:00Z", "reviews": [{"user": {"login": "eid_cccccc"}, "state": "APPROVED"}, {"user": None}]}],
        "team": ["eid_aaaaaa", {"x": 1}],
    }
    (tmp_path / "Alpha.json").write_text(json.dumps(one))
    (tmp_path / "Beta.json").write_text(json.dumps({"urls": [{"id": "u", "link": "l", "description": "d"}]}))
    assert {r["product"] for r in products.read_bundles(spark, str(tmp_path), 1).collect()} == {"Alpha"}
    bundles = products.read_bundles(spark, str(tmp_path))
    docs = products.bundle_documents(bundles)
    assert {(r["product"], r["doc_id"]) for r in docs.collect()} == {("Alpha", "s1"), ("Alpha", "s2"), ("Alpha", "plan_1"), ("Alpha", "9"), ("Beta", "u")}
    chart = json.dumps([{"employee_id": "a", "engineering_leads": [{"employee_id": "b", "role": "lead", "engineers": [{"employee_id": "c"}, {"name": "no id", "team": [{"employee_id": "d"}]}]}]}])
    org = products.org_reports(spark.createDataFrame([(chart,), ("{",), (None,)], "record string"))
    assert {tuple(r)[:2] for r in org.collect()} == {("b", "a"), ("c", "b")}
    got = {(r["subject_surface"], r["predicate"], r["object_surface"]) for r in products.bundle_claims(docs, bundles, org).collect()}
    plan = "artifact:bundle_doc:plan-1"
    assert {("artifact:bundle_slack:s1", "REFERENCES", plan), ("artifact:bundle_slack:s2", "REFERENCES", plan)} == {x for x in got if x[1] == "REFERENCES"}
    assert {("artifact:bundle_slack:s1", "MENTIONS", "eid_cccccc"), ("artifact:bundle_slack:s1", "MENTIONS", "eid_bbbbbb")} == {x for x in got if x[1] == "MENTIONS"}
    assert {("artifact:bundle_pr:9", "REVIEWED_BY", "eid_cccccc"), ("eid_aaaaaa", "MEMBER_OF", "Alpha"), ("b", "REPORTS_TO", "a"), ("Beta", "DISCUSSED_IN", "artifact:bundle_url:u"), ("eid_bbbbbb", "AUTHORED", "artifact:bundle_pr:9"), ("artifact:bundle_pr:9", "STATUS_IS", "open")} <= got
    assert len([x for x in got if x[1] == "MEMBER_OF"]) == 1


def test_folder_to_documents_and_model_hook(spark, tmp_path):
    (tmp_path / "slack.jsonl").write_text(json.dumps({"ts": "1", "text": "Sam will own the lift from today, says everybody here.", "user": "@sam"}) + "\n" + json.dumps({"text": "no id"}))
    (tmp_path / "other.csv").write_text("id\n1\n")
    docs, skipped = files.read_documents(spark, str(tmp_path))
    assert [r["doc_id"] for r in docs.collect()] == ["1"] and [tuple(r) for r in skipped.collect()] == [("other", 1)]
    good = {"subject": "Sam", "subject_type": "Person", "predicate": "OWNS", "object": "Lift", "object_type": "Project", "evidence": "Sam will own the lift"}
    answer = "Here you are:\n```json\n" + json.dumps({"claims": [good, {**good, "predicate": "LIKES"}, {**good, "object": " "}, 7]}) + "\n```"
    got = model.statements(docs, lambda texts: [answer for _ in texts]).collect()
    assert [(r["subject_surface"], r["predicate"], r["confidence"], r["tier"]) for r in got] == [("Sam", "OWNS", 0.8, "B")]
    assert model.statements(docs, lambda texts: ["no" for _ in texts]).count() == 0
    assert model.read_json('so {"a": 1} it is') == {"a": 1} and model.read_json(None) is None


def test_envelope_and_rules(spark):
    rec = [json.dumps({"key": "ENG-1", "fields": {"summary": "s", "created": "2026-01-01T00:00:00Z", "updated": "junk", "reporter": {"displayName": "Al"}, "assignee": {"displayName": "Bo"}, "project": {"key": "P", "name": "Atlas"}, "status": {"name": ""}, "duedate": None}}), "{bad", json.dumps({"fields": {}})]
    env = records.envelope(spark.createDataFrame([(r,) for r in rec], "record string"), "jira").collect()
    assert len(env) == 1 and env[0]["acl_groups"] == ["P"] and env[0]["created_at"].startswith("2026-01-01T00:00:00") and env[0]["updated_at"] == ""
    docs = spark.createDataFrame([("ENG-1", "jira", rec[0], "2026-01-01", "")], "doc_id string, tool string, structured string, created_at string, updated_at string")
    got = {(r["subject_surface"], r["predicate"], r["object_surface"]) for r in records.field_map_claims(docs).collect()}
    assert got == {("artifact:jira:eng-1", "ASSIGNED_TO", "Bo"), ("Bo", "WORKS_ON", "Atlas"), ("Atlas", "DISCUSSED_IN", "artifact:jira:eng-1")}


def test_stream_equals_batch(spark, data, tmp_path):
    c = spark.read.parquet(f"{data}/claims.parquet").select(*incremental._COLUMNS)
    c.repartition(3, "claim_key").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.start(stream, str(tmp_path / "out")).awaitTermination()
    got = incremental.current(str(tmp_path / "out"), spark).select("claim_key", "score", "status")
    want = arbitrate(latest_claims(c)).select("claim_key", "score", "status")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_rules_and_envelopes_of_every_tool(spark, tmp_path):
    def nested(path):
        head, _, rest = path.partition(".")
        return {head: nested(rest) if rest else f"v {path}"}

    def merge(a, b):
        return {k: merge(a[k], b[k]) if k in a and k in b and isinstance(a[k], dict) else b.get(k, a.get(k)) for k in {**a, **b}}

    rows, want = [], set()
    for tool, x in SOURCES.items():
        record = {}
        for subj, _, p, obj, _, _ in x["rules"]:
            for path in {subj, obj} - {"__self__"}:
                record = merge(record, nested(path))
            want.add((tool, p))
        rows += [(f"{tool}-1", tool, json.dumps(record), "2026-01-01", ""), (f'{tool}-"2"', tool, " { } ", "2026-01-01", ""), (None, tool, json.dumps(record), None, None)]
    spark.createDataFrame(rows, "doc_id string, tool string, structured string, created_at string, updated_at string").write.parquet(str(tmp_path / "raw_docs.parquet"))
    got = query_pack.QUERIES["field_map_claims"](spark, str(tmp_path)).collect()
    assert {(r["source_tool"], r["predicate"]) for r in got} == want and len(want) == len(got)
    envelopes = query_pack.QUERIES["envelope_all"](spark, str(tmp_path)).collect()
    assert {(r["tool"], r["doc_id"]) for r in envelopes} == {(t, i) for t in SOURCES for i in (f"{t}-1", f'{t}-"2"')} and len(envelopes) == 18
