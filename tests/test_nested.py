import json
import random

from strandline.operators import nested

DOCS = "doc_id string, tool string, structured string, loaded_at timestamp, alts string, n bigint"
SRC = "source_id string, tool string, paths string, segs int"


def expected(records):
    """Plain recursive reading of the problem's statement; records: (table, tool, owner, text)."""
    parsed = []
    for tbl, tool, owner, text in records:
        try:
            v = json.loads(text)
            while isinstance(v, str):
                v = json.loads(v)
            parsed.append((tbl, tool, owner, v))
        except (ValueError, TypeError):
            pass

    def opened(v):
        if isinstance(v, str) and v.strip().startswith("["):
            try:
                y = json.loads(v)
                return y if isinstance(y, list) else v
            except ValueError:
                pass
        return v

    arrays, out = set(), set()

    def scan(v, kp, key):
        v = opened(v)
        if isinstance(v, dict):
            for k, x in v.items():
                scan(x, (*kp, k), key)
        elif isinstance(v, list):
            arrays.add((key, kp))
            for x in v:
                scan(x, (*kp, "*") if isinstance(opened(x), list) else kp, key)

    def walk(v, kp, path, parent, key, owner, element):
        v = opened(v)
        if isinstance(v, dict):
            if not element and kp and (key, kp) in arrays:
                path, element = path + "/0", True
            if element:
                out.add((owner, path, parent))
                parent = path
            for k, x in v.items():
                walk(x, (*kp, k), path + "/" + k.replace("~", "~0").replace("/", "~1"), parent, key, owner, False)
        elif isinstance(v, list):
            for n, x in enumerate(v):
                walk(x, (*kp, "*") if isinstance(opened(x), list) else kp, f"{path}/{n}", parent, key, owner, True)

    for tbl, tool, owner, v in parsed:
        scan(v, (), (tbl, tool))
    for tbl, tool, owner, v in parsed:
        walk(v, (), "", "", (tbl, tool), owner, False)
    return out


def run(spark, docs, sources=()):
    d = spark.createDataFrame([(i, t, s, None, "x", 1) for i, t, s in docs], DOCS)
    s = spark.createDataFrame([(i, t, p, 1) for i, t, p in sources], SRC)
    rows = [tuple(r) for r in nested.found(d, s).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_lone_objects_text_arrays_nulls_and_escapes(spark):
    docs = [
        ("a", "t", '{"x": [{"y": {"z": 1}}, null, {"y": [{"z": 2}]}], "k/~": [{}]}'),
        ("b", "t", '{"x": {"y": []}, "s": "a \\"quoted\\" [1] {", "back\\\\": ["\\\\"]}'),
        ("c", "t", json.dumps(json.dumps({"x": json.dumps([{"y": [{"deep": "é[{"}]}])}))),
        ("d", "u", '{"x": {"y": 1}}'),
        ("e", "t", '{"x": ['),
        ("f", "t", None),
        ("g", "t", ""),
        ("h", "t", '{"x": [[{"in": [[{}]]}], "[not json", "[1, 2]", "[{}]"]}'),
        (None, "t", '{"x": [{}]}'),
    ]
    assert run(spark, docs + docs[:1]) == expected([("r", t, i, s) for i, t, s in docs if i])


def test_random_records_against_plain_reading(spark):
    rnd = random.Random(3)

    def make(depth):
        k = rnd.random()
        if depth > 4 or k < 0.25:
            return rnd.choice([None, 1, "x", 'q"[{\\', "", True, -1.5e3])
        if k < 0.6:
            return {rnd.choice("abcd") + rnd.choice(["", "/", "~", '"']): make(depth + 1) for _ in range(rnd.randint(0, 3))}
        v = [make(depth + 1) for _ in range(rnd.randint(0, 3))]
        return json.dumps(v) if rnd.random() < 0.15 else v

    docs = [(f"d{i}", rnd.choice("tu"), json.dumps({"r": make(0), "s": make(1)}, indent=rnd.choice([None, 1]), ensure_ascii=bool(i % 2))) for i in range(300)]
    src = [(f"s{i}", "t", json.dumps({"a.b": make(1)})) for i in range(20)]
    want = expected([("r", t, i, s) for i, t, s in docs] + [("s", t, i, s) for i, t, s in src])
    assert run(spark, docs, src) == want


def test_empty_tables_and_a_very_long_record(spark):
    assert run(spark, []) == set()
    long = json.dumps({"x": [{"n": "y" * 50} for _ in range(5000)]})
    assert len(run(spark, [("a", "t", long)])) == 5000


def test_far_and_often_wrapped_arrays():
    far = json.dumps({"a": " " * 100 + '[{"x": 1}, {"x": 2}]'})
    often = json.dumps([{"y": 1}])
    for _ in range(12):
        often = json.dumps(often)
    objects, _ = nested.linked_paths([far, often])
    assert sorted((i, segs) for i, segs, _ in objects) == [(0, ["/a/0"]), (0, ["/a/1"]), (1, ["/0"])]
