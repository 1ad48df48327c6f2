import json
from datetime import datetime

from turnwise.operators.schema_drift import cast_value, canonical, chained, correspondences, families, field_origins, find_changes, flood, predecessors, renamed_on, unified_records

FILES = "file_id long, feed_id long, path string, exported_at timestamp, ingested_at timestamp, n_lines int"
LINES = "file_id long, line_no int, raw string"


def files(spark, rows):
    return spark.createDataFrame([(f, feed, None, at, None, 1) for f, feed, at in rows], FILES)


def lines(spark, by_file):
    return spark.createDataFrame([(f, i, r if isinstance(r, str) else json.dumps(r)) for f, rs in by_file.items() for i, r in enumerate(rs)], LINES)


def test_changes(spark):
    day = lambda d: datetime(2025, 1, d)
    fs = files(spark, [(1, 7, day(1)), (1, 7, day(1)), (3, 7, day(9)), (2, 7, day(5)), (4, 7, day(12)), (9, 8, day(1)), (10, None, day(2))])
    ls = lines(
        spark,
        {
            1: [{"id": "a", "message": "Hello there", "n": 1, "lang": "en", "gone": "x"}, {"id": "b", "message": "Two", "n": 2, "lang": "de", "gone": None}, "{broken", "[1]"],
            2: [{"id": "b", "content": {"text": "Two"}, "n": "2", "locale": "de", "fresh": 5}, {"id": "c", "content": {"text": "Three"}, "n": "3", "locale": "fr", "fresh": 6}],
            3: [{"id": "c", "content": "Three", "n": "3", "locale": "fr", "fresh": None}],
            4: ["nonsense"],
        },
    )
    got = {tuple(r) for r in find_changes(fs, ls.union(ls)).collect()}
    assert got == {
        (2, "renamed", "message", "content"), (2, "renamed", "lang", "locale"), (2, "removed", "gone", ""), (2, "added", "", "fresh"), (2, "retyped", "n", "n"), (3, "retyped", "content", "content"),
        *{(4, "removed", f, "") for f in ("id", "content", "n", "locale", "fresh")},
    }
    assert find_changes(fs.limit(0), ls).count() == 0


def test_predecessors_of_a_long_feed(spark):
    rows = [(i, 1, datetime(2020 + i // 300, 1 + i % 12, 1 + (i // 12) % 25, i % 24)) for i in range(900)]
    got = {r.file_id: r.prev_id for r in predecessors(files(spark, rows)).collect()}
    order = [f for f, _, _ in sorted(rows, key=lambda r: (r[2], r[0]))]
    assert got == {b: a for a, b in zip([None, *order], order)}


def test_canonical():
    assert canonical("2025-01-01T00:00:00Z") == canonical(1735689600) == canonical("1735689600000")
    assert canonical(["a", "b"]) == canonical("a,b") and canonical(False) == canonical(0) and canonical(None) is None
    assert canonical({"text": {"text": "Hi!"}}) == canonical("hi")


def test_flooding_prefers_carried_values():
    side = lambda *n: [{"field": x, "kinds": ["string"], "nested": []} for x in n]
    s = flood(side("a", "b"), side("c", "d"), {("a", "d"): (3, 3), ("b", "c"): (3, 3), ("a", "c"): (0, 3)})
    assert s["a", "d"] > s["a", "c"] and s["b", "c"] > s["b", "d"]


def test_unified(spark):
    ls = lines(spark, {1: [{"id": 5, "role": "User", "text": {"text": "hi"}, "created_at": 12, "x": [1]}, "bad"]})
    (r,) = unified_records(files(spark, [(1, 7, datetime(2025, 1, 1))]), ls.union(ls)).collect()
    assert (r.feed_id, r.message_id, r.sent_at, r.speaker, r.content, r.rest) == (7, "5", "12", "User", "hi", '{"x": [1]}')


def test_unified_follows_the_renames(spark):
    day = lambda d: datetime(2025, d, 1)
    fs = files(spark, [(1, 7, day(1)), (2, 7, day(3)), (3, 7, day(5)), (4, 8, day(1))])
    ls = lines(
        spark,
        {
            1: [{"id": "a", "content": "One", "author": {"name": "User", "kind": "person"}, "lang": "en", "score": 4, "tags": ["x", "y"], "edited": True}, {"id": "b", "content": "Two", "lang": "de", "score": 2.5, "tags": None, "edited": False}],
            2: [{"id": "b", "blurb": {"text": "Two"}, "locale": "de", "rating": "2.5", "tags": None, "edited": 0, "text": "else"}],
            3: [{"id": "b", "blurb": "Two", "language": "de", "rating": "2.5", "tags": "z", "edited": "false"}, {"id": "c", "blurb": "Three", "language": "fr", "rating": "n/a", "tags": "x,y", "edited": "true"}],
            4: [{"id": "d", "content": "Four", "msg": "Other", "language": "es"}],
        },
    )
    got = {(r.file_id, r.line_no): r.asDict() for r in unified_records(fs, ls.union(ls), share=0.8).collect()}
    told = {k: (v["content"], v["speaker"], v["language"], v["rating"], v["tags"], v["edited"]) for k, v in got.items()}
    assert told == {
        (1, 0): ("One", "User", "en", 4.0, "x,y", True), (1, 1): ("Two", None, "de", 2.5, None, False), (2, 0): ("Two", None, "de", 2.5, None, False),
        (3, 0): ("Two", None, "de", 2.5, "z", False), (3, 1): ("Three", None, "fr", None, "x,y", True), (4, 0): ("Four", None, "es", None, None, None),
    }
    rest = {k: json.loads(v["rest"]) for k, v in got.items()}
    assert rest == {(1, 0): {"author": {"name": "User", "kind": "person"}}, (1, 1): {}, (2, 0): {"text": "else"}, (3, 0): {}, (3, 1): {"rating": "n/a"}, (4, 0): {"msg": "Other"}}


def test_origins_are_chained_over_spans(spark):
    rows = [(i, 7, datetime(2025, 1 + i, 1)) for i in range(1, 7)]
    steps = [(2, "a", "b"), (3, "c", "a"), (4, "b", "d"), (4, "a", "b"), (6, "d", "a")]
    moves = spark.createDataFrame(steps, "file_id long, old_field string, new_field string")
    got = {r.file_id: {x["name"]: x["origin"] for x in r.origins} for r in field_origins(files(spark, rows), moves).collect()}
    assert got == {1: {}, 2: {"b": "a"}, 3: {"b": "a", "a": "c"}, 4: {"d": "a", "b": "c"}, 5: {"d": "a", "b": "c"}, 6: {"b": "c"}}
    one = renamed_on(renamed_on({}, [("a", "b")]), [("b", "c")])
    assert chained(renamed_on({}, [("z", "a")]), one)["c"] == "z"


def test_names_of_two_meanings_are_not_joined():
    got = families({("lang", "locale"): 9, ("score", "value"): 1, ("blurb", "text"): 2}, {"lang": 5, "locale": 3, "score": 4, "value": 6, "text": 9}, {("score", "text"): 4})
    assert got["locale"] == got["lang"] == "lang" and got["score"] == "score" and got["value"] == got["blurb"] == "content"
    assert cast_value("7", "bigint", False) == ("7", True) and cast_value("7.5", "bigint", False)[0] is None and cast_value({"id": "m"}, "string", False) == ("m", True)


def test_a_chance_agreement_takes_no_rename():
    side = lambda **n: [{"field": x, "kinds": [k], "nested": []} for x, k in n.items()]
    told = {("edited", "rating"): (1, 1), ("score", "rating"): (9, 10)}
    assert correspondences(side(edited="boolean", score="number"), side(rating="number"), told) == [("score", "rating")]
    assert correspondences(side(edited="boolean", score="number"), side(rating="boolean"), told) == [("score", "rating")]
    assert correspondences(side(edited="boolean"), side(rating="number"), {("edited", "rating"): (2, 10)}) == []


def test_flooding_decides_where_messages_cannot(monkeypatch):
    """Four pairs carry equal values (1, "1" and so on) in as many messages: the types, over which scores flow, tell them apart."""
    from turnwise.operators import schema_drift

    side = lambda **n: [{"field": x, "kinds": [k], "nested": []} for x, k in n.items()]
    old, new = side(alpha="string", beta="number"), side(xi="number", yota="string")
    told = {(a, b): (3, 3) for a in ("alpha", "beta") for b in ("xi", "yota")}
    assert set(correspondences(old, new, told)) == {("alpha", "yota"), ("beta", "xi")}
    keep = lambda *n: [{"field": x, "kinds": ["object"], "nested": k} for x, k in n]
    old, new = keep(("alpha", ["city"]), ("beta", ["model"])), keep(("xi", ["model"]), ("yota", ["city"]))
    assert set(correspondences(old, new, told)) == {("alpha", "yota"), ("beta", "xi")}
    monkeypatch.setattr(schema_drift, "flood", lambda o, n, e: {(a["field"], b["field"]): 0.0 for a in o for b in n})
    assert set(correspondences(old, new, told)) == {("alpha", "xi"), ("beta", "yota")}


def test_both_ways_to_read_a_line_agree(spark):
    from turnwise.operators.schema_drift import parse_slowly, with_fields
    from pyspark.sql import functions as F

    raws = [
        '{"a":1,"b":"1","c":null,"d":true,"e":[1,{"z":2}],"f":{"y":1,"x":"q"},"g":1.5,"h":"ü"}', '{"a":1} x', '{"a":1}{"b":2}', '{"a":1},{"b":2}', '{"a":1}]', '{"a":1}] {}',
        '{"a":1,"a":"2"}', "[1]", "7", '"x"', '{"a":NaN}', "", "{", '{"a":1}}', '  {"id":"x"}  ', '{"big":123456789012345678901234567890}', "{}", None,
    ]
    df = spark.createDataFrame(list(enumerate(raws)), "n int, raw string")
    form = lambda fields: sorted((f.name, f.kind, f.text, f.nested) for f in fields)
    fast = {r.n: form(r.fields) for r in with_fields(df).collect() if r.fields is not None}
    slow = {r.n: form(r.f) for r in df.select("n", parse_slowly("raw").alias("f")).where("f IS NOT NULL").collect()}
    assert fast == slow and set(slow) == {0, 6, 10, 14, 15, 16}
