import json

import pytest

from cadenza.operators import nested


def test_triples_cover_a_record():
    t = nested.triples('{"a": 1.5, "b": [{"c": "x"}, null, {"c": null}], "d": {"e": true}, "f": []}')
    assert ("a", (), "1.5", "number") in t
    assert ("b[].c", (0,), "x", "string") in t
    assert ("b[]", (1,), None, "null") in t
    assert ("b[].c", (2,), None, "null") in t
    assert ("d.e", (), "true", "bool") in t
    assert ("f", (), None, "list") in t


def test_lone_objects_wrappers_and_repeated_encoding():
    inner = {"s": {"x": 1}, "t": json.dumps([{"x": 2}, {"x": 3}])}
    text = "﻿ " + json.dumps(json.dumps({"payload": inner, "hash": "h"}))
    t = nested.triples(text, lists=("s",), wrappers=("payload",))
    assert ("s[].x", (0,), "1", "number") in t
    assert [(o, v) for p, o, v, _ in t if p == "t[].x"] == [((0,), "2"), ((1,), "3")]


def test_last_of_repeated_keys_and_plain_texts():
    t = nested.triples('{"a": {"b": 1}, "a": 2, "c": "[not json", "d": "\\"q\\"", "e": "{}x"}')
    assert [x for x in t if x[0].startswith("a")] == [("a", (), "2", "number")]
    assert ("c", (), "[not json", "string") in t
    assert ("d", (), '"q"', "string") in t


@pytest.mark.parametrize("bad", ["", "{", '{"a": 1', '{"a" 1}', "[1,]", "{} {}", '{"a": tru}', "nul", '{"a": 01}', '"\x01"'])
def test_unreadable(bad):
    with pytest.raises(nested.Unreadable):
        nested.triples(bad)


def test_agrees_with_the_standard_parser():
    import random

    rng = random.Random(5)

    def value(d):
        k = rng.random()
        if d and k < 0.3:
            return {rng.choice("abcd") + str(i): value(d - 1) for i in range(rng.randint(0, 3))}
        if d and k < 0.6:
            return [value(d - 1) for _ in range(rng.randint(0, 3))]
        return rng.choice([None, True, 3, -2.5e-3, "tëxt\n\"q\"", "", "a[b"])

    def walk(v, p="", o=()):
        if isinstance(v, dict):
            yield p, o, None, "object"
            for k, x in v.items():
                yield from walk(x, f"{p}.{k}" if p else k, o)
        elif isinstance(v, list):
            yield p, o, None, "list"
            for i, x in enumerate(v):
                yield from walk(x, f"{p}[]", (*o, i))
        else:
            yield p, o, None if v is None else v if isinstance(v, str) else json.dumps(v), {type(None): "null", bool: "bool", str: "string"}.get(type(v), "number")

    for _ in range(200):
        v = value(4)
        assert nested.triples(json.dumps(v)) == list(walk(v))


def by_tokens(text, **kw):
    out = []
    nested._read(text.lstrip("﻿"), "", (), kw.get("lists", ()), kw.get("wrappers", ()), 8, out)
    return [x for x in out if x is not None]


def test_both_readers_agree_on_encoded_wrapped_and_lone_values():
    import random

    rng = random.Random(7)

    def value(d):
        k = rng.random()
        if d and k < 0.35:
            v = {rng.choice(["s", "t", "payload", "a"]): value(d - 1) for _ in range(rng.randint(0, 3))}
        elif d and k < 0.6:
            v = [value(d - 1) for _ in range(rng.randint(0, 3))]
        else:
            return rng.choice([None, False, 12, 1.50, "x", '"q"', "{", "[1, 2", '{"s": {"y": 1}}', '" [3] "', "1", ""])
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            v = json.dumps(v)
        return v

    for _ in range(400):
        text = json.dumps({"payload": value(4), "s": value(3)} if rng.random() < 0.5 else value(4))
        assert nested.triples(text, ("s", "t"), ("payload",)) == by_tokens(text, lists=("s", "t"), wrappers=("payload",))
    deep = "[" * 4_000 + "]" * 4_000
    assert len(nested.triples(deep)) == 4_000


def test_only_what_lies_under_the_paths_asked_for():
    text = '{"a": {"b": [{"c": 1, "d": 2}], "e": 3}, "ab": 4}'
    assert [p for p, *_ in nested.triples(text, under=("a.b[].c",))] == ["", "a", "a.b", "a.b[]", "a.b[].c"]


def test_columns_are_found_by_group(spark):
    df = spark.createDataFrame([(1, '{"n": 1, "m": {"x": null}, "segs": [{"t": 1}, {"u": {"v": 2}}], "tags": ["a"]}', 1)], "rid bigint, body string, at int")
    v = nested.path_values(df, "rid", "body", "at")
    assert nested.found_columns(v) == {"": ["n"], "segs[]": ["t", "u.v"], "tags[]": [""]}
    with pytest.raises(ValueError):
        nested.found_columns(v, 2)


def test_tables_keep_parents_and_one_delivery(spark):
    rows = [
        (1, "k", '{"n": 1, "segs": [{"beats": [{"t": 1}, null, {"t": "2"}]}, null, {"beats": {"t": 9}}]}', 1), (1, "k", '{"n": 1', 2), (1, "k", '{"n": 1, "segs": [{"beats": [{"t": 1}, null, {"t": "2"}]}, null, {"beats": {"t": 9}}]}', 3),
        (2, None, None, 1), (None, "k", "{}", 1), (3, "k", "oops", 1), (4, "k", '{"segs": []}', 1), (5, "k", '{"n": 7}', None),
    ]
    df = spark.createDataFrame(rows, "rid bigint, path string, body string, at int")
    v = nested.path_values(df, "rid", "body", "at", [], ("segs", "beats"))
    b = nested.pivot_group(v, "segs[].beats[]", {"t": "t"}).where("is_object")
    assert sorted((r["id"], tuple(r["parent"]), r["pos"], r["t"]) for r in b.collect()) == [(1, (0,), 0, "1"), (1, (0,), 2, "2"), (1, (2,), 0, "9")]
    top = {r["id"]: r["n"] for r in nested.pivot_group(v, "", {"n": "n"}).collect()}
    assert top == {1: "1", 4: None, 5: "7"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "rid bigint, body string, at int")
    assert nested.path_values(df, "rid", "body", "at").isEmpty()
