import json

from skein.operators import shred


def nodes(spark, *rows):
    df = spark.createDataFrame([(i, a, b, "x", 1) for i, a, b in rows], "tool_id bigint, input_schema string, output_schema string, doc string, node int")
    return sorted((tuple(r) for r in shred.schema_nodes(df).collect()), key=str)


def test_paths_and_types(spark):
    s = {"type": "object", "properties": {"a/b~": {"type": ["string", "null"], "enum": [{"type": "x"}]}, "type": {"items": [{"type": 7}, True]}}, "additionalProperties": {"anyOf": [{"type": {"n": ["q"]}}]}, "$defs": {"d": {"additionalProperties": False}}, "default": {"type": "no"}}
    got = {(p, q, t) for _, _, p, q, t in nodes(spark, (1, json.dumps(s), None))}
    assert got == {("#", "", "object"), ("#/properties/a~1b~0", "#", "string|null"), ("#/properties/type", "#", ""), ("#/properties/type/items/0", "#/properties/type", ""), ("#/properties/type/items/1", "#/properties/type", ""), ("#/additionalProperties", "#", ""), ("#/additionalProperties/anyOf/0", "#/additionalProperties", ""), ("#/$defs/d", "#", "")}


def test_odd_texts(spark):
    inner = json.dumps({"type": "string"})
    got = nodes(spark, (1, None, ""), (2, '{"type": "str', "{} x"), (3, json.dumps(inner), json.dumps(json.dumps(inner))), (4, "7", '{"type": NaN}'), (5, '{"type":"a","type":"b"}', None), (5, '{"type":"a","type":"b"}', None), (None, inner, None))
    assert got == sorted([(3, "input", "#", "", "string"), (3, "output", "#", "", "string"), (4, "input", "#", "", ""), (5, "input", "#", "", "b"), (None, "input", "#", "", "string")], key=str)


def test_very_deep():
    n = 30_000
    text = '{"items":' * n + "{}" + "}" * n
    ok, value = shred.parse_schema(text)
    assert ok and sum(1 for _ in shred.shred(value)) == n + 1
    assert shred._loads_deep('{"a": [1, {"b": null}, [], {}], "c": "x"}') == {"a": [1, {"b": None}, [], {}], "c": "x"}
    for bad in ("[1,]", '{"a":1,}', "[1 2]", '{"a" 1}', "[", "{}}"):
        try:
            shred._loads_deep(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_empty(spark):
    assert nodes(spark) == []


def test_any_record_as_related_tables(spark):
    order = '{"id": 7, "who": {"name": "a"}, "lines": [{"sku": "x", "n": 1, "tags": ["p"]}, {"sku": "y"}], "a/b": {"c": null}}'
    df = spark.createDataFrame([(1, order), (2, "{"), (3, None), (4, "[]"), (5, '{"lines": [1, {}]}')], "k bigint, t string")
    adj = shred.nodes(df, "k", "t")
    lines = {(r.k, r.ordinal): r for r in shred.entity_table(adj, "k", r"^/lines/\[\]$", ["sku", "n"]).collect()}
    assert {x: (r.c_sku, r.c_n) for x, r in lines.items()} == {(1, 0): ("x", "1"), (1, 1): ("y", None), (5, 1): (None, None)}
    top = {r.k: r for r in shred.entity_table(adj, "k", "^$", ["id"]).collect()}
    assert set(top) == {1, 5} and lines[1, 0].above == top[1].node and top[1].c_id == "7" and top[1].above is None
    assert [r.c_c for r in shred.entity_table(adj, "k", "^/a~1b$", ["c"]).collect()] == [None]
    assert shred.entity_table(shred.nodes(df.filter("false"), "k", "t"), "k", "", ["id"]).count() == 0
