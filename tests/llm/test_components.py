import random

import pytest
from graphloom.llm.components import alias_keys, connected_components, decision_links, mention_links, name_key, name_links


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components_equal_union_find(spark, shape):
    r = random.Random(3)
    pairs = {
        "chain": [(f"v{i:03}", f"v{i + 1:03}") for i in range(120)],
        "star": [("hub", f"v{i:03}") for i in range(150)] + [("x", "y"), ("y", "x"), ("z", "z")],
        "random": [(f"v{r.randrange(90):03}", f"v{r.randrange(90):03}") for _ in range(60)] + [(None, "v001")],
    }[shape]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert {x.id: x.group_id for x in connected_components(df).collect()} == union_find(pairs)


def test_empty(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert connected_components(df).collect() == []


def test_keys():
    assert name_key(" Foo-(Bar)_（x） ") == "foobarx"
    assert name_key("Weiß") == name_key("WEISS")
    assert alias_keys('["A", "b"') == [] and alias_keys("null") == [] and alias_keys('{"a": 1}') == []
    assert alias_keys('["A-b", 3, null, "ab"]') == ["ab"]


def test_links(spark):
    rows = [
        ("e1", "Alpha", "T", '["beta"]'),
        ("e2", "BETA ", "T", None),
        ("e3", "Beta", "U", "[]"),
        ("e4", "Gamma", "T", '["same"]'),
        ("e5", "Delta", "T", '["same", "Delta"]'),
        ("e6", None, "T", "broken["),
        ("e7", "be-ta", "T", ""),
    ]
    e = spark.createDataFrame(rows, "id string, preferred_name string, entity_type string, aliases_json string")
    found = {tuple(sorted(x)) for x in name_links(e).collect()}
    assert union_find(found) == {"e1": "e1", "e2": "e1", "e7": "e1"}
    ids = e.select("id")
    c = spark.createDataFrame(
        [("e1", "e2", "merged"), ("e2", "e1", "auto_merged"), ("e1", "gone", "merged"), ("e1", "e3", "rejected"), ("e1", "e1", "merged"), (None, "e1", "merged")],
        "left_entity_id string, right_entity_id string, status string",
    )
    assert {tuple(sorted(x)) for x in decision_links(c, ids).collect()} == {("e1", "e2")}
    m = spark.createDataFrame(
        [("m1", "e4"), ("m1", "e5"), ("m1", "seed"), ("m2", "e1"), ("m2", "e1"), (None, "e1"), (None, "e2"), ("m3", None), ("m4", "seed"), ("m4", "e1")],
        "id string, canonical_entity_id string",
    )
    assert {tuple(x) for x in mention_links(m, ids).collect()} == {("e4", "e5")}
