"""Chains and reachability against plain loops."""

import random

import pytest
from cairnlore.operators import graph


def chain(parents, node):
    out, path = [], [node]
    while node in parents:
        node = parents[node]
        out.append(node)
        if node in path:
            break
        path.append(node)
    return out


def test_all_ancestors_by_plain_walks(spark):
    dice = random.Random(3)
    parents = {str(i): str(i - 1) for i in range(1, 70)}  # a chain of 69 steps
    parents |= {f"t{i}": f"t{dice.randrange(i)}" for i in range(1, 60)}  # a tree
    parents |= {"f1": "f3", "f2": "f1", "f3": "f2", "tail": "f3", "tail2": "tail", "self": "self"}  # cycles
    rows = [*parents.items(), ("1", "0"), (None, "1"), ("t0", None), ("5", "9")]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "id string, parent string, ancestor string")
    got = {(r.id, r.ancestor, r.depth) for r in graph.all_ancestors(df).collect()}
    assert got == {(n, a, d + 1) for n in parents for d, a in enumerate(chain(parents, n))}
    assert graph.all_ancestors(df.limit(0)).count() == 0


def test_all_ancestors_agree_with_steps(spark):
    df = spark.createDataFrame([("f3", "f2"), ("f2", "f1"), ("f1", "f3"), ("a", "b"), ("b", "c")], "id string, parent string")
    rows = lambda x: sorted(tuple(r) for r in x.collect())
    assert rows(graph.all_ancestors(df)) == rows(graph.ancestors(df))


@pytest.mark.parametrize("broadcast", [True, False])
def test_many_sources_by_plain_searches(spark, broadcast, monkeypatch):
    dice = random.Random(4)
    monkeypatch.setattr(graph, "FRONTIER", 200_000 if broadcast else 0)
    pairs = {(dice.randrange(60), dice.randrange(60)) for _ in range(90)} | {(i, 7) for i in range(60)} | {(7, i) for i in range(0, 60, 3)}
    rows = [("n", str(a), "n", str(b), "imports") for a, b in pairs]
    edges = spark.createDataFrame(rows + rows[:5] + [("n", "1", "n", "2", "other"), ("n", None, "n", "1", "imports")], "from_type string, from_id string, to_type string, to_id string, relation string")
    sources = spark.createDataFrame([("n", str(i), 0) for i in range(100)] + [("n", "1", 1), ("n", None, 2), ("m", "1", 3)], "type string, id string, depth int").repartition(3)
    want, back = set(), set()
    for out, links in ((want, pairs), (back, {(b, a) for a, b in pairs})):
        for start in range(60):
            seen, front = {start}, {start}
            for d in range(1, 4):
                front = {b for a, b in links if a in front} - seen
                seen |= front
                out |= {(str(start), str(b), d) for b in front}
    got = [(r.source_id, r.node_id, r.depth) for r in graph.reached(edges, sources, 3, ["imports"]).collect()]
    assert set(got) == want and len(got) == len(want)
    turned = graph.reversed_edges(edges, {"imports": "imported_by"})
    assert {(r.source_id, r.node_id, r.depth) for r in graph.reached(turned, sources, 3, ["imported_by"]).collect()} == back


def test_relations_and_ids(spark):
    edges = spark.createDataFrame([("f", "a", "f", "b", "imports"), ("f", "b", "f", "c", "imports"), ("f", "a", "f", "d", "other")], "from_type string, from_id string, to_type string, to_id string, relation string")
    trace = lambda e, start, **k: sorted((r.node, r.depth) for r in graph.flow_trace(e, "f", start, **k).collect())
    assert trace(edges, "a", relations=["imports"]) == [("f:b", 1), ("f:c", 2)]
    assert trace(graph.reversed_edges(edges), "c") == [("f:a", 2), ("f:b", 1)]
    assert sorted(r.id for r in graph.related_ids(edges, "f", "a", 1).collect()) == ["b", "d"]
