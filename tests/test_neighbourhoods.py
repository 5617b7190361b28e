import json
import random

import pytest

from skuforge.operators import enrich, graph


def random_edges(seed, products=40):
    draw = random.Random(seed)
    return sorted({(f"product:{p}", f"{kind}:{draw.randint(0, 9)}", kind) for p in range(products) for kind in ("category", "brand", "finish") if draw.random() < 0.5})


def walk(edges, start, radius):
    near = {}
    for a, b, _ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen, last = ({start: 0}, {start}) if start in near else ({}, set())
    for d in range(1, radius + 1):
        last = {b for a in last for b in near[a]} - set(seen)
        seen |= dict.fromkeys(last, d)
    return seen


@pytest.mark.parametrize("radius", (0, 1, 3, 50))
def test_many_starts_against_one_walk_each(spark, radius):
    edges = random_edges(radius)
    starts = [f"product:{i}" for i in range(0, 40, 3)] + ["brand:1", "product:none", None, "product:0"]
    got = graph.neighbourhoods(spark.createDataFrame(edges, "product string, node string, kind string"), spark.createDataFrame([(s,) for s in starts], "start string"), radius)
    want = {(s, n, d) for s in starts if s for n, d in walk(edges, s, radius).items()}
    rows = got.collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_plans_are_as_long_at_any_radius(spark):
    e = spark.createDataFrame([(f"product:{i}", f"series:{i + d}", "series") for i in range(30) for d in (0, 1)], "product string, node string, kind string")
    starts = spark.createDataFrame([("product:0",)], "start string")
    sizes = [len(graph.neighbourhoods(e, starts, r)._jdf.queryExecution().analyzed().toString().splitlines()) for r in (2, 9)]
    assert sizes[0] == sizes[1]


def test_steps_go_by_class_whatever_the_copies(spark, monkeypatch):
    # 3 kinds of products with 20 copies each; and x and y, which are neighbours of themselves and of each other
    edges = [(f"product:{i}-{c}", f"{k}:{v}", k) for i in range(3) for c in range(20) for k, v in (("category", i // 2), ("brand", i))] + [(a, b, "loop") for a, b in (("x", "x"), ("y", "x"), ("y", "y"))]
    starts = [f"product:{i}-{c}" for i in range(2) for c in range(20)] + ["x", "y", "brand:2"]
    folders, write = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: folders.append(write(df, name)) or folders[-1])
    for radius in (1, 2, 4):
        folders.clear()
        rows = graph.neighbourhoods(spark.createDataFrame(edges, "product string, node string, kind string"), spark.createDataFrame([(s,) for s in starts], "start string"), radius).collect()
        want = {(s, n, d) for s in starts for n, d in walk(edges, s, radius).items()}
        assert {tuple(r) for r in rows} == want and len(rows) == len(want)
        # 4 classes of starts, 9 of nodes; by node the steps' tables had a row for each of the result's
        assert spark.read.parquet(*folders).count() <= 4 * 9


@pytest.mark.parametrize("members", (256, 7))
def test_starts_and_nodes_meet_in_lists(spark, monkeypatch, members):
    # 30 kinds of products with 20 copies each: 61 classes, and 600 starts
    monkeypatch.setattr(graph, "MEMBERS_A_LIST", members, raising=False)
    monkeypatch.setattr(graph, "PAIRS_A_TASK", 20_000, raising=False)
    edges = [(f"product:{i}-{c}", f"{k}:{v}", k) for i in range(30) for c in range(20) for k, v in (("category", 0), ("brand", i))]
    starts = sorted({p for p, _, _ in edges})
    near = graph.neighbourhoods(spark.createDataFrame(edges, "product string, node string, kind string"), spark.createDataFrame([(s,) for s in starts], "start string"), 3)
    rows = near.collect()
    want = {(s, n, d) for s in starts for n, d in walk(edges, s, 3).items()}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    # every start meets every class; those were rows of their own, shuffled, sorted and joined with the nodes as the last step
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.find("Generate explode(nodes") < plan.find("REPARTITION_BY_NUM") < plan.find("Join")


def test_drawn_elements_of_a_focus_and_of_all(spark):
    edges = [("product:1", "category:bolt", "category"), ("product:1", "brand:a:b", "brand"), ("product:2", "brand:a:b", "brand"), ("product:2", "finish:x\"y", "finish")]
    e = spark.createDataFrame(edges, "product string, node string, kind string")
    near = graph.neighbourhoods(e, spark.createDataFrame([("product:1",)], "start string"), 1)
    got = [(r.start, r.part, json.loads(r.element)["data"]) for r in graph.drawn(e, near).collect()]
    assert sorted((x["id"], x["label"], x["kind"]) for s, p, x in got if p == "node") == [("brand:a:b", "brand=a:b", "attribute"), ("category:bolt", "bolt", "category"), ("product:1", "1", "product")]
    assert sorted((x["source"], x["target"], x["relation"]) for s, p, x in got if p == "edge") == [("product:1", "brand:a:b", "has_attribute"), ("product:1", "category:bolt", "in_category")]
    assert {s for s, _, _ in got} == {"product:1"}
    every = [json.loads(r.element)["data"] for r in graph.drawn(e).collect()]
    assert len(every) == 9 and any(x.get("id") == 'finish:x"y' for x in every)


def test_consensus_by_series_then_by_brand(spark):
    cats = spark.createDataFrame([(i, "c", "B") for i in range(5)] + [(9, "c", "b"), (10, "d", "B"), (11, "c", None)], "record_id long, category string, brand string")
    fields = [(i, "series", "S", 0.9) for i in range(5)] + [(i, "finish", "red", 0.9) for i in range(3)] + [(3, "finish", "blue", 0.3)] + [(i, "mass", "2", 0.9) for i in range(2)]
    fields = spark.createDataFrame(fields, "record_id long, key string, value string, confidence double")
    wanted = spark.createDataFrame([(4, "finish"), (9, "finish"), (10, "finish"), (11, "finish"), (4, "mass")], "record_id long, key string")
    got = {(r.record_id, r.key): (r.value, r.support, r.share) for r in enrich.series_consensus(cats, fields, wanted).collect()}
    assert got == {(4, "finish"): ("red", 3, 0.75), (9, "finish"): ("red", 3, 0.6)}
