"""Queries over whole tables against plain versions."""

import os

import pytest

from tesselle.operators import objects
from tesselle.plans import catalog, views

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_graph_components_of_all_line_items(spark):
    of = {r.o_orderkey: r.o_custkey for r in views.table(spark, DATA, "orders").collect()}
    edges = [(of[r.l_orderkey], -(r.l_suppkey + 1)) for r in views.table(spark, DATA, "lineitem").collect() if r.l_orderkey in of]
    nodes = sorted({v for e in edges for v in e})
    at = {v: i for i, v in enumerate(nodes)}
    sets = objects.DisjointSets(len(nodes))
    for a, b in edges:
        sets.unite(at[a], at[b])
    least: dict[int, int] = {}
    for v in nodes:
        least.setdefault(sets.find(at[v]), v)
    got = {r.node: r.comp for r in catalog.QUERIES["graph_components"](spark, DATA).collect()}
    assert got == {v: least[sets.find(at[v])] for v in nodes}


def test_every_event_is_mapped(spark):
    got = {r.event_id: (list(r.evens), list(r.names)) for r in catalog.QUERIES["filter_map_vector"](spark, DATA).collect()}
    ids = [r.event_id for r in views.table(spark, DATA, "events").select("event_id").collect()]
    assert got == {i: ([x for x in (i % 5, i % 7, i % 11) if x % 2 == 0], [f"n{i % 5}", f"n{i % 7}"]) for i in ids}


def test_every_event_is_donor_or_sample(spark):
    rows = [(r.event_id, r.event_type, r.t, r.value) for r in views.table(spark, DATA, "events").selectExpr("event_id", "event_type", "unix_micros(cast(ts as timestamp)) t", "value").collect()]
    donors, want = {}, []
    for i, kind, t, v in rows:
        if i % 2 == 0:
            donors.setdefault(kind, []).append((t, v))
    for i, kind, t, _ in rows:
        if i % 2:
            (t0, v0), (t1, v1) = max((x for x in donors[kind] if x[0] <= t), default=(None, None)), min((x for x in donors[kind] if x[0] >= t), default=(None, None))
            want.append((kind, t, v1 if t0 is None else v0 if t1 in (None, t0) else v0 + (v1 - v0) * (t - t0) / (t1 - t0)))
    got = sorted((r.event_type, r.t, r.value) for r in catalog.QUERIES["asof_sample"](spark, DATA).collect())
    assert len(got) == len(want) == len(rows) - sum(map(len, donors.values()))
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-4 for a, b in zip(got, sorted(want)))


def test_heaviest_cycles_of_the_whole_network(spark):
    w = {(r.src, r.dst): r.w for r in views.trade(spark, LARGER).collect()}
    got = catalog.QUERIES["heaviest_cycles"](spark, LARGER).orderBy("cycle_no").collect()
    for r in got:
        assert r.weight == sum(w[e] for e in zip(r.path, [*r.path[1:], r.path[0]]))
    # A walk that takes the heaviest edge to a new nation closes to a cycle of the network.
    for start in {a for a, _ in w}:
        path = [start]
        while on := [(x, -b) for (a, b), x in w.items() if a == path[-1] and b not in path]:
            path.append(-max(on)[1])
        assert got[0].weight >= sum(w[e] for e in zip(path, path[1:])) + w.get((path[-1], start), -sum(w.values()))
