import numpy as np
import pytest

from tesselle.operators import graphs, neighbours


def cycles(spark, edges):
    return [(r.path, r.weight) for r in graphs.heaviest_cycles(spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src int, dst int, w double")).orderBy("cycle_no").collect()]


def test_heaviest_cycles(spark):
    a = [(0, 1, 1), (1, 2, 1), (2, 0, 10), (3, 4, 2), (4, 5, 2), (5, 3, 2), (0, 3, 0.1), (4, 0, 0.1)]
    assert cycles(spark, a) == [([0, 1, 2], 12.0), ([3, 4, 5], 6.0)]
    got = cycles(spark, [(0, 1, 5), (1, 2, 5), (2, 0, 1), (2, 3, 4), (3, 4, 3), (4, 2, 3)])
    assert len(got) == 1 and got[0][0][0] == 0
    assert cycles(spark, [(0, 0, 5), (1, 2, 3), (2, 1, 3)]) == [([1, 2], 6.0), ([0], 5.0)]
    assert cycles(spark, [(0, 1, 1), (1, 2, 1), (2, 3, 1)]) == []


def test_edges_are_checked(spark):
    bad = spark.createDataFrame([(0, 9, 1.0)], "src int, dst int, w double")
    with pytest.raises(Exception, match="out of range"):
        graphs.check_edges(bad, 3).collect()


def test_heap():
    h = graphs.IndexedHeap()
    for v, p in ((10, 5.0), (20, 2.0), (30, 3.0)):
        h.push(v, p)
    assert h.update(10, 1.0) and not h.update(99, 1.0) and 10 in h
    assert [h.pop()[0] for _ in range(3)] == [10, 20, 30]
    for v in (5, 3, 4):
        h.push(v, 1.0)
    with pytest.raises(RuntimeError):
        h.push(5, 0.0)
    assert [h.pop()[0] for _ in range(3)] == [3, 4, 5]
    with pytest.raises(RuntimeError):
        h.pop()


def test_heap_against_sorted_model():
    r = np.random.default_rng(3)
    h, model = graphs.IndexedHeap(), {}
    for v in range(500):
        model[v] = float(r.integers(0, 50))
        h.push(v, model[v])
    while model:
        for v in r.integers(0, 500, 5).tolist():
            if v in model:
                model[v] = float(r.integers(0, 50))
                assert h.update(v, model[v])
        want = min(model, key=lambda v: (model[v], v))
        assert h.pop() == (want, model.pop(want))


def test_queue_order(spark):
    ops = [(10, 5.0, 0), (20, 2.0, 1), (30, 3.0, 2), (10, 1.0, 3)]
    got = graphs.queue_order(spark.createDataFrame(ops, "value int, priority double, op_no int")).orderBy("pos").collect()
    assert [r.value for r in got] == [10, 20, 30]


def test_knn_and_radius_equal_brute_force(spark):
    r = np.random.default_rng(7)
    p = r.uniform(-100, 100, (1500, 2))
    q = np.vstack([[1.25, -3.5], r.uniform(-300, 300, (20, 2))])
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double")
    queries = spark.createDataFrame([(i, *map(float, x), 10.0 + 30 * (i % 3)) for i, x in enumerate(q)], "qid long, x double, y double, radius double")
    d2 = ((q[:, None] - p[None]) ** 2).sum(axis=2)
    knn, rad = {}, {}
    for x in neighbours.knn_join(points, queries, 10).orderBy("qid", "rank").collect():
        knn.setdefault(x.qid, []).append(x.id)
    for x in neighbours.radius_join(points, queries).collect():
        rad.setdefault(x.qid, set()).add(x.id)
    for i in range(len(q)):
        assert knn[i] == np.lexsort((np.arange(len(p)), d2[i]))[:10].tolist()
        assert rad.get(i, set()) == set(np.flatnonzero(d2[i] <= (10.0 + 30 * (i % 3)) ** 2).tolist())
    assert neighbours.knn_join(points.limit(3), queries, 10).count() == 3 * len(q)
    assert neighbours.knn_join(points.limit(0), queries, 4).count() == 0
    with pytest.raises(ValueError):
        neighbours.knn_join(points, queries, -1)


def plain_best(w):
    n, found = len(w), []

    def grow(path, weight):
        for v in range(path[0], n):
            if np.isfinite(w[path[-1], v]):
                if v == path[0]:
                    found.append((weight + w[path[-1], v], path))
                elif v not in path:
                    grow([*path, v], weight + w[path[-1], v])

    for s in range(n):
        grow([s], 0.0)
    top = max((x for x, _ in found), default=None)
    return min(((p, x) for x, p in found if x >= top - 1e-6), key=lambda c: (-len(c[0]), c[0]), default=None)


def test_cycle_search_equals_enumeration():
    r = np.random.default_rng(1)
    for _ in range(150):
        n = int(r.integers(1, 7))
        w = np.where(r.random((n, n)) < r.choice([0.3, 0.6, 1]), r.integers(0, r.choice([1, 2, 5, 50]), (n, n)).astype(float), -np.inf)
        assert graphs.CycleSearch(w).best() == plain_best(w)


def nearest(points, queries, k):
    out = {}
    for q, x, y in queries:
        got = sorted(((a - x) ** 2 + (b - y) ** 2, i) for i, a, b in points if a is not None and b is not None and a == a and abs(a) != float("inf"))
        out |= {(q, n): i for n, (_, i) in enumerate(got[:k])}
    return out


@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e9])
def test_neighbours_at_every_scale(spark, scale):
    r = np.random.default_rng(3)
    xy = np.concatenate([r.normal(size=(150, 2)), r.normal(size=(100, 2)) * 1e-4 + 2, np.repeat([[5.0, 5.0]], 40, axis=0), [[900.0, -900.0]]]) * scale
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(xy)] + [(1000, None, 1.0), (1001, float("nan"), 1.0), (1002, float("inf"), 1.0)]
    queries = [(i, float(a * 1.01), float(b)) for i, (a, b) in enumerate(xy[::9])] + [(500, 1e5 * scale, 1e5 * scale), (501, 5.0 * scale, 5.0 * scale)]
    p = spark.createDataFrame(points, "id long, x double, y double")
    q = spark.createDataFrame([*queries, (999, None, 0.0)], "qid long, x double, y double")
    for k in (1, 7, 400):
        got = {(x.qid, x["rank"]): x.id for x in neighbours.knn_join(p, q, k).collect()}
        assert got == nearest(points, queries, k)


def test_neighbours_far_apart_and_few(spark):
    p = spark.createDataFrame([(i, i * 1e9, 0.0) for i in range(3)], "id long, x double, y double")
    q = spark.createDataFrame([(1, 5e8, 0.0)], "qid long, x double, y double")
    for k in (2, 5):
        assert [(r["rank"], r.id) for r in neighbours.knn_join(p, q, k).orderBy("rank").collect()] == [(0, 0), (1, 1), (2, 2)][:k]
    one = p.filter("id = 0")
    assert [r.id for r in neighbours.knn_join(one, q, 3).collect()] == [0] and neighbours.knn_join(one.limit(0), q, 3).count() == 0 and neighbours.knn_join(p, q.limit(0), 3).count() == 0
    assert neighbours.knn_join(p, q, 0).count() == 0
    for bad in ({"k": -1}, {"k": 1, "eps": -1.0}, {"k": 1, "most_visited": -1}):
        with pytest.raises(ValueError):
            neighbours.knn_join(p, q, **bad)


def test_radii_of_every_size(spark):
    r = np.random.default_rng(8)
    xy = r.normal(size=(200, 2)) * 50
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, x double, y double")
    queries = [(k, float(a), float(b), float(s)) for k, ((a, b), s) in enumerate(zip(xy[::10], [0.0, 1e-7, 0.4, 3.0, 17.0, 64.0, 90.0, 400.0, -1.0] * 3))]
    got = {(x.qid, x.id) for x in neighbours.radius_join(p, spark.createDataFrame(queries, "qid long, x double, y double, radius double")).collect()}
    assert got == {(k, i) for k, a, b, s in queries if s >= 0 for i, (x, y) in enumerate(xy) if (x - a) ** 2 + (y - b) ** 2 <= s * s}


def test_buckets_of_a_queue_change_nothing(spark):
    r = np.random.default_rng(1)
    rows = [(["a", None][k % 2], int(v), None if k % 31 == 0 else float(p), k) for k, (v, p) in enumerate(zip(r.integers(0, 150, 400), r.integers(0, 60, 400)))]
    df = spark.createDataFrame(rows, "q string, value long, priority double, op_no long")
    runs = [sorted(((x.q or "", x.pos, x.value) for x in graphs.queue_order(df, ["q"], n).collect())) for n in (10**9, 1, 9)]
    assert runs[0] == runs[1] == runs[2]
    last = {(q, v): p for q, v, p, _ in rows}
    for q in ("a", None):
        want = sorted((v for g, v in last if g == q), key=lambda v: (last[q, v] is not None, last[q, v] or 0, v))
        assert [v for g, _, v in runs[0] if g == (q or "")] == want
    assert sorted(x.pos for x in graphs.queue_order(df.drop("q"), bucket_rows=5).collect()) == list(range(len({v for _, v, _, _ in rows})))
