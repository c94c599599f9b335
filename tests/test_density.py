import math
import random

import pytest

from smeltery.functions.components import connected
from smeltery.operators import density
from smeltery.operators.density import dbscan


def plain(points, eps, least):
    """point-by-point: neighbours, core points, components, nearest core point."""
    near = {i: [j for j, q in points.items() if sum((a - b) ** 2 for a, b in zip(p, q)) <= eps * eps] for i, p in points.items()}
    core = {i for i, n in near.items() if len(n) >= least}
    label, roots = {}, []
    for i in sorted(core):
        if i in label:
            continue
        roots.append(i)
        todo = [i]
        while todo:
            x = todo.pop()
            if x in label:
                continue
            label[x] = len(roots) - 1
            todo += [j for j in near[x] if j in core]
    out = {}
    for i, p in points.items():
        if i in core:
            out[i] = (label[i], True)
            continue
        held = [(sum((a - b) ** 2 for a, b in zip(p, points[j])), label[j]) for j in near[i] if j in core]
        out[i] = (min(held)[1] if held else -1, False)
    return out


@pytest.mark.parametrize("d, eps, least", [(1, 2.0, 3), (2, 3.0, 5), (2, 3.0, 1), (3, 4.0, 6)])
def test_equals_point_by_point(spark, d, eps, least, monkeypatch):
    monkeypatch.setattr(density, "REPRESENTATIVES", 2)
    monkeypatch.setattr(density, "BLOCK", 3)
    r = random.Random(d * 10 + least)
    points = {}
    for i in range(260):
        middle = r.choice([0, 12, 15, 40])
        points[i] = tuple(float(round(middle + r.gauss(0, 3)) if r.random() < 0.9 else r.randrange(-30, 80)) for _ in range(d))
    for i in range(260, 300):
        points[i] = points[0]  # one place that many rows share
    names = [f"x{k}" for k in range(d)]
    rows = spark.createDataFrame([(i, *p) for i, p in points.items()], ["id", *names]).repartition(4)
    got = {r.id: (r.cluster, r.is_core) for r in dbscan(rows, names, eps, least).collect()}
    assert got == plain(points, eps, least)


def test_odd_rows(spark):
    rows = [(1, 0.0, 0.0), (2, -0.0, 0.0), (3, 0.1, None), (4, float("nan"), 0.0), (5, float("inf"), 0.0), (6, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    got = {r.id: (r.cluster, r.is_core) for r in dbscan(df, ["a", "b"], 1.0, 2).collect()}
    assert got == {1: (0, True), 2: (0, True), 3: (-1, False), 4: (-1, False), 5: (-1, False), 6: (-1, False)}
    assert dbscan(df.limit(0), ["a", "b"], 1.0, 2).collect() == []
    with pytest.raises(ValueError):
        dbscan(df, ["a"] * 7, 1.0, 2)


def test_a_dense_cell_gives_no_pairs(spark):
    """Twenty thousand different points in one cell: no join meets points with points of that cell."""
    df = spark.range(20_000).selectExpr("id", "id / 100000.0D AS a", "(id * 7 % 20000) / 100000.0D AS b")
    out = dbscan(df, ["a", "b"], 1.0, 5)
    assert out.where("cluster = 0 AND is_core").count() == 20_000
    assert math.sqrt(2) * 0.2 < 1.0


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(300 + i, 301 + i) for i in range(40)]
    nodes = spark.createDataFrame([(i,) for i in range(400)], "node int")
    root = {i: i for i in range(400)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected(nodes, spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {i: find(i) for i in range(400)}
