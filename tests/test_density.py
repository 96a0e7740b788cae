"""Density clustering by cells and blocks, and connected components, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ophelion.operators import cluster, density, graph

ROWS = "label string, i long, v array<double>"


def cloud(kind):
    rng = np.random.default_rng(len(kind))
    if kind == "blobs":
        x = np.concatenate([rng.normal(c, 0.3, (45, 6)) for c in (0, 2, 2.9, 6)] + [rng.uniform(-2, 8, (40, 6))])
    elif kind == "chain":  # one cluster through many cells
        t = np.linspace(0, 40, 240)[:, None]
        x = np.concatenate([t, np.sin(t), np.cos(t), t * 0, t * 0], axis=1)
    else:  # copies, missing values and rows of few values
        x = np.concatenate([np.repeat(rng.normal(0, 1, (3, 6)), 30, axis=0), rng.normal(0, 1, (110, 6))])
        x[rng.random(x.shape) < 0.08] = np.nan
        x[5] = np.nan
    return x[rng.permutation(len(x))]


def frame(spark, clouds):
    rows = [(label, i, [None if np.isnan(e) else float(e) for e in row]) for label, x in clouds.items() for i, row in enumerate(x)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, ROWS).repartition(4)


@pytest.mark.parametrize(("block", "pivots"), [(1000, 256), (40, 256), (25, 3)])
def test_clusters_as_in_one_task(spark, block, pivots):
    clouds = {"blobs": cloud("blobs"), "chain": cloud("chain"), None: cloud("missing")}
    grid = [(0.35, 4), (0.5, 4), (0.5, 12)]
    found = density.cluster_grid(frame(spark, clouds), ["label"], "i", "v", grid, block=block, pivots=pivots).collect()
    got = {}
    for r in found:
        got.setdefault((r["eps"], r["min_samples"], r["label"]), {})[r["i"]] = r["cluster"]
    for eps, least in grid:
        for label, x in clouds.items():
            want = cluster.dbscan(x, eps, least)
            assert [got[eps, least, label][i] for i in range(len(x))] == want.tolist(), (eps, least, label)
    assert {r["cluster"] for r in found} >= {-1, 0, 1, 2}
    totals = {(r["eps"], r["min_samples"]): r for r in cluster.sweep_totals(density.sweep(frame(spark, clouds), ["label"], "i", "v", grid[:1], block=block, pivots=pivots)).collect()}
    assert totals[0.35, 4]["points"] == sum(map(len, clouds.values()))


def test_cells_leave_pairs_out(spark):
    """Far cells aren't compared: a chain's cells hold few points but their own."""
    _, found = density.points(frame(spark, {"chain": cloud("chain")}), ["label"], "i", "v")
    placed = density.cells(found, 0.2, 20, 256).collect()
    assert sum(r["home"] for r in placed) == 240
    assert len({r["cell"] for r in placed}) > 5 and len(placed) < 240 * 3


@pytest.mark.parametrize("block", [1000, 30])
def test_knn_mean_distance(spark, block):
    clouds = {"blobs": cloud("blobs"), "missing": cloud("missing"), "two": np.array([[0.0] * 6, [1.0] * 6])}
    for k in (1, 5):
        got = {(r["label"], r["i"]): r["mean_distance"] for r in density.knn_mean_distance(frame(spark, clouds), ["label"], "i", "v", k, block=block).collect()}
        for label, x in clouds.items():
            d = cluster.distance_block(x, x)
            np.fill_diagonal(d, 0)
            d[(np.nan_to_num(x, nan=1e9)[:, None] == np.nan_to_num(x, nan=1e9)[None]).all(axis=2)] = 0  # equal vectors are one point
            want = np.sort(d, axis=1)[:, : max(2, k)].mean(axis=1)
            assert [got[label, i] for i in range(len(x))] == pytest.approx(want.tolist(), abs=1e-7)


def test_no_rows(spark):
    none = frame(spark, {"a": cloud("blobs")}).where("false")
    assert density.cluster(none, ["label"], "i", "v", 0.5, 4).count() == 0
    assert density.knn_mean_distance(none, ["label"], "i", "v", 3).count() == 0


def brute_components(edges):
    root = {}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {x: top(x) for x in root}


@pytest.mark.parametrize("kind", ["random", "chain", "hub", "loops"])
def test_components(spark, kind):
    rng = random.Random(2)
    edges = {
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(130)],
        "chain": [(i, i + 1) for i in range(60)],
        "hub": [(50, i) for i in range(100)] + [(200, 201)],
        "loops": [(1, 1), (2, 2), (3, 2), (2, 3)],
    }[kind]
    rng.shuffle(edges)
    df = spark.createDataFrame([*edges, (None, 7)], "a long, b long")
    found = graph.components(df).collect()
    assert {r["node"]: r["root"] for r in found} == brute_components(edges) and len(found) == len(brute_components(edges))
    assert graph.components(df.where("false")).count() == 0


def test_a_point_goes_to_few_tasks(spark):
    """Points are sent once for each group of their partition, and groups stay few."""
    rng = np.random.default_rng(3)
    _, found = density.points(frame(spark, {"a": rng.normal(0, 1, (400, 6))}), ["label"], "i", "v")
    dealt = density.grouped(found, 10)
    assert {r["groups"] for r in dealt.collect()} == {density.GROUPS}
    assert density._crossed(dealt, alike=True).count() == 400 * density.GROUPS
    assert {r["groups"] for r in density.grouped(found, 400).collect()} == {1}


def test_pieces_of_one_cluster_are_not_compared(monkeypatch):
    """Core points that are one cluster already need no distances."""
    import pandas as pd

    x = np.random.default_rng(4).normal(0, 0.01, (200, 6))
    pdf = pd.DataFrame({"v": [v.tobytes() for v in x], "group": 0})
    compared, keep = [], density._between
    monkeypatch.setattr(density, "_between", lambda x, a, b, m: compared.append(len(a) * len(b)) or keep(x, a, b, m))
    (joined,), (reached,) = density._join(pdf, np.arange(200)[:, None], [1.0], 5, 20, 4)
    assert set(joined[1]) == {0} and reached.shape == (2, 0)
    assert sum(compared) < 200 * 200 / 4


def test_enough_neighbours_end_a_count(monkeypatch):
    """Ten times the points of a cloud take far less than a hundred times the distances,
    and what is counted of points with too few neighbours is whole."""
    import pandas as pd

    keep, took = density._between, {}
    for n in (400, 4000):
        rng = np.random.default_rng(n)
        x = np.concatenate([rng.normal(0, 1, (n, 6)), rng.normal(0, 9, (20, 6))])
        x[3, 2] = np.nan
        pdf = pd.DataFrame({"v": [v.tobytes() for v in x], "group": 0, "weight": rng.integers(1, 3, len(x))})
        took[n] = 0

        def between(x, a, b, m, n=n):
            took[n] += len(a) * len(b)
            return keep(x, a, b, m)

        monkeypatch.setattr(density, "_between", between)
        sums, open_ = density._counted(pdf, x, np.ones(len(x), bool), [1.5, 2.0], [6, 4], 5, 100, 256)
        d = cluster.distance_block(x, x)
        np.fill_diagonal(d, 0.0)
        want = np.stack([(d <= r) @ pdf["weight"].to_numpy() for r in (1.5, 2.0)])
        assert (open_ == ((want[0] < 6) | (want[1] < 4))).all() and 0 < open_.sum() < 100
        assert (sums[:, open_] == want[:, open_]).all()
        assert took[400] < 420 * 420
    assert took[4000] < 20 * took[400] and took[4000] < 4020 * 4020 / 30


def test_settled_points_are_not_sent_to_each_other(spark):
    """Only open points meet other groups; every pair of groups with an open end meets once."""
    _, found = density.points(frame(spark, {"a": np.random.default_rng(5).normal(0, 1, (400, 6)), "b": np.ones((3, 6))}), ["label"], "i", "v")
    dealt = density.grouped(found, 10).withColumn("open", density.F.col("first") < 7).localCheckpoint()
    rows = {r["id"]: (r["group"], r["open"], r["part"]) for r in dealt.collect()}
    sent = density._across(dealt, "open", block=10).collect()
    assert len(sent) < 400 + 7 * 3 * density.GROUPS
    tasks, met = {}, []
    for r in sent:
        tasks.setdefault((r["part"], r["low"], r["high"]), []).append((r["group"], r["id"]))
    for members in tasks.values():
        met += [frozenset((i, j)) for g, i in members for h, j in members if g < h]
    want = [frozenset((i, j)) for i in rows for j in rows if i < j and rows[i][2] == rows[j][2] and rows[i][0] != rows[j][0] and (rows[i][1] or rows[j][1])]
    assert len(met) == len(set(met)) and set(met) == set(want)


def test_hubs_join_the_clusters_of_all_groups(spark):
    """Clouds of one cluster, of several with thin bridges, with copies, far points and
    points at the edge, each in several groups."""
    clouds = {}
    for k in range(10):
        rng = np.random.default_rng(k)
        parts = [rng.normal(0, 0.3, (150, 6)), rng.normal(0, 0.3, (20 + 12 * k, 6)) + 2, rng.uniform(-2, 4, (30, 6))]
        if k % 2:
            parts.append(np.linspace(0, 2, 25)[:, None] + rng.normal(0, 0.1, (25, 6)))
        if k % 3 == 0:
            parts.append(np.repeat(rng.normal(1, 1, (4, 6)), 9, axis=0))
        x = np.concatenate(parts)
        clouds[f"c{k}"] = x[rng.permutation(len(x))]
    grid = [(0.3, 4), (0.36, 9), (0.42, 4)]
    found = density.cluster_grid(frame(spark, clouds), ["label"], "i", "v", grid, block=40).collect()
    got = {(r["eps"], r["min_samples"], r["label"], r["i"]): r["cluster"] for r in found}
    assert len(got) == len(found) == len(grid) * sum(map(len, clouds.values()))
    for eps, least in grid:
        for label, x in clouds.items():
            assert [got[eps, least, label, i] for i in range(len(x))] == cluster.dbscan(x, eps, least).tolist(), (eps, least, label)
    x = clouds["c1"]
    hubs = density._hubs(x, np.ones(len(x), bool), 0.3, 5)
    assert 100 < len(hubs) <= density.HUBS
    assert len(density._hubs(x, np.zeros(len(x), bool), 0.3, 5)) == 0
