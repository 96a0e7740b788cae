"""Density clustering and nearest distances of partitions of any size.

Equal vectors are one point with a weight. The points of a partition are dealt to a few
groups by hash. A task cuts its groups into pieces around pivots; pieces are compared
unless the triangle inequality tells that none of their points are within eps. Missing
values break it: points that have some are pieces that meet all.

Neighbours are counted in each group, for a point only until there are enough. Only points
that have too few, the open ones, meet other groups. Then the core points of a group are
joined to clusters, together with a few of the partition, its hubs, which are one cluster
and go to every group: what they reach is one cluster through all groups. Again only the
other points are open and meet other groups, and only links of clusters leave a task.
Linked clusters are connected components of a small graph.

No pair of points is left out unless it can't change a result, so where most points are
open (noise, or clusters as small as a group's share of them) the work grows with all
pairs in near pieces. Where points have enough neighbours in their own group and are one
cluster, it grows as the points.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import drop, staged
from .cluster import distance_block
from .graph import components

#: Points of a block, and pivots of a partition; cells beyond that grow and are cut.
BLOCK, PIVOTS = 1000, 256


def _stack(values: pd.Series) -> np.ndarray:
    return np.array([[np.nan if e is None else e for e in v] for v in values], np.float64)


def _plain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Text columns as Python objects: Spark can't take strings of several Arrow chunks."""
    return pdf.astype({c: object for c in ("part", "point", "node") if c in pdf})


def _partition(columns: Sequence[str]) -> Column:
    """One text for the values of the partition's columns; nulls are values."""
    return F.to_json(F.struct(*columns)) if columns else F.lit("")


def points(df: DataFrame, partition: Sequence[str], row_id: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """The rows (partition, row_id, part, point), and the points (part, point, weight,
    first, v): vectors that differ, with how many rows have them and the least row_id.
    A null vector is one without values."""
    v = F.transform(F.coalesce(F.col(vector).cast("array<double>"), F.array().cast("array<double>")), lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x + F.lit(0.0)))
    rows = df.select(*partition, row_id, _partition(partition).alias("part"), v.alias("v")).withColumn("point", F.md5(F.to_json(F.struct("part", "v"), {"ignoreNullFields": "false"}).cast("binary")))
    found = rows.groupBy("part", "point").agg(F.count(F.lit(1)).alias("weight"), F.min(row_id).alias("first"), F.first("v").alias("v"))
    return rows.drop("v"), found


def _hashed(column: str, n: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(seed)), n).cast("int")


def cells(found: DataFrame, reach: float, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(part, cell, point, weight, first, v, home): every point in its home cell, and in
    the cells whose points may be within ``reach`` of it. A partition of up to ``block``
    points is one cell; the points of least hash are the pivots of a larger one."""
    whole = F.forall("v", lambda x: x.isNotNull())
    counts = found.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims"))
    sized = found.join(counts, "part").withColumn("whole", whole & (F.size("v") == F.col("dims")))
    turn = F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64("point", F.lit(1)), "point"))
    chosen = sized.where("whole").where(F.col("n") > block).withColumn("turn", turn).where(F.col("turn") <= pivots)
    chosen = chosen.where(F.col("turn") <= F.ceil(F.col("n") / block)).select("part", "n", "v", "turn")
    # points go to Python in groups of bounded size, each with the pivots of its partition
    groups = F.ceil(F.col("n") / block).cast("int")
    dealt = sized.select("part", "point", "weight", "first", "v", "whole", _hashed("point", groups, 2).alias("group"))
    sent = chosen.select(F.col("part").alias("of"), "turn", F.col("v").alias("centre"), F.explode(F.sequence(F.lit(0), groups - 1)).alias("to"))

    def assign(mine: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        base = mine[["part", "point", "weight", "first", "v"]]
        if mine.empty or centres.empty:
            return _plain(base.assign(cell=np.int32(0), home=True))
        c = _stack(centres.sort_values("turn")["centre"])
        is_whole = mine["whole"].to_numpy(bool)
        home, near = np.zeros(len(mine), np.int64), np.ones((len(mine), len(c)), bool)
        if is_whole.any():
            d = distance_block(_stack(mine["v"][is_whole]), c, 0)
            home[is_whole] = d.argmin(axis=1)
            near[is_whole] = d <= d.min(axis=1, keepdims=True) + 2 * reach + 1e-6
        at, cell = np.nonzero(near)
        return _plain(base.iloc[at].assign(cell=cell.astype(np.int32), home=home[at] == cell))

    first = found.schema["first"].dataType.simpleString()
    return dealt.groupBy("part", "group").cogroup(sent.groupBy("of", "to")).applyInPandas(assign, f"part string, point string, weight long, first {first}, v array<double>, cell int, home boolean")


def _paired(placed: DataFrame, *columns: str, block: int = BLOCK) -> DataFrame:
    """Rows of tasks (part, cell, one, two): a block of a cell's own points (asks), and a
    block of all its points."""
    sizes = placed.groupBy("part", "cell").agg((F.count_if("home") / block + 1).cast("int").alias("ones"), (F.count(F.lit(1)) / block + 1).cast("int").alias("twos"))
    sized = placed.join(sizes, ["part", "cell"])
    mine, theirs = _hashed("point", F.col("ones"), 3), _hashed("point", F.col("twos"), 4)
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = sized.where("home").select("part", "cell", mine.alias("one"), upto("twos").alias("two"), F.lit(True).alias("asks"), "point", "v", "home", *columns)
    held = sized.select("part", "cell", upto("ones").alias("one"), theirs.alias("two"), F.lit(False).alias("asks"), "point", "v", "home", *columns)
    return asks.unionByName(held)


def _distances(asks: pd.DataFrame, held: pd.DataFrame, min_valid: int) -> np.ndarray:
    d = distance_block(_stack(asks["v"]), _stack(held["v"]), min_valid)
    d[asks["point"].to_numpy()[:, None] == held["point"].to_numpy()[None, :]] = 0.0
    return d


TASK = ["part", "cell", "one", "two"]


#: A partition of more than a block of points is dealt to GROUPS groups, to more of them
#: where a group would hold over HELD blocks, and has up to HUBS hubs.
GROUPS, HELD, HUBS = 8, 32, 256


@F.pandas_udf(T.BinaryType())
def _bytes(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: np.asarray(v, np.float64).tobytes())


def _matrix(values: pd.Series) -> np.ndarray:
    """Vectors of ``_bytes``; shorter ones miss the values at their end."""
    width = max(map(len, values)) // 8
    blank = np.full(width, np.nan).tobytes()
    return np.frombuffer(b"".join(v + blank[len(v) :] for v in values), np.float64).reshape(len(values), width)


def grouped(found: DataFrame, block: int = BLOCK, keys: DataFrame | None = None) -> DataFrame:
    """(part, id, point, weight, first, v, group, groups): points with a number of their
    own and the group that they are dealt to. ``keys``, the points' (part, point), spares
    a pass over ``found``."""
    n = (found if keys is None else keys).groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    many = F.greatest(F.least(F.ceil(F.col("n") / block), F.lit(GROUPS)), F.ceil(F.col("n") / (HELD * block))).cast("int")
    # a row for a block of points at most, so points don't move to meet it
    sized = found.join(F.broadcast(n.select("part", many.alias("groups"))), "part", "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    return sized.select("part", F.monotonically_increasing_id().alias("id"), "point", "weight", "first", _bytes("v").alias("v"), _hashed("point", F.col("groups"), 2).alias("group"), "groups")


def _crossed(dealt: DataFrame, *columns: str, alike: bool) -> DataFrame:
    """Every point once for each pair (low, high) of groups that its own is in; ``alike``
    keeps the pairs of a group with itself."""
    other = dealt.select("part", "id", "group", "v", *columns, F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("other"))
    other = other if alike else other.where("group <> other")
    return other.withColumns({"low": F.least("group", "other"), "high": F.greatest("group", "other")}).drop("other")


def _across(marked: DataFrame, *columns: str, block: int = BLOCK) -> DataFrame:
    """Rows of tasks (part, low, high) that hold every pair of points of different groups
    of which one is ``open``: the open points of two groups, or a slice of the open ones
    (as group -1) with the other points of a group."""
    opened = marked.where("open and groups > 1")
    slices = F.broadcast(opened.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / (HELD * block)).cast("int").alias("slices")))
    asks = opened.join(slices, "part").withColumn("low", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).where("low <> group")
    asks = asks.withColumns({"group": F.lit(-1), "high": -1 - _hashed("id", F.col("slices"), 5)})
    held = marked.where("not open").join(slices, "part").withColumns({"low": F.col("group"), "high": F.explode(F.sequence(-F.col("slices"), F.lit(-1)))})
    kept = ["part", "id", "group", "v", *columns, "low", "high"]
    return _crossed(opened, *columns, alike=False).select(kept).unionByName(asks.select(kept)).unionByName(held.select(kept))


def _pieces(x: np.ndarray, at: np.ndarray, block: int, pivots: int) -> list[tuple]:
    """The points ``at`` as (places, centre, radius) of up to ``block`` near ones; points
    with missing values have no centre."""
    whole = np.isfinite(x[at]).all(axis=1)
    cells = [(at[~whole], False)]
    full = at[whole]
    if len(full) > block:
        k = min(pivots, -(-len(full) // block))
        home = distance_block(x[full], x[full[:: len(full) // k][:k]], 0).argmin(axis=1)
        cells += [(full[home == c], True) for c in range(k)]
    else:
        cells.append((full, True))
    out = []
    for cell, centred in cells:
        for start in range(0, len(cell), block):
            part = cell[start : start + block]
            centre = x[part].mean(axis=0, keepdims=True) if centred else None
            out.append((part, centre, distance_block(x[part], centre, 0).max() if centred else np.inf))
    return out


def _meeting(x: np.ndarray, one: list[tuple], two: list[tuple] | None, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of pieces that may hold points within ``reach``, by the triangle inequality;
    without ``two`` the pairs of ``one``, a piece with itself included."""
    for i, (a, centre, radius) in enumerate(one):
        for b, other, size in one[i:] if two is None else two:
            if centre is None or other is None or a is b or distance_block(centre, other, 0)[0, 0] <= radius + size + reach + 1e-6:
                yield a, b


def _pairs_of(pdf: pd.DataFrame, x: np.ndarray, reach: float, block: int, pivots: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    group = pdf["group"].to_numpy()
    sides = [_pieces(x, np.flatnonzero(group == g), block, pivots) for g in np.unique(group)]
    return _meeting(x, sides[0], sides[1] if len(sides) == 2 else None, reach)


def _between(x: np.ndarray, a: np.ndarray, b: np.ndarray, min_valid: int) -> np.ndarray:
    d = distance_block(x[a], x[b], min_valid)
    if a is b:
        np.fill_diagonal(d, 0.0)  # missing values or not
    return d


def _facing(a: np.ndarray, b: np.ndarray, open_: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Blocks that hold every pair of two pieces of which one point is open once."""
    mine, rest = a[open_[a]], a[~open_[a]]
    blocks = [(mine, mine), (rest, mine)] if a is b else [(mine, b), (rest, b[open_[b]])]
    return [(p, q) for p, q in blocks if len(p) and len(q)]


def _counted(pdf: pd.DataFrame, x: np.ndarray, open_: np.ndarray, radii: Sequence[float], needs: Sequence[int], min_valid: int, block: int, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    """(the rows within each radius of each point, itself included; the points that are
    still open). A point is open until it has the rows that are needed at each radius;
    what is counted of open points is whole."""
    w, least, open_ = pdf["weight"].to_numpy(np.float64), np.asarray(needs)[:, None], open_.copy()
    sums = np.zeros((len(radii), len(pdf)))
    for a, b in _pairs_of(pdf, x, max(radii), block, pivots):
        for p, q in _facing(a, b, open_):
            d = _between(x, p, q, min_valid)
            for k, r in enumerate(radii):
                near = (d <= r).astype(np.float64)
                sums[k, p] += near @ w[q]
                if p is not q:
                    sums[k, q] += w[p] @ near
            for some in (p, q):
                open_[some] &= (sums[:, some] < least).any(axis=0)
    return sums, open_


def _hubs(x: np.ndarray, settled: np.ndarray, reach: float, min_valid: int) -> np.ndarray:
    """Up to HUBS of the settled points that are linked with each other."""
    at = np.flatnonzero(settled)
    at = at[:: max(1, len(at) // HUBS)][:HUBS]
    if not len(at):
        return at
    root = np.arange(len(at))
    _unite(root, *np.nonzero(_between(x, at, at, min_valid) <= reach))
    return at[root == np.bincount(root).argmax()]


def _unite(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Puts the ends of the links (u, v) under one root, the least of theirs."""
    while True:
        u, v = root[u], root[v]
        apart = u != v
        if not apart.any():
            return
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root[:] = root[root]


def _join(pdf: pd.DataFrame, comp: np.ndarray, radii: Sequence[float], min_valid: int, block: int, pivots: int) -> tuple[list, list]:
    """For each column of ``comp`` (the clusters of core points, -1 for others): the
    clusters and those they are joined to, and the pairs (place of another point, cluster
    that reaches it). Core points of the cluster that two pieces have most points of
    aren't compared with each other."""
    x, n = _matrix(pdf["v"]), len(radii)
    known, of, root, reached = [], [], [], [[np.zeros((2, 0), np.int64)] for _ in radii]
    for g in range(n):
        names, inverse = np.unique(comp[:, g], return_inverse=True)
        known.append(names), of.append(inverse), root.append(np.arange(len(names)))
    core, open_ = comp >= 0, np.zeros(len(pdf), bool)
    for a, b in _pairs_of(pdf, x, max(radii), block, pivots):
        both = a if a is b else np.concatenate([a, b])
        open_[both] = False
        for g in range(n):
            now = np.where(core[both, g], root[g][of[g][both]], -1)
            if (now >= 0).any():
                open_[both] |= now != np.bincount(now[now >= 0]).argmax()
        for p, q in _facing(a, b, open_):
            some = [g for g in range(n) if core[p, g].any() or core[q, g].any()]
            d = _between(x, p, q, min_valid) if some else None
            for g in some:
                near, cp, cq = d <= radii[g], core[p, g], core[q, g]
                i, j = np.nonzero(near & cp[:, None] & cq[None, :])
                _unite(root[g], of[g][p[i]], of[g][q[j]])
                if not cp.all():
                    i, j = np.nonzero(near & ~cp[:, None] & cq[None, :])
                    reached[g].append(np.stack([p[i], of[g][q[j]]]))
                if p is not q and not cq.all():
                    i, j = np.nonzero(near & cp[:, None] & ~cq[None, :])
                    reached[g].append(np.stack([q[j], of[g][p[i]]]))
    joined = [(known[g], known[g][root[g]], of[g]) for g in range(n)]
    return joined, [np.unique(np.stack([at, joined[g][1][c]]), axis=1) for g in range(n) for at, c in [np.concatenate(reached[g], axis=1)]]


def cluster_grid(df: DataFrame, partition: Sequence[str], row_id: str, vector: str, grid: Sequence[tuple[float, int]], min_valid: int = 5, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(eps, min_samples, partition, row_id, cluster) of every row for every pair of the
    grid, -1 for noise. Clusters are numbered by the least row_id of their core points;
    a row that several clusters reach gets the one of least number. Row ids are unique in
    their partition. Rows with equal vectors count each, missing values are compared as
    ``nan_euclidean`` does, and an empty table gives no rows."""
    radii, reach = sorted({float(e) for e, _ in grid}), [float(e) for e, _ in grid]
    needs = [max(int(m) for e, m in grid if float(e) == r) for r in radii]
    rows, found = points(df, partition, row_id, vector)
    rows = staged(rows, "rows")
    dealt = staged(grouped(found, block, rows.select("part", "point").distinct()), "dealt")
    first = dealt.schema["first"].dataType.simpleString()
    kept = f"part string, id long, point string, first {first}, v binary, group int, groups int, "

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        x, hub = _matrix(pdf["v"]), np.full(len(pdf), -1)
        sums, open_ = _counted(pdf, x, np.ones(len(pdf), bool), radii, needs, min_valid, block, pivots)
        if pdf["group"].iloc[0] == 0 and pdf["groups"].iloc[0] > 1:
            hubs = _hubs(x, ~open_, radii[0], min_valid)
            hub[hubs] = pdf["id"].to_numpy()[hubs].min(initial=np.iinfo(np.int64).max)
        return _plain(pdf.assign(w=list(sums.T), open=open_, hub=hub))

    def count_more(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, open_ = pdf["id"].to_numpy(), pdf["open"].to_numpy(bool)
        if pdf["group"].nunique() < 2:
            return pd.DataFrame({"id": [], "w": []}, dtype=object)
        sums, _ = _counted(pdf, _matrix(pdf["v"]), open_, radii, needs, min_valid, block, pivots)
        return pd.DataFrame({"id": ids[open_], "w": pd.Series(list(sums.T[open_]), dtype=object)})

    counted = staged(dealt.groupBy("part", "group").applyInPandas(count, kept + "weight long, w array<double>, open boolean, hub long"), "counted")
    drop(dealt)
    more = _across(counted, "weight", "open", block=block).groupBy("part", "low", "high").applyInPandas(count_more, "id long, w array<double>")
    total = counted.where("open").select("id", "w").unionByName(more).groupBy("id").agg(*[F.sum(F.col("w")[k]).alias(f"w{k}") for k in range(len(radii))])
    cores = staged(total.select("id", F.array(*(F.col(f"w{radii.index(float(e))}") >= int(m) for e, m in grid)).alias("core")), "cores")
    flagged = counted.drop("weight", "w", "open").join(cores, "id", "left").withColumns({"core": F.coalesce("core", F.array(*(F.lit(True) for _ in grid))), "copy": F.lit(False)})
    copies = flagged.where("hub >= 0").withColumns({"group": F.explode(F.sequence(F.lit(1), F.col("groups") - 1)), "copy": F.lit(True)})

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, core, hub = pdf["id"].to_numpy(np.int64), np.stack(pdf["core"].to_numpy()).astype(bool), pdf["hub"].to_numpy(np.int64)
        joined, reached = _join(pdf, np.where(core, np.where(hub < 0, ids, hub)[:, None], -1), reach, min_valid, block, pivots)
        comp = np.stack([now[of] for _, now, of in joined], axis=1)
        at, g, by = (np.concatenate(k) for k in zip(*((at, np.full(len(at), g), by) for g, (at, by) in enumerate(reached)), strict=True))
        top, open_ = hub.argmax(), np.ones(len(pdf), bool)
        if hub[top] >= 0:  # the cluster of the hubs has one name in all groups
            by = np.where(by == comp[top][g], hub[top], by)
            comp = np.where(comp == comp[top], hub[top], comp)
            open_ = (comp != hub[top]).any(axis=1)
        order = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[order], np.arange(1, len(pdf)))
        out = pdf.drop(columns=["core", "hub"]).assign(comp=list(comp), at=np.split(g[order], cuts), by=np.split(by[order], cuts), open=open_)
        return _plain(out[~out.pop("copy").to_numpy(bool)])

    # clusters of each group of points and the hubs, then of pairs of groups
    inside = staged(flagged.unionByName(copies).groupBy("part", "group").applyInPandas(within, kept + "comp array<long>, at array<int>, by array<long>, open boolean"), "inside")
    drop(counted)

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        if pdf["group"].nunique() == 2:
            ids = pdf["id"].to_numpy(np.int64)
            joined, reached = _join(pdf, np.stack(pdf["comp"].to_numpy()).astype(np.int64), reach, min_valid, block, pivots)
            for g, ((names, now, _), (at, by)) in enumerate(zip(joined, reached, strict=True)):
                out += [pd.DataFrame({"g": g, "a": names[names != now], "b": now[names != now], "core": True}), pd.DataFrame({"g": g, "a": ids[at], "b": by, "core": False})]
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("g", "a", "b", "core")})

    links = staged(_across(inside, "comp", block=block).groupBy("part", "low", "high").applyInPandas(across, "g int, a long, b long, core boolean"), "links")
    node = lambda c: (F.col(c) * len(grid) + F.col("g")).alias(c)
    roots = staged(components(links.where("core").select(node("a"), node("b"))), "roots")
    cored = inside.select("part", "id", "first", F.posexplode("comp").alias("g", "comp")).where("comp >= 0").select("part", "id", "first", "g", node("comp"))
    least = cored.groupBy("g", "part", "comp").agg(F.min("first").alias("first")).join(roots.withColumnRenamed("node", "comp"), "comp", "left").withColumn("root", F.coalesce("root", "comp"))
    least = staged(least.select("g", "part", "comp", "root", "first"), "clusters")
    number = (F.row_number().over(Window.partitionBy("g", "part").orderBy("first")) - 1).alias("cluster")  # clusters, not rows
    numbered = least.groupBy("g", "part", "root").agg(F.min("first").alias("first")).select("root", number)
    numbers = staged(least.join(numbered, "root").select("comp", "cluster"), "numbers")
    near = inside.select("id", F.inline(F.arrays_zip(F.col("at").alias("g"), F.col("by").alias("comp")))).select("id", "g", node("comp"))
    border = near.unionByName(links.where("not core").select(F.col("a").alias("id"), "g", F.col("b").alias("comp")).select("id", "g", node("comp")))
    labels = cored.select("id", "g", "comp").unionByName(border).join(numbers, "comp").groupBy("id").agg(*[F.min(F.when(F.col("g") == g, F.col("cluster"))).alias(f"c{g}") for g in range(len(grid))])
    named = inside.select("part", "point", "id").join(labels, "id").drop("id")
    every = F.explode(F.array(*(F.struct(F.lit(float(e)).alias("eps"), F.lit(int(m)).alias("min_samples"), F.coalesce(f"c{g}", F.lit(-1)).cast("int").alias("cluster")) for g, (e, m) in enumerate(grid)))).alias("x")
    out = rows.join(named, ["part", "point"], "left").select(*partition, row_id, every)
    return out.select("x.eps", "x.min_samples", *partition, row_id, "x.cluster")


def cluster(df: DataFrame, partition: Sequence[str], row_id: str, vector: str, eps: float, min_samples: int, **how) -> DataFrame:
    """(partition, row_id, cluster)."""
    return cluster_grid(df, partition, row_id, vector, [(eps, min_samples)], **how).drop("eps", "min_samples")


def sweep(df: DataFrame, partition: Sequence[str], row_id: str, vector: str, grid: Sequence[tuple[float, int]], **how) -> DataFrame:
    """(eps, min_samples, partition, points, clusters, noise) for each pair of a grid."""
    found = cluster_grid(df, partition, row_id, vector, grid, **how)
    return found.groupBy("eps", "min_samples", *partition).agg(F.count(F.lit(1)).cast("int").alias("points"), (F.max("cluster") + 1).alias("clusters"), F.count_if(F.col("cluster") == -1).cast("int").alias("noise"))


def knn_mean_distance(df: DataFrame, partition: Sequence[str], row_id: str, vector: str, k: int, min_valid: int = 5, block: int = BLOCK) -> DataFrame:
    """(partition, row_id, mean_distance) over the k nearest rows of the partition, itself
    included, two at least where there are so many. Points are compared in pairs of
    blocks; each returns the nearest distances of its points, and those are merged."""
    need = max(2, k)
    rows, found = points(df, partition, row_id, vector)
    rows = staged(rows, "rows")
    placed = found.withColumn("cell", F.lit(0)).withColumn("home", F.lit(True))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asks, held = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        if asks.empty or held.empty:
            return pd.DataFrame({"part": [], "point": [], "near": []})
        d = _distances(asks, held, min_valid)
        # a point of weight w is w rows, of which the k nearest hold k at most
        many = np.repeat(np.arange(len(held)), np.minimum(held["weight"].to_numpy(), need))
        d = d[:, many]
        d = np.sort(np.partition(d, need - 1, axis=1)[:, :need] if d.shape[1] > need else d, axis=1)
        return _plain(pd.DataFrame({"part": asks["part"], "point": asks["point"], "near": list(d)}))

    got = _paired(placed, "weight", block=block).groupBy(*TASK).applyInPandas(run, "part string, point string, near array<double>")
    # lists of k, two at a time: what a point gathers doesn't grow with the blocks
    merged = got.select("part", "point", F.explode("near").alias("d"))
    turn = F.row_number().over(Window.partitionBy("part", "point").orderBy("d"))
    means = merged.withColumn("turn", turn).where(F.col("turn") <= need).groupBy("part", "point").agg(F.avg("d").alias("mean_distance"))
    return rows.join(means, ["part", "point"]).select(*partition, row_id, "mean_distance")
