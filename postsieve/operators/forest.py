"""Forests and single trees of classes, grown to the end: wide nodes level by level over all rows, small ones whole in a task.

Spark's own trees send a histogram for every node of every partition, also for nodes of two rows; of trees without a
bound these are most.  Here a node of more than LOCAL_ROWS rows is split by added histograms, and what is below comes
to one task as bytes, a bin a feature, where it is grown level by level.  Held rows go down the same way and get their
leaf's shares where it is made, so no tree is ever sent or stored.

Chance comes from hashes of row number, tree and node, so a repeated task does the same again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from .cuts import Cuts

#: As Spark's trees have: parts of a feature's range.  Their edges are quantiles over all rows, within EDGE_ERROR of their ranks.
BINS, EDGE_ERROR = 32, 0.001
#: The most rows of a node that a task grows by itself, and histogram cells that it holds at once.
LOCAL_ROWS, CELLS = 1 << 15, 1 << 21
#: Gains below are rounding.
LEAST_GAIN = 1e-9
#: Shares of 0, 1, ... draws of a row: Poisson with mean 1.
DRAWS = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1)) for k in range(12)])
GOLDEN = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class How:
    trees: int
    depth: int
    least: int
    tried: int
    bagged: bool
    seed: int
    width: int
    classes: int


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _salt(how: How, tree: int) -> np.uint64:
    return np.uint64((how.seed * 1_000_003 + tree + 1) * GOLDEN % 2**64)


def draws(how: How, tree: int, number: np.ndarray) -> np.ndarray:
    """How often a tree has each row."""
    if not how.bagged:
        return np.ones(len(number), np.uint8)
    share = _mixed(_mixed(number) ^ _salt(how, tree)) / np.float64(2**64)
    return np.searchsorted(DRAWS, share, "right").astype(np.uint8)


def features_of(how: How, tree: int, path: np.ndarray) -> np.ndarray:
    """The features that each node tries, ascending."""
    if how.tried >= how.width:
        return np.broadcast_to(np.arange(how.width), (len(path), how.width))
    rank = _mixed(_mixed(path.astype(np.uint64) * np.uint64(GOLDEN) ^ _salt(how, tree))[:, None] + np.arange(1, how.width + 1, dtype=np.uint64)[None])
    return np.sort(np.argpartition(rank, how.tried - 1, axis=1)[:, : how.tried], axis=1)


def histogram(how: How, x: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Nodes by tried features by bins by classes: the weights of rows, whose nodes are `at`."""
    k, out = len(f), []
    for j in range(f.shape[1]):
        cell = (at * BINS + x[np.arange(len(x)), f[at, j]]) * how.classes + y
        out.append(np.bincount(cell, w, k * BINS * how.classes).reshape(k, BINS, how.classes))
    return np.stack(out, 1)


def best(how: How, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each node the largest fall of rows times Gini impurity, its place among the tried features and the last bin of the left side."""
    left = h.cumsum(2)
    whole = left[:, :1, -1:]
    left = left[:, :, :-1]
    right = whole - left
    a, b, n = left.sum(3), right.sum(3), whole.sum(3)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.einsum("kjbc,kjbc->kjb", left, left) / a + np.einsum("kjbc,kjbc->kjb", right, right) / b - (whole * whole).sum(3) / n
    gain = np.where((a >= how.least) & (b >= how.least), gain, -1.0).reshape(len(h), -1)
    at = gain.argmax(1)
    return gain[np.arange(len(h)), at], at // (BINS - 1), at % (BINS - 1)


def grown(how: How, tree: int, root: int, x: np.ndarray, y: np.ndarray, w: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All below one node: gains by feature, and shares of classes for each held row."""
    gains, votes = np.zeros(how.width), np.zeros((len(held), how.classes))
    path, at, to = np.array([root]), np.zeros(len(x), np.int64), np.zeros(len(held), np.int64)
    rows, kept = np.arange(len(x)), np.arange(len(held))
    step = max(1, CELLS // (how.tried * BINS * how.classes))
    for level in range(root.bit_length() - 1, how.depth + 1):
        k = len(path)
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        counts = np.bincount(at * how.classes + y[rows], w[rows], k * how.classes).reshape(k, -1)
        n = counts.sum(1)
        feature, cut = np.full(k, -1), np.zeros(k, np.int64)
        wide = np.flatnonzero((counts.max(1) < n) & (n >= 2 * how.least)) if level < how.depth else np.zeros(0, np.int64)
        place = np.full(k, -1)
        for a in range(0, len(wide), step):
            own = wide[a : a + step]
            place[own] = np.arange(len(own))
            part = slice(*np.searchsorted(at, [own[0], own[-1] + 1]))
            mine = rows[part][place[at[part]] >= 0]
            here = place[at[part]]
            f = features_of(how, tree, path[own])
            gain, j, b = best(how, histogram(how, x[mine], y[mine], w[mine], here[here >= 0], f))
            place[own] = -1
            good = gain > LEAST_GAIN
            feature[own[good]], cut[own[good]] = f[np.flatnonzero(good), j[good]], b[good]
            gains += np.bincount(feature[own[good]], gain[good], how.width)
        leaf = feature < 0
        end = leaf[to]
        votes[kept[end]] = counts[to[end]] / np.maximum(n[to[end], None], 1)
        if leaf.all():
            break
        child = 2 * (np.cumsum(~leaf) - 1)
        rows, at, kept, to = rows[~leaf[at]], at[~leaf[at]], kept[~end], to[~end]
        at = child[at] + (x[rows, feature[at]] > cut[at])
        to = child[to] + (held[kept, feature[to]] > cut[to])
        path = (2 * path[~leaf, None] + np.arange(2)).ravel()
    return gains, votes


@dataclass
class Top:
    """The nodes of one tree above those that tasks grow: paths (1 is the root, 2p and 2p + 1 are p's children), ascending, with feature and bin."""

    path: np.ndarray
    feature: np.ndarray
    cut: np.ndarray

    def down(self, x: np.ndarray) -> np.ndarray:
        at = np.ones(len(x), np.int64)
        while len(self.path):
            i = np.minimum(np.searchsorted(self.path, at), len(self.path) - 1)
            inner = np.flatnonzero(self.path[i] == at)
            if not len(inner):
                break
            at[inner] = 2 * at[inner] + (x[inner, self.feature[i[inner]]] > self.cut[i[inner]])
        return at


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _binned(cuts: Cuts, train: DataFrame, held: DataFrame | None, edges: list[np.ndarray]) -> DataFrame:
    """held, number, y and x, a byte a feature, as a table: numbers stay when a task is repeated."""

    @F.arrow_udf("binary")
    def bins(f: pa.Array) -> pa.Array:
        v = f.flatten().to_numpy(zero_copy_only=False).reshape(len(f), -1)
        x = np.column_stack([np.searchsorted(e, v[:, i], "left") for i, e in enumerate(edges)]).astype(np.uint8)
        return pa.array([r.tobytes() for r in x], pa.binary())

    rows = train.select(F.lit(False).alias("held"), "features", "y")
    rows = rows if held is None else rows.unionByName(held.select(F.lit(True).alias("held"), "features", "y"))
    return cuts.cut(rows.select("held", F.monotonically_increasing_id().alias("number"), F.col("y").cast("int").alias("y"), bins(vector_to_array("features")).alias("x")))


def _each(batches, how: How) -> Iterator[tuple]:
    for b in batches:
        yield b.column("held").to_numpy(zero_copy_only=False), b.column("number").to_numpy(), b.column("y").to_numpy().astype(np.int64), _matrix(b.column("x"), how.width)


def _splits(rows: DataFrame, how: How, tops: list[Top], wide: dict[int, np.ndarray]) -> list:
    """For each wide node the best split over all rows: gain, feature, bin, and the classes' weights on both sides."""
    sent = rows.sparkSession.sparkContext.broadcast((tops, wide))  # a node for every LOCAL_ROWS rows of a tree
    shape = (how.tried, BINS, how.classes)

    def count(batches):
        tops, wide = sent.value
        total: dict[tuple[int, int], np.ndarray] = {}
        for _, number, y, x in _each(batches, how):
            for tree, paths in wide.items():
                w, at = draws(how, tree, number), tops[tree].down(x)
                i = np.minimum(np.searchsorted(paths, at), len(paths) - 1)
                own = (paths[i] == at) & (w > 0)
                h = histogram(how, x[own], y[own], w[own], i[own], features_of(how, tree, paths))
                for p, one in zip(paths.tolist(), h, strict=True):
                    total[tree, p] = total[tree, p] + one if (tree, p) in total else one
        for (tree, p), one in total.items():
            yield pa.RecordBatch.from_pydict({"tree": pa.array([tree], pa.int32()), "path": pa.array([p], pa.int64()), "h": pa.array([one.tobytes()], pa.binary())})

    def add(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for tree, p, h in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                one = np.frombuffer(h, float).reshape(shape)
                total[tree, p] = total[tree, p] + one if (tree, p) in total else one
        for (tree, p), h in total.items():
            (gain,), (j,), (b,) = best(how, h[None])
            left, f = h[j, : b + 1].sum(0), features_of(how, tree, np.array([p]))[0, j]
            yield pa.RecordBatch.from_pylist([{"tree": tree, "path": p, "gain": gain, "feature": int(f), "cut": int(b), "lefts": left.tolist(), "rights": (h[j].sum(0) - left).tolist()}], pa.schema([("tree", pa.int32()), ("path", pa.int64()), ("gain", pa.float64()), ("feature", pa.int32()), ("cut", pa.int32()), ("lefts", pa.list_(pa.float64())), ("rights", pa.list_(pa.float64()))]))

    made = rows.where("not held").mapInArrow(count, "tree int, path long, h binary").repartition("tree", "path")
    return made.mapInArrow(add, "tree int, path long, gain double, feature int, cut int, lefts array<double>, rights array<double>").collect()


def _tops(rows: DataFrame, how: How, n: int) -> tuple[list[Top], np.ndarray, int]:
    """The trees above nodes of LOCAL_ROWS rows, the gains there by tree and feature, and how many nodes are left to grow."""
    inner: list[dict[int, tuple[int, int]]] = [{} for _ in range(how.trees)]
    gains, open_ = np.zeros((how.trees, how.width)), how.trees
    tops = [Top(*(np.zeros(0, np.int64),) * 3) for _ in inner]
    wide = {t: np.array([1]) for t in range(how.trees)} if n > LOCAL_ROWS and how.depth else {}
    while wide:
        found: dict[int, list[int]] = {}
        for r in _splits(rows, how, tops, wide):
            if r["gain"] <= LEAST_GAIN:
                continue
            inner[r["tree"]][r["path"]] = (r["feature"], r["cut"])
            gains[r["tree"], r["feature"]] += r["gain"]
            open_ += 1
            for child, side in ((2 * r["path"], r["lefts"]), (2 * r["path"] + 1, r["rights"])):
                if sum(side) > LOCAL_ROWS and max(side) < sum(side) and child.bit_length() <= how.depth:
                    found.setdefault(r["tree"], []).append(child)
        tops = [Top(np.array(sorted(d), np.int64), *(np.array([d[p][i] for p in sorted(d)], np.int64) for i in (0, 1))) for d in inner]
        wide = {t: np.array(sorted(p)) for t, p in found.items()}
    return tops, gains, open_


LEAVES = "tree int, feature int, gain double, number long, y int, class int, vote double"
SENT = "tree int, path long, held boolean, number binary, y binary, w binary, x binary"


def _grown(rows: DataFrame, how: How, tops: list[Top], nodes: int) -> DataFrame:
    """LEAVES: gains by tree and feature, and each held row's shares of classes by tree."""
    sent = rows.sparkSession.sparkContext.broadcast(tops)
    names = [c.split(" ")[0] for c in SENT.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 4]

    def deal(batches):
        for held, number, y, x in _each(batches, how):
            for tree, top in enumerate(sent.value):
                w, at = draws(how, tree, number), top.down(x)
                w[held] = 1
                own = np.flatnonzero(w)
                own = own[np.lexsort((held[own], at[own]))]
                starts = np.flatnonzero(np.diff(at[own] * 2 + held[own], prepend=-1))
                out = []
                for part in np.split(own, starts[1:]) if len(own) else []:
                    out.append((tree, int(at[part[0]]), bool(held[part[0]]), number[part].tobytes(), y[part].astype(np.int32).tobytes(), w[part].tobytes(), x[part].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def grow(group: pa.Table) -> pa.Table:
        tree, path = group["tree"][0].as_py(), group["path"][0].as_py()
        pick = lambda held, c, kind: np.frombuffer(b"".join(group.filter(group["held"] if held else pc.invert(group["held"]))[c].to_pylist()), kind)
        x, hx = (pick(h, "x", np.uint8).reshape(-1, how.width) for h in (False, True))
        y, w, number, hy = pick(False, "y", np.int32).astype(np.int64), pick(False, "w", np.uint8), pick(True, "number", np.int64), pick(True, "y", np.int32)
        gains, votes = grown(how, tree, path, x, y, w, hx)
        f, (i, c) = np.flatnonzero(gains), np.nonzero(votes)
        none = lambda k, kind: pa.nulls(k, kind)
        a = [np.full(len(f), tree, np.int32), f.astype(np.int32), gains[f], none(len(f), pa.int64()), none(len(f), pa.int32()), none(len(f), pa.int32()), none(len(f), pa.float64())]
        b = [np.full(len(i), tree, np.int32), none(len(i), pa.int32()), none(len(i), pa.float64()), number[i], hy[i], c.astype(np.int32), votes[i, c]]
        names = [x.split(" ")[0] for x in LEAVES.split(", ")]
        return pa.concat_tables([pa.table([pa.array(v) if isinstance(v, np.ndarray) else v for v in t], names) for t in (a, b)])

    # few rows stand for much work, which AQE would bring together by their bytes
    dealt = rows.mapInArrow(deal, SENT).repartition(min(nodes, 1000), "tree", "path")
    return dealt.groupBy("tree", "path").applyInArrow(grow, LEAVES)


def forest(train: DataFrame, held: DataFrame | None = None, trees: int = 100, depth: int = 30, least: int = 1, bagged: bool = True, seed: int = 42, use=None):
    """use(importances, predictions): a value a feature, of sum 1, and the held rows' y, prediction and probability (an array), while their table lasts.

    A node of a forest tries the root of the features, rounded up, and its rows are drawn with repeats; a single
    tree that is not bagged tries all.  Inputs have features and y, from 0.
    """
    with Cuts(train.sparkSession) as cuts:
        seen = train.select(F.max("y"), F.count("*"), F.max(F.size(vector_to_array("features")))).first()
        classes, n, width = int(seen[0]) + 1, seen[1], seen[2]
        columns = train.select(vector_to_array("features").alias("f")).select(*[F.col("f")[i].alias(f"f{i}") for i in range(width)])
        edges = [np.unique(e) for e in columns.approxQuantile(columns.columns, [i / BINS for i in range(1, BINS)], EDGE_ERROR)]
        how = How(trees, depth, least, int(np.ceil(np.sqrt(width))) if bagged else width, bagged, seed, width, classes)
        rows = _binned(cuts, train, held, edges)
        tops, gains, nodes = _tops(rows, how, n)
        leaves = cuts.cut(_grown(rows, how, tops, nodes))
        for r in leaves.where("feature is not null").groupBy("tree", "feature").agg(F.sum("gain").alias("gain")).collect():
            gains[r["tree"], r["feature"]] += r["gain"]
        # every tree counts the same
        share = gains / np.maximum(gains.sum(1, keepdims=True), LEAST_GAIN)
        votes = leaves.where("number is not null").groupBy("number", "y").agg(*[F.round(F.sum(F.when(F.col("class") == c, F.col("vote")).otherwise(0.0)) / trees, 9).alias(f"c{c}") for c in range(classes)])
        made = votes.select(F.col("y").cast("double").alias("y"), F.array(*[f"c{c}" for c in range(classes)]).alias("probability"))
        made = made.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))
        return use(share.sum(0) / max(share.sum(), LEAST_GAIN), made)
