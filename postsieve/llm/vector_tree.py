"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

1. Equal vectors become one row with the k + 1 smallest of their ids; of a group of copies no other id
   can be among the k nearest of any query, so this loses nothing.
2. Of each vector length a tree of centroids is fitted on a sample of at most SAMPLE_ROWS vectors and
   SAMPLE_BYTES; its leaves are cells of about SHARD_ROWS vectors, MAX_CELLS at most.  Every vector goes
   to a cell; a cell of more vectors is dealt by hash into shards.
3. One task a shard continues the tree over all its vectors, down to leaves of about LEAF_ROWS,
   and stores it as one row.
4. AUDIT_QUERIES queries are compared with all vectors.  For each true neighbour the place of its cell,
   and of its leaf, in the query's order of visits is found; visits widen until RECALL of the
   neighbours are reached, by the cheapest pair of cells and leaves a cell.
5. Every query goes through the tree with a priority queue, the node whose centroid has the largest
   inner product first, visits so many cells, and in each so many leaves.  What it finds
   is compared in double precision, component by component, so copies tie.

A shard is sent to each block of QUERY_ROWS queries that visit it.  Queries of one vector are one query.

Defined cases: rows without vec_id and vectors that are null, empty, zero or hold null or non-finite
components take no part, as queries or otherwise; vectors of unequal length do not meet; a row is a
query's own if both its vec_id and its vector are the query's, so other vectors of that vec_id may be
found, and rows that repeat a vec_id with its vector are one; two vectors of one vec_id are two queries; ties go to the smaller vec_id; where a
query has fewer than k neighbours it gets those that it visits, all where visits reach all; very
long vectors make shards of fewer rows (SHARD_BYTES); empty tables give no rows; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .shared import Scratch

NEAREST, RECALL = 20, 0.95
SAMPLE_ROWS, SAMPLE_BYTES = 32_768, 32 << 20
SHARD_ROWS, SHARD_BYTES = 8_192, 64 << 20
MAX_CELLS, LEAF_ROWS, BRANCH = 4_096, 64, 8
QUERY_ROWS, AUDIT_QUERIES = 4_096, 256
#: Rows on which one node's centroids are fitted, and rounds of the fit.
NODE_SAMPLE, ROUNDS = 2_048, 8
#: Parts into which the queries of one vector are dealt when they get their answers.
SALTS = 16
KEY = ["width", "k1", "k2"]


def means(x: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """At most k centroids by Lloyd's rounds on NODE_SAMPLE rows, and the nearest one of each row; none is empty."""
    rng = np.random.default_rng(seed)
    some = x[rng.permutation(len(x))[:NODE_SAMPLE]]
    centre = some[:k].copy()
    for _ in range(ROUNDS):
        near = (0.5 * (centre * centre).sum(1) - some @ centre.T).argmin(1)
        used = np.unique(near)
        centre = np.stack([some[near == c].mean(0) for c in used])
    near = (0.5 * (centre * centre).sum(1) - x @ centre.T).argmin(1)
    used, near = np.unique(near, return_inverse=True)
    return centre[used], near


class Tree:
    """Nodes with centroids; the children of a node lie next to each other, leaf is a leaf's number or -1."""

    def __init__(self, centre: np.ndarray, children: np.ndarray, leaf: np.ndarray):
        self.centre, self.children, self.leaf = centre, children, leaf
        self.leaves = int(leaf.max()) + 1

    @classmethod
    def fit(cls, x: np.ndarray, leaf_rows: int) -> tuple[Tree, np.ndarray]:
        """The tree and the number of each row's leaf."""
        centre, children, leaf, own = [x.mean(0)], [(0, 0)], [-1], np.zeros(len(x), np.int64)
        todo, leaves = [(0, np.arange(len(x)))], 0
        for node, rows in todo:  # grows on the way
            k = min(BRANCH, math.ceil(len(rows) / leaf_rows))
            parts, near = means(x[rows], k, node) if k > 1 else (x[:1], None)
            if len(parts) < 2:
                leaf[node], own[rows], leaves = leaves, leaves, leaves + 1
                continue
            children[node] = (len(centre), len(centre) + len(parts))
            todo += [(len(centre) + c, rows[near == c]) for c in range(len(parts))]
            centre += list(parts)
            children += [(0, 0)] * len(parts)
            leaf += [-1] * len(parts)
        return cls(np.stack(centre), np.array(children, np.int64), np.array(leaf, np.int64)), own

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by the nearest child at every node."""
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.unique(node[self.leaf[node] < 0])
            if not len(inner):
                return self.leaf[node]
            for n in inner.tolist():
                rows, (a, b) = np.flatnonzero(node == n), self.children[n]
                c = self.centre[a:b]
                node[rows] = a + (0.5 * (c * c).sum(1) - x[rows] @ c.T).argmin(1)

    def visits(self, q: np.ndarray, most: int) -> list[list[int]]:
        """For each query the first `most` leaves, best bin first."""
        out, leaf, children = [], self.leaf.tolist(), self.children.tolist()
        for worth in (-(q @ self.centre.T)).tolist():
            queue, seen = [(worth[0], 0)], []
            while queue and len(seen) < most:
                _, node = heapq.heappop(queue)
                if leaf[node] >= 0:
                    seen.append(leaf[node])
                else:
                    for c in range(*children[node]):
                        heapq.heappush(queue, (worth[c], c))
            out.append(seen)
        return out


class Shard:
    """Vectors in the order of their leaves, the ids and digests of each, and the tree."""

    COLUMNS = ("vectors", "ids", "id_bounds", "digests", "leaf_bounds", "centre", "children", "leaf")
    SCHEMA = "width int, cell int, shard int, " + ", ".join(f"{c} binary" for c in COLUMNS)

    @staticmethod
    def build(rows: pa.Table) -> pa.Table:
        # the tree must not depend on the order in which rows arrive
        rows = rows.sort_by([("k1", "ascending"), ("k2", "ascending")])
        x = matrix(rows.column("embedding"))
        tree, own = Tree.fit(x, LEAF_ROWS)
        order = np.argsort(own, kind="stable")
        lists = rows.column("ids").combine_chunks().take(pa.array(order))
        digests = np.column_stack([rows.column(c).to_numpy()[order] for c in ("k1", "k2")])
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
        parts = (x[order], lists.flatten().to_numpy(), bounds, digests, np.searchsorted(own[order], np.arange(tree.leaves + 1)), tree.centre, tree.children, tree.leaf)
        head = {c: pa.array([rows.column(c)[0].as_py()], pa.int32()) for c in ("width", "cell", "shard")}
        return pa.table(head | {c: pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for c, p in zip(Shard.COLUMNS, parts, strict=True)})

    def __init__(self, row: pa.Table):
        width = row.column("width")[0].as_py()
        get = lambda c, kind=np.int64: np.frombuffer(row.column(c)[0].as_buffer(), kind)
        self.x, self.ids, self.id_bounds = get("vectors", np.float64).reshape(-1, width), get("ids"), get("id_bounds")
        self.digests, self.leaf_bounds = get("digests").reshape(-1, 2), get("leaf_bounds")
        self.tree = Tree(get("centre", np.float64).reshape(-1, width), get("children").reshape(-1, 2), get("leaf"))


def matrix(column) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def by_width(batch: pa.RecordBatch):
    """The rows of each vector length in a batch."""
    width = batch.column("width").to_numpy()
    for w in np.unique(width).tolist():
        yield w, batch.take(pa.array(np.flatnonzero(width == w)))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, added up component by component: equal vectors give equal values wherever they lie."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def first_of(group: np.ndarray, k: int) -> np.ndarray:
    return np.arange(len(group)) - np.searchsorted(group, group) < k


def tops(scores: np.ndarray, k: int, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row and of all that are within the row's slack of them."""
    if scores.shape[1] <= k:
        return np.nonzero(np.ones(scores.shape, bool))
    kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return np.nonzero(scores >= (kth - slack)[:, None])


def usable(vectors: DataFrame) -> DataFrame:
    v = vectors.selectExpr("cast(vec_id as long) vec_id", "cast(embedding as array<double>) embedding")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda x: x != 0))
    return v.select("vec_id", "embedding", F.size("embedding").alias("width"), F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"))


def within(rows: int, bytes_: int):
    """As many rows as the bound on rows and that on bytes allow, one at least."""
    return F.greatest(F.lit(1), F.least(F.lit(rows), F.floor(F.lit(bytes_) / (8 * F.col("width")))))


class Index:
    """Vectors dealt to shards with trees; made by fit, read by audit and find."""

    def __init__(self, scratch: Scratch, k: int, trees: dict[int, Tree], dealt: DataFrame, cells: DataFrame, shards: DataFrame):
        self.scratch, self.k, self.dealt, self.cells, self.shards = scratch, k, dealt, cells, shards
        self.trees = dealt.sparkSession.sparkContext.broadcast(trees)  # MAX_CELLS leaves a width at most

    @classmethod
    def fit(cls, vectors: DataFrame, k: int, scratch: Scratch, shard_rows: int, shard_bytes: int) -> Index:
        one = usable(vectors).groupBy("vec_id", *KEY).agg(F.first("embedding").alias("embedding"))
        few = one.withColumn("at", F.row_number().over(W.partitionBy(*KEY).orderBy("vec_id"))).where(F.col("at") <= k + 1)
        reps = scratch.cut(few.groupBy(*KEY).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("embedding").alias("embedding")))
        most = within(shard_rows, shard_bytes)
        sizes = {r["width"]: r["cells"] for r in reps.groupBy("width").agg(F.count("*").alias("n")).select("width", F.ceil(F.col("n") / most).alias("cells")).collect()}
        large = [w for w, cells in sizes.items() if cells > 1]
        picked = reps.where(F.col("width").isin(large)).withColumn("at", F.row_number().over(W.partitionBy("width").orderBy(F.xxhash64("k1", "k2"), "k1", "k2"))).where(F.col("at") <= within(SAMPLE_ROWS, SAMPLE_BYTES))
        trees = {}
        for batch in picked.select("width", "embedding", "at").orderBy("width", "at").toArrow().combine_chunks().to_batches() if large else []:
            for w, own in by_width(batch):
                trees[w], _ = Tree.fit(matrix(own.column("embedding")), max(1, math.ceil(own.num_rows / min(sizes[w], MAX_CELLS))))
        shared = reps.sparkSession.sparkContext.broadcast(trees)

        def place(batches):
            for batch in batches:
                for w, own in by_width(batch):
                    tree = shared.value.get(w)
                    cell = tree.place(matrix(own.column("embedding"))) if tree else np.zeros(own.num_rows, np.int64)
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cell.astype(np.int32))], [*own.schema.names, "cell"])

        placed = scratch.cut(reps.mapInArrow(place, "width int, k1 long, k2 long, ids array<long>, embedding array<double>, cell int"))
        # a row per cell: MAX_CELLS a width at most, so this may be broadcast
        cells = scratch.cut(placed.groupBy("width", "cell").count().select("width", "cell", F.ceil(F.col("count") / most).cast("int").alias("shards")))
        dealt = scratch.cut(placed.join(F.broadcast(cells), ["width", "cell"]).withColumn("shard", F.pmod(F.xxhash64("k2"), F.col("shards").cast("long")).cast("int")).drop("shards"))
        shards = scratch.cut(dealt.groupBy("width", "cell", "shard").applyInArrow(Shard.build, Shard.SCHEMA))
        scratch.drop(reps, placed)
        return cls(scratch, k, trees, dealt, cells, shards)

    def audit(self, queries: DataFrame) -> list[tuple[int, int]]:
        """Of every true neighbour of AUDIT_QUERIES queries: its cell's place and its leaf's place in the order of visits, from 1."""
        picked = queries.orderBy(F.xxhash64("k1", "k2"), "k1", "k2").limit(AUDIT_QUERIES).toArrow().combine_chunks().to_batches()
        asked = {w: (matrix(own.column("embedding")), own.column("k1").to_numpy(), own.column("k2").to_numpy()) for b in picked for w, own in by_width(b)}
        shared, trees, k = self.dealt.sparkSession.sparkContext.broadcast(asked), self.trees, self.k

        def compare(batches):
            best: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for w, own in by_width(batch):
                    if w not in shared.value:
                        continue
                    q, k1, k2 = shared.value[w]
                    digest = [own.column(c).to_numpy() for c in ("k1", "k2", "cell", "shard")]
                    scores = q @ matrix(own.column("embedding")).T
                    scores[(k1[:, None] == digest[0]) & (k2[:, None] == digest[1])] = -np.inf  # its own vector is no find
                    r, c = tops(scores, k, np.zeros(len(q)))
                    new = [r, scores[r, c], *(d[c] for d in digest)]
                    kept = [np.concatenate(x) for x in zip(best[w], new, strict=True)] if w in best else new
                    kept = [x[np.isfinite(kept[1])] for x in kept]
                    order = np.lexsort((kept[3], kept[2], -kept[1], kept[0]))
                    order = order[first_of(kept[0][order], k)]
                    best[w] = [x[order] for x in kept]
            for w, (r, s, a, b, cell, shard) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), w, np.int32)), pa.array(cell), pa.array(shard), pa.array(r.astype(np.int32)), pa.array(s), pa.array(a), pa.array(b)], ["width", "cell", "shard", "q", "s", "k1", "k2"])

        near = self.dealt.mapInArrow(compare, "width int, cell int, shard int, q int, s double, k1 long, k2 long")
        near = near.withColumn("at", F.row_number().over(W.partitionBy("width", "q").orderBy(F.desc("s"), "k1", "k2"))).where(F.col("at") <= k)

        def places(true: pa.Table, shard: pa.Table) -> pa.Table:
            if not true.num_rows or not shard.num_rows:
                return pa.table({"cell": pa.array([], pa.int32()), "leaf": pa.array([], pa.int32())})
            w, cell, s = true.column("width")[0].as_py(), true.column("cell")[0].as_py(), Shard(shard)
            tree, q = trees.value.get(w), shared.value[w][0]
            who, code = np.unique(true.column("q").to_numpy(), return_inverse=True)
            leaves = s.tree.visits(q[who], s.tree.leaves)
            cells = tree.visits(q[who], tree.leaves) if tree else [[0]] * len(who)
            row = {d: i for i, d in enumerate(map(tuple, s.digests.tolist()))}
            at = [row[d] for d in zip(true.column("k1").to_pylist(), true.column("k2").to_pylist(), strict=True)]
            leaf = (np.searchsorted(s.leaf_bounds, at, "right") - 1).tolist()
            found = [(cells[i].index(cell) + 1, leaves[i].index(n) + 1) for i, n in zip(code.tolist(), leaf, strict=True)]
            return pa.table({"cell": pa.array([a for a, _ in found], pa.int32()), "leaf": pa.array([b for _, b in found], pa.int32())})

        key = ["width", "cell", "shard"]
        out = near.groupBy(*key).cogroup(self.shards.groupBy(*key)).applyInArrow(places, "cell int, leaf int")
        return [(r["cell"], r["leaf"]) for r in out.collect()]

    def find(self, queries: DataFrame, cells: int, leaves: int) -> DataFrame:
        """KEY of each query vector, vec_id, score and same (whether the vectors are equal): the k + 1 best found."""
        trees, k = self.trees, self.k

        def route(batches):
            for batch in batches:
                for w, own in by_width(batch):
                    tree = trees.value.get(w)
                    to = tree.visits(matrix(own.column("embedding")), cells) if tree else [[0]] * own.num_rows
                    rows = own.take(pa.array(np.repeat(np.arange(own.num_rows), [len(t) for t in to])))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([c for t in to for c in t], pa.int32())], [*rows.schema.names, "cell"])

        routed = self.scratch.cut(queries.mapInArrow(route, "width int, k1 long, k2 long, embedding array<double>, cell int"))
        loads = routed.groupBy("width", "cell").count().withColumn("blocks", F.ceil(F.col("count") / QUERY_ROWS).cast("int")).drop("count")
        loads = F.broadcast(self.scratch.cut(loads.join(self.cells, ["width", "cell"])))  # a row per cell
        asks = routed.join(loads, ["width", "cell"]).withColumn("block", F.pmod(F.xxhash64("k1"), F.col("blocks").cast("long")).cast("int"))
        asks = asks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards", "blocks")
        stored = self.shards.join(loads.drop("shards"), ["width", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

        def answer(asked: pa.Table, shard: pa.Table) -> pa.Table:
            names = [*KEY, "vec_id", "score", "same"]
            if not asked.num_rows or not shard.num_rows:
                return pa.table([pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())], names)
            s, q = Shard(shard), matrix(asked.column("embedding"))
            slack = 1e-13 * q.shape[1] * np.sqrt((q * q).sum(1)) * np.sqrt((s.x * s.x).sum(1).max())
            to = s.tree.visits(q, leaves)
            who, leaf = np.repeat(np.arange(len(q)), [len(t) for t in to]), np.array([n for t in to for n in t])
            order, found = np.argsort(leaf, kind="stable"), []
            for n, rows in zip(np.unique(leaf), np.split(who[order], np.flatnonzero(np.diff(leaf[order])) + 1), strict=True):
                a, b = s.leaf_bounds[n], s.leaf_bounds[n + 1]
                scores = q[rows] @ s.x[a:b].T
                r, c = tops(scores, k + 1, slack[rows])
                found.append((rows[r], a + c, scores[r, c]))
            who, row, rough = map(np.concatenate, zip(*found, strict=True))
            # what is rounded differently may be among the best: all near the last place are compared exactly
            order = np.lexsort((-rough, who))
            who, row, rough = who[order], row[order], rough[order]
            start = np.searchsorted(who, who)
            last = np.minimum(start + k, np.searchsorted(who, who, "right") - 1)
            good = rough >= rough[last] - slack[who]
            who, row = who[good], row[good]
            score = np.concatenate([product(q[who[a : a + 65536]], s.x[row[a : a + 65536]]) for a in range(0, len(who), 65536)])
            order = np.lexsort((s.ids[s.id_bounds[row]], -score, who))
            order = order[first_of(who[order], k + 1)]
            who, row, score = who[order], row[order], score[order]
            n = np.diff(s.id_bounds)[row]
            ids = s.ids[np.repeat(s.id_bounds[row], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            who, row, score = (np.repeat(x, n) for x in (who, row, score))
            order = np.lexsort((ids, -score, who))
            order = order[first_of(who[order], k + 1)]
            who, row, score, ids = who[order], row[order], score[order], ids[order]
            own = [asked.column(c).to_numpy()[who] for c in KEY]
            same = (own[1] == s.digests[row, 0]) & (own[2] == s.digests[row, 1])
            return pa.table([*map(pa.array, own), pa.array(ids), pa.array(score), pa.array(same)], names)

        key = ["width", "cell", "shard", "block"]
        found = asks.groupBy(*key).cogroup(stored.groupBy(*key)).applyInArrow(answer, "width int, k1 long, k2 long, vec_id long, score double, same boolean")
        found = found.withColumn("at", F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("score"), "vec_id"))).where(F.col("at") <= k + 1)
        return self.scratch.cut(found)


def widen(places: list[tuple[int, int]], least: float) -> tuple[int, int]:
    """The cheapest (cells, leaves a cell) whose visits reach `least` of the places: cells double, leaves rise until they do."""
    if not places:
        return 1, 1
    need, best, cells = math.ceil(least * len(places)), None, 1
    while best is None or cells <= max(c for c, _ in places):
        reached = sorted(n for c, n in places if c <= cells)
        if len(reached) >= need:
            best = min(best or (math.inf, 0, 0), (cells * reached[need - 1], cells, reached[need - 1]))
        cells *= 2
    return best[1:]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, least: float = RECALL, scratch: Scratch | None = None, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest that each query finds among vectors, without its own row."""
    scratch = scratch or Scratch(vectors.sparkSession, "vector-tree")
    index = Index.fit(vectors, k, scratch, shard_rows, shard_bytes)
    asked = usable(queries)
    distinct = scratch.cut(asked.groupBy(*KEY).agg(F.first("embedding").alias("embedding")))
    found = index.find(distinct, *widen(index.audit(distinct), least))
    lists = found.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("at", "vec_id", "score", "same"))).alias("best"))
    lists = lists.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    rows = asked.select(F.col("vec_id").alias("query_id"), *KEY).distinct().withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int"))
    others = F.slice(F.filter("best", lambda x: ~(x["same"] & (x["vec_id"] == F.col("query_id")))), 1, k)
    out = rows.join(lists, [*KEY, "salt"]).select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
