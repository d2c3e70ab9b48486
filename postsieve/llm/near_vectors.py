"""Near-duplicate vectors: a hierarchical navigable small-world graph per shard.

Vectors of one label and length are dealt into shards of about SHARD_ROWS rows, and SHARD_BYTES, by a
hash.  One task builds a shard's graph (layers of a skip-list kind, each a graph of
near neighbours, searched greedily from the top) and stores it as one row.  Every block
of QUERY_SHARDS shards' vectors then queries every shard of its label by beam search.  Audits set
the beam: AUDIT rows of a block are compared with the whole shard, and where fewer than EVIDENCE of them
have links, as many vectors of the shard are turned to a known cosine above the threshold and
searched for; the beam doubles until the search finds every link of the first and all of the others.
So an audit compares a fixed number of rows, whatever the data.  A beam that is full of links is
doubled for its query until it is not; a beam as wide as the shard (24 rows or fewer at the start) is a
comparison with all of it.  Links are verified by cosine in double precision.

Tasks return per vector the number of links and one edge to the root of a local union,
never the pairs; the edges are united in Spark.  Equal vectors are one node with a
multiplicity, so copies are never expanded, and joins of all rows are salted.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components,
and those without a label or id, link with nothing and keep their own id; vectors of unequal
length do not link; rows that repeat a vec_id with the same vector are one vector and give equal
rows, with different vectors each gives its own row, with that vector's links; ties need no order, as
every link counts; very long vectors make shards of fewer rows (SHARD_BYTES); an empty table gives no
rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .components import components
from .shared import Scratch

SHARD_ROWS, SHARD_BYTES = 20_000, 64 << 20
LINKS, BEAM, AUDIT = 12, 24, 256
#: Shards whose vectors query another shard in one task.
QUERY_SHARDS = 4
#: Parts into which copies of one vector are dealt in joins.
SALTS = 8
#: Links that an audit must have looked for, at least one a row: where none of 100 is missed, the share missed is below 3 per cent (at 95 per cent).
EVIDENCE = 100
#: Single precision finds, double precision decides.
SLACK = 1e-4


class Graph:
    """Layers of neighbour lists over unit vectors; row 0 of each layer's members is where it is entered."""

    def __init__(self, vectors: np.ndarray, members: list[np.ndarray], near: list[np.ndarray]):
        self.x, self.members, self.near = vectors, members, near

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 1) -> "Graph":
        n = len(vectors)
        level = np.minimum(np.random.default_rng(seed).geometric(1 - 1 / LINKS, n) - 1, 6)
        order = np.argsort(-level, kind="stable")
        g = cls(vectors, [], [])
        for layer in range(int(level.max()), -1, -1):
            rows = order[: int((level >= layer).sum())]
            # a layer is a graph over all n rows, of which only its members have neighbours
            near = np.full((n, 2 * LINKS), -1, np.int32)
            g.members.insert(0, rows)
            g.near.insert(0, near)
            g._fill(rows, near)
        return g

    def _fill(self, rows: np.ndarray, near: np.ndarray) -> None:
        first = rows[: min(len(rows), 128)]
        sims = self.x[first] @ self.x[first].T
        np.fill_diagonal(sims, -2)
        k = min(2 * LINKS, len(first) - 1)
        if k > 0:
            near[first, :k] = first[np.argsort(-sims, axis=1)[:, :k]]
        done = len(first)
        while done < len(rows):
            part = rows[done : done + min(done, 1024)]
            ids, sims = self.search(self.x[part], 2 * LINKS, done_rows=rows[:done], bottom=0)
            # vectors that come together may be each other's nearest
            own = self.x[part] @ self.x[part].T
            np.fill_diagonal(own, -2)
            k = min(LINKS, len(part) - 1)
            if k > 0:
                top = np.argpartition(-own, k - 1, axis=1)[:, :k]
                ids, sims = np.hstack([ids, part[top]]), np.hstack([sims, np.take_along_axis(own, top, 1)])
            top = np.argsort(-sims, axis=1, kind="stable")[:, :LINKS]
            ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
            ids[sims <= -2] = -1
            near[part, : ids.shape[1]] = ids
            self._back(near, np.repeat(part, ids.shape[1]), ids.ravel())
            done += len(part)

    def _back(self, near: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
        """Adds source to the lists of target; a full list keeps the nearest."""
        ok = target >= 0
        source, target = source[ok], target[ok]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        who, at, count = np.unique(target, return_index=True, return_counts=True)
        width = near.shape[1]
        add = np.full((len(who), int(count.max()) if len(count) else 0), -1, np.int32)
        add[np.repeat(np.arange(len(who)), count), np.arange(len(source)) - np.repeat(at, count)] = source
        for a in range(0, len(who), 256):
            w = who[a : a + 256]
            both = np.sort(np.hstack([near[w], add[a : a + 256]]), axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            sims = np.einsum("qd,qcd->qc", self.x[w], self.x[both])
            sims[both < 0] = -3
            top = np.argsort(-sims, axis=1, kind="stable")[:, :width]
            near[w] = np.take_along_axis(both, top, 1)

    def search(self, q: np.ndarray, beam: int, done_rows: np.ndarray | None = None, bottom: int = 0, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` best rows found for each query (-1 and -2 where there are fewer), unordered."""
        out = []
        for a in range(0, len(q), 256):
            part = q[a : a + 256]
            entry = np.full((len(part), 1), self.members[-1][0])
            for layer in range(len(self.near) - 1, bottom, -1):
                entry = self._beam(part, entry, 4, self.near[layer])[0]
            if done_rows is not None:
                entry = np.hstack([entry, np.full((len(part), 1), done_rows[0])])
            if own is not None:
                entry = np.hstack([entry, own[a : a + 256, None]])
            out.append(self._beam(part, entry, max(beam, entry.shape[1]), self.near[bottom]))
        ids = np.concatenate([x for x, _ in out]) if out else np.zeros((0, beam), np.int64)
        sims = np.concatenate([x for _, x in out]) if out else np.zeros((0, beam), np.float32)
        return ids, sims

    def _beam(self, q: np.ndarray, entry: np.ndarray, beam: int, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(q)
        seen = np.zeros((n, len(self.x)), bool)
        entry = np.sort(entry, axis=1)
        twice = np.zeros(entry.shape, bool)
        twice[:, 1:] = entry[:, 1:] == entry[:, :-1]
        twice |= entry < 0
        sims = np.einsum("qd,qcd->qc", q, self.x[entry])
        sims[twice] = -2
        ids = np.where(twice, -1, entry)
        r, c = (ids >= 0).nonzero()
        seen[r, ids[r, c]] = True
        pad = max(0, beam - ids.shape[1])
        ids, sims = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1), np.pad(sims, ((0, 0), (0, pad)), constant_values=-2)
        fresh = ids >= 0
        live = np.arange(n)
        while len(live):
            score = np.where(fresh[live], sims[live], -4)
            k = min(4, score.shape[1])
            pick = np.argpartition(-score, k - 1, axis=1)[:, :k]
            value = np.take_along_axis(score, pick, 1)
            some = value.max(1) > -2
            live, pick, value = live[some], pick[some], value[some]
            if not len(live):
                break
            fresh[live[:, None], pick] = False
            node = np.where(value > -2, np.take_along_axis(ids[live], pick, 1), -1)
            more = np.where(node[:, :, None] >= 0, near[node], -1).reshape(len(live), -1)
            more.sort(axis=1)
            more[:, 1:][more[:, 1:] == more[:, :-1]] = -1
            new = (more >= 0) & ~seen[live[:, None], more]
            r, c = new.nonzero()
            seen[live[r], more[r, c]] = True
            s = np.where(new, np.einsum("qd,qcd->qc", q[live], self.x[more]), -2).astype(np.float32)
            all_ids, all_sims = np.hstack([ids[live], np.where(new, more, -1)]), np.hstack([sims[live], s])
            all_fresh = np.hstack([fresh[live], new])
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam] if all_sims.shape[1] > beam else np.broadcast_to(np.arange(beam), (len(live), beam))
            ids[live], sims[live], fresh[live] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, all_fresh))
        return ids, sims

    def dump(self) -> bytes:
        parts = [np.array([len(self.members), *self.x.shape], np.int64).tobytes()]
        parts += [np.int64(len(m)).tobytes() + m.astype(np.int32).tobytes() + near[m].tobytes() for m, near in zip(self.members, self.near, strict=True)]
        return b"".join(parts)

    @classmethod
    def load(cls, raw: bytes, vectors: np.ndarray) -> "Graph":
        layers, n, _ = np.frombuffer(raw, np.int64, 3)
        at, members, near = 24, [], []
        for _ in range(layers):
            m = int(np.frombuffer(raw, np.int64, 1, at)[0])
            rows = np.frombuffer(raw, np.int32, m, at + 8)
            lists = np.full((n, 2 * LINKS), -1, np.int32)
            lists[rows] = np.frombuffer(raw, np.int32, m * 2 * LINKS, at + 8 + 4 * m).reshape(m, -1)
            at += 8 + 4 * m + 4 * m * 2 * LINKS
            members.append(rows)
            near.append(lists)
        return cls(vectors, members, near)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def turned(x: np.ndarray, least: float, rng: np.random.Generator) -> np.ndarray:
    """Unit vectors, each turned in a random direction to a cosine between `least` and 1 with itself."""
    if x.shape[1] < 2:
        return x
    aside = rng.normal(size=x.shape)
    aside -= (aside * x).sum(1, keepdims=True) * x
    aside /= np.sqrt((aside * aside).sum(1, keepdims=True))
    cosine = rng.uniform(min(1.0, least + 1e-6), 1, (len(x), 1))
    return cosine * x + np.sqrt(1 - cosine * cosine) * aside


def compared(q: np.ndarray, rows: np.ndarray, graph: Graph, exact: np.ndarray, ids: np.ndarray, q_ids: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """All links of these rows of q by brute force."""
    r, c = np.nonzero(q[rows].astype(np.float32) @ graph.x.T >= least - SLACK)
    ok = (np.einsum("nd,nd->n", q[rows[r]], exact[c]) >= least) & (q_ids[rows[r]] != ids[c])
    return rows[r[ok]], c[ok]


def links(graph: Graph, exact: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, least: float):
    """Yields (query row, shard row) arrays of all pairs with cosine >= least found by widening beams; ids are sorted."""
    n, size = len(q), len(exact)
    q32 = q.astype(np.float32)
    own = np.minimum(np.searchsorted(ids, q_ids), size - 1)
    own = np.where(ids[own] == q_ids, own, -1)

    def exact_pairs(rows):
        return compared(q, rows, graph, exact, ids, q_ids, least)

    def verify(rows, found):
        r, c = np.nonzero(found >= 0)
        a, b = rows[r], found[r, c]
        ok = np.einsum("nd,nd->n", q[a], exact[b]) >= least
        ok &= q_ids[a] != ids[b]
        return a[ok], b[ok]

    rng = np.random.default_rng(1)
    truth_a, truth_b = exact_pairs(np.sort(rng.permutation(n)[:AUDIT]))
    test, code = np.unique(truth_a, return_inverse=True)
    sought = rng.permutation(size)[: EVIDENCE if len(test) < EVIDENCE else 0]
    turned_ = turned(exact[sought], least, rng).astype(np.float32)
    beam = min(BEAM, size)
    while beam < size:
        good = True
        if len(test):
            found, sims = graph.search(q32[test], beam, own=own[test])
            hit = np.zeros((len(test), size), bool)
            r, c = np.nonzero(sims >= least - SLACK)
            hit[r, found[r, c]] = True
            # a query whose beam is full of links gets a wider one below in any case
            good = hit[code, truth_b][~(sims >= least - SLACK).all(1)[code]].all()
        if good and len(sought):
            found, sims = graph.search(turned_, beam)
            good = ((found == sought[:, None]).any(1) | (sims >= least - SLACK).all(1)).all()
        if good:
            break
        beam = min(2 * beam, size)
    todo = np.arange(n)
    while len(todo) and beam < size:
        found, sims = graph.search(q32[todo], beam, own=own[todo])
        near = sims >= least - SLACK
        full = near.all(1)
        yield verify(todo[~full], np.where(near[~full], found[~full], -1))
        todo, beam = todo[full], min(2 * beam, size)
    for a in range(0, len(todo), 256):
        yield exact_pairs(todo[a : a + 256])


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives linked nodes one root, the smaller one; parent holds every node's root before and after."""
    while len(a):
        x, y = parent[a], parent[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        up = parent[parent]
        while (up != parent).any():
            parent[:] = up
            up = parent[parent]


def near_vectors(vectors: DataFrame, least: float = 0.8, scratch: Scratch | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    scratch = scratch or Scratch(vectors.sparkSession, "near-vectors")
    v = vectors.selectExpr("cast(vec_id as long) vec_id", "embedding", "label")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    v = v.withColumn("ok", F.coalesce(usable & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False)))
    # two hashes name a vector: joins need not carry it
    v = v.select("vec_id", "label", "embedding", "ok", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"))
    good = v.where("ok")
    reps = good.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("least_id"), F.count_distinct("vec_id").alias("copies"), F.first("embedding").alias("embedding"))
    # vectors may share a vec_id, so each has a number of its own, which the table fixes
    reps = scratch.cut(reps.withColumn("id", F.monotonically_increasing_id()).withColumn("width", F.size("embedding")))
    most = F.greatest(F.lit(1), F.least(F.lit(shard_rows), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("width")))))
    sizes = reps.groupBy("label", "width").agg(F.count("*").alias("n")).select("label", "width", F.ceil(F.col("n") / most).cast("int").alias("shards"))
    dealt = reps.join(sizes, ["label", "width"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards").cast("long")).cast("int"))
    dealt = scratch.cut(dealt.select("label", "width", "shard", "shards", "id", "copies", "embedding"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = unit(np.stack(pdf["embedding"]))
        g = Graph.build(x.astype(np.float32))
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "width": [int(pdf["width"].iloc[0])], "shard": [int(pdf["shard"].iloc[0])], "shards": [int(pdf["shards"].iloc[0])], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "copies": [pdf["copies"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()], "graph": [g.dump()]})

    kind = dict(vectors.dtypes)["label"]
    graphs = scratch.cut(dealt.groupBy("label", "width", "shard").applyInPandas(build, f"label {kind}, width int, shard int, shards int, ids binary, copies binary, vectors binary, graph binary"))

    def query(pdf: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        s = shard.iloc[0]
        ids, copies = np.frombuffer(s["ids"], np.int64), np.frombuffer(s["copies"], np.int64)
        exact = np.frombuffer(s["vectors"], np.float64).reshape(len(ids), -1)
        g = Graph.load(s["graph"], exact.astype(np.float32))
        pdf = pdf.sort_values("id")
        q, q_ids = unit(np.stack(pdf["embedding"])), pdf["id"].to_numpy(np.int64)
        count = np.zeros(len(q), np.int64)
        nodes, code = np.unique(np.concatenate([q_ids, ids]), return_inverse=True)
        parent = np.arange(len(nodes))
        for a, b in links(g, exact, ids, q, q_ids, least):
            np.add.at(count, a, copies[b])
            unite(parent, code[a], code[len(q) + b])
        joined = np.flatnonzero(parent != np.arange(len(nodes)))
        return pd.DataFrame({"id": np.concatenate([q_ids, nodes[joined]]), "n": np.concatenate([count, np.zeros(len(joined), np.int64)]), "root": np.concatenate([q_ids, nodes[parent[joined]]])})

    block = F.floor(F.col("shard") / QUERY_SHARDS).cast("int")
    blocks = dealt.select("label", "width", block.alias("block"), "id", "embedding", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    # a shard is sent once for every QUERY_SHARDS shards that query it
    stored = graphs.select("label", "width", "shard", "ids", "copies", "vectors", "graph", F.explode(F.sequence(F.lit(0), F.floor((F.col("shards") - 1) / QUERY_SHARDS).cast("int"))).alias("block"))
    key = ["label", "width", "shard", "block"]
    found = blocks.groupBy(*key).cogroup(stored.groupBy(*key)).applyInPandas(query, "id long, n long, root long")
    found = scratch.cut(found)
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    united = components(found.where("root <> id").select(F.col("root").alias("a"), F.col("id").alias("b")), scratch)
    known = reps.select("label", "k1", "k2", "id", "least_id", "copies").join(counts, "id").join(united.withColumnRenamed("node", "id"), "id", "left")
    known = scratch.cut(known.withColumn("group", F.coalesce("component", "id")))
    # the smallest vec_id of a group names it
    names = known.groupBy("group").agg(F.min("least_id").alias("component_id"))
    known = known.join(names, "group").select("label", "k1", "k2", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")
    known = scratch.cut(known).withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    linked = good.select("vec_id", "label", "k1", "k2", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt")).join(known, ["label", "k1", "k2", "salt"])
    alone = v.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("component_id") == F.col("vec_id"))
