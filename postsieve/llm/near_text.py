"""Near-duplicate texts: an LSH forest over MinHash signatures.

A text's set of five-word shingles gets a one-permutation MinHash signature: the
smallest hash in each of BINS ranges, an empty range borrowing from the next.  Each of
TREES orders is the table of all distinct sets sorted by its own choice of DEPTH
signature values.  Neighbours in an order share the longest prefixes: in every order
each set is paired with up to `near` sets before and behind it, the longest common prefix first
and down to `depth` values.  So the depth adapts to the region: where many sets share a long
prefix only those with a longer one are paired, where few do, shorter ones serve.  The row's
values must bear a pair out (`agree` of DEPTH).

The candidate pairs unite into clusters, in Spark.  A cluster that has more sets than the
reach of its neighbours is chained by it, so what two of its sets have in common need not
be a pair: each cluster is verified whole, all its sets against all, on the full sets.  That
happens in blocks of BLOCK_SETS, a task for every two blocks, which counts shared shingles
through an inverted list and returns one edge per set to the root of its local union, never
the pairs.  Blocks are ranges of set sizes, and two whose sizes exclude a link are skipped.

An audit measures the recall: the sets of AUDIT texts (smallest hashes of doc_id, of at most AUDIT_BYTES)
are compared with those of all texts, exactly, in the pass that makes the signatures.  As natural links between
different sets can be rare, each audited set also gets a planted one that is known to link with it, at
similarities from the threshold up; planted sets stand in the orders and nowhere else.  The reach widens (more
neighbours, shorter prefixes, less agreement) until at least RECALL of the audited links lie
inside one group and RECALL of the planted ones inside one cluster, at most ROUNDS times, else LowRecall is raised; what was
missed of the audited links is linked in any case.

Texts with equal sets are one node throughout; their smallest doc_id stands for them.

Defined cases: null, empty and blank texts have an empty set and link with nothing; a
text of fewer than five words counts as one shingle; rows that repeat a doc_id link by the set of
each row, and carry the smallest doc_id that this set's group has; rows without doc_id link with nothing
and have no component; very long texts are one row, whole; ties in an order go by id; empty tables give no
rows; other columns, whatever their names, are not touched.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .shared import U64, Scratch, documents_words, mix, shingle_set

BINS, TREES, DEPTH = 128, 12, 8
AUDIT, AUDIT_BYTES, RECALL, ROUNDS = 128, 1 << 18, 0.9, 6
#: Sets of a cluster that one task takes twice of at most.
BLOCK_SETS = 512
_ORDER = np.random.default_rng(5).permutation(BINS)[: TREES * DEPTH]
_EDGES = np.arange(BINS, dtype=np.uint64) << U64(57)


def signature(shingles: np.ndarray) -> np.ndarray:
    """BINS 32-bit values of a sorted, non-empty set of hashes."""
    at = np.searchsorted(shingles, _EDGES)
    after = np.append(at[1:], len(shingles))
    full = np.flatnonzero(at < after)
    value = shingles[at[full]]
    take = np.searchsorted(full, np.arange(BINS))
    wrapped = take == len(full)
    take[wrapped] = 0
    away = full[take] - np.arange(BINS) + BINS * wrapped
    return (mix(value[take] + away.astype(np.uint64) * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32)


class Reach(NamedTuple):
    """How far an order is searched for candidates."""

    near: int = 6
    depth: int = 1
    agree: int = 5

    def wider(self) -> Reach:
        return Reach(2 * self.near, 1, max(1, self.agree - 1))


class LowRecall(RuntimeError):
    """The widest reach finds too few of the known links."""


def planted(s: np.ndarray, percent: int, rng: np.random.Generator) -> np.ndarray | None:
    """A set that links with s, but is another; none where s is too small for one."""
    most = len(s) * (100 - percent) // (100 + percent)
    if most < 1:
        more = s if 100 * len(s) >= percent * (len(s) + 1) else None
        out = 0
    else:
        out = int(rng.integers(1, most + 1))
        more = np.delete(s, rng.permutation(len(s))[:out])
    return None if more is None else np.unique(np.concatenate([more, rng.integers(1, 2**63, max(1, out), dtype=np.uint64) * U64(2)]))


class Audit:
    """Some texts' sets, which of them a set links with, and a planted set for each."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], percent: int):
        self.ids, self.percent = np.array(ids, np.int64), percent
        self.size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([np.zeros(0, np.uint64), *sets])
        order = np.argsort(flat, kind="stable")
        self.hash, self.owner = flat[order], np.repeat(np.arange(len(sets)), self.size)[order]
        self.bit = np.zeros(1 << 22, bool)
        self.bit[(self.hash >> U64(42)).astype(np.int64)] = True
        rng = np.random.default_rng(3)
        self.plants = [(i, p) for i, s in zip(ids, sets, strict=True) if (p := planted(s, percent, rng)) is not None]

    def orders(self, base: int) -> list[tuple[int, int, bytes]]:
        """(id, tree, key) of the planted sets, numbered from base."""
        keys = [signature(p)[_ORDER].astype(">u4").tobytes() for _, p in self.plants]
        return [(base + i, t, k[4 * DEPTH * t : 4 * DEPTH * (t + 1)]) for i, k in enumerate(keys) for t in range(TREES)]

    def links(self, s: np.ndarray) -> list[int]:
        likely = s[self.bit[(s >> U64(42)).astype(np.int64)]]
        a, b = np.searchsorted(self.hash, likely, "left"), np.searchsorted(self.hash, likely, "right")
        many = b - a
        at = np.repeat(a - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        n = np.bincount(self.owner[at], minlength=len(self.ids))
        return self.ids[(n > 0) & (100 * n >= self.percent * (len(s) + self.size - n))].tolist()


def audit_of(docs: DataFrame, percent: int, rows: int = AUDIT) -> Audit:
    """The audit of the texts with the smallest hashes of doc_id."""
    some = docs.selectExpr("cast(doc_id as long) doc_id", "text").where("doc_id is not null and text is not null").where(F.octet_length("text") <= AUDIT_BYTES)
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows).toArrow()
    sets = [shingle_set(w) for _, words in documents_words(some.column("text"), lower=True) for w in words]
    ids = some.column("doc_id").to_pylist()
    once = [i for i in range(len(ids)) if ids.index(ids[i]) == i and len(sets[i])]
    return Audit([ids[i] for i in once], [sets[i] for i in once], percent)


_SET = "doc_id long, n_shingles long, k1 long, k2 long, keys binary, linked array<long>"


def _describe(batches, audit: Audit):
    """doc_id, n_shingles, two halves of the set's digest, the TREES keys in one binary, and audited texts it links with."""
    for batch in batches:
        n, k1, k2, keys, linked = [], [], [], [], []
        for _, words in documents_words(batch.column(1), lower=True):
            for w in words:
                s = shingle_set(w)
                n.append(len(s))
                if len(s):
                    with np.errstate(over="ignore"):
                        k1.append(int(mix(s).sum().astype(np.int64)))
                        k2.append(int(np.bitwise_xor.reduce(mix(s + U64(77))).astype(np.int64)))
                    keys.append(signature(s)[_ORDER].astype(">u4").tobytes())
                    linked.append(audit.links(s))
                else:
                    linked.append([])
                    k1.append(None)
                    k2.append(None)
                    keys.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(keys, pa.binary()), pa.array(linked, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "k1", "k2", "keys", "linked"])


def _sets(batches):
    for batch in batches:
        out = []
        for _, words in documents_words(batch.column(1), lower=True):
            out += [shingle_set(w).tobytes() for w in words]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "shingles"])


_PAIR = "a long, b long, tree int, key binary, id long"


def _pairs(tree: np.ndarray, key: np.ndarray, ids: np.ndarray, fresh: int, reach: Reach) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row i >= fresh with one of the `near` rows before it."""
    head = np.ascontiguousarray(key[:, : reach.depth])
    a, b, live = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.arange(fresh, len(ids))
    for back in range(1, reach.near + 1):
        live = live[live >= back]
        live = live[(tree[live] == tree[live - back]) & (head[live] == head[live - back]).all(1)]
        i = live[ids[live] != ids[live - back]]
        i = i[(key[i] == key[i - back]).sum(1) >= reach.agree]
        a.append(ids[i - back])
        b.append(ids[i])
    a, b = np.concatenate(a), np.concatenate(b)
    return np.minimum(a, b), np.maximum(a, b)


def _columns(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array(rows["tree"]), np.frombuffer(b"".join(rows["key"]), ">u4").reshape(-1, DEPTH), np.array(rows["id"], np.int64)


def _neighbours(batches, reach: Reach):
    """Candidate pairs of sorted rows (tree, key, id); also the partition's first and last `near` rows."""
    head, tail, near = None, None, reach.near

    def ends(rows):
        n = len(rows["id"])
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(rows["tree"], pa.int32()), pa.array(rows["key"], pa.binary()), pa.array(rows["id"], pa.int64())], ["a", "b", "tree", "key", "id"])

    for batch in batches:
        rows = batch.to_pydict()
        if not rows["id"]:
            continue
        if head is None or len(head["id"]) < near:
            head = {k: ([] if head is None else head[k]) + v[:near] for k, v in rows.items()}
        fresh = 0
        if tail is not None:
            fresh = len(tail["id"])
            rows = {k: tail[k] + v for k, v in rows.items()}
        a, b = _pairs(*_columns(rows), fresh, reach)
        tail = {k: v[-near:] for k, v in rows.items()}
        if len(a):
            n = len(a)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], ["a", "b", "tree", "key", "id"])
    if head is not None:
        yield ends(head)
        yield ends(tail)


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def unite(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the smallest index that links reach, by exact counts of shared shingles."""
    size = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    letters, code = np.unique(flat, return_inverse=True)
    order = np.argsort(code, kind="stable")
    holders, begin = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(letters)))])
    first = np.concatenate([[0], np.cumsum(size)])
    parent = list(range(len(sets)))
    for i in range(len(sets)):
        own = code[first[i] : first[i + 1]]
        many = begin[own + 1] - begin[own]
        place = np.repeat(begin[own] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
        shared = np.bincount(holders[place], minlength=len(sets))
        for j in np.flatnonzero(100 * shared[:i] >= percent * (size[i] + size[:i] - shared[:i])).tolist():
            x, y = _find(parent, i), _find(parent, j)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return [_find(parent, i) for i in range(len(sets))]


def _linked(docs: DataFrame, reps: DataFrame, orders: DataFrame, plants: tuple[int, int], percent: int, reach: Reach, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges (a, b) that unite all linked sets among the candidates within reach; also the candidates' clusters, and the pairs (plant, id) of planted sets, whose ids lie in the range plants."""
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = orders.repartitionByRange(width, "tree", "key", "id").sortWithinPartitions("tree", "key", "id").select("tree", "key", "id")
    found = scratch.cut(table.mapInArrow(lambda batches: _neighbours(batches, reach), _PAIR))
    pairs = found.where("a is not null").select("a", "b")
    # at most 2 * near rows of every partition, whatever the input
    ends = sorted({(r["tree"], bytes(r["key"]), r["id"]) for r in found.where("id is not null").select("tree", "key", "id").collect()})
    if ends:
        a, b = _pairs(*_columns(dict(zip(("tree", "key", "id"), zip(*ends, strict=True), strict=True))), 0, reach)
        if len(a):
            pairs = pairs.unionByName(spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a long, b long"))
    sown = lambda c: F.col(c).between(plants[0], plants[1] - 1)
    near = pairs.where(sown("a") != sown("b"))
    near = scratch.cut(near.select(F.when(sown("a"), F.col("a")).otherwise(F.col("b")).alias("plant"), F.when(sown("a"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct())
    clusters = components(pairs.where(~sown("a") & ~sown("b")), scratch)
    scratch.drop(found)
    sizes = clusters.join(reps.select(F.col("id").alias("node"), "n_shingles"), "node").distinct()
    members = sizes.groupBy("component").agg(F.count("*").alias("n"), F.min(F.log("n_shingles")).alias("lo"))
    members = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK_SETS).cast("int"))
    # sets of like size share a range; a range is dealt by hash into blocks of even number
    step = float(-np.log(percent / 100))
    dealt = sizes.join(members.select("component", "blocks", "lo"), "component")
    dealt = dealt.withColumn("band", F.floor((F.log("n_shingles") - F.col("lo")) / step).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    dealt = scratch.cut(dealt.select("node", "component", "blocks", "band", "block"))
    texts = docs.selectExpr("cast(doc_id as long) id", "text").join(dealt.withColumnRenamed("node", "id").select("id").distinct(), "id", "left_semi")
    sets = scratch.cut(texts.mapInArrow(_sets, "id long, shingles binary"))
    # small clusters are one task; in large ones each set goes to the tasks of its block with every block
    small = dealt.where("blocks = 1").select("node", "component", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("span"))
    both = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.named_struct(F.lit("i"), F.least(k, "block"), F.lit("j"), F.greatest(k, "block")))
    # links lie within a band or between neighbouring ones: span b joins bands b and b + 1
    spans = F.array_distinct(F.array(F.greatest(F.col("band") - 1, F.lit(0)), F.col("band")))
    large = dealt.where("blocks > 1").select("node", "component", F.explode(spans).alias("span"), both.alias("both"))
    large = large.select("node", "component", "span", F.explode("both").alias("p")).select("node", "component", "p.i", "p.j", "span")
    work = small.unionByName(large).join(sets.withColumnRenamed("id", "node"), "node")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["node", "shingles"])
        nodes = pdf["node"].to_numpy()
        root = unite([np.frombuffer(x, np.uint64) for x in pdf["shingles"]], percent)
        moved = [(int(nodes[r]), int(nodes[i])) for i, r in enumerate(root) if r != i]
        return pd.DataFrame(moved, columns=["a", "b"], dtype=np.int64)

    return scratch.cut(work.groupBy("component", "i", "j", "span").applyInPandas(verify, "a long, b long")), clusters, near


def near_duplicates(docs: DataFrame, percent: int = 80, scratch: Scratch | None = None, reach: Reach = Reach(), report: list | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: links where 100 * shared >= percent * union of the shingle sets.

    report: takes (reach, audited links, those inside one group, planted links, those found) of each round.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "near-text")
    audit = spark.sparkContext.broadcast(audit_of(docs, percent))
    all_docs = scratch.cut(docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lambda batches: _describe(batches, audit.value), _SET))
    usable = F.col("keys").isNotNull() & F.col("doc_id").isNotNull()
    full = all_docs.where(usable)
    reps = scratch.cut(full.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("id")))
    own = full.select(F.col("doc_id").alias("id"), "k1", "k2", "n_shingles", "keys").join(reps, ["k1", "k2", "n_shingles", "id"])
    own = own.groupBy("id", "k1", "k2", "n_shingles").agg(F.max("keys").alias("keys"))
    cut = [F.substring("keys", 1 + t * 4 * DEPTH, 4 * DEPTH) for t in range(TREES)]
    orders = stored = scratch.cut(own.select("id", F.posexplode(F.array(*cut)).alias("tree", "key")))
    # audited links between different sets, by the sets' ids; of equal rows one is enough
    digest = ["k1", "k2", "n_shingles"]
    ids = audit.value.ids.tolist()
    audited = full.where(F.col("doc_id").isin(ids)).select("doc_id", *digest).distinct().join(reps, digest).select(F.col("doc_id").alias("q"), F.col("id").alias("a")).distinct()
    truth = full.where(F.size("linked") > 0).select(*digest, F.explode("linked").alias("q")).distinct().join(reps, digest).select("id", "q").distinct()
    truth = scratch.cut(truth.join(audited, "q").where("a <> id").select("a", F.col("id").alias("b")).distinct())
    # planted sets have ids that no text has
    low, high = reps.agg(F.min("id"), F.max("id")).first()
    n = len(audit.value.plants)
    base = (low or 0) - n if (low or 0) >= -(2**63) + n else high + 1
    plants = (base, base + n)
    sown = spark.createDataFrame([(base + i, q) for i, (q, _) in enumerate(audit.value.plants)], "plant long, q long")
    known = scratch.cut(sown.join(audited, "q").select("plant", "a"))
    orders = orders.unionByName(spark.createDataFrame(audit.value.orders(base), "id long, tree int, key binary").select(*orders.columns))
    for left in range(ROUNDS, 0, -1):
        edges, clusters, near = _linked(docs, reps, orders, plants, percent, reach, scratch)
        united = components(edges, scratch)
        root = lambda c: united.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))  # noqa: E731, B023
        seen = truth.join(root("a"), "a", "left").join(root("b"), "b", "left")
        total, inside = seen.agg(F.count("*"), F.count_if(F.coalesce("ca", "a") == F.coalesce("cb", "b"))).first()
        # a cluster is verified whole: a planted set is found if it has a neighbour in the cluster of its own
        cluster = lambda c: clusters.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))  # noqa: E731, B023
        met = near.join(known, "plant").join(cluster("id"), "id", "left").join(cluster("a"), "a", "left")
        met = met.where(F.coalesce("cid", "id") == F.coalesce("ca", "a"))
        sought, found = known.count(), met.select("plant").distinct().count()
        if report is not None:
            report.append((reach, total, inside, sought, found))
        if inside >= RECALL * total and found >= RECALL * sought:
            break
        if left == 1:
            raise LowRecall(f"{inside} of {total} audited and {found} of {sought} planted links found at {reach}")
        reach = reach.wider()
    if inside < total:
        united = components(edges.unionByName(truth), scratch)
    scratch.drop(stored)
    out = all_docs.where(usable).select("doc_id", "n_shingles", "k1", "k2").join(reps, ["k1", "k2", "n_shingles"])
    out = out.join(united.withColumnRenamed("node", "id"), "id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    out = out.unionByName(all_docs.where(~usable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("component_id") == F.col("doc_id"))
