"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are parted by the number of their distinct shingles (parts of sizes up to twice
the smallest).  An item of n shingles that is contained to at least `least` lacks at most
m = n - ceil(least * n) of them, so a document that contains it has one of its m + 1
smallest hashes.  A part's sketches are the m + 1 smallest hashes of each of its items, m that of
the part's largest item, in a table of its own.  A document is looked up in the tables of those
parts whose smallest item it could contain, by its own size; candidates of which it holds too few
sketch hashes go, and the rest are verified by exact containment.

Items come in blocks of at most BLOCK_ITEMS and about BLOCK_BYTES of text, dealt by hash;
each block is one broadcast of that bound, all documents pass every block.

Defined cases: null and empty texts match nothing; an item or document with fewer than
five words counts as one shingle of all its words; repeated items and repeated documents
each match, row by row; rows without doc_id are documents too, items without item_id are not;
very long texts are taken whole; a containment of exactly `least` matches; empty tables give no
rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import documents_words, shingle_set

CONTAINED = 0.8
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 64 << 20


class Part:
    """Items of like size: their sketches as one sorted table of (hash, item)."""

    def __init__(self, items: list[int], sets: list[np.ndarray], need: list[int]):
        self.least = min(need[k] for k in items)
        slack = max(len(sets[k]) - need[k] for k in items)
        sketches = [sets[k][: slack + 1] for k in items]
        #: of a sketch of its length, how many hashes a document that contains the item has at least
        self.hits = {k: len(x) - (len(sets[k]) - need[k]) for k, x in zip(items, sketches, strict=True)}
        flat, own = np.concatenate(sketches), np.repeat(items, [len(x) for x in sketches])
        order = np.argsort(flat, kind="stable")
        self.hash, self.owner = flat[order], own[order]

    def candidates(self, likely: np.ndarray) -> list[int]:
        a, b = np.searchsorted(self.hash, likely, "left"), np.searchsorted(self.hash, likely, "right")
        some = np.flatnonzero(a < b)
        if not len(some):
            return []
        held = np.concatenate([self.owner[x:y] for x, y in zip(a[some], b[some], strict=True)])
        items, n = np.unique(held, return_counts=True)
        return [int(k) for k, m in zip(items, n, strict=True) if m >= self.hits[k]]


class Index:
    """The parts, and every item's whole set for verification."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], least: float):
        keep = [i for i, s in enumerate(sets) if len(s)]
        self.ids = [ids[i] for i in keep]
        self.sets = [sets[i] for i in keep]
        self.need = [math.ceil(round(least * len(s), 9)) for s in self.sets]
        sizes: dict[int, list[int]] = {}
        for k, s in enumerate(self.sets):
            sizes.setdefault(int(len(s)).bit_length(), []).append(k)
        self.parts = [Part(sizes[b], self.sets, self.need) for b in sorted(sizes)]
        self.bit = np.zeros(1 << 22, bool)
        for part in self.parts:
            self.bit[(part.hash >> np.uint64(42)).astype(np.int64)] = True

    def search(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(item, shared shingles) of the items that one document contains."""
        shingles = shingle_set(words)
        likely = shingles[self.bit[(shingles >> np.uint64(42)).astype(np.int64)]]
        if not len(likely):
            return []
        out = []
        for part in self.parts:
            if part.least > len(shingles):
                break
            for k in part.candidates(likely):
                at = np.minimum(np.searchsorted(shingles, self.sets[k]), len(shingles) - 1)
                n = int((shingles[at] == self.sets[k]).sum())
                if n >= self.need[k]:
                    out.append((k, n))
        return sorted(out)


def item_sets(items: DataFrame) -> tuple[list[int], list[np.ndarray]]:
    table = items.toArrow()
    sets: list[np.ndarray] = []
    for _, words in documents_words(table.column("text"), lower=True):
        sets += map(shingle_set, words)
    return table.column("item_id").to_pylist(), sets


def _blocks(items: DataFrame, block_items: int):
    """The items in blocks, an index of each at a time."""
    items = items.selectExpr("cast(item_id as long) item_id", "text").where("text is not null and item_id is not null")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, math.ceil(size["n"] / (block_items * 0.9)), math.ceil(size["bytes"] / BLOCK_BYTES))
    for block in range(blocks):
        yield items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items


def clean(docs: DataFrame, items: DataFrame, least: float = CONTAINED, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of docs, each with all its columns, whose own text contains no item; nothing is joined, so ids may repeat or be null."""
    text = docs.columns.index("text")
    for own in _blocks(items, block_items):
        shared = docs.sparkSession.sparkContext.broadcast(Index(*item_sets(own), least))

        def run(batches, shared=shared):
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for first, words in documents_words(batch.column(text), lower=True):
                    good[first : first + len(words)] = [not shared.value.search(w) for w in words]
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def matches(docs: DataFrame, items: DataFrame, least: float = CONTAINED, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment: a row for every item that a document contains."""
    out = None
    for own in _blocks(items, block_items):
        shared = docs.sparkSession.sparkContext.broadcast(Index(*item_sets(own), least))

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), []
                for first, words in documents_words(batch.column(1), lower=True):
                    for i, w in enumerate(words):
                        rows += [(ids[first + i], index.ids[k], n, len(index.sets[k])) for k, n in index.search(w)]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "n_shared", "n_item"])

        found = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, item_id long, n_shared long, n_item long")
        out = found if out is None else out.unionByName(found)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))
