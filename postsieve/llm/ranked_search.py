"""Ranked lexical search by a threshold-seeded join: the k best documents of every item, exactly.

Items come in blocks of at most BLOCK_ITEMS and about BLOCK_BYTES of text, dealt by hash; a block's
vocabulary is one broadcast of that bound, and all documents pass every block:

1. One pass over whole texts writes, per document, its number of terms and how often it holds each
   term of the block (an inverted list turned to the side of the documents: no list of a frequent
   term is ever gathered in one place).
2. A term's largest impact (its part of a score) and its kth largest are found over all documents and
   stored with the term.  The largest kth impact of an item's terms is a score that k documents have
   at least, so it bounds the item's kth score from below.
3. An item's terms go by falling largest impact.  The longest tail of them whose largest impacts add
   up to less than the bound is pruned: a document with no other term of the item stays below the bound.
4. Documents with a term that was not pruned are candidates; they are scored exactly with all
   of the item's terms, those below the bound go, and the k best remain, first per task, then per part
   of an item's rows, then per item.

Scores are 64-bit integers.  Terms are compared as bytes, never by hash.

Defined cases: null and empty texts have no terms, are found by no item and do not count as
documents; an item without terms, or whose terms no document has, gives no rows; every row is a document
of its own, also where texts or doc_ids repeat, and every item row is searched for itself; rows
without doc_id are documents and come last among equal scores; items without item_id are searched
and keep their null; equal scores go by ascending doc_id; very long texts are taken whole; empty tables give
no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from .shared import LOWER, Scratch, steps, text_bytes

K = 50
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 32 << 20
#: Bytes of text, and cells of pairs with terms, that one vectorised step takes.
STEP_BYTES, STEP_CELLS = 4 << 20, 4 << 20
#: Parts into which an item's (or term's) rows are dealt before they meet.
SALTS = 16
#: Bytes of terms: digits, ASCII letters and all of other characters.
TERM = np.zeros(256, bool)
TERM[0x30:0x3A] = TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True


def terms(column: pa.Array):
    """For each step: its first row, the terms of its rows as binary values, and n + 1 bounds of the rows in them."""
    data, bounds = text_bytes(column)
    for first, last in steps(bounds, STEP_BYTES):
        part, own = LOWER[data[bounds[first] : bounds[last]]], bounds[first : last + 1] - bounds[first]
        solid = TERM[part]
        before = np.zeros(len(part), bool)
        before[1:] = solid[:-1]
        before[own[:-1][own[:-1] < len(part)]] = False
        starts = np.flatnonzero(solid & ~before)
        inside = np.cumsum(solid, dtype=np.int64)
        at = np.append(inside[starts] - 1, inside[-1] if len(inside) else 0).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(part[solid])])
        yield first, words, np.searchsorted(starts, own)


class Items:
    """One block: ids, the vocabulary, and each item's distinct terms (numbers in the vocabulary) by bounds."""

    def __init__(self, table: pa.Table):
        ids = table.column("item_id").to_pylist()
        column = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
        flat, own = [], []
        for first, words, at in terms(column):
            flat.append(words)
            own.append(first + np.repeat(np.arange(len(at) - 1), np.diff(at)))
        words = pa.concat_arrays(flat).dictionary_encode() if flat else pa.array([], pa.binary()).dictionary_encode()
        self.vocabulary = words.dictionary
        rows = np.concatenate(own) if own else np.zeros(0, np.int64)
        pairs = np.unique(rows * max(1, len(self.vocabulary)) + words.indices.to_numpy().astype(np.int64))
        item, self.term = pairs // max(1, len(self.vocabulary)), pairs % max(1, len(self.vocabulary))
        some, count = np.unique(item, return_counts=True)
        self.ids = [ids[i] for i in some]
        self.bounds = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)


def forward(batches, vocabulary: pa.Array):
    """doc_id, n and, for the vocabulary's terms that a document holds, their ascending numbers and counts; rows without any term go."""
    size = max(1, len(vocabulary))
    for batch in batches:
        for first, words, at in terms(batch.column(1)):
            n = np.diff(at)
            number = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            key, tf = np.unique(row[number >= 0] * size + number[number >= 0], return_counts=True)
            bounds = np.searchsorted(key, np.arange(len(n) + 1) * size).astype(np.int32)
            out = pa.RecordBatch.from_arrays(
                [batch.column(0)[first : first + len(n)], pa.array(n, pa.int64()), pa.ListArray.from_arrays(bounds, pa.array((key % size).astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(tf.astype(np.int32)))],
                ["doc_id", "n", "terms", "tf"],
            )
            yield out.filter(pa.array(n > 0))


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


class Postings:
    """A batch of the forward table, flat: row, term and impact of each posting."""

    def __init__(self, batch: pa.RecordBatch, weight: np.ndarray, n_docs: int, total: int):
        lists, tf = batch.column("terms"), batch.column("tf").flatten().to_numpy().astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
        self.row = np.repeat(np.arange(len(lists)), np.diff(self.bounds))
        self.term = lists.flatten().to_numpy().astype(np.int64)
        m = 50 + (50 * batch.column("n").to_numpy().astype(np.int64) * n_docs) // total
        self.impact = weight[self.term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[self.row]))


def first_of(group: np.ndarray, k: int) -> np.ndarray:
    """Of ascending group numbers: whether a place is among the first k of its group."""
    start = np.searchsorted(group, group)
    return np.arange(len(group)) - start < k


def expand(counts: np.ndarray) -> np.ndarray:
    """0 .. count - 1 for each count in turn."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def spans(cost: np.ndarray, limit: int):
    """Ranges of places whose cost adds up to about `limit` at most, or of one place."""
    total, first = np.concatenate([[0], np.cumsum(cost)]), 0
    while first < len(cost):
        last = max(first + 1, int(np.searchsorted(total, total[first] + limit, "right")) - 1)
        yield first, last
        first = last


def scored(p: Postings, items: Items, needed: tuple[np.ndarray, np.ndarray], least: np.ndarray, size: int):
    """Yields (row, item, score) arrays of the candidates with scores of at least `least` of their item.

    needed: for each term, by bounds, the items in which it was not pruned.
    """
    who, at = needed
    key, count = p.row * size + p.term, np.diff(at)[p.term]
    per_row = np.add.reduceat(np.append(count, 0), p.bounds[:-1]) * (np.diff(p.bounds) > 0) if len(p.bounds) > 1 else np.zeros(0, np.int64)
    lengths = np.diff(items.bounds)
    for first, last in spans(per_row, STEP_CELLS):
        own = slice(p.bounds[first], p.bounds[last])
        found = who[np.repeat(at[p.term[own]], count[own]) + expand(count[own])]
        pairs = np.unique(np.repeat(p.row[own], count[own]) * len(lengths) + found)
        row, item = pairs // len(lengths), pairs % len(lengths)
        for a, b in spans(lengths[item], STEP_CELLS):
            r, i = row[a:b], item[a:b]
            n = lengths[i]
            want = np.repeat(r, n) * size + items.term[np.repeat(items.bounds[i], n) + expand(n)]
            where = np.minimum(np.searchsorted(key, want), len(key) - 1)
            score = np.add.reduceat(np.where(key[where] == want, p.impact[where], 0), np.cumsum(n) - n)
            good = score >= least[i]
            yield r[good], i[good], score[good]


def best_per_group(rows: DataFrame, group: str, order: list, salt, k: int) -> DataFrame:
    """The first k rows of each group; parts of a group are cut down before they meet."""
    salted = rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int"))
    part = salted.withColumn("_at", F.row_number().over(W.partitionBy(group, "_salt").orderBy(*order))).where(F.col("_at") <= k).drop("_salt", "_at")
    return part.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def seeds(table: DataFrame, weight: np.ndarray, n_docs: int, total: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each term's largest and kth largest impact over all documents (0 where it has fewer)."""
    shared = table.sparkSession.sparkContext.broadcast(weight)

    def run(batches):
        term, impact = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            p = Postings(batch, shared.value, n_docs, total)
            term, impact = np.concatenate([term, p.term]), np.concatenate([impact, p.impact])
            order = np.lexsort((-impact, term))
            order = order[first_of(term[order], k)]
            term, impact = term[order], impact[order]
        yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(impact)], ["term", "impact"])

    tops = best_per_group(table.mapInArrow(run, "term int, impact long"), "term", [F.desc("impact")], F.monotonically_increasing_id(), k)
    out = tops.groupBy("term").agg(F.max("impact").alias("most"), F.max(F.when(F.col("rank") == k, F.col("impact"))).alias("kth")).toArrow()
    most, kth = np.zeros(len(weight), np.int64), np.zeros(len(weight), np.int64)
    number = out["term"].to_numpy()
    most[number], kth[number] = out["most"].to_numpy(), out["kth"].fill_null(0).to_numpy()
    return most, kth


def prune(items: Items, most: np.ndarray, kth: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Each item's least score of interest, and the items of each term in which it is not pruned, by bounds."""
    item = np.repeat(np.arange(len(items.ids)), np.diff(items.bounds))
    least = np.maximum(np.maximum.reduceat(kth[items.term], items.bounds[:-1]), 1) if len(item) else np.ones(0, np.int64)
    order = np.lexsort((most[items.term], item))  # rising within an item: running sums are those of tails
    upto = np.cumsum(most[items.term[order]])
    upto -= (upto - most[items.term[order]])[items.bounds[item]]
    needed = upto >= least[item]
    term, who = items.term[order][needed], item[needed]
    order = np.argsort(term, kind="stable")
    return least, (who[order], np.searchsorted(term[order], np.arange(len(most) + 1)))


def _block(docs: DataFrame, items: Items, k: int, scratch: Scratch) -> DataFrame:
    context, size = docs.sparkSession.sparkContext, max(1, len(items.vocabulary))
    words = context.broadcast(items.vocabulary)
    table = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lambda batches: forward(batches, words.value), "doc_id long, n long, terms array<int>, tf array<int>")
    table = scratch.cut(table)
    corpus = table.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    n_docs, total = corpus["docs"], max(1, corpus["total"])
    held = table.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    df = np.zeros(size, np.int64)
    df[held["term"].to_numpy()] = held["count"].to_numpy()
    weight = weights(df, n_docs)
    least, needed = prune(items, *seeds(table, weight, n_docs, total, k))
    shared = context.broadcast((items, weight, least, needed))

    def run(batches):
        block, w, low, by_term = shared.value
        kept = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
        for batch in batches:
            ids = batch.column("doc_id")
            doc, none = pc.fill_null(ids, 0).to_numpy().astype(np.int64), pc.is_null(ids).to_numpy(zero_copy_only=False)
            for r, i, s in scored(Postings(batch, w, n_docs, total), block, by_term, low, size):
                kept = [np.concatenate(x) for x in zip(kept, (i, s, doc[r], none[r]), strict=True)]
                order = np.lexsort((kept[2], kept[3], -kept[1], kept[0]))
                order = order[first_of(kept[0][order], k)]
                kept = [x[order] for x in kept]
        item, score, doc, none = kept
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array([block.ids[i] for i in item], pa.int64()), pa.array(doc, mask=none), pa.array(score)], ["q", "item_id", "doc_id", "score"])

    found = table.mapInArrow(run, "q long, item_id long, doc_id long, score long")
    tops = best_per_group(found, "q", [F.desc("score"), F.asc_nulls_last("doc_id")], F.xxhash64("doc_id", "score"), k)
    return tops.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, block_items: int = BLOCK_ITEMS, scratch: Scratch | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 of every item."""
    scratch = scratch or Scratch(docs.sparkSession, "ranked-search")
    items = items.selectExpr("cast(item_id as long) item_id", "text").where("text is not null")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, math.ceil(size["n"] / (block_items * 0.9)), math.ceil(size["bytes"] / BLOCK_BYTES))
    out = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        found = _block(docs, Items(own.toArrow()), k, scratch)
        out = found if out is None else out.unionByName(found)
    return out
