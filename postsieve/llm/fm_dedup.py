"""Substring dedup with FM-indexes: words of windows that an earlier document has go.

A window is WINDOW consecutive words.  Each window is dealt by its anchor, the smallest
hash of the ANCHOR-word sequences in it, so equal windows always meet: consecutive
windows with one anchor form a region.  Regions whose anchor occurs in two documents are
dealt to shards by anchor, so all that could match a region is in one shard, and no document
has to be streamed through every shard.

A shard indexes its distinct regions, each with the smallest doc_id that has it: the suffix
array's Burrows-Wheeler transform, compressed to runs, whose heads are a wavelet matrix of
packed bits with rank counts (`Fm`).  Backward search extends each region's match to the left
while some suffix in its interval belongs to an earlier document (matching statistics);
matches of WINDOW words or more are reported as intervals.  Each region is searched for its
first document, against documents before it, and, where later documents have it too, for
those.  All intervals that are removed come from this search.

An anchor with more than HOT_ROWS distinct regions (a passage in as many different
surroundings) would fill one shard.  Its regions are cut into single windows, each its own
anchor, and only windows that two documents have go on: the same search, on shorter regions.

Joins of all regions are salted, so the copies of one region are spread over tasks.

Defined cases: null texts have no words; documents of fewer than WINDOW words lose none;
rows of one doc_id, repeated or with different texts, are not earlier than each other, and each
loses its own words; rows without a doc_id lose none and count for none; very long texts are
one row of many regions; empty tables give no rows; columns besides doc_id and text, whatever
their names, are kept where the caller asks for them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import U64, Scratch, documents_words, gram_hashes, mix

WINDOW, ANCHOR, PROBE = 50, 8, 3
#: Windows of a region at most.
REGION_WINDOWS = 64
#: Distinct regions that a shard gets on average: a suffix array of some 400,000 words.
SHARD_REGIONS = 6_000
#: From here on an anchor's distinct regions are cut into windows.
HOT_ROWS = 3_000
#: Steps that all regions of a shard take together before what remains is searched by window.
SHARED_STEPS = 250
#: Parts into which rows of one region are dealt in joins.
SALTS = 8


class Wavelet:
    """Rank queries over a sequence of small integers: a wavelet matrix of packed bits."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.bits, self.ranks, self.zeros = [], [], []
        now = symbols.astype(np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bit = ((now >> np.uint32(level)) & np.uint32(1)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(U64)
            self.bits.append(packed)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place, plus where its run begins in the last level."""
        for k in range(self.levels):
            word = at >> 6
            below = (U64(1) << (at & 63).astype(U64)) - U64(1)
            ones = self.ranks[k][word] + np.bitwise_count(self.bits[k][word] & below)
            up = (symbol >> (self.levels - 1 - k)) & 1
            at = np.where(up == 1, self.zeros[k] + ones, at - ones)
        return at


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` symbols (ties in any order)."""
    n, step = len(text), 1
    rank = text.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    while step < depth:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * np.int64(max(n, int(rank.max()) + 1) + 2) + after
        order = np.argsort(key, kind="stable")
        put = key[order]
        new = np.concatenate([[0], np.cumsum(put[1:] != put[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        step *= 2
    return order


class Fm:
    """A run-length compressed FM-index over regions (word hashes), with the smallest document of each."""

    def __init__(self, regions: list[np.ndarray], docs: np.ndarray):
        sizes = np.array([len(r) for r in regions])
        words = np.concatenate(regions)
        letters, coded = np.unique(words, return_inverse=True)
        self.sigma = len(letters) + 1
        text = np.zeros(len(words) + len(regions), np.int32)
        first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        place = np.arange(len(words)) + np.repeat(np.arange(len(regions)), sizes)
        text[place] = coded + 1
        #: the regions that are streamed through the index
        self.text, self.first, self.sizes = text, first, sizes
        order = suffix_array(text, WINDOW)
        bwt = text[order - 1]
        self.starts = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.heads = bwt[self.starts]
        self.wavelet = Wavelet(self.heads, self.sigma)
        #: where each symbol's runs begin in the wavelet's last level, and among the runs in the order of symbols
        self.base = self.wavelet.rank(np.arange(self.sigma), np.zeros(self.sigma, np.int64))
        self.runs = np.concatenate([[0], np.cumsum(np.bincount(self.heads, minlength=self.sigma))])
        lengths = np.diff(np.append(self.starts, len(bwt)))
        self.before = np.concatenate([[0], np.cumsum(lengths[np.argsort(self.heads, kind="stable")])])
        names, code = np.unique(docs, return_inverse=True)
        self.docs = code.astype(np.int32)
        owner = np.repeat(self.docs, sizes + 1)[order]
        # minima of blocks of 16 for every power of two of blocks, and inside blocks from both ends
        pad = np.append(owner, np.full(-len(owner) % 16, 2**31 - 1, np.int32)).reshape(-1, 16)
        self.inside = pad
        self.front = np.minimum.accumulate(pad, axis=1).ravel()
        self.back = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
        self.least = [pad.min(1)]
        step = 1
        while 2 * step <= len(self.least[0]):
            low = self.least[-1]
            self.least.append(np.minimum(low[:-step], low[step:]))
            step *= 2

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the suffixes begin that start with the symbol and are followed by the first `at` ones."""
        run = np.searchsorted(self.starts, at, "right") - 1
        whole = self.runs[symbol] + self.wavelet.rank(symbol, np.maximum(run, 0)) - self.base[symbol]
        part = np.where(self.heads[np.maximum(run, 0)] == symbol, at - self.starts[np.maximum(run, 0)], 0)
        return self.before[whole] + part

    def smallest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest document in each (not empty) interval of suffixes."""
        a, b = low >> 4, (high - 1) >> 4
        out = np.minimum(self.back[low], self.front[high - 1])
        one = np.flatnonzero(a == b)
        if len(one):
            at = np.arange(16)
            use = (at >= (low[one] & 15)[:, None]) & (at <= ((high[one] - 1) & 15)[:, None])
            out[one] = np.where(use, self.inside[a[one]], 2**31 - 1).min(1)
        far = np.flatnonzero(b - a > 1)
        if len(far):
            x, y = a[far] + 1, b[far]
            level = np.frexp((y - x).astype(np.float64))[1] - 1
            for k in np.unique(level):
                m = level == k
                t = self.least[k]
                out[far[m]] = np.minimum(out[far[m]], np.minimum(t[x[m]], t[y[m] - (1 << int(k))]))
        return out

    def earlier(self, region: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(search, first word, end) of matches of WINDOW words or more in documents with a code below the bound.

        All searches step together.  A region looks for a match that ends before `end`; it
        holds words at .. end-1 and its interval of suffixes.  Where a step fails at word
        f, no window that holds f .. end-1 is left, and windows behind f were inside what
        matched.  What may remain holds f and ends sooner.  So a short probe from f
        follows (PROBE words, then twice as many each time): if it fails too, all windows
        that hold it are out, which is found in a few steps and not in WINDOW.
        """
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        name = np.arange(len(region))
        end = self.sizes[region].copy()
        at = end.copy()
        goal = np.full(len(region), -1)  # the word at which the search before failed, -1 at first
        most = end.copy()  # ends of windows that may remain are at most this
        low, high = np.zeros(len(region), np.int64), np.full(len(region), len(self.text), np.int64)
        for _ in range(SHARED_STEPS):
            if not len(region):
                break
            ok, low, high = self.extend(region, bound, at, low, high)
            at = np.where(ok, at - 1, at)
            stop = ~ok
            hit = stop & (end - at >= WINDOW)
            if hit.any():
                found.append((name[hit], at[hit], end[hit]))
            # a probe that got past its goal proves nothing about longer ends: probe further
            longer = stop & (goal >= 0) & (at <= goal) & (end < most)
            fail = stop & ~longer
            length = np.where(longer, 2 * (end - goal), PROBE)
            goal = np.where(fail, at - 1, goal)
            # a window that holds word `goal` ends WINDOW - 1 words behind it at most
            most = np.where(fail, np.minimum(end - 1, goal + WINDOW), most)
            gone = fail & ((at == 0) | (most < WINDOW))
            end = np.where(stop, np.minimum(goal + length, most), end)
            at = np.where(stop, end, at)
            low, high = np.where(stop, 0, low), np.where(stop, len(self.text), high)
            if gone.any():
                keep = ~gone
                name, region, bound, end, at, low, high, goal, most = name[keep], region[keep], bound[keep], end[keep], at[keep], low[keep], high[keep], goal[keep], most[keep]
        # a few regions need very many probes: their remaining windows are searched side by side
        many = most - WINDOW + 1
        one, region, bound = np.repeat(name, many), np.repeat(region, many), np.repeat(bound, many)
        end = WINDOW + np.arange(len(one)) - np.repeat(np.cumsum(many) - many, many)
        at = end.copy()
        low, high = np.zeros(len(one), np.int64), np.full(len(one), len(self.text), np.int64)
        for _ in range(WINDOW):
            ok, low, high = self.extend(region, bound, at, low, high)
            one, region, bound, end, at, low, high = one[ok], region[ok], bound[ok], end[ok], at[ok] - 1, low[ok], high[ok]
        found.append((one, at, end))
        return tuple(np.concatenate([f[k] for f in found]) for k in range(3))

    def extend(self, region: np.ndarray, bound: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One step of backward search: whether the word before `at` can be added, and the intervals."""
        n = len(region)
        symbol = self.text[self.first[region] + np.maximum(at - 1, 0)]
        rank = self.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        lo, hi = rank[:n], rank[n:]
        ok = (at > 0) & (hi > lo)
        sub = np.flatnonzero(ok)
        if len(sub):
            ok[sub] = self.smallest(lo[sub], hi[sub]) < bound[sub]
        return ok, np.where(ok, lo, low), np.where(ok, hi, high)


def regions_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, anchor) of the maximal runs of windows that choose one anchor."""
    n = len(words) - WINDOW + 1
    if n < 1:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(U64)
    grams = gram_hashes(words, ANCHOR)
    span = WINDOW - ANCHOR + 1
    best, done = grams, 1
    while 2 * done <= span:
        best = np.minimum(best[:-done], best[done:])
        done *= 2
    if done < span:
        best = np.minimum(best[: len(best) - (span - done)], best[span - done :])
    cut = np.flatnonzero(best[1:] != best[:-1]) + 1
    first = np.concatenate([[0], cut])
    # where words repeat with a short period, one anchor goes on: such runs are parted
    long = -(-np.diff(np.append(first, n)) // REGION_WINDOWS)
    part = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
    first = np.repeat(first, long) + part * REGION_WINDOWS
    return first, np.append(first[1:], n) + WINDOW - 1, best[first]


_STEP = U64(0xD1342543DE82EF95)
_UNSTEP = U64(pow(int(_STEP), -1, 2**64))
_REGION = "doc long, copy long, pos int, size int, anchor long, content long"


def _regions(batches):
    """From (doc, copy, text): the regions of every text; `copy` tells the texts of one doc_id apart."""
    for batch in batches:
        ids, copies = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        doc, copy, pos, size, anchor, content = [], [], [], [], [], []
        for row, words in documents_words(batch.column(2), lower=False):
            for i, w in enumerate(words):
                first, end, a = regions_of(w)
                if not len(first):
                    continue
                total = np.zeros(len(w) + 1, U64)
                weight = mix(w)
                up = np.multiply.accumulate(np.full(len(w), _STEP, U64))
                np.cumsum(weight * up, out=total[1:])
                # the content's hash does not depend on where the region is
                down = np.multiply.accumulate(np.full(len(w), _UNSTEP, U64))
                h = mix((total[end] - total[first]) * down[first] + (end - first).astype(U64))
                doc.append(np.full(len(first), ids[row + i], np.int64))
                copy.append(np.full(len(first), copies[row + i], np.int64))
                pos.append(first)
                size.append(end - first)
                anchor.append(a.astype(np.int64))
                content.append(h.astype(np.int64))
        join = lambda x, t: pa.array(np.concatenate(x).astype(t) if x else np.zeros(0, t))
        yield pa.RecordBatch.from_arrays([join(doc, np.int64), join(copy, np.int64), join(pos, np.int32), join(size, np.int32), join(anchor, np.int64), join(content, np.int64)], ["doc", "copy", "pos", "size", "anchor", "content"])


def _windows(batches):
    """From (doc, copy, text, wanted): every window of the wanted regions, as a region of its own."""
    for batch in batches:
        ids, copies, wanted = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_pylist()
        for row, words in documents_words(batch.column(2), lower=False):
            at, own, hashes = [], [], []
            for i, w in enumerate(words):
                for r in wanted[row + i]:
                    h = gram_hashes(w[r["pos"] : r["pos"] + r["size"]], WINDOW).astype(np.int64)
                    hashes.append(h)
                    at.append(np.arange(r["pos"], r["pos"] + len(h), dtype=np.int32))
                    own.append(np.full(len(h), row + i))
            if hashes:
                h, own = np.concatenate(hashes), np.concatenate(own)
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(copies[own]), pa.array(np.concatenate(at)), pa.array(np.full(len(h), WINDOW, np.int32)), pa.array(h), pa.array(h)], ["doc", "copy", "pos", "size", "anchor", "content"])


def _contents(batches):
    """From (doc, text, wanted): the wanted regions' words."""
    for batch in batches:
        ids, wanted = batch.column(0).to_numpy(), batch.column(2).to_pylist()
        for row, words in documents_words(batch.column(1), lower=False):
            anchor, content, doc, later, out = [], [], [], [], []
            for i, w in enumerate(words):
                for r in wanted[row + i]:
                    anchor.append(r["anchor"])
                    content.append(r["content"])
                    doc.append(ids[row + i])
                    later.append(r["later"])
                    out.append(w[r["pos"] : r["pos"] + r["size"]].tobytes())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(content, pa.int64()), pa.array(doc, pa.int64()), pa.array(later, pa.bool_()), pa.array(out, pa.binary())], ["anchor", "content", "doc", "later", "words"])


def _search(batches):
    """One partition is one shard: matches of each region for its first document and for later ones."""
    anchor, content, docs, later, regions = [], [], [], [], []
    for batch in batches:
        anchor.append(batch.column(0).to_numpy())
        content.append(batch.column(1).to_numpy())
        docs.append(batch.column(2).to_numpy())
        later.append(batch.column(3).to_numpy(zero_copy_only=False))
        regions += [np.frombuffer(x, U64) for x in batch.column(4).to_pylist()]
    names = ["anchor", "content", "late", "first", "end"]
    if not regions:
        return
    anchor, content, docs, later = map(np.concatenate, (anchor, content, docs, later))
    # repeated rows of a document bring a region again
    once = np.unique(np.stack([anchor, content]), axis=1, return_index=True)[1]
    anchor, content, docs, later, regions = anchor[once], content[once], docs[once], later[once], [regions[i] for i in once]
    fm = Fm(regions, docs)
    more = np.flatnonzero(later)
    region = np.concatenate([np.arange(len(regions)), more])
    bound = np.concatenate([fm.docs, fm.docs[more] + 1])
    search, first, end = fm.earlier(region, bound)
    of = region[search]
    yield pa.RecordBatch.from_arrays([pa.array(anchor[of]), pa.array(content[of]), pa.array(search >= len(regions)), pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32))], names)


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))


def _matches(texts: DataFrame, regions: DataFrame, scratch: Scratch, hot_rows: int | None, shard_regions: int) -> DataFrame:
    """(doc, copy, first, end) found among these regions; those of hot anchors are cut into windows."""
    spark = texts.sparkSession
    distinct = regions.groupBy("anchor", "content").agg(F.min("doc").alias("owner"), F.max("doc").alias("last"))
    anchors = distinct.groupBy("anchor").agg(F.min("owner").alias("d0"), F.max("last").alias("d1"), F.count("*").alias("n")).where("d0 < d1")
    hot = F.lit(False) if hot_rows is None else F.col("n") > hot_rows
    part = F.pmod(F.xxhash64("content"), F.lit(SALTS)).cast("int").alias("salt")
    shared = scratch.cut(distinct.select("*", part).join(_salted(anchors.select("anchor", hot.alias("hot"))), ["anchor", "salt"]).select("anchor", "content", "owner", (F.col("last") > F.col("owner")).alias("later"), "hot"))
    salt = F.pmod(F.xxhash64("doc", "copy", "pos"), F.lit(SALTS)).cast("int").alias("salt")
    known = scratch.cut(regions.select("*", salt).join(_salted(shared), ["anchor", "content", "salt"]))
    scratch.drop(regions)
    # any one place of a region in its first document gives its words
    one = known.where("doc = owner and not hot").groupBy("anchor", "content").agg(F.min(F.struct("doc", "copy", "pos", "size", "later")).alias("x"))
    want = one.select("x.doc", "x.copy", F.struct("x.pos", "x.size", "anchor", "content", "x.later").alias("w")).groupBy("doc", "copy").agg(F.collect_list("w").alias("wanted"))
    words = texts.join(want, ["doc", "copy"]).select("doc", "text", "wanted").mapInArrow(_contents, "anchor long, content long, doc long, later boolean, words binary")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shared.where("not hot").count() // shard_regions))
    found = scratch.cut(words.repartition(shards, "anchor").mapInArrow(_search, "anchor long, content long, late boolean, first int, end int"))
    held = known.where("not hot").withColumn("late", F.col("doc") > F.col("owner"))
    out = held.join(_salted(found), ["anchor", "content", "late", "salt"]).select("doc", "copy", (F.col("pos") + F.col("first")).alias("first"), (F.col("pos") + F.col("end")).alias("end"))
    if hot_rows is not None and not shared.where("hot").isEmpty():
        want = known.where("hot").groupBy("doc", "copy").agg(F.collect_list(F.struct("pos", "size")).alias("wanted"))
        windows = scratch.cut(texts.join(want, ["doc", "copy"]).select("doc", "copy", "text", "wanted").mapInArrow(_windows, _REGION))
        out = out.unionByName(_matches(texts, windows, scratch, None, shard_regions))
    return out


def repeats(docs: DataFrame, scratch: Scratch | None = None, hot_rows: int = HOT_ROWS, shard_regions: int = SHARD_REGIONS) -> DataFrame:
    """(doc, copy, first, end): intervals of words to remove, which may overlap; copy is xxhash64 of the text."""
    scratch = scratch or Scratch(docs.sparkSession, "substrings")
    texts = docs.selectExpr("cast(doc_id as long) doc", "xxhash64(text) copy", "text").where("doc is not null")
    regions = scratch.cut(texts.mapInArrow(_regions, _REGION))
    return _matches(texts, regions, scratch, hot_rows, shard_regions)


def _kept(text: str | None, gone: list[dict] | None) -> tuple[list[bytes], int]:
    """The kept words, and how many went."""
    words = text.encode().split() if text else []
    if not gone:
        return words, 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, [p["first"] for p in gone], 1)
    np.add.at(edge, [p["end"] for p in gone], -1)
    keep = np.cumsum(edge[:-1]) == 0
    kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
    return kept, len(words) - len(kept)


def remove(docs: DataFrame, with_text: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row.

    with_text: instead all columns of docs, with text shortened where words went
    (kept words joined by one space) and as it was where none did.
    """
    scratch = scratch or Scratch(docs.sparkSession, "substrings")
    found = scratch.cut(repeats(docs, scratch))
    gone = found.groupBy("doc", "copy").agg(F.collect_set(F.struct("first", "end")).alias("gone"))
    # the row's own columns travel as one, so that their names meet no other
    own = [F.col(f"`{c}`") for c in docs.columns if c != "text"] if with_text else ["doc_id"]
    rows = docs.select(F.struct(*own).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("copy"), "text")
    joined = rows.join(gone, ["doc", "copy"], "left").select("row", "doc", "text", "gone")

    def texts(batches):
        for batch in batches:
            out = []
            for text, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                kept, n = _kept(text, parts)
                out.append(b" ".join(kept).decode() if n else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "text"])

    def digests(batches):
        for batch in batches:
            n, cut, digest = [], [], []
            for text, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                kept, removed = _kept(text, parts)
                n.append(len(kept) + removed)
                cut.append(removed)
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    if not with_text:
        return joined.mapInArrow(digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    slim = joined.mapInArrow(texts, f"row {dict(joined.dtypes)['row']}, text string")
    return slim.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
