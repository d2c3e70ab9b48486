"""Periodic runs of words by Lempel-Ziv blocks: every maximal stretch that repeats its first words.

A run is a stretch of at least `least` words whose smallest period q fits `times` times and which no
neighbouring word extends keeping q.  Tasks take whole texts in steps of about CHUNK_BYTES, all of a
step's texts at once:

1. Words become exact numbers and every text is closed by a symbol of its own.  Prefix doubling names
   equal factors of 1, 2, 4, ... words, renaming only those that occur twice; the last names give the
   suffix array, all of them together the longest common extension of two places, to either side,
   in as many steps as there are lengths.
2. The suffix array's LCP and its nearest smaller places give each place's longest previous factor
   (LPF) and an earlier place where it stands; following LPF from a text's start gives its blocks.
3. Main's boundary extensions: a run that meets a block's border, and ends in the next block, has a
   period below the sum of both blocks' lengths over `times` - 1, so for each border and period
   the stretch through the border is extended to both sides.
4. A run strictly inside a block has a copy inside the block's earlier place; runs lie in buckets by
   start, and blocks copy theirs from left to right.

Nothing is shuffled; a step's work is about n log n for n words, whatever repeats.

Defined cases: null and empty texts have no words and no runs; texts of any length are taken whole (one
beyond CHUNK_BYTES is a step of its own and bounds a task's memory); repeated rows, and rows that
share a doc_id, each are judged for themselves; doc_id may be null; an empty table gives no rows; of several
periods of one stretch the smallest counts; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import SPACE, split, steps, text_bytes

LEAST, TIMES = 24, 3
#: Pairs of places that are extended in one vectorised step.
STEP_PAIRS = 1 << 20
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Factors:
    """names[k][i]: a number that the factor of 2**k symbols from i shares with its equals alone, in their order."""

    def __init__(self, symbols: np.ndarray):
        order = np.argsort(symbols, kind="stable")
        sorted_ = symbols[order]
        first = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
        name = np.empty(len(symbols), np.int64)
        name[order] = np.maximum.accumulate(np.where(first, np.arange(len(symbols)), 0))
        self.names = [name]
        again = order[~(first & np.append(first[1:], True))]
        reach = 1
        # a factor that holds a closing symbol occurs once, so i + reach stays inside for all that occur again
        while len(again):
            key = name[again] * len(symbols) + name[again + reach]
            order = np.argsort(key, kind="stable")
            again, key = again[order], key[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            group = name[again]
            new_group = np.concatenate([[True], group[1:] != group[:-1]])
            place = np.arange(len(again))
            name = name.copy()
            name[again] = group + np.maximum.accumulate(np.where(first, place, 0)) - np.maximum.accumulate(np.where(new_group, place, 0))
            self.names.append(name)
            again, reach = again[~(first & np.append(first[1:], True))], reach * 2
        self.suffixes = np.empty(len(symbols), np.int64)
        self.suffixes[name] = np.arange(len(symbols))

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from a and from b on are equal; a is not b."""
        at, to = a.copy(), b.copy()
        for k in range(len(self.names) - 1, -1, -1):
            same = self.names[k][at] == self.names[k][to]
            at[same] += 1 << k
            to[same] += 1 << k
        return at - a

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols up to a and up to b, themselves included, are equal; a is before b."""
        at, to = a.copy(), b.copy()
        for k in range(len(self.names) - 1, -1, -1):
            x, y = at - (1 << k) + 1, to - (1 << k) + 1
            same = (x >= 0) & (self.names[k][x] == self.names[k][y])
            at[same] -= 1 << k
            to[same] -= 1 << k
        return a - at


def nearest_smaller(suffixes: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the suffix array the nearest one before it with a smaller suffix, and the two suffixes' LCP; where that is 0 the first is not meant."""
    to, common = np.arange(len(suffixes)) - 1, lcp.copy()
    live = np.flatnonzero(common > 0)
    while len(live):
        live = live[suffixes[to[live]] > suffixes[live]]
        # all between `by` and its own nearest are larger than it, so they may be leapt over
        by = to[live]
        common[live], to[live] = np.minimum(common[live], common[by]), to[by]
        live = live[common[live] > 0]
    return to, common


def previous_factors(f: Factors) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol the length of the longest factor from it that also starts earlier, and where."""
    sa, lcp = f.suffixes, np.zeros(len(f.suffixes), np.int64)
    alike = np.flatnonzero(f.names[0][sa[1:]] == f.names[0][sa[:-1]]) + 1
    lcp[alike] = f.ahead(sa[alike - 1], sa[alike])
    before, left = nearest_smaller(sa, lcp)
    after, right = nearest_smaller(sa[::-1], np.append(0, lcp[:0:-1]))
    after, right = len(sa) - 1 - after[::-1], right[::-1]
    longest, source = np.zeros(len(sa), np.int64), np.zeros(len(sa), np.int64)
    longest[sa] = np.maximum(left, right)
    source[sa] = sa[np.where(left >= right, before, np.minimum(after, len(sa) - 1))]
    return longest, source


def blocks(longest: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The borders of each text's blocks, its start and end included."""
    step, out = np.maximum(longest, 1).tolist(), []
    for at, end in zip(starts.tolist(), ends.tolist(), strict=True):
        borders = [at]
        while at < end:
            at += step[at]
            borders.append(at)
        out.append(np.array(borders))
    return out


def border_runs(f: Factors, borders: list[np.ndarray], least: int, times: int) -> np.ndarray:
    """Rows (start, end, period) of all runs that meet a border, by start; the smallest period of each stretch."""
    where, sizes, first, last = [], [], [], []
    for b in borders:
        length = np.diff(b, prepend=b[0], append=b[-1])
        both = length[:-1] + length[1:]
        # a run that ends in the next block is at most as long as both blocks and one period
        some = both + (both - 1) // (times - 1) > least
        where.append(b[some])
        sizes.append((both[some] - 1) // (times - 1))
        first.append(np.full(some.sum(), b[0]))
        last.append(np.full(some.sum(), b[-1]))
    where, sizes, first, last = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (where, sizes, first, last))
    total, out, begin = np.concatenate([[0], np.cumsum(sizes)]), [np.zeros((0, 3), np.int64)], 0
    while begin < len(where):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + STEP_PAIRS, "right")) - 1)
        n = sizes[begin:end]
        period = np.arange(n.sum()) - np.repeat(total[begin:end] - total[begin], n) + 1
        b, low, high = (np.repeat(x[begin:end], n) for x in (where, first, last))
        # one period before the border, and one after it
        for a, c, ok in ((b - period, b, b - period >= low), (b, b + period, b + period <= high)):
            a, c, q = a[ok], c[ok], period[ok]
            start, stop = a - f.behind(a - 1, c - 1), c + f.ahead(a, c)
            good = stop - start >= np.maximum(least, times * q)
            out.append(np.column_stack([start[good], stop[good], q[good]]))
        begin = end
    found = np.concatenate(out)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(1)])[: len(found)]
    return found[new]


def copied_runs(found: list[tuple[int, int, int]], borders: np.ndarray, source: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The runs of one text, by start: those that meet a border, and their copies strictly inside blocks."""
    runs = list(found)
    for at, end in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        if end - at < least + 2:
            continue
        origin = int(source[at])
        i = bisect_left(runs, (origin + 1,))
        while i < len(runs) and runs[i][0] + least < origin + end - at:
            start, stop, q = runs[i]
            if stop < origin + end - at:
                # a copy starts later, so it is met in its turn where the places overlap
                insort(runs, (start + at - origin, stop + at - origin, q))
            i += 1
    return runs


def text_runs(words: pa.Array, bounds: np.ndarray, least: int, times: int) -> list[list[tuple[int, int, int]]]:
    """Each text's runs (start, length, period) in words, by start and period; bounds are the texts' in words."""
    rows, n = len(bounds) - 1, np.diff(bounds)
    symbols = np.empty(len(words) + rows + 1, np.int64)
    symbols[0] = -1
    text = np.repeat(np.arange(rows), n)
    symbols[1 + np.arange(len(words)) + text] = (text << 32) + 1 + words.dictionary_encode().indices.to_numpy().astype(np.int64)
    ends = 1 + bounds[1:] + np.arange(rows)
    symbols[ends] = np.arange(rows) << 32
    starts = ends - n
    f = Factors(symbols)
    longest, source = previous_factors(f)
    borders = blocks(longest, starts, ends)
    found = border_runs(f, borders, least, times)
    at, out = np.searchsorted(found[:, 0], np.append(starts, len(symbols))), []
    for i in range(rows):
        own = copied_runs(list(map(tuple, found[at[i] : at[i + 1]].tolist())), borders[i], source, least) if at[i] < at[i + 1] else []
        out.append(sorted(((s - int(starts[i]), e - s, q) for s, e, q in own), key=lambda r: (r[0], r[2])))
    return out


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed: the words, joined by one blank, that no run holds after its first period."""
    if times < 2 or least < 1:
        raise ValueError("a run repeats its period at least twice and has a word")

    def run(batches):
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            for first, last in steps(bounds):
                part = data[bounds[first] : bounds[last]]
                words, at = split(part, bounds[first : last + 1] - bounds[first], ~SPACE[part])
                runs, kept = text_runs(words, at, least, times), np.ones(len(words), bool)
                for i, own in enumerate(runs):
                    for start, length, q in own:
                        kept[at[i] + start + q : at[i] + start + length] = False
                left = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(kept)])[at], words.filter(pa.array(kept)).cast(pa.string()))
                flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
                shape = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                sizes = np.concatenate([[0], np.cumsum([len(own) for own in runs])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array(np.diff(at).astype(np.int64)), pa.ListArray.from_arrays(sizes, shape), pc.binary_join(left, " ")], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
