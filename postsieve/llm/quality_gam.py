"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins; cyclic boosting of shallow trees (at most three cuts
on one feature, one cut each way on a pair) adds to one lookup table per feature and
per chosen pair.  A score is the logistic of a sum of table entries, looked up for a
whole batch at once.  The model is fitted on at most SAMPLE_ROWS labelled rows, taken
in the order of a hash of doc_id; everything else covers all rows.

Defined cases: a null text counts as empty; an empty text is scored as the features
of no words; labels that are null are not learned from, and several labels of one
document count as their mean; of a repeated doc_id the greatest text is learned from, and
every row is scored; ties in the order of hashes go by doc_id; a very long text is a step of
its own; without labels every score is 0.5; empty tables give no rows; columns besides doc_id
and text, whatever their names, are passed through by `accepted` and else not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import steps, text_bytes, word_hashes, word_spans

#: Most labelled rows that the fit uses.
SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 150, 80, 0.15
FEATURES = (
    "log_words", "word_bytes", "upper", "digit", "mark", "symbol", "pipe", "bang", "high_bytes", "distinct_words",
    "top_word", "log_lines", "distinct_lines", "line_words", "end_symbol", "no_stop", "short_words", "long_words",
)


def _classes() -> np.ndarray:
    t = np.zeros((7, 256), np.uint8)
    t[0, 65:91] = 1
    t[1, 48:58] = 1
    t[2, [ord(c) for c in ".,;:?'\"-"]] = 1
    t[3, [ord(c) for c in "#$%&*+/<=>@\\^_`~{}[]()"]] = 1
    t[4, ord("|")] = 1
    t[5, ord("!")] = 1
    t[6, 128:] = 1
    return t


_CLASS = _classes()
_END_SYMBOL = np.zeros(256, bool)
_END_SYMBOL[[ord(c) for c in "#$%&*!|"]] = True


def features(column: pa.Array) -> np.ndarray:
    """One row of len(FEATURES) doubles per text."""
    data, bounds = text_bytes(column)
    out = np.zeros((len(bounds) - 1, len(FEATURES)))
    for first, last in steps(bounds):
        part, own = data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        size = np.diff(own)
        x = out[first:last]
        per_byte = 1 / np.maximum(size, 1)
        for k in range(7):
            total = np.concatenate([[0], np.cumsum(_CLASS[k][part], dtype=np.int64)])
            x[:, (2, 3, 4, 5, 6, 7, 8)[k]] = np.diff(total[own]) * per_byte
        starts, ends, at = word_spans(part, own)
        n = np.diff(at)
        x[:, 0] = np.log1p(n)
        one = 1 / np.maximum(n, 1)
        length = ends - starts
        for col, values in ((1, length), (14, _END_SYMBOL[part[ends - 1]] if len(ends) else length), (16, length <= 3), (17, length >= 12)):
            total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
            x[:, col] = np.diff(total[at]) * one
        hashes = word_hashes(part, starts, ends)
        line_at = np.flatnonzero(part == 10)
        cut = np.unique(np.concatenate([own[:-1], line_at + 1]))
        cut = cut[cut < len(part)]
        line_of = np.searchsorted(cut, own)
        line_hash = word_hashes(part, cut, np.append(cut[1:], len(part))) if len(cut) else np.zeros(0, np.uint64)
        lines = np.diff(line_of)
        x[:, 11] = np.log1p(lines)
        x[:, 13] = np.log1p(n / np.maximum(lines, 1))
        for i in range(last - first):
            if n[i]:
                _, count = np.unique(hashes[at[i] : at[i + 1]], return_counts=True)
                x[i, 9], x[i, 10] = len(count) * one[i], count.max() * one[i]
                x[i, 15] = np.count_nonzero(count >= 2) / len(count)
            if lines[i]:
                x[i, 12] = len(np.unique(line_hash[line_of[i] : line_of[i + 1]])) / lines[i]
    return out


class Model:
    """Cuts and tables.  `single[f]` has an entry per bin, `pair[k]` a square of coarse bins."""

    def __init__(self, base: float, cuts: list[np.ndarray], single: list[np.ndarray], pairs: list[tuple[int, int]], coarse: list[np.ndarray], pair: list[np.ndarray]):
        self.base, self.cuts, self.single, self.pairs, self.coarse, self.pair = base, cuts, single, pairs, coarse, pair

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        bins = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)]
        for f, t in enumerate(self.single):
            z += t[bins[f]]
        for (f, g), t in zip(self.pairs, self.pair, strict=True):
            z += t[self.coarse[f][bins[f]], self.coarse[g][bins[g]]]
        return 1 / (1 + np.exp(-z))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int = 4, least: float = 2.0) -> np.ndarray:
    """Values per bin of a tree with up to `leaves` leaves, cut where the gain is largest."""
    value = lambda a, b: grad[a:b].sum() / (hess[a:b].sum() + 1.0)
    parts = [(0, len(grad))]
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for a, b in parts:
            g, h = np.cumsum(grad[a:b]), np.cumsum(hess[a:b])
            gl, hl, gr, hr = g[:-1], h[:-1], g[-1] - g[:-1], h[-1] - h[:-1]
            gain = np.where((hl > least / 4) & (hr > least / 4), gl**2 / (hl + 1) + gr**2 / (hr + 1) - g[-1] ** 2 / (h[-1] + 1), 0)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), (a, b), a + 1 + int(gain.argmax()))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = value(a, b)
    return out


def _pair_tree(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut each way of a square of bins: its gain and the four leaves' values."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    best, out = 0.0, np.zeros_like(grad)
    for i in range(len(g) - 1):
        for j in range(len(g) - 1):
            gs = np.array([[g[i, j], g[i, -1] - g[i, j]], [g[-1, j] - g[i, j], g[-1, -1] - g[i, -1] - g[-1, j] + g[i, j]]])
            hs = np.array([[h[i, j], h[i, -1] - h[i, j]], [h[-1, j] - h[i, j], h[-1, -1] - h[i, -1] - h[-1, j] + h[i, j]]])
            if (gain := (gs**2 / (hs + 1)).sum()) > best:
                best, v = gain, gs / (hs + 1)
                out = np.zeros_like(grad)
                out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v[0, 0], v[0, 1], v[1, 0], v[1, 1]
    return best, out


def train(x: np.ndarray, y: np.ndarray) -> Model:
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) if n else np.zeros(0) for f in range(width)]
    single = [np.zeros(len(c) + 1) for c in cuts]
    if n == 0:
        return Model(0.0, cuts, single, [], [], [])
    rate = (y.sum() + 1) / (n + 2)
    base = float(np.log(rate / (1 - rate)))
    if y.min() == y.max():
        return Model(base, cuts, single, [], [], [])
    bins = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]
    z = np.full(n, base)

    def parts(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size)

    for _ in range(ROUNDS):
        for f in range(width):
            step = RATE * np.clip(_tree(*parts(bins[f], len(single[f]))), -4, 4)
            single[f] += step
            z += step[bins[f]]
    coarse = [np.minimum(np.arange(len(t)) * PAIR_BINS // len(t), PAIR_BINS - 1) for t in single]
    square = lambda f, g: coarse[f][bins[f]] * PAIR_BINS + coarse[g][bins[g]]
    gains = []
    for f in range(width):
        for g in range(f + 1, width):
            a, b = parts(square(f, g), PAIR_BINS**2)
            gains.append((_pair_tree(a.reshape(PAIR_BINS, -1), b.reshape(PAIR_BINS, -1))[0], f, g))
    chosen = [(f, g) for _, f, g in sorted(gains, reverse=True)[:PAIRS]]
    pair = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in chosen]
    where = [square(f, g) for f, g in chosen]
    for _ in range(PAIR_ROUNDS):
        for k in range(len(chosen)):
            a, b = parts(where[k], PAIR_BINS**2)
            step = RATE * np.clip(_pair_tree(a.reshape(PAIR_BINS, -1), b.reshape(PAIR_BINS, -1))[1], -4, 4)
            pair[k] += step
            z += step.ravel()[where[k]]
    return Model(base, cuts, single, chosen, coarse, pair)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns quality from the labelled documents whose crc32(doc_id) mod 5 is not 0."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select(F.col("doc_id").alias("key"), "y")

    def run(batches):
        for batch in batches:
            x = features(batch.column(0))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), flat], ["key", "y", "x"])

    # of a repeated doc_id one text, so that SAMPLE_ROWS bounds what is collected
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("key")).groupBy("key", "y").agg(F.max("text").alias("text")).selectExpr("text", "cast(key as long) key", "y")
    rows = rows.mapInArrow(run, "key long, y double, x array<double>").collect()
    rows.sort(key=lambda r: (r["key"], r["x"]))
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES))
    return train(x, np.array([r["y"] for r in rows]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(features(batch.column(1))))], ["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows with a score of `least` or more, with all their columns."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.score(features(batch.column(at))) >= least))

    return docs.mapInArrow(run, docs.schema)
