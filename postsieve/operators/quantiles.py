"""Exact quantiles by rounds of counts: no task and no buffer holds all values.

A rank lies in a range of values.  Each round takes EDGES random values of every range that is still wanted,
counts all rows between them in one pass over all columns, and goes on in the part that holds the
rank, until a part is one value.  A range shrinks about EDGES times a round, and ties end it at once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window as W, functions as F

EDGES = 512


@dataclass
class _Range:
    """Values from low to high of a column, which hold the ranks."""

    column: str
    low: float
    high: float
    ranks: list[int]

    def holds(self):
        c = F.col(self.column)
        return c.between(F.lit(self.low), F.lit(self.high))


def _edges(rows: DataFrame, wanted: list[_Range]) -> dict[str, list[float]]:
    """Random values of each range, and the next larger doubles, so that the values themselves are parts."""
    each = F.array(*[F.when(r.holds(), F.struct(F.lit(i).alias("i"), F.col(r.column).alias("v"))) for i, r in enumerate(wanted)])
    values = rows.select(F.inline(F.filter(each, lambda x: x.isNotNull())))
    some = values.withColumn("at", F.row_number().over(W.partitionBy("i").orderBy(F.rand()))).where(F.col("at") <= EDGES)
    out: dict[str, set] = {}
    for r in some.select("i", "v").distinct().collect():
        out.setdefault(wanted[r["i"]].column, set()).update((r["v"] + 0.0, math.nextafter(r["v"], math.inf)))
    return {c: sorted(x for x in e if math.isfinite(x)) for c, e in out.items()}


def quantiles(rows: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """For each column its values at the shares 0 to 1 of the order, between two values in proportion; nulls do not count, NaN is the largest, none gives None."""
    rows = rows.select(*[F.col(c).cast("double").alias(c) for c in columns])
    # what is not finite has no place between values: it is counted apart
    ends = {c: [F.col(c) == -math.inf, F.col(c) == math.inf, F.isnan(c)] for c in columns}
    solid = rows.select(*[F.when(~(ends[c][0] | ends[c][1] | ends[c][2]), F.col(c)).alias(c) for c in columns])
    told = solid.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    apart = rows.agg(*[F.count_if(x) for c in columns for x in ends[c]]).first()
    found: dict[str, dict[int, float]] = {c: {} for c in columns}
    asked, wanted = {}, []
    for i, c in enumerate(columns):
        sizes = [apart[3 * i], told[f"n{i}"], apart[3 * i + 1], apart[3 * i + 2]]
        asked[c] = [p * (sum(sizes) - 1) for p in shares] if sum(sizes) else []
        inner, first = [], 0
        for size, value in zip(sizes, (-math.inf, None, math.inf, math.nan), strict=True):
            own = [k for k in sorted({k for x in asked[c] for k in (math.floor(x), math.ceil(x))}) if first <= k < first + size]
            if value is None:
                inner = own
            else:
                found[c] |= dict.fromkeys(own, value)
            first += size
        if inner:
            wanted.append(_Range(c, told[f"lo{i}"], told[f"hi{i}"], inner))
    while True:
        for r in wanted:
            if r.low == r.high:
                found[r.column] |= dict.fromkeys(r.ranks, r.low)
        wanted = [r for r in wanted if r.low != r.high]
        if not wanted:
            break
        edges = _edges(solid, wanted)
        names = sorted({r.column for r in wanted})
        parts = Bucketizer(splitsArray=[[-math.inf, *edges[c], math.inf] for c in names], inputCols=names, outputCols=[f"_part{i}" for i in range(len(names))], handleInvalid="keep").transform(solid)
        each = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_part{i}").cast("int").alias("part"), F.col(c).alias("v")) for i, c in enumerate(names)])
        counts = parts.select(F.inline(F.filter(each, lambda x: x["v"].isNotNull()))).groupBy("i", "part").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        after = []
        for i, c in enumerate(names):
            below = apart[3 * columns.index(c)]
            for r in sorted((r for r in counts if r["i"] == i), key=lambda r: r["part"]):
                ranks = [k for w in wanted if w.column == c for k in w.ranks if below <= k < below + r["n"]]
                if ranks:
                    after.append(_Range(c, r["lo"], r["hi"], ranks))
                below += r["n"]
        wanted = after
    out = {}
    for c, places in asked.items():
        known = found[c]
        pairs = [(known[math.floor(x)], known[math.ceil(x)], x - math.floor(x)) for x in places]
        out[c] = [a if a == b or not part else a + part * (b - a) for a, b, part in pairs] or [None] * len(shares)
    return out
