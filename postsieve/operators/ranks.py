"""Running sums and places in a global order, without a task that holds the whole order.

Rows are parted into ranges of the order, as many as there are shuffle partitions; sums
run inside each range and over the ranges' totals.  The ranges' edges come from SAMPLE
keys (those with the smallest hashes, so they are the same in every pass); edges decide
where the work is done, never a result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SAMPLE = 4096


def range_of(rows: DataFrame, keys: list[Column]) -> Column:
    """The number of edges at or below a row's keys, found in two steps of about sqrt(edges) comparisons."""
    names = [f"k{i}" for i in range(len(keys))]
    picked = rows.select(*[k.alias(x) for k, x in zip(keys, names, strict=True)])
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = picked.orderBy(F.xxhash64(*names), *names).limit(SAMPLE).orderBy(*names).collect()
    edges = list(dict.fromkeys(tuple(sample[len(sample) * i // n]) for i in range(1, n))) if sample else []
    if not edges:
        return F.lit(0)
    literal = lambda e: F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(e, picked.schema, strict=True)])
    own = F.struct(*[k.alias(x) for k, x in zip(keys, names, strict=True)])
    width = math.ceil(math.sqrt(len(edges)))
    groups = [edges[i : i + width] for i in range(0, len(edges), width)]
    below = lambda a: F.size(F.filter(a, lambda e: e <= own))
    group = below(F.array(*[literal(g[0]) for g in groups]))
    fine = F.get(F.array(*[F.array(*map(literal, g)) for g in groups]), F.greatest(group - 1, F.lit(0)))
    return F.greatest(group - 1, F.lit(0)) * width + below(fine)


def running(rows: DataFrame, keys: list[Column], sums: dict[str, Column], within: list[str] | None = None, part: Column | None = None) -> DataFrame:
    """Rows with, for each name, the sum over the rows of the group up to this one, and under all_<name> the group's sum.

    keys: the order; rows equal in all of them are ordered arbitrarily, and when many they meet in one task.
    part: a value that never falls as the keys rise, to part by in place of sampled ranges, which take a pass over rows.
    """
    within, names = within or [], list(sums)
    cols = [*rows.columns]
    order = {f"_k{i}": k for i, k in enumerate(keys)}
    r = rows.withColumns({**order, **{f"_v_{x}": c for x, c in sums.items()}})
    r = r.withColumn("_range", range_of(r, [F.col(k) for k in order]) if part is None else part)
    totals = r.groupBy(*within, "_range").agg(*[F.sum(f"_v_{x}").alias(f"_t_{x}") for x in names])
    group = W.partitionBy(*within)
    earlier = group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(within)], *[F.coalesce(F.sum(f"_t_{x}").over(earlier), F.lit(0)).alias(f"_b_{x}") for x in names], *[F.sum(f"_t_{x}").over(group).alias(f"all_{x}") for x in names])
    upto = W.partitionBy(*within, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    r = r.withColumns({f"_s_{x}": F.sum(f"_v_{x}").over(upto) for x in names})
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(within):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return r.join(totals, same).select(*cols, *[(F.col(f"_b_{x}") + F.col(f"_s_{x}")).alias(x) for x in names], *[f"all_{x}" for x in names])
