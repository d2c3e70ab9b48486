"""URL filters: longest matching host/path rule, else trust and distrust of the host.

Hosts are nodes; a page's links to other hosts (absolute or `//host`) are edges, each pair once.  Hosts
with pages that a rule allows are trusted seeds, weighted by those pages' share of the
host's pages.  Personalised PageRank carries trust along the edges:
r = (1 - DAMPING) * seed + DAMPING * sum of r / degree, to the fixed point.

Distrust goes against the edges (who links to blocked hosts is suspect): it is the share of
a host's walks that end blocked.  A walk ends at a host in proportion to its pages with a
verdict, or where no link leads on; else it follows one of the host's edges, where it ends in
proportion to the edge's URLs with a verdict (on crawled hosts or not), and each step counts
DAMPING.  What ends blocked is divided by all that ends, so neither the number of
hosts that link to a blocked one nor links inside a farm make it smaller.  A page that no
rule fits is blocked if its host's distrust, (1 - DAMPING) times that share, is above its
trust and above the threshold, which half of a host's own pages being blocked would reach.

Defined cases: a null url, or one without `://`, has an empty host and path, is no node
and gets `allow`; null html has no links; links of one host to itself do not count;
repeated pages count repeatedly in shares; without edges only the seeds speak.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .shared import Scratch

DAMPING, THRESHOLD = 0.85, 0.075
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Absolute links and `//host/path`.
HREF = r"""(?i)href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
#: Rounds go on until what all later ones can add is below TOLERANCE; MOST rounds reach it on any graph.
TOLERANCE = 1e-9
MOST = math.ceil(math.log(TOLERANCE * (1 - DAMPING)) / math.log(DAMPING))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]], column: str) -> Column:
    """The longest rule that fits: its text, or its verdict.  rules: (host/path, verdict)."""
    out = F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: len(r[0])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(text if column == "rule" else verdict)).otherwise(out)
    return out


def settled(grown: float, unit: float) -> bool:
    """Values only grow, and four further rounds add at most DAMPING^4 of what the last four did."""
    return grown * DAMPING**4 / (1 - DAMPING**4) <= TOLERANCE * unit


def flow(edges: DataFrame, seeds: DataFrame, scratch: Scratch) -> DataFrame:
    """host, r: personalised PageRank over (src, dst, share) from (host, seed)."""
    base = seeds.select("host", ((1 - DAMPING) * F.col("seed")).alias("seed")).where("seed > 0")
    rank = base.withColumnRenamed("seed", "r")
    kept = None
    total = before = rank.agg(F.sum("r")).first()[0] or 0.0
    for k in range(MOST):
        moved = rank.join(edges, F.col("host") == F.col("src")).select(F.col("dst").alias("host"), (DAMPING * F.col("r") * F.col("share")).alias("r"))
        rank = moved.unionByName(base.withColumnRenamed("seed", "r")).groupBy("host").agg(F.sum("r").alias("r"))
        if k % 4 == 3:
            old, kept = kept, scratch.cut(rank)
            rank = kept
            scratch.drop(*([old] if old is not None else []))
            after = rank.agg(F.sum("r")).first()[0] or 0.0
            if settled(after - before, total):
                break
            before = after
    return rank


def ends(edges: DataFrame, hosts: DataFrame, scratch: Scratch) -> DataFrame:
    """host, share: of the walks from a host that end, those that end blocked; from edges (src, dst, share, blocked, ruled) and hosts (host, allow, block)."""
    own = hosts.select("host", "block", (F.col("allow") + F.col("block")).alias("judged"))
    onward = own.withColumnRenamed("host", "src")
    step = edges.join(onward, "src").withColumn("w", (1 - F.col("judged")) * DAMPING * F.col("share"))
    step = scratch.cut(step.select("src", "dst", (F.col("w") * F.col("blocked")).alias("wb"), (F.col("w") * F.col("ruled")).alias("wr"), (F.col("w") * (1 - F.col("ruled"))).alias("w")))
    inner = edges.select(F.col("src").alias("dst")).distinct()
    # targets without edges of their own keep their values: all walks end there
    known = step.join(inner.withColumn("on", F.lit(1.0)), "dst", "left").join(own.withColumnRenamed("host", "dst"), "dst", "left")
    rest = F.when(F.col("on").isNull(), F.col("w")).otherwise(0.0)
    leaf = known.groupBy(F.col("src").alias("host")).agg(F.sum(F.col("wb") + rest * F.coalesce("block", F.lit(0.0))).alias("lb"), F.sum(F.col("wr") + rest).alias("le"))
    step = scratch.cut(step.where("w > 0").join(inner, "dst", "left_semi").select("src", "dst", "w"))
    base = own.join(inner.withColumnRenamed("dst", "host"), "host").join(leaf, "host", "left").na.fill(0.0, ["lb", "le"])
    base = scratch.cut(base.select("host", (F.col("block") + F.col("lb")).alias("b"), (F.col("judged") + F.col("le")).alias("e")))
    now, kept, before = base, None, 0.0
    for k in range(0 if step.isEmpty() else MOST):
        moved = step.join(now, F.col("dst") == F.col("host")).select(F.col("src").alias("host"), (F.col("w") * F.col("b")).alias("b"), (F.col("w") * F.col("e")).alias("e"))
        now = moved.unionByName(base).groupBy("host").agg(F.sum("b").alias("b"), F.sum("e").alias("e"))
        if k % 4 == 3:
            old, kept = kept, scratch.cut(now)
            now = kept
            scratch.drop(*([old] if old is not None else []))
            after = now.agg(F.sum(F.col("b") + F.col("e"))).first()[0]
            if settled(after - before, 1.0):
                break
            before = after
    walked = now.select("host", F.when(F.col("e") > 0, F.col("b") / F.col("e")).otherwise(0.0).alias("share"))
    return walked.unionByName(own.join(walked, "host", "left_anti").select("host", F.col("block").alias("share")))


def judge(pages: DataFrame, rules: list[tuple[str, str]], scratch: Scratch | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every row."""
    scratch = scratch or Scratch(pages.sparkSession, "host-trust")
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = seen.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules, "rule")).withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules, "verdict"))
    share = lambda v: (F.count_if(F.col("ruled") == v) / F.count("*")).alias(v)
    hosts = scratch.cut(seen.where("host <> ''").groupBy("host").agg(share("allow"), share("block")))
    out_links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(HREF), 1))).alias("link")).where("src <> ''")
    link = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    out_links = out_links.select("src", host_of(link).alias("dst"), path_of(link).alias("path")).where("dst <> '' and src <> dst").distinct()
    # the rules judge the targets too, whether crawled or not
    out_links = out_links.withColumn("ruled", rule_of(F.col("dst"), F.col("path"), rules, "verdict"))
    part = lambda c: F.count_if(c) / F.count("*")
    pairs = scratch.cut(out_links.groupBy("src", "dst").agg(part(F.col("ruled") == "block").alias("blocked"), part(F.col("ruled").isNotNull()).alias("ruled")))
    if pairs.isEmpty():
        trust = hosts.select("host", ((1 - DAMPING) * F.col("allow")).alias("trust"))
        distrust = hosts.select("host", ((1 - DAMPING) * F.col("block")).alias("distrust"))
    else:
        degree = pairs.groupBy("src").agg((1 / F.count("*")).alias("share"))
        forward = scratch.cut(pairs.join(degree, "src").select("src", "dst", "share", "blocked", "ruled"))
        trust = flow(forward, hosts.select("host", F.col("allow").alias("seed")), scratch).withColumnRenamed("r", "trust")
        distrust = ends(forward, hosts, scratch).select("host", ((1 - DAMPING) * F.col("share")).alias("distrust"))
    both = hosts.select("host").join(trust, "host", "left").join(distrust, "host", "left").na.fill(0.0, ["trust", "distrust"])
    both = scratch.cut(both)
    out = seen.join(both, "host", "left").na.fill(0.0, ["trust", "distrust"])
    # 1e-12: sums in another order must not turn a tie
    method = F.when((F.col("distrust") > F.col("trust") + 1e-12) & (F.col("distrust") >= THRESHOLD - 1e-12), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")
