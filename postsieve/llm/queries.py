"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat_collapse, decontaminate, fm_dedup, host_trust, lang_spans, licences, near_text, near_vectors, periodic_runs, prefix_bpe, quality_gam, ranked_search, vector_tree
from .shared import table

URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
ACCEPT = 0.3


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op2_near_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.near_duplicates(table(spark, sf_dir, "documents"), 85)


def op3_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_trust.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_gam.score(docs, quality_gam.fit(docs, table(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def op5_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.remove(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_item", F.round("containment", 9).alias("containment"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op8_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return prefix_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op9_lang_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return lang_spans.label(docs, lang_spans.fit(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_collapse.render(table(spark, sf_dir, "conversations"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def planted(docs: DataFrame) -> DataFrame:
    """The documents, of which those whose crc32 of doc_id ends in 0 repeat themselves from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(w):
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        own = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(own, " ")).otherwise("")

    # an array of one element names the words, so they are found once
    words = F.array(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")))
    return docs.select("doc_id", F.when(h % 10 == 0, F.transform(words, repeated)[0]).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(planted(table(spark, sf_dir, "documents")))
    # a run is better if length / period is greater, compared without rounding; earlier runs win ties
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_vector_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vector_tree.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_near_vectors, op2_near_text, op3_host_trust, op4_quality_gam, op5_fm_dedup, op6_decontaminate, op7_licences, op8_prefix_bpe, op9_lang_spans, op10_chat_collapse, op11_ranked_search, op12_periodic_runs, op13_vector_tree]
    return {f.__name__: f for f in own}


_WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHINGLES = "unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)"


def _reach(nodes: str, key: str) -> str:
    return f"""reach(n, r) AS (
        SELECT {key}, {key} FROM {nodes}
        UNION SELECT reach.n, l.b FROM reach JOIN links l ON l.a = reach.r
    ), comp AS (SELECT n, min(r) AS c FROM reach GROUP BY n)"""


OP1_SQL = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
    WHERE list_cosine_similarity(x.e, y.e) >= 0.93::DOUBLE
), {_reach("embeddings", "vec_id")}
SELECT e.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, comp.c AS component_id, comp.c = e.vec_id AS kept
FROM embeddings e JOIN comp ON comp.n = e.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = e.vec_id
"""

OP2_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(t=_LOWERED)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, {_SHINGLES} AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
one AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
links AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one), {_reach("documents", "doc_id")}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, comp.c AS component_id, comp.c = d.doc_id AS kept
FROM documents d JOIN comp ON comp.n = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def _op3_sql() -> str:
    host = lambda u: f"coalesce(translate(regexp_extract({u}, '://([^/?#]*)', 1), '{host_trust._UPPER}', '{host_trust._LOWER}'), '')"
    cases = {"rule": "", "verdict": ""}
    for text, verdict in sorted(URL_RULES, key=lambda r: -len(r[0])):
        own, _, rest = text.partition("/")
        fits = f"(host = '{own}' OR host LIKE '%.{own}') AND starts_with(path, '/{rest}')"
        cases["rule"] += f" WHEN {fits} THEN '{text}'"
        cases["verdict"] += f" WHEN {fits} THEN '{verdict}'"
    link, d, most = host_trust.HREF.replace("'", "''"), f"{host_trust.DAMPING}::DOUBLE", host_trust.MOST
    absolute = "CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END"
    path = lambda u: f"coalesce(regexp_extract({u}, '://[^/?#]*([^?#]*)', 1), '')"
    # both fixed points are sums over the number of steps taken
    return f"""
WITH RECURSIVE p AS (SELECT page_id, html, {host("url")} AS host, {path("url")} AS path FROM pages),
seen AS (SELECT page_id, host, path, CASE{cases["rule"]} END AS rule, CASE{cases["verdict"]} END AS ruled FROM p),
hosts AS (SELECT host, count(*) FILTER (ruled = 'allow') / count(*)::DOUBLE AS allow, count(*) FILTER (ruled = 'block') / count(*)::DOUBLE AS block FROM seen WHERE host <> '' GROUP BY host),
urls AS (SELECT src, {absolute} AS link FROM (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM p WHERE host <> '')),
targets AS (SELECT DISTINCT src, {host("link")} AS host, {path("link")} AS path FROM urls),
judged AS (SELECT src, host AS dst, CASE{cases["verdict"]} END AS ruled FROM targets WHERE host <> '' AND host <> src),
pairs AS (SELECT src, dst, count(*) FILTER (ruled = 'block') / count(*)::DOUBLE AS blocked, count(ruled) / count(*)::DOUBLE AS ruled FROM judged GROUP BY ALL),
edges AS (SELECT *, 1 / count(*) OVER (PARTITION BY src)::DOUBLE AS share FROM pairs),
t(host, r, k) AS (SELECT host, (1 - {d}) * allow, 0 FROM hosts WHERE allow > 0
    UNION ALL SELECT dst, sum({d} * r * share), k + 1 FROM t JOIN edges ON src = host WHERE k < {most} GROUP BY dst, k),
trust AS (SELECT host, sum(r) AS r FROM t GROUP BY host),
step AS (SELECT src, dst, blocked, ruled, (1 - h.allow - h.block) * {d} * share AS w, dst IN (SELECT src FROM pairs) AS onward, coalesce(o.block, 0) AS there FROM edges JOIN hosts h ON h.host = src LEFT JOIN hosts o ON o.host = dst),
base AS (SELECT src AS host, any_value(h.block) + sum(w * blocked + CASE WHEN onward THEN 0 ELSE w * (1 - s.ruled) * there END) AS b, any_value(h.allow + h.block) + sum(w * s.ruled + CASE WHEN onward THEN 0 ELSE w * (1 - s.ruled) END) AS e
    FROM step s JOIN hosts h ON h.host = src GROUP BY src),
x(host, b, e, k) AS (SELECT host, b, e, 0 FROM base
    UNION ALL SELECT src, sum(w * (1 - ruled) * b), sum(w * (1 - ruled) * e), k + 1 FROM x JOIN step ON dst = host WHERE onward AND k < {most} GROUP BY src, k),
walked AS (SELECT host, CASE WHEN sum(e) > 0 THEN sum(b) / sum(e) ELSE 0 END AS share FROM x GROUP BY host),
distrust AS (SELECT host, (1 - {d}) * coalesce(share, block) AS r FROM hosts LEFT JOIN walked USING (host))
SELECT page_id, s.host, path, rule, coalesce(ruled, CASE WHEN coalesce(d.r, 0) > coalesce(t.r, 0) + 1e-12 AND coalesce(d.r, 0) >= {host_trust.THRESHOLD} - 1e-12 THEN 'block' ELSE 'allow' END) AS verdict
FROM seen s LEFT JOIN trust t ON t.host = s.host LEFT JOIN distrust d ON d.host = s.host
"""


OP5_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM win JOIN least USING (h) WHERE doc_id > m),
kept AS (SELECT x.doc_id, string_agg(x.s, ' ' ORDER BY x.j) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS s, unnest(range(1, len(w) + 1)) AS j FROM w) x LEFT JOIN gone USING (doc_id, j) WHERE gone.j IS NULL GROUP BY x.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

OP6_SQL = f"""
WITH d AS (SELECT DISTINCT r, doc_id, {_SHINGLES} AS s FROM (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(t=_LOWERED)} AS w FROM documents)),
i AS (SELECT DISTINCT q, item_id, {_SHINGLES} AS s FROM (SELECT row_number() OVER () AS q, item_id, {_WORDS.format(t=_LOWERED)} AS w FROM benchmark WHERE item_id IS NOT NULL)),
n AS (SELECT q, count(*) AS n_item FROM i GROUP BY q)
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, n_item::BIGINT AS n_item, round(count(*) / n_item::DOUBLE, 9) AS containment
FROM d JOIN i USING (s) JOIN n USING (q) GROUP BY r, q, doc_id, item_id, n_item HAVING count(*) >= ceil(round(0.8::DOUBLE * n_item, 9))
"""

OP10_SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
      concat(coalesce('r' || role, 'n'), chr(1), coalesce('t' || text, 'n')) AS k FROM t),
l AS (SELECT conv_id, list(k ORDER BY place) AS ks, count(*) AS n FROM p GROUP BY conv_id),
f AS (SELECT conv_id, n, unnest(range(1, n + 1)) AS i, ks FROM l),
h AS (SELECT conv_id, n, i, sha256(array_to_string(ks[1:i], chr(2))) AS h FROM f),
proper AS (SELECT DISTINCT h FROM h WHERE i < n),
whole AS (SELECT h, min(conv_id) AS conv_id FROM h WHERE i = n GROUP BY h),
kept AS (SELECT conv_id FROM whole WHERE h NOT IN (SELECT h FROM proper))
SELECT conv_id, n::BIGINT AS n_turns, ((place - 1) // {chat_collapse.CHUNK})::BIGINT AS chunk, min(place)::BIGINT AS first_turn,
       string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered
FROM p JOIN kept USING (conv_id) JOIN l USING (conv_id) GROUP BY conv_id, n, chunk
"""


_TERMS = r"regexp_extract_all({t}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format(t=_LOWERED)} AS t FROM documents),
c AS (SELECT count(*)::BIGINT AS nd, sum(len(t))::BIGINT AS total FROM d WHERE len(t) > 0),
p AS (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d),
tf AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM p GROUP BY ALL),
w AS (SELECT term, floor(1000::DOUBLE * ln((2 * nd + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, c GROUP BY term, nd),
i AS (SELECT DISTINCT q, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS q, item_id, {_TERMS.format(t=_LOWERED)} AS t FROM benchmark)),
s AS (SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // total))))::BIGINT AS score
    FROM i JOIN tf USING (term) JOIN w USING (term), c GROUP BY q, item_id, r, doc_id),
o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {ranked_search.K}
"""


def _op12_sql() -> str:
    bits = "range(0, 256)"
    for _ in range(8):
        bits = f"list_transform({bits}, lambda c: xor(c >> 1, 3988292384 * (c & 1)))"
    least, times = periodic_runs.LEAST, periodic_runs.TIMES
    # two equal words q apart, next to each other for long enough, are a run of period q
    return f"""
WITH t AS (SELECT {bits} AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(t="coalesce(text, '')")} AS w,
      xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM documents, t),
g AS (SELECT r, doc_id, w, len(w) AS n, h, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS k FROM d),
p AS (SELECT r, doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END]) ELSE w END AS w FROM g),
x AS (SELECT r, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS i FROM p),
e AS (SELECT a.r, b.i - a.i AS q, a.i FROM x a JOIN x b ON a.r = b.r AND a.word = b.word AND a.i < b.i AND {times} * (b.i - a.i) <= a.n),
c AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e) GROUP BY r, q, island HAVING count(*) + q >= greatest({least}, {times} * q)),
runs AS (SELECT r, s, l, min(q) AS q FROM c GROUP BY r, s, l),
best AS (SELECT r, s, l, q FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY l / q::DOUBLE DESC, s, q) = 1),
listed AS (SELECT r, count(*) AS n, string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q) AS t FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM x ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(listed.n, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, q::BIGINT AS period, (1000 * l // q)::BIGINT AS exponent_milli,
       sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM p LEFT JOIN best USING (r) LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_vectors": OP1_SQL, "op2_near_text": OP2_SQL, "op3_host_trust": _op3_sql(), "op5_fm_dedup": OP5_SQL, "op6_decontaminate": OP6_SQL, "op10_chat_collapse": OP10_SQL, "op11_ranked_search": OP11_SQL, "op12_periodic_runs": _op12_sql()}
