"""Each operator against brute force on small tables, and on nulls, blanks, repeats, empty tables and clashing names."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from postsieve.llm import chat_collapse, decontaminate, fm_dedup, host_trust, lang_spans, near_text, near_vectors, prefix_bpe, quality_gam

SF = "/root/testdata/sf0.001"
PATH = P.path("byte_bpe_50k.tiktoken")
EXTRA = "id long, n long, score double, component long, keys string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, a short text, a very long one, copies, a repeated row, and columns named like the operators' own."""
    word = "abcdefgh ijk lm nopq rs tuv wx yz".split()
    rng = random.Random(4)
    long = " ".join(rng.choice(word) + str(rng.randrange(400)) for _ in range(30_000))
    base = " ".join(f"w{i}" for i in range(200))
    near = base.replace("w100 ", "x100 ")
    texts = [None, "", " \n\t ", "one two", "one two", base, base, near, long, "é 世界 😀 !!", "1 2 3"]
    rows = [(i, t, "en" if i % 2 else None, "src0", len(t or ""), 1, 2, 0.5, 3, "k") for i, t in enumerate(texts)]
    rows.append(rows[5])
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").cache()


def docs_of(spark, name="documents", sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_near_text_odd(spark, odd):
    got = {r.doc_id: r for r in near_text.near_duplicates(odd, 85).collect()}
    assert [got[i].n_shingles for i in (0, 1, 2, 3)] == [0, 0, 0, 1]
    assert [got[i].component_id for i in (0, 1, 2, 3, 4)] == [0, 1, 2, 3, 3]
    assert {got[i].component_id for i in (5, 6, 7)} == {5} and got[5].kept and not got[7].kept
    assert near_text.near_duplicates(odd.where("false")).count() == 0


def test_near_text_dense_group(spark):
    """A star of variants, of which many are no links: against all pairs."""
    rng = random.Random(1)
    hub = [f"h{i}" for i in range(120)]
    texts = [" ".join(f"z{rng.random()}" if rng.random() < p else w for w in hub) for p in (0.0, *[0.005] * 40, *[0.03] * 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in near_text.near_duplicates(df, 85).collect()}
    assert got == {i: find(i) for i in range(len(sets))}


def windows_removed(rows):
    """Of every row (doc_id, text): the loss of its own text; null doc_ids lose none and count for none."""
    first, out = {}, []
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - 49 if d is not None else 0):
            k = b" ".join(w[i : i + 50])
            first[k] = min(first.get(k, d), d)
    for d, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - 49 if d is not None else 0):
            if first[b" ".join(w[i : i + 50])] < d:
                gone |= set(range(i, i + 50))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [3000, 2])
def test_substrings(spark, odd, hot, monkeypatch):
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(90)]
    long = " ".join(f"a{i}" for i in range(130))
    # repeated rows, and one doc_id with several texts: the judged text decides what goes
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(1000, long), (1001, long), (1001, "short"), (1001, "x " + long + " y"), (1002, long), (1002, long), (None, long), (None, None)]
    for d in range(20, 60):
        a = rng.randrange(40)
        rows.append((d, " ".join([*(f"q{rng.randrange(10**6)}" for _ in range(30)), *passage[a : a + 60], *["again"] * rng.randrange(120)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    real = fm_dedup.repeats
    monkeypatch.setattr(fm_dedup, "repeats", lambda docs, scratch=None: real(docs, scratch, hot_rows=hot, shard_regions=20))
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in fm_dedup.remove(df).collect()), key=str)
    assert got == windows_removed(rows)
    assert fm_dedup.remove(odd.where("false")).count() == 0


def test_substrings_clashing_names(spark):
    long = " ".join(f"a{i}" for i in range(60))
    rows = [(1, long, 1, 2, 3, "r"), (2, "z " + long, 4, 5, 6, "s"), (2, None, 7, 8, 9, "t")]
    df = spark.createDataFrame(rows, "doc_id int, text string, _gone int, doc int, copy int, `row` string")
    out = fm_dedup.remove(df, with_text=True)
    assert out.dtypes == df.dtypes
    assert sorted(map(tuple, out.collect()), key=str) == sorted([rows[0], (2, "z", 4, 5, 6, "s"), rows[2]], key=str)
    assert fm_dedup.remove(df.select("doc_id", "text"), with_text=True).count() == 3


def test_fm_index():
    """Ranks, interval minima and matching statistics against plain search."""
    rng = np.random.default_rng(3)
    regions = [rng.integers(1, 4, n).astype(np.uint64) for n in (60, 113, 55, 70)]
    regions += [np.concatenate([regions[0][:52], rng.integers(1, 4, 9).astype(np.uint64)]), regions[1].copy()]
    docs = np.array([5, 3, 9, 4, 7, 8])
    fm = fm_dedup.Fm(regions, docs)
    order = fm_dedup.suffix_array(fm.text, fm_dedup.WINDOW)
    bwt = fm.text[order - 1]
    counts = np.concatenate([[0], np.cumsum(np.bincount(fm.text, minlength=fm.sigma))])
    for c in range(1, fm.sigma):
        at = np.arange(len(bwt) + 1)
        assert (fm.rank(np.full(len(at), c), at) == counts[c] + np.concatenate([[0], np.cumsum(bwt == c)])).all()
    own = np.repeat(fm.docs, fm.sizes + 1)[order]
    low = rng.integers(0, len(own) - 1, 500)
    high = np.minimum(low + 1 + rng.integers(0, 200, 500), len(own))
    assert (fm.smallest(low, high) == [own[a:b].min() for a, b in zip(low, high, strict=True)]).all()
    search, first, end = fm.earlier(np.arange(6), fm.docs)
    covered = [set() for _ in regions]
    for r, a, b in zip(search, first, end, strict=True):
        covered[r] |= set(range(a, b))
    for r, x in enumerate(regions):
        want = set()
        for i in range(len(x) - 49):
            if any(docs[o] < docs[r] and (y[j : j + 50] == x[i : i + 50]).all() for o, y in enumerate(regions) for j in range(len(y) - 49)):
                want |= set(range(i, i + 50))
        assert covered[r] == want


def test_bpe_round_trip(odd):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    real = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in prefix_bpe.encode(odd, PATH, P.PATTERN, with_ids=True).join(odd.select("doc_id", "text"), "doc_id").collect():
        assert r.ids.split() == [str(i) for i in real.encode_ordinary(r.text or "")] and r.decoded == (r.text or "")
        assert r.n_tokens == len(r.ids.split())
    merges, rng = prefix_bpe.load(PATH), random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("theinanorstéx ") for _ in range(rng.randrange(1, 25))).encode() for _ in range(2))
        whole = prefix_bpe.Prefixes(merges, a + b).ids()
        assert prefix_bpe.Prefixes(merges, a).append(b).ids() == whole
        assert prefix_bpe.Prefixes(merges, a + a).edit(a + b).ids() == whole


def test_quality(spark, odd):
    docs, labels = (docs_of(spark, t, "/root/testdata/sf0.01") for t in ("documents", "labels"))  # enough labels to learn from
    scored = quality_gam.score(docs, quality_gam.fit(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.3) == (r.quality == 1) for r in held) >= 0.9 * len(held)
    empty = quality_gam.fit(docs.where("false"), labels.where("false"))
    assert {r.score for r in quality_gam.score(odd, empty).collect()} == {0.5}
    clash = odd.withColumn("_score", F.lit(1)).withColumn("doc_id", F.col("doc_id").cast("int"))
    assert quality_gam.accepted(clash, empty, 0.5).dtypes == clash.dtypes and quality_gam.accepted(clash, empty, 0.5).count() == clash.count()
    assert quality_gam.accepted(clash, empty, 0.6).count() == 0 and quality_gam.fit(clash, labels).score(np.zeros((0, len(quality_gam.FEATURES)))).shape == (0,)
    assert quality_gam.score(clash, empty).count() == odd.count()


def test_language(spark, odd):
    docs = docs_of(spark)
    model = lang_spans.fit(docs)
    got = {r.doc_id: r.lang_pred for r in lang_spans.label(docs, model).collect()}
    held = [r for r in docs.select("doc_id", "lang").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(got[r.doc_id] == r.lang for r in held) >= 0.95 * len(held)
    got = {r.doc_id: r for r in lang_spans.label(odd, model, with_spans=True).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 10)] == ["und"] * 4 and got[0].score == 0
    one = {r.lang: r.text for r in docs.where("lang in ('en', 'de') and length(text) between 300 and 2000").collect()}
    mixed = spark.createDataFrame([(1, one["en"] + " " + one["de"])], "doc_id long, text string")
    assert [s.lang for s in lang_spans.label(mixed, model, with_spans=True).first().spans] == ["en", "de"]
    assert {r.lang_pred for r in lang_spans.label(odd, lang_spans.fit(docs.where("false"))).collect()} == {"und"}


def test_viterbi_brute_force():
    rng = np.random.default_rng(0)
    at = np.array([0, 1, 1, 6, 11, 18])
    s = rng.normal(0, 6, (18, 3)).astype(np.float32)
    got = lang_spans.viterbi(s, at, 5.0)
    cost = lambda x, p: sum(x[i, k] for i, k in enumerate(p)) - 5.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
    import itertools

    for a, b in zip(at, at[1:], strict=False):
        if b > a:
            best = max(cost(s[a:b], p) for p in itertools.product(range(3), repeat=int(b - a)))
            assert cost(s[a:b], got[a:b]) == pytest.approx(best, abs=1e-3)


def test_decontamination(spark, odd):
    items = spark.createDataFrame([(1, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"), (2, "one two"), (3, None), (4, ""), (5, "w1 w2 w3 no such words here at all")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.matches(odd.dropDuplicates(["doc_id"]), items).collect())
    assert got == [(3, 2), (4, 2), (5, 1), (6, 1), (7, 1)]
    blocks = decontaminate.matches(odd.dropDuplicates(["doc_id"]), items, block_items=2)
    assert sorted((r.doc_id, r.item_id) for r in blocks.collect()) == got
    assert decontaminate.matches(odd, items.where("false")).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(600, 16))
    base[300:] = base[:300] + rng.normal(size=(300, 16)) * rng.choice([0.05, 0.3, 1.0], 300)[:, None]
    rows = [(i, [float(v) for v in x.astype(np.float32)], int(i % 3)) for i, x in enumerate(base)]
    rows += [(1000, rows[0][1], 0), (1001, None, 0), (1002, [0.0] * 16, 0), (1003, [float("nan")] * 16, 0), (1004, rows[1][1], None), (1005, [1.0], 0), (1006, [1.0, None], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(1)).withColumn("n", F.lit(2))
    good = {i: (np.array(x, float), k) for i, x, k in rows if i < 1001}
    link = {i: set() for i, _, _ in rows}
    for i, (x, k) in good.items():
        for j, (y, m) in good.items():
            if i != j and k == m and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                link[i].add(j)
    comp = {}
    for i in sorted(link):
        todo = [i]
        while todo:
            v = todo.pop()
            if v not in comp:
                comp[v] = i
                todo += link[v]
    for size in (20_000, 60):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(df, 0.93, shard_rows=size).collect()}
        assert got == {i: (len(link[i]), comp[i], comp[i] == i) for i in link}
    assert near_vectors.near_vectors(df.where("false")).count() == 0


def far_shard(n_queries=3000):
    """A shard of separate clusters, which its graph does not connect, and queries of which few are near a row of it."""
    rng = np.random.default_rng(5)
    shard = np.repeat(rng.normal(size=(40, 16)), 60, 0) + 0.45 * rng.normal(size=(2400, 16))
    q = rng.normal(size=(n_queries, 16))
    audited = np.linspace(0, n_queries - 1, 256).astype(int)
    few = rng.choice(np.setdiff1d(np.arange(n_queries), audited), 40, replace=False)
    q[few] = shard[rng.integers(0, len(shard), 40)] + 0.02 * rng.normal(size=(40, 16))
    return near_vectors.unit(shard), near_vectors.unit(q)


def test_vectors_audit_evidence():
    """Few links between a block and another shard: against brute force."""
    shard, q = far_shard()
    ids, q_ids = np.arange(len(shard)), 10_000 + np.arange(len(q))
    graph = near_vectors.Graph.build(shard.astype(np.float32))
    got = {(int(i), int(j)) for a, b in near_vectors.links(graph, shard, ids, q, q_ids, 0.96) for i, j in zip(a, b, strict=True)}
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(q @ shard.T >= 0.96), strict=True)}
    assert len(want) >= 40 and got == want


def test_vectors_shards_by_graph(spark):
    """Several shards that are searched by their graphs."""
    shard, q = far_shard(1600)
    x = np.concatenate([shard, q]).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int")
    u = near_vectors.unit(x)
    want = (u @ u.T >= 0.96).sum(1) - 1
    got = {r.vec_id: r.n_links for r in near_vectors.near_vectors(df, 0.96, shard_rows=1000).collect()}
    assert got == dict(enumerate(want.tolist()))


def test_chat(spark):
    turns = [(1, t, "user", f"m{t}") for t in range(3)] + [(2, t, "user", f"m{t}") for t in range(700)] + [(3, t, "user", f"m{t}") for t in range(3)]
    turns += [(4, 0, "user", "m0"), (4, 1, "user", "other"), (5, 0, None, None), (6, None, "user", "x"), (6, None, "user", "x"), (None, 0, "user", "lost"), (7, 0, "user", None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = chat_collapse.render(df).collect()
    assert {r.conv_id for r in got} == {2, 4, 5, 6, 7}
    whole = "".join(r.rendered for r in sorted((r for r in got if r.conv_id == 2), key=lambda r: r.chunk))
    assert whole == "".join(f"<|im_start|>user\nm{t}<|im_end|>\n" for t in range(700))
    assert chat_collapse.render(df.where("false")).count() == 0


def test_hosts(spark):
    rules = [("good.org/", "allow"), ("bad.net/", "block")]
    pages = [
        (1, "http://good.org/a", '<a href="http://friend.com/x">'), (2, "http://friend.com/y", '<a href="http://good.org/">'), (3, "http://bad.net/z", None),
        (4, "http://farm.biz/q", "<a href='https://BAD.net/1'> <a href=https://bad.net/2>"), (5, None, ""), (6, "no scheme", ""), (7, "HTTP://Sub.GOOD.org?x", ""), (8, "x://sub.good.org/p#f", ""),
    ]
    got = {r.page_id: r for r in host_trust.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert [got[i].verdict for i in range(1, 9)] == ["allow", "allow", "block", "block", "allow", "allow", "allow", "allow"]
    assert (got[7].host, got[7].path, got[7].rule, got[8].path, got[8].rule) == ("sub.good.org", "", None, "/p", "good.org/")
    assert got[2].trust > 0 and got[4].distrust > got[4].trust


def test_host_farm(spark):
    """Many hosts around one blocked host, with and without links among them; a host with few links to it stays."""
    rules, sites = [("bad.net/", "block"), ("good.org/", "allow")], [f"f{i}.biz" for i in range(12)]
    link = lambda *hosts: " ".join(f'<a href="http://{h}/x">' for h in hosts)
    pages = [(0, "http://bad.net/", ""), (1, "http://good.org/", link("fine.com")), (2, "http://news.com/a", link("bad.net", "a.com", "b.com", "c.com")), (3, "http://fine.com/a", link("good.org", "bad.net", "d.com"))]
    pages += [(10 + i, f"http://{h}/p", link("bad.net")) for i, h in enumerate(sites)]
    pages += [(30 + i, f"http://r{i}.biz/p", link("bad.net", *[f"r{j}.biz" for j in range(12)])) for i in range(12)]
    got = {r.page_id: r for r in host_trust.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert {i for i, r in got.items() if r.verdict == "block"} == {0, *range(10, 22), *range(30, 42)}
    # one in four; one in three that end
    assert got[2].distrust == pytest.approx(0.15 / 4) and got[3].distrust == pytest.approx(0.15 / 3)
    assert got[10].distrust == got[30].distrust == pytest.approx(0.15)


def test_host_links_fixed_point(spark):
    """Links to blocked URLs that were not crawled, links without a scheme, and long paths and cycles against a linear solve."""
    rules = [("x.com/de/", "block"), ("good.org/", "allow")]
    pages = [(0, "http://a.biz/", '<a href="http://x.com/de/1">'), (1, "http://b.biz/", "<a href='//x.com/de/2'>"), (2, "http://c.biz/", '<a href="http://x.com/en/1">'), (3, "http://good.org/", '<a href="http://l0.com/">')]
    pages += [(10 + i, f"http://l{i}.com/", f'<a href="//l{(i + 1) % 20}.com/">' + ('<a href="//x.com/de/3"><a href="http://y.com/">' if i == 19 else "")) for i in range(20)]
    got = {r.page_id: r for r in host_trust.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert [got[i].verdict for i in range(4)] == ["block", "block", "allow", "allow"]
    # trust: a cycle of 20 fed by good.org, whose last host has three links; all its walks end blocked or at y.com
    m, seed = np.zeros((21, 21)), np.zeros(21)
    m[0, 20], seed[20] = 0.85, 0.15
    for i in range(20):
        m[(i + 1) % 20, i] = 0.85 / (3 if i == 19 else 1)
    want = np.linalg.solve(np.eye(21) - m, seed)
    assert [got[10 + i].trust for i in range(20)] == pytest.approx(list(want[:20]), abs=1e-8)
    assert [got[10 + i].distrust for i in range(20)] == pytest.approx([0.075] * 20, abs=1e-6)


def test_pipeline(spark):
    import corpus_pipeline

    docs, kept = docs_of(spark), None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        if name != "encoding":
            assert out.columns == docs.columns
        kept = out
        docs = out
    assert 0 < kept.count() <= docs_of(spark).count()
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs_of(spark).where("false"), SF).count() == 0
