"""Measured recall of the searches, the models against plain loops, and more defined cases."""

import math
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from postsieve.llm import decontaminate, lang_spans, near_text, near_vectors, quality_gam

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def test_graph_search_at_every_size(monkeypatch):
    """The graph is searched for all rows of small and large shards, and finds every link."""
    rng = np.random.default_rng(2)
    for size in (30, 150, 1500):
        x = np.repeat(rng.normal(size=(size // 10, 12)), 10, 0) + 0.1 * rng.normal(size=(size, 12))
        x, ids, searched = near_vectors.unit(x), np.arange(size), []
        g = near_vectors.Graph.build(x.astype(np.float32))
        real = g.search
        monkeypatch.setattr(g, "search", lambda q, beam, **k: (searched.append((len(q), beam)), real(q, beam, **k))[1])
        got = {(int(i), int(j)) for a, b in near_vectors.links(g, x, ids, x, ids, 0.95) for i, j in zip(a, b, strict=True)}
        assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(x @ x.T >= 0.95), strict=True) if i != j}
        assert any(n == size and beam < size for n, beam in searched)


def test_graph_recall_without_widening():
    """What a beam of BEAM finds alone, on 4,000 vectors in clusters: at least 0.9 of the links."""
    rng = np.random.default_rng(4)
    x = near_vectors.unit(np.repeat(rng.normal(size=(500, 32)), 8, 0) + 0.1 * rng.normal(size=(4000, 32)))
    g = near_vectors.Graph.build(x.astype(np.float32))
    found, sims = g.search(x.astype(np.float32), near_vectors.BEAM)
    got = {(i, int(j)) for i in range(len(x)) for j, s in zip(found[i], sims[i], strict=True) if s >= 0.93 and i != j}
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(x @ x.T >= 0.93), strict=True) if i != j}
    assert len(got & want) >= 0.9 * len(want)


def test_audit_without_links(monkeypatch):
    """Where nothing is linked, a fixed number of rows is compared with the shard, however many there are."""
    rng = np.random.default_rng(6)
    for size in (2000, 4000):
        x, seen, real = near_vectors.unit(rng.normal(size=(size, 24))), [], near_vectors.compared
        g = near_vectors.Graph.build(x.astype(np.float32))
        monkeypatch.setattr(near_vectors, "compared", lambda q, rows, *a: (seen.append(len(rows)), real(q, rows, *a))[1])
        assert not sum(len(a) for a, _ in near_vectors.links(g, x, np.arange(size), x, np.arange(size), 0.93))
        monkeypatch.setattr(near_vectors, "compared", real)
        assert sum(seen) == near_vectors.AUDIT


def test_turned_vectors():
    x = near_vectors.unit(np.random.default_rng(1).normal(size=(50, 8)))
    c = (near_vectors.turned(x, 0.93, np.random.default_rng(2)) * x).sum(1)
    assert c.min() >= 0.93 and c.max() <= 1 + 1e-12 and c.std() > 0.005


def test_recall_of_a_large_shard():
    """20,000 vectors, of which few have links, through audits as they are: at least 0.99 of the links."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20_000, 24))
    x[:400] = x[400:800] + 0.15 * rng.normal(size=(400, 24))
    x = near_vectors.unit(x)
    g = near_vectors.Graph.build(x.astype(np.float32))
    ids = np.arange(len(x))
    got = {(int(i), int(j)) for a, b in near_vectors.links(g, x, ids, x, ids, 0.93) for i, j in zip(a, b, strict=True)}
    want = {(int(a), int(b)) for at in range(0, 20_000, 2000) for a, b in zip(*np.nonzero(x[at : at + 2000] @ x.T >= 0.93), strict=True) for a in [a + at] if a != b}
    assert len(want) > 500 and got <= want and len(got) >= 0.99 * len(want)


def test_different_vectors_of_one_id(spark):
    """Each row has its own vector's links, also where another vector has its id."""
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.02]), (1, [0.0, 1.0]), (4, [0.01, 1.0]), (9, [0.7, -0.7]), (0, [0.7, -0.71])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in near_vectors.near_vectors(df, 0.99).collect())
    assert got == [(0, 1, 0, True), (1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 1, False), (9, 1, 0, False)]


def test_unite():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.integers(0, 60, 40), rng.integers(0, 60, 40)
        parent = np.arange(60)
        near_vectors.unite(parent, a[:20], b[:20])
        near_vectors.unite(parent, a[20:], b[20:])
        want = np.arange(60)
        for _ in range(60):
            low = np.minimum(want[a], want[b])
            np.minimum.at(want, a, low)
            np.minimum.at(want, b, low)
        assert (parent == want).all()


def test_vectors_repeated_rows(spark):
    rows = [(1, [1.0, 0.0], 1, 7), (1, [1.0, 0.0], 1, 7), (2, [1.0, 0.0], 1, 7), (3, [1.0, 0.01], 1, 7), (4, [0.0, 1.0], 1, 7), (5, [1.0, 0.0], 2, 7), (None, [1.0, 0.0], 1, 7)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int, k1 int")
    got = sorted(tuple(r)[:4] for r in near_vectors.near_vectors(df, 0.93).where("vec_id is not null").collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (5, 0, 5, True)]


def shingles(text):
    w = WORD.findall((text or "").lower().encode())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def by_pairs(texts, percent):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("kind", ["short", "dense", "narrow"])
def test_near_text_recall(spark, kind, monkeypatch):
    """Short texts, many variants of one template, and a reach so narrow that the audit must widen it."""
    rng = random.Random(5)
    word = lambda n: f"w{rng.randrange(n)}"
    texts = []
    if kind == "dense":
        base = [word(5000) for _ in range(150)]
        texts = [" ".join(word(9000) if rng.random() < 0.02 * rng.random() else w for w in base) for _ in range(250)]
    else:
        for _ in range(150):
            base = [word(400) for _ in range(rng.choice((6, 11, 30, 60)))]
            texts.append(" ".join(base))
            if rng.random() < 0.6:
                texts.append(" ".join([*base, word(400)]) if len(base) > 11 else " ".join(base))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    report = []
    monkeypatch.setattr(near_text, "audit_of", lambda docs, percent, real=near_text.audit_of: real(docs, percent, 1000))
    got = near_text.near_duplicates(df, 85, reach=near_text.Reach(1, 8, 8) if kind == "narrow" else near_text.Reach(), report=report)
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(by_pairs(texts, 85)))
    total, inside, sought, found = report[-1][1:]
    assert total > 0 and inside >= near_text.RECALL * total and sought > 100 and found >= near_text.RECALL * sought


def test_near_text_rare_links(spark):
    """Audited texts without any natural link: planted ones are the evidence, and change no group."""
    rng = random.Random(8)
    texts = [" ".join(f"t{i}w{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 120))) for i in range(400)]
    report, df = [], spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = set(near_text.audit_of(df, 85).ids.tolist())
    rest = [i for i in range(400) if i not in first][:60]
    # near pairs, none of them audited, and texts shorter than one that can be varied
    for k in range(0, 60, 2):
        a, w = rest[k], texts[rest[k]].split()
        texts[rest[k + 1]] = " ".join([*w, "more"] if k % 4 else w[1:])
    df = spark.createDataFrame([*enumerate(texts), *[(-(2**63) + i, "a b c d e f") for i in range(3)]], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_text.near_duplicates(df, 85, report=report).collect()}
    want = by_pairs(texts, 85)
    assert {i: c for i, c in got.items() if i >= 0} == dict(enumerate(want)) and sum(i != c for i, c in enumerate(want)) == 30
    assert {got[-(2**63) + i] for i in range(3)} == {-(2**63)}
    _, total, inside, sought, found = report[-1]
    assert sought >= 100 and found >= near_text.RECALL * sought


def test_planted_sets():
    rng = np.random.default_rng(1)
    for n in (1, 5, 6, 11, 12, 13, 60, 1000):
        s = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
        for _ in range(20):
            p = near_text.planted(s, 85, rng)
            assert (p is None) == (n < 6)
            if p is not None:
                assert 100 * len(np.intersect1d(s, p)) >= 85 * len(np.union1d(s, p)) and not np.array_equal(s, p)


def test_low_recall_is_an_error(spark, monkeypatch):
    """An order that pairs nothing finds no planted set: that is said, not passed over."""
    monkeypatch.setattr(near_text.Reach, "wider", lambda self: self)
    texts = [" ".join(f"t{i}w{k}" for k in range(40)) for i in range(120)]
    with pytest.raises(near_text.LowRecall, match="planted"):
        near_text.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 85, reach=near_text.Reach(1, 8, 9))


def test_audit_links():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, n).astype(np.uint64) << np.uint64(50)) for n in (30, 60, 90, 120)]
    audit = near_text.Audit([7, 8, 9, 10], sets, 60)
    for s in sets:
        want = [i for i, t in zip((7, 8, 9, 10), sets, strict=True) if 100 * len(np.intersect1d(s, t)) >= 60 * len(np.union1d(s, t))]
        assert audit.links(s) == want


def test_decontamination_by_loops(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    long = "a b c d e f g h i j " + " ".join(f"x{i}" for i in range(300))
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(9000, long), (9000, long), (None, long)], "doc_id long, text string"))
    items = items.select("item_id", "text").unionByName(spark.createDataFrame([(900, "b c d e f g"), (900, long), (None, long), (901, " ".join(f"x{i}" for i in range(50, 200)) + " no more of this")], "item_id long, text string"))
    own = [(r.item_id, shingles(r.text)) for r in items.collect() if r.item_id is not None and r.text]
    want = sorted(((r.doc_id, i, len(s & shingles(r.text)), len(s)) for r in docs.collect() for i, s in own if s and len(s & shingles(r.text)) >= math.ceil(round(0.8 * len(s), 9))), key=str)
    got = decontaminate.matches(docs, items)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == want and any(w[0] == 9000 for w in want)


# --- quality




def test_quality_trees_fit_by_loops():
    """Cyclic boosting follows its definition: one feature, few bins, a loop over rows."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (200, 2)).astype(float)
    y = (rng.random(200) < np.where(x[:, 0] > 1, 0.9, 0.2)).astype(float)
    model = quality_gam.train(x, y)
    p = model.score(x)
    for v in range(4):
        rows = x[:, 0] == v
        assert abs(p[rows].mean() - y[rows].mean()) < 0.12
    grad, hess = np.array([3.0, -1.0, 2.0]), np.array([1.0, 2.0, 1.0])
    tree = quality_gam._tree(grad, hess)
    assert tree[0] > 0 > tree[1] and tree[2] > 0
    table = rng.normal(size=(8, 8))
    gain, out = quality_gam._pair_tree(table, np.ones((8, 8)))
    best = max(sum(table[a, b].sum() ** 2 / (table[a, b].size + 1) for a in (slice(0, i), slice(i, 8)) for b in (slice(0, j), slice(j, 8))) for i in range(1, 8) for j in range(1, 8))
    assert gain == pytest.approx(best) and len(np.unique(out)) <= 4


def test_quality_scores_all_rows_alone(spark):
    """A text's features do not depend on the texts around it."""
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + [None, "", " \n", "|", "x" * 3_000_000]
    whole = quality_gam.features(pa.array(texts, pa.string()))
    alone = np.concatenate([quality_gam.features(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(whole, alone) and np.isfinite(whole).all()
    for t, f in zip(texts, whole, strict=True):
        b = (t or "").encode()
        w = WORD.findall(b)
        f = dict(zip(quality_gam.FEATURES, f, strict=True))
        assert f["log_words"] == pytest.approx(math.log1p(len(w)))
        if w:
            assert f["distinct_words"] == pytest.approx(len(set(w)) / len(w)) and f["top_word"] == pytest.approx(max(map(w.count, set(w))) / len(w))


# --- languages


def plain_words(text):
    """Runs of letters and marks of the lower-case text."""
    out, now = [], ""
    for c in (text or "").lower() + " ":
        if unicodedata.category(c)[0] in "LM":
            now += c
        elif now:
            out.append(now)
            now = ""
    return out


def test_words_of_a_text():
    texts = ["Ünder 😀 “quotes” and nbsp", "Tiếng Việt rất đẹp", "мир ΚΟΣΜΟΣ שלום 世界 한국 ไทย", "x1y 2 __", None, "étude"]
    data, bounds = lang_spans.text_bytes(lang_spans.pc.utf8_lower(pa.array(texts, pa.string())))
    model = lang_spans.Model(["a", "b"], np.ones((2, 2 * lang_spans.BUCKETS + lang_spans.SCRIPTS), np.int64))
    _, sizes, at = lang_spans.word_scores(model, data, bounds)
    for i, t in enumerate(texts):
        assert sizes[at[i] : at[i + 1]].tolist() == [len(w.encode()) for w in plain_words(t)]
    script = lang_spans._byte_scripts(np.frombuffer("aế мα世한א😀“1".encode(), np.uint8)).tolist()
    assert script == [1, 1, 1, 1, 0, 3, 3, 2, 2, 12, 12, 12, 10, 10, 10, 5, 5, 0, 0, 0, 0, 0, 0, 0, 0]


def test_language_by_loops(spark):
    """Labels and scores of a whole table against plain sums and a plain Viterbi."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lang_spans.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_spans.label(docs, model).collect()}
    for r in docs.where("length(text) < 600").collect():
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert got[r.doc_id] == ("und", 0.0)
            continue
        data, bounds = lang_spans.text_bytes(lang_spans.pc.utf8_lower(pa.array([r.text], pa.string())))
        scores, sizes, _ = lang_spans.word_scores(model, data, bounds)
        best, back = scores[0].astype(float), []
        for s in scores[1:]:
            top = int(best.argmax())
            stay = best >= best[top] - lang_spans.SWITCH
            back.append(np.where(stay, np.arange(len(best)), top))
            best = np.where(stay, best, best[top] - lang_spans.SWITCH) + s
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        letters = np.bincount(path[::-1], sizes, len(model.langs))
        assert got[r.doc_id][0] == model.langs[int(letters.argmax())]
        assert 0 <= got[r.doc_id][1] <= 1


def test_emoji_and_quotes_are_no_words(spark):
    model = lang_spans.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    df = spark.createDataFrame([(1, "😀 “”  "), (2, "😀 the “house” of the people"), (2, "😀 the “house” of the people")], "doc_id int, text string")
    got = lang_spans.label(df, model, with_spans=True).orderBy("doc_id").collect()
    assert (got[0].lang_pred, got[0].score) == ("und", 0.0) and got[1] == got[2] and got[1].lang_pred == "en"
    assert lang_spans.label(df.where("false"), model).count() == 0


def test_hosts_against_sql(spark, tmp_path):
    """Trust and distrust on random link graphs: every verdict is that of the SQL."""
    import duckdb

    from postsieve.llm import queries

    rng = random.Random(9)
    hosts = [f"h{i}.{end}" for i in range(30) for end in ("com", "net")] + ["www.Example.org", "example.org", "a.org"]
    paths = ["/fr/1", "/de/2", "/es/3", "/en/1", "/x?y=1", "", "#top"]
    url = lambda near: f"{rng.choice(['http:', 'HTTPS:', ''])}//{rng.choice(near)}{rng.choice(paths)}"
    pages = [(None, None, None), (-1, "no scheme", '<a href="http://h1.com/de/2">'), (-2, "http:///de/2", "")]
    for i in range(400):
        home = rng.choice(hosts)
        near = [hosts[(hosts.index(home) + k) % len(hosts)] for k in (1, 2, 7)] + [f"outside{i % 9}.com"]
        links = "".join(f'<a href = "{url(near)}">x</a>' for _ in range(rng.randrange(5)))
        pages.append((i, f"http://{home}{rng.choice(paths)}", links + "<a href='/local'>" if i % 17 else None))
    pages.append(pages[9])
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r) for r in queries.op3_host_trust(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(queries.oracle_sql()["op3_host_trust"]).fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}
