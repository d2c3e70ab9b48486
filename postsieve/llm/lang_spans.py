"""Language spans: script ranges narrow the candidates, then Viterbi labels the words.

A word is a run of letters (Unicode's categories L, and M for the marks on them) of the
lower-case text.  Each word gets a score per language, the sum of the log
probabilities of its byte bigrams and trigrams (hashed into BUCKETS); languages in
which the word's script hardly occurred are ruled out by a large penalty.  Viterbi
with a penalty for every change of language then labels the words, and runs of one
label are spans.  The document's language is the one with the most letters; the score
is that language's share, weighted by how far its words prefer it.

Counts are learned from about SAMPLE_DOCS documents per language (those with the
smallest hashes of doc_id), as documented bounds of the fit.

Defined cases: a null text, or one without any letter, is `und` with score 0; rows
with a null lang are not learned from; without any learned language all is `und`; every row
is labelled by itself, so repeated rows give equal rows; ties go to the smaller lang; very long
texts go through Viterbi alone, whole; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from .shared import steps, text_bytes

SAMPLE_DOCS = 2_000
BUCKETS = 1 << 15
SWITCH = 12.0
#: Bytes of text whose words go through Viterbi together (a longer text alone).
VITERBI_BYTES = 8 << 20
RULED_OUT = -60.0
#: A script counts as a language's own if at least this share of its letters is in it.
SCRIPT_SHARE = 0.002
_LETTER = regex.compile(r"\p{L}")


#: Ranges of scripts in Unicode (first, last, script): 1 Latin, 2 Greek, 3 Cyrillic, 4 Armenian and Georgian,
#: 5 Hebrew, 6 Arabic and Syriac, 7 Indic, 8 Thai, Lao, Tibetan, Burmese and Khmer, 9 Ethiopic, 10 Hangul, 11 kana, 12 Han; 13 is any other.
RANGES = [
    (0x0041, 0x024F, 1), (0x0250, 0x02AF, 1), (0x0370, 0x03FF, 2), (0x0400, 0x052F, 3), (0x0530, 0x058F, 4), (0x0590, 0x05FF, 5), (0x0600, 0x08FF, 6),
    (0x0900, 0x0DFF, 7), (0x0E00, 0x109F, 8), (0x10A0, 0x10FF, 4), (0x1100, 0x11FF, 10), (0x1200, 0x139F, 9), (0x1780, 0x17FF, 8), (0x1C80, 0x1C8F, 3),
    (0x1C90, 0x1CBF, 4), (0x1E00, 0x1EFF, 1), (0x1F00, 0x1FFF, 2), (0x2C60, 0x2C7F, 1), (0x2D00, 0x2D2F, 4), (0x2DE0, 0x2DFF, 3), (0x3040, 0x30FF, 11),
    (0x3130, 0x318F, 10), (0x31F0, 0x31FF, 11), (0x3400, 0x4DBF, 12), (0x4E00, 0x9FFF, 12), (0xA640, 0xA69F, 3), (0xA720, 0xA7FF, 1), (0xA8E0, 0xA8FF, 7),
    (0xAB30, 0xAB6F, 1), (0xAC00, 0xD7FF, 10), (0xF900, 0xFAFF, 12), (0xFB00, 0xFB06, 1), (0xFB1D, 0xFB4F, 5), (0xFB50, 0xFDFF, 6), (0xFE70, 0xFEFF, 6),
    (0xFF21, 0xFF5A, 1), (0xFF66, 0xFF9D, 11), (0x20000, 0x323AF, 12),
]
SCRIPTS = 14


@lru_cache(maxsize=1)
def _scripts() -> np.ndarray:
    """The script of every code point that is a letter, or a mark on one; 0 of all others."""
    t = np.zeros(0x110000, np.uint8)
    t[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] in "LM"]] = SCRIPTS - 1
    for a, b, script in RANGES:
        part = t[a : b + 1]
        part[part > 0] = script
    # marks that many scripts share tell nothing
    t[0x0300:0x0370][t[0x0300:0x0370] == SCRIPTS - 1] = SCRIPTS
    return t


def _byte_scripts(part: np.ndarray) -> np.ndarray:
    """The script of each byte's character, 0 outside of words."""
    table = _scripts()
    out = table[part]
    out[part >= 128] = 0
    at = np.flatnonzero(part >= 0xC2)
    if len(at):
        b = np.append(part, np.zeros(3, np.uint8)).astype(np.int32)
        lead, size = b[at], 2 + (b[at] >= 0xE0).astype(np.int64) + (b[at] >= 0xF0)
        c = np.where(size == 2, lead & 0x1F, np.where(size == 3, lead & 0x0F, lead & 0x07))
        for k in (1, 2, 3):
            c = np.where(size > k, (c << 6) | (b[at + k] & 0x3F), c)
        script = table[np.minimum(c, 0x10FFFF)]
        out[at] = script
        for k in (1, 2, 3):
            more = size > k
            out[at[more] + k] = script[more]
    return out


def _grams(part: np.ndarray, own: np.ndarray):
    """Of lower-case text: hashes of the bigram and trigram at each letter byte, the first letter of each word, first word of each row, the script at each letter byte, and letter bytes before each row."""
    script = _byte_scripts(part)
    letter = script > 0
    x = np.where(letter, part, 32).astype(np.uint32)
    left, right = np.full(len(x), 32, np.uint32), np.full(len(x), 32, np.uint32)
    left[1:], right[:-1] = x[:-1], x[1:]
    edge = own[own < len(part)]
    left[edge] = 32
    right[edge[edge > 0] - 1] = 32
    at = np.flatnonzero(letter)
    two = (left * np.uint32(0x9E3779B1) + x * np.uint32(0x85EBCA6B)) ^ np.uint32(0x1B873593)
    tri = two + right * np.uint32(0xC2B2AE35)
    tri ^= tri >> np.uint32(15)
    tri *= np.uint32(0x2C1B3C6D)
    two ^= two >> np.uint32(13)
    two *= np.uint32(0x297A2D39)
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    first[edge] = letter[edge]
    rank = np.cumsum(letter) - 1
    words = np.flatnonzero(first)
    return two[at] >> np.uint32(17), tri[at] >> np.uint32(17), rank[words] if len(words) else words, np.searchsorted(words, own), np.where(script[at] == SCRIPTS, 0, script[at]), np.concatenate([[0], np.cumsum(letter, dtype=np.int64)])[own]


def _counts(batches):
    for batch in batches:
        data, bounds = text_bytes(pc.utf8_lower(batch.column(0)))
        langs = batch.column(1).to_pylist()
        names = sorted(set(langs))
        number = np.array([names.index(x) for x in langs], np.int64)
        total = np.zeros((len(names), 2 * BUCKETS + SCRIPTS), np.int64)
        for first, last in steps(bounds):
            part, own = data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
            two, tri, _, _, script, letters = _grams(part, own)
            for i in range(last - first):
                a, b = letters[i], letters[i + 1]
                row = total[number[first + i]]
                row[:BUCKETS] += np.bincount(two[a:b], minlength=BUCKETS)
                row[BUCKETS : 2 * BUCKETS] += np.bincount(tri[a:b], minlength=BUCKETS)
                row[2 * BUCKETS :] += np.bincount(script[a:b], minlength=SCRIPTS)
        who, what = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in who], pa.string()), pa.array(what, pa.int32()), pa.array(total[who, what])], ["lang", "bucket", "n"])


class Model:
    def __init__(self, langs: list[str], total: np.ndarray):
        self.langs = langs
        part = lambda a, b: np.log((total[:, a:b] + 0.2) / (total[:, a:b].sum(1, keepdims=True) + 0.2 * (b - a)))
        two, tri = part(0, BUCKETS), part(BUCKETS, 2 * BUCKETS)
        centre = lambda t: np.ascontiguousarray((t - t.mean(0)).T.astype(np.float32))
        self.two, self.tri = (centre(two), centre(tri)) if langs else (two.T, tri.T)
        scripts = total[:, 2 * BUCKETS :].astype(float)
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        own = share >= SCRIPT_SHARE
        self.script = np.where(own | ~own.any(0), 0, RULED_OUT).T.astype(np.float32)
        self.script[0] = 0


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learns from documents with a lang whose crc32(doc_id) mod 4 is not 2."""
    known = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((0, 2 * BUCKETS + SCRIPTS)))
    share = F.create_map(*[F.lit(v) for k, n in sorted(sizes.items()) for v in (k, min(1.0, sample_docs / n))])
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * share[F.col("lang")])
    # A lang of this table is one of few; what comes back is bounded by langs x buckets.
    rows = sample.select("text", "lang").mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    total = np.zeros((len(langs), 2 * BUCKETS + SCRIPTS), np.int64)
    if langs:
        number = {x: i for i, x in enumerate(langs)}
        total[[number[x] for x in rows.column("lang").to_pylist()], rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return Model(langs, total)


def word_scores(model: Model, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores (words x langs), letters of each word, first word of each row (and the end)."""
    scores, sizes, at, done = [], [], [np.zeros(1, np.int64)], 0
    for first, last in steps(bounds):
        part, own = data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        two, tri, words, firsts, script, _ = _grams(part, own)
        if len(words):
            s = model.two[two]
            s += model.tri[tri]
            s = np.add.reduceat(s, words, axis=0)
            s += model.script[np.maximum.reduceat(script, words)]
            scores.append(s)
            sizes.append(np.diff(np.append(words, len(two))))
        at.append(firsts[1:] + done)
        done += len(words)
    k = len(model.langs)
    return np.concatenate(scores) if scores else np.zeros((0, k), np.float32), np.concatenate(sizes) if sizes else np.zeros(0, np.int64), np.concatenate(at)


def viterbi(scores: np.ndarray, at: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of every word; all rows take their steps together."""
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    begin, n = at[:-1][order], n[order]
    width = scores.shape[1]
    out = np.zeros(len(scores), np.int16)
    if not len(n) or n[0] == 0:
        return out
    jumped = np.zeros(scores.shape, bool)
    source = np.zeros(len(scores), np.int16)
    alive = np.searchsorted(-n, -np.arange(1, n[0] + 1), "right")
    best = scores[begin[: alive[0]]].copy()
    for t in range(1, n[0]):
        k = alive[t]
        best = best[:k]
        rows = begin[:k] + t
        top = best.argmax(1)
        bar = best[np.arange(k), top][:, None] - switch
        jumped[rows] = best < bar
        source[rows] = top
        best = np.maximum(best, bar) + scores[rows]
        # rows that end here are settled below from their last word
        ended = k if t + 1 >= n[0] else alive[t + 1]
        if ended < k:
            out[begin[ended:k] + t] = best[ended:].argmax(1)
    # rows of one word, and the longest rows
    single = (n == 1).nonzero()[0]
    out[begin[single]] = scores[begin[single]].argmax(1)
    last = (n == n[0]).nonzero()[0]
    if n[0] > 1:
        out[begin[last] + n[0] - 1] = best[: len(last)].argmax(1)
    for t in range(n[0] - 1, 0, -1):
        rows = begin[: alive[t]] + t
        now = out[rows]
        out[rows - 1] = np.where(jumped[rows, now], source[rows], now)
    return out


def label(docs: DataFrame, model: Model, with_spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (and spans: the labels of runs of words with the words of each) of every row."""
    width = len(model.langs)

    def parts(batches):
        for batch in batches:
            bounds = text_bytes(batch.column(1))[1]
            for first, last in steps(bounds, VITERBI_BYTES):
                yield batch.slice(first, last - first)

    def run(batches):
        for batch in parts(batches):
            column = batch.column(1)
            data, bounds = text_bytes(pc.utf8_lower(column))
            lang, share, spans = [], [], []
            if width:
                scores, sizes, at = word_scores(model, data, bounds)
                labels = viterbi(scores, at)
                edge = np.sort(scores, axis=1)
                sure = 1 / (1 + np.exp(-(edge[:, -1] - (edge[:, -2] if width > 1 else 0))))
            for i, text in enumerate(column):
                raw = text.as_py()
                if not width or raw is None or not _LETTER.search(raw):
                    lang.append("und")
                    share.append(0.0)
                    spans.append([])
                    continue
                a, b = at[i], at[i + 1]
                if a == b:
                    lang.append("und")
                    share.append(0.0)
                    spans.append([])
                    continue
                letters = np.bincount(labels[a:b], sizes[a:b], width)
                top = int(letters.argmax())
                mine = labels[a:b] == top
                lang.append(model.langs[top])
                share.append(float((sizes[a:b] * sure[a:b])[mine].sum() / letters.sum()))
                if with_spans:
                    cut = np.flatnonzero(np.diff(labels[a:b])) + 1
                    ends = [*cut.tolist(), int(b - a)]
                    spans.append([{"lang": model.langs[labels[a + e - 1]], "first": s, "last": e - 1} for s, e in zip([0, *ends[:-1]], ends, strict=True)])
            out = [batch.column(0), pa.array(lang, pa.string()), pa.array(share, pa.float64())]
            names = ["doc_id", "lang_pred", "score"]
            if with_spans:
                out.append(pa.array(spans, pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, lang_pred string, score double" + (", spans array<struct<lang string, first long, last long>>" if with_spans else "")
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
