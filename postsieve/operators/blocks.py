"""Weighted TF-IDF blocks and scaled signals of mail rows, as one sparse vector a row.

A vocabulary is counted in Spark and comes to the driver: its size is bounded by the blocks' caps.
Runs of rows are encoded at once: distinct tokens are looked up in one call a block, and what is
kept of a row are ascending positions and counts.

Rows hold tokens (`frame`) or the words that tokens are made of (`texts`), as a string in place of a list: pairs and
letters take many times the room of their words, so they are made where they are counted, of a run's distinct words.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import features as X
from ..functions.text import HEAD_CHARS, masked
from .ranks import running
from .tfidf import char_grams, grams, padded_words, words, words_and_pairs

#: Weight, most terms.  The header block's bound is ours; sender domains have none.
BLOCKS = {"subj": (2.0, 50_000), "body": (1.0, 200_000), "char": (1.0, 300_000), "hdr": (1.0, 300_000)}
WORDS = ("subj", "body")
#: What a term of each block is called, and what masks stand for.
PLACES = {"subj": "subject", "body": "body", "char": "letters", "hdr": "headers", "num": "measure"}
MASKED = [(r"(?<!\S)__url__(?!\S)", "(link)"), (r"(?<!\S)__email__(?!\S)", "(address)"), (r"(?<!\S)__num__(?!\S)", "(number)")]
#: Tokens that a task counts at once at most, or those of one row.
TOKENS = 1 << 20
SITE = re.compile(r"(?<!\S)urldom_(\S+)")
KINDS = {"full": tuple(BLOCKS), "words": WORDS}


def frame(mail: DataFrame, *keep: str) -> DataFrame:
    """keep, one array of tokens per block, num, the 13 signals after log1p, and _at.  Null texts count as empty.

    _at only keeps these columns in a projection of their own: merged into a Python call,
    Spark leaves the call inside its expression and fails with "cannot evaluate".
    """
    return _made(mail, keep, words_and_pairs, char_grams)


def texts(mail: DataFrame, *keep: str) -> DataFrame:
    """What frame gives, with the words of subj, body and char as one string each."""
    joined = lambda made: lambda text: F.array_join(made(text), " ")
    return _made(mail, keep, joined(words), joined(padded_words))


def _made(mail: DataFrame, keep: tuple[str, ...], said: Callable, spelt: Callable) -> DataFrame:
    m = mail
    for c in ("subject", "text", "from_addr", "reply_to"):
        m = m.withColumn(c, F.coalesce(c, F.lit("")))
    head = F.concat(m["subject"], F.lit("\n"), F.substring(m["text"], 1, HEAD_CHARS))
    hdr = F.split(X.header_tokens(m["headers"], m["from_addr"], m["reply_to"]), r"(?U)\s+")
    num = F.array(*[F.log1p(c) for c in X.structural(m)])
    return m.select(*keep, said(masked(m["subject"])).alias("subj"), said(masked(m["text"])).alias("body"), spelt(head).alias("char"), hdr.alias("hdr"), num.alias("num"), F.monotonically_increasing_id().alias("_at"))


@dataclass
class Scaling:
    """What turns counts into values: idf of each position (0 where the term is not known) and the signals' mean and deviation."""

    idf: np.ndarray
    mean: np.ndarray
    std: np.ndarray


@dataclass
class Vocabulary:
    """terms and idf per block in the order of the vector, then the signals' mean and deviation."""

    terms: dict[str, list[str]]
    idf: dict[str, np.ndarray]
    mean: np.ndarray
    std: np.ndarray

    def __post_init__(self):
        self.start, n = {}, 0
        for b, t in self.terms.items():
            self.start[b] = n
            n += len(t)
        self.n_terms = n
        self.n_words = sum(len(self.terms[b]) for b in WORDS if b in self.terms)
        self.size = n + len(self.mean)

    @cached_property
    def at(self) -> dict[str, dict[str, int]]:
        return {b: {x: i for i, x in enumerate(t)} for b, t in self.terms.items()}

    def scaling(self) -> Scaling:
        return Scaling(np.concatenate([np.zeros(0), *self.idf.values()]), self.mean, self.std)

    def name(self, i: int) -> str:
        """A readable name of position i."""
        for b, t in self.terms.items():
            if self.start[b] <= i < self.start[b] + len(t):
                return pretty(b, t[i - self.start[b]])
        return pretty("num", X.STRUCTURAL[i - (self.size - len(self.mean))])

    def to_json(self) -> str:
        return json.dumps({"terms": self.terms, "idf": {b: v.tolist() for b, v in self.idf.items()}, "mean": self.mean.tolist(), "std": self.std.tolist()})

    @staticmethod
    def from_json(text: str) -> Vocabulary:
        d = json.loads(text)
        return Vocabulary(d["terms"], {b: np.array(v) for b, v in d["idf"].items()}, np.array(d["mean"]), np.array(d["std"]))


def pretty(block: str, term: str) -> str:
    """A term as a reader sees it, and where it stands: `win (number) [subject]`; letters keep their blanks in quotes."""
    for mask, shown in MASKED:
        term = re.sub(mask, shown, term)
    term = SITE.sub(lambda m: m[1].replace("_", "."), term)
    return f"{term!r} [{PLACES['char']}]" if block == "char" else f"{term} [{PLACES.get(block, block)}]"


def _places(kind: str) -> tuple[str, ...]:
    if kind not in KINDS:
        raise ValueError(f"unknown feature kind {kind!r}: full or words")
    return KINDS[kind]


def learn(rows: DataFrame, kind: str = "full", min_df: int = 2) -> Vocabulary:
    """The terms in min_df rows (header terms: one), the most frequent first, up to the block's bound."""
    vocabulary, scalings = learn_without(rows.withColumn("_part", F.lit(0)), "_part", [-1], kind, min_df)
    idf = {b: scalings[0].idf[vocabulary.start[b] : vocabulary.start[b] + len(t)] for b, t in vocabulary.terms.items()}
    return Vocabulary(vocabulary.terms, idf, scalings[0].mean, scalings[0].std)


def pieces(batch: pa.RecordBatch, names: Iterable[str], most: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with up to `most` tokens: what is counted of a batch takes many times its room."""
    n = sum(_tokens(batch.column(b), b) for b in names)
    ends, first = np.concatenate([[0], np.cumsum(n)]), 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def _tokens(column: pa.Array, block: str) -> np.ndarray:
    """The number of tokens of each row of a block; of words as a string, a bound."""
    if not pa.types.is_string(column.type):
        n = pc.list_value_length(column)
    else:
        # a word of n characters between blanks has 3 * n - 3 grams, but 1 of one character
        n = pc.multiply(pc.utf8_length(column), 3) if block == "char" else pc.multiply(pc.add(pc.count_substring(column, " "), 1), 2)
    return pc.fill_null(n, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def coded(column: pa.Array, block: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each token its row and its number among distinct tokens, and these."""
    text = pa.types.is_string(column.type)
    lists = pc.split_pattern(column, " ") if text else column
    flat = lists.flatten().cast(pa.string()).dictionary_encode()
    code, known = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary
    row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    if not text:
        return row, code, known
    # of an empty string a split leaves an empty word
    blank = known.index("").as_py()
    if blank >= 0:
        row, code = row[code != blank], code[code != blank]
    if block == "char":
        starts, n, of, known = grams(known)
        ends = np.cumsum(n[code])
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[code] - ends + n[code], n[code])
        return np.repeat(row, n[code]), of[at], known
    next_to = np.flatnonzero(row[1:] == row[:-1])
    pair, of = np.unique(code[next_to] * len(known) + code[next_to + 1], return_inverse=True)
    first, second = (known.take(pa.array(x)) for x in np.divmod(pair, max(len(known), 1)))
    return np.concatenate([row, row[next_to]]), np.concatenate([code, of + len(known)]), pa.concat_arrays([known, pc.binary_join_element_wise(first, second, " ")])


def _seen(rows: DataFrame, part: str, places: tuple[str, ...]) -> DataFrame:
    """part, block, term, df, cf: counts of runs of rows, of which a term has several; tokens themselves are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, places, TOKENS)):
            own = pc.dictionary_encode(batch.column("part"), null_encoding="encode")
            of, parts = own.indices.to_numpy(), own.dictionary
            for b in places:
                row, code, known = coded(batch.column(b), b)
                size = len(known)
                at, tf = np.unique(row * max(size, 1) + code, return_counts=True)
                key = of[at // max(size, 1)].astype(np.int64) * size + at % max(size, 1)
                df, cf = (np.bincount(key, w, len(parts) * size).astype(np.int64) for w in (None, tf))
                some = np.flatnonzero(df)
                if len(some):
                    yield pa.RecordBatch.from_arrays([parts.take(pa.array(some // size)), pa.array([b] * len(some), pa.string()), known.take(pa.array(some % size)), pa.array(df[some]), pa.array(cf[some])], ["part", "block", "term", "df", "cf"])

    counted = rows.select(F.col(part).alias("part"), *places)
    return counted.mapInArrow(run, f"part {counted.schema['part'].dataType.simpleString()}, block string, term string, df long, cf long")


def known_without(rows: DataFrame, part: str, left_out: list[int], kind: str = "full", min_df: int = 2) -> DataFrame:
    """block, term, and for each part i of left_out cf<i> and df<i> in the rows outside it, the latter null where too few rows have the term; terms that are known nowhere have no row.

    Counts are taken once, per term and part; those without a part are the sum less the part's own.
    """
    every = _seen(rows, part, _places(kind))
    less = lambda c, k: F.sum(F.when(F.col("part") != k, F.col(c)).otherwise(0))
    counts = every.groupBy("block", "term").agg(*[less(c, k).alias(f"{c}{i}") for i, k in enumerate(left_out) for c in ("df", "cf")])
    enough = [F.col(f"df{i}") >= F.when(F.col("block") == "hdr", 1).otherwise(min_df) for i in range(len(left_out))]
    known = counts.select("block", "term", *[F.when(ok, F.col(f"df{i}")).alias(f"df{i}") for i, ok in enumerate(enough)], *[f"cf{i}" for i in range(len(left_out))])
    return known.where(F.coalesce(*[F.col(f"df{i}") for i in range(len(left_out))]).isNotNull())


def learn_without(rows: DataFrame, part: str, left_out: list[int], kind: str = "full", min_df: int = 2) -> tuple[Vocabulary, list[Scaling]]:
    """What learn finds in the rows outside each part of left_out: the union of their terms, up to the blocks' bounds, and a Scaling for each."""
    places = _places(kind)
    known = known_without(rows, part, left_out, kind, min_df).persist()
    sizes = {r["block"]: r[1:] for r in known.groupBy("block").agg(*[F.count(f"df{i}") for i in range(len(left_out))]).collect()}
    taken = _within(known, {(b, i): n[i] for b, n in sizes.items() for i in range(len(left_out)) if n[i] > BLOCKS[b][1]})
    # the caps bound what comes to the driver, the order is that of strings as bytes
    t = taken.select("block", "term", "cf0", *[F.coalesce(f"df{i}", F.lit(0)).alias(f"df{i}") for i in range(len(left_out))]).toArrow().sort_by([("cf0", "descending"), ("term", "ascending")])
    terms, dfs = {}, []
    for b in places:
        own = t.filter(pc.equal(t["block"], b))
        terms[b] = own["term"].to_pylist()
        dfs.append(np.column_stack([own[f"df{i}"].to_numpy() for i in range(len(left_out))]).reshape(-1, len(left_out)))
    known.unpersist()
    df = np.concatenate(dfs)
    width = len(X.STRUCTURAL) if kind == "full" else 0
    moments = _moments(rows, part, width)
    vocabulary = Vocabulary(terms, {b: np.ones(len(t)) for b, t in terms.items()}, np.zeros(width), np.ones(width))
    return vocabulary, [_scaling(df[:, i], [r for r in moments if r[0] != k], width) for i, k in enumerate(left_out)]


def _within(known: DataFrame, full: dict[tuple[str, int], int]) -> DataFrame:
    """known, with df<i> null where a full (block, i) has as many terms as it may before this one, the most frequent first; terms left without any go.

    A count decides for most terms, from how many terms have which; those of the last count that fits are placed by term.
    """
    dfs = [c for c in known.columns if c.startswith("df")]
    if full:
        each = F.filter(F.array(*[F.struct(F.lit(b).alias("of"), F.lit(i).alias("i"), F.col(f"df{i}").alias("df"), F.col(f"cf{i}").alias("cf")) for b, i in full]), lambda x: (x["of"] == F.col("block")) & x["df"].isNotNull())
        apart = known.select("block", "term", F.inline(each)).select("block", "i", "term", "cf")
        least, room = {}, {}
        for b, i in full:
            room[b, i] = BLOCKS[b][1]
        for r in apart.groupBy("block", "i", "cf").count().orderBy(F.desc("cf")).toLocalIterator():
            k = r["block"], r["i"]
            if k not in least:
                if r["count"] > room[k]:
                    least[k] = r["cf"]
                else:
                    room[k] -= r["count"]
        pick = lambda of: F.element_at(F.create_map(*[F.lit(x) for (b, i), v in of.items() for x in (f"{b} {i}", v)]), F.concat_ws(" ", "block", "i"))
        placed = running(apart.where(F.col("cf") == pick(least)), [F.col("term")], {"place": F.lit(1)}, ["block", "i"])
        over = placed.where(F.col("place") > pick(room)).groupBy("block", "term").agg(F.collect_set("i").alias("over"))
        known = known.join(over, ["block", "term"], "left")
        for i in sorted({i for _, i in full}):
            low = F.create_map(*[F.lit(x) for (b, j), v in least.items() if j == i for x in (b, v)])
            out = (F.col(f"cf{i}") < F.try_element_at(low, F.col("block"))) | F.array_contains("over", i)
            known = known.withColumn(f"df{i}", F.when(~F.coalesce(out, F.lit(False)), F.col(f"df{i}")))
    return known.where(F.coalesce(*dfs).isNotNull())


def _moments(rows: DataFrame, part: str, width: int) -> list:
    """By part the number of rows, and the means and variances of the signals."""
    return rows.groupBy(part).agg(F.count("*").alias("n"), *[f(F.col("num")[i]) for f in (F.avg, F.var_pop) for i in range(width)]).collect()


def signal_scaling(rows: DataFrame) -> Scaling:
    """The mean and deviation of the signals alone; no token is counted for it."""
    return _scaling(np.zeros(0), _moments(rows.select("num", F.lit(0).alias("part")), "part", len(X.STRUCTURAL)), len(X.STRUCTURAL))


def _scaling(df: np.ndarray, moments: list, width: int) -> Scaling:
    """From document frequencies, and the number, means and variances of the parts that count."""
    n = np.array([r["n"] for r in moments], float)
    each = np.array([[x or 0.0 for x in r[2:]] for r in moments], float).reshape(len(moments), 2 * width)
    total = max(n.sum(), 1.0)
    mean = n @ each[:, :width] / total
    std = np.sqrt(n @ (each[:, width:] + (each[:, :width] - mean) ** 2) / total)
    # terms that are not known have no row
    return Scaling(np.where(df > 0, np.log((1 + n.sum()) / (1 + df.astype(float))) + 1, 0.0), mean, np.where(std > 0, std, 1.0))


def counted(columns: Mapping[str, pa.Array], terms: dict[str, pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of token lists or words: the n + 1 bounds of its rows, ascending positions of known terms, and what stands for their counts."""
    size, start, keys, tfs = sum(map(len, terms.values())), 0, [], []
    n = len(next(iter(columns.values())))
    for b, known in terms.items():
        row, code, distinct = coded(columns[b], b)
        number = pc.fill_null(pc.index_in(distinct, value_set=known), -1).to_numpy().astype(np.int64)[code]
        key, tf = np.unique(row[number >= 0] * max(size, 1) + start + number[number >= 0], return_counts=True)
        keys.append(key)
        tfs.append(np.ones(len(tf)) if b == "hdr" else 1 + np.log(tf))
        start += len(known)
    key, tf = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0), *tfs])
    order = np.argsort(key, kind="stable")
    return np.searchsorted(key[order], np.arange(n + 1) * max(size, 1)), key[order] % max(size, 1), tf[order]


def shares(terms: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
    """First positions and weights of the blocks."""
    return np.concatenate([[0], np.cumsum([len(t) for t in terms.values()])[:-1]]).astype(np.int64), np.array([BLOCKS[b][0] for b in terms])


def valued(row: np.ndarray, at: np.ndarray, tf: np.ndarray, idf: np.ndarray, blocks: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Counts by idf, each block of a row of its weight's length."""
    x = tf * idf[at]
    own = np.searchsorted(blocks[0], at, "right") - 1
    key = row * len(blocks[0]) + own
    norm = np.sqrt(np.bincount(key, x * x))[key] if len(key) else x
    return np.divide(blocks[1][own] * x, norm, out=np.zeros_like(x), where=norm > 0)


def signals(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each of the n rows that lie between n + 1 bounds, the sum."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]))
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(values, bounds[some], axis=0)
    return out


def _shared(rows: DataFrame, v: Vocabulary, *more):
    """Broadcast: its size is bounded by the blocks' caps."""
    return rows.sparkSession.sparkContext.broadcast(({b: pa.array(t, pa.string()) for b, t in v.terms.items()}, v.scaling(), *more))


def _encoded(f: pa.StructArray | pa.RecordBatch, terms: dict[str, pa.Array], scaling: Scaling) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """In runs of rows these, their bounds, ascending positions and values of the terms, and the scaled signals as a matrix."""
    rows, first = pa.RecordBatch.from_struct_array(f) if isinstance(f, pa.StructArray) else f, 0
    for part in pieces(rows, terms, TOKENS) if terms else [rows]:
        columns = {c: part.column(c) for c in (*terms, "_at")}
        bounds, at, tf = counted(columns, terms)
        x = valued(np.repeat(np.arange(part.num_rows), np.diff(bounds)), at, tf, scaling.idf, shares(terms))
        num = (signals(part.column("num")) - scaling.mean) / scaling.std if len(scaling.mean) else np.zeros((part.num_rows, 0))
        yield slice(first, first + part.num_rows), bounds, at, x, num
        first += part.num_rows


def vectors(rows: DataFrame, v: Vocabulary, *keep: str) -> DataFrame:
    """keep, at and value: the ascending positions of a row that are not empty, the signals' last, and what stands there."""
    shared, held = _shared(rows, v), rows.select(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, scaling = shared.value
        for batch in batches:
            for own, bounds, at, x, num in _encoded(batch, terms, scaling):
                wide = num.shape[1]
                end = len(scaling.idf) + np.arange(wide)
                ats = [np.concatenate([at[a:b], end]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                values = [np.concatenate([x[a:b], s]) for a, b, s in zip(bounds[:-1], bounds[1:], num, strict=True)]
                to = (bounds + wide * np.arange(len(bounds))).astype(np.int32)
                flat = lambda parts, kind: np.concatenate([np.zeros(0), *parts]).astype(kind)
                made = [pa.ListArray.from_arrays(to, flat(ats, np.int32)), pa.ListArray.from_arrays(to, flat(values, float))]
                yield pa.RecordBatch.from_arrays([*batch.slice(own.start, own.stop - own.start).columns[: len(keep)], *made], [*keep, "at", "value"])

    shape = "".join(f"`{c.name}` {c.dataType.simpleString()}, " for c in held.schema)
    return rows.select(*keep, *_columns(v)).mapInArrow(run, f"{shape}at array<int>, value array<double>")


def _columns(v: Vocabulary) -> list[str]:
    """What a vocabulary asks of a row: its blocks, and the signals if it has them."""
    return [*v.terms, *(["num"] if len(v.mean) else []), "_at"]


def _blocks(v: Vocabulary) -> Column:
    return F.struct(*_columns(v))


#: Products of values with coefficients that are held at once.
CELLS = 1 << 22


def margins(rows: DataFrame, v: Vocabulary, coefs: np.ndarray, intercepts: np.ndarray) -> Column:
    """One margin per row of coefs."""
    shared = _shared(rows, v, np.ascontiguousarray(np.asarray(coefs).T), np.asarray(intercepts))

    @F.arrow_udf("array<double>")
    def score(f: pa.Array) -> pa.Array:
        terms, scaling, w, b = shared.value
        out = np.zeros((len(f), w.shape[1]))
        for rows, bounds, at, x, num in _encoded(f, terms, scaling):
            made = num @ w[len(scaling.idf) :] + b
            step = max(1, CELLS // max(1, w.shape[1] * int(np.diff(bounds).max(initial=1))))
            for a in range(0, len(made), step):
                own = bounds[a : a + step + 1]
                part = slice(own[0], own[-1])
                made[a : a + step] += sums(w[at[part]] * x[part, None], own - own[0])
            out[rows] = made
        return pa.ListArray.from_arrays(np.arange(len(f) + 1, dtype=np.int32) * w.shape[1], out.ravel())

    return score(_blocks(v))


def strongest(bounds: np.ndarray, at: np.ndarray, x: np.ndarray, num: np.ndarray, w: np.ndarray, top_k: int) -> list[list[tuple[int, float]]]:
    """Of each row the top_k positions whose values times w are largest, by size to 12 places, then by position, and these products."""
    wide, out = num.shape[1], []
    c, last = x * w[at], num * w[len(w) - wide :]
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        own, where = np.concatenate([c[a:b], last[i]]), np.concatenate([at[a:b], len(w) - wide + np.arange(wide)])
        size = np.abs(own.round(12))
        if len(own) > 4 * top_k:
            # all that may be among the top_k, ties included
            some = np.flatnonzero(size >= np.partition(size, -top_k)[-top_k])
            own, where, size = own[some], where[some], size[some]
        out.append([(int(where[j]), float(own[j])) for j in np.lexsort((where, -size)) if own[j] != 0][:top_k])
    return out


def contributions(rows: DataFrame, v: Vocabulary, coef: np.ndarray, top_k: int = 8) -> Column:
    """The top_k values times coefficients by size to 12 places, then by position, as (feature, weight)."""
    shared = _shared(rows, v, v, np.asarray(coef))

    @F.arrow_udf("array<struct<feature:string,weight:double>>")
    def reasons(f: pa.Array) -> pa.Array:
        terms, scaling, known, w = shared.value
        out = [row for _, bounds, at, x, num in _encoded(f, terms, scaling) for row in strongest(bounds, at, x, num, w, top_k)]
        out = [[{"feature": known.name(i), "weight": c} for i, c in own] for own in out]
        return pa.array(out, pa.list_(pa.struct([("feature", pa.string()), ("weight", pa.float64())])))

    return reasons(_blocks(v))
