"""TF-IDF as relations: terms, document frequencies, weights."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import once

WORD = r"(?U)\b\w\w+\b"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def words_and_pairs(text: Column) -> Column:
    def pairs(w: Column) -> Column:
        last = F.greatest(F.size(w) - 1, F.lit(0))
        return F.concat(w, F.zip_with(F.slice(w, 1, last), F.slice(w, 2, last), lambda a, b: F.concat_ws(" ", a, b)))

    return once(words(text), pairs)


def padded_words(text: Column) -> Column:
    """The words that char_grams pads, as they are."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda x: x != "")


def char_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words padded by a blank each side; a word shorter than n counts once."""
    padded = F.transform(padded_words(text), lambda x: F.concat(F.lit(" "), x, F.lit(" ")))

    def slid(w: Column, n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))
        # a padded word of fewer characters counts once, at the smallest n
        return F.when(F.length(w) >= n, grams).otherwise(F.array(w) if n == low else F.array().cast("array<string>"))

    def of(w: Column) -> Column:
        return F.concat(*[slid(w, n) for n in range(low, high + 1)])

    return F.flatten(F.transform(padded, of))


def grams(words: pa.Array, low: int = 3, high: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """What char_grams gives of distinct words: where a word's grams start, how many it has, the grams' numbers, and the distinct grams."""
    text = "".join(f" {w} " for w in words.to_pylist())
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    ends = np.cumsum(length)
    left = np.repeat(ends, length) - np.arange(len(text))
    word = np.repeat(np.arange(len(length)), length)
    letters, code = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    at, number, found, of, owner = np.arange(len(text)), code.astype(np.int64), [], [], []
    for n in range(2, high + 1):
        # a gram is the one that is shorter by a letter, and that letter
        fits = left[at] >= n
        at, number = at[fits], number[fits]
        _, first, number = np.unique(number * len(letters) + code[at + n - 1], return_index=True, return_inverse=True)
        if n >= low:
            of.append(number + len(found))
            owner.append(word[at])
            found += [text[i : i + n] for i in at[first].tolist()]
    owner, of = np.concatenate(owner), np.concatenate(of)
    n = np.bincount(owner, minlength=len(length))
    return np.cumsum(n) - n, n, of[np.argsort(owner, kind="stable")], pa.array(found, pa.string())


def term_counts(docs: DataFrame, key: str, terms: Column) -> DataFrame:
    """key, term, tf.  Documents are dealt by key as they are: their text takes less room than their terms, which then need no shuffle."""
    return docs.repartition(key).select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequency(counts: DataFrame, min_df: int = 2) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= min_df)


def tfidf(docs: DataFrame, key: str, terms: Column, min_df: int = 2, sublinear: bool = True) -> DataFrame:
    """key, term, weight: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), rows of length one."""
    counts = term_counts(docs, key, terms)
    n = docs.agg(F.count("*").alias("docs"))
    tf = 1 + F.log("tf") if sublinear else F.lit(1.0)
    raw = counts.join(document_frequency(counts, min_df), "term").join(F.broadcast(n))
    raw = raw.select(key, "term", (tf * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1)).alias("raw"))
    # rows of a document meet once, here; what follows by document needs no shuffle
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(key)))
    return raw.select(key, "term", (F.col("raw") / norm).alias("weight"))
