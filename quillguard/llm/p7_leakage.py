"""Evaluation texts leaking into training text (problem 7): winnowing."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Named, map_rows, table
from .leakage import Index, gram_hashes
from .tokens import words

MAX_ITEMS = 20_000  # test items up to which every worker holds an index of all
MAX_CHARS = 40_000_000  # characters of those items
_FOUND = ("n_intact", "n_span", "first_word", "last_word")


@lru_cache(2)
def _index(ref: Named) -> Index:
    """The index of a broadcast of test items, once in each worker."""
    return Index(ref.value)


def bounded(items: DataFrame, key: str, text: str) -> Named | None:
    """A broadcast of the test items if they are within MAX_ITEMS and MAX_CHARS, else None."""
    items = items.select(key, text).where(F.col(key).isNotNull() & (F.col(text) != "")).distinct()
    size = items.agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars")).first()
    if size["n"] > MAX_ITEMS or (size["chars"] or 0) > MAX_CHARS:
        return None
    return Named(items.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in items.collect()]))


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """Leaked stretches of test items, one row each: key, item_id, n_intact, n_span, first_word, last_word.

    Every document is fingerprinted (least of each WINDOW K-word fingerprints), the fingerprints are joined
    with those of the test items, and the hits are extended both ways to the furthest place for each number of
    errors.  Guarantee: each shared run of K + WINDOW - 1 = 5 words is met, and a stretch of sixteen words with two
    altered has one, wherever in between the altered words stand.  A test set within MAX_ITEMS and MAX_CHARS is an
    index that every worker holds; for a larger one both sides' fingerprints are joined in Spark, with the same
    result.  Null and empty texts leak nothing; repeated documents give repeated rows; an empty test set gives no row.
    """
    ref = bounded(items, item_key, text)
    kinds = f"{key} {dict(documents.dtypes)[key]}, {item_key} {dict(items.dtypes)[item_key]}, " + ", ".join(f"{x} int" for x in _FOUND)
    if ref is None:
        return joined_leaks(documents, items, key, item_key, text, kinds)

    def make():
        index = _index(ref)

        def f(c):
            rows = {n: [] for n in (key, item_key, *_FOUND)}
            for k, t in zip(c[key], c[text]):
                for hit in index.search(t):
                    for n, x in zip(rows, (k, *hit)):
                        rows[n].append(x)
            return rows

        return f

    return map_rows(documents.select(key, text), make, kinds)


def fingerprints(df: DataFrame, key: str, text: str, every: bool) -> DataFrame:
    """key, gram: the K-word fingerprints of each text, once each; all of them, or the winnowed."""

    def make():
        def f(c):
            out = {key: [], "gram": []}
            for k, t in zip(c[key], c[text]):
                for h in set(gram_hashes(words(t or ""), every)):
                    out[key].append(k)
                    out["gram"].append(h)
            return out

        return f

    return map_rows(df.select(key, text), make, f"{key} {dict(df.dtypes)[key]}, gram bigint")


def joined_leaks(documents: DataFrame, items: DataFrame, key: str, item_key: str, text: str, kinds: str) -> DataFrame:
    """``leaks`` for a test set of any size: fingerprints meet in a join, only texts that share one are compared.

    The fingerprints of the test items are the smaller side by far; those of the documents that no item has are
    dropped by it before they are shuffled on (a semi-join on the distinct fingerprints, whose size is that of the
    test set), and a fingerprint that many documents have is split by adaptive execution.
    """
    # sides with names of their own, so that columns of the tables may clash
    docs = documents.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).distinct()
    tests = items.where(F.col(item_key).isNotNull()).select(F.col(item_key).alias("i"), F.col(text).alias("u")).distinct()
    grams = fingerprints(tests, "i", "u", True)
    met = fingerprints(docs, "k", "t", False).join(grams, "gram").select("k", "i").distinct()

    def make():
        last: list = [None, None, None]

        def f(c):
            rows = {n: [] for n in (key, item_key, *_FOUND)}
            for k, t, i, u in zip(c["k"], c["t"], c["i"], c["u"]):
                if last[0] != (i, u):
                    last[0], last[1] = (i, u), Index([(i, u)])
                for hit in last[1].search(t):
                    for n, x in zip(rows, (k, *hit)):
                        rows[n].append(x)
            return rows

        return f

    return map_rows(met.join(docs, "k").join(tests, "i").sortWithinPartitions("i"), make, kinds)


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked stretches with their extent; a document delivered twice counts once."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the test items that leaked into them."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()
