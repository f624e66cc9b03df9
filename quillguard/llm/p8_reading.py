"""Reading level of each document (problem 8): pairwise ranker with isotonic levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import reading
from .common import Named, Ref, hashed_sample, map_rows, table, text_models
from .leakage import Index
from .p7_leakage import _index, bounded, leaks

FIT_LABELLED = 4000  # rated documents on which the ranker is fitted, chosen by hashed id
MIN_WORDS = 40  # words, separated by white space, of a document that gets a level


def skipped(index: Index | None, text: str, spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans of words (first, end) of all leaked passages; those that meet are joined, so that no word counts twice."""
    found = [(a, b + 1) for _, _, _, a, b in index.search(text)] if index else []
    out: list[tuple[int, int]] = []
    for a, b in sorted(found + [(x["first_word"], x["last_word"] + 1) for x in spans or ()]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def with_spans(documents: DataFrame, items: DataFrame, key: str, text: str) -> tuple[DataFrame, Named | None]:
    """Documents (key, text, spans), and the broadcast of the test items with which leaked passages are found where
    the text is read anyway; of a test set too large for that the spans of the leaked words are joined instead."""
    ref = bounded(items, "item_id", "text")
    if ref is not None:
        return documents.select(key, text, F.expr("cast(null as array<struct<first_word:int,last_word:int>>)").alias("spans")), ref
    found = leaks(documents, items, key, "item_id", text).groupBy(key).agg(F.collect_set(F.struct("first_word", "last_word")).alias("spans"))
    return documents.select(key, text).join(found, key, "left"), None


def featured(documents: DataFrame, ref: Ref, tests: Named | None, key: str = "doc_id", text: str = "text", state=None) -> DataFrame:
    """key, language, features of each document (of ``with_spans``) long enough; leaked passages do not count.
    With a ranker (``state``, a broadcast) its score and level instead of the features."""
    last = "features array<double>" if state is None else "score double, reading_level int"

    def make():
        model, _ = ref.models()
        index = _index(tests) if tests is not None else None
        ranker = None if state is None else state.value

        def f(c):
            out = {n: [] for n in (key, "language", *(("features",) if ranker is None else ("score", "reading_level")))}
            for k, t, spans in zip(c[key], c[text], c["spans"]):
                if not t or len(t.split()) < MIN_WORDS:
                    continue
                x = reading.features(t, skipped(index, t, spans))
                if x is None:
                    continue
                name = model.document(t)
                row = (k, name, x) if ranker is None else (k, name, s := ranker.score(name, x), ranker.level(s))
                for n, v in zip(out, row):
                    out[n].append(v)
            return out

        return f

    kind = dict(documents.dtypes)[key]
    return map_rows(documents.select(key, text, "spans"), make, f"{key} {kind}, language string, {last}")


def grades(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Median rating of each rated document; null ratings and repeated rows do not count."""
    return labels.where(F.col("reading_level").isNotNull()).distinct().groupBy(key).agg(F.median("reading_level").alias("grade"))


def fit(documents: DataFrame, rated: DataFrame, ref: Ref, tests: Named | None, key: str = "doc_id", text: str = "text") -> reading.Ranker:
    """Ranker from a bounded sample of rated documents (key, grade)."""
    sample = documents.join(F.broadcast(rated.select(key)), key, "left_semi")
    rows = featured(sample, ref, tests, key, text).join(F.broadcast(rated), key).select("language", "features", "grade").collect()  # at most 2 * FIT_LABELLED rows
    return reading.train([(r[0], list(r[1]), r[2]) for r in sorted(rows)])


def levels(documents: DataFrame, labels: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, language, score, reading_level of every document of at least MIN_WORDS words.

    Null, empty and shorter texts get no level.  Without any rating no document gets one.
    """
    ref = Ref(text_models(documents.sparkSession, documents))
    documents, tests = with_spans(documents, items, key, text)
    rated = hashed_sample(grades(labels, key), key, FIT_LABELLED)
    if labels.where(F.col("reading_level").isNotNull()).isEmpty():
        return featured(documents.limit(0), ref, tests, key, text).select(key, "language", F.lit(0.0).alias("score"), F.lit(0).alias("reading_level"))
    model = fit(documents, rated, ref, tests, key, text)
    return featured(documents, ref, tests, key, text, documents.sparkSession.sparkContext.broadcast(model))


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, score and level of each document."""
    out = levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"), table(spark, sf_dir, "eval_items"))
    return out.dropDuplicates(["doc_id"])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level of every document of at least forty words."""
    return p8_levels(spark, sf_dir).select("doc_id", "reading_level")


def p8_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a level, and whether it is one of the scale."""
    return p8_found(spark, sf_dir).select("doc_id", F.col("reading_level").between(1, 4).alias("on_scale"))


SQL = {"p8_covered": "SELECT DISTINCT doc_id, true AS on_scale FROM documents WHERE len(list_filter(string_split_regex(text, '[\\s\\p{Z}\\x0B\\x{0085}\\x{001C}-\\x{001F}]+'), lambda x: x <> '')) >= 40"}
