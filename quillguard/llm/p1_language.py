"""Missing or wrong document language labels (problem 1): Bayesian evidence fusion.

Each stretch of full sentences of one language on a page brings text likelihoods.  They are fused with
what the file declares (its recorded languages), the suffixes of the addresses on the page, and a prior of
its host that is smoothed from the whole corpus to the dossier to the file; all three are learned from the
confident stretches by grouped aggregation, each stretch's own share left out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Ref, map_rows, materialize, salted_join, small_join, table, text_models
from .language import LANGS, stretches

CONFIDENT = 4.0  # log-odds from the text alone that make a stretch count in the evidence tables
SMOOTH = 20.0  # stretches that the parent's distribution weighs in its child's
EVIDENCE_WEIGHT = 0.5  # declared languages and address suffixes are correlated with the prior
_SUFFIX = re.compile(r"(?:@|\[at\]|\(at\))\s*([a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,})", re.I)
_DIAL = re.compile(r"(?:\+|\b00)(33|34|49|44|1|212|213|216|971)\b")


def segments(pages: DataFrame, ref: Ref) -> DataFrame:
    """Stretches of the pages: page_id, doc_id, dossier_id, seg_no, start, end, n_sentences, suffix, ll.

    Offsets are those of the stored text.  Pages without a full sentence give no row, nor do null texts.
    ``ll`` holds the log-likelihood for each of LANGS, relative to the best.
    """
    ids = ["page_id", "doc_id", "dossier_id"]
    rest = ["seg_no", "start", "end", "n_sentences", "suffix", "ll"]

    def make():
        model, repairer = ref.models()

        def f(c):
            out = {n: [] for n in (*ids, *rest)}
            for page, doc, dossier, text in zip(*(c[x] for x in ids), c["raw_text"]):
                sound, start, end, _, _ = repairer.map(text)
                found = stretches(sound, model)
                if not found:
                    continue
                m = _SUFFIX.search(sound) if "@" in sound or "at]" in sound else None
                m = m or (_DIAL.search(sound) if "+" in sound or "00" in sound else None)
                suffix = m[1].lower() if m else ""
                for no, (a, b, _, n, ll) in enumerate(found):
                    if start is not None:
                        a, b = start[a], end[b - 1]
                    for name, x in zip((*ids, *rest), (page, doc, dossier, no, a, b, n, suffix, list(ll))):
                        out[name].append(x)
            return out

        return f

    kinds = dict(pages.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in ids) + ", seg_no int, start int, end int, n_sentences int, suffix string, ll array<double>"
    return map_rows(pages.select(*ids, "raw_text").where(F.col("raw_text").isNotNull()), make, schema)


def _counts(label: Column) -> list[Column]:
    return [F.sum((label == x).cast("double")).alias(f"n_{x}") for x in LANGS]


def _array(prefix: str) -> Column:
    """Counts of a joined table as one array; zeros where nothing was joined."""
    return F.array(*[F.coalesce(F.col(f"{prefix}{x}"), F.lit(0.0)) for x in LANGS])


def _share(counts: Column, parent: Column) -> Column:
    """Counts of one level smoothed by the shares of the level above it."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, parent, lambda n, p: (F.greatest(n, F.lit(0.0)) + SMOOTH * p) / (F.greatest(total, F.lit(0.0)) + SMOOTH))


def _less(counts: Column, own: Column) -> Column:
    return F.zip_with(counts, own, lambda a, b: F.greatest(a - b, F.lit(0.0)))


def _rename(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({f"n_{x}": f"{prefix}{x}" for x in LANGS})


def fuse(seg: DataFrame, declared: DataFrame) -> DataFrame:
    """Language and confidence of each stretch from all evidence; pages without a file have the corpus's prior.

    ``declared``: doc_id, languages (array, null counts as empty).  What a stretch has itself brought to the counts
    of its file, its dossier, its file's declared set and its address suffix is taken out of them before they speak
    for it, so that no stretch confirms itself.  An address counts as the whole host, backed off to its last
    label.  Of files, dossiers and suffixes, one row each is joined; those that hold more than a hundredth of the
    rows, and rows without one, are spread over several tasks.
    """
    best = F.array_max("ll")
    label = F.element_at(F.array(*map(F.lit, LANGS)), F.array_position("ll", best).cast("int"))
    second = F.element_at(F.sort_array("ll", asc=False), 2)
    seg = seg.withColumn("label", F.when(best - second >= CONFIDENT, label)).withColumn("tld", F.regexp_extract("suffix", "[^.]+$", 0))
    sure = seg.where("label is not null")

    whole = sure.agg(*_counts(F.col("label"))).first()  # five numbers
    by_doc = materialize(sure.groupBy("doc_id").agg(F.min("dossier_id").alias("host"), *_counts(F.col("label"))))
    by_host = _rename(by_doc.where(F.col("host").isNotNull()).groupBy("host").agg(*[F.sum(f"n_{x}").alias(f"n_{x}") for x in LANGS]), "h_")
    named = sure.where(F.col("suffix") != "").groupBy("suffix", "tld").agg(*_counts(F.col("label")))
    by_suffix = _rename(named.drop("tld"), "s_")
    by_tld = _rename(named.groupBy("tld").agg(*[F.sum(f"n_{x}").alias(f"n_{x}") for x in LANGS]), "t_")
    decl = declared.groupBy("doc_id").agg(F.max(F.concat_ws(",", F.sort_array(F.coalesce("languages", F.array().cast("array<string>"))))).alias("declared"))
    # of a declared set: the files in which each language was found
    by_decl = by_doc.join(decl, "doc_id").groupBy("declared").agg(*[F.sum(F.least(f"n_{x}", F.lit(1.0))).alias(f"n_{x}") for x in LANGS]).transform(lambda d: _rename(d, "d_"))

    n = [whole[f"n_{x}"] or 0.0 for x in LANGS]
    base = F.array(*[F.lit((x + 1.0) / (sum(n) + len(LANGS))) for x in n])
    docs = seg.select("doc_id", "dossier_id").groupBy("doc_id").agg(F.min("dossier_id").alias("host")).join(_rename(by_doc.drop("host"), "f_"), "doc_id", "left").join(decl, "doc_id", "left")
    docs = small_join(salted_join(docs, by_host, "host", "doc_id", seg.withColumnRenamed("dossier_id", "host")), by_decl, "declared")
    docs = docs.select("doc_id", _array("f_").alias("f"), _array("h_").alias("h"), _array("d_").alias("d"))

    joined = salted_join(seg, docs, "doc_id", "page_id", seg)
    # the suffixes of most pages are empty and match nothing
    joined = salted_join(joined.withColumn("suffix", F.when(F.col("suffix") != "", F.col("suffix"))), by_suffix, "suffix", "page_id", seg.where("suffix <> ''"))
    joined = small_join(joined, by_tld, "tld")
    zero = F.array(*[F.lit(0.0)] * len(LANGS))
    own = F.array(*[F.coalesce((F.col("label") == x).cast("double"), F.lit(0.0)) for x in LANGS])
    file_ = F.coalesce("f", zero)
    host = _share(_less(F.coalesce("h", zero), own), base)
    prior = _share(_less(file_, own), host)
    evidence = _share(_less(F.coalesce("d", zero), F.transform(file_, lambda x: F.least(x, F.lit(1.0)))), base)
    with_host = F.col("suffix").isNotNull()
    suffix = _share(_less(_array("s_"), F.when(with_host, own).otherwise(zero)), _share(_less(_array("t_"), F.when(with_host, own).otherwise(zero)), base))
    joined = joined.select("*", prior.alias("prior"), evidence.alias("evidence"), suffix.alias("mail"))
    ratio = lambda c, i: EVIDENCE_WEIGHT * (F.log(F.col(c)[i]) - F.log(base[i]))
    post = F.array(*[F.col("ll")[i] + F.log(F.col("prior")[i]) + ratio("evidence", i) + ratio("mail", i) for i in range(len(LANGS))])
    joined = joined.withColumn("post", post)
    top = F.array_max("post")
    return joined.select(
        "page_id", "doc_id", "dossier_id", "seg_no", "start", "end", "n_sentences",
        F.element_at(F.array(*map(F.lit, LANGS)), F.array_position("post", top).cast("int")).alias("lang"),
        F.round(1.0 / F.aggregate(F.transform("post", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x), 6).alias("confidence"),
    )


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of each stretch of each page."""
    ref = Ref(text_models(spark, table(spark, sf_dir, "documents")))
    seg = materialize(segments(table(spark, sf_dir, "dossier_pages"), ref).dropDuplicates(["page_id", "seg_no"]))
    return fuse(seg, table(spark, sf_dir, "file_summaries").select("doc_id", F.col("languages_detected").alias("languages")))


def p1_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of each file with the share of its sentences and the least confidence of a stretch."""
    per = p1_segments(spark, sf_dir).groupBy("doc_id", "lang").agg(F.sum("n_sentences").alias("n_sentences"), F.min("confidence").alias("confidence"))
    return per


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose recorded languages are not those of their full sentences, with each real language."""
    real = p1_segments(spark, sf_dir).where("doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("lang")).alias("langs"))
    recorded = table(spark, sf_dir, "file_summaries").select("doc_id", F.explode_outer("languages_detected").alias("lang"))
    recorded = recorded.groupBy("doc_id").agg(F.sort_array(F.collect_set("lang")).alias("recorded"))
    return (
        real.join(recorded, "doc_id", "left")
        .where(~F.col("langs").eqNullSafe(F.coalesce("recorded", F.array().cast("array<string>"))))
        .select("doc_id", F.explode("langs").alias("lang"))
    )
