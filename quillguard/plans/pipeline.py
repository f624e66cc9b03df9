"""The whole batch as one plan: files, pages and identities to hits, masked texts and the report."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import patterns as P
from ..functions import text as T
from ..operators import hits, identity, ocr, regions, report


def dossier_names(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """dossier_id, doc_id, name, origin of first pages: labels, and recipients of attestations."""
    first = pages.where((F.col("page_no") == 1) & (F.trim(text) != "")).select("dossier_id", "doc_id", T.label_ready(text).alias(text))
    label = first.select("dossier_id", "doc_id", identity.label_candidate(text).alias("name"), F.lit("label").alias("origin"))
    attest = first.select("dossier_id", "doc_id", F.explode(identity.attestation_candidates(text)).alias("name"), F.lit("attestation").alias("origin"))
    return label.where("name is not null").unionByName(attest)


@lru_cache(10_000)
def _matcher(terms: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t))), re.I)


@F.pandas_udf(StringType())
def without_terms(text: pd.Series, terms: pd.Series) -> pd.Series:
    """Terms replaced; the pattern of a dossier is made once in each worker."""
    return pd.Series([t if t is None or x is None or not len(x) else _matcher(tuple(x)).sub("[PERSON]", t) for t, x in zip(text, terms)], dtype=object)


def mask_pages(pages: DataFrame, terms: DataFrame, text: str = "raw_text") -> DataFrame:
    """Pages with e-mails, phones and the terms of their dossier replaced by the name of their entity."""
    joined = hits.with_terms(pages, terms, "dossier_id", "page_id", "left", pages)
    plain = hits.masked(hits.masked(text, P.EMAIL, "[EMAIL_ADDRESS]"), P.PHONE, "[PHONE_NUMBER]")
    return joined.withColumn("masked", without_terms(plain, F.col("terms"))).drop("terms")


def batch(files: DataFrame, pages: DataFrame, terms: DataFrame, text: str = "raw_text") -> DataFrame:
    """One record for each file: action, status, error, pages, scanned or not, entities found on searchable pages (before
    boxes within others are left out) and the number of boxes that are covered.

    A file that has no page to work on although its kind is redacted is an error, as one that cannot be opened; files
    that are only copied have nothing found.  Pages of scanned files wait for recognition (``ocr.classify``).
    """
    f = report.dispatch(report.delivered(files))
    s = ocr.scanned(pages)
    # only files that are opened, and whose text is searched, have boxes
    searched = f.where("not unprotected").join(s.where("not is_scanned").select("doc_id"), "doc_id").select("doc_id")
    boxes = regions.page_regions(pages.join(searched, "doc_id", "left_semi"), terms, ["page_id"], text).join(pages.select("page_id", "doc_id"), "page_id")
    n = lambda e: F.count_if(F.col("entity") == e)
    entities = F.create_map(*[x for e in report.ENTITIES for x in (F.lit(e), n(e))]).alias("entities_found")
    counts = boxes.groupBy("doc_id").agg(entities, F.count_if("kept").alias("total_redactions"))
    none = F.create_map(*[x for e in report.ENTITIES for x in (F.lit(e), F.lit(0).cast("bigint"))])
    failed = ~F.col("unprotected") & F.col("n_pages").isNull()
    return f.join(s, "doc_id", "left").join(counts, "doc_id", "left").select(
        "dossier_id", "doc_id", "rel_path", "action", F.when(failed, "error").otherwise("success").alias("status"), F.when(failed, "no page").alias("error"),
        F.coalesce("n_pages", F.lit(0)).alias("pages_processed"), F.coalesce("is_scanned", F.lit(False)).alias("is_scanned"),
        F.coalesce("entities_found", none).alias("entities_found"), F.coalesce("total_redactions", F.lit(0)).alias("total_redactions"),
    )


def audit(files: DataFrame, pages: DataFrame) -> DataFrame:
    """One record for each file: action, scanned or not, pages and raw hits by entity; each page comes once."""
    f = report.dispatch(report.delivered(files))
    s = ocr.scanned(pages)
    found = hits.phone_hits(pages, ["doc_id"], "raw_text").select("doc_id", "entity")
    found = found.unionByName(hits.email_hits(pages, ["doc_id"], "raw_text").select("doc_id", "entity"))
    counts = report.summary_map(report.entity_counts(found, ["doc_id"]), ["doc_id"])
    return f.join(s, "doc_id", "left").join(counts, "doc_id", "left").select(
        "dossier_id", "doc_id", "rel_path", "action", "unprotected", F.coalesce("n_pages", F.lit(0)).alias("pages_processed"), F.coalesce("is_scanned", F.lit(False)).alias("is_scanned"), "entities_found"
    )
