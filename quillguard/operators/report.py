"""Routing of files and the audit report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

ENTITIES = ("PERSON", "PHONE_NUMBER", "EMAIL_ADDRESS", "PROFILE_PHOTO")


def action(path: Column | str) -> Column:
    """What is done with a file: redact_pdf, redact_image, or copy (unprotected)."""
    ext = T.extension(path)
    return F.when(ext == "pdf", "redact_pdf").when(ext.isin("jpg", "jpeg", "png"), "redact_image").otherwise("copy")


def image_format(path: Column | str) -> Column:
    """Format of a written image: JPEG for jpg and jpeg, else PNG."""
    return F.when(T.extension(path).isin("jpg", "jpeg"), "JPEG").otherwise("PNG")


def output_path(root: str, path: Column | str) -> Column:
    """Mirrored place under the output root."""
    return F.concat_ws("/", F.lit(root.rstrip("/")), F.col(path) if isinstance(path, str) else path)


def erased_metadata(metadata: Column | str) -> Column:
    """Metadata with every value emptied."""
    return F.transform_values(metadata, lambda k, v: F.lit(""))


def dispatch(files: DataFrame, path: str = "rel_path") -> DataFrame:
    return files.withColumn("action", action(path)).withColumn("unprotected", F.col("action") == "copy")


def delivered(files: DataFrame, key: str = "doc_id", path: str = "rel_path", dossier: str = "dossier_id") -> DataFrame:
    """One row for each file, however often it was delivered: the first by path and dossier."""
    order = Window.partitionBy(key).orderBy(F.col(path).asc_nulls_first(), F.col(dossier).asc_nulls_first())
    return files.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def entity_counts(hits: DataFrame, key: list[str]) -> DataFrame:
    """Raw hits of each file and entity, before overlaps are resolved."""
    return hits.groupBy(*key, "entity").agg(F.count("*").alias("n_hits"))


def summary_map(counts: DataFrame, key: list[str]) -> DataFrame:
    """entities_found with all four keys, zero where nothing was found."""
    per = counts.groupBy(*key).agg(*[F.coalesce(F.sum(F.when(F.col("entity") == e, F.col("n_hits"))), F.lit(0)).alias(e) for e in ENTITIES])
    return per.select(*key, F.create_map(*[x for e in ENTITIES for x in (F.lit(e), F.col(e))]).alias("entities_found"))


def totals(records: DataFrame, elapsed: float | None = None) -> DataFrame:
    """One row: files, successes, errors, redactions and the sum of each entity; missing counts are zero."""
    e = lambda k: F.coalesce(F.sum(F.coalesce(F.element_at("entities_found", k), F.lit(0))), F.lit(0)).alias(k.lower())
    return records.agg(
        F.count("*").alias("n_files"), F.count_if(F.col("status") == "success").alias("n_success"), F.count_if(F.col("status") != "success").alias("n_errors"),
        F.countDistinct("dossier_id").alias("n_dossiers"), F.coalesce(F.sum("total_redactions"), F.lit(0)).alias("total_redactions"), *map(e, ENTITIES),
        F.round(F.lit(elapsed).cast("double"), 2).alias("elapsed_seconds"),
    )


def languages_first_seen(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", lang: str = "lang") -> DataFrame:
    """Languages of each document in the order in which they first appear."""
    first = pages.groupBy(doc, lang).agg(F.min(page).alias("p"))
    return first.groupBy(doc).agg(F.transform(F.sort_array(F.collect_list(F.struct("p", lang))), lambda x: x[lang]).alias("languages"))


def without_cv(files: DataFrame, cvs: DataFrame, dossier: str = "dossier_id", path: str = "rel_path") -> DataFrame:
    """Files of a dossier other than its CV."""
    return files.join(cvs.select(dossier, path), [dossier, path], "left_anti")


def latest(records: DataFrame, key: str = "doc_id", at: str = "processed_at") -> DataFrame:
    """The last record of each file."""
    return records.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).where("rn = 1").drop("rn")
