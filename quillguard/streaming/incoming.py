"""Files that arrive one by one: stateless hits as they come, terms of a dossier as they are learned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import patterns as P
from ..operators import hits, identity
from ..plans.pipeline import dossier_names, without_terms


def page_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    """Pages from Parquet files dropped into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Raw files dropped into a folder."""
    return spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def masked_stream(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """Masked text and the number of hits; stateless, so it runs in append mode."""
    c = F.col(text)
    return (
        pages.withColumn("n_emails", F.size(hits.email_matches(c))).withColumn("n_phones", F.size(hits.phone_matches(c)))
        .withColumn("masked", hits.masked(hits.masked(c, P.EMAIL, "[EMAIL_ADDRESS]"), P.PHONE, "[PHONE_NUMBER]"))
    )


def counts_stream(pages: DataFrame, at: str, text: str = "raw_text", late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Hits per hour of arrival with a watermark for late pages; a page delivered twice within it counts once."""
    once = pages.withWatermark(at, late).dropDuplicatesWithinWatermark(["page_id"])
    c = F.col(text)
    return once.groupBy(F.window(at, window)).agg(F.sum(F.size(hits.email_matches(c))).alias("n_emails"), F.sum(F.size(hits.phone_matches(c))).alias("n_phones"), F.count("*").alias("n_pages"))


def terms_stream(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """Search terms of each dossier as its first pages arrive: dossier_id, terms.  State is one set for each dossier; a
    page that is delivered again adds nothing to it.  To be written in update or complete mode."""
    names = dossier_names(pages, text)
    found = names.where("dossier_id is not null").select("dossier_id", F.explode(identity.search_terms("name")).alias("term"))
    return found.groupBy("dossier_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def masked_with_terms(pages: DataFrame, terms: DataFrame, text: str = "raw_text") -> DataFrame:
    """A stream of pages masked with the terms that are known (a static table dossier_id, terms) besides e-mails and phones.

    The table is read anew in each batch, so terms that ``terms_stream`` has written since are used.
    """
    return masked_stream(pages, text).join(terms, "dossier_id", "left").withColumn("masked", without_terms("masked", "terms")).drop("terms")


def start(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes a stream to Parquet; the checkpoint makes each file count once."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
