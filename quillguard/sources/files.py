"""Reading dossiers: directory trees, binary files, and plug-ins that decode what Spark cannot."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def with_dossier(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """dossier_id from the first folder; loose files at the root are left out."""
    parts = F.split(path, "/")
    return files.where(F.size(parts) >= 2).withColumn("dossier_id", parts[0])


def discover(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Files below the root: dossier_id, rel_path, ext, length, modified (and content).

    Reads recursively; loose files at the root, empty folders and files of length zero give no row.
    """
    prefix = root.rstrip("/")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(prefix)
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^\\Q{prefix}\\E/", "")
    out = df.withColumn("rel_path", F.url_decode(F.replace(rel, F.lit("+"), F.lit("%2B"))))
    cols = ["dossier_id", "rel_path", T.extension("rel_path").alias("ext"), "length", F.col("modificationTime").alias("modified")]
    return with_dossier(out).select(*cols, *(["content"] if content else []))


def spread(df: DataFrame) -> DataFrame:
    """A plain scan whose tasks are few against the cores (a small file) spread over them; any other as it is.  The
    number of tasks is asked of the scan, which runs nothing."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def once(df: DataFrame, key: str) -> DataFrame:
    """One row for each key, any of several; rows without a key all stay.

    Only keys are shuffled to find those that come twice; the rows of all others are read where they lie, so that
    texts are not moved for the sake of a few repeated rows.
    """
    twice = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    return df.join(twice, key, "left_anti").unionByName(df.join(twice, key, "left_semi").dropDuplicates([key]))


def choose_root(argument: str | None, exists: Callable[[str], bool]) -> str:
    """The given folder, else data if it is there, else test."""
    return argument or ("data" if exists("data") else "test")


def choose_output(argument: str | None) -> str:
    return argument or "result"


@dataclass
class Plugins:
    """Decoders that are not part of this library; a missing one degrades, it does not fail.

    Each maps an iterator of Arrow batches (as in ``mapInArrow``) to one with the named schema.
    """

    slots: dict[str, tuple[Callable, str]] = field(default_factory=dict)

    KINDS = ("pdf_pages", "page_spans", "page_images", "image_pixels", "ocr", "ner", "faces", "language", "pdf_writer", "image_writer")

    def register(self, kind: str, run: Callable, schema: str) -> None:
        if kind not in self.KINDS:
            raise ValueError(f"no such plug-in: {kind}")
        self.slots[kind] = (run, schema)

    def apply(self, kind: str, df: DataFrame, empty_schema: str) -> tuple[DataFrame, str]:
        """Result and status: ok, or degraded with an empty result where no plug-in is registered."""
        if kind not in self.slots:
            return df.sparkSession.createDataFrame([], empty_schema), "degraded"
        run, schema = self.slots[kind]
        return df.mapInArrow(run, schema), "ok"


PAGES = "dossier_id string, doc_id bigint, page_no int, width double, height double, text string, n_images int"
SPANS = "doc_id bigint, page_no int, block_no int, line_no int, span_no int, text string, font double, y0 double, height double"
OCR_ITEMS = "doc_id bigint, page_no int, item_no int, quad array<struct<x:double,y:double>>, text string"
NER_TOKENS = "doc_id bigint, seq int, entity_group string, word string, start int, end int, score double"
FACES = "doc_id bigint, page_no int, x0 double, y0 double, x1 double, y1 double, score double"


def flatten_layout(pages: DataFrame, blocks: str = "blocks") -> DataFrame:
    """Nested blocks (bbox, lines of spans) to one row per span."""
    b = pages.select("doc_id", "page_no", "height", F.posexplode(blocks).alias("block_no", "b"))
    line = b.select("doc_id", "page_no", "height", "block_no", F.col("b.bbox.y0").alias("y0"), F.posexplode("b.lines").alias("line_no", "l"))
    span = line.select("doc_id", "page_no", "height", "block_no", "y0", "line_no", F.posexplode("l.spans").alias("span_no", "s"))
    return span.select("doc_id", "page_no", "block_no", "line_no", "span_no", F.col("s.text").alias("text"), F.col("s.size").alias("font"), "y0", "height")


def header_image(width: Column, height: Column, for_redaction: bool) -> Column:
    """Size in points of an image that can be a header card."""
    return (width > (80 if for_redaction else 100)) & (height > 25)


def image_placements(images: DataFrame, every: bool = False) -> DataFrame:
    """First placement of each embedded image, or every one."""
    return images.select("doc_id", "page_no", "image_no", F.explode("rects" if every else F.slice("rects", 1, 1)).alias("rect"))
