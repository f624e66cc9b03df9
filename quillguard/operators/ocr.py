"""Scanned documents: routing, and three ways of classifying recognized lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import patterns as P
from ..functions import text as T

SCANNED_CHARS = 50  # characters per page on average below which a document counts as scanned


def scanned(pages: DataFrame, doc: str = "doc_id", text: str = "raw_text") -> DataFrame:
    """doc, n_pages, n_chars, is_scanned, n_needs_ocr: whether the document's average page has hardly any text,
    and the number of its pages that have none (which a document-wide average hides)."""
    n = F.length(F.trim(F.coalesce(F.col(text), F.lit(""))))
    out = pages.groupBy(doc).agg(F.count("*").alias("n_pages"), F.sum(n).cast("bigint").alias("n_chars"), F.sum(F.when(n == 0, 1).otherwise(0)).cast("bigint").alias("n_needs_ocr"))
    return out.withColumn("is_scanned", F.col("n_chars") < SCANNED_CHARS * F.col("n_pages"))


def first_written_page(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "raw_text", images: str = "n_images") -> DataFrame:
    """The first of a document's first three pages with over 30 characters or an image, else its first."""
    w = Window.partitionBy(doc).orderBy(page)
    p = pages.withColumn("rank", F.dense_rank().over(w)).where("rank <= 3")
    written = (F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 30) | (F.coalesce(F.col(images), F.lit(0)) > 0)
    return p.groupBy(doc).agg(F.coalesce(F.min(F.when(written, F.col(page))), F.min(page)).alias("first_page"))


def is_phone(text: Column | str) -> Column:
    return T.without_separators(text).rlike(P.OCR_PHONE)


def is_email(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return c.contains("@") & c.contains(".")


def name_part(text: Column | str, terms: Column) -> Column:
    """Whether a term of four characters stands in the text, case aside."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.coalesce(F.exists(terms, lambda t: (F.length(t) >= 4) & F.contains(low, F.lower(t))), F.lit(False))


def classify(variant: str, text: Column | str, terms: Column, given: list[str] = lx.GIVEN_NAMES, stopwords: list[str] = lx.STOPWORDS) -> Column:
    """Entity of a recognized line, or null.

    ``card``: a name part decides even if the line is a stopword or given name, which then is nothing at all;
    ``page``: such a stopword falls through to phone and e-mail, given names are not guarded;
    ``image``: both stopwords and given names fall through.
    """
    low = F.lower(F.trim(F.col(text) if isinstance(text, str) else text))
    named = name_part(text, terms)
    stop, first = low.isin(stopwords), low.isin(given)
    rest = F.when(is_phone(text), "PHONE_NUMBER").when(is_email(text), "EMAIL_ADDRESS")
    if variant == "card":
        return F.when(named, F.when(~stop & ~first, "PERSON")).otherwise(rest)
    guard = ~stop if variant == "page" else ~stop & ~first
    return F.when(named & guard, "PERSON").otherwise(rest)


def header_name(lines: Column, stopwords: list[str] = lx.STOPWORDS) -> Column:
    """First of up to six recognized lines that can be a name, or null."""

    def clean(x: Column) -> Column:
        return T.strip_honorific(T.collapse(x))

    def ok(x: Column) -> Column:
        w = T.tokens(x)
        return F.size(w).between(1, 4) & F.length(x).between(4, 40) & ~T.overlaps(w, stopwords) & ~x.rlike("@|http|\\.com|[0-9]{5,}")

    return F.get(F.filter(F.transform(F.slice(lines, 1, 6), clean), ok), 0)


def fallback_terms(lines: Column, stopwords: list[str] = lx.STOPWORDS) -> Column:
    """Terms when nothing else names the candidate: the first of the first five lines of two to four words that
    are no stopwords, and its words of four letters."""
    line = F.get(F.filter(F.slice(lines, 1, 5), lambda x: F.size(T.tokens(x)).between(2, 4) & ~T.overlaps(T.tokens(x), stopwords)), 0)
    parts = F.filter(T.tokens(line), lambda w: (F.length(w) >= 4) & ~F.lower(w).isin(stopwords))
    return F.when(line.isNotNull(), F.array_distinct(F.concat(F.array(line), parts))).otherwise(F.array().cast("array<string>"))


def running_offsets(items: DataFrame, page: list[str], order: str = "item_no", text: str = "text") -> DataFrame:
    """Where each recognized line begins in the concatenation of its page."""
    w = Window.partitionBy(*page).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn("offset", F.coalesce(F.sum(F.length(text) + 1).over(w), F.lit(0)))
