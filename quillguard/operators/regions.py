"""From occurrences in a page's text to boxes on it, and from boxes to what is counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from . import hits, layout

ORDER = ("PERSON", "PHONE_NUMBER", "EMAIL_ADDRESS")  # in which boxes are placed; of equal boxes the first stays
_SPANS = "array<struct<start:int,end:int,entity:string>>"


def literal_spans(text: Column, strings: Column, entity: str) -> Column:
    """Every occurrence of each string in the text, case aside, as an array of (start, end, entity)."""
    low = F.lower(text)

    def one(s: Column) -> Column:
        pieces = F.split(low, F.concat(F.lit("\\Q"), F.lower(s), F.lit("\\E")), -1)
        found = F.aggregate(
            F.slice(pieces, 1, F.size(pieces) - 1),
            F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out")),
            lambda a, p: F.struct(
                (a["at"] + F.length(p) + F.length(s)).alias("at"),
                F.concat(a["out"], F.array(F.struct((a["at"] + F.length(p)).alias("start"), (a["at"] + F.length(p) + F.length(s)).alias("end"), F.lit(entity).alias("entity")))).alias("out"),
            ),
        )
        return found["out"]

    return F.flatten(F.transform(F.coalesce(strings, F.array().cast("array<string>")), one))


def occurrences(pages: DataFrame, terms: DataFrame, key: list[str], text: str, dossier: str = "dossier_id") -> DataFrame:
    """Where the terms of its dossier, phone numbers and pieces of e-mail addresses stand on each page: key, entity,
    start, end.  Each place counts once for an entity; null and blank texts have none."""
    joined = hits.with_terms(pages.where(F.trim(text) != "").select(*key, dossier, text), terms, dossier, key[0], "left", pages)
    c = F.col(text)
    terms_ = F.filter("terms", lambda t: F.length(t) >= 3)
    phones = F.array_distinct(hits.phone_matches(c))
    parts = F.array_distinct(F.flatten(F.transform(hits.email_matches(c), lambda m: T.email_parts(m))))
    every = F.array_distinct(F.concat(literal_spans(c, terms_, ORDER[0]), literal_spans(c, phones, ORDER[1]), literal_spans(c, parts, ORDER[2])))
    return joined.select(*key, F.explode(every).alias("h")).select(*key, "h.entity", "h.start", "h.end")


def placed_words(pages: DataFrame, key: list[str], text: str, char_width: float = 6.0, line_height: float = 12.0) -> DataFrame:
    """Words with their places in the whole text and the boxes of a fixed-width rendering: key, line_no, word_no, word,
    start, end, rect.  Decoders that know the real boxes give the same columns."""
    lines = _pieces(F.col(text), "\n")
    rows = pages.where(F.col(text).isNotNull()).select(*key, F.posexplode(lines).alias("line_no", "l"))
    w = rows.select(*key, "line_no", F.col("l.at").alias("offset"), F.posexplode(_pieces(F.col("l.piece"), " ")).alias("word_no", "w")).where("w.piece <> ''")
    word, at, y0 = F.col("w.piece"), F.col("w.at"), F.col("line_no") * line_height
    start = F.col("offset") + at
    rect = G.rect(at * char_width, y0, (at + F.length(word)) * char_width, y0 + line_height)
    return w.select(*key, "line_no", "word_no", word.alias("word"), start.alias("start"), (start + F.length(word)).alias("end"), rect.alias("rect"))


def _pieces(text: Column, by: str) -> Column:
    """Pieces of a text between single characters, with the places where they begin."""
    pieces = F.split(text, by)
    begins = F.aggregate(pieces, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x) + 1)))
    return F.zip_with(pieces, F.slice(begins, 1, F.size(pieces)), lambda p, b: F.struct(p.alias("piece"), b.alias("at")))


def boxes_of(found: DataFrame, words: DataFrame, key: list[str]) -> DataFrame:
    """Boxes of the occurrences, one for each line that one runs over: key, entity, start, end, line_no, rect.

    The share of a word's letters that belongs to the occurrence is the share of its box.
    """
    h, w = found.alias("h"), words.alias("w")
    on = (F.col("h.start") < F.col("w.end")) & (F.col("w.start") < F.col("h.end"))
    for k in key:
        on = on & (F.col(f"h.{k}") == F.col(f"w.{k}"))
    one = (F.col("w.rect.x1") - F.col("w.rect.x0")) / (F.col("w.end") - F.col("w.start"))
    x0 = F.col("w.rect.x0") + (F.greatest("h.start", "w.start") - F.col("w.start")) * one
    x1 = F.col("w.rect.x0") + (F.least("h.end", "w.end") - F.col("w.start")) * one
    keys = [F.col(f"h.{k}").alias(k) for k in key]
    out = h.join(w, on).groupBy(*keys, F.col("h.entity").alias("entity"), F.col("h.start").alias("start"), F.col("h.end").alias("end"), F.col("w.line_no").alias("line_no"))
    out = out.agg(F.min(x0).alias("x0"), F.min("w.rect.y0").alias("y0"), F.max(x1).alias("x1"), F.max("w.rect.y1").alias("y1"))
    return out.select(*key, "entity", "start", "end", "line_no", G.rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("rect"))


def flagged(boxes: DataFrame, key: list[str]) -> DataFrame:
    """Boxes (key, id, entity, rect) with ``kept``: whether no other box of the page holds them; of equal boxes the
    one with the lowest id is kept.  The boxes of a page, bounded by the length of its text, are one array."""
    per = boxes.groupBy(*key).agg(F.collect_list(F.struct("id", "entity", "rect")).alias("bs"))
    within = lambda a, b: (a["id"] != b["id"]) & G.contains(b["rect"], a["rect"]) & ((a["rect"] != b["rect"]) | (b["id"] < a["id"]))
    one = lambda a: F.struct(a["id"].alias("id"), a["entity"].alias("entity"), a["rect"].alias("rect"), (~F.exists("bs", lambda b: within(a, b))).alias("kept"))
    return per.select(*key, F.explode(F.transform("bs", one)).alias("b")).select(*key, "b.*")


def page_regions(pages: DataFrame, terms: DataFrame, key: list[str], text: str, dossier: str = "dossier_id") -> DataFrame:
    """Boxes to be covered on searchable pages: key, id, entity, rect, kept.

    Boxes are padded; a phone's reaches over a country code just left of it.  All rows are what entities are
    counted from, those that are kept (in no other box) what is covered.
    """
    words = placed_words(pages, key, text)
    found = boxes_of(occurrences(pages, terms, key, text, dossier), words, key)
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("entity"))
    found = found.withColumn("id", F.row_number().over(Window.partitionBy(*key).orderBy(place, "start", "end", "line_no")))
    prefixes = words.where(F.col("word").startswith("+") | (F.col("word") == "212"))
    phones = layout.band_left(found.where("entity = 'PHONE_NUMBER'"), prefixes, key).select(*key, "id", F.lit("PHONE_NUMBER").alias("entity"), "rect")
    others = found.where("entity <> 'PHONE_NUMBER'").select(*key, "id", "entity", G.pad(F.col("rect")).alias("rect"))
    return flagged(others.unionByName(phones), key)
