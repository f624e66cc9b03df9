"""Person hits in Arabic text: titles, labels, compounds, a gazetteer walk, visual order, a second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as T
from . import hits

_W = "[\\x{0600}-\\x{06FF}]+"
# Patterns of the recognizer with their scores; a title belongs to its span, a label does not.
TITLE = f"(?<=^|\\s)(?:{lx.ARABIC_TITLES})\\s+{_W}(?:\\s+{_W}){{1,3}}"
LABEL = f"(?:{lx.ARABIC_LABELS})\\s*[:\\-]\\s*({_W}(?:\\s+{_W}){{1,3}})"
COMPOUND = f"(?<=^|\\s)(?:عبد\\s+(?:{lx.ARABIC_ABD})|(?:{lx.ARABIC_DIN})\\s+الدين)(?:\\s+{_W}){{1,2}}"
KINDS = ("title", "label", "compound", "gazetteer")


def gazetteer(names: list[str] = lx.ARABIC_FIRST_NAMES) -> str:
    """A first name with up to two words after it, whole words only."""
    return f"(?<![\\x{{0600}}-\\x{{06FF}}])(?:{'|'.join(sorted(names, key=len, reverse=True))})(?![\\x{{0600}}-\\x{{06FF}}])(?:\\s+{_W}){{0,2}}"


def kind_spans(text: Column | str, kind: str, names: list[str] = lx.ARABIC_FIRST_NAMES) -> Column:
    """Hits of one pattern; a lone first name scores 0.70, one with more words 0.85."""
    if kind == "title":
        return hits.span_array(text, TITLE, "PERSON", "arabic_title", 0.90)
    if kind == "compound":
        return hits.span_array(text, COMPOUND, "PERSON", "arabic_compound", 0.88)
    if kind == "label":  # the name after the label ends where the match ends
        name = lambda h: F.regexp_extract(h["found"], LABEL, 1)
        found = hits.span_array(text, LABEL, "PERSON", "arabic_label", 0.95)
        return F.transform(found, lambda h: h.withField("start", h["end"] - F.length(name(h))).withField("found", name(h)))
    found = hits.span_array(text, gazetteer(names), "PERSON", "arabic_gazetteer", 0.85)
    return F.transform(found, lambda h: h.withField("score", F.when(F.trim(h["found"]).rlike("\\s"), 0.85).otherwise(0.70)))


def span_arrays(text: Column | str, names: list[str] = lx.ARABIC_FIRST_NAMES) -> Column:
    """All pattern hits of a text as one array."""
    return F.flatten(F.array(*[kind_spans(text, k, names) for k in KINDS]))


def kind_hits(pages: DataFrame, key: list[str], text: str, kind: str) -> DataFrame:
    """Hits of one pattern, one row each."""
    return pages.where(T.has_arabic(text, False)).select(*key, F.explode(kind_spans(text, kind)).alias("h")).select(*key, "h.*")


def person_hits(pages: DataFrame, key: list[str], text: str, resolve: bool = True) -> DataFrame:
    """Person hits of Arabic pages; overlaps resolved within the page (score, length, place, rule)."""
    a = span_arrays(text)
    a = hits.resolve_array(a) if resolve else a
    return pages.where(T.has_arabic(text, False)).select(*key, F.explode(a).alias("h")).select(*key, "h.*")


def analyzer_hits(pages: DataFrame, key: list[str], text: str, lang: str) -> DataFrame:
    """Hits of all recognizers together, the regional rules by language and the Arabic patterns, in one pass; overlaps
    are resolved over all of them.  Null and blank texts have none."""
    arabic = F.when(T.has_arabic(text, False), span_arrays(text)).otherwise(F.array().cast(hits._NONE))
    every = F.flatten(F.array(*hits.rule_arrays(text, lang), arabic))
    found = pages.where(F.col(text).isNotNull()).select(*key, every.alias("hits"))
    return found.select(*key, F.explode(hits.resolve_array(F.col("hits"))).alias("h")).select(*key, "h.*")


def reversed_words(pages: DataFrame, key: list[str], text: str, names: list[str] = lx.ARABIC_FIRST_NAMES) -> DataFrame:
    """Words that are a first name in logical or visual order, with the words beside them unless those end in a colon.

    The compatibility form is taken once per page; places are word numbers.
    """
    plain = pages.where(F.col(text).rlike(T.ARABIC)).select(*key, T.nfkc(text).alias("plain"))
    w = plain.select(*key, F.posexplode(T.tokens("plain")).alias("word_no", "word")).where(T.has_arabic("word"))
    order = Window.partitionBy(*key).orderBy("word_no")
    side = lambda c: F.when(~F.coalesce(c, F.lit(":")).rlike("[:：]$"), c)
    w = w.withColumn("before", side(F.lag("word").over(order))).withColumn("after", side(F.lead("word").over(order)))
    return w.where(F.reverse("word").isin(names) | F.col("word").isin(names)).select(*key, "word_no", F.concat_ws(" ", "before", "word", "after").alias("found"), F.lit(0.90).alias("score"))


def second_pass(pages: DataFrame, key: list[str], text: str) -> DataFrame:
    """Hits of the compatibility form whose places the first pass does not have; places are those of that form."""
    first = person_hits(pages, key, text, resolve=False)
    plain = pages.where(F.col(text).rlike(T.ARABIC)).select(*key, T.nfkc(text).alias("plain"))
    return person_hits(plain, key, "plain", resolve=False).join(first.select(*key, "start", "end"), [*key, "start", "end"], "left_anti")


def uncovered(found: DataFrame, cover: DataFrame, key: list[str]) -> DataFrame:
    """Hits that lie in no span of the other set."""
    a, b = found.alias("a"), cover.select(*key, "start", "end").alias("b")
    on = (F.col("a.start") >= F.col("b.start")) & (F.col("a.end") <= F.col("b.end"))
    for k in key:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, on, "left_anti")
