"""Folding and accepting the output of a name recognizer (tokens come from a plug-in)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as T


def fold_tokens(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Neighbouring tokens of one group joined: doc, first_seq, entity_group, word, start, end, score.

    A token joins its predecessor of the same group if it is a continuation (##) or begins at most one
    character after it; a missing start counts as adjacent.  The score is the least, the end the last known.
    """
    w = Window.partitionBy(doc).orderBy("seq")
    known_end = F.last("end", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    sub = F.col("word").startswith("##")
    near = sub | F.col("start").isNull() | (F.col("start") <= known_end + 1)
    joins = F.coalesce((F.lag("entity_group").over(w) == F.col("entity_group")) & near, F.lit(False))
    marked = tokens.withColumn("joins", joins).withColumn("gap", F.when(F.col("joins") & ~sub & (F.col("start") > known_end), " ").otherwise(""))
    marked = marked.withColumn("island", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    piece = F.when(F.col("joins"), F.concat("gap", F.regexp_replace("word", "^##", ""))).otherwise(F.col("word"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("seq", piece.alias("p")))), lambda x: x["p"])
    return marked.groupBy(doc, "island").agg(
        F.min("seq").alias("first_seq"), F.min_by("entity_group", "seq").alias("entity_group"), F.array_join(parts, "").alias("word"),
        F.min_by("start", "seq").alias("start"), F.max_by("end", F.when(F.col("end").isNotNull(), F.col("seq"))).alias("end"), F.min("score").alias("score"),
    ).drop("island")


def readable_lines(pages: DataFrame, key: list[str], text: str) -> DataFrame:
    """Lines that recognition reads: the first 30 of three characters, cut to 500, without addresses, digit
    lines and section headings."""
    out = pages.select(*key, F.posexplode(T.lines(text, 3, 30, 500)).alias("line_no", "line"))
    first = F.lower(F.split("line", "\\s+")[0])
    return out.where(~F.col("line").contains("@") & ~F.col("line").rlike("^[0-9+\\s\\-–/.]+$") & ~first.isin(lx.SECTIONS))


def accepted_names(entities: DataFrame, stopwords: list[str] = lx.STOPWORDS) -> DataFrame:
    """Persons with a score of 0.80: two to four words (Arabic one to four), five letters, capitalized."""
    c = T.strip_place(T.keep_name_chars(T.collapse(F.regexp_replace("word", "##", ""))))
    df = entities.withColumn("name", c)
    w = T.tokens("name")
    arabic = T.has_arabic("name")
    capital = F.forall(w, lambda t: F.substring(t, 1, 1).rlike("(?U)\\p{Lu}"))
    ok = (F.col("entity_group") == "PER") & (F.col("score") >= 0.80) & F.size(w).between(F.when(arabic, 1).otherwise(2), F.lit(4)) & (F.length("name") >= 5)
    return df.where(ok & ~T.overlaps(w, stopwords) & (arabic | capital))


def longest_name(names: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The longest name of each document, the first by text of equals."""
    return names.groupBy(doc).agg(F.min(F.struct((-F.length("name")).alias("n"), "name")).alias("b")).select(doc, "b.name")
