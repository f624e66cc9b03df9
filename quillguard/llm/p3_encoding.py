"""Garbled text from wrong character encoding (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Ref, map_rows, table, text_models


def needs_look(col: str):
    """JVM-side filter: text with a character outside ASCII, without which nothing is garbled or disguised."""
    return F.octet_length(col) > F.length(col)


def repair(pages: DataFrame, ref: Ref, text: str = "raw_text", key: str = "page_id") -> DataFrame:
    """Rows whose text was decoded wrongly, with the restored text.

    In: any table with ``key`` and ``text``.  Out: key, restored (the text with every chain undone that
    makes its description shorter), fully (whether no lost or unlikely character is left).  Null and
    empty texts, and texts without garbled characters, give no row; repeated rows give repeated rows.
    """
    from .encodings import LOST, ODD

    def make():
        _, repairer = ref.models()

        def f(c):
            out = {key: [], "restored": [], "fully": []}
            for k, t in zip(c[key], c[text]):
                sound, _, _, wrong, _ = repairer.map(t)
                if wrong:
                    out[key].append(k)
                    out["restored"].append(sound)
                    out["fully"].append(LOST not in sound and not ODD.search(sound))
            return out

        return f

    kind = dict(pages.dtypes)[key]
    return map_rows(pages.select(key, text).where(needs_look(text)), make, f"{key} {kind}, restored string, fully boolean")


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restored text of every garbled page; a page delivered twice counts once."""
    ref = Ref(text_models(spark, table(spark, sf_dir, "documents")))
    return repair(table(spark, sf_dir, "dossier_pages"), ref).dropDuplicates(["page_id"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with at least one character from a wrong decoding."""
    ref = Ref(text_models(spark, table(spark, sf_dir, "documents")))
    return repair(table(spark, sf_dir, "dossier_pages"), ref).select("page_id").distinct()


LOST_OR_CONTROL = "[\\x{0080}-\\x{009F}\\x{FFFD}]"


def p3_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the pages found, those with a control character or a lost one, which no sound text has."""
    found = p3_found(spark, sf_dir)
    pages = table(spark, sf_dir, "dossier_pages").where(F.col("raw_text").rlike(LOST_OR_CONTROL)).select("page_id").distinct()
    return pages.join(found, "page_id", "left_semi")


SQL = {"p3_controls": f"SELECT DISTINCT page_id FROM dossier_pages WHERE regexp_matches(raw_text, '{LOST_OR_CONTROL}')"}
