"""Visually identical text with different characters (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import glyphs
from .common import Ref, map_rows, table, text_models
from .p3_encoding import needs_look


def unify(df: DataFrame, key: str, text: str, ref: Ref | None = None) -> DataFrame:
    """Canonical form of every text that differs from it.

    Out: key, canonical, garbled.  With models, text that was decoded wrongly is told apart (garbled) and
    restored first.  Null and empty texts and texts in canonical form give no row.
    """

    def make():
        repairer = ref.models()[1] if ref is not None else None

        def f(c):
            out = {key: [], "canonical": [], "garbled": []}
            for k, t in zip(c[key], c[text]):
                wrong = False
                if repairer is not None:
                    sound, _, _, wrong, disguised = repairer.map(t)
                else:
                    sound, start, _ = glyphs.canonical_map(t)
                    disguised = start is not None and glyphs.stands_in(t, sound)
                if disguised or wrong:
                    out[key].append(k)
                    out["canonical"].append(sound)
                    out["garbled"].append(wrong)
            return out

        return f

    kind = dict(df.dtypes)[key]
    return map_rows(df.select(key, text).where(needs_look(text)), make, f"{key} {kind}, canonical string, garbled boolean")


def p5_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical text of each row of both tables that needed it."""
    ref = Ref(text_models(spark, table(spark, sf_dir, "documents")))
    pages = unify(table(spark, sf_dir, "dossier_pages"), "page_id", "raw_text", ref)
    names = unify(table(spark, sf_dir, "candidate_names"), "name_id", "candidate_name")
    shape = lambda df, tab, key: df.select(F.lit(tab).alias("tab_name"), F.col(key).alias("rec_id"), "canonical", "garbled")
    return shape(pages, "dossier_pages", "page_id").unionByName(shape(names, "candidate_names", "name_id")).dropDuplicates(["tab_name", "rec_id"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a character that stands in for the ordinary spelling, garbled pages left out."""
    ref = Ref(text_models(spark, table(spark, sf_dir, "documents")))
    pages = unify(table(spark, sf_dir, "dossier_pages"), "page_id", "raw_text", ref).where(~F.col("garbled"))
    names = unify(table(spark, sf_dir, "candidate_names"), "name_id", "candidate_name")
    shape = lambda df, tab, key: df.select(F.lit(tab).alias("tab_name"), F.col(key).alias("rec_id"))
    return shape(pages, "dossier_pages", "page_id").unionByName(shape(names, "candidate_names", "name_id")).distinct()


# Full-width forms, ligatures, presentation forms, invisible characters, and marks on a plain letter.
EVIDENT = "[\\x{FF01}-\\x{FF5E}\\x{FB00}-\\x{FB06}\\x{FE70}-\\x{FEFC}\\x{200B}-\\x{200F}\\x{2060}\\x{00AD}\\x{00A0}]|[a-zA-Z][\\x{0300}-\\x{0304}\\x{0308}]"


def p5_evident_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the names found, those with a character of the evident classes."""
    names = table(spark, sf_dir, "candidate_names")
    return names.where(F.col("candidate_name").rlike(EVIDENT)).select("name_id").distinct().join(unify(names, "name_id", "candidate_name"), "name_id", "left_semi")


SQL = {"p5_evident_names": f"SELECT DISTINCT name_id FROM candidate_names WHERE regexp_matches(candidate_name, '{EVIDENT}')"}
