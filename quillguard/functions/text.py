"""Text expressions: all of them Catalyst expressions but for NFKC and title case, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lexicon as lx

# French function words that tell French where no statistical language is at hand.
FRENCH = "(?:^|[^a-z\\x{00E0}-\\x{00FF}])(?:et|de|les|pour|avec)(?:$|[^a-z\\x{00E0}-\\x{00FF}])"
ARABIC = "[\\x{0600}-\\x{06FF}\\x{FB50}-\\x{FEFF}]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility form; null stays null."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def title_case(s: pd.Series) -> pd.Series:
    """Capital after every non-letter, unlike ``initcap``."""
    return s.map(lambda x: None if x is None else x.title())


def fold_arabic(c) -> Column:
    """Without lengthening strokes and vowel signs, alef variants bare; null becomes empty."""
    c = F.regexp_replace(F.coalesce(_c(c), F.lit("")), "[\\x{0640}\\x{064B}-\\x{065F}\\x{0670}]", "")
    return F.translate(c, "إأآٱ", "اااا")


def normalize_arabic(c) -> Column:
    """Compatibility form, then ``fold_arabic``."""
    return fold_arabic(nfkc(F.coalesce(_c(c), F.lit(""))))


def label_ready(c) -> Column:
    """Compatibility form with plain blanks and the label word repaired that extraction tears."""
    return F.replace(F.replace(nfkc(_c(c)), F.lit(" "), F.lit(" ")), F.lit("االسم"), F.lit("الاسم"))


def collapse(c) -> Column:
    """Runs of white space to one blank, trimmed."""
    return F.trim(F.regexp_replace(_c(c), "\\s+", " "))


def strip_honorific(c) -> Column:
    return F.regexp_replace(_c(c), f"(?iu)^(?:{lx.HONORIFICS})\\s+", "")


def strip_place(c) -> Column:
    return F.regexp_replace(_c(c), f"^(?:{lx.PLACES})\\s*", "")


def keep_name_chars(c) -> Column:
    """Word characters, blanks, Arabic, hyphens and dots only."""
    return F.trim(F.regexp_replace(_c(c), "(?U)[^\\w\\s\\x{0600}-\\x{06FF}\\x{FB50}-\\x{FEFF}\\-.]", ""))


def strip_edges(c) -> Column:
    return F.regexp_replace(_c(c), "^[ :,;.\\-/|*]+|[ :,;.\\-/|*]+$", "")


def first_piece(c, separators: str) -> Column:
    return F.trim(F.split(_c(c), separators, 2)[0])


ATTESTATION_SEPARATORS = "\\s*[:•|]\\s*|\\s+[-–]\\s+"  # a hyphen separates only between blanks
LABEL_SEPARATORS = "\\s+[-–•]\\s+|\\s*\\|\\s*|:"


def tokens(c, separators: str = "\\s+") -> Column:
    return F.filter(F.split(_c(c), separators), lambda x: x != "")


def lines(c, least: int = 3, most: int | None = None, width: int | None = None) -> Column:
    """Trimmed lines of at least ``least`` characters; optionally the first ``most``, cut to ``width``."""
    out = F.filter(F.transform(F.split(_c(c), "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)
    out = out if most is None else F.slice(out, 1, most)
    return out if width is None else F.transform(out, lambda x: F.substring(x, 1, width))


def base_name(c) -> Column:
    return F.element_at(F.split(_c(c), "/"), -1)


def extension(c) -> Column:
    return F.lower(F.regexp_extract(base_name(c), "\\.([^.]+)$", 1))


def digit_count(c) -> Column:
    return F.length(F.regexp_replace(_c(c), "[^0-9]", ""))


def without_separators(c) -> Column:
    return F.regexp_replace(_c(c), "[\\s.-]", "")


def has_arabic(c, presentation_forms: bool = True) -> Column:
    return _c(c).rlike(ARABIC if presentation_forms else "[\\x{0600}-\\x{06FF}]")


def case_variants(c) -> Column:
    c = _c(c)
    return F.array_distinct(F.array(c, F.upper(c), title_case(c), F.lower(c)))


def inverted(c) -> Column:
    """The two words of a name swapped; null for other numbers of words."""
    w = tokens(c, "[\\s\\-]+")
    return F.when(F.size(w) == 2, F.concat_ws(" ", w[1], w[0]))


def abd_variant(c) -> Column:
    """The compound with Abd- in its other spelling (apart or together); null where there is none."""
    c = _c(c)
    return F.when(c.contains("عبد "), F.replace(c, F.lit("عبد "), F.lit("عبد"))).when(c.contains("عبد"), F.regexp_replace(c, "عبد([\\x{0621}-\\x{064A}]+)", "عبد $1"))


def email_parts(c) -> Column:
    """Pieces of a spaced address of at least three characters."""
    return F.filter(F.split(_c(c), "\\s+"), lambda x: F.length(x) >= 3)


def overlaps(tokens_: Column, words: list[str]) -> Column:
    """Whether a token, in lower case, is one of the words."""
    return F.exists(tokens_, lambda t: F.lower(t).isin(words))


def arabic_share(c) -> Column:
    """Arabic letters among all letters."""
    arabic, latin = F.regexp_count(_c(c), F.lit("[\\x{0621}-\\x{064A}]")), F.regexp_count(_c(c), F.lit("[A-Za-z\\x{00C0}-\\x{024F}]"))
    return arabic / F.greatest(arabic + latin, F.lit(1))


def _is_one_of(words: list[str]):
    return lambda w: w.isin(words)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def statistical_language(c) -> Column:
    """Language whose function words the text has most of (first by code of equals); null where it has none.

    Each occurrence counts; words are runs of Latin letters, so other scripts do not count.
    """
    langs = sorted(lx.FUNCTION_WORDS.items())
    count = lambda ws, i, k, v: F.struct(F.size(F.filter(ws, _is_one_of(v))).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("lang"))
    best = lambda ws: F.greatest(*[count(ws, i, k, v) for i, (k, v) in enumerate(langs)])
    return _let(F.split(F.lower(_c(c)), "[^a-z\\x{00DF}-\\x{00FF}]+"), lambda ws: _let(best(ws), lambda b: F.when(b["n"] > 0, b["lang"])))


def detect_language(c, statistical: Column | None = None) -> Column:
    """ar, fr or en: blank is en, over a quarter Arabic letters is ar, else the statistical language folded to
    the three (Romance to fr, the rest to en), or French function words where there is none."""
    c = _c(c)
    french = F.lower(c).rlike(FRENCH)
    words = F.when(french, "fr").otherwise("en")
    rest = words if statistical is None else F.when(statistical.isNull(), words).otherwise(fold_language(statistical))
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "en").when(arabic_share(c) > 0.25, "ar").otherwise(rest)


def fold_language(lang: Column) -> Column:
    return F.when(lang.isin("fr", "ar", "en"), lang).when(lang.isin("es", "it", "pt", "ca"), "fr").otherwise("en")
