"""Personal information inside free text (problem 2)."""

from __future__ import annotations

import hashlib
import re
from secrets import token_bytes

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii, pseudonyms
from .common import Ref, map_rows, table, text_models
from .glyphs import fold_lookalikes

KEY_CONF = "spark.quillguard.pseudonymKey"  # secret of the pseudonyms; without it each application draws its own
_DRAWN: dict[str, bytes] = {}
_PIECES = "array<struct<field_name:string,pii_kind:string,start:int,end:int,found_text:string,placeholder:string>>"


def session_key(spark: SparkSession) -> bytes:
    """The session's secret: as configured, else one drawn for this application, so that its queries stay linked."""
    named = spark.conf.get(KEY_CONF, None)
    if named:
        return hashlib.blake2b(named.encode(), digest_size=32).digest()
    return _DRAWN.setdefault(spark.sparkContext.applicationId, token_bytes(32))


def placeholder(kind: str, sound: str, key: bytes) -> str:
    """Typed placeholder with a pseudonym: numbers keep their format, the rest get a keyed tag.

    Spellings that differ in case, blanks, word order or disguise alone get the same tag.
    """
    if kind in ("PHONE", "ID_NUMBER"):
        return f"[{kind} {pseudonyms.number(' '.join(sound.split()), key, kind)}]"
    plain = pii.fold(fold_lookalikes(sound))
    if kind == "EMAIL":
        plain = re.sub(r"\[ ?at ?\]|\( ?at ?\)", "@", re.sub(r"\s+", "", plain))
    elif kind == "NAME":
        plain = " ".join(sorted(re.findall(r"\w+", plain)))
    else:
        plain = " ".join(re.findall(r"\w+", plain))
    return f"[{kind} {pseudonyms.tag(plain, key, kind)}]"


def pieces_of(text: str | None, repairer, vocabulary, secret: bytes, dates: bool = False) -> list[tuple[str, int, int, str, str]]:
    """Pieces of personal data of a stored text in their order, without overlaps, each with its placeholder: kind, start,
    end, found text, placeholder."""
    if not text:
        return []
    sound, start, end, _, _ = repairer.map(text)
    found = [(a, b, k, None) for a, b, k in pii.find(sound, vocabulary)]
    if dates:
        found += [(a, b, "DATE", (d, form)) for a, b, d, form in pii.dates(sound) if not any(a < y and x < b for x, y, _, _ in found)]
        found.sort(key=lambda x: x[:2])
    out, at = [], 0
    for x, y, kind, value in found:
        a, b = pii.stored(text, (x, y, kind), start, end)
        if a < at or a >= b:
            continue
        if value is None:
            new = placeholder(kind, sound[x:y], secret)
        else:
            other = pseudonyms.day(value[0], secret)
            new = f"[DATE {value[1].format(other.year, other.month, other.day)}]"
        out.append((kind, a, b, text[a:b], new))
        at = b
    return out


def found_pieces(df: DataFrame, key: str, fields: list[str], ref: Ref, secret: bytes | None = None, dates: bool = False) -> DataFrame:
    """The list of what ``redact`` replaces, one row each: key, field_name, pii_kind, start, end, found_text, placeholder."""
    secret = secret or session_key(df.sparkSession)
    names = ("pii_kind", "start", "end", "found_text", "placeholder")

    def make():
        _, repairer = ref.models()
        vocabulary = ref.vocabulary()

        def f(c):
            keys, where, rows = [], [], []
            for k, *texts in zip(c[key], *(c[x] for x in fields)):
                for t, field in zip(texts, fields):
                    if t and (found := pieces_of(t, repairer, vocabulary, secret, dates)):
                        keys += [k] * len(found)
                        where += [field] * len(found)
                        rows += found
            return {key: keys, "field_name": where} | dict(zip(names, map(list, zip(*rows)) if rows else [[] for _ in names]))

        return f

    kind = dict(df.dtypes)[key]
    return map_rows(df.select(key, *fields), make, f"{key} {kind}, field_name string, pii_kind string, start int, end int, found_text string, placeholder string")


def redact(df: DataFrame, key: str, fields: list[str], ref: Ref, secret: bytes | None = None, dates: bool = False) -> DataFrame:
    """Texts with personal data replaced by typed placeholders, and the list of what was replaced.

    Out: key, redacted (one text per field, null for null), pieces.  Everything outside the pieces stays exactly as
    stored; dates are replaced only on request.  Null, empty and blank texts have no pieces; repeated rows give
    repeated rows.
    """
    secret = secret or session_key(df.sparkSession)
    names = ("field_name", "pii_kind", "start", "end", "found_text", "placeholder")

    def make():
        _, repairer = ref.models()
        vocabulary = ref.vocabulary()

        def f(c):
            out = {key: c[key], "redacted": [], "pieces": []}
            for row in zip(*(c[x] for x in fields)):
                every, done = [], []
                for t, field in zip(row, fields):
                    found = pieces_of(t, repairer, vocabulary, secret, dates)
                    every += [dict(zip(names, (field, *x))) for x in found]
                    done.append(replaced(t, found))
                out["redacted"].append(done)
                out["pieces"].append(every)
            return out

        return f

    kind = dict(df.dtypes)[key]
    return map_rows(df.select(key, *fields), make, f"{key} {kind}, redacted array<string>, pieces {_PIECES}")


def replaced(text: str | None, pieces: list[tuple[str, int, int, str, str]]) -> str | None:
    """The text with each piece's placeholder in its place."""
    if not pieces:
        return text
    out, at = [], 0
    for _, a, b, _, new in pieces:
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:]


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both texts of every page after redaction, with the number of pieces of each kind."""
    ref = Ref(text_models(spark, table(spark, sf_dir, "documents")))
    out = redact(table(spark, sf_dir, "dossier_pages"), "page_id", ["raw_text", "header_text"], ref)
    count = lambda k: F.size(F.filter("pieces", lambda p: p["pii_kind"] == k)).alias(f"n_{k.lower()}")
    return out.select("page_id", F.col("redacted")[0].alias("raw_text"), F.col("redacted")[1].alias("header_text"), *[count(k) for k in pii.KINDS]).dropDuplicates(["page_id"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each piece of personal data that is replaced in a field of a page."""
    ref = Ref(text_models(spark, table(spark, sf_dir, "documents")))
    out = found_pieces(table(spark, sf_dir, "dossier_pages"), "page_id", ["raw_text", "header_text"], ref)
    return out.select("page_id", "field_name", "pii_kind", "found_text").distinct()
