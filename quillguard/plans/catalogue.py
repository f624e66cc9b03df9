"""All queries of the core by name, and their DuckDB SQL.  Every query runs over whole tables."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import lexicon as lx
from ..functions import patterns as P
from ..functions import text as T
from ..operators import arabic, hits, identity, layout, ner, ocr, regions, report
from ..sources.files import flatten_layout, header_image, image_placements, once, spread
from . import pipeline

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return once(spread(_t(spark, d, "dossier_pages")), "page_id")


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(map(_s, words)) + ")"


_PAGES = "(SELECT * FROM dossier_pages QUALIFY row_number() OVER (PARTITION BY page_id) = 1)"
_LINES = f"(SELECT page_id, doc_id, dossier_id, unnest(range(1, len(ls) + 1)) - 1 AS line_no, unnest(ls) AS line FROM (SELECT page_id, doc_id, dossier_id, string_split(raw_text, chr(10)) AS ls FROM {_PAGES} WHERE raw_text IS NOT NULL))"
_HEAD = f"(SELECT page_id, doc_id, dossier_id, unnest(range(1, len(ls) + 1)) - 1 AS line_no, unnest(ls) AS line FROM (SELECT page_id, doc_id, dossier_id, string_split(header_text, chr(10)) AS ls FROM {_PAGES} WHERE header_text IS NOT NULL))"


def _lang() -> Column:
    return T.detect_language("raw_text", T.statistical_language("raw_text"))


def _lines(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    return pages.where(F.col(text).isNotNull()).select("page_id", "doc_id", "dossier_id", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


# Patterns of the SQL, written out for it.  RE2 has no lookaround, so what stands beside a match is looked at
# where one begins, and matches are then taken from left to right.
_BLANK = "[\\s\\p{Z}\\x{0085}]*"
_MAIL = f"[A-Za-z0-9._%+-]+(?:{_BLANK}@{_BLANK}|{_BLANK}\\[at\\]{_BLANK})[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}"
_TEL = (
    "(?:(?:\\+|00)(?:33|212)[\\s.-]?(?:\\(0\\)[\\s.-]?)?|0)[1-7](?:[\\s.-]?[0-9]{2}){4}"
    "|(?:\\+|00)[1-9][0-9]{0,3}[\\s.-]?(?:\\(?[0-9]{1,4}\\)?[\\s.-]?)?[0-9]{2,4}[\\s.-]?[0-9]{2,4}|[567][0-9]{8}"
)


def _found(kind: str, source: str, text: str = "raw_text") -> str:
    """SQL of all phone or e-mail matches of a source (page_id, text): page_id, l, a list of places s (from one) and matches f."""
    before = "substr(t, i - 1, 1)"
    if kind == "tel":
        hint, pattern, after = f"regexp_matches({text}, '[0-9][0-9]')", _TEL, "[^0-9]"
        begins = f"substr(t, i, 1) IN ('+', '0', '5', '6', '7') AND (i = 1 OR NOT regexp_matches({before}, '[0-9]'))"
    else:
        hint, pattern, after = f"regexp_matches({text}, '@|\\[at\\]')", _MAIL, "[^\\p{L}\\p{N}_]"
        word = f"(i > 1 AND regexp_matches({before}, '[\\p{{L}}\\p{{N}}_]'))"
        begins = f"(regexp_matches(substr(t, i, 1), '[A-Za-z0-9_]') AND NOT {word} OR substr(t, i, 1) IN ('.', '%', '+', '-') AND {word})"
    return (
        f"(WITH c AS (SELECT page_id, {text} AS t, unnest(range(1, length({text}) + 1)) AS i FROM {source} WHERE {hint}), "
        f"m AS (SELECT page_id, i, regexp_extract(substr(t, i), {_s('^(' + pattern + ')(?:' + after + '|$)')}, 1) AS f FROM c WHERE {begins}), "
        "g AS (SELECT page_id, list(struct_pack(s := i, f := f) ORDER BY i) AS l FROM m WHERE f <> '' GROUP BY page_id) "
        "SELECT page_id, list_reduce(l, lambda a, x: CASE WHEN len(a) = 0 OR x.s >= a[-1].s + length(a[-1].f) THEN list_append(a, x) ELSE a END, []::STRUCT(s BIGINT, f VARCHAR)[]) AS l FROM g)"
    )


def _replaced(text: str, found: str, by: str) -> str:
    """SQL of a text with its matches (a list, null for none) replaced; ``by`` may look at x.f."""
    return (
        f"CASE WHEN {found} IS NULL THEN {text} ELSE list_reduce({found}, lambda a, x: struct_pack(o := a.o || substr({text}, a.p, x.s - a.p) || {by}, p := x.s + length(x.f)), struct_pack(o := '', p := 1::BIGINT)).o "
        f"|| substr({text}, {found}[-1].s + length({found}[-1].f)) END"
    )


def _compatible() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition makes of single characters, from Unicode's tables: from, to, and those of several."""
    one, several = {}, {}
    for c in map(chr, [*range(0xA0, 0xAC00), *range(0xF900, 0xFFF0)]):
        k = unicodedata.normalize("NFKC", c)
        if k != c and k != unicodedata.normalize("NFC", c):
            if len(k) == 1:
                one[c] = k
            elif c in "…½¼¾™№¨¯´¸˘˙˚˛˜˝" or "ﬀ" <= c <= "ﬆ" or "ﻵ" <= c <= "ﻼ":
                several[c] = k
    return "".join(one), "".join(one.values()), several


_ONE, _ITS, _SEVERAL = _compatible()


def _nfkc(c: str) -> str:
    """SQL of the compatibility form, for the characters that the texts have."""
    for k, v in _SEVERAL.items():
        c = f"replace({c}, {_s(k)}, {_s(v)})"
    return f"nfc_normalize(translate({c}, {_s(_ONE)}, {_s(_ITS)}))"


_READY = f"replace({_nfkc('raw_text')}, 'االسم', 'الاسم')"
_MAILS = f"(SELECT p.*, l, coalesce(list_transform(l, lambda x: x.f), []) AS mails FROM {_PAGES} p LEFT JOIN {_found('mail', _PAGES)} USING (page_id))"
_UNMAILED = f"(SELECT page_id, doc_id, dossier_id, raw_text, {_replaced('raw_text', 'l', _s('[EMAIL_ADDRESS]'))} AS t, mails FROM {_MAILS})"
_UNTOLD = f"(SELECT u.*, {_replaced('t', 'k.l', _s('[PHONE_NUMBER]'))} AS masked FROM {_UNMAILED} u LEFT JOIN {_found('tel', _UNMAILED, 't')} k USING (page_id))"
_TELS = f"(SELECT page_id, unnest(l) AS h, unnest(range(len(l))) AS seq FROM {_found('tel', _PAGES)})"

# ---- hits ------------------------------------------------------------------------------------------


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """E-mail and phone hits of each page, with the masked text."""
    p = _pages(spark, d)
    m = hits.masked(hits.masked("raw_text", P.EMAIL, "[EMAIL_ADDRESS]"), P.PHONE, "[PHONE_NUMBER]")
    return p.select("page_id", "doc_id", F.coalesce(F.size(hits.email_matches("raw_text")), F.lit(0)).alias("n_emails"), F.coalesce(F.size(hits.phone_matches("raw_text")), F.lit(0)).alias("n_phones"), m.alias("masked"))


_Q["flagship_masked_pages"] = flagship
_SQL["flagship_masked_pages"] = (
    "SELECT page_id, doc_id, len(mails)::INT AS n_emails, coalesce(len(list_filter(n.l, lambda x: length(regexp_replace(x.f, '[^0-9]', '', 'g')) >= 8)), 0)::INT AS n_phones, masked "
    f"FROM {_UNTOLD} u LEFT JOIN {_found('tel', _PAGES)} n USING (page_id)"
)


@_query(f"SELECT page_id, found, count(*) AS n FROM (SELECT page_id, unnest(mails) AS found FROM {_MAILS}) GROUP BY ALL")
def email_hits(spark, d):
    return hits.email_hits(_pages(spark, d), ["page_id"], "raw_text").groupBy("page_id", "found").agg(F.count("*").alias("n"))


@_query(f"SELECT dossier_id, sum(len(mails))::BIGINT AS n_emails, count(*) AS n_pages FROM {_MAILS} WHERE raw_text IS NOT NULL GROUP BY dossier_id")
def email_counts_by_dossier(spark, d):
    p = _pages(spark, d).where("raw_text is not null")
    return p.groupBy("dossier_id").agg(F.sum(F.size(hits.email_matches("raw_text"))).alias("n_emails"), F.count("*").alias("n_pages"))


@_query(f"SELECT page_id, t AS masked FROM {_UNMAILED}")
def email_masked_text(spark, d):
    return _pages(spark, d).select("page_id", hits.masked("raw_text", P.EMAIL, "[EMAIL_ADDRESS]").alias("masked"))


@_query(f"SELECT page_no, count(*) AS n_pages, count(*) FILTER (regexp_matches(raw_text, {_s(P.PHONE_CONSUMING)})) AS n_with_phone FROM {_PAGES} GROUP BY page_no")
def phone_pages_by_number(spark, d):
    return _pages(spark, d).groupBy("page_no").agg(F.count("*").alias("n_pages"), F.count_if(F.col("raw_text").rlike(P.PHONE_CONSUMING)).alias("n_with_phone"))


@_query(
    "SELECT page_id, 'PHONE_NUMBER' AS entity, CASE WHEN regexp_matches(h.f, '^[0-9]+$') THEN 'phone_bare' ELSE 'phone_written' END AS rule, seq::INT AS seq, (h.s - 1)::INT AS start, (h.s - 1 + length(h.f))::INT AS \"end\", h.f AS found, 1.0::DOUBLE AS score "
    f"FROM {_TELS} WHERE length(regexp_replace(h.f, '[^0-9]', '', 'g')) >= 8"
)
def phone_hits(spark, d):
    return hits.phone_hits(_pages(spark, d), ["page_id"], "raw_text")


@_query(f"SELECT page_id, regexp_extract(raw_text, '(?:^|[^0-9])([567][0-9]{{8}})(?:[^0-9]|$)', 1) AS found FROM {_PAGES} WHERE regexp_matches(raw_text, '(?:^|[^0-9])([567][0-9]{{8}})(?:[^0-9]|$)')")
def bare9_pages(spark, d):
    r = "(?:^|[^0-9])([567][0-9]{8})(?:[^0-9]|$)"
    return _pages(spark, d).where(F.col("raw_text").rlike(r)).select("page_id", F.regexp_extract("raw_text", r, 1).alias("found"))


@_query(f"SELECT page_id, line_no::INT AS line_no FROM {_LINES} WHERE regexp_matches(regexp_replace(line, '[\\s.-]', '', 'g'), {_s(P.OCR_PHONE)})")
def ocr_phone_rule_lines(spark, d):
    return _lines(_pages(spark, d)).where(ocr.is_phone("line")).select("page_id", "line_no")


@_query(f"SELECT page_id, line_no::INT AS line_no FROM {_LINES} WHERE contains(line, '@') AND contains(line, '.')")
def ocr_email_rule_lines(spark, d):
    return _lines(_pages(spark, d)).where(ocr.is_email("line")).select("page_id", "line_no")


@_query(f"SELECT page_id, {_replaced('raw_text', 'l', "repeat('█', length(x.f))")} AS masked FROM {_MAILS}")
def masked_fixed_width(spark, d):
    return _pages(spark, d).select("page_id", hits.masked_fixed_width("raw_text", P.EMAIL).alias("masked"))


@_query(f"SELECT page_id, unnest(list_filter(string_split_regex(found, '\\s+'), lambda x: length(x) >= 3)) AS part FROM (SELECT page_id, unnest(mails) AS found FROM {_MAILS})")
def email_part_search(spark, d):
    return hits.email_hits(_pages(spark, d), ["page_id"], "raw_text").select("page_id", F.explode(T.email_parts("found")).alias("part"))


_TITLED = f"(?:^|\\s)((?:{lx.ARABIC_TITLES})\\s+[\\x{{0600}}-\\x{{06FF}}]+(?:\\s+[\\x{{0600}}-\\x{{06FF}}]+){{1,3}})"


@_query(f"SELECT page_id, unnest(regexp_extract_all(raw_text, {_s(_TITLED)}, 1)) AS found FROM {_PAGES}")
def arabic_title_hits(spark, d):
    return arabic.kind_hits(_pages(spark, d), ["page_id"], "raw_text", "title").select("page_id", "found")


_LABELLED = f"(?:{lx.ARABIC_LABELS})\\s*[:\\-]\\s*([\\x{{0600}}-\\x{{06FF}}]+(?:\\s+[\\x{{0600}}-\\x{{06FF}}]+){{1,3}})"


@_query(f"SELECT page_id, unnest(regexp_extract_all(raw_text, {_s(_LABELLED)}, 1)) AS found FROM {_PAGES}")
def arabic_label_hits(spark, d):
    return arabic.kind_hits(_pages(spark, d), ["page_id"], "raw_text", "label").select("page_id", "found")


_COMPOUND = f"(?:^|\\s)((?:عبد\\s+(?:{lx.ARABIC_ABD})|(?:{lx.ARABIC_DIN})\\s+الدين)(?:\\s+[\\x{{0600}}-\\x{{06FF}}]+){{1,2}})"


@_query(f"SELECT page_id, unnest(regexp_extract_all(raw_text, {_s(_COMPOUND)}, 1)) AS found FROM {_PAGES}")
def arabic_compound_hits(spark, d):
    return arabic.kind_hits(_pages(spark, d), ["page_id"], "raw_text", "compound").select("page_id", "found")


_GAZETTEER = "(?:^|[^\\x{0600}-\\x{06FF}])((?:" + "|".join(lx.ARABIC_FIRST_NAMES) + ")(?:\\s+[\\x{0600}-\\x{06FF}]+){0,2})(?:$|[^\\x{0600}-\\x{06FF}])"


@_query(f"SELECT page_id, unnest(regexp_extract_all(raw_text, {_s(_GAZETTEER)}, 1)) AS found FROM {_PAGES}")
def arabic_gazetteer_hits(spark, d):
    return arabic.kind_hits(_pages(spark, d), ["page_id"], "raw_text", "gazetteer").select("page_id", "found")


# ---- guards and lines ------------------------------------------------------------------------------

_TOK = "list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '')"


@_query(f"SELECT page_id, line_no::INT AS line_no, len(list_filter({_TOK}, lambda x: lower(x) IN {_in(lx.STOPWORDS)})) > 0 AS guarded FROM {_LINES}")
def token_stopword_guard(spark, d):
    return _lines(_pages(spark, d)).select("page_id", "line_no", T.overlaps(T.tokens("line"), lx.STOPWORDS).alias("guarded"))


@_query(
    f"SELECT page_id, line_no::INT AS line_no, line FROM {_LINES} WHERE len({_TOK}) BETWEEN 2 AND 4 AND length(line) BETWEEN 4 AND 40 AND NOT regexp_matches(line, '[0-9]') "
    f"AND NOT regexp_matches(line, '@|http|www|\\.com|\\.ma|\\.fr') AND len(list_filter({_TOK}, lambda x: lower(x) IN {_in([*lx.STOPWORDS, *lx.MONTHS, *lx.INSTITUTIONS])})) = 0 "
    f"AND len(list_filter({'[' + ', '.join(map(_s, lx.HEADINGS)) + ']'}, lambda h: contains(upper(line), h))) = 0"
)
def name_guard_lines(spark, d):
    w = T.tokens("line")
    ok = F.size(w).between(2, 4) & F.length("line").between(4, 40) & ~F.col("line").rlike("[0-9]") & ~F.col("line").rlike("@|http|www|\\.com|\\.ma|\\.fr")
    ok = ok & ~T.overlaps(w, [*lx.STOPWORDS, *lx.MONTHS, *lx.INSTITUTIONS]) & ~F.exists(F.array(*map(F.lit, lx.HEADINGS)), lambda h: F.contains(F.upper("line"), h))
    return _lines(_pages(spark, d)).where(ok).select("page_id", "line_no", "line")


@_query(
    f"SELECT page_id, (line_no)::INT AS line_no, line FROM (SELECT page_id, unnest(range(len(ls))) AS line_no, substr(unnest(ls), 1, 500) AS line FROM (SELECT page_id, list_filter(list_transform(string_split(raw_text, chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) >= 3)[1:30] AS ls FROM {_PAGES} WHERE raw_text IS NOT NULL)) "
    f"WHERE NOT contains(line, '@') AND NOT regexp_matches(line, '^[0-9+\\s\\-–/.]+$') AND lower(string_split_regex(line, '\\s+')[1]) NOT IN {_in(lx.SECTIONS)}"
)
def first30_lines(spark, d):
    return ner.readable_lines(_pages(spark, d), ["page_id"], "raw_text")


@_query("SELECT CASE WHEN lang IN ('fr','ar','en') THEN lang WHEN lang IN ('es','it','pt','ca') THEN 'fr' ELSE 'en' END AS family, count(*) AS n FROM documents GROUP BY 1")
def lang_family(spark, d):
    return _t(spark, d, "documents").groupBy(T.fold_language(F.col("lang")).alias("family")).agg(F.count("*").alias("n"))


_N_AR = "length(regexp_replace(raw_text, '[^\\x{0621}-\\x{064A}]', '', 'g'))"
_N_LAT = "length(regexp_replace(raw_text, '[^A-Za-z\\x{00C0}-\\x{024F}]', '', 'g'))"
_FUNCTION = lambda k: f"len(list_filter(string_split_regex(lower(raw_text), '[^a-z\\x{{00DF}}-\\x{{00FF}}]+'), lambda x: x IN {_in(lx.FUNCTION_WORDS[k])}))"
_MOST = f"greatest({', '.join(map(_FUNCTION, ('de', 'en', 'es', 'fr')))})"
_STAT = f"(CASE WHEN {_MOST} = 0 THEN NULL " + " ".join(f"WHEN {_FUNCTION(k)} = {_MOST} THEN '{k}'" for k in ("de", "en", "es", "fr")) + " END)"
_DETECT = f"CASE WHEN trim(coalesce(raw_text, ''), ' ') = '' THEN 'en' WHEN {_N_AR}::DOUBLE / greatest({_N_AR} + {_N_LAT}, 1) > 0.25 THEN 'ar' WHEN {_STAT} IN ('fr', 'es') THEN 'fr' WHEN {_STAT} IS NULL AND regexp_matches(lower(raw_text), {_s(T.FRENCH)}) THEN 'fr' ELSE 'en' END"


@_query(f"SELECT page_id, {_DETECT} AS lang FROM {_PAGES}")
def script_gate(spark, d):
    return _pages(spark, d).select("page_id", _lang().alias("lang"))


@_query(
    f"SELECT doc_id, list_transform(list_sort(list(struct_pack(p := p, lang := lang))), lambda x: x.lang)::VARCHAR AS languages FROM (SELECT doc_id, {_DETECT} AS lang, min(page_no) AS p FROM {_PAGES} WHERE trim(coalesce(raw_text, ''), ' ') <> '' GROUP BY 1, 2) GROUP BY doc_id"
)
def languages_per_file(spark, d):
    p = _pages(spark, d).where(F.trim(F.coalesce("raw_text", F.lit(""))) != "").withColumn("lang", _lang())
    out = report.languages_first_seen(p)
    return out.select("doc_id", F.concat(F.lit("["), F.array_join("languages", ", "), F.lit("]")).alias("languages"))


def _spans(source: str, text: str, begins: str, match: str) -> str:
    """SQL of the matches of a pattern from left to right: page_id, h (place s from one, match f).  ``match`` is the match
    at the head of substr(t, i), or an empty string; ``begins`` whether one may begin at place i of t."""
    return (
        f"(WITH c AS (SELECT page_id, {text} AS t, unnest(range(1, length({text}) + 1)) AS i FROM {source}), m AS (SELECT page_id, i, {match} AS f FROM c WHERE {begins}), "
        "g AS (SELECT page_id, list(struct_pack(s := i, f := f) ORDER BY i) AS l FROM m WHERE f <> '' GROUP BY page_id) "
        "SELECT page_id, unnest(list_reduce(l, lambda a, x: CASE WHEN len(a) = 0 OR x.s >= a[-1].s + length(a[-1].f) THEN list_append(a, x) ELSE a END, []::STRUCT(s BIGINT, f VARCHAR)[])) AS h FROM g)"
    )


def _best(hits_: str) -> str:
    """SQL of the hits that no better one overlaps: higher score, then longer, then earlier, then by rule."""
    rank = lambda a: f"({a}.score, {a}.\"end\" - {a}.start, -{a}.start, {a}.rule)"
    return f"WITH x AS MATERIALIZED ({hits_}) SELECT * FROM x a WHERE NOT EXISTS (SELECT 1 FROM x b WHERE b.page_id = a.page_id AND a.start < b.\"end\" AND b.start < a.\"end\" AND {rank('b')} > {rank('a')})"


def _as_hits(spans: str, entity: str, rule: str, score: str, skip: str = "0") -> str:
    return f"SELECT page_id, (h.s - 1 + {skip})::INT AS start, (h.s - 1 + length(h.f))::INT AS \"end\", substr(h.f, 1 + {skip}) AS found, '{entity}' AS entity, '{rule}' AS rule, {score}::DOUBLE AS score FROM {spans}"


# The regional rules: languages, pattern, score; none has a digit beside it.
_REGIONAL = {
    "phone_fr_trunk": (["fr"], "(?:0|\\+33\\s*(?:\\(0\\)\\s*)?)[1-9](?:[\\s.-]?[0-9]{2}){4}", 0.85),
    "phone_fr_spaced": (["fr"], "(?:0|\\+33\\s*)[1-9](?:\\s+[0-9]{2}){4}", 0.90),
    "phone_ma_international": (["ar", "fr", "en"], "(?:\\+212\\s*(?:\\(0\\)\\s*)?|00212\\s*)[5-7](?:[\\s.-]?[0-9]{2}){4}", 0.90),
    "phone_ma_trunk": (["ar", "fr", "en"], "0[5-7](?:[\\s.-]?[0-9]{2}){4}", 0.85),
    "phone_dz_tn": (["ar", "fr", "en"], "(?:\\+213|\\+216|00213|00216)[\\s.-]?[5-7][0-9](?:[\\s.-]?[0-9]{2}){3}", 0.85),
    "phone_international": (["en", "fr", "ar"], "(?:\\+|00)[1-9][0-9]{0,3}[\\s.-]?(?:\\(?[0-9]{1,4}\\)?[\\s.-]?)?[0-9]{1,4}[\\s.-]?[0-9]{2,4}[\\s.-]?[0-9]{2,9}", 0.80),
}
_SPOKEN = f"(SELECT *, {_DETECT} AS lang FROM {_PAGES} WHERE regexp_matches(raw_text, '[0-9@]|\\[at\\]'))"
_BY_RULE = " UNION ALL ".join(
    _as_hits(
        _spans(f"(SELECT * FROM {_SPOKEN} WHERE lang IN {_in(langs)})", "raw_text", "substr(t, i, 1) IN ('+', '0') AND (i = 1 OR NOT regexp_matches(substr(t, i - 1, 1), '[0-9]'))", f"regexp_extract(substr(t, i), {_s('^(' + p + ')(?:[^0-9]|$)')}, 1)"),
        "PHONE_NUMBER", name, str(score),
    )
    for name, (langs, p, score) in _REGIONAL.items()
)
_BY_RULE += " UNION ALL " + _as_hits(f"(SELECT page_id, unnest(l) AS h FROM {_MAILS} WHERE {_DETECT} = 'ar')", "EMAIL_ADDRESS", "email_ar", "1.0")


@_query(_best(_BY_RULE))
def rule_catalogue_hits(spark, d):
    p = _pages(spark, d).withColumn("lang", _lang())
    return hits.rule_hits(p, ["page_id"], "raw_text", "lang", resolve=True)


_ARW = "[\\x{0600}-\\x{06FF}]+"
_SPACED = "(i = 1 OR regexp_matches(substr(t, i - 1, 1), '[\\s\\x0B]'))"


def _arabic_sql(source: str, text: str) -> str:
    """SQL of all hits of the Arabic patterns, before overlaps are resolved."""
    at = lambda p: f"regexp_extract(substr(t, i), {_s('^(' + p + ')')}, 1)"
    letter = "regexp_matches(substr(t, i, 1), '[\\x{0600}-\\x{06FF}]')"
    first = "(?:" + "|".join(sorted(lx.ARABIC_FIRST_NAMES, key=len, reverse=True)) + ")"
    label = f"(?:{lx.ARABIC_LABELS})\\s*[:\\-]\\s*"
    alone = f"regexp_extract(substr(t, i), {_s('^(' + first + ')(?:[^' + chr(0x5C) + 'x{0600}-' + chr(0x5C) + 'x{06FF}]|$)')}, 1)"
    walk = f"CASE WHEN {at(first + '(?:' + chr(0x5C) + 's+' + _ARW + '){1,2}')} <> '' THEN {at(first + '(?:' + chr(0x5C) + 's+' + _ARW + '){1,2}')} ELSE {alone} END"
    parts = [
        _as_hits(_spans(source, text, f"{letter} AND {_SPACED}", at(f"(?:{lx.ARABIC_TITLES})\\s+{_ARW}(?:\\s+{_ARW}){{1,3}}")), "PERSON", "arabic_title", "0.90"),
        _as_hits(_spans(source, text, letter, at(f"{label}{_ARW}(?:\\s+{_ARW}){{1,3}}")), "PERSON", "arabic_label", "0.95", f"length(regexp_extract(h.f, {_s('^' + label)}))"),
        _as_hits(_spans(source, text, f"{letter} AND {_SPACED}", at(f"(?:عبد\\s+(?:{lx.ARABIC_ABD})|(?:{lx.ARABIC_DIN})\\s+الدين)(?:\\s+{_ARW}){{1,2}}")), "PERSON", "arabic_compound", "0.88"),
        _as_hits(_spans(source, text, f"{letter} AND (i = 1 OR NOT regexp_matches(substr(t, i - 1, 1), '[\\x{{0600}}-\\x{{06FF}}]'))", walk), "PERSON", "arabic_gazetteer", "CASE WHEN regexp_matches(trim(h.f, ' '), '\\s') THEN 0.85 ELSE 0.70 END"),
    ]
    return " UNION ALL ".join(parts)


_ARABIC_PAGES = f"(SELECT page_id, raw_text FROM {_PAGES} WHERE regexp_matches(raw_text, '[\\x{{0600}}-\\x{{06FF}}]'))"


@_query(_best(_arabic_sql(_ARABIC_PAGES, "raw_text")))
def arabic_person_hits(spark, d):
    return arabic.person_hits(_pages(spark, d), ["page_id"], "raw_text")


@_query(_best(_BY_RULE + " UNION ALL " + _arabic_sql(_ARABIC_PAGES, "raw_text")))
def analyzer_hits(spark, d):
    """All recognizers in one catalogue."""
    return arabic.analyzer_hits(_pages(spark, d).withColumn("lang", _lang()), ["page_id"], "raw_text", "lang")


@_query(
    f"WITH first AS MATERIALIZED ({_arabic_sql(_ARABIC_PAGES, 'raw_text')}), n AS MATERIALIZED (SELECT page_id, {_nfkc('raw_text')} AS plain FROM {_PAGES} WHERE regexp_matches(raw_text, '[\\x{{0600}}-\\x{{06FF}}\\x{{FB50}}-\\x{{FEFF}}]')) "
    f"SELECT * FROM ({_arabic_sql('n', 'plain')}) a WHERE NOT EXISTS (SELECT 1 FROM first b WHERE b.page_id = a.page_id AND b.start = a.start AND b.\"end\" = a.\"end\")"
)
def arabic_second_pass(spark, d):
    return arabic.second_pass(_pages(spark, d), ["page_id"], "raw_text")


# ---- routing and pages -----------------------------------------------------------------------------

_NC = "length(trim(coalesce(raw_text, ''), ' '))"


@_query(
    f"SELECT doc_id, count(*) AS n_pages, sum({_NC})::BIGINT AS n_chars, sum(CASE WHEN {_NC} = 0 THEN 1 ELSE 0 END)::BIGINT AS n_needs_ocr, sum({_NC}) < 50 * count(*) AS is_scanned FROM {_PAGES} GROUP BY doc_id"
)
def scanned_routing(spark, d):
    return ocr.scanned(_pages(spark, d))


@_query(
    f"SELECT doc_id, coalesce(min(page_no) FILTER ({_NC} > 30 OR coalesce(n_images, 0) > 0), min(page_no)) AS first_page FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY page_no) AS rk FROM {_PAGES}) WHERE rk <= 3 GROUP BY doc_id"
)
def first_nonblank_page(spark, d):
    return ocr.first_written_page(_pages(spark, d))


@_query(f"SELECT doc_id, sum({_NC})::BIGINT AS n_chars, count(*) FILTER ({_NC} = 0) AS n_blank FROM {_PAGES} GROUP BY doc_id")
def text_chars_per_file(spark, d):
    n = F.length(F.trim(F.coalesce("raw_text", F.lit(""))))
    return _pages(spark, d).groupBy("doc_id").agg(F.sum(n).cast("bigint").alias("n_chars"), F.count_if(n == 0).alias("n_blank"))


@_query(f"SELECT page_id, line_no::INT AS line_no, coalesce(sum(length(line) + 1) OVER (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_chars FROM {_LINES}")
def ocr_running_offsets(spark, d):
    out = ocr.running_offsets(_lines(_pages(spark, d)), ["page_id"], "line_no", "line")
    return out.select("page_id", "line_no", F.col("offset").alias("offset_chars"))


# ---- files -----------------------------------------------------------------------------------------

_EXT = "lower(regexp_extract(string_split(rel_path, '/')[-1], '\\.([^.]+)$', 1))"


@_query(
    f"SELECT doc_id, rel_path, {_EXT} AS extension, CASE WHEN {_EXT} = 'pdf' THEN 'redact_pdf' WHEN {_EXT} IN ('jpg','jpeg','png') THEN 'redact_image' ELSE 'copy' END AS action, {_EXT} NOT IN ('pdf','jpg','jpeg','png') AS unprotected, "
    f"CASE WHEN {_EXT} IN ('jpg','jpeg') THEN 'JPEG' ELSE 'PNG' END AS image_format, 'result/' || rel_path AS out_path FROM dossier_files"
)
def file_dispatch(spark, d):
    f = report.dispatch(_t(spark, d, "dossier_files"))
    return f.select("doc_id", "rel_path", T.extension("rel_path").alias("extension"), "action", "unprotected", report.image_format("rel_path").alias("image_format"), report.output_path("result", "rel_path").alias("out_path"))


@_query("SELECT count(DISTINCT dossier_id) AS n_dossiers, count(DISTINCT doc_id) AS n_files, count(*) FILTER (dossier_id IS NULL) AS n_loose FROM dossier_files")
def dossier_counts(spark, d):
    return _t(spark, d, "dossier_files").agg(F.countDistinct("dossier_id").alias("n_dossiers"), F.countDistinct("doc_id").alias("n_files"), F.count_if(F.col("dossier_id").isNull()).alias("n_loose"))


@_query("SELECT string_split(rel_path, '/')[1] AS dossier_folder, count(DISTINCT rel_path) AS n_files FROM dossier_files WHERE contains(rel_path, '/') GROUP BY 1")
def dossier_folders(spark, d):
    from ..sources.files import with_dossier

    return with_dossier(_t(spark, d, "dossier_files").select("rel_path")).groupBy(F.col("dossier_id").alias("dossier_folder")).agg(F.countDistinct("rel_path").alias("n_files"))


_PRIO = "CASE WHEN regexp_matches(lower(string_split(rel_path, '/')[-1]), 'cv|resume') THEN 1 WHEN lower(rel_path) LIKE '%.pdf' THEN 2 END"


@_query(f"SELECT dossier_id, rel_path, priority::INT AS priority FROM (SELECT dossier_id, rel_path, {_PRIO} AS priority, row_number() OVER (PARTITION BY dossier_id ORDER BY {_PRIO}, rel_path) AS rn FROM dossier_files WHERE dossier_id IS NOT NULL AND {_PRIO} IS NOT NULL) WHERE rn = 1")
def dossier_cv_pick(spark, d):
    return identity.cv_pick(_t(spark, d, "dossier_files"))


@_query(f"SELECT dossier_id, count(DISTINCT rel_path) AS n_other FROM dossier_files f WHERE dossier_id IS NOT NULL AND rel_path <> coalesce((SELECT rel_path FROM (SELECT dossier_id AS k, rel_path, row_number() OVER (PARTITION BY dossier_id ORDER BY {_PRIO}, rel_path) AS rn FROM dossier_files WHERE {_PRIO} IS NOT NULL) WHERE rn = 1 AND k = f.dossier_id), '') GROUP BY dossier_id")
def files_beside_cv(spark, d):
    f = _t(spark, d, "dossier_files").where("dossier_id is not null")
    return report.without_cv(f, identity.cv_pick(f)).groupBy("dossier_id").agg(F.countDistinct("rel_path").alias("n_other"))


# ---- identity --------------------------------------------------------------------------------------

_AL = "[\\x{0600}-\\x{06FF}]"
_FOLD = lambda c: f"translate(regexp_replace({c}, '[\\x{{0640}}\\x{{064B}}-\\x{{065F}}\\x{{0670}}]', '', 'g'), 'إأآٱ', 'اااا')"
_COLL = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'), ' ')"
_CLEAN = lambda c: f"regexp_replace(regexp_replace({_COLL(c)}, '(?i)^(?:{lx.HONORIFICS})\\s+', ''), '^(?:{lx.PLACES})\\s*', '')"
_FOLDED = [g.translate(str.maketrans("إأآٱ", "اااا")) for g in (*lx.GIVEN_NAMES, *lx.ARABIC_FIRST_NAMES)]
_ABD = lambda c: f"CASE WHEN contains({c}, 'عبد ') THEN replace({c}, 'عبد ', 'عبد') WHEN contains({c}, 'عبد') THEN regexp_replace({c}, 'عبد([\\x{{0621}}-\\x{{064A}}]+)', 'عبد \\1', 'g') END"


def _terms_sql(source: str) -> str:
    """SQL of ``identity.search_terms``: rows (k, term) from a source of (k, name)."""
    return (
        f"(SELECT DISTINCT k, term FROM (SELECT k, unnest(list_transform(list_filter(list_concat([c, CASE WHEN len(w) = 2 THEN w[2] || ' ' || w[1] END], list_filter(w, lambda x: length(x) >= 5 AND lower(x) NOT IN {_in(lx.GIVEN_NAMES)} AND lower(x) NOT IN {_in(lx.STOPWORDS)}), "
        f"CASE WHEN regexp_matches(c, '{_AL}') THEN list_concat([p, {_ABD('p')}], list_filter(list_filter(string_split_regex(p, '\\s+'), lambda x: x <> ''), lambda x: length(x) >= 4 AND x NOT IN {_in(_FOLDED)} AND x NOT IN {_in(lx.STOPWORDS)})) ELSE [] END), lambda x: x IS NOT NULL), lambda x: lower(x))) AS term "
        f"FROM (SELECT k, c, list_filter(string_split_regex(c, '[\\s\\-]+'), lambda x: x <> '') AS w, {_FOLD('c')} AS p FROM (SELECT k, {_CLEAN('name')} AS c FROM {source}) WHERE length(c) >= 3)) WHERE term IS NOT NULL)"
    )


_CAND = "(SELECT DISTINCT name_id AS k, candidate_name AS name FROM candidate_names WHERE candidate_name IS NOT NULL)"
_DOSS = "(SELECT dossier_id AS k, unnest(cand_names) AS name FROM dossier_identities)"


@_query(f"SELECT k AS name_id, term FROM {_terms_sql(_CAND)}")
def identity_expand(spark, d):
    n = _t(spark, d, "candidate_names").where("candidate_name is not null").select("name_id", "candidate_name").distinct()
    return n.select("name_id", F.explode(identity.search_terms("candidate_name")).alias("term"))


def _dossier_terms(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "dossier_identities").select("dossier_id", F.explode("cand_names").alias("name"), F.lit("dossier").alias("origin"))
    return identity.identities(n)


@_query(f"SELECT f.doc_id, f.dossier_id, coalesce(t.n, 0) AS n_terms FROM (SELECT DISTINCT doc_id, dossier_id FROM dossier_files) f LEFT JOIN (SELECT k, count(*) AS n FROM {_terms_sql(_DOSS)} GROUP BY k) t ON f.dossier_id = t.k")
def dossier_propagation(spark, d):
    f = _t(spark, d, "dossier_files").select("doc_id", "dossier_id").distinct()
    out = identity.propagate(f, _dossier_terms(spark, d))
    return out.select("doc_id", "dossier_id", F.coalesce(F.when(F.col("terms").isNotNull(), F.size("terms")), F.lit(0)).cast("bigint").alias("n_terms"))


@_query(
    f"SELECT page_id, term, n_hits FROM (SELECT p.page_id, t.term, ((length(lower(raw_text)) - length(replace(lower(raw_text), t.term, ''))) // length(t.term))::INT AS n_hits FROM {_PAGES} p JOIN {_terms_sql(_DOSS)} t ON p.dossier_id = t.k WHERE trim(raw_text, ' ') <> '') WHERE n_hits > 0"
)
def name_term_hits(spark, d):
    return identity.term_hits(_pages(spark, d), _dossier_terms(spark, d), ["page_id"], "raw_text").select("page_id", "term", "n_hits")


_KEEP = "[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200C}\\x{200D}\\s\\x{00A0}\\x{0085}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0600}-\\x{06FF}\\x{FB50}-\\x{FEFF}\\-.]"
_LAB = "(?i)(?:^|[^A-Za-z0-9_\\x{00C0}-\\x{024F}])(?:Nom(?:\\s+et\\s+pr[eé]nom)?|Name|الاسم(?:\\s+الكامل)?|المرشح|صاحب\\s+السيرة)\\s*[:\\-]\\s*([^\\n\\r]+(?:\\n[^\\n\\r:]+)?)"
_LSEP = "\\s+[-–•]\\s+|\\s*\\|\\s*|:"
_FIRST = f"(SELECT doc_id, coalesce(min(page_no) FILTER (length(trim(coalesce(raw_text, ''), ' ')) > 30 OR coalesce(n_images, 0) > 0), min(page_no)) AS first_page FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY page_no) AS rk FROM {_PAGES}) WHERE rk <= 3 GROUP BY doc_id)"
_TARGET = f"(SELECT p.* FROM {_PAGES} p JOIN {_FIRST} f ON p.doc_id IS NOT DISTINCT FROM f.doc_id AND p.page_no = f.first_page)"


def _label_sql(key: str, source: str) -> str:
    c = f"trim(regexp_replace(trim(string_split_regex({_COLL(f'regexp_extract({_READY}, {_s(_LAB)}, 1)')}, {_s(_LSEP)})[1], ' '), {_s(_KEEP)}, '', 'g'), ' ')"
    w = f"SELECT {key}, c, list_filter(string_split_regex(c, '[\\s\\-_]+'), lambda x: x <> '') AS w FROM (SELECT {key}, {c} AS c FROM {source} WHERE raw_text IS NOT NULL)"
    return f"SELECT {key}, list_aggregate(w, 'string_agg', ' ') AS name FROM ({w}) WHERE len(w) BETWEEN 1 AND 4 AND NOT regexp_matches(c, '[0-9]') AND len(list_filter(w, lambda x: lower(x) IN {_in([*lx.MONTHS, *lx.STOPWORDS])})) = 0"


@_query(_label_sql("page_id", _TARGET))
def label_extract(spark, d):
    """Name after a label on the first written page of each file, the text brought to its compatibility form first."""
    p = identity.target_pages(_pages(spark, d)).select("page_id", T.label_ready("raw_text").alias("ready"))
    return p.select("page_id", identity.label_candidate("ready").alias("name")).where("name is not null")


_UP, _ANY = "[A-Z\\x{00C0}-\\x{0178}]", "[a-zA-Z\\x{00C0}-\\x{0178}\\s\\-]+?"
_FR_TITLE, _EN_TITLE = "(?:M\\.|Mme|Mlle|Monsieur|Madame)?", "(?:Mr\\.|Ms\\.|Mrs\\.)?"
_GIVEN_TO = (
    f"(?i)(?:atteste|certifie)\\s+que\\s+{_FR_TITLE}\\s*({_UP}{_ANY})(?:\\s*,|\\s+a\\s+|\\s+est\\s+|\\s+n[eé]\\s+|\\s+titulaire|\\s+matricule|\\n|\\r)",
    f"(?i)(?:d[eé]cern[eé]e?|accord[eé]e?|attribu[eé]e?|d[eé]livr[eé]e?|remis)\\s+[aà]\\s+{_FR_TITLE}\\s*({_UP}{_ANY})(?:\\s*,|\\s+pour\\s+|\\s+a\\s+|\\s+le\\s+|\\n|\\r)",
    f"(?i)au\\s+profit\\s+de\\s+{_FR_TITLE}\\s*({_UP}{_ANY})(?:\\s*,|\\s+pour\\s+|\\n|\\r)",
    f"(?i)(?:certify\\s+that|awarded\\s+to|presented\\s+to|conferred\\s+upon)\\s+{_EN_TITLE}\\s*([A-Z][a-zA-Z\\s\\-]+?)(?:\\s*,|\\s+for\\s+|\\s+has\\s+|\\n|\\r)",
    "(?i)(?:نشهد\\s+أن|يشهد\\s+أن)\\s+(?:السيد|السيدة|الآنسة|الطالب|التلميذ)?\\s*([^\\n\\r,]+?)(?:\\s*,|\\s+قد|\\s+أنه|\\n|\\r)",
)


def _attest_sql(p: str, key: str) -> str:
    c = f"trim(string_split_regex({_COLL(f'regexp_extract({_READY}, {_s(p)}, 1)')}, '\\s*[:•|]\\s*|\\s+[-–]\\s+')[1], ' ')"
    w = "list_filter(string_split_regex(c, '\\s+'), lambda x: x <> '')"
    ok = f"len({w}) BETWEEN 2 AND 4 AND len(list_filter({w}, lambda x: lower(x) IN {_in([*lx.STOPWORDS, *lx.INSTITUTIONS])})) = 0"
    part = "length(x) >= 4 AND (regexp_matches(x, '^\\p{Lu}') OR regexp_matches(x, '\\p{Lu}') AND NOT regexp_matches(x, '\\p{Ll}'))"
    return f"SELECT {key}, unnest(list_concat([list_aggregate({w}, 'string_agg', ' ')], list_filter({w}, lambda x: {part}))) AS name FROM (SELECT {key}, {c} AS c FROM {_PAGES} WHERE page_no = 1 AND raw_text IS NOT NULL) WHERE {ok}"


@_query("SELECT DISTINCT page_id, name FROM (" + " UNION ALL ".join(_attest_sql(p, "page_id") for p in _GIVEN_TO) + ")")
def attestation_extract(spark, d):
    """Recipients named on first pages, the text brought to its compatibility form first."""
    p = _pages(spark, d).where("page_no = 1 and raw_text is not null").select("page_id", T.label_ready("raw_text").alias("ready"))
    return p.select("page_id", F.explode(identity.attestation_candidates("ready")).alias("name"))


@_query(f"SELECT name_id, {_FOLD('candidate_name')} AS folded FROM (SELECT DISTINCT name_id, candidate_name FROM candidate_names WHERE candidate_name IS NOT NULL)")
def arabic_alef_fold(spark, d):
    return _t(spark, d, "candidate_names").where("candidate_name is not null").select("name_id", "candidate_name").distinct().select("name_id", T.fold_arabic("candidate_name").alias("folded"))


@_query(
    f"SELECT name_id, lower(c) AS low, CASE WHEN len(w) = 2 THEN w[2] || ' ' || w[1] END AS inverted, {_ABD('c')} AS abd, regexp_matches(c, '{_AL}') AS arabic FROM (SELECT name_id, c, list_filter(string_split_regex(c, '[\\s\\-]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT name_id, {_CLEAN('candidate_name')} AS c FROM candidate_names WHERE candidate_name IS NOT NULL))"
)
def name_forms(spark, d):
    c = T.strip_place(T.strip_honorific(T.collapse("candidate_name")))
    n = _t(spark, d, "candidate_names").where("candidate_name is not null").select("name_id", c.alias("c")).distinct()
    return n.select("name_id", F.lower("c").alias("low"), T.inverted("c").alias("inverted"), T.abd_variant("c").alias("abd"), T.has_arabic("c", False).alias("arabic"))


_TITLE_CASE = lambda c: f"list_aggregate(list_transform(range(1, length({c}) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(substr({c}, i - 1, 1), '[\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]') THEN upper(substr({c}, i, 1)) ELSE lower(substr({c}, i, 1)) END), 'string_agg', '')"


@_query(f"SELECT DISTINCT name_id, {_FOLD(_nfkc('candidate_name'))} AS normal FROM candidate_names WHERE candidate_name IS NOT NULL")
def nfkc_names(spark, d):
    return _t(spark, d, "candidate_names").where("candidate_name is not null").select("name_id", T.normalize_arabic("candidate_name").alias("normal")).distinct()


@_query(f"SELECT DISTINCT name_id, unnest([candidate_name, upper(candidate_name), {_TITLE_CASE('candidate_name')}, lower(candidate_name)]) AS form FROM candidate_names WHERE candidate_name <> ''")
def case_forms(spark, d):
    """Names in all the cases in which they are searched."""
    n = _t(spark, d, "candidate_names").where("candidate_name <> ''").select("name_id", F.explode(T.case_variants("candidate_name")).alias("form"))
    return n.distinct()


@_query("SELECT dossier_id, origin, count(DISTINCT candidate_name) AS n_names FROM candidate_names WHERE dossier_id IS NOT NULL AND candidate_name IS NOT NULL GROUP BY 1, 2")
def names_by_origin(spark, d):
    return _t(spark, d, "candidate_names").where("dossier_id is not null and candidate_name is not null").groupBy("dossier_id", "origin").agg(F.countDistinct("candidate_name").alias("n_names"))


_AR_TERMS = f"(SELECT k, {_FOLD('term')} AS target FROM {_terms_sql(_DOSS)} WHERE regexp_matches(term, '{_AL}'))"


@_query(
    f"SELECT DISTINCT page_id, word FROM (SELECT page_id, dossier_id, word, {_FOLD(_nfkc('word'))} AS plain FROM (SELECT DISTINCT page_id, dossier_id, unnest(string_split_regex(raw_text, '\\s+')) AS word FROM {_PAGES}) WHERE regexp_matches(word, '{_AL}')) w JOIN {_AR_TERMS} t ON w.dossier_id = t.k "
    f"WHERE length(plain) >= 4 AND plain NOT IN {_in([x.translate(str.maketrans('إأآٱ', 'اااا')) for x in lx.ARABIC_FIRST_NAMES])} AND (plain = target OR length(plain) >= 5 AND contains(target, plain))"
)
def arabic_word_hits(spark, d):
    p = _pages(spark, d).where(T.has_arabic("raw_text", False))
    words = p.select("page_id", "dossier_id", F.explode(F.split("raw_text", "\\s+")).alias("word")).where(T.has_arabic("word", False)).distinct()
    return identity.arabic_word_hits(words, _dossier_terms(spark, d), ["page_id"], sized=_t(spark, d, "dossier_pages")).select("page_id", "word")


# ---- recognized lines and tokens -------------------------------------------------------------------

_CLASS = "CASE WHEN regexp_matches(regexp_replace(line, '[\\s.-]', '', 'g'), {p}) THEN 'PHONE_NUMBER' WHEN contains(line, '@') AND contains(line, '.') THEN 'EMAIL_ADDRESS' END".format(p=_s(P.OCR_PHONE))
_NAMED = "coalesce(len(list_filter(terms, lambda t: length(t) >= 4 AND contains(lower(line), t))) > 0, false)"
_STOP, _GIV = f"lower(trim(line, ' ')) IN {_in(lx.STOPWORDS)}", f"lower(trim(line, ' ')) IN {_in(lx.GIVEN_NAMES)}"


@_query(
    f"SELECT page_id, line_no::INT AS line_no, CASE WHEN {_NAMED} THEN CASE WHEN NOT {_STOP} AND NOT {_GIV} THEN 'PERSON' END ELSE {_CLASS} END AS card, CASE WHEN {_NAMED} AND NOT {_STOP} THEN 'PERSON' ELSE {_CLASS} END AS page, "
    f"CASE WHEN {_NAMED} AND NOT {_STOP} AND NOT {_GIV} THEN 'PERSON' ELSE {_CLASS} END AS image FROM {_HEAD} h LEFT JOIN (SELECT k, list(term) AS terms FROM {_terms_sql(_DOSS)} GROUP BY k) t ON h.dossier_id = t.k"
)
def ocr_classify(spark, d):
    per = _dossier_terms(spark, d).groupBy("dossier_id").agg(F.collect_list("term").alias("terms"))
    h = _lines(_pages(spark, d), "header_text").join(per, "dossier_id", "left")
    return h.select("page_id", "line_no", *[ocr.classify(v, "line", F.col("terms")).alias(v) for v in ("card", "page", "image")])


_TOKENS = (
    "(SELECT page_id AS doc_id, (line_no * 100 + wn)::INT AS seq, CASE WHEN regexp_matches(word, '^[A-Z]') THEN 'PER' ELSE 'O' END AS entity_group, word, s::INT AS start, (s + length(word))::INT AS \"end\", round((50 + (length(word) * 7 + wn * 3) % 50) / 100.0, 2)::DOUBLE AS score FROM "
    f"(SELECT page_id, line_no, wn, ws[wn + 1] AS word, coalesce(list_sum(list_transform(ws[1:wn], lambda x: length(x) + 1)), 0) + line_no * 1000 AS s FROM (SELECT page_id, line_no, ws, unnest(range(len(ws))) AS wn FROM (SELECT page_id, line_no, string_split(line, ' ') AS ws FROM {_HEAD}))) WHERE word <> '')"
)


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens as a recognizer would give them, one per word of a header."""
    w = _lines(_pages(spark, d), "header_text").select("page_id", "line_no", F.split("line", " ").alias("ws"))
    w = w.select("page_id", "line_no", "ws", F.posexplode("ws").alias("wn", "word"))
    start = F.aggregate(F.slice("ws", 1, F.col("wn")), F.lit(0), lambda a, x: a + F.length(x) + 1) + F.col("line_no") * 1000
    score = F.round((50 + (F.length("word") * 7 + F.col("wn") * 3) % 50) / 100.0, 2)
    return w.where("word <> ''").select(
        F.col("page_id").alias("doc_id"), (F.col("line_no") * 100 + F.col("wn")).alias("seq"), F.when(F.col("word").rlike("^[A-Z]"), "PER").otherwise("O").alias("entity_group"),
        "word", start.alias("start"), (start + F.length("word")).alias("end"), score.alias("score"),
    )


@_query(
    f"WITH t AS {_TOKENS}, m AS (SELECT *, coalesce(lag(entity_group) OVER w = entity_group AND start <= lag(\"end\") OVER w + 1, false) AS joins, lag(\"end\") OVER w AS pe FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY seq)), i AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM m) "
    "SELECT doc_id, min(seq) AS first_seq, min(entity_group) AS entity_group, string_agg(CASE WHEN joins AND start > pe THEN ' ' ELSE '' END || word, '' ORDER BY seq) AS word, min(start) AS start, max(\"end\") AS \"end\", min(score) AS score FROM i GROUP BY doc_id, island"
)
def ner_fold(spark, d):
    return ner.fold_tokens(_tokens(spark, d))


def _placed_sql(c: str) -> str:
    inner = f"regexp_replace({c}, '##', '', 'g')"
    return f"regexp_replace(trim(regexp_replace({_COLL(inner)}, {_s(_KEEP)}, '', 'g'), ' '), '^(?:{lx.PLACES})\\s*', '')"


_NER = (
    f"(SELECT doc_id, name FROM (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, name) AS rn FROM (SELECT *, list_filter(string_split_regex(name, '\\s+'), lambda x: x <> '') AS w, regexp_matches(name, '[\\x{{0600}}-\\x{{06FF}}\\x{{FB50}}-\\x{{FEFF}}]') AS arabic "
    f"FROM (SELECT doc_id, score, entity_group, {_placed_sql('word')} AS name FROM ({_SQL['ner_fold']}))) "
    f"WHERE entity_group = 'PER' AND score >= 0.8 AND len(w) BETWEEN CASE WHEN arabic THEN 1 ELSE 2 END AND 4 AND length(name) >= 5 AND len(list_filter(w, lambda x: lower(x) IN {_in(lx.STOPWORDS)})) = 0 AND (arabic OR len(list_filter(w, lambda x: NOT regexp_matches(x, '^\\p{{Lu}}'))) = 0)) WHERE rn = 1)"
)


@_query(f"SELECT doc_id, name FROM {_NER}")
def ner_accepted(spark, d):
    """The longest accepted name among the folded tokens of each header, the limit on the score included."""
    return ner.longest_name(ner.accepted_names(ner.fold_tokens(_tokens(spark, d))))


# ---- geometry --------------------------------------------------------------------------------------

_WORDS = (
    f"(SELECT page_id, line_no::INT AS line_no, wn::INT AS word_no, word, (s * 6.0)::DOUBLE AS x0, (line_no * 12.0)::DOUBLE AS y0, ((s + length(word)) * 6.0)::DOUBLE AS x1, (line_no * 12.0 + 12)::DOUBLE AS y1, line_no * 1000 + wn AS id FROM "
    f"(SELECT page_id, line_no, wn, ws[wn + 1] AS word, coalesce(list_sum(list_transform(ws[1:wn], lambda x: length(x) + 1)), 0) AS s FROM (SELECT page_id, line_no, ws, unnest(range(len(ws))) AS wn FROM (SELECT page_id, line_no, string_split(line, ' ') AS ws FROM {_HEAD}))) WHERE word <> '')"
)


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Words of the headers with boxes; id grows in reading order."""
    return layout.words_of(_pages(spark, d), ["page_id"], "header_text").withColumn("id", (F.col("line_no") * 1000 + F.col("word_no")).cast("bigint"))


# A box per word, widened by the word's place so that some contain others.
_BOXES = f"(SELECT page_id, id, x0 - (id % 3) * 20 AS x0, y0 - (id % 3) * 13 AS y0, x1 + (id % 3) * 20 AS x1, y1 + (id % 3) * 13 AS y1 FROM {_WORDS})"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    by = F.col("id") % 3
    r = F.col("rect")
    return _words(spark, d).select("page_id", "id", G.rect(r["x0"] - by * 20, r["y0"] - by * 13, r["x1"] + by * 20, r["y1"] + by * 13).alias("rect"))


def _flat(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.col(f"rect.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])


@_query(f"SELECT page_id, id, x0, y0, x1, y1 FROM {_BOXES} a WHERE NOT EXISTS (SELECT 1 FROM {_BOXES} b WHERE b.page_id = a.page_id AND b.id <> a.id AND b.x0 <= a.x0 AND b.y0 <= a.y0 AND b.x1 >= a.x1 AND b.y1 >= a.y1 AND (b.x0 <> a.x0 OR b.y0 <> a.y0 OR b.x1 <> a.x1 OR b.y1 <> a.y1 OR b.id < a.id))")
def rect_containment_dedupe(spark, d):
    return _flat(layout.maximal(_boxes(spark, d), ["page_id"]), "page_id", "id")


@_query(
    f"WITH RECURSIVE b AS MATERIALIZED (SELECT * FROM {_BOXES}), e AS MATERIALIZED (SELECT x.page_id, x.id AS i, y.id AS j FROM b x JOIN b y ON x.page_id = y.page_id AND x.x0 < y.x1 AND y.x0 < x.x1 AND x.y0 < y.y1 AND y.y0 < x.y1), "
    "r AS (SELECT page_id, i, j FROM e UNION SELECT r.page_id, r.i, e.j FROM r JOIN e ON e.page_id = r.page_id AND e.i = r.j), "
    "c AS (SELECT page_id, i, min(j) AS root FROM r GROUP BY 1, 2) SELECT b.page_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM b JOIN c ON c.page_id = b.page_id AND c.i = b.id GROUP BY b.page_id, root"
)
def rect_union(spark, d):
    return layout.union_boxes(_boxes(spark, d), ["page_id"])


@_query(f"SELECT page_id, id, x0, y0, x1, y1 FROM {_BOXES} a WHERE id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM {_BOXES} b WHERE b.id % 3 = 2 AND b.page_id = a.page_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)")
def boxes_outside_images(spark, d):
    b = _boxes(spark, d)
    return _flat(layout.outside(b.where("id % 3 = 0"), b.where("id % 3 = 2"), ["page_id"]), "page_id", "id")


_DIGITS = "length(regexp_replace(word, '[^0-9]', '', 'g'))"


@_query(
    f"SELECT t.page_id, t.id, coalesce(min(p.x0), t.x0) - 2 AS x0, t.y0 - 2 AS y0, t.x1 + 2 AS x1, t.y1 + 2 AS y1 FROM (SELECT * FROM {_WORDS} WHERE {_DIGITS} >= 2 AND NOT starts_with(word, '+')) t LEFT JOIN (SELECT * FROM {_WORDS} WHERE starts_with(word, '+') OR word = '212') p "
    "ON p.page_id = t.page_id AND p.x0 >= t.x0 - 45 AND p.x1 <= t.x0 AND p.y0 < t.y1 + 2 AND t.y0 - 2 < p.y1 GROUP BY t.page_id, t.id, t.x0, t.y0, t.x1, t.y1"
)
def band_prefix_absorb(spark, d):
    w = _words(spark, d)
    targets = w.where((T.digit_count("word") >= 2) & ~F.col("word").startswith("+"))
    prefixes = w.where(F.col("word").startswith("+") | (F.col("word") == "212"))
    return _flat(layout.band_left(targets, prefixes, ["page_id"]), "page_id", "id")


@_query(f"SELECT c.page_id, c.id, string_agg(w.word, ' ' ORDER BY w.line_no, w.word_no) AS text FROM (SELECT page_id, 1::BIGINT AS id, 0.0 AS x0, 0.0 AS y0, 150.0 AS x1, 18.0 AS y1 FROM {_PAGES} WHERE header_text IS NOT NULL) c JOIN {_WORDS} w ON w.page_id = c.page_id AND w.x0 < c.x1 AND c.x0 < w.x1 AND w.y0 < c.y1 AND c.y0 < w.y1 GROUP BY 1, 2")
def clipped_text(spark, d):
    clip = _pages(spark, d).where("header_text is not null").select("page_id", F.lit(1).cast("bigint").alias("id"), G.rect(0.0, 0.0, 150.0, 18.0).alias("rect"))
    return layout.clipped_text(_words(spark, d), clip, ["page_id"])


@_query(
    "SELECT page_id, width * 0.1 - 2 AS px0, height * 0.1 - 2 AS py0, width * 0.3 + 2 AS px1, height * 0.2 + 2 AS py1, least(10.0, width / 2) AS qx0, 5.0 AS qy0, greatest(10.0, width / 2) AS qx1, 40.0 AS qy1, "
    "width * 0.1 + 20 * (width * 0.2 / 200) - 2 AS ax0, height * 0.1 + 10 * (height * 0.1 / 100) - 2 AS ay0, width * 0.1 + 120 * (width * 0.2 / 200) + 2 AS ax1, height * 0.1 + 60 * (height * 0.1 / 100) + 2 AS ay1, "
    f"greatest(0.0, width * 0.1 - width * 0.2 * 0.2) AS fx0, least(height, height * 0.2 + height * 0.1 * 0.2 * 1.25) AS fy1, height * 0.1 < height * 0.4 AS in_top FROM (SELECT page_id, width, height FROM {_PAGES} WHERE width IS NOT NULL AND height IS NOT NULL)"
)
def box_transforms(spark, d):
    w, h = F.col("width"), F.col("height")
    placed = _pages(spark, d).where("width is not null and height is not null").select("page_id", "width", "height", G.rect(w * 0.1, h * 0.1, w * 0.1 + w * 0.2, h * 0.1 + h * 0.1).alias("rect"))
    placed = placed.withColumn("rect", G.rect(w * 0.1, h * 0.1, w * 0.3, h * 0.2))
    quad = F.array(*[F.struct(x.cast("double").alias("x"), F.lit(float(y)).alias("y")) for x, y in ((F.lit(10.0), 5), (w / 2, 8), (w / 2, 40), (F.lit(10.0), 38))])
    p, q = G.pad(F.col("rect")), G.quad_to_rect(quad)
    base = G.rect(w * 0.1, h * 0.1, w * 0.1 + w * 0.2, h * 0.1 + h * 0.1)
    rough = G.pixels_to_page(G.rect(20.0, 10.0, 120.0, 60.0), F.struct(base["x0"].alias("x0"), base["y0"].alias("y0"), base["x1"].alias("x1"), base["y1"].alias("y1")), F.lit(200), F.lit(100))
    f = G.pad_face(F.col("rect"), w, h)
    pick = lambda r, pre, names: [r[n].alias(f"{pre}{n}") for n in names]
    all_ = ("x0", "y0", "x1", "y1")
    out = placed.select("page_id", *pick(p, "p", all_), *pick(q, "q", all_), *pick(rough, "a", all_), *pick(f, "f", ("x0", "y1")), (F.col("rect.y0") < h * layout.TOP).alias("in_top"))
    return out


_SPANS = f"(SELECT page_id AS doc_id, (line_no // 2)::INT AS block_no, line_no::INT AS line_no, line AS text, (9 + (length(line) * 7 + line_no * 5) % 15)::DOUBLE AS font, ((line_no // 2) * 60)::DOUBLE AS y0 FROM {_HEAD} WHERE trim(line, ' ') <> '' AND (line_no // 2) * 60 < 842 * 0.4)"
_SW = "list_filter(string_split_regex(name, '[\\s\\-]+'), lambda x: x <> '')"


@_query(
    f"WITH s AS {_SPANS}, m AS (SELECT *, max(font) OVER (PARTITION BY doc_id, block_no) AS most FROM s), c AS (SELECT doc_id, max(most) AS font, y0, string_agg(trim(text, ' '), ' ' ORDER BY line_no) AS text FROM m WHERE most >= 13 AND font >= most - 3.5 GROUP BY doc_id, block_no, y0 UNION ALL SELECT doc_id, font, y0, trim(text, ' ') FROM m WHERE most < 13), "
    f"n AS (SELECT doc_id, font, y0, regexp_replace({_CLEAN('text')}, '^[ :,;.\\-/|*]+|[ :,;.\\-/|*]+$', '', 'g') AS name FROM c) SELECT doc_id, name, font, y0 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY font DESC, y0, name) AS rn FROM n WHERE NOT regexp_matches(name, '[0-9]') AND NOT regexp_matches(name, '@|http|www|\\.com|\\.ma|\\.fr') "
    f"AND len(list_filter({_SW}, lambda x: lower(x) IN {_in([*lx.MONTHS, *lx.STOPWORDS])})) = 0 AND len(list_filter({'[' + ', '.join(map(_s, lx.HEADINGS)) + ']'}, lambda h: contains(upper(name), h))) = 0 "
    f"AND ((len({_SW}) BETWEEN 2 AND 4 AND length(name) BETWEEN 4 AND 40) OR (len({_SW}) = 1 AND length(name) BETWEEN 4 AND 25 AND font >= 18))) WHERE rn = 1"
)
def layout_top_candidate(spark, d):
    h = _lines(_pages(spark, d), "header_text")
    block = (F.col("line_no") / 2).cast("int")
    spans = h.select(
        F.col("page_id").alias("doc_id"), block.alias("block_no"), "line_no", F.lit(0).alias("span_no"), F.col("line").alias("text"),
        (9 + (F.length("line") * 7 + F.col("line_no") * 5) % 15).cast("double").alias("font"), (block * 60).cast("double").alias("y0"), F.lit(842.0).alias("height"),
    )
    return layout.layout_name(spans)


def _card_sql(text: str) -> str:
    return (
        f"list_filter(list_transform(string_split({text}, chr(10))[1:6], lambda x: regexp_replace({_COLL('x')}, '(?i)^(?:{lx.HONORIFICS})\\s+', '')), lambda x: len(list_filter(string_split_regex(x, '\\s+'), lambda y: y <> '')) BETWEEN 1 AND 4 AND length(x) BETWEEN 4 AND 40 "
        f"AND len(list_filter(string_split_regex(x, '\\s+'), lambda y: lower(y) IN {_in(lx.STOPWORDS)})) = 0 AND NOT regexp_matches(x, '@|http|\\.com|[0-9]{{5,}}'))[1]"
    )


@_query(
    f"SELECT page_id, step::INT AS step, name FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY step, name) AS rn FROM (SELECT page_id, 0 AS step, name FROM ({_SQL['label_extract']}) UNION ALL SELECT doc_id, 1, name FROM ({_SQL['layout_top_candidate']}) "
    f"UNION ALL SELECT page_id, 2, {_card_sql('header_text')} FROM {_PAGES} UNION ALL SELECT page_id, 3, {_card_sql('raw_text')} FROM {_PAGES} WHERE length(trim(raw_text, ' ')) < 80 UNION ALL SELECT doc_id, 4, name FROM {_NER}) WHERE name IS NOT NULL AND page_id IN (SELECT page_id FROM {_TARGET})) WHERE rn = 1"
)
def name_cascade(spark, d):
    """Candidate's name on the first written page of each file: label, else layout, else card, else the lines of a page
    of under 80 characters (a scanned one), else recognizer."""
    p = identity.target_pages(_pages(spark, d))
    keys = p.select("page_id")
    of = lambda df: df.select(F.col("doc_id").alias("page_id"), "name").join(keys, "page_id", "left_semi")
    card = p.select("page_id", ocr.header_name(F.split("header_text", "\n")).alias("name"))
    scan = p.where(F.length(F.trim("raw_text")) < 80).select("page_id", ocr.header_name(F.split("raw_text", "\n")).alias("name"))
    return identity.first_found([label_extract(spark, d), of(layout_top_candidate(spark, d)), card, scan, of(ner_accepted(spark, d))], "page_id")


# ---- regions and the batch -------------------------------------------------------------------------

_WHOLE = (
    "(SELECT page_id, line_no::INT AS line_no, word, (lo + s)::BIGINT AS st, (lo + s + length(word))::BIGINT AS en, (s * 6.0)::DOUBLE AS x0, (line_no * 12.0)::DOUBLE AS y0, ((s + length(word)) * 6.0)::DOUBLE AS x1, (line_no * 12.0 + 12)::DOUBLE AS y1 FROM "
    "(SELECT page_id, line_no, lo, ws[wn + 1] AS word, coalesce(list_sum(list_transform(ws[1:wn], lambda x: length(x) + 1)), 0) AS s FROM (SELECT page_id, line_no, ws, lo, unnest(range(len(ws))) AS wn FROM (SELECT page_id, line_no, string_split(line, ' ') AS ws, "
    f"coalesce(sum(length(line) + 1) OVER (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM {_LINES}))) WHERE word <> '')"
)
_SOUGHT = (
    f"(SELECT DISTINCT page_id, 'PERSON' AS entity, 1 AS o, term AS q FROM {_PAGES} p JOIN {_terms_sql(_DOSS)} t ON p.dossier_id = t.k WHERE length(term) >= 3 UNION SELECT page_id, 'PHONE_NUMBER', 2, lower(h.f) FROM {_TELS} WHERE length(regexp_replace(h.f, '[^0-9]', '', 'g')) >= 8 "
    f"UNION SELECT page_id, 'EMAIL_ADDRESS', 3, lower(part) FROM (SELECT page_id, unnest(list_filter(string_split_regex(found, '\\s+'), lambda x: length(x) >= 3)) AS part FROM (SELECT page_id, unnest(mails) AS found FROM {_MAILS})))"
)
_OCC = (
    "(SELECT DISTINCT page_id, entity, o, pos AS st, pos + length(q) AS en FROM (SELECT page_id, entity, o, q, unnest(list_transform(range(1, len(ps)), lambda i: list_sum(list_transform(ps[1:i], lambda x: length(x)))::BIGINT + (i - 1) * length(q))) AS pos "
    f"FROM (SELECT s.page_id, entity, o, q, string_split(lower(raw_text), q) AS ps FROM {_SOUGHT} s JOIN {_PAGES} p ON p.page_id = s.page_id)))"
)
_REGIONS = (
    f"WITH w AS MATERIALIZED (SELECT * FROM {_WHOLE}), h AS MATERIALIZED (SELECT * FROM {_OCC}), b AS (SELECT h.page_id, entity, o, h.st, h.en, line_no, min(x0 + (greatest(h.st, w.st) - w.st) * 6.0) AS x0, min(y0) AS y0, max(x0 + (least(h.en, w.en) - w.st) * 6.0) AS x1, max(y1) AS y1 FROM h JOIN w ON w.page_id = h.page_id AND h.st < w.en AND w.st < h.en GROUP BY h.page_id, entity, o, h.st, h.en, line_no), "
    "n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY o, st, en, line_no) AS id FROM b), "
    "l AS (SELECT n.page_id, n.id, min(p.x0) AS lx FROM n JOIN w p ON n.o = 2 AND p.page_id = n.page_id AND (starts_with(p.word, '+') OR p.word = '212') AND p.x0 >= n.x0 - 45 AND p.x1 <= n.x0 AND p.y0 < n.y1 + 2 AND n.y0 - 2 < p.y1 GROUP BY 1, 2), "
    "every AS MATERIALIZED (SELECT n.page_id, n.id, n.entity, coalesce(lx, x0) - 2 AS x0, y0 - 2 AS y0, x1 + 2 AS x1, y1 + 2 AS y1 FROM n LEFT JOIN l ON l.page_id = n.page_id AND l.id = n.id), "
    "kept AS MATERIALIZED (SELECT * FROM every a WHERE NOT EXISTS (SELECT 1 FROM every b WHERE b.page_id = a.page_id AND b.id <> a.id AND b.x0 <= a.x0 AND b.y0 <= a.y0 AND b.x1 >= a.x1 AND b.y1 >= a.y1 AND (b.x0 <> a.x0 OR b.y0 <> a.y0 OR b.x1 <> a.x1 OR b.y1 <> a.y1 OR b.id < a.id))) "
)


@_query(f"{_REGIONS} SELECT page_id, id::INT AS id, entity, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM kept")
def page_regions(spark, d):
    """Boxes to cover on every page: occurrences of names, phones and e-mail pieces, placed, padded, those in others left out."""
    return _flat(regions.page_regions(_pages(spark, d), _dossier_terms(spark, d), ["page_id"], "raw_text").where("kept"), "page_id", "id", "entity")


@_query(
    f"{_REGIONS} SELECT a.page_id, n_person, n_phone, n_email, coalesce(k.n, 0) AS total_redactions FROM (SELECT page_id, count(*) FILTER (entity = 'PERSON') AS n_person, count(*) FILTER (entity = 'PHONE_NUMBER') AS n_phone, count(*) FILTER (entity = 'EMAIL_ADDRESS') AS n_email FROM every GROUP BY page_id) a "
    "LEFT JOIN (SELECT page_id, count(*) AS n FROM kept GROUP BY page_id) k ON k.page_id = a.page_id"
)
def page_counts(spark, d):
    """Entities of each page before boxes within others are left out, and the boxes that are covered."""
    n = lambda e, c: F.count_if(F.col("entity") == e).alias(c)
    every = regions.page_regions(_pages(spark, d), _dossier_terms(spark, d), ["page_id"], "raw_text")
    return every.groupBy("page_id").agg(n("PERSON", "n_person"), n("PHONE_NUMBER", "n_phone"), n("EMAIL_ADDRESS", "n_email"), F.count_if("kept").alias("total_redactions"))


_FILES = "(SELECT * FROM dossier_files QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rel_path NULLS FIRST, dossier_id NULLS FIRST) = 1)"
_ACTION = f"CASE WHEN {_EXT} = 'pdf' THEN 'redact_pdf' WHEN {_EXT} IN ('jpg','jpeg','png') THEN 'redact_image' ELSE 'copy' END"


@_query(
    f"{_REGIONS}, s AS MATERIALIZED ({_SQL['scanned_routing']}), f AS MATERIALIZED (SELECT *, {_ACTION} AS action FROM {_FILES}), pg AS (SELECT p.page_id, p.doc_id FROM {_PAGES} p JOIN f ON f.doc_id = p.doc_id JOIN s ON s.doc_id = p.doc_id WHERE action <> 'copy' AND NOT s.is_scanned), "
    "ev AS (SELECT doc_id, count(*) FILTER (entity = 'PERSON') AS a, count(*) FILTER (entity = 'PHONE_NUMBER') AS b, count(*) FILTER (entity = 'EMAIL_ADDRESS') AS c FROM every JOIN pg ON pg.page_id = every.page_id GROUP BY doc_id), kp AS (SELECT doc_id, count(*) AS n FROM kept JOIN pg ON pg.page_id = kept.page_id GROUP BY doc_id) "
    "SELECT f.dossier_id, f.doc_id, rel_path, action, CASE WHEN action <> 'copy' AND s.n_pages IS NULL THEN 'error' ELSE 'success' END AS status, CASE WHEN action <> 'copy' AND s.n_pages IS NULL THEN 'no page' END AS error, coalesce(n_pages, 0) AS pages_processed, coalesce(s.is_scanned, false) AS is_scanned, "
    "coalesce(a, 0) AS person, coalesce(b, 0) AS phone_number, coalesce(c, 0) AS email_address, coalesce(n, 0) AS total_redactions FROM f LEFT JOIN s ON s.doc_id = f.doc_id LEFT JOIN ev ON ev.doc_id = f.doc_id LEFT JOIN kp ON kp.doc_id = f.doc_id"
)
def batch_report(spark, d):
    """The whole batch: one record for each file with status, error, entities found and boxes covered."""
    out = pipeline.batch(_t(spark, d, "dossier_files"), _pages(spark, d), _dossier_terms(spark, d))
    e = lambda k: F.col("entities_found")[k].alias(k.lower())
    return out.select("dossier_id", "doc_id", "rel_path", "action", "status", "error", "pages_processed", "is_scanned", e("PERSON"), e("PHONE_NUMBER"), e("EMAIL_ADDRESS"), "total_redactions")


# ---- images, layout and files ----------------------------------------------------------------------


@_query(
    "SELECT page_id, trunc(least(x, x + 9.9))::DOUBLE AS x0, 5.0::DOUBLE AS y0, trunc(greatest(x, x + 9.9))::DOUBLE AS x1, 40.0::DOUBLE AS y1, trunc(x) - 4 AS mx0, 1.0::DOUBLE AS my0, trunc(x + 9.9) + 4 AS mx1, 44.0::DOUBLE AS my1 "
    f"FROM (SELECT page_id, width / 7 AS x FROM {_PAGES} WHERE width IS NOT NULL)"
)
def scan_boxes(spark, d):
    """Recognized quads as boxes of whole pixels, and what is painted over for them."""
    p = _pages(spark, d).where("width is not null")
    x = F.col("width") / 7
    quad = F.array(*[F.struct(a.alias("x"), F.lit(b).alias("y")) for a, b in ((x, 5.9), (x + 9.9, 8.2), (x + 9.9, 40.6), (x, 38.0))])
    r = G.pixel_box(quad)
    m = G.mask_box(r)
    return p.select("page_id", *[r[c].alias(c) for c in ("x0", "y0", "x1", "y1")], *[m[c].alias(f"m{c}") for c in ("x0", "y0", "x1", "y1")])


@_query(
    f"SELECT page_id, id, (x1 - x0) * 2 >= 25 AND (y1 - y0) * 2 >= 25 AND x1 - x0 BETWEEN 25 AND 160 AND (id % 2 = 1 OR y1 - y0 BETWEEN 25 AND 160) AND 0.5 + (id % 10) / 20.0 >= 0.6 AS face, x1 - x0 >= 40 AND y1 - y0 >= 40 AS photo FROM {_BOXES}"
)
def face_sizes(spark, d):
    """Which boxes can be faces (on the page, or in an image by their width alone) and which images portraits."""
    b = _boxes(spark, d)
    r = F.col("rect")
    px = lambda a, z: (r[z] - r[a]) * 2
    score = 0.5 + (F.col("id") % 10) / 20.0
    face = F.when(F.col("id") % 2 == 0, G.face_size_ok(r, px("x0", "x1"), px("y0", "y1"), True, score)).otherwise(G.face_size_ok(r, px("x0", "x1"), px("y0", "y1"), False, score))
    return b.select("page_id", "id", face.alias("face"), G.photo_size_ok(r).alias("photo"))


@_query(
    "SELECT doc_id, page_no, image_no::INT AS image_no, (image_no * 30)::DOUBLE AS x0, (image_no * 70)::DOUBLE AS y0, image_no * 55 > 80 AND 20 + image_no * 9 > 25 AS redacted, image_no * 55 > 100 AND 20 + image_no * 9 > 25 AND coalesce(image_no * 70 < height * 0.38, false) AS named "
    f"FROM (SELECT doc_id, page_no, height, unnest(range(1, n_images + 1)) AS image_no FROM {_PAGES} WHERE n_images > 0)"
)
def header_images(spark, d):
    """First placement of each embedded image, and whether it can be a header card (to be covered, to take a name from)."""
    side = lambda r, a, z: r[z] - r[a]
    n = F.col("n_images")
    p = _pages(spark, d).where("n_images > 0").select("doc_id", "page_no", "height", F.explode(F.sequence(F.lit(1), n)).alias("image_no"))
    i = F.col("image_no")
    at = lambda k: G.rect(i * 30 + k, i * 70 + k, i * 30 + k + i * 55, i * 70 + k + 20 + i * 9)
    placed = image_placements(p.withColumn("rects", F.array(at(0), at(500)))).join(p, ["doc_id", "page_no", "image_no"])
    r = F.col("rect")
    named = header_image(side(r, "x0", "x1"), side(r, "y0", "y1"), False) & F.coalesce(r["y0"] < F.col("height") * layout.TOP_OCR, F.lit(False))
    return placed.select("doc_id", "page_no", "image_no", r["x0"].alias("x0"), r["y0"].alias("y0"), header_image(side(r, "x0", "x1"), side(r, "y0", "y1"), True).alias("redacted"), named.alias("named")).distinct()


@_query(f"SELECT page_id AS doc_id, 1 AS page_no, (line_no // 2)::INT AS block_no, (line_no % 2)::INT AS line_no, 0 AS span_no, line AS text, (9 + length(line) % 7)::DOUBLE AS font, ((line_no // 2) * 60)::DOUBLE AS y0, 842.0::DOUBLE AS height FROM {_HEAD}")
def flattened_layout(spark, d):
    """Nested layout (blocks of lines of spans) to one row for each span."""
    h = _lines(_pages(spark, d), "header_text")
    span = F.struct(F.col("line").alias("text"), (9 + F.length("line") % 7).cast("double").alias("size"))
    lines = h.select("page_id", (F.col("line_no") / 2).cast("int").alias("b"), "line_no", F.struct(F.array(span).alias("spans")).alias("l"))
    blocks = lines.groupBy("page_id", "b").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "l"))), lambda x: x["l"]).alias("lines"))
    blocks = blocks.select("page_id", "b", F.struct(F.struct((F.col("b") * 60).cast("double").alias("y0")).alias("bbox"), "lines").alias("x"))
    pages = blocks.groupBy(F.col("page_id").alias("doc_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "x"))), lambda x: x["x"]).alias("blocks"))
    return flatten_layout(pages.select("doc_id", F.lit(1).alias("page_no"), F.lit(842.0).alias("height"), "blocks"))


@_query(f"SELECT page_id, string_agg(line, chr(10) ORDER BY line_no % 3, 100 - line_no) AS text FROM {_HEAD} WHERE (line_no % 3) * 150 < 842 * 0.38 AND trim(line, ' ') <> '' GROUP BY page_id")
def header_reading_order(spark, d):
    """Text of the blocks at the head of a page, from top to bottom and left to right."""
    h = _lines(_pages(spark, d), "header_text")
    return layout.header_blocks(h.select("page_id", (100 - F.col("line_no")).cast("double").alias("x0"), (F.col("line_no") % 3 * 150).cast("double").alias("y0"), F.col("line").alias("text"), F.lit(842.0).alias("height")), ["page_id"])


@_query("SELECT DISTINCT doc_id, CASE WHEN rel_path IS NOT NULL THEN '' END AS title, '' AS author FROM dossier_files")
def erased_metadata(spark, d):
    """Metadata of a written file: every value emptied."""
    f = _t(spark, d, "dossier_files").select("doc_id", F.create_map(F.lit("title"), "rel_path", F.lit("author"), F.coalesce("dossier_id", F.lit("?"))).alias("m")).withColumn("m", report.erased_metadata("m"))
    return f.select("doc_id", F.col("m")["title"].alias("title"), F.col("m")["author"].alias("author")).distinct()


_AR_FORMS = "[\\x{0600}-\\x{06FF}\\x{FB50}-\\x{FEFF}]"


@_query(
    f"WITH t AS (SELECT page_id, unnest(ws) AS word, unnest(range(len(ws))) AS word_no FROM (SELECT page_id, list_filter(string_split_regex({_nfkc('raw_text')}, '[\\s\\x0B]+'), lambda x: x <> '') AS ws FROM {_PAGES} WHERE regexp_matches(raw_text, '{_AR_FORMS}'))), "
    f"n AS (SELECT page_id, word_no, word, lag(word) OVER w AS b, lead(word) OVER w AS a FROM t WHERE regexp_matches(word, '{_AR_FORMS}') WINDOW w AS (PARTITION BY page_id ORDER BY word_no)) "
    f"SELECT page_id, word_no::INT AS word_no, concat_ws(' ', CASE WHEN NOT regexp_matches(b, '[:：]$') THEN b END, word, CASE WHEN NOT regexp_matches(a, '[:：]$') THEN a END) AS found, 0.9::DOUBLE AS score FROM n WHERE reverse(word) IN {_in(lx.ARABIC_FIRST_NAMES)} OR word IN {_in(lx.ARABIC_FIRST_NAMES)}"
)
def reversed_name_words(spark, d):
    """First names in logical or visual order, with the words beside them."""
    return arabic.reversed_words(_pages(spark, d), ["page_id"], "raw_text")


@_query(
    "WITH l AS (SELECT page_id, list_filter(string_split(header_text, chr(10))[1:5], lambda x: len(list_filter(string_split_regex(x, '\\s+'), lambda y: y <> '')) BETWEEN 2 AND 4 AND len(list_filter(string_split_regex(x, '\\s+'), lambda y: lower(y) IN " + _in(lx.STOPWORDS) + f")) = 0)[1] AS line FROM {_PAGES}) "
    "SELECT DISTINCT page_id, unnest(list_concat([line], list_filter(string_split_regex(line, '\\s+'), lambda y: length(y) >= 4))) AS term FROM l WHERE line IS NOT NULL"
)
def fallback_terms(spark, d):
    """Terms of a scanned document that nothing else names: its first line that can be a name, and that line's words."""
    return _pages(spark, d).select("page_id", F.explode(ocr.fallback_terms(F.split("header_text", "\n"))).alias("term"))


@_query(
    f"SELECT t.page_id, (h.s - 1)::INT AS start, h.f AS found FROM {_TELS} t WHERE length(regexp_replace(h.f, '[^0-9]', '', 'g')) >= 8 AND NOT EXISTS (SELECT 1 FROM (SELECT page_id, unnest(l) AS m FROM {_MAILS}) e WHERE e.page_id = t.page_id AND e.m.s <= t.h.s AND e.m.s + length(e.m.f) >= t.h.s + length(t.h.f))"
)
def phones_outside_mails(spark, d):
    """Phone hits that lie in no e-mail address."""
    p = _pages(spark, d)
    return arabic.uncovered(hits.phone_hits(p, ["page_id"], "raw_text"), hits.email_hits(p, ["page_id"], "raw_text"), ["page_id"]).select("page_id", "start", "found")


# ---- report ----------------------------------------------------------------------------------------

_ENT = lambda k: f"coalesce(sum(coalesce(entities_found['{k}'], 0)), 0)::BIGINT AS {k.lower()}"


@_query(
    "SELECT count(*) AS n_files, count(*) FILTER (status = 'success') AS n_success, count(*) FILTER (status <> 'success') AS n_errors, count(DISTINCT dossier_id) AS n_dossiers, coalesce(sum(total_redactions), 0)::BIGINT AS total_redactions, "
    + ", ".join(map(_ENT, report.ENTITIES)) + " FROM (SELECT * FROM file_summaries QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY processed_at DESC) = 1)"
)
def report_totals(spark, d):
    return report.totals(report.latest(_t(spark, d, "file_summaries"))).drop("elapsed_seconds")


@_query(
    "SELECT dossier_id, count(*) AS n_files, sum(pages_processed)::BIGINT AS n_pages, sum(total_redactions)::BIGINT AS n_redactions, count(*) FILTER (is_scanned) AS n_scanned FROM (SELECT DISTINCT doc_id, dossier_id, pages_processed, total_redactions, is_scanned FROM file_summaries) GROUP BY dossier_id"
)
def report_by_dossier(spark, d):
    f = _t(spark, d, "file_summaries").select("doc_id", "dossier_id", "pages_processed", "total_redactions", "is_scanned").distinct()
    return f.groupBy("dossier_id").agg(F.count("*").alias("n_files"), F.sum("pages_processed").alias("n_pages"), F.sum("total_redactions").alias("n_redactions"), F.count_if("is_scanned").alias("n_scanned"))


@_query(f"SELECT p.doc_id, f.kind, sum(len(mails))::BIGINT AS n_emails FROM {_MAILS} p LEFT JOIN (SELECT doc_id, min(kind) AS kind FROM dossier_files GROUP BY doc_id) f ON p.doc_id = f.doc_id WHERE p.raw_text IS NOT NULL GROUP BY 1, 2")
def hits_by_file_kind(spark, d):
    kinds = _t(spark, d, "dossier_files").groupBy("doc_id").agg(F.min("kind").alias("kind"))
    p = _pages(spark, d).where("raw_text is not null").groupBy("doc_id").agg(F.sum(F.size(hits.email_matches("raw_text"))).alias("n_emails"))
    return p.join(kinds, "doc_id", "left").select("doc_id", "kind", "n_emails")


@_query(
    f"SELECT f.dossier_id, f.doc_id, f.rel_path, {_ACTION} AS action, {_ACTION} = 'copy' AS unprotected, coalesce(n_pages, 0) AS pages_processed, coalesce(is_scanned, false) AS is_scanned, CASE WHEN coalesce(ne, 0) + coalesce(np, 0) > 0 THEN "
    "'{\"PERSON\":0,\"PHONE_NUMBER\":' || coalesce(np, 0) || ',\"EMAIL_ADDRESS\":' || coalesce(ne, 0) || ',\"PROFILE_PHOTO\":0}' END AS entities_found "
    f"FROM {_FILES} f LEFT JOIN ({_SQL['scanned_routing']}) s ON s.doc_id = f.doc_id LEFT JOIN (SELECT doc_id, sum(len(mails))::BIGINT AS ne FROM {_MAILS} GROUP BY doc_id) e ON e.doc_id = f.doc_id "
    f"LEFT JOIN (SELECT doc_id, count(*) AS np FROM ({_SQL['phone_hits']}) h JOIN {_PAGES} p USING (page_id) GROUP BY doc_id) t ON t.doc_id = f.doc_id"
)
def file_audit(spark, d):
    out = pipeline.audit(_t(spark, d, "dossier_files"), _pages(spark, d))
    return out.withColumn("entities_found", F.to_json("entities_found"))


_NAMED_FIRST = (
    "(SELECT DISTINCT dossier_id AS k, name FROM (" + " UNION ALL ".join(_attest_sql(p, "dossier_id") for p in _GIVEN_TO) + " UNION ALL " + _label_sql("dossier_id", f"(SELECT * FROM {_PAGES} WHERE page_no = 1)") + ") WHERE dossier_id IS NOT NULL)"
)


@_query(
    f"WITH q AS (SELECT k, string_agg('\\Q' || term || '\\E', '|' ORDER BY length(term) DESC, term) AS pattern FROM {_terms_sql(_NAMED_FIRST)} GROUP BY k) SELECT page_id, CASE WHEN pattern IS NULL THEN masked ELSE regexp_replace(masked, '(?i)' || pattern, '[PERSON]', 'g') END AS masked FROM {_UNTOLD} LEFT JOIN q ON q.k = dossier_id"
)
def dossier_masked_pages(spark, d):
    p = _pages(spark, d)
    names = pipeline.dossier_names(p).select("dossier_id", "name", "origin")
    return pipeline.mask_pages(p, identity.identities(names)).select("page_id", "masked")


@_query()
def report_json(spark, d):
    from ..sources.sinks import report_json as as_json

    records = report.latest(_t(spark, d, "file_summaries"))
    return as_json(report.totals(records), records)


@_query(
    "SELECT 0 AS part, NULL::VARCHAR AS doc_id, NULL::VARCHAR AS status, count(*)::VARCHAR AS n FROM (SELECT DISTINCT doc_id FROM file_summaries) UNION ALL "
    "SELECT 1, doc_id::VARCHAR, status, coalesce(total_redactions, 0)::VARCHAR FROM (SELECT * FROM file_summaries QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY processed_at DESC) = 1)"
)
def report_json_fields(spark, d):
    """The JSON report read back: the number of files from its head, and of each record the file, its status and redactions."""
    from ..sources.sinks import report_json as as_json

    records = report.latest(_t(spark, d, "file_summaries"))
    j = lambda f: F.get_json_object("value", f"$.{f}")
    return as_json(report.totals(records), records).select("part", j("doc_id").alias("doc_id"), j("status").alias("status"), F.when(F.col("part") == 0, j("n_files")).otherwise(F.coalesce(j("total_redactions"), F.lit("0"))).alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


__all__ = ["Column", "flagship", "oracle_sql", "queries"]
