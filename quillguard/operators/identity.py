"""Whose dossier it is: names from labels, attestations and layout, expanded to search terms per dossier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as T
from . import hits

_TITLE = r"(?:M\.|Mme|Mlle|Monsieur|Madame)?"
_UPPER = r"[A-Z\x{00C0}-\x{0178}]"
_NAME = rf"({_UPPER}[a-zA-Z\x{{00C0}}-\x{{0178}}\s\-]+?)"
# Phrases that hand a paper to its recipient, in French, English and Arabic.
ATTESTATIONS = (
    rf"(?iu)(?:atteste|certifie)\s+que\s+{_TITLE}\s*{_NAME}(?:\s*,|\s+a\s+|\s+est\s+|\s+n[eé]\s+|\s+titulaire|\s+matricule|\n|\r)",
    rf"(?iu)(?:d[eé]cern[eé]e?|accord[eé]e?|attribu[eé]e?|d[eé]livr[eé]e?|remis)\s+[aà]\s+{_TITLE}\s*{_NAME}(?:\s*,|\s+pour\s+|\s+a\s+|\s+le\s+|\n|\r)",
    rf"(?iu)(?:au\s+profit\s+de)\s+{_TITLE}\s*{_NAME}(?:\s*,|\s+pour\s+|\n|\r)",
    r"(?iu)(?:certify\s+that|awarded\s+to|presented\s+to|conferred\s+upon)\s+(?:Mr\.|Ms\.|Mrs\.)?\s*([A-Z][a-zA-Z\s\-]+?)(?:\s*,|\s+for\s+|\s+has\s+|\n|\r)",
    r"(?iu)(?:نشهد\s+أن|يشهد\s+أن)\s+(?:السيد|السيدة|الآنسة|الطالب|التلميذ)?\s*([^\n\r,]+?)(?:\s*,|\s+قد|\s+أنه|\n|\r)",
)
# Fixed value: labels that a name follows on the line, with the next line up to a colon.
LABEL = r"(?iu)(?:^|[^A-Za-z0-9_\x{00C0}-\x{024F}])(?:Nom(?:\s+et\s+pr[eé]nom)?|Name|الاسم(?:\s+الكامل)?|المرشح|صاحب\s+السيرة)\s*[:\-]\s*([^\n\r]+(?:\n[^\n\r:]+)?)"


def label_candidate(text: Column | str, stopwords: list[str] = lx.STOPWORDS) -> Column:
    """Name after a label (first match), or null."""
    c = T.collapse(F.regexp_extract(text, LABEL, 1))  # of text made ready by ``T.label_ready``
    c = T.keep_name_chars(T.first_piece(c, T.LABEL_SEPARATORS))
    w = T.tokens(c, "[\\s\\-_]+")
    ok = F.size(w).between(1, 4) & ~c.rlike("[0-9]") & ~T.overlaps(w, lx.MONTHS) & ~T.overlaps(w, stopwords)
    return F.when(ok, F.array_join(w, " "))


def attestation_candidates(text: Column | str, stopwords: list[str] = lx.STOPWORDS) -> Column:
    """Recipients named by the phrases (first match of each), with each capitalized word of four letters."""

    def one(p: str) -> Column:
        c = T.first_piece(T.collapse(F.regexp_extract(text, p, 1)), T.ATTESTATION_SEPARATORS)
        w = T.tokens(c)
        ok = F.size(w).between(2, 4) & ~T.overlaps(w, stopwords) & ~T.overlaps(w, lx.INSTITUTIONS)
        # a capital at the head, or capitals alone; Arabic words and digits have none
        parts = F.filter(w, lambda x: (F.length(x) >= 4) & (x.rlike("^\\p{Lu}") | (x.rlike("\\p{Lu}") & ~x.rlike("\\p{Ll}"))))
        return F.when(ok, F.concat(F.array(F.array_join(w, " ")), parts)).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(*map(one, ATTESTATIONS))))


def search_terms(name: Column | str, given: list[str] = lx.GIVEN_NAMES, stopwords: list[str] = lx.STOPWORDS) -> Column:
    """Strings to search for a name, folded in case (matching folds it too): the name, its inversion, family
    words of five letters that are neither given names nor stopwords, Arabic normal forms."""
    c = T.strip_place(T.strip_honorific(T.collapse(name)))
    w = T.tokens(c, "[\\s\\-]+")
    family = F.filter(w, lambda x: (F.length(x) >= 5) & ~F.lower(x).isin(given) & ~F.lower(x).isin(stopwords))
    plain = T.fold_arabic(c)
    folded_given = [g.translate(str.maketrans("إأآٱ", "اااا")) for g in (*given, *lx.ARABIC_FIRST_NAMES)]
    arabic = F.when(
        T.has_arabic(c, False),
        F.concat(F.array(plain), F.array(T.abd_variant(plain)), F.filter(T.tokens(plain), lambda x: (F.length(x) >= 4) & ~x.isin(folded_given) & ~x.isin(stopwords))),
    ).otherwise(F.array().cast("array<string>"))
    all_ = F.array_distinct(F.filter(F.transform(F.concat(F.array(c), F.array(T.inverted(c)), family, arabic), F.lower), lambda x: x.isNotNull()))
    return F.when(F.length(c) >= 3, all_).otherwise(F.array().cast("array<string>"))


def cv_pick(files: DataFrame, path: str = "rel_path", dossier: str = "dossier_id") -> DataFrame:
    """One CV file for each dossier: a name with cv or resume, else a PDF; then the first path."""
    name = F.lower(T.base_name(path))
    priority = F.when(name.rlike("cv|resume"), 1).when(name.endswith(".pdf"), 2)
    best = files.where(F.col(dossier).isNotNull() & priority.isNotNull()).groupBy(dossier).agg(F.min(F.struct(priority.alias("priority"), F.col(path).alias(path))).alias("b"))
    return best.select(dossier, f"b.{path}", "b.priority")


def identities(names: DataFrame, dossier: str = "dossier_id", name: str = "name", origin: str = "origin", **lists) -> DataFrame:
    """Search terms of each dossier: dossier_id, term, origin, has_arabic; union over its names."""
    return (
        names.where(F.col(dossier).isNotNull() & F.col(name).isNotNull())
        .select(dossier, F.col(origin).alias("origin"), F.explode(search_terms(name, **lists)).alias("term"))
        .groupBy(dossier, "term").agg(F.min("origin").alias("origin"))
        .withColumn("has_arabic", T.has_arabic("term", False))
    )


def term_hits(pages: DataFrame, terms: DataFrame, key: list[str], text: str, dossier: str = "dossier_id") -> DataFrame:
    """Pages that hold a term of their own dossier: equality on the dossier, then containment; folded in case.

    A dossier's terms are one array, so a page is joined once, not with each term; large dossiers are spread.
    """
    low = F.lower(F.col(text))
    joined = hits.with_terms(pages.where(F.trim(text) != ""), terms, dossier, key[0], sized=pages)
    counted = F.transform("terms", lambda t: F.struct(t.alias("term"), ((F.length(low) - F.length(F.replace(low, t, F.lit("")))) / F.length(t)).cast("int").alias("n")))
    return joined.select(*key, dossier, F.explode(F.filter(counted, lambda x: x["n"] > 0)).alias("h")).select(*key, dossier, F.col("h.term").alias("term"), F.col("h.n").alias("n_hits"))


def arabic_word_hits(words: DataFrame, terms: DataFrame, key: list[str], word: str = "word", dossier: str = "dossier_id", lexicon: list[str] = lx.ARABIC_FIRST_NAMES, sized: DataFrame | None = None) -> DataFrame:
    """Words of a page that equal, or as five letters or more stand inside, a normalized Arabic term."""
    plain = T.normalize_arabic(word)
    targets = terms.where("has_arabic").select(dossier, T.fold_arabic("term").alias("term"))
    folded = [w.translate(str.maketrans("إأآٱ", "اااا")) for w in lexicon]
    w = words.withColumn("plain", plain).where((F.length("plain") >= 4) & ~F.col("plain").isin(folded))
    near = lambda t: (F.col("plain") == t) | ((F.length("plain") >= 5) & t.contains(F.col("plain")))
    return hits.with_terms(w, targets, dossier, word, sized=sized).where(F.exists("terms", near)).select(*key, dossier, word)


def first_found(steps: list[DataFrame], key: str, name: str = "name") -> DataFrame:
    """Cascade: for each key the name of the first step that has one."""
    out = None
    for k, s in enumerate(steps):
        part = s.where(F.col(name).isNotNull()).select(key, F.lit(k).alias("step"), name)
        out = part if out is None else out.unionByName(part)
    best = out.groupBy(key).agg(F.min(F.struct("step", name)).alias("b"))
    return best.select(key, "b.step", f"b.{name}")


def propagate(files: DataFrame, terms: DataFrame, own: DataFrame | None = None, dossier: str = "dossier_id", doc: str = "doc_id") -> DataFrame:
    """Dossier terms for every file of the dossier; a file whose dossier has none falls back to its own."""
    per = terms.groupBy(dossier).agg(F.sort_array(F.collect_set("term")).alias("terms"))
    out = files.join(per, dossier, "left")
    if own is not None:
        out = out.join(own.groupBy(doc).agg(F.sort_array(F.collect_set("term")).alias("own")), doc, "left").withColumn("terms", F.coalesce("terms", "own")).drop("own")
    return out


def target_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    """The page of each document that names are taken from: its first written one."""
    from .ocr import first_written_page

    first = first_written_page(pages.select(doc, page, "raw_text", "n_images"), doc, page).select(F.col(doc).alias("_doc"), F.col("first_page").alias("_page"))
    return pages.join(first, F.col(doc).eqNullSafe(F.col("_doc")) & F.col(page).eqNullSafe(F.col("_page")), "left_semi")
