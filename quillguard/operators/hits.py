"""Phone and e-mail hits in page text: existence, spans without a UDF, masking, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


def matches(text: Column | str, regex: str) -> Column:
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(regex), F.lit(0))


def phone_matches(text: Column | str) -> Column:
    """Matches of the live phone rule with at least eight digits."""
    return F.filter(matches(text, P.PHONE), lambda m: T.digit_count(m) >= P.PHONE_DIGITS)


def email_matches(text: Column | str) -> Column:
    return matches(text, P.EMAIL)


def span_array(text: Column | str, regex: str, entity: str, rule: str, score: float = 1.0) -> Column:
    """Matches with their places as an array of (start, end, found, entity, rule, score).

    Offsets come from the lengths of the pieces between the matches, so the regular expression stays in the
    JVM.  Texts without a match give an empty array, null ones null.
    """
    c = F.col(text) if isinstance(text, str) else text
    found = matches(c, regex)
    out = F.aggregate(
        F.arrays_zip(found.alias("f"), F.slice(F.split(c, regex, -1), 1, F.size(found)).alias("g")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,found:string>>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["g"]) + F.length(x["f"])).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + F.length(x["g"])).alias("start"), (a["at"] + F.length(x["g"]) + F.length(x["f"])).alias("end"), x["f"].alias("found")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.transform(out, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["found"].alias("found"), F.lit(entity).alias("entity"), F.lit(rule).alias("rule"), F.lit(score).alias("score")))


def spans(df: DataFrame, key: list[str], text: str, regex: str, entity: str, rule: str, score: float = 1.0) -> DataFrame:
    """Hits one per row: key, entity, rule, seq, start, end, found, score.  Null texts give no row."""
    out = df.where(F.col(text).rlike(regex)).select(*key, F.posexplode(span_array(text, regex, entity, rule, score)).alias("seq", "h"))
    return out.select(*key, "h.entity", "h.rule", "seq", "h.start", "h.end", "h.found", "h.score")


def resolve_array(hits_: Column) -> Column:
    """Hits of one text that no better hit overlaps: higher score, then longer, then earlier, then by rule."""
    better = lambda a, b: F.struct(b["score"], b["end"] - b["start"], -b["start"], b["rule"]) > F.struct(a["score"], a["end"] - a["start"], -a["start"], a["rule"])
    return F.filter(hits_, lambda a: ~F.exists(hits_, lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"]) & better(a, b)))


def phone_hits(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """Spans of the live phone rule; ``rule`` tells bare digit runs from written numbers."""
    out = spans(df, key, text, P.PHONE, "PHONE_NUMBER", "phone")
    bare = F.col("found").rlike("^[0-9]+$")
    return out.where(T.digit_count("found") >= P.PHONE_DIGITS).withColumn("rule", F.when(bare, "phone_bare").otherwise("phone_written"))


def email_hits(df: DataFrame, key: list[str], text: str) -> DataFrame:
    return spans(df, key, text, P.EMAIL, "EMAIL_ADDRESS", "email")


SHARE = 0.01  # of the rows, from which a dossier is spread over several tasks; so there are a hundred of them at most
SALTS = 64


def with_terms(rows: DataFrame, terms: DataFrame, dossier: str, spread: str, how: str = "inner", sized: DataFrame | None = None) -> DataFrame:
    """Rows with the terms of their dossier (one array, sorted): rows of a large dossier, and rows without one, are
    spread over SALTS keys, for each of which the dossier's terms are there.

    Which dossiers are large is asked of ``sized`` (the plain table, of which this reads one column), else of the rows.
    """
    asked = (rows if sized is None else sized).select(dossier)
    sizes = asked.groupBy(dossier).agg(F.count("*").alias("n"))
    total = asked.count()
    hot = [r[0] for r in sizes.where((F.col("n") > SHARE * total) & F.col(dossier).isNotNull()).select(dossier).limit(int(1 / SHARE)).collect()]
    per = terms.groupBy(dossier).agg(F.sort_array(F.collect_set("term")).alias("terms"))
    salt = lambda on, some: F.when(F.col(dossier).isin(hot) if hot else F.lit(False), some).otherwise(on)
    one = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    a = rows.withColumn("_salt", salt(F.when(F.col(dossier).isNull(), one).otherwise(F.lit(0)), one))
    b = per.withColumn("_salt", F.explode(salt(F.array(F.lit(0)), F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    return a.join(b, [dossier, "_salt"], how).drop("_salt")


def masked(text: Column | str, regex: str, placeholder: str) -> Column:
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, regex, placeholder)


def masked_fixed_width(text: Column | str, regex: str) -> Column:
    """Every match replaced by as many block characters, so offsets stay."""
    c = F.col(text) if isinstance(text, str) else text
    found, gaps = matches(c, regex), F.split(c, regex, -1)
    return F.when(~c.rlike(regex), c).otherwise(
        F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.repeat(F.lit("█"), F.length(F.get(found, i))), F.lit("")))), "")
    )


def resolve_overlaps(hits: DataFrame, key: list[str]) -> DataFrame:
    """Hits that no better hit of the same text overlaps: higher score, then longer, then earlier, then by rule."""
    rank = lambda a: F.struct(F.col(f"{a}.score"), F.col(f"{a}.end") - F.col(f"{a}.start"), -F.col(f"{a}.start"), F.col(f"{a}.rule"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    cond = cond & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")) & (rank("b") > rank("a"))
    return hits.alias("a").join(hits.alias("b"), cond, "left_anti")


_NONE = "array<struct<start:int,end:int,found:string,entity:string,rule:string,score:double>>"


def rule_arrays(text: str, lang: str, rules=P.RULES) -> list[Column]:
    """Hits of each rule of the catalogue as an array; empty where the text's language is none of the rule's."""
    return [F.when(F.col(lang).isin(*r.langs), span_array(text, r.regex, r.entity, r.name, r.score)).otherwise(F.array().cast(_NONE)) for r in rules]


def rule_hits(pages: DataFrame, key: list[str], text: str, lang: str, rules=P.RULES, resolve: bool = False) -> DataFrame:
    """Hits of the rule catalogue on pages of each rule's languages, in one pass over the pages."""
    found = pages.where(F.col(text).rlike("[0-9@]|\\[at\\]")).select(*key, F.flatten(F.array(*rule_arrays(text, lang, rules))).alias("hits"))
    return found.select(*key, F.explode(resolve_array(F.col("hits")) if resolve else "hits").alias("h")).select(*key, "h.*")
