"""Patterns for phone numbers and e-mail addresses, in one form for Java and one for engines without lookaround."""

from __future__ import annotations

from dataclasses import dataclass

SEP = r"[\s.-]?"
_PAIRS = rf"(?:{SEP}\d{{2}}){{4}}"
# Grammar of the live phone rule, three alternatives with no digit beside them.
PHONE_NATIONAL = rf"(?:(?:\+|00)(?:33|212){SEP}(?:\(0\){SEP})?|0)[1-7]{_PAIRS}"
PHONE_INTERNATIONAL = rf"(?:\+|00)[1-9]\d{{0,3}}{SEP}(?:\(?\d{{1,4}}\)?{SEP})?\d{{2,4}}{SEP}\d{{2,4}}"
PHONE_BARE = r"[567]\d{8}"
PHONE_CORE = f"{PHONE_NATIONAL}|{PHONE_INTERNATIONAL}|{PHONE_BARE}"
PHONE = "|".join(rf"(?<!\d){p}(?!\d)" for p in (PHONE_NATIONAL, PHONE_INTERNATIONAL, PHONE_BARE))
PHONE_DIGITS = 8
# The same without lookaround: the neighbours are consumed, the number is group 1 (for tests of existence).
PHONE_CONSUMING = rf"(?:^|[^0-9])({PHONE_CORE})(?:[^0-9]|$)"
# The e-mail rule; its ends are word boundaries, and letters of all scripts are words.
_WORD = r"[\p{L}\p{N}_]"
_BLANK = r"[\s\p{Z}\x{0085}]*"
EMAIL = (
    # what follows the local part is none of its letters, so nothing is given back
    rf"(?:(?<!{_WORD})(?=[A-Za-z0-9_])|(?<={_WORD})(?=[.%+-]))[A-Za-z0-9._%+-]++{_BLANK}+(?:@|\[at\]){_BLANK}+"
    rf"[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}(?!{_WORD})"
)
# The rule for scanned text, after separators are taken out; it is not anchored.
OCR_PHONE = r"(?:\+|00|0)?[5-7]\d{8}"


@dataclass(frozen=True)
class Rule:
    """A named rule of the catalogue: what it finds, for pages of which language, with which score."""

    name: str
    entity: str
    langs: tuple[str, ...]
    regex: str
    score: float


# Regional phone rules with their scores, and the Arabic-locale e-mail rule.
RULES = (
    Rule("phone_fr_trunk", "PHONE_NUMBER", ("fr",), r"(?<!\d)(?:0|\+33\s*(?:\(0\)\s*)?)[1-9](?:[\s.-]?\d{2}){4}(?!\d)", 0.85),
    Rule("phone_fr_spaced", "PHONE_NUMBER", ("fr",), r"(?<!\d)(?:0|\+33\s*)[1-9](?:\s+\d{2}){4}(?!\d)", 0.90),
    Rule("phone_ma_international", "PHONE_NUMBER", ("ar", "fr", "en"), r"(?<!\d)(?:\+212\s*(?:\(0\)\s*)?|00212\s*)[5-7](?:[\s.-]?\d{2}){4}(?!\d)", 0.90),
    Rule("phone_ma_trunk", "PHONE_NUMBER", ("ar", "fr", "en"), r"(?<!\d)0[5-7](?:[\s.-]?\d{2}){4}(?!\d)", 0.85),
    Rule("phone_dz_tn", "PHONE_NUMBER", ("ar", "fr", "en"), r"(?<!\d)(?:\+213|\+216|00213|00216)[\s.-]?[5-7]\d(?:[\s.-]?\d{2}){3}(?!\d)", 0.85),
    Rule(
        "phone_international", "PHONE_NUMBER", ("en", "fr", "ar"),
        r"(?<!\d)(?:\+|00)[1-9]\d{0,3}[\s.-]?(?:\(?\d{1,4}\)?[\s.-]?)?\d{1,4}[\s.-]?\d{2,4}[\s.-]?\d{2,9}(?!\d)", 0.80,
    ),
    Rule("email_ar", "EMAIL_ADDRESS", ("ar",), EMAIL, 1.0),
)
