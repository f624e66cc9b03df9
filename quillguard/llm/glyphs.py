"""Canonical form of text that prints like ordinary text but differs in its characters.

Normalization quick-check properties split a text into stable characters, which are copied, and
unstable segments (an unstable character with the starter before it and the marks after it), which
alone are normalized and spliced back.  A second pass folds look-alike letters of other scripts, but
only inside words that also hold Latin letters, so real Greek, Cyrillic or Arabic words stay.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Cyrillic and Greek letters drawn like a Latin letter, with that letter.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j",
    "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "υ": "u",
    "γ": "y", "κ": "k", "Ԍ": "G", "ӏ": "l", "օ": "o", "ո": "n", "ս": "u", "ց": "g",
}
# Code points that print nothing.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
# Compatibility classes that a reader cannot tell from the plain form.
ALIKE_TAGS = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
ALIKE_COMPAT = [(0x2000, 0x200A), (0x205F, 0x205F), (0x3000, 0x3000), (0xFB00, 0xFB06), (0x2160, 0x217F), (0x01C4, 0x01CC), (0x0132, 0x0133)]


def _unstable() -> list[int]:
    """Code points whose compatibility form prints the same."""
    found = []
    for cp in [*range(0xA0, 0xD800), *range(0xF900, 0xFFF0), *range(0x1D400, 0x1D800)]:
        tag = unicodedata.decomposition(chr(cp)).partition(" ")[0]
        if tag in ALIKE_TAGS or tag == "<compat>" and any(a <= cp <= b for a, b in ALIKE_COMPAT):
            found.append(cp)
    return found


def char_class(cps: list[int]) -> str:
    """Ranges for a character class, in a syntax that Java and Python share for the BMP."""
    out, cps = [], sorted(cps)
    i = 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        out.append((cps[i], cps[j]))
        i = j + 1
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in out)


def _quick_check() -> tuple[list[int], list[int]]:
    """Code points with the quick-check property No, and those that may go on a segment (Maybe, or a mark).

    Maybe have the second letters of canonical compositions and the vowels and finals of Hangul; marks can
    change places.  A form that prints the same and begins with one of these goes on a segment too.
    """
    no, goes_on = [], set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for cp in [*range(0xA0, 0xAC00), *range(0xF900, 0x10000), *range(0x10000, 0x1F000), *range(0x2F800, 0x2FA20)]:
        c = chr(cp)
        if unicodedata.combining(c):
            goes_on.add(cp)
        d = unicodedata.decomposition(c)
        if not d or d[0] == "<":
            continue
        if not unicodedata.is_normalized("NFC", c):
            no.append(cp)
        parts = d.split()
        if len(parts) == 2:
            goes_on.add(int(parts[1], 16))
    goes_on |= {cp for cp in _UNSTABLE if ord(unicodedata.normalize("NFKC", chr(cp))[0]) in goes_on}
    return no, sorted(x for x in goes_on if x > 0x7F)


_UNSTABLE = _unstable()
_NO, _GOES_ON = _quick_check()
# Classes of single ranges beyond 16 bits, which the pattern engine would try one by one: all of those go on a segment.
_CLASS = char_class(sorted(x for x in {*_UNSTABLE, *_NO} if x < 0x10000))
_ON = char_class([x for x in _GOES_ON if x < 0x10000]) + "\U00010000-\U0010ffff"
_MARKS = "̀-͎͐-ͯٓ-ٕ"
_INV = re.escape(INVISIBLE)
# Characters that stand in for others; a text without any, and without marks out of order, needs no work.
SUSPECT_CLASS = f"{_CLASS}{_MARKS}{INVISIBLE}{''.join(LOOKALIKES)}"
SUSPECT = re.compile(f"[{SUSPECT_CLASS}]")
_LOOK_AT = re.compile(f"[{SUSPECT_CLASS}{_ON}]")
_SEGMENT = re.compile(f"[{_INV}]+|[{_CLASS}][{_ON}]*|[^{_ON}{_INV}]?[{_ON}]+")
_INVISIBLE_RUN = set(INVISIBLE)
_LOOK = re.compile(f"\\w*[{''.join(LOOKALIKES)}]\\w*")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
# A lone look-alike (alone or with a digit) has no Latin letter in its own word; it is folded unless a
# word beside it is really of its script.
_OTHER = re.compile(r"[Ͱ-ϿЀ-ӿ]")
_TABLE = str.maketrans(LOOKALIKES)


def canonical(text: str) -> str:
    """The canonical form alone; see ``canonical_map`` when offsets are needed."""
    while _LOOK_AT.search(text):
        new = fold_lookalikes(_SEGMENT.sub(_whole, text))
        if new == text:
            break
        text = new
    return text


def _whole(m: re.Match) -> str:
    return _formed(m[0])


def _formed(seg: str) -> str:
    return _form(seg) if len(seg) <= 64 else _form.__wrapped__(seg)  # long segments are not remembered


@lru_cache(20_000)
def _form(seg: str) -> str:
    """Canonical form of a segment."""
    if seg[0] in _INVISIBLE_RUN:
        return ""
    new = unicodedata.normalize("NFC", "".join(unicodedata.normalize("NFKC", c) if c in _SET else c for c in seg))
    return " " if new.isspace() and new != seg else new


def canonical_map(text: str) -> tuple[str, list[int] | None, list[int] | None]:
    """Canonical text, and for each of its characters where its source begins and ends (None: unchanged).

    The result is in Unicode normal form C.  What one pass brings together (a mark behind a removed invisible
    character, or on a folded letter) the next one joins.
    """
    got = _pass(text)
    if got[1] is None:
        return got
    while (more := _pass(got[0]))[1] is not None:
        new, s, e = more
        got = new, [got[1][i] for i in s], [got[2][i - 1] for i in e]
    return got if got[0] != text else (text, None, None)


def _pass(text: str) -> tuple[str, list[int] | None, list[int] | None]:
    if not _LOOK_AT.search(text):
        return text, None, None
    out: list[str] = []
    start: list[int] = []
    end: list[int] = []
    at = 0
    for m in _SEGMENT.finditer(text):
        a, b = m.span()
        seg = m[0]
        if (new := _formed(seg)) == seg:
            continue
        out.append(text[at:a])
        start.extend(range(at, a))
        end.extend(range(at + 1, a + 1))
        out.append(new)
        if len(new) == b - a:
            start.extend(range(a, b))
            end.extend(range(a + 1, b + 1))
        else:
            start.extend([a] * len(new))
            end.extend([b] * len(new))
        at = b
    out.append(text[at:])
    start.extend(range(at, len(text)))
    end.extend(range(at + 1, len(text) + 1))
    joined = "".join(out)
    folded = fold_lookalikes(joined)
    if folded == text:
        return text, None, None
    return folded, start, end


_SET = {chr(c) for c in _UNSTABLE}


def fold_lookalikes(text: str) -> str:
    """Same length; letters that imitate Latin ones are replaced inside words with Latin letters."""

    def one(m: re.Match) -> str:
        w = m[0]
        if _LATIN.search(w) or len(w) < 3 and len(_OTHER.findall(w)) == 1 and not _near(text, *m.span()):
            return w.translate(_TABLE)
        return w

    return _LOOK.sub(one, text)


def _near(text: str, a: int, b: int) -> bool:
    """Whether a neighbouring word on the line is wholly in Greek or Cyrillic letters."""
    before, after = text[max(0, text.rfind("\n", 0, a)) : a].split(), text[b:].partition("\n")[0].split()
    return any(x and _OTHER.match(x[0]) and not _LATIN.search(x) and sum(map(str.isalpha, x)) > 1 for x in (*before[-1:], *after[:1])) and not text[a:b].strip("АВ").isdigit()


def stands_in(text: str, new: str) -> bool:
    """Whether the canonical form has other characters; marks in another order are no disguise."""
    return text != new and sorted(text) != sorted(new)


def is_disguised(text: str) -> bool:
    """Whether any character of the text stands in for its ordinary spelling."""
    return bool(_LOOK_AT.search(text)) and stands_in(text, canonical(text))
