"""Names as people type them: parsing into a pivot (given name or kind of organisation) and a core
(family name, or the organisation's own words), and a true edit metric on cores."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

from .glyphs import canonical
from .pii import fold

# Short and variant forms of given names, folded.
_VARIANTS = {
    "alexandre": "alex", "amina": "aminah minouche", "anselme": "anselm", "beatriz": "beatrice bea", "bernard": "bernd",
    "brahim": "brahime", "camille": "cam", "christophe": "kristof chris", "clementine": "clem", "dominique": "domi",
    "dorothea": "doro dora", "driss": "drisse", "eduardo": "edu eddie", "elisabeth": "elsbeth liz", "emeric": "emerick",
    "fatima": "fatma fati", "francois": "franz fanch", "friedrich": "fritz", "gabrielle": "gaby", "gerhard": "gerd",
    "guillermo": "guille", "henriette": "hetty", "hicham": "hisham", "hortense": "tensie", "ignacio": "nacho",
    "ikram": "ikrame", "isabelle": "ysabel isa", "joaquin": "quino", "johannes": "hannes", "josephine": "josie",
    "karima": "karimah", "katharina": "kathi", "konstantin": "kostja", "latifa": "latefa", "leonardo": "leo",
    "ludovic": "ludo", "margarethe": "grete maggie", "maximilien": "max", "mohamed": "simo mohammed med", "natividad": "nati",
    "nawal": "naoual", "nicolas": "nico", "octave": "octavio", "olivier": "oliv", "oumaima": "omayma", "pascual": "pascal",
    "patricia": "patty", "philippe": "phil", "rachid": "rashid", "raphaelle": "raffa", "rosalind": "rosa", "salvador": "chava",
    "sebastien": "seb bastian", "soukaina": "sokaina", "tariq": "tarek", "theodora": "teddy thea teodora", "thibault": "tib thibaut",
    "valentina": "tina vale", "victoire": "vicky", "vincent": "vince",
}
PIVOTS = {v: g for g, vs in _VARIANTS.items() for v in (g, *vs.split())}
# Arabic given names in normalized spelling.
PIVOTS_AR = {
    w: w
    for w in "ابراهيم احمد اسما امينه الياس امنه بلال جمال حنان خديجه رشيد زكريا زينب سلمي سميره صلاحالدين طارق عبدالرحمن عبدالعزيز فاطمه كريم ليلي مصطفي نورالدين هشام وفا ياسين يوسف محمد علي حسن عمر سعيد مريم".split()
}
# Kinds of organisation and their abbreviations; branches and legal forms, which do not identify.
ORG = {
    v: k
    for k, vs in {
        "societe": "societe ste soc company", "institut": "institut inst institute instituto", "universite": "universite univ university universidad",
        "etablissements": "etablissements ets etabl etablissement", "groupe": "groupe grp gpe group grupo", "laboratoire": "laboratoire lab labo laboratory laboratorio",
        "fundacion": "fundacion fund foundation fondation", "academy": "academy acad academie academia",
    }.items()
    for v in vs.split()
}
BRANCH = {
    v: k
    for k, vs in {
        "sante": "sante", "ingenierie": "ingenierie ing ingen", "energie": "energie energ", "conseil": "conseil conseils cons",
        "formation": "formation formations form", "logistique": "logistique logist logistics log",
    }.items()
    for v in vs.split()
}
LEGAL = frozenset("sa sarl gmbh ltd inc llc sas ag".split())
TITLES = frozenset("m mm mr mme mlle mrs ms dr prof herr frau d don dona sr sra السيد السيده الاستاذ الاستاذه الدكتور الدكتوره".split())
_TOKEN = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*\.?")
_LEGAL_DOTS = re.compile(r"\bs\.?\s*a\.?\s*r\.?\s*l\b\.?", re.I)
_OCR = str.maketrans("01548", "olsab")
_AR_FOLD = str.maketrans({"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ة": "ه", "ى": "ي", "ؤ": "و", "ئ": "ي", "ـ": None})
_AR_MARKS = re.compile(r"[ً-ْٰ]")


def _arabic(w: str) -> str:
    w = _AR_MARKS.sub("", w.translate(_AR_FOLD))
    return w[:-1] if len(w) > 3 and w[-1] == "ء" else w


def damerau(a: str, b: str, most: int) -> int:
    """Unrestricted Damerau-Levenshtein distance, a metric; anything above ``most`` may come back as most + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    last: dict[str, int] = {}
    n, m = len(a), len(b)
    inf = n + m
    d = [[inf] * (m + 2) for _ in range(n + 2)]
    for i in range(n + 1):
        d[i + 1][1] = i
    for j in range(m + 1):
        d[1][j + 1] = j
    for i in range(1, n + 1):
        db = 0
        row = d[i + 1]
        above = d[i]
        best = inf
        for j in range(1, m + 1):
            k, same = last.get(b[j - 1], 0), db
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, db = 0, j
            x = min(above[j] + cost, row[j] + 1, above[j + 1] + 1, d[k][same] + (i - k - 1) + 1 + (j - same - 1))
            row[j + 1] = x
            if x < best:
                best = x
        last[a[i - 1]] = i
        if best > most + 1:
            return most + 1
    return d[n + 1][m + 1]


@lru_cache(None)
def _org_index() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for w in (*ORG, *BRANCH):
        if len(w) > 5:
            for k in deletions(w, 1):
                out.setdefault(k, []).append(w)
    return out


@lru_cache(50_000)
def _like_kind(word: str) -> bool:
    """Whether a word is within one edit of a kind of organisation or a branch."""
    index = _org_index()
    return any(damerau(word, w, 1) <= 1 for w in {w for k in deletions(word, 1) for w in index.get(k, ())})


class Pivots:
    """Given names in all their forms, found by what is left of them when up to two letters are taken out."""

    def __init__(self, forms: dict[str, str]):
        self.forms = forms
        self.index: dict[str, list[str]] = {}
        for p in forms:
            for k in deletions(p, 2):
                self.index.setdefault(k, []).append(p)
        self.near = lru_cache(50_000)(self._near)

    def _near(self, word: str) -> tuple[tuple[int, str], ...]:
        """Pivots of a given-name token: the nearest within its radius, and by the triangle inequality all that
        a spelling of the same name within one edit of it could be nearest to.  Sorted by distance."""
        if word in self.forms:
            return ((0, self.forms[word]),)
        radius = pivot_radius(word)
        if not radius:
            return ()
        close = {p for k in deletions(word, radius) for p in self.index.get(k, ())}
        return nearest([(d, self.forms[p]) for p in close if (d := form_distance(word, p)) is not None])


def pivot_radius(word: str) -> int:
    """Edits allowed between a given-name token and a form of a given name."""
    return 0 if len(word) < 4 else 1 if len(word) < 6 else 2


def form_distance(word: str, form: str) -> int | None:
    """Distance of a token from a form of a given name within its radius, else None."""
    d = damerau(word, form, pivot_radius(word))
    return d if d <= pivot_radius(word) and 2 * d < len(form) else None


def nearest(hits: list[tuple[int, str]]) -> tuple[tuple[int, str], ...]:
    """Of pivots at their distances: the one that is met exactly, else the nearest and those one edit farther."""
    near = sorted(hits)
    out: dict[str, int] = {}
    for d, c in near[:1] if near and near[0][0] == 0 else near:
        if d <= near[0][0] + 1:
            out.setdefault(c, d)
    return tuple((d, c) for c, d in out.items())


@lru_cache(None)
def known() -> Pivots:
    return Pivots(PIVOTS | PIVOTS_AR)


def parse(name: str | None) -> list[tuple[str, str, str]]:
    """A name as points (kind, cell, core); kind is P (person), A (person in Arabic script) or O (organisation).

    Persons: the cell is the canonical given name, ``I:x`` where only its initial is known, ``F`` where only
    one word is, ``U`` where no word is near a pivot; the core of ``U`` is all words, sorted, so that their
    order does not matter.  Null, empty and letterless names give no point.
    """
    if not name:
        return []
    text = canonical(name)
    if not any(map(str.isalpha, text)):
        return []
    words = [w.strip(".").replace("-", "").replace("'", "").replace("’", "") for w in _TOKEN.findall(_LEGAL_DOTS.sub(" ", text))]
    words = [w for w in words if w]
    if any(w[0] > "؀" for w in words):
        return _person([_arabic(w) for w in words if w[0] > "؀"], "A")
    hyphenated = [x for w in _TOKEN.findall(_LEGAL_DOTS.sub(" ", text)) for x in re.split(r"[-.]", w) if x]
    folded = [fold(w) for w in hyphenated]
    kinds = [ORG[w] for w in folded if w in ORG]
    if kinds:
        rest = [w.translate(_OCR) for w in folded if w not in ORG and w not in LEGAL and w not in BRANCH and len(w) > 1]
        rest = [w for w in rest if not _like_kind(w)]
        if rest:
            if len(rest) > 2:  # a word torn apart: the shortest piece joins its shorter neighbour
                while len(rest) > 2:
                    k = min(range(len(rest)), key=lambda i: len(rest[i]))
                    n = k - 1 if k and (k + 1 == len(rest) or len(rest[k - 1]) <= len(rest[k + 1])) else k + 1
                    a, b = sorted((k, n))
                    rest[a : b + 1] = [rest[a] + rest[b]]
            return [("O", kinds[0], " ".join(sorted(rest)))]
    return _person([fold(w).translate(_OCR) if any(map(str.isalpha, w)) else w for w in words], "P")


def _person(words: list[str], kind: str) -> list[tuple[str, str, str]]:
    if kind == "A":
        joined: list[str] = []
        for w in words:
            if joined and (joined[-1] == "عبد" or w == "الدين"):
                joined[-1] += w
            else:
                joined.append(w)
        words = joined
    if len(words) > 1 and words[0] in TITLES and (len(words[0]) > 1 or len(words) > 2):
        words = words[1:]  # M. or D. before a single word is an initial
    initials = [w for w in words if len(w) == 1]
    long = [w for w in words if len(w) > 1 and w not in TITLES]
    if not long:
        return []
    near = known().near
    best: tuple[float, int] | None = None
    for k, w in enumerate(long):
        p = known().near(w)
        if p and (best is None or p[0][0] / len(w) < best[0]):
            best = (p[0][0] / len(w), k)
    family = lambda ws: _core("".join(ws), kind)
    if best is None:  # a torn given name
        for k in range(len(long) - 1):
            if len(long) > 2 and (p := known().near(long[k] + long[k + 1])) and p[0][0] <= 1:
                rest = long[:k] + long[k + 2 :]
                return [(kind, c, family(rest)) for _, c in p]
        if initials and len(words) <= 3 and (len(words[0]) == 1 or len(long) == 1):
            return [(kind, f"I:{initials[0]}", family(long))]
        if initials and len(long) == 2 and len(words) == 3:  # a torn family name, or two names and a middle initial
            return [(kind, f"I:{initials[0]}", " ".join(long))]
        if len(long) > 1:
            return [(kind, "U", " ".join(sorted(_core(w, kind) for w in long)))]
        return [(kind, "F", family(long))]
    rest = long[: best[1]] + long[best[1] + 1 :]
    if not rest:
        return [(kind, "G", family(long))] if len(long) == 1 and not initials else [(kind, f"I:{initials[0]}", family(long))]
    return [(kind, c, family(rest)) for _, c in known().near(long[best[1]])]


def _core(family: str, kind: str) -> str:
    if kind == "A":
        return family[2:] if family.startswith("ال") and len(family) > 4 else family
    return family


def radius(core: str) -> int:
    """Edits allowed between two spellings of a core."""
    return 1 if len(core) < 6 else 2


MOST_WORDS = 6  # words of a name without a pivot up to which it is compared word by word; longer ones must be equal


def deletions(word: str, k: int) -> set[str]:
    """The word and all words with up to k letters taken out: two words within k edits share one."""
    out = layer = {word}
    for _ in range(k):
        layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
        out = out | layer
    return out


def word_radius(word: str) -> int:
    """Edits allowed in one of several words."""
    return 0 if len(word) < 4 else 1 if len(word) < 7 else 2


def _paired(x: list[str], y: list[str], most: int) -> int:
    """Least sum of edits over the pairings of the words of two names; more than ``most`` where none is within."""
    if not x:
        return 0
    best = most + 1
    for k, v in enumerate(y):
        c = _word(x[0], v)
        if c < best:
            best = min(best, c + _paired(x[1:], y[:k] + y[k + 1 :], best - c - 1))
    return best


def _word(u: str, v: str) -> int:
    d = damerau(u, v, 2)
    return d if d <= min(word_radius(u), word_radius(v)) else 9


def _shortened(x: list[str], y: list[str]) -> int:
    """Cost of two words of which one is abbreviated to three letters or more, which counts as an edit."""
    best = 9
    for i in range(2):
        for j in range(2):
            u, v = x[i], y[j]
            if min(len(u), len(v)) >= 3 and (u.startswith(v) or v.startswith(u)) and (rest := _word(x[1 - i], y[1 - j])) <= 1:
                best = min(best, 1 + rest)
    return best


def within(kind: str, a: str, b: str) -> int | None:
    """Distance of two cores of one cell if they are within its radius, else None.

    One word: Damerau-Levenshtein within the smaller radius of both.  Several words (organisations, names
    without a pivot): the sum over the best pairing of the words, at most three and two.
    """
    if a == b:
        return 0
    if " " not in a and " " not in b:
        most = min(radius(a), radius(b))
        d = damerau(a, b, most)
        return d if d <= most else None
    x, y = a.split(" "), b.split(" ")
    if len(x) != len(y) or len(x) > MOST_WORDS:
        return None
    most = 3 if kind == "O" else 2
    d = _paired(x, y, most)
    if kind != "O" and len(x) == 2:
        d = min(d, _shortened(x, y))
    return d if d <= most else None


def keys(kind: str, core: str) -> set[str]:
    """Strings of which two cores within the radius of each other share at least one.

    One word: the core with up to its radius of letters taken out.  Several: pairs of words with letters taken
    out, so that a word which many names have is no key of its own.
    """
    words = core.split(" ")
    if len(words) == 1:
        return deletions(core, radius(core))
    if len(words) > MOST_WORDS:
        return {core}
    d = [[deletions(w, k) for k in range(3)] for w in words]
    out: set[str] = set()
    for i in range(len(words)):
        for j in range(len(words)):
            if i == j:
                continue
            if kind == "O":  # one edit and two, either way
                pairs = ((d[i][1], d[j][2]),)
            elif len(words) > 2:  # two edits leave one of three words as it is, another with one at most
                pairs = ((d[i][0], d[j][1]),)
            else:
                pairs = ((d[i][1], d[j][1]), (d[i][0], d[j][2]), ({words[i][:3] + "-"}, d[j][1]))
            for p, q in pairs:
                for a in p:
                    for b in q:
                        out.add(f"{a} {b}" if a < b else f"{b} {a}")
    return out


def key_count(kind: str, core: str) -> int:
    """About how many keys a core has."""
    n = [(1, 1 + len(w), 1 + len(w) + len(w) * (len(w) - 1) // 2) for w in core.split(" ")]
    if len(n) == 1:
        return n[0][radius(core)]
    if len(n) > MOST_WORDS:
        return 1
    if kind == "O":
        return sum(a[1] * b[2] for a in n for b in n if a is not b)
    return sum(a[1] * b[1] + b[2] + b[1] if len(n) == 2 else b[1] for a in n for b in n if a is not b)


def stable(key: str) -> int:
    """Hash that is the same in every process."""
    return zlib.crc32(key.encode())


LEARN_FAMILIES = 3  # rare words beside which two words must stand in turn to be forms of one given name
LEARN_GIVEN = 5  # rare words beside which a word must stand to be a given name
RARE = 8  # words that stand beside a rare word at most


def recast(kind: str, cell: str, core: str, pivots: Pivots) -> list[tuple[str, str, str]]:
    """Points of a name without a pivot once given names have been learned; as it was where none is near."""
    words = core.split(" ")
    near = [(p[0][0] / len(w), k, p) for k, w in enumerate(words) if (p := pivots.near(w))]
    if not near:
        return [(kind, cell, core)]
    _, k, p = min(near)
    return [(kind, c, "".join(words[:k] + words[k + 1 :])) for _, c in p]
