"""Personal data in free text: where it stands, and format-preserving pseudonyms for it.

Detection runs on the sound canonical text (wrong decodings undone, disguises folded), so that one set
of patterns serves every spelling; each piece is then mapped back to the characters as stored.
"""

from __future__ import annotations

import re
import unicodedata
from datetime import date
from functools import lru_cache

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")

# Given names of the domain, folded (no accents, lower case).
GIVEN = frozenset(
    """
    alexandre amina anselme beatriz bernard brahim camille christophe clementine dominique dorothea driss eduardo
    elisabeth emeric fatima francois friedrich gabrielle gerhard guillermo henriette hicham hortense ignacio ikram
    isabelle joaquin johannes josephine karima katharina konstantin latifa leonardo ludovic margarethe maximilien
    mohamed natividad nawal nicolas octave olivier oumaima pascual patricia philippe rachid raphaelle rosalind
    salvador sebastien soukaina tariq theodora thibault valentina victoire vincent youssef hassan khadija sara nadia
    omar ali ahmed marie pierre jean anna maria karl hans peter john mary james carmen jose luis ana
    """.split()
)
GIVEN_AR = frozenset(
    """
    إبراهيم أحمد أسماء أمينة إلياس آمنة بلال جمال حنان خديجة رشيد زكرياء زينب سلمى سميرة صلاح طارق عبد فاطمة كريم
    ليلى مصطفى نور هشام وفاء ياسين يوسف محمد علي حسن حسين عمر سعيد مريم عائشة نادية سعاد
    """.split()
)

_SP = r"[ \t ]"
_WS = r"[ \t]*\n?[ \t]*"  # blanks and at most one line end
TITLE = r"(?:M\.|MM\.|Mme\.?|Mlle\.?|Monsieur|Madame|Mademoiselle|Mr\.?|Mrs\.?|Ms\.?|Miss|Dr\.?|Prof\.?|Herrn?|Frau|D\.|Dña\.?|Don|Doña|Sra?\.|السيدة|السيد|الأستاذة|الأستاذ|الدكتورة|الدكتور)"
_TITLES = re.compile(rf"(?:{TITLE}\s+)+")
_L = r"A-Za-zÀ-ÖØ-öø-ÿŒœ"
_CAP = rf"[A-ZÀ-ÖØ-Þ\ufffd][{_L}\ufffd'’]*(?:-[{_L}\ufffd'’]+)*\.?"
_AR = r"[ء-ْـ]+"
_TOKEN = rf"(?:{_CAP}|{_AR})"
_NAME = rf"{_TOKEN}(?:(?:,?{_SP}+|,?{_SP}*\n{_SP}*){_TOKEN}){{0,4}}?"

# What stands before and after a name in running text (a word that must occur, before, after).
_CONTEXTS = [
    ("guidance", r"under the guidance of", r"during the year"),
    ("sous", r"sous la responsabilité de", r"au cours de"),
    ("Leitung", r"unter der Leitung von", r"im Laufe"),
    ("bajo", r"bajo la dirección de", r"durante el año"),
    ("إشراف", r"تحت إشراف", r"خلال سنة"),
    ("attestons", r"attestons que", r"a suivi"),
    ("certifie", r"certifie que", r"a occupé"),
    ("ce", r"diplôme est décerné à", r"pour"),
    ("hereby", r"hereby declares that", r"has completed"),
    ("awarded", r"is awarded to", r"for"),
    ("constar", r"hace constar que", r"ha trabajado"),
    ("otorga", r"otorga(?: este diploma)? a", r"por"),
    ("concede", r"concede(?: este diploma)? a", r"por"),
    ("dass", r"hiermit,\s+dass", r"bis zum Jahr"),
    ("verliehen", r"wird", r"verliehen"),
    ("المعني", r"المعني بالأمر", r"قد"),
    ("هذه الشهادة", r"تمنح هذه الشهادة (?:إلى|ل)", r"(?:على|تقديرا)"),
]


def _lossy(phrase: str) -> str:
    """A pattern for a phrase whose accented letters may be lost and whose blanks may be line ends."""
    return re.sub(r"[À-ÿ]", lambda m: f"[{m[0]}\ufffd]", phrase).replace(" ", r"\s+")


_RUNNING = [
    (trigger, re.compile(rf"{_lossy(before)}\s+((?:{TITLE}\s+)*)({_NAME})(?=\s+{_lossy(after)}(?!\w))"))
    for trigger, before, after in _CONTEXTS
]
# Labels and signature lines that a name follows.
_LABELS = (
    r"Nom et prénom|Nom complet|Nom|NOM|Full name|Name|NAME|Nombre y apellidos|Nombre|NOMBRE|Vor- und Nachname|الاسم الكامل|الاسم العائلي والشخصي|الاسم"
    r"|Signé|Signed|Firmado|Gezeichnet|Unterschrift|Signature|التوقيع|المديرة|المدير|Le directeur|La directrice|Pour la direction|The head of training"
    r"|La directora|El director|Die Leiterin|Der Leiter|For the board|Por la dirección|Für die Leitung|عن الإدارة"
)
_LABELLED = re.compile(rf"(?m)^[ \t]*(?:{re.sub('[À-ÿ]', lambda m: f'[{m[0]}\ufffd]', _LABELS)})[ \t]*(?:[:,]|[-–—]|：)[ \t]*\n?[ \t]*((?:{TITLE}\s+)*)({_TOKEN}(?:,?{_SP}+{_TOKEN}){{0,4}})[ \t]*$")
_LINE_NAME = re.compile(rf"^((?:{TITLE}\s+)*)({_TOKEN}(?:,?{_SP}+{_TOKEN}){{0,3}})[ \t]*$")
_WORDS = re.compile(rf"[{_L}\ufffd]+|{_AR}")
# Words that make a line of capitalised words a heading, a job or an organisation.
_NO_NAME = frozenset(
    """
    profil profile perfil resume curriculum vitae lebenslauf competences experience formation skills education perfil estudios experiencia
    erfahrung ausbildung technicienne technicien developpeur responsable warehouse maintenance application societe institut universite
    etablissements groupe laboratoire fundacion academy company university institute conseil energie ingenierie logistique sante
    السيرة الذاتية الخبرات التكوين المهارات مسؤول تقنية لوجستي
    """.split()
)


@lru_cache(100_000)
def fold(word: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.casefold()) if not unicodedata.combining(c))


@lru_cache(100_000)
def is_given(word: str) -> bool:
    """Whether a word is a given name, Arabic compounds and alef variants included."""
    if "\ufffd" in word:
        w = re.compile(re.escape(fold(word)).replace("\ufffd", "."))
        return any(w.fullmatch(g) for g in GIVEN)
    if word[0] >= "؀":
        w = word.replace("ـ", "")
        return w in GIVEN_AR or w.startswith("عبد") and len(w) > 5
    return fold(word) in GIVEN


def _name_start(m: re.Match) -> int:
    """Where a name begins after its title; M. or D. before a single word is an initial, not a title."""
    if m[1] and (i := re.search(r"[A-Z]\.\s+$", m[1])) and len(_units(m[2])) == 1:
        return m.start(1) + i.start()
    return m.start(2)


def _units(name: str) -> list[str]:
    """Words of a name; compounds with Abd- and -al-Din count as one."""
    out: list[str] = []
    for w in re.findall(rf"[{_L}\ufffd]+\.?|{_AR}", name):
        if out and (out[-1] == "عبد" or w == "الدين"):
            out[-1] += w if out[-1] == "عبد" else ""
        else:
            out.append(w)
    return out


# E-mail addresses: a spelt-out or spaced @ and a line end beside it are allowed.
_EMAIL = re.compile(
    r"[A-Za-z0-9][A-Za-z0-9._%+-]*(?:(?:(?<=[._%+-])|(?=[._%+-]))\n[A-Za-z0-9._%+-]+)?" + _WS + r"(?:@|\[ ?at ?\]|\( ?at ?\))" + _WS
    + r"[A-Za-z0-9-]+(?:(?:\.|\.\n|\n\.)[A-Za-z0-9-]+)*\.?\n?(?<=[.\n])[A-Za-z]{2,}|[A-Za-z0-9][A-Za-z0-9._%+-]*" + _WS + r"(?:@|\[ ?at ?\]|\( ?at ?\))" + _WS + r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
)
_AT = re.compile(r"@|\[ ?at ?\]|\( ?at ?\)")
_MAIL_LEFT = re.compile(rf"[A-Za-z0-9._%+-]+{_WS}$")
_MAIL_RIGHT = re.compile(rf"{_WS}[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}}")

_S = r"[ \-.]?"  # one separator between groups of digits
_PHONE = re.compile(
    rf"(?=[+(0-7])(?<![\w+.,/-])(?:"
    rf"(?:\+|00)(?:33|212|213|216|971|44|34|49|1){_S}(?:\(0\){_S})?(?:\(\d{{3}}\) ?\d{{3}}-\d{{4}}|\d(?:{_S}\d){{7,9}})"
    rf"|(?:\+|00)\d(?:{_S}\d){{8,13}}"
    rf"|\(\d{{3}}\) ?\d{{3}}[- ]\d{{4}}"
    rf"|0\d{{4}} \d{{3}} \d{{3}}"
    rf"|0\d\d[ -]\d{{4}}[ -]\d{{4}}"
    rf"|0[1-9](?:{_S}\d\d){{4}}"
    rf"|[5-7]\d{{8}}"
    rf")(?![\d/]|[-.]\d|\w)"
)
_NUMBER = re.compile(r"\d(?:[ \-.()]{0,3}\d){7}")  # what every phone number has
# Words before a number that make it something else than a phone number.
_NOT_PHONE = re.compile(r"(?i)(?:order no\.?|no\.|n°|nr\.?|lot|sku|ref\.?|build|diploma|iso|article|art\.|commande|siret|isbn|eur|surface|gpa)[ :]*$")

# Labels of a person's identity papers in five languages.
_ID_LABELS = (
    r"CIN|CNIE|C\.I\.N\.?|Carte nationale(?: d'identité)?|Pièce d'identité|N° de sécurité sociale|Numéro de sécurité sociale|Passeport|Titre de séjour"
    r"|ID card|National ID|Identity document|Identity card|Social security (?:number|no\.?)|SSN|Passport(?: No\.?| number)?|passport(?: no\.?| number)?|DNI|NIE|Documento de identidad|Pasaporte"
    r"|Número de la seguridad social|Seguridad social|N\.º de la Seguridad Social|Personalausweis(?:nummer)?|Ausweisnummer|Ausweis|Reisepass(?:nummer)?|Sozialversicherungsnummer"
    r"|رقم البطاقة الوطنية|رقم جواز السفر|بطاقة التعريف(?: الوطنية)?|جواز السفر|رقم الضمان الاجتماعي|رقم بطاقة التعريف"
)
_ID_VALUE = (
    r"(?:[A-Z]{1,3}[ \n]?\d{5,8}[A-Z]?|\d{3}-\n?\d{2}-\n?\d{4}|[12][ \n]?\d\d[ \n]?\d\d[ \n]?\d[\dAB][ \n]?\d{3}[ \n]?\d{3}(?:[ \n]?\d\d)?|\d{15}|\d{13}|\d{8}[ -]?[A-Z]|\d{7,12}[A-Z]?)"
)
_ID = re.compile(rf"(?:{_ID_LABELS})[ \t]*(?:is|est|es|ist|lautet|n°|Nº|N°|No\.?|Nr\.?|number|número|Nummer|رقم)?[ \t]*[:#-]?[ \t]*\n?[ \t]*({_ID_VALUE})(?![\w])")
_ID_HINT = re.compile(rf"{_ID_LABELS}")

# The shapes of a home address.
# First words of place names of several words.
_PLACE = rf"(?:(?:Puerto|San|Santa|Villa|Bad|Sankt|Saint|Sainte|La|Le|Les|El|Los|Las|Nueva|Neu|Alt)[ \n])?[A-ZÀ-ÖØ-Þ][{_L}\ufffd'’]+(?:-[{_L}'’]+)*(?: (?:de|del|la|las|los|sur|am|an|der) [A-ZÀ-ÖØ-Þ][{_L}'’]+)*"
_NL = r"[ \n]"
_FR_WAY = r"(?:rue|lot\.|avenue|av\.|boulevard|bd|bd\.|impasse|chemin|allée|place|quai|cours|route|square|passage|résidence|lotissement|ruelle|sentier)"
_EN_WAY = r"(?:Street|Road|Lane|Avenue|Close|Drive|Court|Way|Place|Square|Terrace|Crescent|Gardens|Hill|Row|Walk|St\.?|Rd\.?|Ave\.?)"
_ES_WAY = r"(?:Calle|Avenida|Avda\.|Plaza|Paseo|C/|Camino|Travesía|Ronda|Carrera|Pasaje|Via|Viale|Piazza|Corso)"
_DE_WAY = r"[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer|damm|steig|pfad|hof)"
_AR_WAY = r"(?:زنقة|شارع|حي|درب|ساحة|إقامة|طريق|نهج|زقاق|ممر)"
_W = rf"[{_L}'’-]+"
_FR = rf"\d{{1,4}}(?:{_NL}(?:bis|ter|quater))?,?{_NL}{_FR_WAY}(?:{_NL}{_W}){{1,6}}?(?:,{_NL}(?:villa|(?:appt|[éÉ\ufffd]tage|b[âa]t\.?|apt|porte|esc\.?){_NL}?[\dA-Z]+)){{0,3}},?{_NL}\d\d{_NL}?\d{{3}}{_NL}{_PLACE}"
_EN = (
    rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite){_NL}\d+[A-Z]?,{_NL})?\d{{1,4}}[A-Z]?,?{_NL}(?:[A-Z][\w'-]+{_NL}){{1,3}}{_EN_WAY}(?:{_NL}[NSEW]{{1,2}}(?!\w))?(?:,{_NL}(?:Unit|Flat|Apt\.?|Suite|Floor){_NL}\d+[A-Z]?)?"
    rf",{_NL}(?:(?:North|South|East|West|New|Old|Great|Little|Upper|Lower|Saint|St\.?|Port|Mount|Fort|Lake){_NL})?[A-Z][a-z]+(?:(?:,{_NL}[A-Z]{{2}})? \d{{5}}(?!\d))?"
)
_ES = rf"{_ES_WAY}(?:{_NL}{_W}){{1,6}}?,?{_NL}\d{{1,4}}(?:,{_NL}(?:piso|planta|puerta|bajo|esc\.){_NL}?[\dº]*(?:{_NL}[A-Z](?![\w]))?)?,{_NL}(?:\d\d{_NL}?\d{{3}}{_NL})?{_PLACE}"
_DE = rf"(?:{_DE_WAY}|(?:Am|An der|An den|Im|In der|In den|Zum|Zur|Auf dem|Auf der|Unter den|Hinter dem|Vor dem)(?:{_NL}[A-ZÄÖÜ][\wäöüß-]+){{1,3}}){_NL}\d{{1,4}}[a-z]?(?:,{_NL}(?:Wohnung|Whg\.|Stock|Etage|Hinterhaus|\d+\.{_NL}(?:Stock|OG|Etage)){_NL}?[\dA-Z]*)?,{_NL}\d{{5}}{_NL}{_PLACE}"
_ARW = r"[ء-ْ]+"
_ARP = rf"(?:مدينة{_NL}{_ARW} {_ARW}|{_ARW}{_NL}{_ARW})"
_ARA = (
    rf"(?:رقم{_NL}\d{{1,4}}،{_NL}{_AR_WAY}(?:{_NL}{_ARW}){{1,3}}|\d{{1,4}}،?{_NL}{_AR_WAY}(?:{_NL}{_ARW}){{1,3}}|{_AR_WAY}(?:{_NL}{_ARW}){{1,3}}?{_NL}رقم{_NL}\d{{1,4}})"
    rf"(?:،{_NL}(?:الطابق|الشقة|شقة|طابق|عمارة){_NL}\d+)*،{_NL}{_ARP}(?: \d{{5}}(?!\d))?"
)
# Words of which an address of each shape has at least one.
_ADDRESSES = [
    (re.compile(rf"(?<![\w]){_FR}"), frozenset({"rue", "lot.", "avenue", "av.", "boulevard", "bd", "impasse", "chemin", "allée", "place", "quai", "cours", "route", "square", "passage", "résidence", "lotissement", "ruelle", "sentier"})),
    (re.compile(rf"(?<![\w]){_EN}"), frozenset({"Street", "Road", "Lane", "Avenue", "Close", "Drive", "Court", "Way", "Place", "Square", "Terrace", "Crescent", "Gardens", "Hill", "Row", "Walk", "St", "St.", "Rd", "Rd.", "Ave", "Ave."})),
    (re.compile(rf"(?<![\w]){_ES}"), frozenset({"Calle", "Avenida", "Avda.", "Plaza", "Paseo", "C/", "Camino", "Travesía", "Ronda", "Carrera", "Pasaje", "Via", "Viale", "Piazza", "Corso"})),
    (re.compile(rf"(?<![\w]){_DE}"), re.compile(r"\d[a-z]?,[ \n][\dWSEH]")),
    (re.compile(rf"(?<![\w]){_ARA}"), frozenset({"زنقة", "شارع", "حي", "درب", "ساحة", "إقامة", "طريق", "نهج", "زقاق", "ممر"})),
]
# Account numbers, which are no phones: two letters and two digits before groups of four; four groups of four digits.
_ACCOUNT = re.compile(r"(?<!\w)(?:[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?!\w)")

# Names by the features of their words: a run of capitalized words of which none is an ordinary one.
_PARTICLE = r"(?:de|del|de la|da|di|von|van|van der|zu|bin|ben|al|el)"
_RUN = re.compile(rf"{_CAP}(?:[ \t]+(?:{_PARTICLE}[ \t]+)?{_CAP}){{1,4}}(?![\w@])")
# Words after which a name often stands.
_CUE = re.compile(
    r"(?i)(?:\b(?:of|by|to|with|from|for|met|that|and|contact|person|avec|par|que|de|à|a|pour|et|chez|con|por|para|y|mit|von|an|durch|für|und|dass|herr|frau|director|manager|colleague|collègue|kollege|kollegin)|[:,]|[ء-ي])[ \t]+$"
)
# Words of organisations and papers, of which a name has none.
_ORG = frozenset("societe ste company institut institute instituto universite university universidad etablissements ets groupe group grupo laboratoire laboratory laboratorio fundacion foundation fondation academy academie academia gmbh sarl ltd inc llc ag ref no nr id national street road avenue rue calle".split())
_INSIDE = re.compile(r"[\w@.&'’-]")  # before a capital that begins no word
_INNER = re.compile(r"(?<=\s)(?=[A-ZÀ-ÖØ-Þ])")
# Points for what speaks for a name; LIKELY are enough.
GIVEN_POINTS, CUE_POINTS, TITLE_POINTS, LINE_POINTS, UNKNOWN_POINTS, LIKELY = 2, 2, 2, 2, 1, 4
TOP_LINES = 8  # lines at the head of a page of which one may be a name alone


def name_points(run: str, before: str, title: str, alone: bool, vocabulary: frozenset[str]) -> int:
    """Points of a run of capitalized words: given names, words that no text has as an ordinary word, what stands
    before, and whether it is a line at the head of the page."""
    if "\ufffd" in run:
        return 0
    words = [fold(w) for w in re.findall(rf"[{_L}\ufffd]{{2,}}", run) if w[0].isupper()]
    if len(words) < 2 or any(w in _ORG or w in _NO_NAME for w in words):
        return 0
    named = [is_given(w) for w in words]
    if run.isupper() and not any(named) and not alone and not title:  # a heading
        return 0
    if any(w in vocabulary and not n for w, n in zip(words, named)):
        return 0
    first = GIVEN_POINTS + UNKNOWN_POINTS if any(named) else 0
    return first + UNKNOWN_POINTS * sum(not n for n in named) + (CUE_POINTS if _CUE.search(before) else 0) + (TITLE_POINTS if title else 0) + (LINE_POINTS if alone else 0)


_DIGIT = re.compile(r"\d")
_ARABIC_DIGITS = str.maketrans("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
_ARABIC_DIGIT = re.compile("[٠-٩۰-۹]")


def find(text: str, vocabulary: frozenset[str] | None = None) -> list[tuple[int, int, str]]:
    """Pieces of personal data of a sound canonical text as (start, end, kind), sorted, without overlaps.

    ``vocabulary``: ordinary words (folded), by which names outside all known contexts are told; without it such
    names are not looked for.
    """
    if not text or text.isspace():
        return []
    plain = text.translate(_ARABIC_DIGITS) if not text.isascii() and _ARABIC_DIGIT.search(text) else text
    found: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []

    def add(a: int, b: int, kind: str) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b and not any(a < y and x < b for x, y in taken):
            found.append((a, b, kind))
            taken.append((a, b))

    if "@" in plain or "at]" in plain or "at)" in plain:
        for m in _AT.finditer(plain):
            left, right = _MAIL_LEFT.search(plain, max(0, m.start() - 80), m.start()), _MAIL_RIGHT.match(plain, m.end())
            if left and right:
                a = left.start()
                while plain[a] in "._%+-":
                    a += 1
                add(a, right.end(), "EMAIL")
    if _ID_HINT.search(plain):
        for m in _ID.finditer(plain):
            add(*m.span(1), "ID_NUMBER")
    words = set(plain.replace(",", " ").split())
    for pattern, hints in _ADDRESSES:
        if hints.search(plain) if isinstance(hints, re.Pattern) else not hints.isdisjoint(words):
            for m in pattern.finditer(plain):
                add(*m.span(), "ADDRESS")
    if _ACCOUNT.search(plain):
        taken += [m.span() for m in _ACCOUNT.finditer(plain)]
    for m in _PHONE.finditer(plain) if _NUMBER.search(plain) else ():
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15 and not _NOT_PHONE.search(plain, max(0, m.start() - 24), m.start()):
            add(*m.span(), "PHONE")
    for trigger, pattern in _RUNNING:
        if trigger in words:
            for m in pattern.finditer(plain):
                add(_name_start(m), m.end(2), "NAME")
    for m in _LABELLED.finditer(plain):
        add(_name_start(m), m.end(2), "NAME")
    at = 0
    lines = plain.split("\n")
    before: tuple[int, list[str]] | None = None  # a line that may be the first half of a name
    for line in lines:
        n, half = len(line), None
        if 1 < n < 60 and line[0] not in "-•*" and line.count(" ") < 6 and (m := _LINE_NAME.match(line)):
            a = _name_start(m)
            units = _units(line[a : m.end(2)])
            if not any(fold(w) in _NO_NAME for w in units):
                if before and len(joined := _units(f"{before[1][0]} {m[2]}")) == 2 and any(map(is_given, joined)):
                    add(before[0], at + m.end(2), "NAME")
                elif len(units) > 1 and (any(map(is_given, units)) or any(len(w.strip(".")) == 1 for w in units)):
                    add(at + a, at + m.end(2), "NAME")
                elif len(units) == 1:
                    half = (at + a, units)
        before = half
        at += n + 1
    if vocabulary:
        head = sum(len(x) + 1 for x in lines[:TOP_LINES])
        for m in _RUN.finditer(plain):
            a, b = m.span()
            alone = b <= head and (a == 0 or plain[a - 1] == "\n") and (b == len(plain) or plain[b] == "\n")
            title = _TITLES.match(m[0])
            start = a + title.end() if title else a
            if not (a and _INSIDE.match(plain[a - 1])) and name_points(plain[start:b], plain[max(0, a - 24) : a], title[0] if title else "", alone, vocabulary) >= LIKELY:
                add(start, b, "NAME")
                continue
            for x in list(_INNER.finditer(m[0]))[:-1]:  # the run may begin with ordinary words
                k = a + x.start()
                if name_points(plain[k:b], plain[max(0, k - 24) : k], "", False, vocabulary) >= LIKELY:
                    add(k, b, "NAME")
                    break
    return sorted(found)


# Dates: day, month and year in numbers, or the other way round, with one sign between them.
_DATE = re.compile(r"(?<![\w./-])(?:(\d{1,2})([./-])(\d{1,2})\2(\d{4})|(\d{4})([./-])(\d{1,2})\6(\d{1,2}))(?![\w/-]|\.\d)")


def dates(text: str) -> list[tuple[int, int, date, str]]:
    """Valid dates as (start, end, date, form); the form is what a date of the same notation is written with."""
    out = []
    for m in _DATE.finditer(text):
        try:
            if m[1]:
                d, form = date(int(m[4]), int(m[3]), int(m[1])), f"{{2:0{len(m[1])}d}}{m[2]}{{1:0{len(m[3])}d}}{m[2]}{{0:04d}}"
            else:
                d, form = date(int(m[5]), int(m[7]), int(m[8])), f"{{0:04d}}{m[6]}{{1:0{len(m[7])}d}}{m[6]}{{2:0{len(m[8])}d}}"
        except ValueError:
            continue
        out.append((m.start(), m.end(), d, form))
    return out


def stored(text: str, piece: tuple[int, int, str], start: list[int] | None, end: list[int] | None) -> tuple[int, int]:
    """Where a piece of the sound text stands in the stored text, without white space around it."""
    a, b, _ = piece
    if start is not None:
        a, b = start[a], end[b - 1]
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return a, b
