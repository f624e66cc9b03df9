"""Restoring text that was decoded with the wrong character encoding.

Every candidate chain of wrong decodings is undone on the runs of non-ASCII characters of a line, and
each candidate is compressed with zstandard dictionaries trained per language on clean text.  The
chain with the least description length (compressed bytes plus the cost of naming the chain) wins;
without a chain that is cheaper than leaving the line alone, the line stays as it is.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache

import zstandard

from .glyphs import SUSPECT, canonical, canonical_map, stands_in

# Code pages by which UTF-8 is misread, and pairs (bytes were really, bytes were read as).
_MULTI = ("cp1252", "latin-1", "cp437", "mac_roman", "cp1256", "cp1251", "cp850", "cp1250")
_SINGLE = (
    ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("cp1256", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1256"),
    ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1256", "mac_roman"), ("cp1256", "cp1251"), ("cp1251", "cp1252"),
)
STEP_COST = 1.0  # bytes charged for each step of a chain
ODD_COST = 2.0  # bytes charged for each unlikely place that is left
MARGIN = 1.0  # bytes by which a chain has to beat leaving the line alone
LANGS = ("en", "fr", "es", "de", "ar")


@lru_cache(None)
def byte_of(codec: str) -> dict[str, int]:
    """Character to byte of a one-byte code page; bytes it leaves undefined stand for themselves."""
    table = {}
    for b in range(256):
        try:
            ch = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            ch = chr(b)
        table.setdefault(ch, b)
    for b in range(0x80, 0xA0):  # C1 controls pass through lenient decoders
        table.setdefault(chr(b), b)
    return table


@lru_cache(None)
def char_of(codec: str) -> list[str]:
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


_RUN = re.compile(r"[^\x00-\x7f]+")
# A chain is a tuple (real, read) or (real, read, "odd words"), the latter for sound text beside garbled.
CHAINS: list[tuple[str, ...]] = [("utf-8", c) for c in _MULTI] + list(_SINGLE) + [(*c, "odd words") for c in _SINGLE]
LOST = "\ufffd"
# Characters that sound text of the five languages (and of names beside it) is made of.
_ORDINARY = "\t-~\u060c\u061b\u061f\u0621-\u0652\u0660-\u066c\u0670àâäçéèêëîïôöùûüœæñáíóúßãõÀÂÃÄÇÉÊËÎÏÔÕÖÜÑÁÍÓÚŒ°²³º‘’“”„–—•«»…€"
# Capitals inside words or words of accented letters alone are made of sound letters, yet unlikely;
# so are a turned question mark before a space and single Greek or Cyrillic letters in Latin text.
_ODD = (
    f"[^{_ORDINARY}\u0370-\u03ff\u0400-\u04ff]|[a-zß-ÿ][À-ÖØ-Þ]|[À-ÿ]{{3}}|(?<![A-Za-zÀ-ÿ])[À-ÿ]{{2}}(?![A-Za-z])"
    "|(?<![À-ÿ])[ÀÂÄÇÊÎÔÖÜÑÁÍÓÚ](?![A-Za-zÀ-ÿ\\s])|Ã(?![A-Z])|(?<![A-Z])[ËÏÕ]|[A-Za-zÀ-ÿ][\u0370-\u04ff\u0621-\u0652]|[\u0370-\u04ff\u0621-\u0652][A-Za-zÀ-ÿ]|[\u0370-\u04ff][\u0621-\u064a]|[\u0621-\u064a][\u0370-\u04ff]|[0-9][\u0400-\u04ff]"
    "|[a-z][îï](?![A-Za-zÀ-ÿ])|(?<![A-Za-zÀ-ÿ])[ïîëñíÔ](?![A-Za-zÀ-ÿ'’])|(?<=[0-9] m)I(?![A-Za-z0-9])|(?<![\u0370-\u04ff])[\u0370-\u04ff](?![\u0370-\u04ff])|[„…°²³º«»€œŒ–—‘’“”][a-zà-ÿ]?(?<=[a-z][„…°²³«»€–—“”][a-z])"
)
ODD = re.compile(_ODD)
# What nearly all sound text is made of.  Text of these characters alone, and without Arabic glued to
# Latin letters, can hold no unlikely place and nothing disguised; both patterns also run in the JVM.
SAFE_CLASS = "\t-~\u060c\u061b\u061f\u0621-\u0652\u0660-\u066càâäçéèêëîïôöùûüœæñáíóúßÀÉ°²’“”–•"
UNSAFE = re.compile(f"[^{SAFE_CLASS}]")
SAFE = frozenset(c for c in map(chr, range(0x2100)) if not UNSAFE.match(c))
_L = "A-Za-zÀ-ÿ"
# Places among safe characters that may be unlikely; looked at behind each character beyond ASCII, so that the
# pattern engine passes over all others.
GLUED = re.compile(
    f"[^\\x00-\\x7f](?:(?<=[{_L}][\u0621-\u0652])|(?<=[\u0621-\u0652])(?=[{_L}²°])|(?<=[a-zß-ÿ][ÀÉ])|(?<=[a-z][°²“”–])(?=[a-z])"
    f"|(?<=[À-ÿ])(?=[À-ÿ]{{2}})|(?<=[À-ÿ])(?<![{_L}][\\s\\S])(?=[À-ÿ](?![A-Za-z]))|(?<=À)(?![{_L}\\s])"
    f"|(?<=[a-z][îï])(?![{_L}])|(?<=[ïîëñíÔ])(?<![{_L}][\\s\\S])(?![{_L}'’]))"
)


def unsafe(text: str) -> bool:
    """Whether the text needs a closer look at all: all that ``map`` finds wrong, disguised or out of order is unsafe."""
    if text.isascii():
        return False
    if not SAFE.issuperset(text):
        return True
    return bool(GLUED.search(text)) or not unicodedata.is_normalized("NFC", text)


def odd(text: str) -> int:
    """How many places of the text are unlikely in sound text."""
    return len(ODD.findall(text))


# Letters of scripts beside the five languages' that two sound neighbours can add up to by chance.
_STRANGE = re.compile("[\u0180-\u0191\u0193-\u02af\u0460-\u05ff\u0671-\u0678\u067a-\u067d\u067f-\u0685\u0687\u0689-\u0690\u0692-\u0697\u0699-\u06a8\u06aa-\u06ae\u06b0-\u06b9\u06bb-\u06bd\u06bf\u06c0\u06c2-\u06d1\u06d3-\u08ff]")


@lru_cache(50_000)
def _undo_multi(run: str, codec: str) -> tuple[str, list[int]] | None:
    """UTF-8 read as a one-byte code page: the text, and how many characters each of its own came from."""
    table = byte_of(codec)
    raw = [table.get(c, -1) for c in run]
    if min(raw) >= 0x80:
        try:
            got = bytes(raw).decode("utf-8")
            if _STRANGE.search(got):
                raise ValueError
            return got, [2 if c < "\u0800" else 3 if c < "\U00010000" else 4 for c in got]
        except ValueError:
            pass
    out: list[str] = []
    width: list[int] = []
    i, good, n = 0, False, len(raw)
    while i < n:
        b = raw[i]
        k = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 1
        if k > 1 and i + k <= n and min(raw[i + 1 : i + k]) >= 0x80 and max(raw[i + 1 : i + k]) < 0xC0:
            try:
                ch = bytes(raw[i : i + k]).decode("utf-8")
                if _STRANGE.match(ch):
                    raise ValueError
                out.append(ch)
                width.append(k)
                i += k
                good = True
                continue
            except ValueError:
                pass
        out.append(run[i])
        width.append(1)
        i += 1
    return ("".join(out), width) if good else None


SHORT = 64  # characters of a run that is remembered


def _undone(run: str, codec: str) -> tuple[str, list[int]] | None:
    return _undo_multi(run, codec) if len(run) <= SHORT else _undo_multi.__wrapped__(run, codec)


@lru_cache(None)
def _single_table(real: str, read: str) -> dict[int, str]:
    table, chars = byte_of(read), char_of(real)
    return {ord(c): chars[b] for c, b in table.items() if b > 127 and chars[b] != c}


@lru_cache(8)
def _odd_words(text: str) -> list[tuple[int, int]]:
    """Words that hold an unlikely place."""
    spans: list[tuple[int, int]] = []
    for m in ODD.finditer(text):
        p = m.start() + (m.end() - m.start() > 1)
        if spans and p < spans[-1][1]:
            continue
        a, b = p, p
        while a and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if a < b:
            spans.append((a, b))
    return spans


def undo(text: str, chain: tuple[str, ...]) -> str | None:
    """The text before this wrong decoding; None where nothing in it can come from it."""
    if chain[0] != "utf-8":
        table = _single_table(*chain[:2])
        if len(chain) == 2:
            new = text.translate(table)
        else:
            out, at = [], 0
            for a, b in _odd_words(text):
                out += [text[at:a], text[a:b].translate(table)]
                at = b
            new = "".join(out) + text[at:]
        return new if new != text else None
    out, at = [], 0
    for m in _RUN.finditer(text):
        got = _undone(m[0], chain[1])
        if got is not None:
            out += [text[at : m.start()], got[0]]
            at = m.end()
    return "".join(out) + text[at:] if out else None


def undo_map(text: str, chain: tuple[str, ...]) -> tuple[str, list[int], list[int]] | None:
    """``undo`` with the place that each character came from."""
    if chain[0] != "utf-8":
        new = undo(text, chain)
        return None if new is None else (new, list(range(len(text))), list(range(1, len(text) + 1)))
    out: list[str] = []
    start: list[int] = []
    end: list[int] = []
    at = 0
    for m in _RUN.finditer(text):
        got = _undone(m[0], chain[1])
        if got is None:
            continue
        a, b = m.span()
        out += [text[at:a], got[0]]
        start.extend(range(at, a))
        end.extend(range(at + 1, a + 1))
        for w in got[1]:
            start.append(a)
            a += w
            end.append(a)
        at = b
    if not out:
        return None
    out.append(text[at:])
    start.extend(range(at, len(text)))
    end.extend(range(at + 1, len(text) + 1))
    return "".join(out), start, end


class Describer:
    """Description length of a line under per-language dictionaries."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 3):
        self.packers = {}
        for lang, data in dictionaries.items():
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=level)
            self.packers[lang] = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def length(self, text: str) -> float:
        """Bytes under the best language."""
        raw = text.encode("utf-8", "surrogatepass")
        return min(len(p.compress(raw)) for p in self.packers.values())


def train_dictionaries(samples: dict[str, list[str]], size: int = 32768) -> dict[str, bytes]:
    """One dictionary for each language from whole clean texts."""
    out = {}
    for lang, texts in samples.items():
        parts = [p.encode() for t in texts for p in re.split(r"(?<=[.!?])\s+|\n", t) if p]
        if len(parts) < 8:
            continue
        try:
            out[lang] = zstandard.train_dictionary(size, parts, level=3).as_bytes()
        except zstandard.ZstdError:
            out[lang] = b"".join(parts)[-size:]
    return out


TRAINING = 60_000  # pieces of the text that a dictionary is trained on where counts are given
_LINE = 8  # pieces of one of its lines


def text_of_counts(counts: dict[str, int], total: int) -> list[str]:
    """Lines of about TRAINING pieces in which each piece is as frequent as in the texts that were counted (``total``
    pieces, listed or not), spread evenly; of fewer, all of them."""
    share = min(1.0, TRAINING / max(total, 1))
    places: list[tuple[float, str]] = []
    for w, n in counts.items():
        times = round(n * share)
        at = zlib.crc32(w.encode("utf-8", "surrogatepass")) / (1 << 32)
        places += [((i + at) / times, w) for i in range(times)]
    text = [w for _, w in sorted(places)]
    return [" ".join(text[i : i + _LINE]) for i in range(0, len(text), _LINE)]


ROUNDS = 3  # wrong decodings that may lie on top of each other
AMBIGUOUS = re.compile("[аісуоІАﬂ]")  # look-alikes and ligatures that also arise from wrong decoding
_FROM_LOOKALIKE = [c for c in CHAINS if c in (("cp1252", "cp1251"), ("cp1252", "mac_roman"))]
CONTROLS = re.compile(r"[\x80-\x9f]")


class Repairer:
    """Chooses, for the lines of a text, the chain with the least description length."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.describe = Describer(dictionaries)

    def cost(self, text: str, left: int) -> float:
        return self.describe.length(text) + ODD_COST * left

    def chains(self, lines: list[str]) -> list[tuple[str, ...]]:
        """Chains to undo on these lines together, the last wrong decoding first."""
        taken: list[tuple[str, ...]] = []
        text = "\n".join(lines)
        cost = None
        for _ in range(ROUNDS):
            sound = canonical(text)
            hits = ODD.findall(sound)
            looks = len(SUSPECT.findall(text)) - len(SUSPECT.findall(sound))
            vague = len(AMBIGUOUS.findall(text))
            if not hits and not vague:
                break
            # look-alikes and ligatures also arise from wrong decoding, so their folding competes as a candidate
            options = []
            known: dict[str, tuple[str, int, bool]] = {}  # several chains may give the same text
            for k, chain in enumerate(CHAINS):
                if not hits and chain not in _FROM_LOOKALIKE or (new := undo(text, chain)) is None:
                    continue
                steps = [(chain, new)]
                if chain[0] == "utf-8" and (again := undo(new, chain)) is not None:
                    steps.append((chain, chain, again))
                for *names, got in steps:
                    if got not in known:
                        plain = canonical(got)
                        left = odd(plain)
                        better = left < len(hits) or left == len(hits) and len(AMBIGUOUS.findall(got)) < vague
                        known[got] = plain, left, better and len(SUSPECT.findall(got)) - len(SUSPECT.findall(plain)) <= looks
                    plain, left, better = known[got]
                    if better:
                        options.append((left, k, len(names), names, got, plain))
            if not options:
                break
            if cost is None:
                cost = self.cost(text, odd(text)) if sound == text else min(self.cost(text, odd(text)), self.cost(sound, len(hits)) + STEP_COST)
            priced = {got: self.cost(*known[got][:2]) for got in {x[4] for x in options}}
            best = min((priced[got] + STEP_COST * n, k, n, names, got) for _, k, n, names, got, _ in options)
            if best[0] + MARGIN > cost:
                break
            cost, _, _, names, text = best
            taken += names
        return taken

    def map(self, text: str) -> tuple[str, list[int] | None, list[int] | None, bool, bool]:
        """Sound canonical text, where each character came from (None: unchanged), whether any of it was
        decoded wrongly and whether any of it was disguised."""
        if not unsafe(text):
            return text, None, None, False, False
        out: list[str] = []
        start: list[int] = []
        end: list[int] = []
        wrong = disguised = changed = False
        lines = text.split("\n")
        odd_lines = [k for k, x in enumerate(lines) if unsafe(x) and (AMBIGUOUS.search(x) or ODD.search(canonical(x)))]
        plan: dict[int, list[tuple[str, ...]]] = {}
        if odd_lines:
            left = odd_lines
            for _ in range(2):  # a page may mix chains; what the first does not explain is tried again
                chains = self.chains([lines[k] for k in left])
                if not chains:
                    break
                done = []
                for k in left:
                    x = lines[k]
                    mine = []
                    for chain in chains:
                        new = undo(x, chain)
                        if new is None or new == x:
                            continue
                        if odd(canonical(new)) > odd(canonical(x)):
                            continue
                        mine.append(chain)
                        x = new
                    if mine:
                        plan[k] = mine
                        done.append(k)
                left = [k for k in left if k not in done]
                if not left or not done:
                    break
            for k in left:  # single lines that the page as a whole does not explain
                if len(odd_lines) > 1 and ODD.search(canonical(lines[k])) and (mine := self.chains([lines[k]])):
                    plan[k] = mine
        at = 0
        for k, x in enumerate(lines):
            if k:
                out.append("\n")
                start.append(at - 1)
                end.append(at)
            if x.isascii():
                out.append(x)
                start.extend(range(at, at + len(x)))
                end.extend(range(at + 1, at + len(x) + 1))
                at += len(x) + 1
                continue
            new, a, b = x, None, None
            for chain in plan.get(k, ()):
                if (got := undo_map(new, chain)) is not None:
                    new, a, b = _compose(got, a, b)
                    wrong = changed = True
            got = canonical_map(new)
            if got[1] is not None:
                if k not in plan and stands_in(x, got[0]):
                    disguised = True
                changed = True
                new, a, b = _compose(got, a, b)
            out.append(new)
            if a is None:
                start.extend(range(at, at + len(x)))
                end.extend(range(at + 1, at + len(x) + 1))
            else:
                start.extend([at + i for i in a])
                end.extend([at + i for i in b])
            at += len(x) + 1
        wrong = wrong or LOST in text or bool(CONTROLS.search(text))
        return ("".join(out), start, end, wrong, disguised) if changed else (text, None, None, wrong, disguised)


def _compose(got: tuple[str, list[int], list[int]], a: list[int] | None, b: list[int] | None) -> tuple[str, list[int], list[int]]:
    new, s, e = got
    return (new, s, e) if a is None else (new, [a[i] for i in s], [b[i - 1] for i in e])

