"""Language of the sentences of a page: text likelihoods, to be fused with other evidence.

A page is cut into full sentences (headings, labels, lists, remarks in bullet points and contact lines
are none).  Each sentence gets a log-likelihood per language from word frequencies, with letter trigrams
for words the model has not seen; scripts rule languages out.  Neighbouring sentences of one language
form a stretch.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

LANGS = ("ar", "de", "en", "es", "fr")
LATIN = LANGS[1:]
MIN_WORDS = 3
FREQUENT = 50  # occurrences of a word from which its trigrams count no more
_BULLET = re.compile(r"^[ \t]*(?:[-•*–—·▪‣◦●○■□➢✓✔>#]|\d+[.)])[ \t]")
_END = re.compile(r"[.!?؟۔…][\"'’”»)\]]*[ \t]*$")
_SPLIT = re.compile(r"(?<=[.!?؟…])[ \t]+(?=[A-ZÀ-ÖØ-Þ¿¡\"“«ء-ي])")
_ABBREV = re.compile(r"(?:\b(?:M|MM|Mme|Mlle|Mr|Mrs|Ms|Dr|Prof|D|Sr|Sra|Nr|No|St|Av|bd)|\b[A-Z])\.$")
_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿœŒ]+|[ء-ْ]+")
_DOMAIN = re.compile(r"\S*@\S*|\S+\.[a-z]{2,}\S*")


class Model:
    """Word and letter-trigram log-likelihoods of the Latin languages; Arabic is told by its script."""

    def __init__(self, words: dict[str, tuple[float, ...]], grams: dict[str, tuple[float, ...]]):
        self.words, self.grams = words, grams
        self.unseen = lru_cache(200_000)(self._unseen)
        self.piece = lru_cache(150_000)(self._piece)

    def _unseen(self, word: str) -> tuple[float, ...]:
        w = f" {word} "
        total = [0.0] * len(LATIN)
        for i in range(len(w) - 2):
            g = self.grams.get(w[i : i + 3])
            if g is not None:
                for k, x in enumerate(g):
                    total[k] += x
        top = max(total)
        # an unseen word (a name, a rare word) may tilt a sentence only a little
        return tuple(max(-1.5, 0.25 * (x - top)) for x in total)

    def _piece(self, piece: str) -> tuple[float, ...]:
        """Log-likelihoods of the words of a piece of text between white space, and -1 for an Arabic one."""
        a = [0.0] * (len(LATIN) + 1)
        if _DOMAIN.search(piece.lower()):
            return tuple(a)
        for w in _WORD.findall(piece.lower()):
            if w[0] > "؀":
                a[-1] += 1
            else:
                for k, x in enumerate(self.words.get(w) or self.unseen(w)):
                    a[k] += x
        return tuple(a)

    def document(self, text: str) -> str:
        """Language of a whole text from its distinct words; empty for a text without words."""
        pieces = set(text.split())
        sums = [sum(x) for x in zip(*map(self.piece, pieces))] if pieces else []
        if not sums or not any(sums):
            return ""
        if 2 * sums[-1] >= len(pieces):
            return "ar"
        return LATIN[max(range(len(LATIN)), key=sums.__getitem__)]

    def score(self, text: str) -> tuple[float, ...] | None:
        """Log-likelihood per language of LANGS, relative to the best; None where there are too few words."""
        text = text.lower()
        if "@" in text or "." in text[:-2]:
            text = _DOMAIN.sub(" ", text)
        words = _WORD.findall(text)
        if len(words) < MIN_WORDS:
            return None
        arabic = sum(w[0] > "؀" for w in words)
        if 2 * arabic >= len(words):
            return (0.0, -30.0, -30.0, -30.0, -30.0)
        a = b = c = d = 0.0
        known = self.words
        for w in words:
            x = known.get(w)
            if x is None:
                if w[0] > "؀":
                    continue
                x = self.unseen(w)
            a += x[0]
            b += x[1]
            c += x[2]
            d += x[3]
        top = max(a, b, c, d)
        return (-30.0, max(a - top, -30.0), max(b - top, -30.0), max(c - top, -30.0), max(d - top, -30.0))


def train(samples: list[tuple[str, str]], smooth: float = 0.5) -> Model:
    """Model from (language, text) pairs; wrong labels dilute but do not decide, being the minority."""
    counts = {k: Counter() for k in LATIN}
    grams = {k: Counter() for k in LATIN}
    for lang, text in samples:
        if lang in counts:
            counts[lang].update(latin_words(text))
    for k in LATIN:
        for w, n in counts[k].items():
            for g in trigrams(w):
                grams[k][g] += min(n, FREQUENT)
    return fitted(counts, {k: sum(counts[k].values()) for k in LATIN}, grams, smooth=smooth)


def trigrams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


def latin_words(text: str) -> list[str]:
    return [w for w in _WORD.findall(text.lower()) if w[0] < "؀"]


def fitted(words: dict[str, dict[str, int]], totals: dict[str, int], grams: dict[str, dict[str, int]], scale: float = 1.0, smooth: float = 0.5) -> Model:
    """Model from counts of words and trigrams in the texts of each language.  ``totals``: all words of a language,
    listed in ``words`` or not; ``scale``: by what the counts are divided before they are smoothed."""

    def table(by: dict[str, dict[str, int]], sums: dict[str, int], floor: float) -> dict[str, tuple[float, ...]]:
        sums = {k: sums.get(k, 0) / scale + 1 for k in LATIN}
        out = {}
        for w in set().union(*by.values()):
            p = [(by.get(k, {}).get(w, 0) / scale + smooth) / sums[k] for k in LATIN]
            top = max(p)
            out[w] = tuple(max(math.log(x / top), floor) for x in p)
        return out

    return Model(table(words, totals, -6.0), table(grams, {k: sum(v.values()) for k, v in grams.items()}, -3.0))


def sentences(text: str) -> list[tuple[int, int, str]]:
    """Full sentences as (start, end, sentence); lines that are no running text give none."""
    out = []
    at = 0
    for line in text.split("\n"):
        n = len(line)
        if n > 15 and _END.search(line, max(0, n - 6)) and not _BULLET.match(line):
            a = 0
            for m in _SPLIT.finditer(line):
                if _ABBREV.search(line, max(0, m.start() - 5), m.start()):
                    continue
                out.append((at + a, at + m.start(), line[a : m.start()]))
                a = m.end()
            out.append((at + a, at + n, line[a:]))
        at += n + 1
    return out


def stretches(text: str, model: Model) -> list[tuple[int, int, int, int, tuple[float, ...]]]:
    """Stretches of one language: (start, end, language number, sentences, summed log-likelihoods)."""
    out: list[list] = []
    for a, b, s in sentences(text):
        x = model.score(s)
        if x is None:
            continue
        k = x.index(max(x))
        if out and out[-1][2] == k:
            last = out[-1]
            last[1] = b
            last[3] += 1
            last[4] = tuple(map(float.__add__, last[4], x))
        else:
            out.append([a, b, k, 1, x])
    return [tuple(x) for x in out]
