"""Reading level of a text: syntax and vocabulary features, a linear pairwise ranker, isotonic levels."""

from __future__ import annotations

import math
import re
from bisect import bisect_right

import numpy as np

from .language import LANGS
from .tokens import CACHE, words

# Quoted fragments: between ellipses, or lines that begin or end with one.
_QUOTE = re.compile(r"(?m)^[ \t]*(?:\.\.\.|…).*$|(?:\.\.\.|…)[^.!?\n]{0,200}(?:\.[^.!?\n]{0,80})?(?:\.\.\.|…)|^[^\n]{0,200}(?:\.\.\.|…)[ \t]*$")
_SENTENCE = re.compile(r"[^.!?؟\n]+[.!?؟]*")
FEATURES = (
    "mean_words", "median_words", "upper_words", "word_letters", "long_words", "very_long_words", "commas", "sentence_letters", "short_sentences",
    "long_sentences", "type_ratio", "rare_share",
)


class _Shape(dict):
    """Letters, long words and commas of a piece of text between white space, remembered."""

    def __missing__(self, piece: str) -> tuple[int, int, int, int, int]:
        if len(self) > CACHE:
            self.clear()
        ws = words(piece)
        got = self[piece] = (
            len(ws), sum(map(len, ws)), sum(len(w) >= 9 for w in ws), sum(len(w) >= 12 for w in ws), sum(c in ",;:،؛" for c in piece),
        )
        return got


_SHAPES = _Shape()


def own_text(text: str) -> str:
    """The text without quoted fragments."""
    return _QUOTE.sub("\n", text) if "..." in text or "…" in text else text


def own_spans(text: str, skip: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words of a text as spans of words of its ``own_text``."""
    if "..." not in text and "…" not in text:
        return skip
    count = lambda x: sum(_SHAPES[p][0] for p in x.split())
    quotes, at, n = [], 0, 0
    for m in _QUOTE.finditer(text):
        n += count(text[at : m.start()])
        quotes.append((n, n := n + count(m[0])))
        at = m.end()
    place = lambda p: p - sum(max(0, min(p, b) - a) for a, b in quotes)
    return [(place(a), place(b)) for a, b in skip]


def features(text: str, skip: list[tuple[int, int]] = ()) -> list[float] | None:
    """Features of a text; ``skip`` holds spans of words (leaked passages) that do not count
    any more than quoted fragments.

    None for a text without words.  Sentences of which more than half is skipped are left out whole.
    """
    lengths: list[int] = []
    letters = long = very = commas = total = 0
    kinds: set[str] = set()
    at = 0
    get = _SHAPES.__getitem__
    if skip:
        skip = own_spans(text, skip)
    for m in _SENTENCE.finditer(own_text(text)):
        pieces = m[0].split()
        n = a = b = c = d = 0
        for p in pieces:
            x = get(p)
            n += x[0]
            a += x[1]
            b += x[2]
            c += x[3]
            d += x[4]
        if not n:
            continue
        start, at = at, at + n
        if skip and sum(max(0, min(at, y) - max(start, x)) for x, y in skip) * 2 > n:
            continue
        lengths.append(n)
        letters += a
        long += b
        very += c
        commas += d
        total += n
        kinds.update(pieces)
    if not total:
        return None
    lengths.sort()
    k = len(lengths)
    half = acc = 0
    for x in lengths:  # sentence length at which half of the words are reached: what most of the text is like
        acc += x
        if 2 * acc >= total:
            half = x
            break
    return [
        math.log(total / k), math.log(lengths[k // 2]), math.log(half), letters / total, long / total, very / total, commas / k, math.log(letters / k),
        sum(x <= 9 for x in lengths) / k, sum(x * (x >= 30) for x in lengths) / total, len(kinds) / math.sqrt(total), sum(x * (x >= 15) for x in lengths) / total,
    ]


def majority(ratings: list[int]) -> float | None:
    """Median of the ratings of a document; null ratings do not count."""
    r = sorted(x for x in ratings if x is not None)
    return (r[(len(r) - 1) // 2] + r[len(r) // 2]) / 2 if r else None


class Ranker:
    """Score of a text and its level.

    Features are standardized per language; the weights come from logistic regression on differences of
    document pairs of one language whose grades differ, the levels from isotonic regression of the grades
    on the scores.
    """

    def __init__(self, mean: dict[str, np.ndarray], scale: dict[str, np.ndarray], weights: np.ndarray, knots: list[tuple[float, float]], spread: dict[str, tuple[float, float]] | None = None):
        self.mean, self.scale, self.weights, self.knots = mean, scale, weights, knots
        self.edges = [x for x, _ in knots]

    def score(self, lang: str, x: list[float]) -> float:
        key = lang if lang in self.mean else ""
        z = (np.asarray(x) - self.mean[key]) / self.scale[key]
        return float(np.clip(z, -4, 4) @ self.weights)

    def level(self, score: float) -> int:
        k = bisect_right(self.edges, score) - 1
        return int(min(4, max(1, math.floor(self.knots[max(k, 0)][1] + 0.5))))


def isotonic(x: np.ndarray, y: np.ndarray) -> list[tuple[float, float]]:
    """Pool-adjacent-violators: knots (from this score on, fitted value)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for i in order:
        blocks.append([x[i], y[i], 1.0])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            s, v, n = blocks.pop()
            p = blocks[-1]
            p[1] = (p[1] * p[2] + v * n) / (p[2] + n)
            p[2] += n
    return [(b[0], b[1]) for b in blocks]


def train(rows: list[tuple[str, list[float], float]], pairs: int = 60_000, steps: int = 300, seed: int = 7) -> Ranker:
    """Ranker from (language, features, grade) rows."""
    rng = np.random.default_rng(seed)
    langs = [r[0] for r in rows]
    f = np.asarray([r[1] for r in rows], dtype=float)
    g = np.asarray([r[2] for r in rows], dtype=float)
    mean, scale = {"": f.mean(0)}, {"": f.std(0) + 1e-6}
    z = np.zeros_like(f)
    for lang in set(langs):
        idx = np.array([i for i, x in enumerate(langs) if x == lang])
        if len(idx) >= 30 and lang in LANGS:
            # level mixes differ by language in a sample: standardize on equal weights for each grade
            w = np.zeros(len(idx))
            rounded = np.round(g[idx])
            for v in np.unique(rounded):
                w[rounded == v] = 1 / (rounded == v).sum()
            w /= w.sum()
            mu = w @ f[idx]
            mean[lang], scale[lang] = mu, np.sqrt(w @ (f[idx] - mu) ** 2) + 1e-6
    for i, lang in enumerate(langs):
        k = lang if lang in mean else ""
        z[i] = np.clip((f[i] - mean[k]) / scale[k], -4, 4)
    by: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        by.setdefault(lang, []).append(i)
    a_all, b_all = [], []
    for idx in by.values():
        n = max(1, pairs * len(idx) // len(langs))
        a, b = rng.choice(idx, n), rng.choice(idx, n)
        keep = g[a] - g[b] >= 0.75
        a_all.append(a[keep])
        b_all.append(b[keep])
    a, b = np.concatenate(a_all), np.concatenate(b_all)
    d = z[a] - z[b]
    w = np.zeros(f.shape[1])
    if len(d):
        for _ in range(steps):  # Newton steps of the ridge logistic loss converge in a few rounds
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            grad = d.T @ p / len(d) - 1e-3 * w
            h = (d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(len(w))
            step = np.linalg.solve(h, grad)
            w += step
            if np.abs(step).max() < 1e-6:
                break
    return Ranker(mean, scale, w, isotonic(z @ w, g))
