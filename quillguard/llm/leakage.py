"""Finding passages of test items in documents by winnowing."""

from __future__ import annotations

from xxhash import xxh3_64_intdigest

from .tokens import CACHE, words

K = 4  # words of a fingerprint
WINDOW = 2  # fingerprints of which the least is kept: every shared run of K + WINDOW - 1 words is met
LEAST = 15  # item words from the first to the last intact word of a stretch (sixteen with one altered end)
PER_ERROR = 8  # item words for each altered, dropped or foreign word
PENALTY = 3  # price of an error against an intact word when the extent of a stretch is chosen
SEEDED = 6  # words of the seeded runs on neighbouring diagonals: of sixteen with two altered, runs of five or more hold six
INTACT = LEAST - LEAST // PER_ERROR - 1  # words that window and item must have in common in order to be aligned


def _hash(gram: tuple[int, ...]) -> int:
    """Order of fingerprints: any fixed mixing of the word numbers will do."""
    h = 0x9E3779B97F4A7C15
    for x in gram:
        h = ((h ^ x) * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
    return h


def winnow(ids: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """(place, gram) of the least fingerprint of each window; the rightmost of equals, each place once."""
    n = len(ids) - K + 1
    if n < 1:
        return []
    grams = [tuple(ids[i : i + K]) for i in range(n)]
    hashes = [_hash(g) for g in grams]
    out, last = [], -1
    for a in range(max(1, n - WINDOW + 1)):
        b = min(a + WINDOW, n)
        k = min(range(b - 1, a - 1, -1), key=hashes.__getitem__)
        if k != last:
            out.append((k, grams[k]))
            last = k
    return out


def gram_hashes(ws: list[str], every: bool) -> list[int]:
    """64-bit fingerprints of the K-word runs of a text: all, or the winnowed (least of each WINDOW)."""
    hashes = [xxh3_64_intdigest(" ".join(ws[i : i + K])) - (1 << 63) for i in range(len(ws) - K + 1)]
    if every or not hashes:
        return hashes
    return [min(hashes[i : i + WINDOW]) for i in range(max(1, len(hashes) - WINDOW + 1))]


class _Numbers(dict):
    """Numbers of the words of a piece of text between white space; 0: no word of the test items."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) > CACHE:
            self.clear()
        got = self[piece] = tuple(self.vocabulary.get(w, 0) for w in words(piece))
        return got


class Index:
    """Fingerprints of test items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.items: dict[int, list[int]] = {}
        self.prints: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text or "")]
            self.items[item] = ids
        self.masks: dict[int, dict[int, int]] = {}
        for item, ids in self.items.items():
            m = self.masks[item] = {}
            for i, w in enumerate(ids):
                m[w] = m.get(w, 0) | 1 << i
            # the test side keeps every gram, so that a document's fingerprint is met wherever it falls
            for i in range(len(ids) - K + 1):
                self.prints.setdefault(tuple(ids[i : i + K]), []).append((item, i))
        self.numbers = _Numbers(self.vocabulary)

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        get = self.numbers.__getitem__
        for piece in text.split():
            out += get(piece)
        return out

    def search(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """Every leaked stretch of a text: (item, intact words, item words spanned, first and last word in the text)."""
        if not text:
            return []
        return self.search_ids(self.ids(text))

    def search_ids(self, ids: list[int]) -> list[tuple[int, int, int, int, int]]:
        known = bytes(map(bool, ids))
        if b"\1" * K not in known:
            return []
        # fingerprints with a word that no item has cannot match: only stretches of known words are winnowed
        seeds: dict[int, dict[int, list[int]]] = {}
        a, n = 0, len(ids)
        while a < n:
            a = known.find(1, a)
            if a < 0:
                break
            b = known.find(0, a)
            b = n if b < 0 else b
            if b - a >= K:
                for k, gram in winnow(ids[a:b]):
                    for item, i in self.prints.get(gram, ()):
                        seeds.setdefault(item, {}).setdefault(a + k - i, []).append(a + k)
            a = b
        out = []
        for item, diagonals in seeds.items():
            target = self.items[item]
            found: list[tuple[int, int, int, int]] = []
            for lo, hi, runs in self._regions(ids, target, diagonals):
                if common_in_order(ids[lo:hi], self.masks[item], len(target)) < INTACT:
                    continue
                for run in sorted(runs, key=lambda r: r[1] - r[2]):
                    if not any(x <= run[1] and run[2] <= y + 1 for _, _, x, y in found) and (got := stretch(ids, target, run)) and got[2:] not in [x[2:] for x in found]:
                        found.append(got)
            # of a stretch that lies within another, only the outer one
            out += [(item, *x) for x in found if not any(y[2] <= x[2] and x[3] <= y[3] and y[2:] != x[2:] for y in found)]
        return out

    @staticmethod
    def _regions(ids: list[int], target: list[int], diagonals: dict[int, list[int]]) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
        """Windows of the text in which enough of the item stands on neighbouring diagonals, with the shared runs."""
        runs = []
        for d, places in diagonals.items():
            end = -1
            for j in sorted(places):
                if j < end:
                    continue
                a = j
                while a and a - d > 0 and ids[a - 1] == target[a - 1 - d]:
                    a -= 1
                end = j
                while end < len(ids) and end - d < len(target) and ids[end] == target[end - d]:
                    end += 1
                runs.append((d, a, end))
        runs.sort()
        out, group = [], []
        slack = max(3, len(target) // PER_ERROR + 1)
        for r in runs:
            if group and r[0] - group[-1][0] > slack:
                out.append(group)
                group = []
            group.append(r)
        out.append(group)
        regions = []
        for g in out:
            covered = set()
            for d, a, b in g:
                covered.update(range(a - d, b - d))
            if len(covered) >= SEEDED:
                lo = min(d for d, _, _ in g) - slack
                hi = max(d for d, _, _ in g) + len(target) + slack
                regions.append((max(0, lo), min(len(ids), hi), g))
        return regions


def common_in_order(text: list[int], masks: dict[int, int], n: int) -> int:
    """Length of the longest common subsequence, one integer operation per word of the text."""
    full = (1 << n) - 1
    v = full
    for w in text:
        m = masks.get(w)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def reach(text: list[int], target: list[int], most: int) -> list[tuple[int, int, int]]:
    """How far the item goes on in the text from where both begin, with 0, 1, ... most errors.

    Of each number of errors: item words, text words and intact words up to the last intact word.  On every
    diagonal the furthest place is kept, so no way with as many errors gets further.
    """
    n, m = len(text), len(target)
    i = 0
    while i < n and i < m and text[i] == target[i]:
        i += 1
    front = {0: (i, i)}  # diagonal (text place less item place): item place, intact words
    out = [(i, i, i)]
    for e in range(1, most + 1):
        if out[-1][0] == m:
            break
        new, far = {}, out[-1]
        for d in range(-e, e + 1):
            ways = []
            if (x := front.get(d)) is not None:  # altered
                ways.append((x[0] + 1, x[1]))
            if (x := front.get(d - 1)) is not None:  # foreign
                ways.append(x)
            if (x := front.get(d + 1)) is not None:  # dropped
                ways.append((x[0] + 1, x[1]))
            ways = [x for x in ways if x[0] <= m and x[0] + d <= n]
            if not ways:
                continue
            i, intact = start = max(ways)
            while i < m and i + d < n and text[i + d] == target[i]:
                i += 1
            new[d] = (i, intact + i - start[0])
            if i > start[0] and i > far[0]:
                far = (i, i + d, new[d][1])
        front = new
        out.append(far)
    return out


def stretch(ids: list[int], target: list[int], run: tuple[int, int, int]) -> tuple[int, int, int, int] | None:
    """Best stretch of the item about a shared run (diagonal, first text word, end): intact words, item words,
    first and last text word.  Errors may stand near either end; None where no stretch is long and sound enough."""
    d, a, b = run
    most = (len(target) + PER_ERROR - 1) // PER_ERROR
    room = len(target) + most
    before = reach(ids[max(0, a - room) : a][::-1], target[: a - d][::-1], most)
    after = reach(ids[b : b + room], target[b - d :], most)
    best = None
    for e, (i, j, x) in enumerate(before):
        for f, (k, n, y) in enumerate(after):
            span, intact = i + b - a + k, x + b - a + y
            if span >= LEAST and (e + f) * PER_ERROR < span + PER_ERROR:
                got = (intact - PENALTY * (e + f), intact, span, a - j, b + n - 1)
                if best is None or got[0] > best[0]:
                    best = got
    return None if best is None else best[1:]
