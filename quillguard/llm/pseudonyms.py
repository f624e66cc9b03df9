"""Format-preserving pseudonyms: a keyed Feistel network over the digits (and letters) of a value.

Digits map to digits and letters to letters, separators stay, so a pseudonym has the format of its value;
the map is a permutation, so equal values get equal pseudonyms in all documents and different values
different ones.  Numbers with a check key get a fresh valid key, dates stay valid dates.
"""

from __future__ import annotations

import hashlib
from datetime import date, timedelta
from functools import lru_cache

ROUNDS = 8
SUBSCRIBER = 8  # last digits of a phone, the same in every notation of it
_CHECK = "TRWAGMYFPDXBNJZSQVHLCKE"  # check letters of an identity number, by its remainder


def _round(key: bytes, tweak: str, i: int, half: int, modulus: int) -> int:
    h = hashlib.blake2b(f"{tweak}|{i}|{half}".encode(), key=key, digest_size=16)
    return int.from_bytes(h.digest(), "big") % modulus


def permute(value: int, modulus_left: int, modulus_right: int, key: bytes, tweak: str) -> int:
    """A permutation of range(modulus_left * modulus_right): additive Feistel rounds on two unequal halves."""
    left, right = divmod(value, modulus_right)
    for i in range(0, ROUNDS, 2):
        left = (left + _round(key, tweak, i, right, modulus_left)) % modulus_left
        right = (right + _round(key, tweak, i + 1, left, modulus_right)) % modulus_right
    return left * modulus_right + right


def unpermute(value: int, modulus_left: int, modulus_right: int, key: bytes, tweak: str) -> int:
    left, right = divmod(value, modulus_right)
    for i in range(ROUNDS - 2, -1, -2):
        right = (right - _round(key, tweak, i + 1, left, modulus_right)) % modulus_right
        left = (left - _round(key, tweak, i, right, modulus_left)) % modulus_left
    return left * modulus_right + right


def permute_digits(digits: str, key: bytes, tweak: str, inverse: bool = False) -> str:
    """Digits to as many digits; a single digit is permuted too."""
    n = len(digits)
    a = max(1, n // 2)
    f = unpermute if inverse else permute
    return str(f(int(digits), 10**a, 10 ** (n - a), key, f"{tweak}:{n}")).zfill(n)


def permute_letters(letters: str, key: bytes, tweak: str, inverse: bool = False) -> str:
    """Capital letters A-Z to as many capital letters."""
    n = len(letters)
    value = 0
    for c in letters:
        value = value * 26 + ord(c) - 65
    a = max(1, n // 2)
    value = (unpermute if inverse else permute)(value, 26**a, 26 ** (n - a), key, f"{tweak}:{n}")
    out = []
    for _ in range(n):
        value, r = divmod(value, 26)
        out.append(chr(65 + r))
    return "".join(reversed(out))


def _refill(value: str, digits: str, letters: str, keep: int = 0) -> str:
    """The value with its digits after the first ``keep`` and its letters replaced in order."""
    d, x, seen, out = iter(digits), iter(letters), 0, []
    for c in value:
        if c.isdigit():
            seen += 1
            out.append(c if seen <= keep else next(d))
        elif "A" <= c <= "Z":
            out.append(next(x))
        else:
            out.append(c)
    return "".join(out)


def _checked(value: str, digits: str, letters: str) -> str | None:
    """What stands for the first letter in the check of a number with a fitting check letter; None for other values."""
    first = {"": "", "X": "0", "Y": "1", "Z": "2"}.get(letters[:-1])
    if not letters or first is None or len(first + digits) != 8 or value.rstrip()[-1] != letters[-1]:
        return None
    return first if _CHECK[int(first + digits) % 23] == letters[-1] else None


@lru_cache(50_000)
def number(value: str, key: bytes, kind: str) -> str:
    """Pseudonym of a phone or identity number in its own format.

    Of a phone the last eight digits are replaced, whatever stands before them, so that its national and
    international notations stay linked; a 15-digit social security number whose key fits (97 - number mod 97)
    and a number of eight digits (or X, Y, Z and seven) whose check letter fits get one that fits again.
    """
    value = "".join(str(int(c)) if c.isdigit() else c for c in value)  # digits of other scripts
    digits = "".join(c for c in value if c.isdigit())
    letters = "".join(c for c in value if "A" <= c <= "Z")
    if not digits:
        return value
    keep = 0
    if kind == "PHONE":
        keep = max(min(1, len(digits) - 1), len(digits) - SUBSCRIBER)
        return _refill(value, permute_digits(digits[keep:], key, kind), permute_letters(letters, key, kind) if letters else "", keep)
    new_letters = permute_letters(letters, key, kind) if letters else ""
    body = digits[keep:]
    if kind == "ID_NUMBER" and len(digits) == 15 and int(digits[:13]) % 97 == 97 - int(digits[13:]):
        body = permute_digits(digits[:13], key, kind)
        body += f"{97 - int(body) % 97:02d}"
    elif kind == "ID_NUMBER" and (first := _checked(value, digits, letters)) is not None:
        body = permute_digits(body, key, kind)
        new_letters = letters[:-1] + _CHECK[int(first + body) % 23]
    else:
        body = permute_digits(body, key, kind + digits[:keep])
    return _refill(value, body, new_letters, keep)


_FIRST, _DAYS = date(1900, 1, 1), 73_049  # days until the end of 2099


@lru_cache(50_000)
def day(value: date, key: bytes) -> date:
    """A date to a date of the same two centuries; dates outside stay as they are."""
    n = (value - _FIRST).days
    if not 0 <= n < _DAYS:
        return value
    while True:  # cycle walking within the smallest grid that holds all days
        n = permute(n, 271, 270, key, "day")
        if n < _DAYS:
            return _FIRST + timedelta(days=n)


@lru_cache(50_000)
def tag(value: str, key: bytes, kind: str) -> str:
    """Keyed tag of 128 bits of a value that has no numeric format (name, address, e-mail)."""
    return hashlib.blake2b(f"{kind}|{value}".encode(), key=key, digest_size=16).hexdigest()
