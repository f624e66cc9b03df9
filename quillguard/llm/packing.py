"""Best-fit packing of sizes into containers of one capacity."""

from __future__ import annotations

from collections.abc import Iterable


def best_fit(items: Iterable[tuple[int, list]], capacity: int) -> list[tuple[int, list]]:
    """Containers (fill, contents) for items (size, contents), largest first, each into the fullest that holds it.

    Open containers are kept by their free space; the free spaces in use are the bits of one integer, so the
    best fit is its lowest bit at or above the size.  Contents are lists and are joined.
    """
    by_free: dict[int, list[list]] = {}
    used = 0
    out: list[list] = []
    for size, contents in sorted(items, key=lambda x: -x[0]):
        fits = used >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            stack = by_free[free]
            one = stack.pop()
            if not stack:
                used ^= 1 << free
            one[0] += size
            one[1] = one[1] + contents if len(one[1]) < 8 else _extend(one[1], contents)
        else:
            one = [size, list(contents)]
            out.append(one)
        free = capacity - one[0]
        stack = by_free.setdefault(free, [])
        if not stack:
            used |= 1 << free
        stack.append(one)
    return [(fill, contents) for fill, contents in out]


def _extend(a: list, b: list) -> list:
    a.extend(b)
    return a
