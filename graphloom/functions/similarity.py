"""String likeness from 0 to 100 by weighted combination of edit-distance ratios."""

from __future__ import annotations

import re


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return bin(~s & full).count("1")


def ratio(a: str, b: str) -> float:
    """Share of characters that insertions and deletions leave."""
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * _lcs(a, b) / n


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a part of the longer one, also one cut at its ends."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n, signs = len(a), set(a)
    best = 0.0
    for i in range(1 - n, len(b)):
        part = b[max(0, i) : i + n]
        if part and (part[-1] in signs or part[0] in signs):
            best = max(best, ratio(a, part))
            if best == 100.0:
                break
    return best


def _sorted(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(_sorted(a), _sorted(b))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    with_x, with_y = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    found = ratio(with_x, with_y)
    return max(found, ratio(both, with_x), ratio(both, with_y)) if both else found


def wratio(a: str, b: str) -> float:
    """The best of the plain, token and, for strings of unlike length, partial ratios, each with its weight."""
    if not a or not b:
        return 0.0
    long, short = max(len(a), len(b)), min(len(a), len(b))
    best = ratio(a, b)
    if long < 1.5 * short:
        return max(best, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    weight = 0.9 if long <= 8 * short else 0.6
    best = max(best, weight * partial_ratio(a, b))
    x, y = set(a.split()), set(b.split())
    partial_set = 100.0 if x & y else partial_ratio(" ".join(sorted(x - y)), " ".join(sorted(y - x)))
    return max(best, 0.95 * weight * max(partial_ratio(_sorted(a), _sorted(b)), partial_set))


def best_match(name: str, among: list[str], cutoff: float = 80.0) -> tuple[str, float] | None:
    """The most alike of several strings at or above the cutoff; the first of equals."""
    found = None
    for other in among:
        score = wratio(name, other)
        if score >= cutoff and (found is None or score > found[1]):
            found = (other, score)
    return found


def squeezed(name: str) -> str:
    return re.sub(r"\s+", " ", name).strip()
