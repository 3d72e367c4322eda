"""Similarity of strings by their longest common subsequence, 0 to 100."""

from __future__ import annotations


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of ``a``."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str, at_least: float = 0.0) -> float:
    """200 * common / total length; 100 for two empty strings. Below ``at_least`` the answer may be any lower number."""
    total = len(a) + len(b)
    if not total:
        return 100.0
    if 200.0 * min(len(a), len(b)) / total < at_least:
        return 0.0
    return 200.0 * lcs_length(a, b) / total


def sorted_tokens(text: str) -> str:
    return " ".join(sorted(text.split()))


def token_sort_ratio(a: str, b: str, at_least: float = 0.0) -> float:
    return ratio(sorted_tokens(a), sorted_tokens(b), at_least)
