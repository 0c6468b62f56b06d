"""Longest common subsequences in bounded time: bit-parallel rows in Python's long integers, and Hirschberg's halving for the places."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


def masks(y: Sequence[Hashable]) -> dict[Hashable, int]:
    """For each item of y the places where it stands, as bits."""
    out: dict[Hashable, int] = {}
    for j, v in enumerate(y):
        out[v] = out.get(v, 0) | 1 << j
    return out


def last_row(x: Sequence[Hashable], y: Sequence[Hashable]) -> int:
    """After all of x: bit j is 0 where a longest common subsequence with y[: j + 1] is longer than that with y[:j]."""
    of, row = masks(y), (1 << len(y)) - 1
    every = row
    for v in x:
        if v in of:
            met = row & of[v]
            row = ((row + met) | (row - met)) & every
    return row


def common_length(x: Sequence[Hashable], y: Sequence[Hashable]) -> int:
    """Length of a longest common subsequence; len(x) * len(y) / 64 steps of a machine."""
    if x == y:
        return len(x)
    if len(x) < len(y):
        x, y = y, x
    return len(y) - last_row(x, y).bit_count()


def prefix_lengths(x: Sequence[Hashable], y: Sequence[Hashable]) -> list[int]:
    """Length of a longest common subsequence of x with y[:j], for j from 0 on."""
    out, row = [0], last_row(x, y)
    for bit in bin(row | 1 << len(y))[:2:-1]:
        out.append(out[-1] + (bit == "0"))
    return out


def common_places(x: Sequence[Hashable], y: Sequence[Hashable]) -> list[tuple[int, int]]:
    """The places in x and y of a longest common subsequence, in order; memory grows with len(x) + len(y)."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        if b - a == 1:
            for j in range(c, d):
                if y[j] == x[a]:
                    out.append((a, j))
                    break
            continue
        mid = (a + b) // 2
        ahead = prefix_lengths(x[a:mid], y[c:d])
        behind = prefix_lengths(x[mid:b][::-1], y[c:d][::-1])[::-1]
        cut = c + max(range(d - c + 1), key=lambda j: ahead[j] + behind[j])
        todo += [(a, mid, c, cut), (mid, b, cut, d)]
    return sorted(out)
