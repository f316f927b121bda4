"""Cutting stock on a histogram of lengths by column generation.

The linear program covers the demand of each length with the fewest sequences. Its columns are patterns, counts of lengths
that fit one sequence. A knapsack over the dual prices finds the best new column; the basis inverse is updated in place. The program has one
row per distinct length, at most the capacity, so its size does not grow with the number of documents.
"""

from __future__ import annotations

import numpy as np

#: The relaxation stops when its value is this close to its lower bound, or after this many columns for each length.
GAP, COLUMNS_PER_LENGTH = 2e-3, 2
#: A sequence of whole pieces is taken outside the relaxed program if at most this share of it stays empty.
SLACK = 0.01

Pattern = dict[int, int]


def best_pattern(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: counts of lengths within the capacity with the greatest total price."""
    price = np.zeros(capacity + 1)
    price[lengths] = np.maximum(prices, 0)
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        with_last = price[1 : c + 1] + best[c - 1 :: -1][:c]
        k = int(with_last.argmax())
        if with_last[k] > best[c - 1] + 1e-12:
            best[c], taken[c] = with_last[k], k + 1
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(capacity + 1, np.int64), capacity
    while c > 0:
        counts[taken[c]] += taken[c] > 0
        c -= taken[c] if taken[c] else 1
    return float(best[capacity]), counts[lengths]


def first_basis(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A triangular basis: fill largest first, with fractions of sequences, so that each pattern ends one length."""
    m = len(lengths)
    left, basis, used, open_ = demand.astype(float), np.zeros((m, m), np.int64), np.zeros(m), np.ones(m, bool)
    for _ in range(m):
        room, counts = capacity, np.zeros(m, np.int64)
        for i in np.flatnonzero(open_)[::-1]:
            if lengths[i] <= room:
                counts[i] = min(room // lengths[i], max(1, int(left[i])))
                room -= counts[i] * lengths[i]
        inside = np.flatnonzero(counts)
        ends = inside[(left[inside] / counts[inside]).argmin()]
        used[ends] = max(left[ends], 0) / counts[ends]
        left[inside] -= used[ends] * counts[inside]
        open_[ends] = False
        basis[:, ends] = counts
    return basis, used


def relaxation(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Patterns in the basis, how often each is used in the relaxed program, and the lower bound reached."""
    m = len(lengths)
    basis, used = first_basis(lengths, demand, capacity)
    patterns: list[np.ndarray | None] = list(basis.T)
    inverse, cost = np.linalg.inv(basis.astype(float)), np.ones(m)
    bound = float((lengths * demand).sum()) / capacity
    for _ in range(COLUMNS_PER_LENGTH * m):
        prices = cost @ inverse
        low = int(prices.argmin())
        if prices[low] < -1e-9:
            pattern, column, price = None, -(np.arange(m) == low).astype(float), 0.0
        else:
            value, counts = best_pattern(lengths, prices, capacity)
            if value <= 1 + 1e-9:
                bound = max(bound, float(cost @ used))
                break
            bound = max(bound, float(np.maximum(prices, 0) @ demand) / value)
            if cost @ used <= bound * (1 + GAP):
                break
            pattern, column, price = counts, counts.astype(float), 1.0
        way = inverse @ column
        up = way > 1e-10
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = used[up] / way[up]
        out = int(ratio.argmin())
        step = ratio[out]
        used = np.maximum(used - step * way, 0)
        used[out] = step
        row = inverse[out] / way[out]
        moved = np.flatnonzero(np.abs(way) > 1e-13)
        inverse[moved] -= way[moved, None] * row
        inverse[out] = row
        patterns[out], cost[out] = pattern, price
    kept = [i for i in range(m) if patterns[i] is not None and used[i] > 0]
    return [patterns[i] for i in kept], used[kept], bound


def cutting_stock(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int], float]:
    """(pattern, how many sequences) of whole pieces, the pieces left over, and a lower bound on the number of sequences of whole pieces.

    Patterns of the relaxation that are full but for SLACK are used floor(value) times as far as pieces are left, then sequences filled largest first that are as full.
    The caller cuts what is left: a few pieces for each pattern, or any number where lengths do not fit each other. Empty histogram: no patterns."""
    full = histogram.get(capacity, 0)
    part = {n: k for n, k in sorted(histogram.items()) if 0 < n < capacity and k > 0}
    plan: list[tuple[Pattern, int]] = [({capacity: 1}, full)] if full else []
    if not part:
        return plan, {}, float(full)
    lengths, left = np.array(list(part)), np.array(list(part.values()))
    patterns, used, bound = relaxation(lengths, left.astype(float), capacity)
    for i in np.argsort(-used):
        pattern = patterns[i]
        in_it = pattern > 0
        if capacity - int(pattern @ lengths) > SLACK * capacity:
            continue
        times = min(int(used[i] + 1e-9), int((left[in_it] // pattern[in_it]).min()))
        if times > 0:
            left = left - times * pattern
            plan.append(({int(n): int(k) for n, k in zip(lengths[in_it], pattern[in_it], strict=True)}, times))
    more, rest = largest_first({int(n): int(k) for n, k in zip(lengths, left, strict=True) if k}, capacity)
    return plan + more, rest, full + bound


def largest_first(left: Pattern, capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Sequences that the largest pieces that fit fill but for SLACK, equal ones at once, and the pieces left over."""
    plan, rest = [], {}
    left = dict(left)
    while left:
        room, pattern = capacity, {}
        for n in sorted(left, reverse=True):
            if n <= room and (k := min(left[n], room // n)):
                pattern[n] = k
                room -= k * n
        if room > SLACK * capacity:
            n = max(pattern)
            rest[n] = rest.get(n, 0) + left.pop(n)
            continue
        times = min(left[n] // k for n, k in pattern.items())
        plan.append((pattern, times))
        for n, k in pattern.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return plan, rest


def powers_of_two(n: int) -> list[int]:
    """The powers of two that n is the sum of, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]
