"""Cutting stock by column generation over a length histogram: numpy only, on numbers whose count does not grow with the data.

Lengths are rounded up to bins. A pattern says how many pieces of each bin share a sequence. The linear program over
patterns is solved by the revised simplex method; new patterns come from an unbounded knapsack priced by the dual values
(dynamic programming over the capacity). Patterns are used a whole number of times; what is left, about one sequence a
pattern, is put together by first fit, longest first.
"""

from __future__ import annotations

import numpy as np

#: Relative width of a bin, and the most steps that the capacity is divided into for even bins.
FINENESS = 64
STEPS = 256
MOST_PATTERNS = 4000
#: How far above the optimum of the linear program to stop.
CLOSE = 1e-3
#: Rounds in a row that bring nothing (ties between patterns) before stopping.
IDLE = 40


def bin_edges(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[int, np.ndarray]:
    """(unit, upper edge of the bin of each length): even steps where pieces are long, finer ones where they are short."""
    mean = float((lengths * counts).sum()) / max(1, counts.sum())
    unit = 1
    while unit * 2 <= min(capacity / STEPS, max(1.0, mean / FINENESS)):
        unit *= 2
    step = np.maximum(unit, 2 ** np.maximum(0, np.ceil(np.log2(np.maximum(lengths, 1))) - np.log2(FINENESS))).astype(np.int64)
    step = np.where(lengths > capacity // 2, unit, step)
    return unit, np.minimum(-(-lengths // step) * step, capacity)


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of items (values over 0) that fits."""
    use = np.flatnonzero(values > 1e-12)
    size, value = sizes[use], values[use]
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    order = np.argsort(size)
    size, value, use = size[order], value[order], use[order]
    fits = np.searchsorted(size, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        n = fits[c]
        if n:
            gain = best[c - size[:n]] + value[:n]
            i = int(gain.argmax())
            if gain[i] > best[c]:
                best[c], pick[c] = gain[i], i
    counts = np.zeros(len(sizes), np.int64)
    c = capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[use[pick[c]]] += 1
            c -= size[pick[c]]
    return float(best[capacity]), counts


def _linear_program(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, times each is used) of the relaxed problem."""
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(np.float64)
    inverse = np.diag(1.0 / columns.diagonal())
    x = inverse @ demand
    idle = 0
    for k in range(MOST_PATTERNS):
        dual = inverse.sum(axis=0)
        value, new = _knapsack(sizes, dual, capacity)
        total = x.sum()
        # no plan needs fewer sequences than total / value
        if value <= 1 + CLOSE or np.ceil(total / value - 1e-6) >= np.ceil(total - 1e-6) or idle > IDLE:
            break
        move = inverse @ new
        ratio = np.full(m, np.inf)
        np.divide(x, move, out=ratio, where=move > 1e-9)
        out = int(ratio.argmin())
        step = max(0.0, ratio[out])
        idle = idle + 1 if step * (value - 1) <= 1e-9 * total else 0
        x -= step * move
        x[out] = step
        columns[:, out] = new
        if k % 50 == 49:
            inverse = np.linalg.inv(columns)
            x = inverse @ demand
        else:
            row = inverse[out] / move[out]
            inverse -= np.outer(move, row)
            inverse[out] = row
    return columns.round().astype(np.int64), np.maximum(x, 0)


def plan(edges: np.ndarray, counts: np.ndarray, unit: int, capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(edge: pieces, ...) of a sequence, how many such sequences]; holds every piece once and never over `capacity`."""
    if not len(edges):
        return []
    sizes, room = edges // unit, capacity // unit
    columns, x = _linear_program(sizes, counts.astype(np.float64), room)
    left = counts.astype(np.int64).copy()
    out = []
    for p in np.argsort(-x, kind="stable"):
        times = int(np.floor(x[p] + 1e-6))
        need = columns[:, p]
        if need.any():
            times = min(times, int((left[need > 0] // need[need > 0]).min()))
            if times > 0:
                left -= times * need
                out.append((dict(zip(edges[need > 0].tolist(), need[need > 0].tolist())), times))
    rooms: list[int] = []
    filled: list[dict[int, int]] = []
    for b in np.argsort(-sizes):
        for _ in range(int(left[b])):
            for i, free in enumerate(rooms):
                if free >= sizes[b]:
                    break
            else:
                i = len(rooms)
                rooms.append(room)
                filled.append({})
            rooms[i] -= int(sizes[b])
            filled[i][int(edges[b])] = filled[i].get(int(edges[b]), 0) + 1
    return out + [(f, 1) for f in filled]
