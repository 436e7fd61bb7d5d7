"""A search for whole numbers of groups that bring every metric of a split within rounding of its share.

The search works on a table of strata alone (groups that are alike in size and class counts), a bounded part of it at a time.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable

import numpy as np

#: Differences of a metric that one round of the search looks at, at most.
_WORK = 12_000_000
#: Allocations that are listed one by one, at most.
_LISTED = 200_000


def limits(totals: dict[str, int]) -> dict[str, tuple[int, int]]:
    """The least and most of each metric in train: 7 tenths rounded down and up, but (7 * images + 5) div 10 images."""
    out = {m: (7 * n // 10, -(-7 * n // 10)) for m, n in totals.items()}
    if "images" in totals:
        out["images"] = ((7 * totals["images"] + 5) // 10,) * 2
    return out


def _misses(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.maximum(low - values, 0).sum(-1) + np.maximum(values - high, 0).sum(-1)


def listed(amounts: np.ndarray, rooms: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray | None:
    """The change with the fewest groups moved that meets all limits, by trying every allocation; None if there is none. rooms: least and most change of each stratum."""
    every = np.array(list(itertools.product(*[range(a, b + 1) for a, b in rooms])), dtype=np.int64).reshape(-1, len(rooms))
    good = every[_misses(start + every @ amounts, low, high) == 0]
    return good[np.abs(good).sum(1).argmin()] if len(good) else None


def repaired(amounts: np.ndarray, rooms: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int = 0, rounds: int = 2000) -> tuple[np.ndarray, int]:
    """(change of each stratum's groups in train, what the metrics then miss in all; 0: all limits are met).

    amounts: of each metric in a group of the stratum; start: the metrics' values in train; rooms: how many groups may leave and
    enter train. Each round takes the best exchange of two groups (in, out, or one for another), as often as it helps; where none helps,
    it takes a random one among the least bad. Few enough allocations are all listed, so that a miss is then proven.
    """
    change, draw = np.zeros(len(amounts), dtype=np.int64), np.random.default_rng(seed)
    if not len(amounts) or not _misses(start, low, high):
        return change, int(_misses(start, low, high))
    if np.log((rooms[:, 1] - rooms[:, 0] + 1).astype(float)).sum() <= np.log(max(_LISTED, 0.5)):
        found = listed(amounts, rooms, start, low, high)
        return (found, 0) if found is not None else (change, int(_misses(start, low, high)))
    at, best, best_change = start.astype(np.int64), int(_misses(start, low, high)), change.copy()
    most = max(int((_WORK / amounts.shape[1]) ** 0.5 / 2), 2)
    for _ in range(rounds):
        into, out = np.flatnonzero(change < rooms[:, 1]), np.flatnonzero(change > rooms[:, 0])
        into, out = (draw.choice(x, most, replace=False) if len(x) > most else x for x in (into, out))
        who = np.concatenate((into, out, [-1]))
        step = np.concatenate((np.ones(len(into), dtype=np.int64), -np.ones(len(out), dtype=np.int64), [0]))
        moves = np.where(who[:, None] >= 0, amounts[who], 0) * step[:, None]
        cost = _misses(at + moves[:, None] + moves[None, :], low, high)
        # the same group can't move twice if there is one left; both ways it stays
        same = np.flatnonzero((who >= 0) & np.where(step > 0, change[who] + 2 > rooms[who, 1], change[who] - 2 < rooms[who, 0]))
        cost[same, same] = np.iinfo(np.int64).max
        cost[-1, -1] = np.iinfo(np.int64).max
        now = int(_misses(at, low, high))
        k = int(cost.argmin())
        if cost.flat[k] >= now:  # nowhere better: a random step among the best few
            few = np.argpartition(cost, min(64, cost.size - 1), axis=None)[:64]
            k = int(draw.choice(few[cost.flat[few] < np.iinfo(np.int64).max]))
        pair = [i for i in divmod(k, len(who)) if who[i] >= 0]
        times = 1
        if cost.flat[k] < now:
            delta = sum(moves[i] for i in pair)
            room = min(int(rooms[who[i], 1] - change[who[i]] if step[i] > 0 else change[who[i]] - rooms[who[i], 0]) // len(pair) for i in pair)
            while 2 * times <= room and _misses(at + 2 * times * delta, low, high) < _misses(at + times * delta, low, high):
                times *= 2
        for i in pair:
            change[who[i]] += times * step[i]
            at = at + times * moves[i]
        missed = int(_misses(at, low, high))
        if missed < best:
            best, best_change = missed, change.copy()
        if not best:
            break
    return best_change, best


def parsed(vector: str) -> dict[str, int]:
    """Boxes by class of a vector (`class:boxes`, comma-joined)."""
    return {k: int(n) for k, _, n in (p.partition(":") for p in vector.split(",") if p)}


def metrics_of(size: int, vector: str) -> dict[str, int]:
    """What one group of so many equal images counts in each metric."""
    out = {"images": size}
    if not vector:
        out["background_images"] = size
    for k, n in parsed(vector).items():
        out |= {f"class_{k}_images": size, f"class_{k}_boxes": size * n}
    return out


def balance(strata: Iterable[tuple[int, str, int, int]], totals: dict[str, int], train: dict[str, int], seed: int = 0) -> tuple[list[tuple[int, str, int]], int]:
    """(size, vector, change) of the strata that change, and what is still missed.

    strata: (size, vector, groups, groups in train), all or a part; totals and train: each metric over all strata.
    """
    rows, names = list(strata), sorted(totals)
    place = {m: k for k, m in enumerate(names)}
    amounts = np.zeros((len(rows), len(names)), dtype=np.int64)
    for k, (size, vector, *_) in enumerate(rows):
        for m, n in metrics_of(size, vector).items():
            amounts[k, place[m]] = n
    bounds = limits(totals)
    low, high = (np.array([bounds[m][k] for m in names], dtype=np.int64) for k in (0, 1))
    rooms = np.array([(-inside, n - inside) for _, _, n, inside in rows], dtype=np.int64).reshape(-1, 2)
    change, missed = repaired(amounts, rooms, np.array([train.get(m, 0) for m in names], dtype=np.int64), low, high, seed)
    return [(size, vector, int(c)) for (size, vector, *_), c in zip(rows, change, strict=True) if c], missed
