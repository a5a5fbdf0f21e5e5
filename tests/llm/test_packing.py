"""The assignment of documents to sequences against a search of all sequences for each document."""

import numpy as np

from folioloom.llm.packing import assign


def slow(lengths, capacity):
    bins, todo = [], []
    for d in sorted(range(len(lengths)), key=lambda d: -lengths[d]):
        n, at = lengths[d], 0
        while n - at >= capacity:
            bins.append([(d, at, capacity)])
            at += capacity
        if n > at:
            todo.append((n - at, d, at))
    todo.sort(key=lambda x: (-x[0], x[1]))
    first = len(bins)
    count = -(-(sum(lengths) - first * capacity) // capacity)
    room, cost = [capacity] * count, [0.0] * count
    bins += [[] for _ in range(count)]
    for n, d, at in todo:
        while n:
            fit = [k for k in range(count) if room[k] >= n] or [k for k in range(count) if room[k]]
            k = min(fit, key=lambda k: (cost[k], k))
            own = min(n, room[k])
            bins[first + k].append((d, at, own))
            room[k] -= own
            cost[k] += own + own * own / 4096
            n, at = n - own, at + own
    return bins


def test_lowest_cost_with_room():
    rng = np.random.default_rng(2)
    for _ in range(40):
        lengths = rng.integers(1, rng.integers(2, 150), rng.integers(0, 120)).tolist()
        capacity = int(rng.integers(3, 80))
        assert assign(np.array(lengths, np.int64), capacity)[0] == slow(lengths, capacity)


def test_no_avoidable_cut_and_little_padding():
    lengths = np.maximum(1, np.random.default_rng(3).lognormal(5, 1.2, 20_000)).astype(int)
    bins, _ = assign(lengths, 2048)
    assert len(bins) == -(-lengths.sum() // 2048) and max(sum(n for *_, n in b) for b in bins) <= 2048
