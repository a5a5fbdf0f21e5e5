"""Recursive graph bisection: an order of documents in which those that share terms lie close together."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Rounds of swaps at a node at most; it ends sooner where no swap helps.
ROUNDS = 12


@dataclass(frozen=True)
class Pairs:
    """The terms of documents, one document after another: terms[starts[d] : starts[d + 1]] are those of document d."""

    starts: np.ndarray
    terms: np.ndarray
    vocabulary: int

    def of(self, docs: np.ndarray) -> Pairs:
        """Those of some documents, without terms that only one of them has: where they lie changes no cost. Terms are numbered
        anew."""
        size = np.diff(self.starts)[docs]
        ends = np.cumsum(size)
        at = np.arange(int(size.sum())) + np.repeat(self.starts[docs] - (ends - size), size)
        terms = self.terms[at]
        often = np.bincount(terms, minlength=self.vocabulary) > 1
        number = np.cumsum(often) - 1
        keep = often[terms]
        kept = np.concatenate([[0], np.cumsum(keep)])
        return Pairs(kept[np.concatenate([[0], ends])], number[terms[keep]], int(often.sum()))

    def summed(self, values: np.ndarray) -> np.ndarray:
        """The sum of values over each document's terms."""
        total = np.concatenate([[0.0], np.cumsum(values[self.terms], dtype=np.float64)])
        return total[self.starts[1:]] - total[self.starts[:-1]]


def _cost(n: int, degree: np.ndarray) -> np.ndarray:
    """Bits, about, of the gaps of a term's list with this many of n documents."""
    return degree * np.log2(n / (degree + 1.0))


def _gains(nl: int, nr: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a term's lists lose in bits when one document with it goes from left to right, and from right to left."""
    now = _cost(nl, left) + _cost(nr, right)
    to_right = now - _cost(nl, np.maximum(left - 1, 0)) - _cost(nr, right + 1)
    to_left = now - _cost(nl, left + 1) - _cost(nr, np.maximum(right - 1, 0))
    return to_right, to_left


def split(pairs: Pairs, nl: int, rounds: int = ROUNDS) -> np.ndarray:
    """Which documents are on the right, all but nl of them: pairs are swapped while that saves bits."""
    n = len(pairs.starts) - 1
    right = np.zeros(n, bool)
    right[nl:] = True
    degree = np.bincount(pairs.terms, minlength=pairs.vocabulary)
    size = np.diff(pairs.starts)
    for _ in range(rounds):
        in_right = np.bincount(pairs.terms[np.repeat(right, size)], minlength=pairs.vocabulary)
        to_right, to_left = _gains(nl, n - nl, degree - in_right, in_right)
        gain = np.where(right, pairs.summed(to_left), pairs.summed(to_right))
        a, b = np.flatnonzero(~right), np.flatnonzero(right)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        swaps = int(np.count_nonzero(gain[a[:m]] + gain[b[:m]] > 1e-9))  # sums descend
        if not swaps:
            break
        right[a[:swaps]], right[b[:swaps]] = True, False
    return right


def order(pairs: Pairs, leaf: int, rounds: int = ROUNDS) -> np.ndarray:
    """Documents in the order of the bisection, down to parts of leaf documents: each leaf of them in the order, but the last, is a
    part."""
    out: list[np.ndarray] = []
    todo = [(np.arange(len(pairs.starts) - 1), pairs)]
    while todo:
        docs, own = todo.pop()
        if len(docs) <= leaf:
            out.append(docs)
            continue
        right = split(own, leaf * -(-(-(-len(docs) // leaf)) // 2), rounds)
        for side in (right, ~right):  # the left one is taken first
            at = np.flatnonzero(side)
            todo.append((docs[at], own.of(at)))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Router:
    """A bisection of sampled documents, applied to any: a document goes right at a node where the weights of its terms, which say
    how much rarer they are on the left, sum to over the node's bound. terms: sorted hashes; weights: nodes x terms, nodes
    as in a heap."""

    terms: np.ndarray
    weights: np.ndarray
    bounds: np.ndarray
    depth: int

    def clusters(self, starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The leaf, from 0, of each document."""
        n = len(starts) - 1
        node = np.zeros(n, np.int64)
        if self.depth and len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
            known = self.terms[at] == hashes
            at = at[known]
            edges = np.concatenate([[0], np.cumsum(known)])[starts]
            for _ in range(self.depth):
                weight = self.weights[np.repeat(node, np.diff(edges)), at]
                total = np.concatenate([[0.0], np.cumsum(weight, dtype=np.float64)])
                node = 2 * node + 1 + (total[edges[1:]] - total[edges[:-1]] > self.bounds[node])
            return node - ((1 << self.depth) - 1)
        return node


def fit_router(starts: np.ndarray, hashes: np.ndarray, depth: int) -> tuple[Router, np.ndarray]:
    """The router of sampled documents' term hashes, and how many terms of how many of them go to each leaf, in one array."""
    terms, number = np.unique(hashes, return_inverse=True)
    whole = Pairs(starts, number.astype(np.int64), len(terms))
    nodes = (1 << depth) - 1
    weights, bounds = np.zeros((max(1, nodes), len(terms)), np.float32), np.zeros(max(1, nodes))
    held = {0: np.arange(len(starts) - 1)}
    for node in range(nodes):
        docs = held[node]
        own = whole.of(docs)
        if len(docs) > 1:
            right = split(own, len(docs) - len(docs) // 2)
            size = np.diff(whole.starts)[docs]
            mine = Pairs(np.concatenate([[0], np.cumsum(size)]), whole.terms[np.arange(int(size.sum())) + np.repeat(whole.starts[docs] - (np.cumsum(size) - size), size)], len(terms))
            in_right = np.bincount(mine.terms[np.repeat(right, size)], minlength=len(terms))
            degree = np.bincount(mine.terms, minlength=len(terms))
            weights[node] = np.where(degree > 1, np.log2((in_right + 0.5) / (degree - in_right + 0.5)), 0.0)
            score = mine.summed(weights[node])
            bounds[node] = np.median(score)
            side = score > bounds[node]
        else:
            side = np.zeros(len(docs), bool)
        held[2 * node + 1], held[2 * node + 2] = docs[~side], docs[side]
    used = np.flatnonzero(np.any(weights != 0, axis=0))
    router = Router(terms[used], weights[:, used], bounds, depth)
    leaf = router.clusters(starts, hashes)
    return router, np.stack([np.bincount(leaf, weights=w, minlength=1 << depth) for w in (np.diff(starts), np.ones(len(leaf)))])
