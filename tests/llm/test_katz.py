"""The Katz model against a version of dictionaries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from folioloom.llm import katz

K = katz.KATZ_K


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w] + [None]


def discounts(n):
    tail = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    out = {}
    for r in range(1, K + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail != 1 else -1
        out[r] = d if 0 < d <= 1 else (r - 0.5) / r
    return lambda c: c * out.get(c, 1.0)


class Brute:
    def __init__(self, texts):
        self.c1, self.c2 = Counter(), Counter()
        for t in texts:
            before = 0
            for w in words(t):
                self.c1[w] += 1
                self.c2[before, w] += 1
                before = w
        n1, n2 = Counter(self.c1.values()), Counter(self.c2.values())
        d1, d2 = discounts(n1), discounts(n2)
        self.n, self.v = sum(self.c1.values()), len(self.c1)
        free = 1 - sum(d1(c) for c in self.c1.values()) / self.n
        seen = (lambda c: d1(c) / self.n) if free > 1e-12 else (lambda c: c / (self.n + 1))
        self.p1 = {w: seen(c) for w, c in self.c1.items()}
        unseen = max(1, n1[1] ** 2 / (2 * n1[2]) if n1[2] else n1[1] * (n1[1] - 1) / 2)
        self.unknown = (free if free > 1e-12 else 1 / (self.n + 1)) / unseen
        after = defaultdict(dict)
        for (h, w), c in self.c2.items():
            after[h][w] = c
        self.p2, self.bow = {}, {}
        for h, ws in after.items():
            total = sum(ws.values())
            left = 1 - sum(d2(c) for c in ws.values()) / total
            for w, c in ws.items():
                self.p2[h, w] = d2(c) / total if left > 1e-12 else c / (total + 1)
            left = left if left > 1e-12 else 1 / (total + 1)
            self.bow[h] = left / (1 - sum(self.p1[w] for w in ws))
            # exactly normalised over known words and the mass of unknown ones
            rest = 1 - sum(self.p1.values())
            mass = sum(self.p2.get((h, w), self.bow[h] * p) for w, p in self.p1.items()) + self.bow[h] * rest
            assert abs(mass - 1) < 1e-9

    def score(self, text):
        total = base = 0.0
        before = 0
        ws = words(text)
        for w in ws:
            p = self.p2.get((before, w)) or self.bow.get(before, 1.0) * self.p1.get(w, self.unknown)
            total += math.log10(p)
            base += math.log10((self.c1[w] + 1) / (self.n + self.v + 1))
            before = w
        return len(ws), sum(w in self.c1 for w in ws), base, total


@pytest.mark.parametrize(("shards", "hot"), [(4, katz.HOT), (16, 12), (4, 40)])
def test_against_dictionaries(spark, shards, hot):
    rng = random.Random(shards)
    vocabulary = ["the"] * 30 + ["Ab", "aB", "é"] + [f"w{int(rng.paretovariate(0.7))}" for _ in range(120)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for _ in range(260)] + [None, "", "  ", "x\ty\n\nZ", "the " * 3000]
    data = [(i, t, "en", 0.5) for i, t in enumerate(texts)] + [(None, "w1 w2 the", "en", 0.5), (5, texts[5], "en", 0.5)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, score double").repartition(3)
    brute = Brute([t for i, t, *_ in data if i is None or zlib.crc32(str(i).encode()) % 7 != 2])
    model = katz.fit(docs, shards, hot)
    assert len(model.hot.words) <= hot and len(model.hot.pairs) <= hot and len(model.hot.contexts) <= hot + 1
    assert (model.stats.n, model.stats.v) == (brute.n, brute.v)
    got = katz.score(docs, model).collect()
    assert len(got) == len(data)
    want = defaultdict(list)
    for i, t, *_ in data:
        want[i].append(brute.score(t))
    for r in got:
        n, known, base, total = want[r.doc_id][0]
        assert (r.n_tokens, r.n_known) == (n, known)
        assert abs(r.base_score - base) < 1e-6 * abs(base) + 1e-9 and abs(r.score - total) < 1e-6 * abs(total) + 1e-9


def test_empty_and_one(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = katz.fit(docs, 4)
    assert katz.score(docs, model).count() == 0
    r = katz.score(spark.createDataFrame([(2, "a a")], "doc_id long, text string"), model).first()
    assert (r.n_known, r.base_score) == (0, 0.0)  # nothing learnt
    one = spark.createDataFrame([(2, "a a")], "doc_id long, text string")
    r = katz.score(one, katz.fit(one, 4)).first()
    assert r.n_tokens == 3 and r.score < 0


def test_blobs():
    import numpy as np

    a = [np.arange(5, dtype=np.uint64), np.array([], np.uint32), np.array([1.5, -2.0]), np.array([3, 300], np.uint16)]
    assert all((x == y).all() and x.dtype == y.dtype for x, y in zip(katz.load(katz.dump(*a)), a))
