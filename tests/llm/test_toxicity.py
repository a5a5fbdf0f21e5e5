"""The classifier chain against loops over dictionaries."""

import math
import random
import re
from collections import Counter

import numpy as np

from folioloom.llm import toxicity, utf8


def features(text):
    """Words, lower-cased A-Z, and their first 4 to 8 bytes."""
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return {w[:n] for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", raw) for n in (*toxicity.STEMS, len(w))}


def hashed(word):
    raw = np.frombuffer(word, np.uint8)
    return int(utf8.hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def corpus(spark, n=300):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["ba", "ce", "di", "fo", "gü"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 40))]
        if i % 4 == 0:
            words.insert(2, rng.choice(["Zorro", "zorrito", "KWXY", "kwxyz"]))
        rows.append((i, " ".join(words), "x"))
        if i < n - 80:
            labels.append((i, 1, int(i % 4 == 0)))
    rows += [(900, None, "x"), (901, "", "x"), (0, rows[0][1], "x"), (None, "zorro", "x"), (902, "zorro " + "ba ce " * 20000, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, flag string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def test_against_dictionaries(spark):
    docs, labels, rows, marks = corpus(spark)
    chain = toxicity.fit(docs, labels, features=40)
    toxic, text = {i: t for i, _, t in marks}, {i: t for i, t, _ in rows if i is not None}
    taught = {}
    for i, t in toxic.items():  # copies teach once
        taught.setdefault((text[i], t), features(text[i]))
    n1, n0 = (sum(t == k for _, t in taught) for k in (1, 0))
    a, b = Counter(), Counter()
    for (_, t), fs in taught.items():
        (a if t else b).update(fs)
    chi = {}
    for f in {*a, *b}:
        if a[f] + b[f] >= 6:
            c = (a[f] * n0 - b[f] * n1) ** 2 / ((a[f] + b[f]) * (n1 + n0 - a[f] - b[f] + 1))
            if c * (n1 + n0) >= 10.83 * n1 * n0:
                chi[hashed(f)] = c
    want = sorted(chi, key=lambda h: (-chi[h], np.uint64(h).view(np.int64)))[:40]
    assert chain.words.tolist() == sorted(want)
    weight = [(name, dict(zip(chain.words.tolist(), w.tolist())), w[len(chain.words) :].tolist()) for name, w in chain.links]

    def judge(t):
        own, odds = {hashed(f) for f in features(t)}, []
        for _, by, rest in weight:
            z = sum(v for h, v in by.items() if h in own) + rest[-1] + sum(x * y for x, y in zip(rest, odds))
            odds.append(max(-6.0, min(6.0, z)))
        return 1 / (1 + math.exp(-z))

    got = toxicity.classify(docs, chain, "q_", "bad").collect()
    assert len(got) == len(rows) and {r.flag for r in got} == {"x"}
    for r in got:
        p = judge(r.text)
        assert abs(r.q_toxic - p) < 1e-9 and r.bad == (p >= chain.threshold)
    held = [r for r in got if r.doc_id is not None and 220 <= r.doc_id < 300]
    assert all(r.bad == (r.doc_id % 4 == 0) for r in held)
    assert {r.doc_id: r.bad for r in got if r.doc_id in (900, 901, 902)} == {900: False, 901: False, 902: True}


def test_logistic_minimises():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (300, 6)).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [2, -1, 0, 1, 0, 0] - 1)))).astype(float)
    w = toxicity.logistic(x, y, l2=0.5, rounds=400)
    xb = np.c_[x, np.ones(300)]
    best, shrink = np.zeros(7), np.r_[np.full(6, 0.5), 1e-6]
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-xb @ best))
        best -= np.linalg.solve((xb * (p * (1 - p))[:, None]).T @ xb + np.diag(shrink), xb.T @ (p - y) + shrink * best)
    assert np.allclose(w, best, atol=1e-2)


def test_threshold_holds_at_the_true_share():
    rng = np.random.default_rng(2)
    y = np.r_[np.ones(500), np.zeros(500)]
    x = (rng.random((1000, 3)) < np.where(y[:, None] > 0, 0.6, 0.1)).astype(float)
    fold = rng.integers(0, 5, 1000)
    even, rare = (toxicity.fit_chain(x, {"toxic": y}, fold, np.arange(3, dtype=np.uint64), 0.9, s).threshold for s in (0.5, 0.05))
    assert rare > even


def test_kinds_are_whole():
    x = np.kron(np.eye(3), np.ones((5, 4)))
    got = toxicity.kinds(x, 3)
    assert [len(set(got[k * 5 : k * 5 + 5].tolist())) for k in range(3)] == [1, 1, 1] and len(set(got.tolist())) == 3
    assert toxicity.kinds(np.zeros((0, 4)), 3).tolist() == [] and len(toxicity.kinds(np.ones((1, 2)), 3)) == 1
