"""The Kneser-Ney model against one of dictionaries, both ways of scoring, and the thresholds."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioloom.llm import quality


class Brute:
    """Interpolated modified Kneser-Ney over characters, by dictionaries of strings; a tab opens and a newline ends a text."""

    def __init__(self, texts, order):
        self.order = order
        counts = [Counter() for _ in range(order + 1)]
        for t in filter(None, map(self.spell, texts)):
            for k in range(1, order + 1):
                for i in range(max(1, k - 1), len(t)):
                    counts[k][t[i - k + 1 : i + 1]] += 1
        self.share, self.weight = [None] * (order + 1), [None] * (order + 1)
        for k in range(1, order + 1):
            left = Counter(g[1:] for g in counts[k + 1]) if k < order else {}
            a = {g: c if k == order or (k > 1 and g[0] == "\t") else left.get(g, c) for g, c in counts[k].items()}
            n = [sum(v == r for v in a.values()) for r in range(5)]
            d = (0.5, 1.0, 1.5)
            if all(n[1:]):
                y = n[1] / (n[1] + 2 * n[2])
                d_ = tuple(r - (r + 1) * y * n[r + 1] / n[r] for r in (1, 2, 3))
                d = d_ if all(0 < x < i for i, x in enumerate(d_, 1)) else d
            total, freed = defaultdict(float), defaultdict(float)
            for g, v in a.items():
                total[g[:-1]] += v
                freed[g[:-1]] += d[min(v, 3) - 1]
            self.share[k] = {g: (v - d[min(v, 3) - 1]) / total[g[:-1]] for g, v in a.items()}
            self.weight[k] = {h: freed[h] / total[h] for h in total}
        self.uniform = 1 / (len(self.share[1]) + 1)

    @staticmethod
    def spell(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        return "\t" + " ".join(words) + "\n" if words else ""

    def p(self, before, c):
        p = self.uniform
        for k in range(1, min(self.order, len(before) + 1) + 1):
            h = before[len(before) - k + 1 :]
            p = self.share[k].get(h + c, 0.0) + self.weight[k].get(h, 1.0) * p
        return p

    def score(self, text):
        t = self.spell(text)
        return -sum(math.log(self.p(t[max(0, i - self.order + 1) : i], t[i])) for i in range(1, len(t))) / (len(t) - 1) if t else None


def corpus(spark, n=200, seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "hé"]) for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(30, 60))]
        words[0] = words[0].capitalize()  # usual at the start of a text, not after a space
        if i % 9 == 1:
            words = [w.upper() + "%%%$$" for w in words]
        if i % 9 == 2:
            words = [words[0]] * 60
        rows.append((i, "  ".join(words), "en" if i % 2 else "de", "mine"))
        if i < n - 60:
            labels.append((i, int(i % 9 not in (1, 2)), 0))
    rows += [(900, None, None, "x"), (901, "", "en", "x"), (901, " \n ", "en", "x"), (None, "th er on", "fr", "x"), (902, "th er on " * 20000, "en", "x"), (903, "th er on", "en", "x"), (904, "th er on", "en", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, keep string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_against_dictionaries(spark, order):
    docs, labels, rows, good = corpus(spark)
    ids = {r["_id"] for r in quality.trusted_ids(labels, 2000).collect()}
    assert ids < {i for i, q, _ in good if q}
    brute = Brute([t for i, t, *_ in rows if i in ids], order)
    want = sorted((brute.score(t) or -1.0) for _, t, *_ in rows)
    for entries in (10**9, 0):  # held by tasks, and joined
        scored = quality.scorer(docs, labels, 2000, order, entries)(docs)
        got = sorted((-1.0 if r.log_perplexity is None else r.log_perplexity) for r in scored.collect())
        assert np.allclose(got, want, rtol=0, atol=1e-9)
    for before in ("\t", "\tth", "her", "an on", "zz", "er "):
        assert sum(brute.p(before, c) for c in brute.share[1]) + brute.p(before, "一") == pytest.approx(1, abs=1e-9)


def test_memory_with_few_slots(spark):
    docs, labels, *_ = corpus(spark, 80)
    shares, weights = quality.fit_tables(quality.trusted(docs, labels, 2000), 3)
    model = quality.load(shares, weights, 3)
    raw = "the on an er THE\nзмея 蛇 the on".encode()
    codes, _ = quality.spelled(np.frombuffer(raw * 30, np.uint8), np.array([0, len(raw), len(raw), len(raw) * 30]))
    g, place = quality.grams(codes, 3)
    want = np.zeros(len(codes))
    want[place > 0] = model.log_p(g, place, np.flatnonzero(place > 0))
    for slots in (1, 4, 1 << 12):
        memory = quality.Memory(model, slots)
        assert all(np.allclose(memory(codes), want, atol=1e-12) for _ in range(3))


def test_held_out_documents(spark):
    docs, labels, *_ = corpus(spark)
    got = quality.classify(docs, labels, low=0.0, high=1.0, keep="kept").collect()
    assert {r.keep for r in got} == {"mine", "x"} and len(got) == docs.count()
    held = [r for r in got if r.doc_id is not None and 140 <= r.doc_id < 200]
    assert not any(r.kept for r in held if r.doc_id % 9 in (1, 2))
    good = [r.kept for r in held if r.doc_id % 9 not in (1, 2)]
    assert sum(good) >= 0.9 * len(good)  # bounds are the extremes of the labelled ones
    for r in got:
        if r.doc_id in (900, 901):
            assert r.kept is False and r.log_perplexity is None
    assert len({(r.log_perplexity, r.kept) for r in got if r.doc_id in (903, 904)}) == 1
    clash = quality.classify(docs.withColumn("log_perplexity", F.lit("old")), labels)
    assert clash.columns == ["doc_id", "text", "lang", "log_perplexity", "keep"] and dict(clash.dtypes)["keep"] == "boolean"
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert all(r.keep == (r.log_perplexity is not None) for r in quality.classify(docs, labels.limit(0)).collect())


def test_the_model_learns_from_all_trusted_documents(spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6000)], "doc_id long, quality int, toxic int")
    docs = spark.range(6000).selectExpr("id as doc_id", "'a' as text")
    half = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).count()
    assert quality.trusted(docs, labels).count() == half > 2000
