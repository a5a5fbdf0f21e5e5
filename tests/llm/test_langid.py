"""Language filters against sets and dictionaries."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioloom.llm import langid

WORDS = {"en": "the and of with house river", "de": "der und von mit haus fluss", "fr": "le et de avec maison rivière", "el": "και το σπίτι ποτάμι με από"}


def documents(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        own = WORDS[lang].split()
        text = " ".join(rng.choice(own).title() if rng.random() < 0.2 else rng.choice(own) for _ in range(rng.randint(3, 40)))
        out.append((i, text + rng.choice(["", "!", " 12, 7", "\n\n--"]), lang))
    return out


def brute_grams(text, width):
    out = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    out = " " + " ".join(out.split()) + " "
    if not out.strip():
        return []
    out += " " * (width - len(out))
    return [out[i : i + width] for i in range(len(out) - width + 1)]


def brute_sets(rows, width, ratio, floor):
    docs, seen = Counter(), {}
    for _, text, lang in rows:
        if text is not None and lang is not None:
            docs[lang] += 1
            for g in set(brute_grams(text, width)):
                seen.setdefault(g, Counter())[lang] += 1
    sets = {lang: set() for lang in docs}
    for g, c in seen.items():
        best = max((n / docs[lang] for lang, n in c.items() if n > 1), default=0)
        for lang, n in c.items():
            if n > 1 and n / docs[lang] >= max(ratio * best, floor):
                sets[lang].add(g)
    return sorted(docs, key=lambda x: (-docs[x], x)), sets


ODD = [(900, None, "en"), (901, "", "en"), (902, "12 - 7!", "de"), (903, "the river", None), (904, "x", "fr"), (None, "der fluss", "de"), (905, "the " * 50_000, "en")]


@pytest.mark.parametrize("width", [3, 4])
def test_counts_equal_sets(spark, width):
    rows = documents(300, width) + ODD + documents(5, 1) * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    filters = langid.fit(df, width=width, floor=0.01, slots_per_gram=4096, hashes=6)  # so that nothing is a false positive
    languages, sets = brute_sets(rows, width, langid.RATIO, 0.01)
    assert filters.languages == languages
    texts = [r[1] or "" for r in rows]
    counts, n = filters.popcounts(texts)
    for i, t in enumerate(texts):
        own = brute_grams(t, width)
        assert n[i] == len(own)
        assert counts[i].tolist() == [sum(g in sets[lang] for g in own) for lang in languages]
    got = langid.predict(df.select("*", F.lit(1).alias("langs"), F.lit("x").alias("Score")), filters)
    assert got.columns == ["doc_id", "text", "lang", "langs", "lang_pred", "score"]
    for r in got.collect():
        own = brute_grams(r.text, width)
        c = [sum(g in sets[lang] for g in own) for lang in languages]
        assert r.lang_pred == (languages[int(np.argmax(c))] if own else "und")
        assert r.score == pytest.approx(max(c) / sum(c) if sum(c) else 0.0, abs=1e-6)


def test_false_positives_are_taken_off():
    """A filter that holds nearly everything by chance doesn't win by that."""
    rng = np.random.default_rng(1)
    words = (rng.random(langid.SLICE) < 0.9).astype(np.uint8) * 2  # all of it chance, of language 1
    found, _ = langid.grams(["the house of the river"])
    for k in range(2):
        words[langid._slots(found[: len(found) // 2], k, langid.SLICE - 1)] |= 1
    f = langid.Filters(["a", "b"], [words], np.array([np.mean(words & 1 > 0) ** 2, np.mean(words & 2 > 0) ** 2]), langid.WIDTH, 2)
    counts, _ = f.popcounts(["the house of the river"])
    assert counts[0, 1] > counts[0, 0]
    assert f.decide(["the house of the river"])[0] == ["a"]


def test_many_languages_and_no_room(spark):
    """Over 64 languages lie in several words; with few bytes the floor rises and filters still decide."""
    rng = random.Random(2)
    rows = []
    for k in range(70):
        letters = [chr(0x4E00 + 20 * k + j) for j in range(20)]
        rows += [(len(rows) + i, " ".join("".join(rng.choices(letters, k=3)) for _ in range(30)), f"l{k:02}") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.fit(df, width=2)
    assert len(filters.words) == 2
    right = [r.lang == r.lang_pred for r in langid.predict(df, filters).collect()]
    assert np.mean(right) > 0.95
    small = langid.fit(spark.createDataFrame(documents(200, 7), "doc_id long, text string, lang string"), most_bytes=1)
    assert small.words[0].nbytes <= langid.SLICE * 8
    assert small.decide(["the house and the river"])[0] == ["en"]


def test_query_learns_only_from_the_rest(spark, tmp_path):
    rows = [(i, t, lang) for i, t, lang in documents(400, 11)] + ODD
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    rows = [(i, t, "xx" if held(i) else lang) for i, t, lang in rows]  # labels of held out documents are wrong, and not seen
    schema = "doc_id long, text string, lang string"
    spark.createDataFrame(rows, schema).select("*", F.lit("a").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in langid.op12(spark, str(tmp_path)).collect()}
    assert len(got) == len({r[0] for r in rows})
    truth = {i: lang for i, _, lang in documents(400, 11)}
    assert all(r.held_out == held(i) for i, r in got.items())
    assert np.mean([r.lang_pred == truth[i] for i, r in got.items() if i in truth and r.held_out]) > 0.98
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"} and got[900].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert langid.op12(spark, str(tmp_path)).count() == 0
    none = langid.fit(spark.createDataFrame([], "text string, lang string"))
    assert none.decide(["a b"])[0] == ["und"]
