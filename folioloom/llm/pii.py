"""Personal data spans: high-recall generators, boosted trees over format and context, calibrated thresholds. SQL functions only."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.cluster import table, texts

KINDS = ("email", "ip", "card", "phone")

#: The contract's patterns, written so that each start is tried once and no repetition can be undone: a run of the first
#: class is entered at its head or where the match before ended, as no later start in it could match where the head fails.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Generators of what the base patterns miss, one a kind; wide on purpose, the trees choose. Bounded repetitions only.
WIDE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9][a-z0-9._%+-]{0,63}(?:\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20|@\x20)[a-z0-9-]{1,63}(?:(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20|\.)[a-z0-9-]{1,63}){1,4}",
    "ip": r"(?i)(?<![0-9a-z:.])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-z:])|(?<![0-9.])[0-9]{1,3}(?:\x20?[\[(]\.[\])]\x20?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9A-Za-z.+-])[0-9]{4}(?:[./_\x20-]{1,3}[0-9]{4}){2}[./_\x20-]{1,3}[0-9]{2,7}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.+-])(?:00[1-9][0-9]{0,2}[\x20.-])?(?:\([0-9]{2,4}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3,4}[.\x20-][0-9]{4}(?![0-9A-Za-z.-]*[0-9])",
}

#: Context words before a span that tell its kind (fixed values).
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|correo|courriel|kontakt)[^0-9]{0,12}$",
    "ip": r"(?i)(?:\bip|address|host|server|adresse)[^0-9]{0,12}$",
    "card": r"(?i)(?:card|visa|credit|payment|karte|carte|tarjeta)[^0-9]{0,12}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|cell|handy|telefon)[^0-9]{0,12}$",
}
AGAINST = r"(?i)(?:version|isbn|issn|invoice|order|serial|total|part|pages?|no)[^0-9A-Za-z]{0,4}$"

CONTEXT = 24

FEATURES = ("digits", "length", "separators", "one_separator", "cue", "against", "word_before", "word_after", "opens_zero", "luhn", "kind_email", "kind_ip", "kind_card", "kind_phone")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check: every second digit from the right doubled, nines cast out."""
    d = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c,
        i: F.when(i % 2 == 0, F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0))).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)) + 1)),
    )
    return (F.length(digits) > 0) & (F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10 == 0)


def valid(kind: str, s: Column) -> Column:
    """The contract's check of a base match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(s)).between(14, 19) & luhn(_digits(s))
    return F.length(_digits(s)).between(10, 15)


def scanned(values: Column, start: Column, following: Callable[[Column, Column], Column], given: Callable[[Column, Column], Column], kind: str, block: int = 256) -> Column:
    """array<kind>: what given(state, value), an array, has for each of values one after another, the state being start, then
    following(state, value). Folds append to arrays of a block only, whose arrays are joined at the end, so that the work
    grows with the values and not with their square."""
    none, nothing = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    step = lambda a, x: F.struct(following(a.s, x).alias("s"), F.concat(a.o, given(a.s, x)).alias("o"))

    def add(acc: Column, b: Column) -> Column:
        return F.aggregate(b, F.struct(acc.s.alias("s"), none.alias("o")), step, lambda r: F.struct(r.s.alias("s"), F.concat(acc.o, F.array(r.o)).alias("o")))

    def scan(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / block).cast("int"))
        blocks = F.transform(numbers, lambda k: F.slice(v, k * block + 1, block))
        return F.flatten(F.aggregate(blocks, F.struct(start.alias("s"), nothing.alias("o")), add, lambda a: a.o))

    return F.element_at(F.transform(F.array(values), scan), 1)  # values, bound to a name, are found once and not once a block


def located(text: Column, pattern: str) -> Column:
    """array<struct<s:int, m:string>>: each match of pattern, leftmost and not overlapping, and where it starts in code
    points, from the lengths of what lies between matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    pairs = F.zip_with(found, F.slice(gaps, 1, F.greatest(F.size(found), F.lit(1))), lambda m, g: F.struct(m.alias("m"), g.alias("gap")))
    pairs = F.filter(pairs, lambda x: x.m.isNotNull())
    kind = "struct<s:int,m:string>"
    start = lambda at, x: F.array(F.struct((at + x.gap).alias("s"), x.m.alias("m")).cast(kind))
    many = scanned(pairs, F.lit(0), lambda at, x: at + x.gap + F.length(x.m), start, kind)
    return F.when(F.size(found) > 0, many).otherwise(F.array().cast(f"array<{kind}>"))


def features(kind: Column, m: Column, before: Column, after: Column) -> dict[str, Column]:
    """FEATURES of a candidate m of a kind with CONTEXT characters on either side."""
    digits = _digits(m)
    separators = F.regexp_replace(m, "[0-9A-Za-z]", "")
    cue = F.lit(False)
    for k in KINDS:
        cue = F.when(kind == k, before.rlike(CUES[k])).otherwise(cue)
    number = lambda c: c.cast("double")
    return {
        "digits": number(F.length(digits)),
        "length": number(F.length(m)),
        "separators": number(F.length(separators)),
        "one_separator": number(F.size(F.array_distinct(F.split(separators, ""))) <= 1),
        "cue": number(cue),
        "against": number(before.rlike(AGAINST)),
        "word_before": number(before.rlike(r"[A-Za-z]\x20$")),
        "word_after": number(after.rlike(r"^\x20[A-Za-z]")),
        "opens_zero": number(m.startswith("0")),
        "luhn": number(luhn(digits)),
        **{f"kind_{k}": number(kind == k) for k in KINDS},
    }


def examples(n: int = 1600, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """Labelled candidates (kind, match, before, after, personal), made by rule: for each kind personal forms and look-alikes
    (version numbers, dates, measures, order numbers), with and without telling context, some labels untold by form."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abdefghilmnoprstu") for _ in range(rng.randint(3, 9)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    cue = {"email": ["email: ", "contact ", "mail me: "], "ip": ["ip ", "server ", "host: "], "card": ["card ", "visa: ", "credit card no. "], "phone": ["phone ", "call ", "tel: "]}
    bad = ["version ", "order ", "invoice ", "isbn ", "serial ", "total ", "pages "]

    def card() -> str:
        d = num(15)
        s = sum(int(c) if i % 2 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(d))
        return d + str(-s % 10)

    out = []
    for _ in range(n):
        kind, yes = rng.choice(KINDS), rng.random() < 0.5
        sep = rng.choice([" ", "-", ".", "  "])
        if kind == "email":
            m = f"{word()} at {word()} dot com" if rng.random() < 0.5 else f"{word()}[at]{word()}[dot]org"
            if not yes:
                m = f"{word()} at {word()}.{word()}"
        elif kind == "ip":
            m = ":".join("".join(rng.choice("0123456789abcdef") for _ in range(4)) for _ in range(8)) if rng.random() < 0.5 else "[.]".join(str(rng.randint(1, 255)) for _ in range(4))
            if not yes:
                m = "[.]".join(str(rng.randint(0, 9)) for _ in range(4))
        elif kind == "card":
            d = card() if yes else num(16)
            m = sep.join(d[i : i + 4] for i in range(0, 16, 4))
        else:
            m = rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}{sep[0]}{num(3)}{sep[0]}{num(4)}"])
        hint = rng.random()
        before = rng.choice(cue[kind]) if (yes and hint < 0.8) else rng.choice(bad) if (not yes and hint < 0.6) else word() + " "
        after = " " + word() if rng.random() < 0.7 else ". "
        out.append((kind, m, (word() + " " + before)[-CONTEXT:], after, int(yes)))
    return out


def boost(rows: list[tuple[list[float], int]], rounds: int = 40, rate: float = 0.3, most_cuts: int = 12) -> list[tuple[float, tuple]]:
    """Gradient boosting of logistic loss by trees of depth two: [(rate, tree)], a tree (feature, cut, (feature, cut, low,
    high) twice)."""
    x, y = [r for r, _ in rows], [t for _, t in rows]
    n, width = len(rows), len(x[0]) if rows else 0
    cuts = []
    for f in range(width):
        values = sorted({r[f] for r in x})
        mids = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
        cuts.append(mids if len(mids) <= most_cuts else [mids[i * len(mids) // most_cuts] for i in range(most_cuts)])
    score, trees = [0.0] * n, []

    def leaf(members: list[int], g: list[float], h: list[float]) -> float:
        return sum(g[i] for i in members) / (sum(h[i] for i in members) + 1.0)

    def best(members: list[int], g: list[float], h: list[float]) -> tuple[int, float, list[int], list[int]] | None:
        all_g, all_h = sum(g[i] for i in members), sum(h[i] for i in members)
        top, found = all_g * all_g / (all_h + 1) + 1e-9, None
        for f in range(width):
            for c in cuts[f]:
                gl = hl = 0.0
                for i in members:
                    if x[i][f] < c:
                        gl += g[i]
                        hl += h[i]
                gain = gl * gl / (hl + 1) + (all_g - gl) ** 2 / (all_h - hl + 1)
                if gain > top:
                    top, found = gain, (f, c)
        if found is None:
            return None
        f, c = found
        return f, c, [i for i in members if x[i][f] < c], [i for i in members if x[i][f] >= c]

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g, h = [t - q for t, q in zip(y, p, strict=True)], [q * (1 - q) for q in p]
        root = best(list(range(n)), g, h)
        if root is None:
            break
        sides = []
        for members in root[2:]:
            split = best(members, g, h) if len(members) > 20 else None
            if split is None:
                v = leaf(members, g, h)
                sides.append((0, 0.0, v, v))
            else:
                sides.append((split[0], split[1], leaf(split[2], g, h), leaf(split[3], g, h)))
        tree = (root[0], root[1], *sides)
        trees.append((rate, tree))
        for i in range(n):
            f, c, low, high = sides[0] if x[i][root[0]] < root[1] else sides[1]
            score[i] += rate * (low if x[i][f] < c else high)
    return trees


def raw_score(trees: list[tuple[float, tuple]], row: list[float]) -> float:
    total = 0.0
    for rate, (f, c, low, high) in trees:
        g, d, a, b = low if row[f] < c else high
        total += rate * (a if row[g] < d else b)
    return total


def calibrate(scores: list[float], labels: list[int], precision: float) -> float:
    """The least score from which on at least `precision` of the held-out examples are personal; infinite if none."""
    order = sorted(zip(scores, labels, strict=True), reverse=True)
    good, threshold = 0, math.inf
    for k, (s, t) in enumerate(order):
        good += t
        if (k + 1 == len(order) or order[k + 1][0] < s) and good >= precision * (k + 1) and k >= 9:
            threshold = s
    return threshold


def fit(spark: SparkSession, n: int = 1600, precision: float = 0.97) -> tuple[list[tuple[float, tuple]], dict[str, float]]:
    """(trees, threshold of each kind) from examples(n), a bounded set made by rule: two thirds grow the trees, one third
    calibrates the thresholds. The features come from the same columns as in detection."""
    return _fit(spark, n, precision)


@lru_cache(maxsize=4)
def _fit(spark: SparkSession, n: int, precision: float) -> tuple[list[tuple[float, tuple]], dict[str, float]]:
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = examples(n)
    values = ", ".join(f"({i}, {quoted(k)}, {quoted(m)}, {quoted(b)}, {quoted(a)}, {y})" for i, (k, m, b, a, y) in enumerate(rows))
    made = spark.sql(f"SELECT * FROM VALUES {values} AS t(i, kind, m, b, a, y)")
    got = made.select("i", "kind", "y", *[c.alias(k) for k, c in features(F.col("kind"), F.col("m"), F.col("b"), F.col("a")).items()]).collect()
    got = sorted(got, key=lambda r: r.i)
    data = [([float(r[f]) for f in FEATURES], r.y) for r in got]
    trees = boost([d for i, d in enumerate(data) if i % 3])
    held = [(r.kind, raw_score(trees, d[0]), d[1]) for i, (r, d) in enumerate(zip(got, data, strict=True)) if i % 3 == 0]
    return trees, {k: calibrate([s for kk, s, _ in held if kk == k], [y for kk, _, y in held if kk == k], precision) for k in KINDS}


def tree_score(trees: list[tuple[float, tuple]], f: dict[str, Column]) -> Column:
    """The boosted score as nested conditions over the features."""
    cols = [f[k] for k in FEATURES]
    total = F.lit(0.0)
    for rate, (g, c, low, high) in trees:
        side = lambda s: F.lit(rate * s[2]) if s[2] == s[3] else F.when(cols[s[0]] < s[1], rate * s[2]).otherwise(rate * s[3])  # noqa: E731, B023
        total = total + F.when(cols[g] < c, side(low)).otherwise(side(high))
    return total


SPAN = "struct<s:int,o:int,kind:string,e:int>"
SPANS = f"array<{SPAN}>"


def clear_of(extra: Column, base: Column) -> Column:
    """The spans of extra that overlap none of base: one pass forward with the farthest end of base so far, one back with the
    nearest start of base to come."""
    mark = f"struct<s:int,side:int,e:int,span:{SPAN}>"
    side = lambda spans, k: F.transform(spans, lambda x: F.struct(x.s.alias("s"), F.lit(k).alias("side"), x.e.alias("e"), x.alias("span")).cast(mark))
    both = F.array_sort(F.concat(side(base, 0), side(extra, 1)))
    farther = lambda end, x: F.when(x.side == 0, F.greatest(end, x.e)).otherwise(end)
    open_ = scanned(both, F.lit(-1), farther, lambda end, x: F.when((x.side == 0) | (end <= x.s), F.array(x)).otherwise(F.array().cast(f"array<{mark}>")), mark)
    nearer = lambda start, x: F.when(x.side == 0, x.s).otherwise(start)
    return scanned(F.reverse(open_), F.lit(2**31 - 1), nearer, lambda start, x: F.when((x.side == 1) & (start >= x.e), F.array(x.span)).otherwise(F.array().cast(SPANS)), SPAN)


def first_of_each(spans: Column) -> Column:
    """Of sorted spans each that begins where the last one taken has ended, or later."""
    took = lambda end, x: x.s >= end
    return scanned(spans, F.lit(0), lambda end, x: F.when(took(end, x), x.e).otherwise(end), lambda end, x: F.when(took(end, x), F.array(x)).otherwise(F.array().cast(SPANS)), SPAN)


def _matches(kind: str) -> Column:
    return F.coalesce(F.col(f"_{kind}"), F.array().cast("array<struct<s:int,m:string>>"))


def _keeps(kind: str):
    return lambda x: valid(kind, x.m)


def _spans(matches: Column, order: int, kind: str) -> Column:
    return F.transform(matches, lambda x: F.struct(x.s.alias("s"), F.lit(order).alias("o"), F.lit(kind).alias("kind"), (x.s + F.length(x.m)).cast("int").alias("e"))).cast(SPANS)


def _chosen(kind: str, trees: list[tuple[float, tuple]], threshold: float):
    def test(x: Column) -> Column:
        before = F.substring(F.col("text"), F.greatest(x.s - CONTEXT, F.lit(0)) + 1, F.least(x.s, F.lit(CONTEXT)))
        after = F.substring(F.col("text"), x.s + F.length(x.m) + 1, F.lit(CONTEXT))
        return tree_score(trees, features(F.lit(kind), x.m, before, after)) >= threshold

    return test


def detect(docs: DataFrame, precision: float = 0.97, keep: bool = False) -> DataFrame:
    """doc_id, text, base and spans (with keep: docs as it is and _spans): arrays of struct<s, o, kind, e> sorted by start, then kind as listed; spans are base
    and the chosen candidates that overlap no base span and no chosen one before. Map side, SQL functions only.

    A null text is empty; an empty text has no spans. Starts and ends are code points, end exclusive. Rows of null or
    repeated doc_id are returned as they come; an empty table gives no rows; other columns are not read.
    """
    trees, thresholds = fit(docs.sparkSession, precision=precision)
    none = F.array().cast(SPANS)
    if keep:  # docs as one struct beside the working columns, whose names can't clash with its own
        df = docs.select(F.struct("*").alias("_row"), F.coalesce("text", F.lit("")).alias("text"))
    else:
        df = texts(docs)
    df = df.withColumn("digit", F.col("text").rlike("[0-9]"))
    guard = {"email": F.col("text").contains("@"), "ip": F.col("digit"), "card": F.col("digit"), "phone": F.col("text").contains("+")}
    for k in KINDS:
        df = df.withColumn(f"_{k}", F.when(guard[k], located(F.col("text"), BASE[k])))
    parts = [_spans(F.filter(_matches(k), _keeps(k)), o, k) for o, k in enumerate(KINDS)]
    df = df.withColumn("base", F.array_sort(F.concat(*parts))).drop(*[f"_{k}" for k in KINDS])
    wide_guard = {"email": F.col("text").rlike(r"(?i)\bat\b|@\x20|[\[(]at[\])]"), "ip": F.col("digit"), "card": F.col("digit"), "phone": F.col("digit")}
    live = [k for k in KINDS if thresholds[k] < math.inf]
    for k in live:
        df = df.withColumn(f"_{k}", F.when(wide_guard[k], located(F.col("text"), WIDE[k])))
    found = [_spans(F.filter(_matches(k), _chosen(k, trees, thresholds[k])), o, k) for o, k in enumerate(KINDS) if k in live]
    df = df.withColumn("_extra", F.concat(*found) if found else none)
    some = F.concat("base", first_of_each(F.array_sort(clear_of(F.col("_extra"), F.col("base")))))
    df = df.withColumn("spans", F.when(F.size("_extra") > 0, F.array_sort(some)).otherwise(F.col("base")))
    return df.select("_row.*", F.col("spans").alias("_spans")) if keep else df.select("doc_id", "text", "base", "spans")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.s.cast("string"), x.e.cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in angle brackets; of overlapping spans the first is replaced, up to the
    farthest end."""
    new = lambda at, x: F.array(F.substring(text, at + 1, x.s - at), F.concat(F.lit("<"), x.kind, F.lit(">")))
    parts = scanned(spans, F.lit(0), lambda at, x: F.greatest(at, x.e), lambda at, x: F.when(x.s >= at, new(at, x)).otherwise(F.array().cast("array<string>")), "string")
    rest = F.substring(text, F.coalesce(F.array_max(F.transform(spans, lambda x: x.e)), F.lit(0)) + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(text)


def op9(spark, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the personal data spans of every whole text of documents."""
    found = detect(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
