"""Column expressions on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from folioloom.functions import geometry as G
from folioloom.functions import lenient as L
from folioloom.functions import text as T
from folioloom.functions import vectors as V
from folioloom.operators import layout, ports, store


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def b(*v):
    return G.box(*map(F.lit, v))


def test_boxes(spark):
    r = one(spark, area=G.area(b(0, 0, 10, 20)), none=G.area(b(5, 5, 1, 1)), over=G.overlap(b(0, 0, 10, 10), b(5, 5, 15, 15)), touch=G.overlap(b(0, 0, 5, 5), b(5, 0, 10, 5)), ok=G.valid(b(0, 0, 1, 1)), flat=G.valid(b(0, 0, 0, 1)), point=G.overlap_ratio(b(3, 3, 3, 3), b(0, 0, 9, 9)))
    assert (r.area, r.none, r.over, r.touch, r.ok, r.flat, r.point) == (200, 0, 25, 0, True, False, 0)
    m = spark.range(1).select(F.explode(F.array(b(0, 0, 5, 5), b(3, 3, 10, 10))).alias("b")).agg(G.merged(F.col("b")).alias("m")).first().m
    assert tuple(m) == (0, 0, 10, 10)
    assert spark.range(0).select(b(0, 0, 1, 1).alias("b")).agg(G.merged(F.col("b")).alias("m")).first().m is None
    p = one(spark, poly=G.from_polygon(F.expr("array(array(1.0D, 5.0D), array(3.0D, 2.0D))")), four=G.from_array(F.expr("array(1.0D, 2.0D, 3.0D, 4.0D)")), three=G.from_array(F.expr("array(1.0D, 2.0D, 3.0D)")))
    assert tuple(p.poly) == (1, 2, 3, 5) and tuple(p.four) == (1, 2, 3, 4) and p.three is None


def test_crop_boxes(spark):
    c = lambda box, kind, w, h: one(spark, c=G.crop_box(box, F.lit(kind), F.lit(w), F.lit(h))).c
    assert tuple(c(b(100, 100, 400, 300), "table", 2000, 2000)) == (72, 72, 428, 328)
    assert tuple(c(b(100, 100, 1100, 300), "figure", 2000, 2000)) == (20, 64, 1180, 336)
    assert c(b(10, 10, 12, 12), "table", 50, 30) is None and c(b(0, 0, 0.5, 90), "figure", 500, 500) is None


LABELS = [("table", "table"), ("borderless_table", "table"), ("table_caption", "table"), (" TABLE ", "table"), ("text", "text_block"), ("custom_text", "text_block"), ("doc_title", "text_block"), ("paragraph_title", "text_block"), ("aside_text", "text_block"), ("number", "text_block"), ("image", "figure"), ("chart", "figure"), ("graph", "figure"), ("figure", "figure"), ("seal", None), ("logo", None), ("", None)]


def test_labels(spark):
    got = spark.createDataFrame(LABELS, "label string, want string").withColumn("got", layout.region_type(F.col("label"))).collect()
    assert all(r.got == r.want for r in got)


def test_tokens_and_strip(spark):
    r = one(spark, t=T.tokens(F.lit("Été No.12 b")), s=T.strip(F.lit("  a b \n")), blank=T.blank(F.lit("　")), long=T.long_tokens(F.lit("abc ab ABC a1b2")))
    assert (r.t, r.s, r.blank, r.long) == (["t", "no", "12", "b"], "a b", True, ["abc", "a1b2"])


@pytest.mark.parametrize(("q", "data", "kind"), [("give a summary", True, "table_lookup"), ("why so", False, "prose"), ("which diagram", False, "figure_lookup"), ("this and that", False, "multi_hop"), ("the chart of 3 rows", True, "table_lookup"), ("Also why", False, "multi_hop"), ("sandy band", False, "prose")])
def test_intent(spark, q, data, kind):
    r = one(spark, d=T.asks_for_data(F.lit(q)), k=T.query_type(F.lit(q)))
    assert (r.d, r.k) == (data, kind)


@pytest.mark.parametrize(("raw", "want"), [("1. a\n2. b", ["a", "b"]), ("1) a\n\n  2) b ", ["a", "b"]), ("", ["q"]), ("\n \n", ["q"]), ("12. x\r\ny", ["x", "y"])])
def test_sub_queries(spark, raw, want):
    assert one(spark, s=T.sub_queries(F.lit(raw), F.lit("q"))).s == want


def test_passage_type(spark):
    t = lambda types, text: one(spark, p=T.passage_type(F.lit(types) if types is None else F.array(*map(F.lit, types)), F.lit(text))).p
    assert [t(["figure", "table"], ""), t(["figure"], ""), t(["x"], " " * 90 + "a"), t(["x"], "a" * 80)] == ["TABLE", "FIGURE", "SECTION_HEADER", "PROSE"]


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x]) if x else F.array().cast("array<double>")
    r = one(spark, a=V.cosine(v(1, 0), v(1, 0)), cut=V.cosine(v(3, 4, 9), v(3, 4)), zero=V.cosine(v(0, 0), v(1, 1)), none=V.cosine(v(), v(1)))
    assert (r.a, round(r.cut, 9), r.zero, r.none) == (1, 1, 0, 0)


def test_lenient_json(spark):
    m = lambda s: one(spark, m=L.lenient_map(F.lit(s))).m
    assert m('{"a": "x"}') == {"a": "x"} and m('```json\n{"a": "x"}\n```') == {"a": "x"} and m('so: {"a": {"b": 1}} ok') == {"a": '{"b":1}'}
    assert m('{"summary": "text", "n": 1,, "summary": "later"') == {"parse_error": "true", "summary": "later"}
    assert m("garbage") == {"parse_error": "true"} and m("[1, 2]") == {"parse_error": "true"}


def test_model_answers(spark):
    r = one(spark, s=L.single_score(F.lit("score: 0.7\nreason: fine")), high=L.single_score(F.lit("Score: 7")), bad=L.single_score(F.lit("score: x")), why=L.single_reason(F.lit("score: 1\nReason: so it is")))
    assert (r.s, r.high, r.bad, r.why) == (0.7, 1.0, 0.0, "so it is")
    ids = F.array(F.lit("a"), F.lit("b"))
    k = lambda s: one(spark, k=L.ranking(F.lit(s), ids)).k
    r = k(json.dumps({"ranking": ["b"], "scores": {"b": 0.9}, "dropped": ["a"]}))
    assert (r.ranking, r.scores, r.dropped, r.top_region_type) == (["b", "a"], {"b": 0.9}, ["a"], "prose")
    assert k("nothing").ranking == ["a", "b"]
    f = lambda s: one(spark, f=L.faithfulness(F.lit(s))).f
    assert f("nothing").overall_verdict == "FAITHFUL" and f('{"confidence_score": 0}').confidence_score == 1.0
    r = f('{"claims": [{"claim_text": "c"}, null], "overall_verdict": "X", "confidence_score": 0.5}')
    assert (r.claims[0].status, len(r.claims), r.overall_verdict, r.confidence_score) == ("UNSUPPORTED", 1, "X", 0.5)
    assert one(spark, n=L.needs_correction(L.faithfulness(F.lit('{"claims": [{"status": "SUPPORTED"}]}')))).n is False


def test_ports(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None), (3, "a b a")], "i int, t string")
    rows = {r.i: r.e for r in ports.HashedEmbedder(16).embed(df, "t", "e").collect()}
    assert rows[1] == rows[3] and abs(sum(x * x for x in rows[1]) - 1) < 1e-6 and set(rows[2]) == {0.0}
    got = ports.ArrowEmbedder(lambda ts: [[float(len(t or ""))] for t in ts]).embed(df, "t", "e").collect()
    assert {r.i: r.e for r in got} == {1: [5.0], 2: [0.0], 3: [5.0]}
    r = one(spark, p=ports.context_prompt(F.lit("why"), F.array(F.lit("x" * 900), F.lit("y"))))
    assert r.p.startswith("Question: why") and "[1] " + "x" * 600 + "\n\n[2] y" in r.p
    answered = ports.ExtractiveModel().answer(spark.createDataFrame([("q [1] first\n\n[2] second",), ("none",)], "p string"), "p", "a").collect()
    assert [r.a for r in answered] == ["first", "No relevant documents found."]
    skip, text = ports.visual_answer(F.lit(" skip "))
    assert one(spark, m=skip, t=text)[:2] == (False, "skip")


def test_small_store_functions(spark):
    assert one(spark, u=store.object_uuid(F.lit("x"))).u == "9dd4e461-268c-8034-f5c8-564e155c67a6"
    at = lambda s: F.expr(f"timestamp'{s}'")
    r = one(spark, a=store.recency(at("2024-01-05 01:00:00"), at("2024-01-05 23:00:00")), b=store.recency(at("2024-01-03 22:00:00"), at("2024-01-05 03:00:00")), c=store.recency(at("2024-01-01 00:00:00"), at("2024-01-05 03:00:00")), d=store.recency(at("2023-01-01 00:00:00"), at("2024-01-05 03:00:00")))
    assert tuple(r) == ("Today", "Yesterday", "4 days ago", "2023-01-01")


def test_answers_are_parsed_once(spark):
    """However many fields are read from an answer."""
    df = spark.createDataFrame([("{}",)], "raw string").select(L.faithfulness(F.col("raw")).alias("f"), L.needs_correction(L.faithfulness(F.col("raw"))).alias("n"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.count("parseJson") <= 4 and plan.count("overall_verdict,StringType") <= 2
