"""Column expressions over what models answer: lenient JSON, scores, rankings, claims."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioloom.functions.text import strip


def unfenced(raw: Column) -> Column:
    return strip(F.regexp_replace(raw, r"```(?:json)?\s*|\s*```", ""))


def unfenced_lines(raw: Column) -> Column:
    """raw without code fences that open or close a line."""
    return F.regexp_replace(F.regexp_replace(strip(raw), r"(?dm)^```(?:json)?\s*", ""), r"(?dm)\s*```$", "")


def once(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value), where value is found once however often made uses it."""
    return F.transform(F.array(value), made)[0]


def json_object(raw: Column, unfence=unfenced) -> Column:
    """The text of the JSON object in raw: all of it without code fences if that is one, else from the first opening to the
    last closing brace; null if neither is."""
    is_object = lambda c: F.ltrim(c).startswith("{") & F.try_parse_json(c).isNotNull()
    part = lambda whole: F.when(whole.contains("{"), F.regexp_extract(whole, r"(?s)\{.*\}", 0))
    return once(unfence(raw), lambda whole: F.when(is_object(whole), whole).otherwise(once(part(whole), lambda c: F.when(is_object(c), c))))


def recovered(raw: Column) -> Column:
    """map<string, string>: the "key": "value" pairs of broken JSON, the last of a key wins, and parse_error."""
    whole = unfenced(raw)
    pattern = r'"(\w+)"\s*:\s*"([^"]*)"'
    keys, values = (F.regexp_extract_all(whole, F.lit(pattern), F.lit(i)) for i in (1, 2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(
        F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))),
        lambda p: ~F.exists(F.slice(keys, p["i"] + 2, F.greatest(F.size(keys), F.lit(1))), lambda k: k == p["k"]),
    )
    own = F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))
    return F.map_concat(F.map_from_arrays(F.array(F.lit("parse_error")), F.array(F.lit("true"))), F.map_filter(own, lambda k, v: k != "parse_error"))


def lenient_map(raw: Column) -> Column:
    """map<string, string> of the object in raw, nested values as JSON; recovered pairs where there's none."""
    return F.when(json_object(raw).isNotNull(), F.from_json(json_object(raw), "map<string,string>")).otherwise(recovered(raw))


def single_score(raw: Column) -> Column:
    """The number after the last line that opens with score:, held to 0..1; 0 if none is one."""
    lines = F.transform(F.split(raw, r"\R"), lambda x: strip(x))
    values = F.transform(F.filter(lines, lambda x: F.lower(x).startswith("score:")), lambda x: strip(F.substring(x, 7, 1 << 20)).try_cast("double"))
    known = F.filter(values, lambda v: v.isNotNull())
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_element_at(known, F.lit(-1)), F.lit(0.0))))


def single_reason(raw: Column) -> Column:
    lines = F.transform(F.split(raw, r"\R"), lambda x: strip(x))
    values = F.transform(F.filter(lines, lambda x: F.lower(x).startswith("reason:")), lambda x: strip(F.substring(x, 8, 1 << 20)))
    return F.coalesce(F.try_element_at(values, F.lit(-1)), F.lit(""))


def string_list(raw: Column, key: str) -> Column:
    """array<string> under key of the object in raw: a lone string is a list of one, null or nothing an empty list."""
    body = json_object(raw)
    value = F.get_json_object(body, f"$.{key}")
    listed = F.from_json(value, "array<string>")
    return F.when(value.isNull(), F.array().cast("array<string>")).when(F.ltrim(value).startswith("["), listed).otherwise(F.array(value))


RANKING = "ranking array<string>, scores map<string,double>, dropped array<string>, top_region_type string"


def ranking(raw: Column, candidates: Column) -> Column:
    """struct of RANKING: the ranking, candidates where it's missing or empty, and those it leaves out after it."""
    got = F.from_json(F.coalesce(json_object(raw, unfenced_lines), F.lit("{}")), RANKING)
    named = F.when(F.size(got.ranking) > 0, got.ranking).otherwise(candidates)
    whole = F.concat(named, F.filter(candidates, lambda c: ~F.array_contains(named, c)))
    return F.struct(
        whole.alias("ranking"),
        F.coalesce(got.scores, F.create_map().cast("map<string,double>")).alias("scores"),
        F.coalesce(got.dropped, F.array().cast("array<string>")).alias("dropped"),
        F.coalesce(F.nullif(got.top_region_type, F.lit("")), F.lit("prose")).alias("top_region_type"),
    )


CLAIM = "claim_text string, status string, source_chunk_ids array<string>, note string"
FAITHFULNESS = "claims array<string>, overall_verdict string, confidence_score double, recommended_action string"


def faithfulness(raw: Column) -> Column:
    """struct<claims: array<CLAIM>, overall_verdict, confidence_score, recommended_action> with their defaults; claims that
    are no objects are passed over; a confidence of 0 counts as missing, so as 1."""
    none = F.array().cast("array<string>")
    text = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), F.lit(default))

    def claim(own: Column) -> Column:
        return F.struct(
            F.coalesce(own.claim_text, F.lit("")).alias("claim_text"),
            text(own.status, "UNSUPPORTED").alias("status"),
            F.coalesce(own.source_chunk_ids, none).alias("source_chunk_ids"),
            F.coalesce(own.note, F.lit("")).alias("note"),
        )

    def made(got: Column) -> Column:
        objects = F.filter(F.coalesce(got.claims, none), lambda c: F.coalesce(c.startswith("{"), F.lit(False)))
        return F.struct(
            F.transform(F.transform(objects, lambda c: F.from_json(c, CLAIM)), claim).alias("claims"),
            text(got.overall_verdict, "FAITHFUL").alias("overall_verdict"),
            F.coalesce(F.nullif(got.confidence_score, F.lit(0.0)), F.lit(1.0)).alias("confidence_score"),
            text(got.recommended_action, "return_as_is").alias("recommended_action"),
        )

    return once(F.from_json(F.coalesce(json_object(raw, unfenced_lines), F.lit("{}")), FAITHFULNESS), made)


def needs_correction(checked: Column) -> Column:
    return F.exists(checked.claims, lambda c: c.status.isin("INFERRED", "UNSUPPORTED"))
