"""Column expressions over text: whitespace, tokens, question intent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of a question that asks for data; matched anywhere in it (fixed values).
DATA_TERMS = (
    "how many", "how much", "total", "average", "mean", "percent", "percentage", "%", "rate", "ratio", "number", "count", "compare", "comparison",
    "versus", "vs", "list", "top", "rank", "ranking", "highest", "lowest", "maximum", "minimum", "sum", "breakdown", "distribution",
)
#: Terms that tell the type of a query (fixed values).
QUERY_FIGURE_TERMS = ("figure", "chart", "image", "diagram", "graph", "plot", "shown")
QUERY_TABLE_TERMS = ("table", "row", "column", "cell", "entry")
#: Terms that put passages of a type first (fixed values).
FIRST_FIGURE_TERMS = ("figure", "chart", "diagram", "image", "plot", "shows", "depicted", "visualization")
FIRST_TABLE_TERMS = ("table", "row", "column", "cell", "score", "bleu", "flop", "cost", "result")
#: Terms that call a specialist (fixed values).
CALL_TABLE_TERMS = ("table", "row", "column")
CALL_FIGURE_TERMS = ("figure", "chart", "image", "diagram", "shown")


def strip(c: Column) -> Column:
    """c without white space at either end, all of Unicode's."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return F.length(strip(F.coalesce(c, F.lit("")))) == 0


def tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, in order, with repeats."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


def long_tokens(c: Column) -> Column:
    """Distinct tokens of three characters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]{3,})"), F.lit(1)))


def has_any(c: Column, terms: tuple[str, ...]) -> Column:
    """Whether the lower-cased text holds any of terms, as parts of words too."""
    low = F.lower(c)
    found = F.lit(False)
    for t in terms:
        found = found | low.contains(t)
    return found


def asks_for_data(question: Column) -> Column:
    return question.rlike("[0-9]") | has_any(question, DATA_TERMS)


def query_type(question: Column) -> Column:
    """multi_hop, figure_lookup, table_lookup or prose."""
    tabular = has_any(question, QUERY_TABLE_TERMS) | asks_for_data(question)
    figure = has_any(question, QUERY_FIGURE_TERMS)
    several = F.lower(question).rlike(r"\band\b|\balso\b|\bas well\b")
    return F.when(several, "multi_hop").when(figure & ~tabular, "figure_lookup").when(tabular, "table_lookup").otherwise("prose")


def passage_type(region_types: Column, text: Column) -> Column:
    """TABLE before FIGURE before SECTION_HEADER (under 80 characters) before PROSE."""
    types = F.coalesce(region_types, F.array().cast("array<string>"))
    return F.when(F.array_contains(types, "table"), "TABLE").when(F.array_contains(types, "figure"), "FIGURE").when(F.length(strip(F.coalesce(text, F.lit("")))) < 80, "SECTION_HEADER").otherwise("PROSE")


def sub_queries(raw: Column, question: Column) -> Column:
    """Lines of a decomposition without their numbering, blank ones dropped; the question itself where none is left."""
    lines = F.transform(F.split(raw, r"\R"), lambda x: strip(F.regexp_replace(strip(x), r"^[0-9]+[.)]\s*", "")))
    kept = F.filter(lines, lambda x: F.length(x) > 0)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(question))
