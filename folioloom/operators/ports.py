"""Ports to outside models, with stand-ins that need no network and always answer alike."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.functions.text import strip, tokens
from folioloom.functions.vectors import let, norm


class Embedder(Protocol):
    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame: ...


class TextModel(Protocol):
    def answer(self, df: DataFrame, prompt: str, out: str) -> DataFrame: ...


class PictureModel(Protocol):
    def describe(self, df: DataFrame, image: str, kind: str, context: str, out: str) -> DataFrame: ...


class PageRenderer(Protocol):
    def render(self, documents: DataFrame) -> DataFrame: ...


class PageReader(Protocol):
    def read(self, pages: DataFrame) -> DataFrame: ...


class LayoutModel(Protocol):
    def detect(self, pages: DataFrame) -> DataFrame: ...


class OrderModel(Protocol):
    def logits(self, pages: DataFrame) -> DataFrame: ...


class HashedEmbedder:
    """Bag of hashed tokens, signed, of unit length: all JVM expressions."""

    def __init__(self, width: int = 64):
        self.width = width

    def column(self, text: Column) -> Column:
        spots = F.array_sort(F.transform(tokens(F.coalesce(text, F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(2 * self.width))))
        # each spot's tokens lie together once sorted: how many there are is known from where it begins and where the next does
        first = lambda s: F.map_from_entries(F.filter(F.transform(s, lambda x, i: F.struct(F.when((i == 0) | (F.get(s, i - 1) != x), x).alias("k"), i.alias("i"))), lambda e: e["k"].isNotNull()))
        last = lambda s: F.map_from_entries(F.filter(F.transform(s, lambda x, i: F.struct(F.when((i == F.size(s) - 1) | (F.get(s, i + 1) != x), x).alias("k"), (i + 1).alias("i"))), lambda e: e["k"].isNotNull()))
        count = lambda a, b, k: F.coalesce(F.try_element_at(b, k) - F.try_element_at(a, k), F.lit(0))
        places = F.sequence(F.lit(0).cast("long"), F.lit(self.width - 1).cast("long"))
        raw = let(spots, lambda s: let(first(s), lambda a: let(last(s), lambda b: F.transform(places, lambda k: (count(a, b, k) - count(a, b, k + self.width)).cast("double")))))
        return let(raw, lambda r: let(norm(r), lambda n: F.transform(r, lambda x: (x / F.when(n > 0, n).otherwise(1.0)).cast("float"))))

    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, self.column(F.col(text)))


class ArrowEmbedder:
    """Any function of a list of texts to a list of vectors, called once a batch; empty batches aren't sent."""

    def __init__(self, function):
        self.function = function

    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame:
        import pyarrow as pa
        from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

        function, schema = self.function, StructType([*df.schema.fields, StructField(out, ArrayType(FloatType()))])

        def run(batches: Iterator) -> Iterator:
            for b in batches:
                texts = b.column(b.schema.get_field_index(text)).to_pylist()
                made = function(texts) if texts else []
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.float32()))], names=[*b.schema.names, out])

        return df.mapInArrow(run, schema)


class RuledModel:
    """Answers by a rule, a column of prompts to a column of answers: all JVM expressions, always alike. Null is a failure."""

    def __init__(self, rule: Callable[[Column], Column]):
        self.rule = rule

    def answer(self, df: DataFrame, prompt: str, out: str) -> DataFrame:
        return df.withColumn(out, self.rule(F.col(prompt)))

    def describe(self, df: DataFrame, image: str, kind: str, context: str, out: str) -> DataFrame:
        return df.withColumn(out, self.rule(F.concat_ws("\n", F.col(kind), F.col(context), F.length(image).cast("string"))))


class CalledModel:
    """Answers by any function of a prompt, such as a request to a service, a few prompts at a time beside each other. A call
    that raises is tried again after a pause, twice as long each time, then counts as failed: its answer is null, and the job goes on.
    So does one that takes longer than seconds, where these are given: it isn't waited for, nor tried again."""

    def __init__(self, function: Callable[[str], str], tries: int = 2, beside: int = 4, seconds: float | None = None, pause: float = 0.0):
        self.function, self.tries, self.beside, self.seconds, self.pause = function, tries, beside, seconds, pause

    def answer(self, df: DataFrame, prompt: str, out: str) -> DataFrame:
        import pyarrow as pa
        from pyspark.sql.types import StringType, StructField, StructType

        function, tries, beside, seconds, pause = self.function, self.tries, self.beside, self.seconds, self.pause

        def one(text: str | None) -> str | None:
            for k in range(tries):
                try:
                    return function(text or "")
                except Exception:  # noqa: BLE001 - whatever a service raises is a failed call
                    if pause and k + 1 < tries:
                        time.sleep(pause * 2**k)
            return None

        def timed(text: str | None) -> str | None:
            """one() on a thread of its own, which a call that hangs keeps."""
            box: list[str | None] = [None]
            runner = threading.Thread(target=lambda: box.__setitem__(0, one(text)), daemon=True)
            runner.start()
            runner.join(seconds)
            return box[0]

        def run(batches: Iterator) -> Iterator:
            from concurrent.futures import ThreadPoolExecutor

            with ThreadPoolExecutor(beside) as pool:
                for b in batches:
                    made = list(pool.map(one if seconds is None else timed, b.column(b.schema.get_field_index(prompt)).to_pylist()))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, out])

        return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, StringType())]))


class ExtractiveModel:
    """Answers with the first passage of the prompt: the text after the last "[1]" up to the next blank line."""

    def answer(self, df: DataFrame, prompt: str, out: str) -> DataFrame:
        found = F.regexp_extract(prompt, r"(?s)\[1\]\s*(.*?)(?:\n\n|$)", 1)
        return df.withColumn(out, F.when(found == "", "No relevant documents found.").otherwise(found))


def context_prompt(question: Column, passages: Column, cap: int = 600) -> Column:
    """The question and numbered passages, each cut to cap characters, as one string."""
    body = F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.substring(p, 1, cap))), "\n\n")
    return F.concat(F.lit("Question: "), question, F.lit("\n\nPassages:\n"), body)


def visual_answer(raw: Column) -> tuple[Column, Column]:
    """(is_meaningful, text) of a picture description: SKIP in any case, with or without white space, says it isn't."""
    text = strip(raw)
    return F.upper(text) != "SKIP", text
