"""Answers of models, kept: a prompt that has an answer is never asked again, and all that read an answer read the same one."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions import lenient as L
from folioloom.operators import ports
from folioloom.sources import versions

ROWS = "key string, model string, run string, answer string, at timestamp"


class Ledger:
    """A model behind a table of its answers at a path, a port like any other. name: the model and all that its answers depend on
    besides the prompt, such as its version and temperature.

    Asking runs at once: distinct prompts without an answer are called, and what comes back is appended. Then rows are joined with
    their answers, so that whatever branches off later, or runs again, calls nothing. A failed call is kept as such for this
    ledger's run, so that all branches see the failure; another run, with a ledger of its own, asks again. An executor that dies
    while it calls makes its task call again what it hadn't handed over.
    """

    def __init__(self, model: ports.TextModel | ports.PictureModel, name: str, path: str, run: str | None = None):
        self.model, self.name, self.path, self.run = model, name, path, run or uuid.uuid4().hex

    def key(self, *parts: Column) -> Column:
        """A hash of the model and what it's shown; null and empty parts differ."""
        marked = [F.coalesce(F.concat(F.lit("+"), F.length(p).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
        return F.sha2(F.concat(F.lit(f"{len(self.name)}:{self.name}"), *marked), 256)

    def rows(self, spark: SparkSession) -> DataFrame:
        """The table: a row a call. Calls that were appended together are a folder, which counts once it's whole; the folders are named
        one by one, so that a plan that reads the table before and after an append holds both readings apart."""
        files = versions.Table(spark, self.path)
        whole = [f"{self.path}/{n}" for n in sorted(files._names(".")) if "_SUCCESS" in files._names(n)]
        return spark.read.schema(ROWS).parquet(*whole) if whole else spark.createDataFrame([], ROWS)

    def _known(self, spark: SparkSession) -> DataFrame:
        """key, answer: the first answer of each key that has one."""
        return self.rows(spark).where("answer is not null").groupBy("key").agg(F.min_by("answer", F.struct("at", "answer")).alias("answer"))

    def _answered(self, df: DataFrame, key: Column, shown: dict[str, str], ask, out: str) -> DataFrame:
        spark, k = df.sparkSession, "_ledger_key"
        keyed = df.withColumn(k, key)
        asks = keyed.select(k, *[F.col(c).alias(name) for name, c in shown.items()]).dropDuplicates([k])
        seen = self.rows(spark).where(F.col("answer").isNotNull() | (F.col("run") == self.run)).select(F.col("key").alias(k))
        due = asks.join(seen, k, "left_anti")
        made = ask(due).select(F.col(k).alias("key"), F.lit(self.name).alias("model"), F.lit(self.run).alias("run"), F.col("_answer").alias("answer"), F.current_timestamp().alias("at"))
        made.write.parquet(f"{self.path}/calls-{uuid.uuid4().hex}")
        known = self._known(spark).select(F.col("key").alias(k), F.col("answer").alias("_ledger_answer"))
        return keyed.join(known, k, "left").select(*[c for c in df.columns if c != out], F.col("_ledger_answer").alias(out))

    def answer(self, df: DataFrame, prompt: str, out: str) -> DataFrame:
        return self._answered(df, self.key(F.col(prompt)), {"_prompt": prompt}, lambda due: self.model.answer(due, "_prompt", "_answer"), out)

    def describe(self, df: DataFrame, image: str, kind: str, context: str, out: str) -> DataFrame:
        shown = {"_image": image, "_kind": kind, "_context": context}
        key = self.key(F.sha2(image, 256), F.col(kind), F.col(context))
        return self._answered(df, key, shown, lambda due: self.model.describe(due, "_image", "_kind", "_context", "_answer"), out)

    def compact(self, spark: SparkSession, files: int = 1) -> None:
        """Answers alone, a row a key, in one folder: failures and answers that came second go. Not while a run is on."""
        table = versions.Table(spark, self.path)
        old = table._names(".")
        held = self.rows(spark).where("answer is not null").groupBy("key").agg(F.min_by(F.struct("model", "run", "answer", "at"), F.struct("at", "answer")).alias("x")).select("key", "x.*")
        held.repartition(files).write.parquet(f"{self.path}/calls-{uuid.uuid4().hex}")
        for name in old:
            fs, p = table._at(name)
            fs.delete(p, True)


class Cascade:
    """Picture or text models in order: rows on which one fails, and they alone, go on to the next. source: a column, if one is named,
    with the name of the model that answered, null where none did.

    models: (name, port). Each step's answers are kept at a path below folder before rows without one are chosen, so that no model is
    asked a row twice; what is kept can be asked for later too, as with any ledger."""

    def __init__(self, models: list[tuple[str, ports.TextModel | ports.PictureModel]], folder: str, source: str | None = None):
        self.steps = [(name, Ledger(model, name, f"{folder}/{i}")) for i, (name, model) in enumerate(models)]
        self.source = source

    def _first(self, df: DataFrame, ask, out: str) -> DataFrame:
        columns = [c for c in df.columns if c not in (out, self.source)]
        kept = [*columns, out, *([self.source] if self.source else [])]
        done, left = None, df.select(columns)
        for name, step in self.steps:
            said = ask(step, left)
            got = said.where(F.col(out).isNotNull())
            got = got.withColumn(self.source, F.lit(name)) if self.source else got
            done = got.select(kept) if done is None else done.unionByName(got.select(kept))
            left = said.where(F.col(out).isNull()).select(columns)
        none = left.withColumn(out, F.lit(None).cast("string"))
        none = none.withColumn(self.source, F.lit(None).cast("string")) if self.source else none
        return none.select(kept) if done is None else done.unionByName(none.select(kept))

    def answer(self, df: DataFrame, prompt: str, out: str) -> DataFrame:
        return self._first(df, lambda step, left: step.answer(left, prompt, out), out)

    def describe(self, df: DataFrame, image: str, kind: str, context: str, out: str) -> DataFrame:
        return self._first(df, lambda step, left: step.describe(left, image, kind, context, out), out)


class Checked:
    """A text model of which only answers count that hold a JSON object with all of keys, none of them null; others are failures."""

    def __init__(self, model: ports.TextModel, keys: tuple[str, ...], note: str = ""):
        self.model, self.keys, self.note = model, keys, note

    def answer(self, df: DataFrame, prompt: str, out: str) -> DataFrame:
        asked = df.withColumn("_noted", F.concat(F.col(prompt), F.lit(self.note)))
        said = self.model.answer(asked, "_noted", out).drop("_noted")
        body = L.json_object(F.col(out))
        whole = body.isNotNull()
        for k in self.keys:
            whole = whole & F.get_json_object(body, f"$.{k}").isNotNull()
        return said.withColumn(out, F.when(whole, F.col(out)))


def structured(model: ports.TextModel, name: str, keys: tuple[str, ...], folder: str, tries: int = 2) -> Cascade:
    """A port that asks again, up to tries times in all, for an answer that holds a JSON object with all of keys; null where it never
    comes. Answers are kept below folder, as a cascade's are: one that doesn't fit is a failure of the run."""
    note = "\n\nThe last answer didn't have the form asked for. Answer with one JSON object that has " + ", ".join(keys) + ", and nothing else."
    return Cascade([(f"{name}-{i}", Checked(model, keys, note if i else "")) for i in range(tries)], folder)
