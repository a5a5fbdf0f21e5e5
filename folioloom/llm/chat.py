"""Chat formatting with offset-aligned loss masks, and reading conversations back from what was made."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.llm import utf8
from folioloom.llm.cluster import partitions, table
from folioloom.llm.packing import encode, token_bytes

#: The template of a turn: OPEN, the escaped role, BETWEEN, the escaped text, CLOSE. ESCAPE stands before ESCAPE itself and
#: before anything of a role or text that reads OPEN, BETWEEN or CLOSE, and is dropped when read back.
OPEN, BETWEEN, CLOSE, ESCAPE = "### ", ":\n", "\n</turn>\n", "\\"
_CONTROL = re.compile(r"\\|#|</turn>")
_ROLE_CONTROL = re.compile(r"\\|#|:|</turn>")
_TURN = re.compile(r"### ((?:[^\\:]+|\\.)*):\n((?:[^\\<]+|\\.|<(?!/turn>))*)\n</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str, role: bool = False) -> str:
    """text with every ESCAPE, '#' and '</turn>' (in a role ':' too) after an ESCAPE."""
    return (_ROLE_CONTROL if role else _CONTROL).sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], learn: frozenset[str]) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation, and the span of code points of each text whose role is in learn; spans are sorted."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{OPEN}{escape(role, True)}{BETWEEN}", escape(text)
        if role in learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation, exactly as they were."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens touch a span, by binary search among the sorted spans (rows of from, to), and the code points under the
    mask, as rows: each token's own part inside a span, joined where parts touch or overlap within one span. Tokens are in
    order and don't contain one another."""
    if not len(spans) or not len(starts):
        return np.zeros(len(starts), bool), np.zeros((0, 2), np.int64)
    low, high = spans[:, 0], spans[:, 1]
    first = np.searchsorted(high, starts, side="right")  # the first span that ends after the token's start
    count = np.maximum(np.searchsorted(low, ends, side="left") - first, 0)  # it and those that begin before its end
    token = np.repeat(np.arange(len(starts)), count)
    span = utf8.flat(first, count)
    a, b = np.maximum(starts[token], low[span]), np.minimum(ends[token], high[span])
    some = a < b
    token, span, a, b = token[some], span[some], a[some], b[some]
    on = np.zeros(len(starts), bool)
    on[token] = True
    if not len(a):
        return on, np.zeros((0, 2), np.int64)
    far = np.maximum.accumulate(b)  # spans ascend, so this is their own
    head = np.flatnonzero(np.r_[True, (span[1:] != span[:-1]) | (a[1:] > far[:-1])])
    return on, np.stack([a[head], far[np.r_[head[1:], len(a)] - 1]], axis=1)


def encoded(texts: list[str], tokenizer: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts, ids in each, starts, ends in code points of all texts together) of one encoding. A token that holds
    part of a character reaches over all of it."""
    raw = [t.encode() for t in texts]
    at = np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
    buf = np.frombuffer(b"".join(raw), np.uint8)
    ids, sizes = encode(buf, at, tokenizer, special_too=False)
    end = np.cumsum(_token_bytes(tokenizer)[ids])
    point = np.cumsum((buf & 0xC0) != 0x80)  # code points begun up to each byte
    start = np.r_[0, end[:-1]] if len(end) else end
    return ids, sizes, point[start] - 1, point[end - 1]


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> np.ndarray:
    return token_bytes(path)


FORMATTED = "conv_id long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>, spans array<struct<a:int,b:int>>"


def format_conversations(conversations: DataFrame, tokenizer: str, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """FORMATTED: each conversation (conv_id, turn, role, text) rendered whole, encoded once, its token offsets in code
    points, the loss mask over tokens, and the code point spans under it.

    Turns are in the order of turn, nulls first, ties by role, then text. A null role or text is an empty one; a null
    conv_id is a conversation of its own kind; repeated rows are turns of their own. An empty table gives no rows. Other
    columns are not read. A conversation is one row of the result, so its turns meet in one task; they are gathered as
    sorted arrays in the JVM, and conversations are dealt out by conv_id.
    """
    wanted = frozenset(learn)
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    whole = turns.repartition(partitions(conversations.sparkSession), "conv_id").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    flat = whole.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            k = 0
            while k < big.num_rows:  # some conversations, or a long one alone, at once
                made, held, first = [], 0, k
                while k < big.num_rows and (not made or held < 1_000_000):
                    made.append(render(list(zip(big.column(1)[k].as_py(), big.column(2)[k].as_py(), strict=True)), wanted))
                    held += len(made[-1][0])
                    k += 1
                ids, sizes, starts, ends = encoded([x for x, _ in made], tokenizer)
                base = np.r_[0, np.cumsum([len(x) for x, _ in made])].astype(np.int64)  # where each one's code points begin
                of = np.repeat(np.arange(len(made)), sizes)
                spans = np.array([(base[i] + a, base[i] + z) for i, (_, own) in enumerate(made) for a, z in own], np.int64).reshape(-1, 2)
                on, parts = mask(starts, ends, spans)
                where = np.searchsorted(base, parts[:, 0], side="right") - 1
                lists = lambda values, n: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), values)
                i32 = lambda x: pa.array(x.astype(np.int32))
                under = pa.StructArray.from_arrays([i32(parts[:, 0] - base[where]), i32(parts[:, 1] - base[where])], names=["a", "b"])
                cols = [
                    lists(i32(ids), sizes),
                    lists(i32(starts - base[of]), sizes),
                    lists(i32(ends - base[of]), sizes),
                    lists(pa.array(on), sizes),
                    lists(under, np.bincount(where, minlength=len(made))),
                ]
                yield pa.RecordBatch.from_arrays(
                    [big.column(0).slice(first, k - first), pa.array([x for x, _ in made]), *cols],
                    names=["conv_id", "formatted", "ids", "starts", "ends", "loss", "spans"],
                )

    return flat.mapInArrow(run, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """DIGESTS of FORMATTED rows, from what is written there alone: turns parsed from formatted, the text under the mask
    from spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            rows = []
            for conv, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = parse(text)
                under = unescape("".join(text[s["a"] : s["b"]] for s in spans))
                rows.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(under), sha(under), len(text)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(
                    zip(*rows, strict=True),
                    (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()),
                    strict=True,
                )] if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return formatted.select("conv_id", "formatted", "spans").mapInArrow(run, DIGESTS)


def op2(spark, sf_dir: str) -> DataFrame:
    """Digests, read back, of all conversations and of conversation -7, whose texts hold the template's own strings."""
    import public_tokenizers

    hard = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(hard).alias("text"),
    )
    both = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_back(format_conversations(both, public_tokenizers.path("byte_bpe_50k.json")))


#: formatted_chars follows from the template: 4 + 2 + 9 characters a turn besides the escaped role and text.
OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS body FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY turn, role, body)) AS turns_sha256,
  CAST(coalesce(sum(length(body)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(body, '' ORDER BY turn, role, body) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(15 + length(role) + length(regexp_replace(role, '[^\\#:]', '', 'g')) + (length(role) - length(replace(role, '</turn>', ''))) / 7
    + length(body) + length(regexp_replace(body, '[^\\#]', '', 'g')) + (length(body) - length(replace(body, '</turn>', ''))) / 7) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
