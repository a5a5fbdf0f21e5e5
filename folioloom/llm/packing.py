"""Cost-balanced packing of tokenized documents into sequences of fixed length."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioloom.llm import utf8
from folioloom.llm.cluster import texts
from folioloom.llm.pieces import Memo, cut_words, per_text

END_ID = 1


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> tuple[list[str], dict[bytes, int]]:
    """(special tokens, ids of byte strings) of the tokenizer file at path."""
    import json

    with open(path) as f:
        spec = json.load(f)
    special = [x["content"] for x in spec["added_tokens"]]
    # the vocabulary's characters stand for bytes: printable ones for themselves, the rest from U+0100 on in order
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(plain))}
    return special, {bytes(byte[c] for c in p): i for p, i in spec["model"]["vocab"].items() if p not in special}


def token_bytes(path: str) -> np.ndarray:
    """How many bytes each id stands for; 0 for special tokens."""
    special, ranks = _vocabulary(path)
    out = np.zeros(max(ranks.values()) + len(special) + 1, np.int64)
    out[list(ranks.values())] = [len(b) for b in ranks]
    return out


@lru_cache(maxsize=4)
def _memo(path: str, special_too: bool = True) -> Memo:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    special, ranks = _vocabulary(path)
    if not special_too:
        special = []
    tokenizer = Tokenizer.from_file(path)
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same ids from the same vocabulary file by either library; the faster one doesn't know special tokens."""
        got = [tokenizer.encode(x, add_special_tokens=False).ids if any(s in x for s in special) else fast(x) for x in (p.decode() for p in pieces)]
        return np.fromiter((i for x in got for i in x), np.int32), np.fromiter(map(len, got), np.int64, len(got))

    return Memo(encode)


def encode(buf: np.ndarray, offsets: np.ndarray, path: str, special_too: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, ids in each) as the tokenizer at path gives them without special tokens added; where one's string
    is in a text it's that token or, without special_too, text. Its byte-level split never joins what stands before a lone
    space or newline with what follows, so pieces are cut there."""
    if not len(buf):
        return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
    starts = cut_words(buf, offsets, (buf == 32) | (buf == 10))
    ids, sizes = _memo(path, special_too)(buf, starts, np.r_[starts[1:], len(buf)])
    return ids, per_text(starts, offsets, sizes)


def cost(lengths: np.ndarray, linear: float = 1.0, quadratic: float = 1.0 / 4096) -> np.ndarray:
    """Estimated cost of attention over pieces that don't see each other: linear in tokens plus quadratic in each piece."""
    n = lengths.astype(np.float64)
    return linear * n + quadratic * n * n


class Rooms:
    """Open sequences by room: a heap of (cost, sequence) for each room, and a tree over rooms of the least of each range,
    so that the cheapest sequence with at least some room is found in log2(capacity) steps."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.least: list[tuple[float, int] | None] = [None] * (2 * self.size)

    def _renew(self, room: int) -> None:
        node, heap = self.size + room, self.heaps[room]
        self.least[node] = heap[0] if heap else None
        while node > 1:
            node //= 2
            a, b = self.least[2 * node], self.least[2 * node + 1]
            self.least[node] = b if a is None or (b is not None and b < a) else a

    def put(self, room: int, cost_: float, sequence: int) -> None:
        if room:
            heapq.heappush(self.heaps[room], (cost_, sequence))
            self._renew(room)

    def take(self, room: int, of: list[int]) -> tuple[float, int] | None:
        """The cheapest sequence with at least room, no longer open; of: each sequence's room."""
        low, high, found = self.size + room, 2 * self.size, None
        while low < high:
            if low & 1:
                x = self.least[low]
                found = x if found is None or (x is not None and x < found) else found
                low += 1
            low //= 2
            high //= 2
        if found is not None:
            heapq.heappop(self.heaps[of[found[1]]])
            self._renew(of[found[1]])
        return found


def assign(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 4096) -> tuple[list[list[tuple[int, int, int]]], list[float]]:
    """Sequences as lists of (document, start, length), and each one's cost.

    Documents descend by cost; each goes whole to the sequence of lowest cost among all that have room for it. ceil(total /
    capacity) sequences are open, the least that can hold all tokens; a document that no sequence has room for is cut to
    fill the sequences of lowest cost with room, so that at most the last capacity - 1 places of all stay empty."""
    order = np.argsort(-lengths, kind="stable")
    bins: list[list[tuple[int, int, int]]] = []
    costs: list[float] = []
    spent = lambda n: linear * n + quadratic * n * n
    todo: list[tuple[int, int, int]] = []
    for d in order.tolist():
        n, at = int(lengths[d]), 0
        while n - at >= capacity:  # whole sequences of one long document
            bins.append([(d, at, capacity)])
            costs.append(spent(capacity))
            at += capacity
        if n > at:
            todo.append((n - at, d, at))
    first = len(bins)
    todo.sort(key=lambda x: (-x[0], x[1]))
    count = -(-(int(lengths.sum()) - first * capacity) // capacity)
    room, rooms = [capacity] * count, Rooms(capacity)
    bins += [[] for _ in range(count)]
    costs += [0.0] * count
    rooms.heaps[capacity] = [(0.0, k) for k in range(count)]
    rooms._renew(capacity)
    for n, d, at in todo:
        whole = rooms.take(n, room)
        while n:
            c, k = whole or rooms.take(1, room)
            own = min(n, room[k])
            bins[first + k].append((d, at, own))
            room[k] -= own
            costs[first + k] = c + spent(own)
            rooms.put(room[k], costs[first + k], k)
            n, at = n - own, at + own
    return bins, costs


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>, cost double"


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, window: int = 8_000_000, linear: float = 1.0, quadratic: float = 1.0 / 4096, with_ids: bool = True) -> DataFrame:
    """Pieces of documents in sequences of at most capacity tokens: PIECES, without ids where with_ids is false.

    Each document is its token ids and END_ID. A window of about that many tokens within a partition is packed at once by
    assign(): no shuffle, memory bounded by the window, and at most capacity - 1 empty places a window. A null or empty
    text is END_ID alone; repeated rows and null doc_ids are packed like any other. Longer documents go over several
    sequences. sequence_id is unique, not dense: the partition in its upper bits. An empty table gives no rows.
    Other columns of docs are not read.
    """
    from pyspark import TaskContext

    def flush(ids: list[np.ndarray], sizes: list[np.ndarray], names: list[pa.Array], base: int) -> tuple[pa.RecordBatch, int]:
        flat, size = np.concatenate(ids), np.concatenate(sizes)
        doc = pa.concat_arrays(names)
        bins, costs = assign(size, capacity, linear, quadratic)
        rows = [(d, at, n, base + s, c) for s, (b, c) in enumerate(zip(bins, costs, strict=True)) for d, at, n in b]
        d, at, n, s, c = (np.array(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5
        first = np.cumsum(size) - size
        head = first[d] + at
        heads = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        run = np.cumsum(n) - n
        off = run - np.repeat(run[heads], np.diff(np.r_[heads, len(s)]))
        raw = memoryview(flat.astype("<u4").tobytes())
        crc = np.fromiter((zlib.crc32(raw[4 * i : 4 * (i + k)]) for i, k in zip(head.tolist(), n.tolist(), strict=True)), np.int64, len(n))
        cols = [doc.take(pa.array(d)), pa.array(at), pa.array(n), pa.array(crc), pa.array(size[d]), pa.array(s), pa.array(off)]
        names_ = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(flat[utf8.flat(head, n)])))
            names_.append("ids")
        return pa.RecordBatch.from_arrays([*cols, pa.array(c.astype(np.float64))], names=[*names_, "cost"]), base + len(bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        ids, sizes, names, held = [], [], [], 0
        for b in batches:
            buf, at = utf8.column(b, "text")
            doc = b.column(0).cast(pa.int64())
            for i, j in utf8.chunks(at, 4_000_000):
                got, n = encode(buf[at[i] : at[j]], at[i : j + 1] - at[i], tokenizer)
                # END_ID after each text
                n1 = n + 1
                own = np.full(len(got) + len(n), END_ID, np.int32)
                own[utf8.flat(np.cumsum(n1) - n1, n)] = got
                ids.append(own)
                sizes.append(n1)
                names.append(doc.slice(i, j - i))
                held += len(own)
                if held >= window:
                    out, base = flush(ids, sizes, names, base)
                    yield from (out.slice(k, 20_000) for k in range(0, out.num_rows, 20_000))
                    ids, sizes, names, held = [], [], [], 0
        if held:
            out, base = flush(ids, sizes, names, base)
            yield from (out.slice(k, 20_000) for k in range(0, out.num_rows, 20_000))

    schema = PIECES if with_ids else PIECES.replace("ids array<int>, ", "")
    return texts(docs).mapInArrow(run, schema)


def op4(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 byte_bpe_50k tokens."""
    import public_tokenizers

    from folioloom.llm.cluster import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
