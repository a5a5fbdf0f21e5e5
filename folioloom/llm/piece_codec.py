"""SentencePiece BPE encoding by vectorised merge rounds, and decoding, without the library in the hot path."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioloom.llm import utf8
from folioloom.llm.cluster import texts
from folioloom.llm.pieces import Memo, cut_words, per_text

#: The character that stands for a space inside pieces.
BAR = "▁"
#: Words of more symbols are merged one at a time with a heap: as exact, and not quadratic in their length.
LONG = 256


class Codec:
    """A BPE model with byte fallback and identity normalisation, read from the library once."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) for i in range(n)]
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        score = [sp.get_score(i) for i in range(n)]
        known = {p: i for i, p in enumerate(pieces) if not special[i]}
        self.byte_id = np.zeros(256, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(pieces[i][1:-1], 16)] = i
        order = sorted(known.values(), key=lambda i: -score[i])
        rank = {i: r for r, i in enumerate(order)}
        self.char = np.arange(-1, -0x110001, -1, dtype=np.int64)  # of a code point: its id, or minus itself less one
        for p, i in known.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        pairs = {}
        for p, i in known.items():
            for k in range(1, len(p)):
                if (a := known.get(p[:k])) is not None and (b := known.get(p[k:])) is not None:
                    pairs[a << 32 | b] = (rank[i], i)
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k][0] for k in self.pair_key.tolist()], np.int64)
        self.pair_id = np.array([pairs[k][1] for k in self.pair_key.tolist()], np.int32)
        self.pairs = pairs
        spell = [b"" if sp.is_control(i) else bytes([int(pieces[i][1:-1], 16)]) if sp.is_byte(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else pieces[i].replace(BAR, " ").encode() for i in range(n)]
        self.spell = np.frombuffer(b"".join(spell), np.uint8)
        self.spell_size = np.array([len(x) for x in spell], np.int64)
        self.spell_at = np.cumsum(self.spell_size) - self.spell_size
        self.memo = Memo(self.encode_words)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        spot = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        ok = (self.pair_key[spot] == key) & (left >= 0) & (right >= 0)
        return np.where(ok, self.pair_rank[spot], np.iinfo(np.int64).max), self.pair_id[spot]

    def merge(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rounds over flat symbols, all words at once: in each word the leftmost of the pairs of least rank merges, the
        arrays are compacted, and words without a pair are set aside, until none has one."""
        none = np.iinfo(np.int64).max
        done_sym, done_word = [], []
        rank = np.full(len(sym), none)
        made = np.zeros(len(sym), np.int32)
        stale = np.ones(len(sym), bool)
        while len(sym):
            look = np.flatnonzero(stale[:-1] & (word[1:] == word[:-1]))
            rank[stale] = none
            rank[look], made[look] = self._ranks(sym[look], sym[look + 1])
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.r_[heads, len(sym)])
            live = np.repeat(best != none, sizes)
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, made = sym[live], word[live], rank[live], made[live]
                if not len(sym):
                    break
                sizes, best = sizes[best != none], best[best != none]
                heads = np.cumsum(sizes) - sizes
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            at = hit[np.r_[True, word[hit[1:]] != word[hit[:-1]]]]  # the leftmost of each word
            sym = sym.copy()
            sym[at] = made[at]
            stale = np.zeros(len(sym), bool)
            stale[at] = True
            stale[at[at > 0] - 1] = True
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word, rank, made, stale = sym[keep], word[keep], rank[keep], made[keep], stale[keep]
        if not done_sym:
            return sym, word
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def merge_long(self, sym: list[int]) -> list[int]:
        """One word, a heap of (rank, place): for words of many symbols."""
        after, before = [*range(1, len(sym)), -1], [*range(-1, len(sym) - 1)]
        heap = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if i >= 0 and j >= 0 and sym[i] >= 0 and sym[j] >= 0 and (p := self.pairs.get(sym[i] << 32 | sym[j])):
                heapq.heappush(heap, (p[0], i, sym[i], sym[j], p[1]))

        for i in range(len(sym)):
            offer(i)
        gone = [False] * len(sym)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], gone[j], after[i] = made, True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return [s for s, g in zip(sym, gone, strict=True) if not g]

    def encode_words(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids in each). A symbol that is no piece becomes its bytes."""
        line = [p.decode().replace(" ", BAR) for p in pieces]
        sizes = np.fromiter(map(len, line), np.int64, len(line))
        sym = self.char[np.frombuffer("".join(line).encode("utf-32-le"), np.uint32)]
        first = np.cumsum(sizes) - sizes
        long = np.flatnonzero(sizes > LONG)
        word = np.repeat(np.arange(len(line)), sizes)
        slow = [self.merge_long(sym[first[k] : first[k] + sizes[k]].tolist()) for k in long.tolist()]
        usual = np.repeat(sizes <= LONG, sizes)
        sym, word = self.merge(sym[usual], word[usual])
        if slow:
            sym = np.concatenate([sym, *(np.array(x, np.int64) for x in slow)])
            word = np.concatenate([word, np.repeat(long, [len(x) for x in slow])])
            order = np.argsort(word, kind="stable")
            sym, word = sym[order], word[order]
        if (odd := np.flatnonzero(sym < 0)).size:
            code = -sym[odd] - 1
            raw = [chr(c).encode() for c in code.tolist()]
            size = np.ones(len(sym), np.int64)
            size[odd] = [len(r) for r in raw]
            place = np.cumsum(size) - size
            out = np.empty(int(size.sum()), np.int64)
            out[place] = sym
            out[utf8.flat(place[odd], size[odd])] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
            sym, word = out, np.repeat(word, size)
        return sym.astype(np.int32), np.bincount(word, minlength=len(pieces))

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids in each), begin and end ids included. Words start at a space after no space, and at
        newlines, which no piece holds; a text that isn't empty has a space put before it."""
        sizes = np.diff(offsets)
        full = (sizes > 0).astype(np.int64)
        at = np.r_[0, np.cumsum(sizes + full)]
        line = np.full(int(at[-1]), 32, np.uint8)
        line[utf8.flat(at[:-1] + full, sizes)] = buf
        starts = cut_words(line, at, (line == 32) | (line == 10))
        ids, n = self.memo(line, starts, np.r_[starts[1:], len(line)])
        count = per_text(starts, at, n)
        out = np.full(len(ids) + 2 * len(count), self.end, np.int32)
        first = np.cumsum(count + 2) - (count + 2)
        out[first] = self.begin
        out[utf8.flat(first + 1, count)] = ids
        return out, count + 2

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 of all texts, bytes in each): pieces spelt out, control ids nothing, the first space of a text dropped.
        Byte pieces give their bytes as they are: ids of an encoding spell UTF-8, others may not."""
        size = self.spell_size[ids]
        raw = self.spell[utf8.flat(self.spell_at[ids], size)]
        of = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(counts)]]
        sizes = np.diff(of)
        has = sizes > 0
        drop = np.zeros(len(sizes), bool)
        drop[has] = raw[of[:-1][has]] == 32
        keep = np.ones(len(raw), bool)
        keep[of[:-1][drop]] = False
        return raw[keep], sizes - drop


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, model: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, ids and decoded, of each whole text; map side.

    A null or empty text has the begin and end ids alone and decodes to nothing. Repeated rows and null doc_ids are
    returned as they come; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            buf, at = utf8.column(b, "text")
            doc = b.column(0).cast(pa.int64())
            for i, j in utf8.chunks(at, 4_000_000):
                ids, n = c.encode(buf[at[i] : at[j]], at[i : j + 1] - at[i])
                text, size = c.decode(ids, n)
                raw, line = memoryview(ids.astype("<u4").tobytes()), memoryview(text.tobytes())
                ie, te = np.r_[0, np.cumsum(4 * n)].tolist(), np.r_[0, np.cumsum(size)].tolist()
                sha = lambda m, e: pa.array([hashlib.sha256(m[p:q]).hexdigest() for p, q in zip(e, e[1:], strict=False)])
                cols, names = [doc.slice(i, j - i), pa.array(n), sha(raw, ie), sha(line, te)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols += [
                        pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(ids)),
                        pa.array([bytes(line[p:q]).decode("utf-8", "replace") for p, q in zip(te, te[1:], strict=False)]),
                    ]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids)


def op7(spark, sf_dir: str) -> DataFrame:
    """Each whole text of documents in ids of piece_bpe_32k and back."""
    import public_tokenizers

    from folioloom.llm.cluster import table

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
