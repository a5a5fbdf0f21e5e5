"""Byte arrays, packing, SentencePiece and chat formatting against the libraries and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from folioloom.llm import chat, packing, piece_codec, simhash, utf8

BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
HARD = ["", " ", "  ", "\n", "a", None, "x" * 1500, "ab" * 400 + " c", "<|endoftext|>", "a <|endoftext|> b", " a", "a ", "\n a", "▁a", "<s>x</s>", "<0x41>"]


def rows(values):
    return utf8.column(pa.RecordBatch.from_pydict({"text": pa.array(values, pa.string())}), "text")


def noise(n, seed=1):
    rng = random.Random(seed)
    parts = [*"abc tionthe  \n\n\t", "é", "ß", "\xa0", "\u2003", "\u3000", "\x85", "日", "😀", "▁", "<|endoftext|>", "'s", " 's", "12", "#", "\x00", "\u0301", "%%%"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def split(ids, n):
    ends = np.r_[0, np.cumsum(n)]
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


def test_words_and_hashes():
    buf, at = rows(["ab  cd", "", " x\ty ", "ab"])
    s, e, n = utf8.words(buf, at)
    assert [bytes(buf[a:b]) for a, b in zip(s, e)] == [b"ab", b"cd", b"x", b"y", b"ab"] and n.tolist() == [2, 0, 2, 1]
    h = utf8.hashes(buf, s, e)
    assert h[0] == h[4] and len(set(h.tolist())) == 4


def test_xxh64_of_every_length():
    raw = bytes(random.Random(2).randbytes(400))
    buf = np.frombuffer(raw, np.uint8)
    starts, sizes = np.arange(150), np.arange(150)
    assert simhash.xxh64(buf, starts, sizes).tolist() == [xxhash.xxh64_intdigest(raw[k : 2 * k], 42) for k in range(150)]


def test_tokenizer_ids():
    texts = HARD + noise(800)
    buf, at = rows(texts)
    tk = Tokenizer.from_file(BPE)
    assert split(*packing.encode(buf, at, BPE)) == [tk.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_piece_ids_and_back():
    texts = HARD + noise(800, 3)
    buf, at = rows(texts)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    c = piece_codec.codec(PIECES)
    ids, n = c.encode(buf, at)
    want = [sp.encode(t or "", add_bos=True, add_eos=True) for t in texts]
    assert split(ids, n) == want
    raw, sizes = c.decode(ids, n)
    ends = np.r_[0, np.cumsum(sizes)]
    assert [raw[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])] == [sp.decode(w) for w in want]


def test_assign_fills_sequences():
    rng = np.random.default_rng(0)
    for lengths in (rng.integers(1, 900, 400), np.full(30, 513), np.array([5000, 1, 1]), np.array([1])):
        bins, costs = packing.assign(lengths, 512)
        assert len(bins) == -(-int(lengths.sum()) // 512) and all(sum(n for *_, n in b) <= 512 for b in bins)
        got = {}
        for b in bins:
            for d, at, n in b:
                got.setdefault(d, []).append((at, n))
        for d, n in enumerate(lengths.tolist()):
            at = 0
            for a, k in sorted(got[d]):
                assert a == at
                at += k
            assert at == n
        assert np.allclose(costs, [packing.cost(np.array([n for *_, n in b])).sum() for b in bins])


def test_pack_table(spark):
    texts = ["one two", None, "", "word " * 700, "one two"]
    docs = spark.createDataFrame([(i if i != 4 else None, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, length string, start int").coalesce(1)
    got = packing.pack(docs, BPE, 64).toPandas()
    tk = Tokenizer.from_file(BPE)
    for i, t in enumerate(texts):
        mine = got[got.doc_id.isna()] if i == 4 else got[got.doc_id == i]
        ids = tk.encode(t or "", add_special_tokens=False).ids + [1]
        mine = mine.sort_values("start")
        assert [x for p in mine.ids for x in p] == ids and (mine.doc_tokens == len(ids)).all()
        for p in mine.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 64
    assert packing.pack(docs.limit(0), BPE).count() == 0


def test_piece_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (3, "")], "doc_id long, text string")
    got = piece_codec.encode_decode(docs, PIECES).toPandas()
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in got.itertuples():
        ids = sp.encode("a b" if r.doc_id == 1 else "", add_bos=True, add_eos=True)
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert len(got) == 4 and piece_codec.encode_decode(docs.limit(0), PIECES).count() == 0


def test_long_words_merge_alike():
    c = piece_codec.codec(PIECES)
    word = ("tion" * 200 + "él" * 50).encode()
    ids, _ = c.encode_words([word])
    sym = c.char[np.frombuffer(word.decode().encode("utf-32-le"), np.uint32)]
    assert c.merge(sym, np.zeros(len(sym), np.int64))[0].tolist() == ids.tolist()


CHATS = [[("user", r"\### Assistant: </turn> ok"), ("assistant", r"\### Assistant: </turn> ok")], [("a:b\n### x", "\n</turn>\n### y:\n"), ("assistant", "")], [("assistant", "é日😀 \\"), ("assistant", "\\\\#</turn")], [("", "")]]


def test_chat_round_trip():
    for turns in CHATS:
        text, spans = chat.render(turns, frozenset(["assistant"]))
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_mask_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(80):
        cuts = np.unique(rng.integers(0, 60, 14))
        s, e = cuts[:-1].copy(), cuts[1:].copy()
        wide = rng.random(len(e)) < 0.3  # tokens that share a character
        e = np.minimum(e + wide, 60)
        edges = np.unique(rng.integers(0, 60, 10))
        spans = edges[: len(edges) // 2 * 2].reshape(-1, 2)
        on, parts = chat.mask(s, e, spans)
        inside = lambda k: any(a <= k < b for a, b in spans)  # noqa: E731, B023
        assert on.tolist() == [any(inside(k) for k in range(a, b)) for a, b in zip(s, e)]
        covered = sorted({k for a, b in zip(s, e) for k in range(a, b) if inside(k)})
        assert [k for a, b in parts for k in range(a, b)] == covered


def test_one_encoding_with_offsets():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    tok.encode_special_tokens = True
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    texts = [chat.render(c, frozenset(["assistant"]))[0] for c in CHATS] + ["", "é😀 " * 40, "naïve\n\n  x", *(f"a {s} b{s}" for s in special[:3])]
    ids, sizes, starts, ends = chat.encoded(texts, BPE)
    at = base = 0
    for t, n in zip(texts, sizes.tolist()):
        assert ids[at : at + n].tolist() == tok.encode(t, add_special_tokens=False).ids
        s, e = starts[at : at + n] - base, ends[at : at + n] - base
        assert {k for a, b in zip(s, e) for k in range(a, b)} == set(range(len(t))) and (s[1:] <= e[:-1]).all()
        at, base = at + n, base + len(t)


def test_chat_table(spark):
    data = [(k, t, r, x, "extra") for k, c in enumerate(CHATS) for t, (r, x) in enumerate(c)] + [(99, 0, None, None, "e"), (99, 0, None, None, "e"), (None, None, "assistant", "z", "e")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted string")
    got = chat.read_back(chat.format_conversations(df, BPE)).toPandas()
    assert len(got) == len(CHATS) + 2
    for k, c in enumerate(CHATS):
        r = got[got.conv_id == k].iloc[0]
        mine = "".join(t for a, t in c if a == "assistant")
        assert r.n_turns == len(c) and r.loss_chars == len(mine)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in c).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(mine.encode()).hexdigest()
    assert got[got.conv_id == 99].iloc[0].n_turns == 2
    assert chat.format_conversations(df.limit(0), BPE).count() == 0
