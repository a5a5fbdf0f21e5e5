"""Merkle manifests against lists and hashlib."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from folioloom.llm import merkle


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def brute_levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def brute_siblings(levels, i, fanout):
    out = []
    for nodes in levels[:-1]:
        out.append((i % fanout, nodes[i // fanout * fanout : (i // fanout + 1) * fanout]))
        i //= fanout
    return out


def brute_fold(leaf, steps):
    for at, run in steps:
        leaf = digest(*run[:at], leaf, *run[at + 1 :])
    return leaf


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, fanout=16):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0], digest(*map(field, r)), r))
    trees, order = {}, sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        trees[g] = brute_levels([x[2] for x in groups[g]], fanout)
    top = brute_levels([trees[g][-1][0] for g in order], fanout)
    out = []
    for k, g in enumerate(order):
        for i, (_, key, leaf, r) in enumerate(groups[g]):
            steps = brute_siblings(trees[g], i, fanout) + brute_siblings(top, k, fanout)
            hit = key is not None and zlib.crc32(str(key).encode()) % 5 == 0
            given = digest(*map(field, (*r[:4], lowered(r[4])))) if hit else leaf
            proof = digest(*[m for at, run in steps for j, m in enumerate(run) if j != at])
            folded = brute_fold(given, steps)
            out.append((key, leaf, trees[g][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def table_of(n, seed, sources):
    rng = random.Random(seed)
    rows = [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([i, None]), rng.choice([f"Text {i} é", "", None])) for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "sources"), [(1, ["a"]), (17, ["a"]), (700, ["hot"] * 9 + ["é", "z", None, "", "Z"]), (300, [f"s{i}" for i in range(40)])])
def test_manifest_equals_lists(spark, tmp_path, n, sources):
    rows = table_of(n, n, sources)
    rows += [rows[0]] * 3 + [(None, "a", "en", 1, "Null id")] * 2 if n > 1 else []
    path = f"{tmp_path}/documents.parquet"
    extra = [F.lit(1).alias(c) for c in ("group", "leaf", "row", "part", "key", "root")]
    spark.createDataFrame(rows, SCHEMA).select("*", *extra).write.parquet(path)
    got = merkle.op13(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


def test_edges_of_partitions_and_other_fanouts(spark):
    """Ranges of a few rows, so that runs of every level lie over their edges."""
    rows = table_of(500, 3, ["hot"] * 5 + ["b", None])
    df = spark.createDataFrame(rows, SCHEMA)
    for fanout, per in ((2, 3), (3, 40), (16, 7)):
        leaf = merkle.leaf_hash(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
        m = merkle.manifest(df, "source", "doc_id", leaf, fanout=fanout, range_rows=per)
        got = {r.key: r for r in merkle.proofs(m, "bigint").collect()}
        assert m.rows.spans.select("part").distinct().count() > 4
        want = brute(rows, fanout)
        assert len(got) == len(rows)
        for key, leaf_, subroot, root, proof, _, _ in want:
            r = got[key]
            assert (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) == (leaf_, subroot, root, proof, root, True)
        assert [r.root for r in m.root.collect()] == [want[0][3]]


def test_node_records_are_those_of_the_trees(spark):
    rows = table_of(400, 5, ["hot"] * 5 + ["b"])
    leaf = merkle.leaf_hash(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    trees = merkle.manifest(spark.createDataFrame(rows, SCHEMA), "source", "doc_id", leaf, range_rows=64).rows
    groups = {}
    for r in sorted(rows):
        groups.setdefault(r[1], []).append(digest(*map(field, r)))
    for r in trees.nodes.collect():
        assert brute_levels(groups[r.group], 16)[r.level][r["at"]] == r.hash.hex()
    for r in trees.runs.collect():
        assert brute_levels(groups[r.group], 16)[r.level][16 * r.run : 16 * r.run + 16] == [m.hex() for m in r.members]


def test_range_completes_each_run_once():
    for total, a, b in ((1, 0, 1), (16, 0, 16), (17, 0, 17), (300, 5, 290), (300, 32, 300), (300, 299, 300)):
        leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(total)]
        levels = brute_levels([x.hex() for x in leaves], 16)
        runs, peaks = {}, {}
        stack = merkle.Range(total, 16, lambda lv, p, m: runs.__setitem__((lv, p), m), lambda lv, p, h: peaks.__setitem__((lv, p), h))
        for i in range(a, b):
            stack.push(i, leaves[i])
        stack.end()
        assert all([x.hex() for x in m] == levels[lv][16 * p : 16 * p + 16] for (lv, p), m in runs.items())
        assert all(h.hex() == levels[lv][p] for (lv, p), h in peaks.items())
        covered = sum(min(total, (p + 1) * 16**lv) - p * 16**lv for lv, p in peaks)
        assert covered == b - a  # the peaks hold each leaf once


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert merkle.op13(spark, str(tmp_path)).count() == 0
