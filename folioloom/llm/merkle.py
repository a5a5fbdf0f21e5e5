"""Merkle manifest of a dataset: hash trees over range partitions, a proof for every row, and its check.

The rows of a group, in order, are the leaves of a tree; every fanout consecutive nodes, fewer in a level's last run, have the hash
of their hex digests, put together, as their parent, until one node remains. These subroots, in the order of their groups, are the
leaves of one more tree. A partition holds a range of leaves whose places in their groups are known. It builds what lies wholly
within it with a stack of levels (Range); runs that reach over its edges are put together level by level by their place, with at
most fanout rows a key and about 2 * fanout rows a level from each partition, so nothing grows with a group in any one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioloom.llm.cluster import dealt, placed, stored, table

FANOUT = 16
#: Leaves of a range partition, about.
RANGE_ROWS = 200_000

Step = tuple[int, list[bytes]]


def leaf_hash(*columns: Column) -> Column:
    """sha256 of the columns, each as its length in bytes, a colon and its value as text, or - where it's null."""
    text = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text]), 256))


def node_hash(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join([c.hex() for c in children]).encode()).digest()


def widths(total: int, fanout: int) -> list[int]:
    """Nodes of each level of a tree, from the leaves to the root."""
    out = [total]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


class Range:
    """The stack over a range of a tree's leaves: for each level the nodes of the run that isn't complete. A full run, or a level's
    last, becomes a node and carries to the next level. run(level, place, members) is called for each complete run, peak(level,
    place, node) for each node whose run isn't complete here, the root among them."""

    def __init__(self, total: int, fanout: int, run: Callable, peak: Callable):
        self.width, self.fanout, self.run, self.peak = widths(total, fanout), fanout, run, peak
        self.held: list[list[bytes]] = [[] for _ in self.width]
        self.at = [0] * len(self.width)

    def push(self, at: int, node: bytes) -> None:
        level = 0
        while True:
            held = self.held[level]
            if self.width[level] == 1 or not held and at % self.fanout:  # the root, or a run that began in an earlier range
                self.peak(level, at, node)
                return
            held.append(node)
            self.at[level] = at
            if len(held) < self.fanout and at + 1 < self.width[level]:
                return
            self.held[level] = []
            self.run(level, at // self.fanout, held)
            level, at, node = level + 1, at // self.fanout, node_hash(held)

    def end(self) -> None:
        for level, held in enumerate(self.held):
            for k, node in enumerate(held):
                self.peak(level, self.at[level] - len(held) + 1 + k, node)


def _spans(leaves: pa.Table, spans: pa.Table) -> Iterator[tuple[dict, pa.Table]]:
    """Each group's span of a partition with its leaves, in order."""
    leaves = leaves.sort_by("row")
    first = leaves.column("row")[0].as_py()
    for s in sorted(spans.to_pylist(), key=lambda s: s["first"]):
        yield s, leaves.slice(s["first"] - first, s["n"])


@dataclass(frozen=True)
class Forest:
    """leaves: part, row, group, ..., leaf, in range partitions; spans: part, group, first, n, start, total; nodes: group, level, at,
    hash, peak; runs: group, level, run, members of runs over edges; roots: group, total, root."""

    leaves: DataFrame
    spans: DataFrame
    nodes: DataFrame
    runs: DataFrame
    roots: DataFrame
    parts: int
    depth: int
    fanout: int


def build(leaves: DataFrame, order: list[str], fanout: int = FANOUT, range_rows: int = RANGE_ROWS) -> Forest:
    """The trees of leaves (group string, leaf binary, and the columns of order), one a group, leaves in that order. Null groups and
    null keys come first; rows alike in order and leaf are as many leaves. No leaves: no trees."""
    spark = leaves.sparkSession
    held = stored(leaves, "merkle-leaves")
    n = held.count()
    parts = dealt(spark, n, range_rows, 512)
    by = ["group", *order]
    place = F.monotonically_increasing_id()  # partition and row in it
    spread = held.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_id", place)
    ranges = stored(spread.select(F.shiftright("_id", 33).cast("int").alias("part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("row"), *leaves.columns), "merkle-ranges")
    mine = W.partitionBy("group")
    counted = ranges.groupBy("part", "group").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    start = F.coalesce(F.sum("n").over(mine.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = stored(counted.select("part", "group", "first", "n", start.alias("start"), F.sum("n").over(mine).alias("total")), "merkle-spans")
    schema = pa.schema([("group", pa.string()), ("level", pa.int32()), ("at", pa.int64()), ("hash", pa.binary()), ("peak", pa.bool_()), ("total", pa.int64())])

    def grow(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for s, own in _spans(left, right):
            group, total = s["group"], s["total"]

            def run(level: int, place: int, members: list[bytes]) -> None:
                if level:  # leaves are a table already
                    out.extend((group, level, place * fanout + k, m, False, total) for k, m in enumerate(members))  # noqa: B023

            stack = Range(total, fanout, run, lambda level, at, node: out.append((group, level, at, node, True, total)))  # noqa: B023
            for k, leaf in enumerate(own.column("leaf").to_pylist()):
                stack.push(s["start"] + k, leaf)
            stack.end()
        return pa.table(list(map(list, zip(*out, strict=True))) or [[]] * len(schema), schema=schema)

    most = spans.agg(F.max("part").alias("p"), F.max("total").alias("t")).first()
    parts, depth = (most.p or 0) + 1, len(widths(most.t or 1, fanout))
    cells = lambda df: placed(df, "part", parts).groupBy("part")
    grown = cells(ranges.select("part", "row", "leaf")).cogroup(cells(spans)).applyInArrow(grow, "group string, level int, at long, hash binary, peak boolean, total long")
    nodes = stored(grown, "merkle-nodes", "peak")
    peaks = nodes.where("peak").select("group", "level", "at", "hash", "total")
    merged, roots, carried = [], [], None
    wide = lambda level: F.col("total") > fanout**level  # noqa: E731 - more than one node there
    for level in range(depth):
        here = peaks.where(F.col("level") == level).drop("level")
        here = here if carried is None else here.unionByName(carried)
        roots.append(here.where(~wide(level)).select("group", "total", F.col("hash").alias("root")))
        members = F.transform(F.sort_array(F.collect_list(F.struct("at", "hash"))), lambda x: x["hash"])
        run = here.where(wide(level)).groupBy("group", F.expr(f"at div {fanout}").alias("run"), "total").agg(members.alias("members"))
        run = stored(run, f"merkle-runs-{level}")
        merged.append(run.select("group", F.lit(level).alias("level"), "run", "members"))
        digest = F.unhex(F.sha2(F.array_join(F.transform("members", lambda m: F.lower(F.hex(m))), ""), 256))
        carried = run.select("group", F.col("run").alias("at"), digest.alias("hash"), "total")
    union = lambda tables: tables[0] if len(tables) == 1 else union(tables[: len(tables) // 2]).unionByName(union(tables[len(tables) // 2 :]))
    return Forest(ranges, spans, nodes, union(merged), stored(union(roots), "merkle-roots"), parts, depth, fanout)


def _edges(forest: Forest) -> DataFrame:
    """part, group, level, run, members: the runs that a partition's leaves climb through and that aren't complete in it."""
    level = F.explode(F.array(*[F.lit(k) for k in range(forest.depth)])).alias("level")
    ends = forest.spans.select("part", "group", level, F.col("start").alias("a"), (F.col("start") + F.col("n") - 1).alias("b"))
    up = lambda c: F.expr(f"{c} div cast(pow({forest.fanout}, level + 1) as bigint)")
    need = ends.select("part", "group", "level", F.explode(F.array_distinct(F.array(up("a"), up("b")))).alias("run")).alias("n")
    same = F.col("n.group").eqNullSafe(F.col("r.group")) & (F.col("n.level") == F.col("r.level")) & (F.col("n.run") == F.col("r.run"))
    return need.join(forest.runs.alias("r"), same).select("n.part", "n.group", "n.level", "n.run", "r.members")


def _steps(span: dict, own: list[bytes], edges: dict[tuple[int, int], list[bytes]], fanout: int) -> Iterator[tuple[list[Step], list[Step]]]:
    """For each leaf of a span the place in its run and the run's members, level by level up to the root: the leaf's own level (none
    for a lone leaf), and what lies above, one list for all leaves of a run."""
    runs = dict(edges)
    stack = Range(span["total"], fanout, lambda level, place, members: runs.__setitem__((level, place), members), lambda *_: None)
    for k, leaf in enumerate(own):
        stack.push(span["start"] + k, leaf)
    levels = len(stack.width) - 1
    above: list[Step] = []
    for i in range(span["start"], span["start"] + len(own)):
        if i % fanout == 0 or i == span["start"]:
            above, at = [], i // fanout
            for level in range(1, levels):
                above.append((at % fanout, runs[level, at // fanout]))
                at //= fanout
        yield [(i % fanout, runs[0, i // fanout])] if levels else [], above


def fold(leaf: bytes, steps: list[Step]) -> bytes:
    """The root that a leaf has with the siblings of steps."""
    for at, members in steps:
        leaf = node_hash([*members[:at], leaf, *members[at + 1 :]])
    return leaf


def siblings(steps: list[Step]) -> list[bytes]:
    return [m for at, members in steps for k, m in enumerate(members) if k != at]


_STEPS = pa.list_(pa.struct([("at", pa.int32()), ("members", pa.list_(pa.binary()))]))


def _climbed(forest: Forest, above: DataFrame | None, columns: list[str], each: Callable, schema: str) -> DataFrame:
    """each(span, leaves, steps of each leaf, row of above) over the spans of all partitions. above: (group, ...), a row a group."""
    fanout, edges = forest.fanout, _edges(forest)
    known = forest.spans
    if above is not None:
        a = above.withColumnRenamed("group", "_g")
        known = known.join(a, F.col("group").eqNullSafe(F.col("_g"))).drop("_g")
    spare = [c for c in known.columns if c not in ("part", "group")]
    own = known.select("part", "group", F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("run"), F.lit(None).cast("array<binary>").alias("members"), *spare)
    context = own.unionByName(edges, allowMissingColumns=True)

    def climb(left: pa.Table, right: pa.Table) -> pa.Table:
        is_edge = right.column("level").is_valid()
        at: dict = {}
        for e in right.filter(is_edge).select(["group", "level", "run", "members"]).to_pylist():
            at.setdefault(e["group"], {})[e["level"], e["run"]] = e["members"]
        made = [
            each(s, rows, _steps(s, rows.column("leaf").to_pylist(), at.get(s["group"], {}), fanout))
            for s, rows in _spans(left, right.filter(pa.compute.invert(is_edge)))
        ]
        return pa.concat_tables(made)

    cells = lambda df: placed(df, "part", forest.parts).groupBy("part")
    return cells(forest.leaves.select("part", "row", "leaf", *columns)).cogroup(cells(context)).applyInArrow(climb, schema)


@dataclass(frozen=True)
class Manifest:
    """rows: the forest of a row's leaves; groups: that of the subroots, whose one tree has the root."""

    rows: Forest
    groups: Forest

    @property
    def root(self) -> DataFrame:
        return self.groups.roots.select(F.lower(F.hex("root")).alias("root"))


def manifest(rows: DataFrame, group: str, key: str, leaf: Column, given: Column | None = None, fanout: int = FANOUT, range_rows: int = RANGE_ROWS) -> Manifest:
    """The manifest of rows, a tree for each value of group (as a string), leaves by key; of rows with the same key, by leaf. Null
    groups and keys are values of their own, before all others. given: the leaf that a check is given, the row's own if there's
    none. Columns of rows other than those named aren't read, whatever their names. No rows: no root."""
    own = rows.select(F.col(group).cast("string").alias("group"), F.col(key).alias("key"), leaf.alias("leaf"), (leaf if given is None else given).alias("given"))
    trees = build(own, ["key", "leaf"], fanout, range_rows)
    tops = trees.roots.select(F.lit("").alias("group"), F.col("group").alias("name"), F.col("root").alias("leaf"))
    return Manifest(trees, build(tops, ["name"], fanout, range_rows))


def group_proofs(m: Manifest) -> DataFrame:
    """group, subroot, root, steps: how each group's subroot climbs to the root."""
    schema = pa.schema([("group", pa.string()), ("subroot", pa.binary()), ("steps", _STEPS)])

    def each(span: dict, rows: pa.Table, steps: Iterator[tuple[list[Step], list[Step]]]) -> pa.Table:
        found = [[{"at": a, "members": ms} for a, ms in [*own, *above]] for own, above in steps]
        return pa.table([rows.column("name"), rows.column("leaf"), pa.array(found, _STEPS)], schema=schema)

    found = _climbed(m.groups, None, ["name"], each, "group string, subroot binary, steps array<struct<at int, members array<binary>>>")
    return found.crossJoin(F.broadcast(m.groups.roots.select("root")))  # one row


def proofs(m: Manifest, key_type: str) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256 (of all siblings' digests, level by level, left to right), folded_root (that the given
    leaf has with these siblings), verified (whether it's the root), of every row; digests in hex."""
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]

    def each(span: dict, rows: pa.Table, steps: Iterator[tuple[list[Step], list[Step]]]) -> pa.Table:
        top: list[Step] = [(s["at"], s["members"]) for s in span["steps"]]
        subroot, root = span["subroot"].hex(), span["root"].hex()
        cols: list[list] = [[] for _ in names]
        last, tail, tail_text = None, top, ""
        for leaf, given, (own, above) in zip(rows.column("leaf").to_pylist(), rows.column("given").to_pylist(), steps, strict=True):
            if above is not last:
                last, tail = above, [*above, *top]
                tail_text = "".join([x.hex() for x in siblings(tail)])
            proof = "".join([x.hex() for x in siblings(own)]) + tail_text
            row = (leaf.hex(), subroot, root, hashlib.sha256(proof.encode()).hexdigest(), fold(given, [*own, *tail]).hex())
            for c, x in zip(cols, row, strict=True):
                c.append(x)
        checked = pa.array([a == root for a in cols[-1]], pa.bool_())
        return pa.table([rows.column("key"), *[pa.array(c, pa.string()) for c in cols], checked], names=["key", *names, "verified"])

    schema = f"key {key_type}, " + ", ".join(f"{n} string" for n in names) + ", verified boolean"
    return _climbed(m.rows, group_proofs(m), ["key", "given"], each, schema)


_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13(spark, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified over the whole documents table. A row is tampered with where 5
    divides the crc32 of its doc_id in decimal; a null doc_id is not."""
    docs = table(spark, sf_dir, "documents")
    cols = [F.col(c) for c in _COLUMNS]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    leaf = leaf_hash(*cols)
    given = F.when(tampered, leaf_hash(*cols[:-1], F.translate("text", _UPPER, _LOWER))).otherwise(leaf)
    found = proofs(manifest(docs, "source", "doc_id", leaf, given), docs.schema["doc_id"].dataType.simpleString())
    return found.withColumnRenamed("key", "doc_id")


def _sql(levels: int = 5) -> str:
    """The same by windows and joins, for groups of at most 16^levels rows."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    row = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = "list_reduce([x] || range(8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))"
    crc = f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: {crc.replace('[x]', '[xor(a, b)]')}), 4294967295)"
    whole, lowered = row('"text"'), row(f"translate(\"text\", '{_UPPER}', '{_LOWER}')")
    parts = [f"d AS (SELECT doc_id, source, {whole} AS leaf, CASE WHEN coalesce({crc} % 5 = 0, false) THEN {lowered} ELSE {whole} END AS given, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS spot FROM documents)"]

    def tree(name: str, leaves: str) -> None:
        parts.append(f"{name}0 AS ({leaves})")
        for k in range(levels):
            parts.append(f"{name}r{k} AS (SELECT g, spot // 16 AS run, list(h ORDER BY spot) AS m FROM {name}{k} WHERE w > 1 GROUP BY ALL)")
            parts.append(f"{name}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY g) AS w FROM (SELECT g, run AS spot, sha256(array_to_string(m, '')) AS h FROM {name}r{k}))")
        parts.append(f"{name}top AS (" + " UNION ALL ".join(f"SELECT g, h FROM {name}{k} WHERE w = 1" for k in range(levels + 1)) + ")")

    tree("a", "SELECT source AS g, spot, leaf AS h, count(*) OVER (PARTITION BY source) AS w FROM d")
    tree("b", "SELECT 0 AS g, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS spot, h, count(*) OVER () AS w, g AS source FROM atop")
    # up each level: siblings put together, the given leaf folded
    rest = "m[:p % 16] || {} || m[p % 16 + 2:]"
    step = f"proof || coalesce(array_to_string({rest.format('[]')}, ''), '') AS proof, coalesce(sha256(array_to_string({rest.format('[f]')}, '')), f) AS f, p // 16 AS p"
    parts.append("u0 AS (SELECT *, '' AS proof, given AS f, spot AS p FROM d)")
    for k in range(levels):
        parts.append(f"u{k + 1} AS (SELECT doc_id, source, leaf, {step} FROM u{k} LEFT JOIN ar{k} ON g IS NOT DISTINCT FROM source AND run = p // 16)")
    parts.append(f"v0 AS (SELECT doc_id, leaf, proof, f, spot AS p, h AS subroot FROM u{levels} u JOIN b0 ON b0.source IS NOT DISTINCT FROM u.source)")
    for k in range(levels):
        parts.append(f"v{k + 1} AS (SELECT doc_id, leaf, subroot, {step} FROM v{k} LEFT JOIN br{k} ON run = p // 16)")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM v{levels} CROSS JOIN btop"


OP13_SQL = _sql()
