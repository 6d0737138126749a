"""Merkle manifest of a dataset: a tree per group over its rows in the order of their ids, and one over the groups.

ranks.py gives every row its place without a sort. Nodes with the same place // 2^BITS share a slot array, keyed by tree
and that number; each array goes up BITS levels in one step and leaves one node for the next round. Paths come down the
same rounds: what lies beside a node within its array, then what lies beside the array's own node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingloom.llm import ranks
from listingloom.sources.shared import written

#: Levels that a slot array goes up at once; it has 2^BITS slots.
BITS = 8
#: The columns of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_SIZE = 32
#: A level of a path: nothing beside the node, or a digest on its left or right.
_NONE, _LEFT, _RIGHT = 0, 1, 2


def _hash(*digests: bytes) -> bytes:
    """The digest of digests, taken as hexadecimal text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def levels_of(n: int) -> int:
    """How often n nodes are halved, rounded up, until one is left."""
    return max(0, n - 1).bit_length()


def levels(nodes: list[bytes], up: int) -> list[list[bytes]]:
    """The nodes, and those of every level up to `up` above them. Two neighbours make a node, the last alone if need be."""
    out = [nodes]
    for _ in range(up):
        nodes = [_hash(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def path(tree: list[list[bytes]], slot: int) -> bytes:
    """What lies beside the way from a slot to the top of its array: per level a flag, and a digest if there is one."""
    out = []
    for nodes in tree[:-1]:
        other = slot ^ 1
        out.append(bytes([_NONE]) if other >= len(nodes) else bytes([_LEFT if slot & 1 else _RIGHT]) + nodes[other])
        slot >>= 1
    return b"".join(out)


def steps(way: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at < len(way):
        flag, size = way[at], 0 if way[at] == _NONE else _SIZE
        out.append((flag, way[at + 1 : at + 1 + size]))
        at += 1 + size
    return out


def folded(node: bytes, way: list[tuple[int, bytes]]) -> bytes:
    """The top that a node and what lies beside its way give."""
    for flag, other in way:
        node = _hash(node) if flag == _NONE else _hash(other, node) if flag == _LEFT else _hash(node, other)
    return node


def _cut(digests: bytes) -> list[bytes]:
    return [digests[i : i + _SIZE] for i in range(0, len(digests), _SIZE)]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One array at a time as Python objects."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _arrays(nodes: DataFrame, round: int, carried: list[str] = []) -> DataFrame:
    """Slot arrays of nodes (tree, pos, total, digest): tree, block, total, round, slots (their digests), top, and lists of `carried`.

    `total` is the number of leaves of the tree, so every array knows whether it is the only one of its level.
    """
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")  # one array's slots: at most 2^BITS rows
        total = table.column("total")[0].as_py()
        there = -(-total >> BITS * round)
        digests = table.column("digest").to_pylist()
        top = levels(digests, levels_of(there) if there <= 1 << BITS else BITS)[-1][0]
        row = {"tree": table.column("tree")[0].as_py(), "block": table.column("block")[0].as_py(), "total": total, "slots": b"".join(digests), "top": top}
        return pa.table({k: [v] for k, v in row.items()} | {c: pa.array([table.column(c).to_pylist()], pa.list_(table.schema.field(c).type)) for c in carried})

    schema = ", ".join(["tree string, block long, total long, slots binary, top binary", *(f"`{c}` array<{kinds[c]}>" for c in carried)])
    keyed = nodes.select("tree", F.shiftright("pos", BITS).alias("block"), "pos", "total", "digest", *carried)
    return keyed.groupBy("tree", "block").applyInArrow(fill, schema)


def _reduced(table: DataFrame, most: int) -> list[DataFrame]:
    """All rounds of slot arrays above the stored arrays of round 0, for trees of at most `most` leaves; the last have one each."""
    rounds = [table]
    while most > 1 << BITS * len(rounds):
        nodes = rounds[-1].select("tree", F.col("block").alias("pos"), "total", F.col("top").alias("digest"))
        rounds.append(written(_arrays(nodes, len(rounds)), "merkle-slots"))
    return rounds


def _paths(slots: DataFrame, round: int, above: DataFrame) -> DataFrame:
    """tree, pos, way, subroot, root: of every slot of these arrays, from (tree, pos, way, ...) of the arrays' own nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                nodes, there = _cut(row["slots"]), -(-row["total"] >> BITS * round)
                tree = levels(nodes, levels_of(there) if there <= 1 << BITS else BITS)
                n = len(nodes)
                yield pa.record_batch(
                    [[row["tree"]] * n, [(row["block"] << BITS) + i for i in range(n)], [path(tree, i) + row["way"] for i in range(n)], [row["subroot"]] * n, [row["root"]] * n],
                    schema=pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("way", pa.binary()), ("subroot", pa.binary()), ("root", pa.binary())]),
                )

    joined = slots.select("tree", "block", "total", "slots").join(above.withColumnRenamed("pos", "block"), ["tree", "block"])
    return joined.mapInArrow(run, "tree string, pos long, way binary, subroot binary, root binary")


def _down(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Paths of the nodes that the arrays of round 0 leave, from `tops`: those of the trees' own tops."""
    found = tops.select("tree", F.lit(0).cast("long").alias("pos"), "way", "subroot", "root")
    for round in range(len(rounds) - 1, 0, -1):
        found = _paths(rounds[round], round, found)
    return found


def field(name: str) -> F.Column:
    """`-` for null, else the bytes of the value as text, a colon and the value."""
    value = F.col(f"`{name}`").cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def tampered() -> F.Column:
    """Whether the contract's tampering hits a row."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 0


def manifest(df: DataFrame, group: str = "lang", changed: F.Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per row of `df`, digests as lower-case hex.

    A leaf is the digest of FIELDS. The rows of a group are a tree in the order of doc_id, and the trees' tops, by group
    (null first, then by bytes), are one too. proof_sha256 is the digest of all that lies beside a row's way to the root;
    folded_root is what its leaf and those give, and verified whether that is the root.

    `changed` marks rows that are verified with 1 added to n_chars (null stays). Null fields count as `-`. Rows without
    doc_id come last in their group; rows of one doc_id and group come by leaf, and equal ones in any order, which gives
    the same rows. Empty texts and equal rows are leaves like others. Columns other than FIELDS and `group` are not looked
    at. An empty table has no rows here either.

    Only digests are moved: a row goes to its bitmap container, then to its slot array of at most 2^BITS rows.
    """
    spark = df.sparkSession
    digest = lambda *fields: F.unhex(F.sha2(F.concat(*fields).cast("binary"), 256))
    more = F.col("n_chars") + 1
    fields = {c: field(c) for c in FIELDS}
    bad = fields | {"n_chars": F.coalesce(F.concat(F.octet_length(more.cast("string")).cast("string"), F.lit(":"), more.cast("string")), F.lit("-"))}
    hit = F.lit(False) if changed is None else changed
    rows = written(df.select(
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("")).alias("tree"), F.col("doc_id").cast("long").alias("id"), digest(*fields.values()).alias("digest"),
        F.when(hit, digest(*bad.values())).alias("other"), F.monotonically_increasing_id().alias("row"),
    ), "merkle-leaves")
    leaves = ranks.placed(rows, ["digest", "other"])

    first = written(_arrays(leaves, 0, ["id", "other"]), "merkle-slots")
    most = rows.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    rounds = _reduced(first, most)
    tops = written(rounds[-1].select("tree", F.col("top").alias("subroot")), "merkle-tops")

    n_trees = tops.count()
    placed = ranks.running(tops.withColumns({"all": F.lit(""), "one": F.lit(1)}), "all", "tree", "one", "pos")
    over = written(_arrays(placed.select(F.lit("").alias("tree"), "pos", F.lit(n_trees).cast("long").alias("total"), F.col("subroot").alias("digest"), F.col("tree").alias("name")), 0, ["name"]), "merkle-slots")
    upper = _reduced(over, n_trees)
    root = upper[-1].select("tree", F.lit(b"").alias("way"), F.lit(None).cast("binary").alias("subroot"), F.col("top").alias("root"))
    ways = _paths(over, 0, _down(upper, root))
    names = over.select(F.posexplode("name").alias("slot", "name"), "block").select("name", (F.shiftleft("block", BITS) + F.col("slot")).alias("pos"))
    above = names.join(ways.select("pos", "way", "root"), "pos").join(tops.withColumnRenamed("tree", "name"), "name")
    at = written(above.select(F.col("name").alias("tree"), "way", "subroot", "root"), "merkle-tops")
    found = first.join(_down(rounds, at).withColumnRenamed("pos", "block"), ["tree", "block"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                nodes = _cut(row["slots"])
                tree = levels(nodes, levels_of(row["total"]) if row["total"] <= 1 << BITS else BITS)
                way = steps(row["way"])
                beside = "".join(other.hex() for _, other in way)
                subroot, root = row["subroot"].hex(), row["root"].hex()
                tops, out = {}, []
                for i, (node, other) in enumerate(zip(nodes, row["other"])):
                    own = steps(path(tree, i))
                    proof = hashlib.sha256(("".join(x.hex() for _, x in own) + beside).encode()).hexdigest()
                    top = folded(node if other is None else other, own)
                    if top not in tops:
                        tops[top] = folded(top, way).hex()
                    out.append((row["id"][i], node.hex(), subroot, root, proof, tops[top], tops[top] == root))
                columns = list(zip(*out))
                yield pa.record_batch([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:6]), pa.array(columns[6], pa.bool_())], names=names)

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    return found.select("id", "total", "slots", "other", "way", "subroot", "root").mapInArrow(verify, schema)


def _crc32(text: str) -> str:
    """DuckDB SQL for the CRC-32 of an ASCII text, bit by bit."""
    bit = "CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, x), range(8)), lambda v, i: {bit})"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)), lambda c, x: {byte}), 4294967295)"


def oracle() -> str:
    """DuckDB SQL for the manifest of `documents` by lang, with the contract's tampering."""

    def leaf(**changed: str) -> str:
        values = [f"CAST({changed.get(c, c)} AS VARCHAR)" for c in FIELDS]
        return f"sha256(concat({', '.join(f"coalesce(concat(CAST(strlen({v}) AS VARCHAR), ':', {v}), '-')" for v in values)}))"

    up = "list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(concat(nodes[2 * i + 1], nodes[2 * i + 2])))"
    step = "CASE WHEN xor(pos >> level, 1) >= len(nodes) THEN 'N' ELSE concat(CASE WHEN (pos >> level) & 1 = 1 THEN 'L' ELSE 'R' END, nodes[xor(pos >> level, 1) + 1]) END"
    fold = "CASE s[1] WHEN 'N' THEN sha256(node) WHEN 'L' THEN sha256(concat(s[2:], node)) ELSE sha256(concat(node, s[2:])) END"
    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {leaf()} AS leaf, CASE WHEN {_crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % 7 = 0 THEN {leaf(n_chars="(n_chars + 1)")} END AS other FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos FROM leaves),
tree(lang, level, nodes) AS (
  SELECT lang, 0, list(leaf ORDER BY pos) FROM placed GROUP BY lang
  UNION ALL SELECT lang, level + 1, {up} FROM tree WHERE len(nodes) > 1),
subroots AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM tree WHERE len(nodes) = 1),
tops(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY pos) FROM subroots
  UNION ALL SELECT level + 1, {up} FROM tops WHERE len(nodes) > 1),
upper_steps AS (SELECT lang, list({step} ORDER BY level) AS steps FROM subroots, tops WHERE len(nodes) > 1 GROUP BY lang),
lower_steps AS (SELECT placed.lang, pos, list({step} ORDER BY level) AS steps FROM placed JOIN tree ON placed.lang IS NOT DISTINCT FROM tree.lang AND len(nodes) > 1 GROUP BY placed.lang, pos),
ways AS (
  SELECT doc_id, leaf, other, subroot, (SELECT nodes[1] FROM tops WHERE len(nodes) = 1) AS root, list_concat(coalesce(l.steps, []), coalesce(u.steps, [])) AS steps
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang LEFT JOIN upper_steps u ON p.lang IS NOT DISTINCT FROM u.lang
  LEFT JOIN lower_steps l ON p.lang IS NOT DISTINCT FROM l.lang AND p.pos = l.pos),
folded AS (SELECT *, list_reduce(list_prepend(coalesce(other, leaf), steps), lambda node, s: {fold}) AS folded_root FROM ways)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(steps, lambda s: s[2:]), 'string_agg', ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded
"""
