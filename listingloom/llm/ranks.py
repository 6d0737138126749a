"""Places of rows in the order of their ids within groups, from compressed bitmaps and not from a sort of the rows.

The ids of a group are a bitmap, cut into containers of 65,536 ids: up to 4,096 ids as an array of 16-bit numbers, more
as 8,192 bytes of bits. Tasks build containers of what they read, those of one place are merged, and a directory holds how
many rows come before each container. A row's place is that number plus the rank of its id in its container: a popcount
up to its bit, from a popcount per 64-bit word kept beside the bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listingloom.llm import buckets
from listingloom.sources.shared import written

#: Ids of a container, in bits, and the most that are kept as an array.
LOW_BITS = 16
MOST_LISTED = 4096

_CONTAINERS = "tree string, high long, ids binary, n long, again array<long>, extra array<long>"


def container(low: np.ndarray) -> bytes:
    """A container of ascending, distinct ids below 65,536."""
    if len(low) <= MOST_LISTED:
        return low.astype("<u2").tobytes()
    flags = np.zeros(1 << LOW_BITS, dtype=np.uint8)
    flags[low] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def members(data: bytes, n: int) -> np.ndarray:
    """The ascending ids of a container of n."""
    if n <= MOST_LISTED:
        return np.frombuffer(data, dtype="<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little"))


class Ranks:
    """Rank queries on many containers at once."""

    def __init__(self, data: list[bytes], n: np.ndarray):
        self.wide = n > MOST_LISTED
        self.place = np.where(self.wide, np.cumsum(self.wide), np.cumsum(~self.wide)) - 1
        words = np.frombuffer(b"".join(d for d, w in zip(data, self.wide) if w), dtype="<u8").reshape(-1, 1 << LOW_BITS - 6)
        counts = np.bitwise_count(words).astype(np.int64)
        self.words, self.directory = words, np.cumsum(counts, axis=1) - counts
        lists = [np.frombuffer(d, dtype="<u2") for d, w in zip(data, self.wide) if not w]
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        self.first = np.cumsum(sizes) - sizes
        low = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, dtype=np.int64)
        self.listed = (np.repeat(np.arange(len(lists)), sizes) << LOW_BITS) | low

    def below(self, at: np.ndarray, low: np.ndarray) -> np.ndarray:
        """How many ids of container at[i] are below low[i]."""
        out = np.zeros(len(at), dtype=np.int64)
        wide, place = self.wide[at], self.place[at]
        w, x = place[wide], low[wide]
        mask = (np.uint64(1) << (x & 63).astype(np.uint64)) - np.uint64(1)
        out[wide] = self.directory[w, x >> 6] + np.bitwise_count(self.words[w, x >> 6] & mask).astype(np.int64)
        w, x = place[~wide], low[~wide]
        out[~wide] = np.searchsorted(self.listed, (w << LOW_BITS) | x) - self.first[w] if len(w) else 0
        return out


def _grouped(tree: np.ndarray, ids: np.ndarray, counts: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Containers of (tree, id) pairs with their counts; repeated pairs are added up."""
    order = np.lexsort((ids, tree))
    tree, ids, counts = tree[order], ids[order], counts[order]
    new = np.concatenate(([True], (tree[1:] != tree[:-1]) | (ids[1:] != ids[:-1])))
    first = np.flatnonzero(new)
    tree, ids, counts = tree[first], ids[first], np.add.reduceat(counts, first)
    high = ids >> LOW_BITS
    cuts = np.append(np.flatnonzero(np.concatenate(([True], (tree[1:] != tree[:-1]) | (high[1:] != high[:-1])))), len(ids))
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        part, n = ids[a:b], counts[a:b]
        more = n > 1
        rows.append((names[tree[a]], int(high[a]), container(part & (1 << LOW_BITS) - 1), b - a, part[more].tolist(), (n[more] - 1).tolist()))
    columns = list(zip(*rows))
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in _CONTAINERS.split(", ")])


def bucket(tree: F.Column, high: F.Column, n: int) -> F.Column:
    return F.pmod(F.xxhash64(tree, high), F.lit(n))


def containers(keys: DataFrame) -> DataFrame:
    """Containers of all rows (tree, id): tree, high, ids, n (distinct ids), again and extra (ids of several rows, and how many more)."""
    n = buckets.count(keys.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            tree = table.column("tree").combine_chunks().dictionary_encode()
            ids = table.column("id").to_numpy()
            return _grouped(tree.indices.to_numpy(), ids, np.ones(len(ids), dtype=np.int64), tree.dictionary.to_pylist())

        parts, held = [], 0
        for batch in batches:
            parts.append(batch)
            held += batch.num_rows
            if held >= buckets.GATHERED:
                yield flush(parts)
                parts, held = [], 0
        if held:
            yield flush(parts)

    def merge(table: pa.Table) -> pa.Table:
        tree = table.column("tree").combine_chunks().dictionary_encode()
        parts = [members(d, n) + (h << LOW_BITS) for d, n, h in zip(*(table.column(c).to_pylist() for c in ("ids", "n", "high")))]
        owner = np.repeat(tree.indices.to_numpy(), [len(p) for p in parts])
        more = table.column("again").combine_chunks()
        ids = np.concatenate([*parts, more.flatten().to_numpy()])
        counts = np.concatenate([np.ones(len(owner), dtype=np.int64), table.column("extra").combine_chunks().flatten().to_numpy()])
        owner = np.concatenate([owner, np.repeat(tree.indices.to_numpy(), more.value_lengths().to_numpy())])
        return pa.Table.from_batches([_grouped(owner, ids, counts, tree.dictionary.to_pylist())])

    built = keys.select("tree", "id").mapInArrow(build, _CONTAINERS)
    dealt = built.withColumn("bucket", bucket(F.col("tree"), F.col("high"), n))
    return dealt.groupBy("bucket").applyInArrow(merge, _CONTAINERS)


def running(df: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """The rows with `name`: the sum of `value` over the rows of their group that come before them in `order`.

    The rows are dealt by range; each range is summed alone and starts from the sums of the ranges before it.
    """
    ranged = written(df.repartitionByRange(group, order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy(group, "_range").agg(F.sum(value).alias("_sum")).select(group, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(base, [group, "_range"])
    return summed.withColumn(name, F.col("_base") + F.col("_inside")).drop("_range", "_base", "_inside")


def _ties(rows: DataFrame) -> DataFrame:
    """Rows that share tree and id (or have no id) with `offset`, their place among those: by digest, equal rows in any order.

    A group of them may be a third of all rows, so places are sums: over parts of the digests' range, within a part over
    digests, within equal rows over the partitions they were read in, and within those over their rows.
    """
    key = [F.col("tree"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("key")]
    rows = rows.select(*key, "id", "digest", F.substring("digest", 1, 2).alias("part"), F.shiftright("row", 33).alias("task"), "row")

    def before(df: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
        window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum("n").over(window), F.lit(0)))

    by = ["tree", "key", "part", "digest"]
    tasks = rows.groupBy(*by, "task").agg(F.count("*").alias("n"))
    digests = tasks.groupBy(*by).agg(F.sum("n").alias("n"))
    parts = digests.groupBy("tree", "key", "part").agg(F.sum("n").alias("n"))
    found = before(tasks, by, "task", "in_digest").drop("n").join(before(digests, by[:-1], "digest", "in_part").drop("n"), by).join(before(parts, ["tree", "key"], "part", "in_key").drop("n"), by[:-1])
    placed = rows.withColumn("in_task", F.row_number().over(Window.partitionBy(*by, "task").orderBy("row")) - 1).join(found, [*by, "task"])
    return placed.select("tree", "key", "row", (F.col("in_key") + F.col("in_part") + F.col("in_digest") + F.col("in_task")).alias("offset"))


def placed(rows: DataFrame, payload: list[str]) -> DataFrame:
    """tree, id, pos, total, payload: the rows with their place in their tree, from 0, and the number of its rows.

    Rows (tree, id, digest, row, payload) are a stored table, where `row` is monotonically_increasing_id(). They come by
    id, then by digest; those without an id last.
    """
    spark = rows.sparkSession
    n = buckets.count(spark)
    made = written(containers(rows.filter("id is not null")), "containers")
    counted = made.withColumn("rows", F.col("n") + F.aggregate("extra", F.lit(0).cast("long"), lambda a, b: a + b))
    directory = written(running(counted, "tree", "high", "rows", "before"), "directory")
    totals = rows.groupBy("tree").agg(F.count("*").alias("total"), F.count("id").alias("with_id"))
    again = written(made.select("tree", F.explode("again").alias("id")), "repeated-ids")

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    plain = rows.filter("id is not null").join(again, ["tree", "id"], "left_anti").select("tree", "id", "row", *payload)
    heads = again.select("tree", "id", *(F.lit(None).cast(kinds[c]).alias(c) for c in ["row", *payload]))
    asked = plain.unionByName(heads).withColumn("bucket", bucket(F.col("tree"), F.shiftright("id", LOW_BITS), n))
    columns = ["tree", "id", "row", *payload]

    def rank(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({c: left.column(c) for c in columns} | {"pos": pa.array([], pa.int64())})
        highs, trees = right.column("high").to_numpy(), right.column("tree").to_pylist()
        known = {t: i for i, t in enumerate(dict.fromkeys(trees))}
        owner = np.array([known[t] for t in trees])
        sizes, before = right.column("n").to_numpy(), right.column("before").to_numpy()
        order = np.lexsort((highs, owner))
        ids = left.column("id").to_numpy()
        encoded = left.column("tree").combine_chunks().dictionary_encode()
        tree = np.array([known[t] for t in encoded.dictionary.to_pylist()])[encoded.indices.to_numpy()]
        # Containers by (tree, high): every pair that is asked for exists.
        lowest = highs.min()
        span = int(highs.max() - lowest) + 1
        if span < (1 << 62) // len(known):
            at = order[np.searchsorted((owner * span + (highs - lowest))[order], tree * span + ((ids >> LOW_BITS) - lowest))]
        else:
            pairs = {(o, h): i for i, (o, h) in enumerate(zip(owner.tolist(), highs.tolist()))}
            at = np.array([pairs[p] for p in zip(tree.tolist(), (ids >> LOW_BITS).tolist())])
        pos = before[at] + Ranks(right.column("ids").to_pylist(), sizes).below(at, ids & (1 << LOW_BITS) - 1)
        extra = right.column("extra").combine_chunks()
        if len(extra.flatten()):
            lengths = extra.value_lengths().to_numpy()
            of, more = np.repeat(np.arange(len(lengths)), lengths), extra.flatten().to_numpy()
            repeated = right.column("again").combine_chunks().flatten().to_numpy()
            for c in np.unique(of):
                mine = np.flatnonzero(at == c)
                sums = np.concatenate(([0], np.cumsum(more[of == c])))
                pos[mine] += sums[np.searchsorted(repeated[of == c], ids[mine])]
        return pa.table({c: left.column(c) for c in columns} | {"pos": pa.array(pos, pa.int64())})

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "pos long"])
    dealt = directory.withColumn("bucket", bucket(F.col("tree"), F.col("high"), n))
    ranked = written(asked.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInArrow(rank, schema), "ranked")
    alone = ranked.filter("row is not null").select("tree", "id", "pos", *payload)
    if again.isEmpty() and rows.filter("id is null").isEmpty():
        return alone.join(totals.select("tree", "total"), "tree")

    without = totals.filter(F.col("with_id") < F.col("total")).select("tree", F.lit("").alias("key"), F.col("with_id").alias("base"))
    bases = ranked.filter("row is null").select("tree", F.col("id").cast("string").alias("key"), F.col("pos").alias("base")).unionByName(without)
    tied = rows.join(again, ["tree", "id"], "left_semi").unionByName(rows.filter("id is null"))
    several = tied.join(_ties(tied).join(bases, ["tree", "key"]).select("row", (F.col("base") + F.col("offset")).alias("pos")), "row").select("tree", "id", "pos", *payload)
    return alone.unionByName(several).join(totals.select("tree", "total"), "tree")
