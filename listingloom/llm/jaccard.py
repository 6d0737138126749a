"""Similarity join of documents by shingles: adaptive prefixes that must match several times before a pair is verified."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from listingloom.llm import buckets, links
from listingloom.llm import texts as t
from listingloom.sources.shared import written

#: Cells of the sketch that estimates how often a shingle occurs: a fixed size, 4 MB where it is broadcast.
CELLS, PARTS = 1 << 22, 64
#: The most matches that a prefix may be lengthened for, and what a verification costs in looks at list entries.
MOST_MATCHES, VERIFY_COST = 4, 20
#: Minimum hashes per document. Each is a hub key, and so is each of the pairs they form: near copies almost surely
#: share some of them, and a pair is seldom shared by anything else.
HUB_HASHES = 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_DRAWS = np.random.default_rng(99).integers(1, 2**63, size=(HUB_HASHES, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Rule:
    """Two documents link when 100 * shared >= percent * united, counted in distinct windows of `words` words."""

    words: int = 5
    percent: int = 80

    def least(self, n: np.ndarray) -> np.ndarray:
        """What a set of n shares at least with any set that it links to."""
        return -(-self.percent * n // 100)


def shingle_sets(column: pa.Array, rule: Rule) -> list[np.ndarray]:
    """The set of every text as sorted 64-bit hashes of its windows; the whole sequence where there are fewer words."""
    data, offsets = t.as_bytes(column)
    words = t.Words(_LOWER[data], offsets)
    keys, places = words.shingles(rule.words)
    cuts = np.searchsorted(places, words.first)
    sets = []
    for i in range(len(column)):
        own = np.sort(keys[cuts[i] : cuts[i + 1]])
        if len(own):
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif words.first[i + 1] > words.first[i]:
            few = np.zeros(1, dtype=np.uint64)
            for key in words.keys[words.first[i] : words.first[i + 1]]:
                few = few * np.uint64(0xC2B2AE3D27D4EB4F) + key
            own = t.mix(few)
        sets.append(own)
    return sets


def node(own: np.ndarray) -> bytes:
    """A name of 128 bits for a set."""
    if not len(own):
        return b""
    return np.array([np.sum(t.mix(own)), np.bitwise_xor.reduce(t.mix(own ^ np.uint64(0xA0761D6478BD642F)))], dtype="<u8").tobytes()


def _first_look(docs: DataFrame, rule: Rule) -> tuple[DataFrame, np.ndarray]:
    """Set size and name of every document, and the sketch over all documents: the power of two below each cell's count."""
    kinds = "doc_id long, n long, node binary, part int, salt int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, dtype=np.uint32)
        for part in t.slices(batches, "text"):
            sets = shingle_sets(part.column("text"), rule)
            if sets:
                where = (np.concatenate(sets) >> np.uint64(64 - 22)).astype(np.int64)
                cells += np.bincount(where, minlength=CELLS).astype(np.uint32)
            n, none = len(sets), pa.nulls(len(sets))
            yield pa.record_batch([
                part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([node(s) or None for s in sets], pa.binary()),
                none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.binary()),
            ], names=["doc_id", "n", "node", "part", "salt", "counts"])
        if cells.any():
            packer, salt = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() % 64
            packed = [packer.compress(x.tobytes()) for x in np.split(cells, PARTS)]
            none = pa.nulls(PARTS)
            yield pa.record_batch([
                none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(range(PARTS), pa.int32()),
                pa.array([salt] * PARTS, pa.int32()), pa.array(packed, pa.binary()),
            ], names=["doc_id", "n", "node", "part", "salt", "counts"])

    def total(group: pa.Table) -> pa.Table:
        unpacker, sums = zstandard.ZstdDecompressor(), np.zeros(CELLS // PARTS, dtype=np.uint64)
        for x in group.column("counts").to_pylist():
            sums += np.frombuffer(unpacker.decompress(x), dtype=np.uint32 if group.column("salt")[0].as_py() >= 0 else np.uint64)
        packed = zstandard.ZstdCompressor(level=1).compress(sums.tobytes())
        return pa.table({"part": group.column("part")[:1], "salt": pa.array([-1], pa.int32()), "counts": pa.array([packed], pa.binary())})

    seen = written(docs.mapInArrow(run, kinds), "jaccard-sizes")
    small = "part int, salt int, counts binary"
    counts = seen.filter("part is not null").select("part", "salt", "counts")
    sums = counts.groupBy("part", "salt").applyInArrow(total, small).groupBy("part").applyInArrow(total, small)
    sketch = np.zeros(CELLS, dtype=np.uint8)
    for r in sums.collect():
        cells = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["counts"]), dtype=np.uint64)
        at = r["part"] * len(cells)
        sketch[at : at + len(cells)] = np.frexp(np.maximum(cells, 1).astype(np.float64))[1] - 1
    return seen.filter("part is null").select("doc_id", "n", "node"), sketch


def prefix(own: np.ndarray, sketch: np.ndarray, rule: Rule) -> tuple[np.ndarray, int]:
    """The prefix of a set, rarest tokens first, and how many of its tokens a partner's prefix must share.

    A token is its estimated frequency's power of two, then the shingle's hash: an order that all documents share. With
    o the least overlap, any partner shares m of the first n - o + m tokens, for every m up to o. More matches cost a
    longer prefix, so more list entries to look at, but fewer pairs share that many: m is where the sum is least.
    """
    n = len(own)
    least = int(rule.least(np.int64(n)))
    tokens = (sketch[(own >> np.uint64(64 - 22)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (own >> np.uint64(6))
    most = max(1, min(MOST_MATCHES, least))
    longest = min(n, n - least + most)
    tokens = np.sort(np.partition(tokens, longest - 1)[:longest])
    looks = np.cumsum(2.0 ** (tokens >> np.uint64(58)).astype(np.float64))
    matches = np.arange(1, most + 1)
    ends = np.minimum(n - least + matches, n)
    cost = looks[ends - 1] + VERIFY_COST * (looks[ends - 1] - ends) / matches
    best = int(np.argmin(cost))
    return tokens[: ends[best]], int(matches[best])


def _hubs(own: np.ndarray) -> list[int]:
    least = np.array([np.min(t.mix((own ^ a) * b)) for a, b in _DRAWS])
    alone = t.mix(least + np.arange(len(least), dtype=np.uint64))
    return np.concatenate((alone, t.mix(least[0::2] * np.uint64(3) + least[1::2]))).view(np.int64).tolist()


def _second_look(docs: DataFrame, sketch: np.ndarray, rule: Rule) -> DataFrame:
    """One row per distinct set: its name, its smallest document, size, matches, prefix, hub keys and how common it is."""
    kinds = "node binary, code long, doc_id long, n long, matches int, tokens binary, hubs array<bigint>, common double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in t.slices(batches, "text"):
            rows = []
            for doc, own in zip(part.column("doc_id").to_pylist(), shingle_sets(part.column("text"), rule), strict=True):
                if len(own) and doc is not None:
                    tokens, matches = prefix(own, sketch, rule)
                    common = float(sketch[(own >> np.uint64(64 - 22)).astype(np.int64)].mean())
                    name = node(own)
                    code = int(np.frombuffer(name[:8], dtype="<i8")[0])
                    rows.append((name, code, doc, len(own), matches, tokens.tobytes(), _hubs(own), round(common, 6)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.float64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=[k.split()[0] for k in kinds.split(", ")])

    same = docs.mapInArrow(run, kinds).groupBy("node")
    firsts = [F.first(c).alias(c) for c in ("code", "n", "matches", "tokens", "hubs", "common")]
    return written(same.agg(F.min("doc_id").alias("doc_id"), *firsts), "jaccard-sets")


def _verified(docs: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, a_id, b, b_id) that link, by their whole sets. Fewer different a than b are best."""
    sets = "node binary, own binary"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in t.slices(batches, "text"):
            found = shingle_sets(part.column("text"), rule)
            yield pa.record_batch([pa.array([node(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "own"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in t.slices(batches, "text"):
            found = []
            for b, own, other in zip(part.column("b").to_pylist(), shingle_sets(part.column("text"), rule), part.column("own").to_pylist(), strict=True):
                mine = np.frombuffer(other, dtype=np.uint64)
                shared = len(np.intersect1d(own, mine, assume_unique=True))
                found.append(node(own) == b and 100 * shared >= rule.percent * (len(own) + len(mine) - shared))
            yield part.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

    left = docs.join(pairs.select(F.col("a_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    left = left.mapInArrow(whole, sets).distinct()
    wide = pairs.join(left.select(F.col("node").alias("a"), "own"), "a").select("a", "b", F.col("b_id").alias("doc_id"), "own")
    return wide.join(docs, "doc_id").select("a", "b", "own", "text").mapInArrow(test, "a binary, b binary").distinct()


def _hub_pairs(sets: DataFrame, rule: Rule) -> DataFrame:
    """Every set with the most common one among those that share a hub key with it, the likely origin of its copies."""
    keyed = sets.select("node", "doc_id", "n", "common", F.explode("hubs").alias("hub"))
    best = F.max(F.struct("common", (-F.col("doc_id")).alias("order"), "node", "doc_id", "n"))
    hubs = keyed.groupBy("hub").agg(best.alias("top"), F.count(F.lit(1)).alias("all")).filter(F.col("all") > 1)
    pairs = keyed.join(hubs, "hub").filter(F.col("node") != F.col("top.node"))
    fit = 100 * F.least("n", "top.n") >= rule.percent * F.greatest("n", "top.n")
    return pairs.filter(fit).select(F.col("top.node").alias("a"), F.col("top.doc_id").alias("a_id"), F.col("node").alias("b"), F.col("doc_id").alias("b_id")).distinct()


def _lists(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """The list entries of tokens that sets of different groups share: token, code (of the set), root (code of its
    group), place. Tokens go to buckets as packed arrays, beside those of the sets that own them."""
    n = buckets.count(sets.sparkSession)
    named = sets.select("node", "tokens").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kinds = "bucket int, tokens binary, places binary, owners binary, codes binary, moved binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]) -> pa.RecordBatch:
            lists = [np.frombuffer(r["tokens"], dtype=np.uint64) for r in rows]
            code, root = (np.frombuffer(b"".join(r[c][:8] for r in rows), dtype=np.int64) for c in ("node", "root"))
            tokens = np.concatenate(lists)
            owner = np.repeat(np.arange(len(rows)), [len(x) for x in lists])
            place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in lists])
            made = []
            for b, (token, at, own) in buckets.dealt(t.mix(tokens), [tokens, place, owner], n):
                few, number = np.unique(own, return_inverse=True)
                # Most sets are a group of their own: what is stored is the difference, mostly zeros.
                arrays = (token, at, number.astype(np.int32), code[few], code[few] ^ root[few])
                made.append((b, *(x.tobytes() for x in arrays)))
            columns = list(zip(*made, strict=True))
            return pa.record_batch([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=[k.split()[0] for k in kinds.split(", ")])

        rows, gathered = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                rows.append(r)
                gathered += len(r["tokens"]) // 8
                if gathered >= buckets.GATHERED:
                    yield out(rows)
                    rows, gathered = [], 0
        if rows:
            yield out(rows)

    def meet(group: pa.Table) -> pa.Table:
        tokens, places = buckets.joined(group.column("tokens"), "<u8"), buckets.joined(group.column("places"), "<i4")
        codes, moved = buckets.joined(group.column("codes"), "<i8"), buckets.joined(group.column("moved"), "<i8")
        own, base = [], 0
        for numbers, some in zip(group.column("owners").to_pylist(), group.column("codes").to_pylist(), strict=True):
            own.append(np.frombuffer(numbers, dtype="<i4").astype(np.int64) + base)
            base += len(some) // 8
        owner = np.concatenate(own)
        root = (codes ^ moved)[owner]
        order = np.lexsort((root, tokens))
        token, of = tokens[order], root[order]
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        last = np.append(first[1:], len(token)) - 1
        kept = order[np.repeat(of[first] != of[last], last - first + 1)]
        return pa.table({
            "token": pa.array(tokens[kept].view(np.int64)), "code": pa.array(codes[owner[kept]]),
            "root": pa.array(root[kept]), "place": pa.array(places[kept]),
        })

    packed = named.select("node", "root", "tokens").mapInArrow(deal, kinds)
    return packed.groupBy("bucket").applyInArrow(meet, "token long, code long, root long, place int")


def _candidates(lists: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of different groups that share enough tokens of their prefixes and may still overlap enough.

    Before its entry at `place` a set has `before` tokens that other groups share; the others there are shared with none.
    So a pair that meets at an entry shares at most the smaller `before`, this token, and the shorter rest. With m matches
    needed, only its first m common tokens have to be seen, and before those it shares at most m - 1.
    """
    facts = sets.select("code", "node", "doc_id", "n", "matches")
    entries = lists.join(facts, "code").withColumn("before", F.row_number().over(Window.partitionBy("node").orderBy("place")) - 1)
    entries = written(entries.withColumn("rest", F.col("n") - F.col("place") - 1), "jaccard-lists")
    x, y = entries.alias("x"), entries.alias("y")
    needed = F.least("x.matches", "y.matches")
    most = F.least("x.before", "y.before", needed - 1) + 1 + F.least("x.rest", "y.rest")
    met = x.join(
        y,
        (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.node") < F.col("y.node"))
        & (100 * F.least("x.n", "y.n") >= rule.percent * F.greatest("x.n", "y.n"))
        & ((100 + rule.percent) * most >= rule.percent * (F.col("x.n") + F.col("y.n"))),
    )
    ends = [F.col(f"{side}.{c}").alias(name) for side, c, name in (("x", "node", "a"), ("x", "doc_id", "a_id"), ("y", "node", "b"), ("y", "doc_id", "b_id"))]
    pairs = met.groupBy(*ends).agg(F.count(F.lit(1)).alias("shared"), F.first(needed).alias("needed"))
    return pairs.filter(F.col("shared") >= F.col("needed")).select("a", "a_id", "b", "b_id")


def near_duplicates(df: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_shingles (size of its set), component_id (the smallest key it reaches by links).

    Words are runs without white space after A-Z are lower-cased; a document's set holds its distinct windows of
    `rule.words` words, or its whole sequence where it has fewer. Two documents link as `rule` says. Without words, or with a
    null text, a set is empty and linked with nothing. A row with a null key links with nothing and has a null component.
    Rows with one key are documents of their own that share a name.

    Equal sets are one node, so copies are never paired. Most near copies then meet the likely origin of their group
    and, verified, join it. For what is left, each set's rarest tokens are listed; only tokens that different groups share
    go on, and pairs that share enough of them and can still overlap enough are verified by whole sets. No bucket,
    list or partner is capped. Frequencies come from a sketch of fixed size over all documents; they order tokens and set
    the cost, not the result.
    """
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    sizes, sketch = _first_look(docs, rule)
    sets = _second_look(docs, sketch, rule)
    first = written(_verified(docs, written(_hub_pairs(sets, rule), "jaccard-hub-pairs"), rule), "jaccard-links")
    groups = written(links.components(first), "jaccard-groups")
    pairs = written(_candidates(_lists(sets, groups), sets, rule), "jaccard-pairs")
    second = written(_verified(docs, pairs, rule), "jaccard-links")
    roots = written(links.components(first.union(second)), "jaccard-roots")
    named = sets.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    component = named.select("node", "root").join(least, "root").select("node", "component_id")
    out = sizes.join(component, "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))
