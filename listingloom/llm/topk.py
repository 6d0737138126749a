"""Exact top-k by inner product: Fagin's threshold algorithm over per-dimension sorted lists, block by block."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingloom.sources.shared import written

#: Distinct vectors in a block of candidates, and in a pack of queries.
BLOCK_VECTORS, PACK_VECTORS = 4096, 1024
#: Entries of every list that the first round reads; each further round reads four times as deep.
FIRST_DEPTH = 8


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component, as double; null if the vector is null or holds null or non-finite components."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & whole, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class Lists:
    """A block of integer vectors with one list per dimension, sorted by component."""

    def __init__(self, vectors: np.ndarray, largest: int):
        """largest: the largest size of a component on either side; it decides which arithmetic is exact."""
        bound = vectors.shape[1] * largest * largest
        kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object
        self.largest, self.vectors = largest, vectors.astype(kind)
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(self.vectors, self.order.T, axis=0)
        # Deeper rounds would read more entries than the block has items.
        n, depth, self.depths = len(vectors), FIRST_DEPTH, []
        while depth < n and (not self.depths or depth * vectors.shape[1] <= n):
            self.depths.append(depth)
            depth *= 4

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """What an item that no list has shown down to each depth can score at most, by query and depth."""
        inner = np.array(self.depths, dtype=np.int64)
        high, low = self.sorted[len(self.vectors) - 1 - inner], self.sorted[inner]
        return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T

    def _round(self, query: np.ndarray, before: int, depth: int, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items that the lists show between two depths for the first time, and their scores: from the top where the
        query's component is positive, from the bottom where it is negative."""
        up, down, n = np.flatnonzero(query > 0), np.flatnonzero(query < 0), len(seen)
        shown = np.concatenate((self.order[up, n - depth : n - before].reshape(-1), self.order[down, before:depth].reshape(-1)))
        fresh = np.unique(shown)
        fresh = fresh[~seen[fresh]]
        seen[fresh] = True
        return fresh, self.vectors[fresh] @ query

    def top(self, queries: np.ndarray, floors: list[float], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Per query: places and scores of all items that may be among the k best and score at least its floor, and how
        many items were scored.

        Round by round, the lists are read deeper and new items are scored in full. A query stops when the bound of what
        is unseen lies below its kth score so far, or below the floor; an equal score may still win by its id. Queries
        that no list round can stop are scored against the rest of the block together.
        """
        n, bounds = len(self.vectors), self.bounds(queries)
        done: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        floors = list(floors)
        for q, query in enumerate(queries):
            seen, places, scores = np.zeros(n, dtype=bool), [], []
            for r, depth in enumerate(self.depths):
                fresh, got = self._round(query, self.depths[r - 1] if r else 0, depth, seen)
                places.append(fresh)
                scores.append(got)
                all_scores = np.concatenate(scores)
                if len(all_scores) >= k:
                    floors[q] = max(floors[q], np.partition(all_scores, len(all_scores) - k)[len(all_scores) - k])
                if bounds[q, r] < floors[q]:
                    every = np.concatenate(places)
                    fit = all_scores >= floors[q]
                    done[q] = every[fit], all_scores[fit], len(every)
                    break
        open_queries = [q for q in range(len(queries)) if q not in done]
        products = queries[open_queries] @ self.vectors.T
        for q, scores in zip(open_queries, products, strict=True):
            places = np.flatnonzero(scores >= floors[q])
            if len(places) > k:
                fit = scores[places]
                places = places[fit >= np.partition(fit, len(fit) - k)[len(fit) - k]]
            done[q] = places, scores[places], n
        for q in range(len(queries)):
            yield done[q]


def _matrix(rows: pa.ListArray) -> np.ndarray:
    """Vectors as rows of a matrix, filled up with zeros."""
    cuts = rows.offsets.to_numpy().astype(np.int64)
    sizes, flat = np.diff(cuts), rows.values.to_numpy()[cuts[0] : cuts[-1]]
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _widened(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows with a column `vector` in lists of about `size` of them, by a hash of the vector: number, rows.

    No list outgrows a block, as each row is of another vector.
    """
    number = F.pmod(F.xxhash64("vector"), F.lit(max(1, math.ceil(rows.count() / size))))
    return rows.groupBy(number.alias("number")).agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))


def _searched(packs: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The candidates of every query in the block that its pack is sent to: query, score, id.

    packs: block, rows (query, vector, bar); blocks: number, rows (vector, ids).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, vectors, lists = None, [], np.zeros((0, 0), dtype=np.int64), None
        for batch in batches:
            for i in range(batch.num_rows):
                if number != batch.column("number")[i].as_py():
                    number, rows = batch.column("number")[i].as_py(), batch.column("rows")[i].values
                    ids, vectors, lists = rows.field("ids").to_pylist(), _matrix(rows.field("vector")), None
                asked = batch.column("asked")[i].values
                queries = _matrix(asked.field("vector"))
                width = max(vectors.shape[1], queries.shape[1], 1)
                largest = max(int(np.abs(x).max(initial=0)) for x in (vectors, queries))
                if lists is None or lists.largest < largest or lists.vectors.shape[1] != width:
                    lists = Lists(_widened(vectors, width), largest)
                floors = [-math.inf if bar is None else bar for bar in asked.field("bar").to_pylist()]
                found = lists.top(_widened(queries, width).astype(lists.vectors.dtype), floors, k)
                out: list[tuple[int, int, int]] = []
                for query, (places, scores, _) in zip(asked.field("query").to_pylist(), found, strict=True):
                    best = sorted((-int(s), x) for p, s in zip(places, scores, strict=True) for x in ids[p])[:k]
                    out += [(query, -s, x) for s, x in best]
                columns = zip(*out, strict=True) if out else ([], [], [])
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["query", "score", "id"])

    met = packs.select("block", F.col("rows").alias("asked")).join(blocks, F.col("block") == F.col("number"))
    return met.select("number", "rows", "asked").mapInArrow(run, "query long, score long, id long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors, each with its k smallest ids: of equal vectors no other can be among the k best."""
    order = Window.partitionBy("vector").orderBy("id")
    few = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def top_k(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """The k highest inner products of every query with all other rows: query_id, rank (from 1), id, score.

    Vectors are quantised first (quantised()). Queries are the rows of `df` that `is_query` selects; candidates are all
    rows but the query's own. Ties go to the smaller id; a query with fewer candidates gets them all. Rows with a null
    id, or a vector that is null or holds null or non-finite components, take no part; shorter vectors count as filled
    up with zeros; a score beyond 64 bits is an error. Rows that share an id are queries and candidates each of its own.

    Equal vectors are searched once and count as candidates with their k + 1 smallest ids only. Candidates are dealt into
    blocks of about BLOCK_VECTORS, queries into packs; every pack meets every block, the stated queries against all rows.
    One block, searched first, gives every query a bar, so that the other blocks stop early and emit little.
    """
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), quantised(F.col(f"`{vector}`"), scale).alias("vector"), is_query.alias("asks"))
    # The number of a row holds from here on, as the rows are read back from where they are written.
    rows = written(rows.filter("id is not null and vector is not null").withColumn("row", F.monotonically_increasing_id()), "topk-rows")
    blocks = written(_packed(_classes(rows.select("id", "vector"), k + 1), BLOCK_VECTORS), "topk-blocks")
    numbers = [r["number"] for r in blocks.select("number").collect()]
    if not numbers:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.col("id").alias("score")).limit(0)
    # Queries with one vector are one query, known by its smallest row.
    asked = rows.filter("asks").groupBy("vector").agg(F.min("row").alias("query"))
    seeds = _packed(asked.withColumn("bar", F.lit(None).cast("long")), PACK_VECTORS)
    sent = seeds.withColumn("block", F.explode(F.array(F.lit(numbers[0]))))
    seeds = written(_best(_searched(sent, blocks, k + 1), k + 1), "topk-seeds")
    bars = seeds.filter(F.col("place") == k + 1).select("query", F.col("score").alias("bar"))
    found = seeds.select("query", "score", "id")
    if numbers[1:]:
        sent = _packed(asked.join(bars, "query", "left").select("vector", "query", "bar"), PACK_VECTORS)
        others = sent.withColumn("block", F.explode(F.array(*map(F.lit, numbers[1:]))))
        found = found.unionByName(_searched(others, blocks, k + 1))
    best = _best(found, k + 1).select("query", "score", F.col("id").alias("other"))
    own = F.aggregate("vector", F.lit(0).cast("long"), lambda total, x: total + x * x).alias("own")
    mine = rows.filter("asks").join(asked, "vector").select("row", F.col("id").alias("query_id"), "query", own)
    # The query's own row is one of those with its id and its score, which are alike in the result: the first of them goes.
    per_row = Window.partitionBy("row")
    place = F.row_number().over(per_row.orderBy(F.col("score").desc(), "other"))
    near = mine.join(best, "query").withColumn("place", place)
    mine_at = F.min(F.when((F.col("other") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("place"))).over(per_row)
    near = near.withColumn("mine_at", mine_at).filter("mine_at is null or place != mine_at")
    rank = (F.col("place") - F.when(F.col("place") > F.col("mine_at"), 1).otherwise(0)).cast("int")
    return near.select("query_id", rank.alias("rank"), F.col("other").alias("id"), "score").filter(F.col("rank") <= k)
