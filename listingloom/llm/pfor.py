"""Token ids in binary files: blocks packed by patched frame of reference, an index of their starts, and the documents.

A file holds the ids of consecutive documents as one stream, cut into blocks of 1,024 ids. All numbers are little-endian.

    file   = MAGIC, blocks, ends, docs, index, foot
    block  = u4 least, u2 width, u2 exceptions, width planes of 128 bytes, u2 place of each exception, u4 value of each
    index  = u8 place of each block in the file, and of the end of the last
    ends   = u8 end of each document in the stream
    docs   = i8 document id, u1 whether there is one, of each document
    foot   = u8 documents, u8 ids, u8 places of ends, docs and index, MAGIC

A block's ids less their least are stored in `width` bits, bit by bit: plane k has bit k of all 1,024 ids. The width is
that of the 90th percentile; ids that need more have their full difference in the exceptions. The last block is filled up
with its least id.
"""

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from listingloom.llm import files
from listingloom.llm import texts as t
from listingloom.llm.pieces import Encoder, Layout, byte_letters
from listingloom.llm.worker import kept

MAGIC = b"PFORIDS1"
BLOCK = 1024
#: Texts encoded at once, in bytes; a word is looked up once in each.
SLICE_BYTES = 8 << 20
_HEAD = np.dtype([("least", "<u4"), ("width", "<u2"), ("exceptions", "<u2")])
_FOOT = np.dtype([("docs", "<u8"), ("ids", "<u8"), ("ends", "<u8"), ("keys", "<u8"), ("index", "<u8"), ("magic", "S8")])


def pack(ids: np.ndarray, percentile: int = 90) -> list[bytes]:
    """Blocks of ids, BLOCK at a time; the number of ids is a multiple of BLOCK."""
    blocks = ids.astype(np.uint32).reshape(-1, BLOCK)
    least = blocks.min(axis=1, initial=2**32 - 1)
    rest = blocks - least[:, None]
    rank = -(-BLOCK * percentile // 100) - 1
    width = np.searchsorted(np.uint64(1) << np.arange(33, dtype=np.uint64), np.partition(rest, rank, axis=1)[:, rank], side="right")
    packed: list[bytes] = [b""] * len(blocks)
    for w in np.unique(width):
        chosen = np.flatnonzero(width == w)
        some = rest[chosen]
        planes = np.empty((len(chosen), w, BLOCK // 8), dtype=np.uint8)
        for k in range(w):
            planes[:, k] = np.packbits((some >> np.uint32(k)).astype(np.uint8) & 1, axis=1, bitorder="little")
        row, place = np.nonzero(some >> np.uint64(w)) if w < 32 else (np.zeros(0, dtype=np.int64),) * 2
        first = np.searchsorted(row, np.arange(len(chosen) + 1))
        heads = np.zeros(len(chosen), dtype=_HEAD)
        heads["least"], heads["width"], heads["exceptions"] = least[chosen], w, np.diff(first)
        for i, at in enumerate(chosen):
            a, b = first[i], first[i + 1]
            packed[at] = b"".join((heads[i].tobytes(), planes[i].tobytes(), place[a:b].astype("<u2").tobytes(), some[i, place[a:b]].astype("<u4").tobytes()))
    return packed


def unpack(data: bytes | memoryview, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at these places of the data."""
    raw = np.frombuffer(data, dtype=np.uint8)
    heads = raw[starts[:, None] + np.arange(_HEAD.itemsize)].copy().view(_HEAD)[:, 0]
    out = np.empty((len(starts), BLOCK), dtype=np.uint32)
    for w in np.unique(heads["width"]):
        chosen = np.flatnonzero(heads["width"] == w)
        values = np.zeros((len(chosen), BLOCK), dtype=np.uint32)
        at = starts[chosen] + _HEAD.itemsize
        for k in range(w):
            plane = raw[(at + k * (BLOCK // 8))[:, None] + np.arange(BLOCK // 8)]
            values |= np.unpackbits(plane, axis=1, bitorder="little").astype(np.uint32) << np.uint32(k)
        at = at + int(w) * (BLOCK // 8)
        n = heads["exceptions"][chosen].astype(np.int64)
        rows = np.repeat(np.arange(len(chosen)), n)
        within = t.ragged(np.zeros(len(n), dtype=np.int64), n)
        place = np.repeat(at, n) + 2 * within
        places = raw[place[:, None] + np.arange(2)].copy().view("<u2")[:, 0]
        value = np.repeat(at + 2 * n, n) + 4 * within
        values[rows, places] = raw[value[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
        out[chosen] = values + heads["least"][chosen][:, None]
    return out.reshape(-1)


@dataclass
class _Written(WriterCommitMessage):
    shard: dict | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, home: str, percentile: int, tokenizer: str | None, end: int | None):
        self.home, self.percentile, self.tokenizer, self.end = home, percentile, tokenizer, end

    def _ids(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """Document ids, token ids and their counts, batch by batch."""
        if self.tokenizer is None:
            for batch in iterator:
                raw, starts = t.as_bytes(batch.column("ids"))
                yield batch.column("doc_id"), np.frombuffer(raw, dtype="<u4"), np.diff(starts) // 4
            return
        library = kept(("library", self.tokenizer), lambda: Library(self.tokenizer))
        for part in t.slices(iterator, "text", SLICE_BYTES, keeps=("library",)):
            ids, counts = library.ids(part.column("text"))
            if self.end is not None:
                ids, counts = np.insert(ids, np.cumsum(counts), np.uint32(self.end)), counts + 1
            yield part.column("doc_id"), ids, counts

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        part = TaskContext.get().partitionId()
        name = f"part-{part:08d}-{uuid.uuid4().hex}.pfor"
        system, folder = files.created(self.home)
        path = f"{folder}/{name}"
        keys, known, counts, places, at = [], [], [], [], len(MAGIC)
        left = np.zeros(0, dtype=np.uint32)
        with system.open_output_stream(path) as out:
            out.write(MAGIC)

            def put(ids: np.ndarray) -> int:
                end = at
                for block in pack(ids, self.percentile):
                    places.append(end)
                    end += len(block)
                    out.write(block)
                return end

            for docs, ids, n in self._ids(iterator):
                keys.append(docs.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                known.append(docs.is_valid().to_numpy(zero_copy_only=False).astype("u1"))
                counts.append(n)
                left = np.concatenate((left, ids))
                whole = len(left) // BLOCK * BLOCK
                at, left = put(left[:whole]), left[whole:]
            total = sum(int(n.sum()) for n in counts)
            if len(left):
                at = put(np.concatenate((left, np.full(BLOCK - len(left), left.min(), dtype=np.uint32))))
            ends = np.cumsum(np.concatenate([*counts, np.zeros(0, dtype=np.int64)])).astype("<u8").tobytes()
            docs = b"".join(x.tobytes() for x in keys) + b"".join(x.tobytes() for x in known)
            foot = np.array([(len(ends) // 8, total, at, at + len(ends), at + len(ends) + len(docs), MAGIC)], dtype=_FOOT)
            out.write(ends + docs + np.array([*places, at], dtype="<u8").tobytes() + foot.tobytes())
        if not len(ends):
            files.drop(f"{self.home}/{name}")
            return _Written(None)
        return _Written({"part": part, "file": name, "docs": len(ends) // 8, "ids": total})

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        shards = sorted((m.shard for m in messages if m and m.shard), key=lambda s: s["part"])
        start = 0
        for shard in shards:
            shard["start"] = start
            start += shard["ids"]
        files.created(self.home)
        files.write_json(f"{self.home}/manifest.json", shards)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m and m.shard:
                files.drop(f"{self.home}/{m.shard['file']}")


class _Shard(InputPartition):
    def __init__(self, file: str, start: int):
        super().__init__(file)
        self.file, self.start = file, start


class _Reader(DataSourceReader):
    def __init__(self, home: str, columns: list[str], blocks: int):
        self.home, self.columns, self.blocks = home, columns, blocks

    def partitions(self) -> list[InputPartition]:
        return [_Shard(s["file"], s["start"]) for s in files.read_json(f"{self.home}/manifest.json")]

    def read(self, partition: _Shard | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file at all
            return
        system, path = files.opened(f"{self.home}/{partition.file}")
        with system.open_input_file(path) as file:
            size = file.size()
            foot = np.frombuffer(file.read_at(_FOOT.itemsize, size - _FOOT.itemsize), dtype=_FOOT)[0]
            if foot["magic"] != MAGIC:
                raise ValueError(f"{partition.file}: not a file of token ids")
            n, end_at, key_at, index_at = (int(foot[k]) for k in ("docs", "ends", "keys", "index"))
            ends = np.frombuffer(file.read_at(8 * n, end_at), dtype="<u8").astype(np.int64)
            keys = np.frombuffer(file.read_at(8 * n, key_at), dtype="<i8")
            known = np.frombuffer(file.read_at(n, key_at + 8 * n), dtype="u1").astype(bool)
            index = np.frombuffer(file.read_at(size - _FOOT.itemsize - index_at, index_at), dtype="<u8").astype(np.int64)
            first = 0
            while first < n:  # whole documents at a time, about `blocks` blocks or one longer document
                start = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, start + self.blocks * BLOCK, side="right")))
                a, b = start // BLOCK, -(-int(ends[last - 1]) // BLOCK)
                data = file.read_at(int(index[b] - index[a]), int(index[a]))
                ids = unpack(data, index[a:b] - index[a])[start - a * BLOCK : int(ends[last - 1]) - a * BLOCK]
                cuts = np.concatenate(([start], ends[first:last])) - start
                made = {"doc_id": lambda: pa.array(keys[first:last], pa.int64(), mask=~known[first:last]),
                        "start": lambda: pa.array(cuts[:-1] + start + partition.start, pa.int64()),
                        "n_tokens": lambda: pa.array(np.diff(cuts), pa.int64()),
                        "ids_crc32": lambda: pa.array(
                            [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.int64()),
                        "ids": lambda: pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(ids.astype(np.int64)))}
                yield pa.record_batch([made[c]() for c in self.columns], names=self.columns)
                first = last


class TokenIds(DataSource):
    """Format "token_ids". Written: rows (doc_id long, ids binary of little-endian u4), or with the option tokenizer, a
    file, rows (doc_id long, text string) that are encoded here, with the id in the option end after each. One file per
    partition, in order, and a manifest that makes them visible together. Read: any of the columns of schema(), only those that are asked for
    by .schema(...) being made; one task per file, read in runs of whole documents through the index of block starts."""

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<bigint>"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        end = self.options.get("end")
        percentile = int(self.options.get("percentile", "90"))
        return _Writer(self.options["path"], percentile, self.options.get("tokenizer"), None if end is None else int(end))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema.names, int(self.options.get("blocks", "1024")))


class Library:
    """Ids by the tokenizers library: of single pieces where the file's pieces lie within words, else of whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        layout = Layout(path)
        letters = dict(enumerate(byte_letters()))
        model = self.tokenizer.model

        def encode(piece: str) -> list[int]:
            plain = piece.isascii() and piece.isalnum()  # such letters stand for themselves
            return [x.id for x in model.tokenize(piece if plain else piece.encode().decode("latin-1").translate(letters))]

        self.encoder = Encoder(layout, encode) if layout.wordwise else None

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.encoder:
            return self.encoder.ids(texts)
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        counts = np.array([len(x) for x in found], dtype=np.int64)
        return np.fromiter((i for x in found for i in x), dtype=np.uint32, count=int(counts.sum())), counts


def write_ids(df: DataFrame, folder: str, path: str, end: int | None, key: str = "doc_id", text: str = "text") -> None:
    """Encodes every text with the tokenizer file at `path`, appends the id `end` to each (none if null), and writes
    the ids to `folder` in ascending order of the key: nulls first, rows with one key by their text.

    A null text counts as an empty one. Rows are dealt by ranges of (key, hash of the text), so neither many rows
    without a key nor many with the same key meet in one task; a task holds about 8 MB of texts at a time. Files of failed tasks are
    not in the manifest. An empty table gives a folder with an empty manifest.
    """
    df.sparkSession.dataSource.register(TokenIds)

    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    writer = dealt.write.format("token_ids").option("tokenizer", path)
    (writer if end is None else writer.option("end", str(end))).mode("append").save(folder)


def read_ids(spark: SparkSession, folder: str, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids")) -> DataFrame:
    """The documents of a folder that write_ids made: key, start among the ids of all documents, number of ids, crc32, ids."""
    spark.dataSource.register(TokenIds)
    kinds = {"ids": "array<bigint>"}
    return spark.read.format("token_ids").schema(", ".join(f"{c} {kinds.get(c, 'long')}" for c in columns)).load(folder)
