"""Byte-level BPE: each distinct word is encoded once, documents are put together by position."""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_folder
from .common import arrow_schema, as_batch, in_batches, with_field

#: Characters of text whose words share one dictionary.
BLOCK_CHARS = 8_000_000
#: Words, at most, that a task keeps with their ids from one block to the next.
KNOWN_WORDS = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its id a line. Its size is bounded by the vocabulary."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Rows (id, ids array<int>) with the BPE ids of every whole text, without special tokens.

    1. Each task cuts its texts into pre-tokens and keeps, per block of texts, a dictionary of
       distinct words; a document becomes the list of its words' places, in order.
    2. The distinct words of all blocks are shuffled by hash, packed per block, so that equal
       words meet in one task, which encodes each of them once.
    3. The ids go back to the blocks, where documents are put together by position.

    The documents' places are written once, bucketed by block, and are not shuffled again; a
    frequent word costs one dictionary entry per block, so there are no hot words. One text is
    never cut. A null text is an empty one and has no ids; every row gives a row, repeated or
    null ids included; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"block long, id {id_type}, places binary, shard int, at binary, lengths binary, words binary"
    name = f"bpe_blocks_{uuid.uuid4().hex}"
    (
        rows.mapInArrow(_block_function(pattern, width, block_chars), schema)
        .write.option("path", scratch_folder(spark, "bpe"))
        .option("compression", "zstd")
        .bucketBy(width, "block")
        .saveAsTable(name)
    )
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and no entry is left in the catalog
    words = blocks.where("shard IS NOT NULL").select("block", "shard", "at", "lengths", "words")
    coded = words.repartition(width, "shard").mapInArrow(_word_function(ranks), "block long, at binary, sizes binary, ids binary")
    places = blocks.where("shard IS NULL").select("block", "id", "places")
    return (
        places.groupBy("block")
        .cogroup(coded.groupBy("block"))
        .applyInArrow(_assemble, f"id {id_type}, ids array<int>")
        .withColumnRenamed("id", id_col)
    )


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", bytes_col: str = "bytes") -> DataFrame:
    """``encoded`` plus the bytes that its ids stand for.

    The table of token bytes is bounded by the vocabulary, so every task joins it by place.
    Null ids give null bytes. An unknown id raises an error.
    """
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(ids_col)
            made = [None if x is None else b"".join(map(table.__getitem__, x)) for x in _lists(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, bytes_col])

    return encoded.mapInArrow(run, with_field(encoded.schema, bytes_col, "binary"))


def ranks_table(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """The vocabulary as rows (id, bytes), for plain joins."""
    return spark.createDataFrame([(i, bytearray(t)) for t, i in ranks.items()], "id int, bytes binary")


def _lists(column: pa.Array) -> Iterator[list[int] | None]:
    for i in range(len(column)):
        value = column[i]
        yield value.values.to_numpy(zero_copy_only=False).tolist() if value.is_valid else None


def _block_function(pattern: str, shards: int, block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        cut = regex.compile(pattern).findall
        task, number = TaskContext.get().partitionId(), 0
        schema = None
        places, known, chars = [], {}, 0
        for batch in batches:
            schema = schema or _block_schema(batch.schema.field("id").type)
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                found = [known.setdefault(w, len(known)) for w in cut(text)]
                places.append((task << 32 | number, key, np.array(found, dtype="<u4").tobytes(), None, None, None, None))
                chars += len(text)
                if chars >= block_chars:
                    yield from in_batches(iter(places), schema)
                    yield from in_batches(_packed(task << 32 | number, known, shards), schema)
                    places, known, chars, number = [], {}, 0, number + 1
        if places:
            yield from in_batches(iter(places), schema)
            yield from in_batches(_packed(task << 32 | number, known, shards), schema)

    return run


def _block_schema(id_type: pa.DataType) -> pa.Schema:
    return arrow_schema(block=pa.int64(), id=id_type, places=pa.binary(), shard=pa.int32(), at=pa.binary(), lengths=pa.binary(), words=pa.binary())


def _packed(block: int, known: dict[str, int], shards: int) -> Iterator[tuple]:
    """The dictionary of a block, by shard: places in the dictionary, lengths and bytes of the words."""
    words = [w.encode() for w in known]
    shard = np.fromiter((zlib.crc32(w) for w in words), dtype=np.uint32, count=len(words)) % shards
    order = np.argsort(shard, kind="stable")
    for at in np.split(order, np.nonzero(np.diff(shard[order]))[0] + 1):
        if len(at):
            own = [words[i] for i in at]
            sizes = np.fromiter(map(len, own), dtype=np.uint32, count=len(own))
            yield block, None, None, int(shard[at[0]]), _pack(np.diff(at, prepend=0)), _pack(sizes), zlib.compress(b"".join(own))


def _pack(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2**32, compressed byte by byte: all lowest bytes, then all second ones, and so on."""
    return zlib.compress(np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _word_function(ranks: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        piece = tiktoken.Encoding("words", pat_str="x", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        known: dict[bytes, bytes] = {}
        schema = arrow_schema(block=pa.int64(), at=pa.binary(), sizes=pa.binary(), ids=pa.binary())
        for batch in batches:
            rows = []
            for block, at, lengths, packed in zip(*(batch.column(c).to_pylist() for c in ("block", "at", "lengths", "words")), strict=True):
                data, made, start = zlib.decompress(packed), [], 0
                if len(known) > KNOWN_WORDS:
                    known.clear()
                for end in np.cumsum(_unpack(lengths)).tolist():
                    word = data[start:end]
                    ids = known.get(word)
                    if ids is None:
                        known[word] = ids = np.array(piece(word), dtype="<u4").tobytes()
                    made.append(ids)
                    start = end
                sizes = np.fromiter(map(len, made), dtype=np.uint32, count=len(made)) // 4
                rows.append((block, at, _pack(sizes), _pack(np.frombuffer(b"".join(made), "<u4"))))
            if rows:
                yield as_batch(rows, schema)

    return run


def _assemble(left: pa.Table, right: pa.Table) -> pa.Table:
    """The ids of a block's documents: each word's run of ids, taken in the order of the places."""
    at = [np.cumsum(_unpack(x)) for x in right.column("at").to_pylist()]
    n = sum(map(len, at))
    sizes, parts, starts, base = np.zeros(n, np.int64), [], np.zeros(n, np.int64), 0
    for where, size, ids in zip(at, right.column("sizes").to_pylist(), right.column("ids").to_pylist(), strict=True):
        size = _unpack(size)
        sizes[where] = size
        starts[where] = base + np.cumsum(size) - size
        parts.append(_unpack(ids).astype(np.int32))
        base += len(parts[-1])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    runs, offsets = [], [0]
    for places in left.column("places").to_pylist():
        place = np.frombuffer(places, "<u4")
        size = sizes[place]
        total = int(size.sum())
        first = starts[place] - (np.cumsum(size) - size)
        runs.append(flat[np.repeat(first, size) + np.arange(total)])
        offsets.append(offsets[-1] + total)
    values = pa.array(np.concatenate(runs) if runs else flat[:0], pa.int32())
    ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
    return pa.table({"id": left.column("id").combine_chunks(), "ids": ids})
