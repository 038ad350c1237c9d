"""Two tokenizers' tokens of the same texts, aligned at common byte ends by merge-path pieces."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_folder, stored
from .byte_level import ByteLevel, piece_encoder
from .common import arrow_schema

#: Characters of text whose documents share one block of pair counts.
BLOCK_CHARS = 2_000_000
#: Token ends, of both sides together, in one piece of the merge.
PIECE = 16_384
#: Between the byte places of two pieces that are merged in one go.
_APART = 1 << 40

_PIECE_DDL = "block long, no int, piece int, i long, j long, a_from long, b_from long, a_before int, a binary, b binary"


def align(
    docs: DataFrame,
    first: ByteLevel,
    second: bytes,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
    piece: int = PIECE,
) -> DataFrame:
    """Rows (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for every document.

    Side A is ``first`` on a space and the text, side B the SentencePiece model ``second`` on
    the text. ``groups`` cuts both at the byte places where a token of either side ends, as
    ``a1,a2|b1;a3|b2,b3``. A link is a token of A and one of B that end together; the count of a
    pair of ids is the number of its links in all documents, ``n_best`` those links whose
    count is the highest of their B id, and ``count_sum`` the sum over the links.

    1. Each task encodes its texts and cuts the merge of A's and B's ends into pieces of
       ``piece`` ends: a binary search on each diagonal finds how many ends of either side lie
       before it (``merge_path``). A piece knows its byte places and the token of A before it,
       so it depends on no other. Pieces are stored by blocks of documents.
    2. Pieces are merged on their own, wherever they are read, so that one long text is the work of
       many tasks: every piece gives its overlaps, and those that end together are links
       (``overlaps``). Each block counts its distinct pairs of ids; the sums, and the highest
       of each B id, are joined back to the blocks that hold them.
    3. Blocks are put together: groups reach from one common end to the next, across pieces.

    Texts that are null or empty, or whose tokens on either side do not spell a space and the text,
    have zeros and empty groups. Every row gives a row, repeated and null ids included; a text
    of any length is encoded whole; an empty table gives an empty result; other columns
    are not read.
    """
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    sides = Sides(first, second)
    name = f"aligned_blocks_{uuid.uuid4().hex}"
    (
        rows.mapInArrow(_cut_function(sides, block_chars, piece), f"id {kind}, {_PIECE_DDL}")
        .write.option("path", scratch_folder(spark, "aligned"))
        .option("compression", "zstd")
        .bucketBy(width, "block")
        .saveAsTable(name)
    )
    pieces = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and no entry is left in the catalog
    lengths_a, lengths_b = sides.lengths()
    held = stored(pieces.drop("id").mapInArrow(_pair_function(lengths_a, lengths_b), "block long, a int, b int, n long"), "pairs")
    counted = held.groupBy("a", "b").agg(F.sum("n").alias("count"))
    top = counted.groupBy("b").agg(F.max("count").alias("top"))
    counted = counted.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))
    back = held.select("block", "a", "b").distinct().join(counted, ["a", "b"])
    return (
        pieces.groupBy("block")
        .cogroup(back.groupBy("block"))
        .applyInArrow(
            _assemble_function(lengths_a, lengths_b),
            f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string",
        )
        .withColumnRenamed("id", id_col)
    )


def overlaps(pieces: DataFrame, lengths_a: np.ndarray, lengths_b: np.ndarray) -> DataFrame:
    """Rows (block, no, piece, a, b, ends): places in the document of the tokens that overlap, and whether they end together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = arrow_schema(block=pa.int64(), no=pa.int32(), piece=pa.int32(), a=pa.int64(), b=pa.int64(), ends=pa.bool_())
        for batch in batches:
            merged = Merged(batch, lengths_a, lengths_b)
            piece, a, b, ends = merged.overlaps()
            at = pa.array(piece)
            columns = [batch.column(c).take(at) for c in ("block", "no", "piece")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(a), pa.array(b), pa.array(ends)], schema=types)

    return pieces.mapInArrow(run, "block long, no int, piece int, a long, b long, ends boolean")


class Sides:
    """Both tokenizers as data that travels in tasks: their sizes are bounded by the vocabularies."""

    def __init__(self, first: ByteLevel, second: bytes):
        self.first, self.second = first, second

    def bytes_a(self) -> list[bytes]:
        table = [b""] * (max(self.first.ranks.values(), default=-1) + 1)
        for token, rank in self.first.ranks.items():
            table[rank] = token
        return table

    def bytes_b(self) -> list[bytes]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=self.second)
        table = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            byte = re.fullmatch("<0x([0-9A-Fa-f]{2})>", piece)
            table.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
        return table

    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([len(t) for t in table], np.int64) for table in (self.bytes_a(), self.bytes_b()))


def merge_path(ends_a: np.ndarray, ends_b: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts (i, j) of both sides' ends before every ``step``-th end of their merge, from (0, 0) to the last.

    On each diagonal i + j = d the smallest i is searched for which A's next end lies behind B's
    last; of equal ends A's comes first. All diagonals are searched at once.
    """
    n, m = len(ends_a), len(ends_b)
    d = np.append(np.arange(0, n + m, step), n + m)
    low, high = np.maximum(0, d - m), np.minimum(d, n)
    while (low < high).any():
        open_ = low < high
        mid = (low + high) // 2
        a = ends_a[np.minimum(mid, n - 1)] if n else np.zeros(len(d), np.int64)
        b = ends_b[np.clip(d - mid - 1, 0, max(0, m - 1))] if m else np.zeros(len(d), np.int64)
        more = open_ & (a <= b)
        low = np.where(more, mid + 1, low)
        high = np.where(open_ & ~more, mid, high)
    return low, d - low


def _cut_function(sides: Sides, block_chars: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        encode_a = sides.first.encoder(lead=True)
        encode_b = piece_encoder(sentencepiece.SentencePieceProcessor(model_proto=sides.second))
        table_a, table_b = (pa.array(t, pa.binary()) for t in (sides.bytes_a(), sides.bytes_b()))
        lengths = [pc.binary_length(t).to_numpy() for t in (table_a, table_b)]
        task, block, held, no = TaskContext.get().partitionId() << 32, 0, 0, 0
        for batch in batches:
            sizes = np.array([len(t.as_py()) for t in batch.column("text")], np.int64)
            part = np.cumsum(sizes) // (1 << 20)
            for own in np.split(np.arange(len(sizes)), np.nonzero(np.diff(part))[0] + 1):
                if not len(own):
                    continue
                cut = batch.slice(int(own[0]), len(own))
                texts = cut.column("text").to_pylist()
                ids_a, ids_b = _spelled(texts, encode_a(texts), encode_b(texts), table_a, table_b)
                yield _pieces(cut.column("id"), ids_a, ids_b, *lengths, step, task | block, no)
                no += len(texts)
                held += int(sizes[own].sum())
                if held >= block_chars:
                    block, held, no = block + 1, 0, 0

    return run


def _spelled(texts: list[str], ids_a: list, ids_b: list, table_a: pa.Array, table_b: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Both sides' ids, without any where a text is empty or the tokens spell something else."""
    whole = [(" " + t).encode() if t else b"" for t in texts]
    ids_a, ids_b = ([x if w else x[:0] for x, w in zip(ids, whole, strict=True)] for ids in (ids_a, ids_b))
    want = b"".join(whole)
    if all(_bytes(np.concatenate(ids), table) == want for ids, table in ((ids_a, table_a), (ids_b, table_b))):
        lengths = [_byte_lengths(ids, table) for ids, table in ((ids_a, table_a), (ids_b, table_b))]
        if all(n == [len(w) for w in whole] for n in lengths):
            return ids_a, ids_b
    same = [_bytes(a, table_a) == w == _bytes(b, table_b) for a, b, w in zip(ids_a, ids_b, whole, strict=True)]
    return tuple([x if s else x[:0] for x, s in zip(ids, same, strict=True)] for ids in (ids_a, ids_b))


def _bytes(ids: np.ndarray, table: pa.Array) -> bytes:
    if not len(ids):
        return b""
    taken = table.take(pa.array(ids))
    return taken.buffers()[2][: int(np.frombuffer(taken.buffers()[1], np.int32)[len(ids)])].to_pybytes()


def _byte_lengths(ids: list[np.ndarray], table: pa.Array) -> list[int]:
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(table).to_numpy()[np.concatenate(ids)])])
    places = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    return np.diff(ends[places]).tolist()


def _pieces(keys: pa.Array, ids_a: list, ids_b: list, length_a: np.ndarray, length_b: np.ndarray, step: int, block: int, no: int) -> pa.RecordBatch:
    rows = []
    for at, (a, b) in enumerate(zip(ids_a, ids_b, strict=True)):
        if len(a) + len(b) <= step:
            rows.append((at, no + at, 0, 0, 0, 0, 0, -1, a.tobytes(), b.tobytes()))
            continue
        ends_a, ends_b = np.cumsum(length_a[a]), np.cumsum(length_b[b])
        places = list(zip(*(x.tolist() for x in merge_path(ends_a, ends_b, step)), strict=True))
        for number, ((i, j), (i2, j2)) in enumerate(zip(places, places[1:], strict=False)):
            a_from, b_from = int(ends_a[i - 1]) if i else 0, int(ends_b[j - 1]) if j else 0
            rows.append((at, no + at, number, i, j, a_from, b_from, int(a[i - 1]) if i else -1, a[i:i2].tobytes(), b[j:j2].tobytes()))
    at, *columns = zip(*rows, strict=True)
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    names = ["no", "piece", "i", "j", "a_from", "b_from", "a_before", "a", "b"]
    made = [keys.take(pa.array(at, pa.int64())), pa.array(np.full(len(rows), block)), *map(pa.array, columns, types)]
    return pa.RecordBatch.from_arrays(made, names=["id", "block", *names])


class Merged:
    """The merge of the ends of some pieces, each on its own: ``links`` by piece, with places and ids of both tokens."""

    def __init__(self, pieces: pa.RecordBatch | pa.Table, lengths_a: np.ndarray, lengths_b: np.ndarray):
        flat, self._starts = {}, {}
        for side, table in (("a", lengths_a), ("b", lengths_b)):
            parts = [np.frombuffer(x, np.int32) for x in pieces.column(side).to_pylist()]
            flat[side] = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            count = np.array([len(x) for x in parts], np.int64)
            setattr(self, f"n_{side}", count)
            ends = np.cumsum(table[flat[side]])
            start = np.cumsum(count) - count
            before = np.concatenate([[0], ends])[start]
            base = _numbers(pieces.column(f"{side}_from")) + np.arange(len(parts)) * _APART
            setattr(self, f"owner_{side}", np.repeat(np.arange(len(parts)), count))
            setattr(self, f"ends_{side}", ends + np.repeat(base - before, count))
            first = self._starts[side] = _numbers(pieces.column("i" if side == "a" else "j"))
            setattr(self, f"at_{side}", np.arange(len(flat[side])) + np.repeat(first - start, count))
        self.a, self.b = flat["a"], flat["b"]
        # A token of A that ends where a piece begins meets the first token of B in the piece.
        late_end = _numbers(pieces.column("a_from")) + np.arange(len(self.n_a)) * _APART
        late = (self.n_b > 0) & (_numbers(pieces.column("i")) > 0)
        first_b = (np.cumsum(self.n_b) - self.n_b)[late]
        late[late] = self.ends_b[first_b] == late_end[late]
        first_b = (np.cumsum(self.n_b) - self.n_b)[late]
        place = np.searchsorted(self.ends_a, self.ends_b)
        met = np.zeros(len(self.ends_b), bool)
        inside = place < len(self.ends_a)
        met[inside] = self.ends_a[place[inside]] == self.ends_b[inside]
        self.link_b = np.nonzero(met)[0]
        link_a = place[self.link_b]
        before = _numbers(pieces.column("a_before"))[late].astype(np.int32)
        order = np.argsort(np.concatenate([first_b, self.link_b]), kind="stable")
        self.link_at_a = np.concatenate([_numbers(pieces.column("i"))[late] - 1, self.at_a[link_a]])[order]
        self.link_id_a = np.concatenate([before, self.a[link_a]])[order]
        self.link_b = np.concatenate([first_b, self.link_b])[order]
        self.link_at_b, self.link_id_b = self.at_b[self.link_b], self.b[self.link_b]
        self.link_piece = self.owner_b[self.link_b]
        self.late = late

    def overlaps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Piece, places of A's and B's tokens, and whether they end together: one row per distinct end of a piece.

        An end that both sides share across a border is a row of the later piece only if B's token
        is its first; the earlier piece has it as an end of A alone.
        """
        ends = np.unique(np.concatenate([self.ends_a, self.ends_b]))
        i, j = np.searchsorted(self.ends_a, ends), np.searchsorted(self.ends_b, ends)
        piece = ends // _APART
        start = lambda count: np.cumsum(count) - count
        a = i - start(self.n_a)[piece] + self._starts["a"][piece]
        b = j - start(self.n_b)[piece] + self._starts["b"][piece]
        together = np.isin(ends, self.ends_b[self.link_b])
        late_ends = self.ends_b[(np.cumsum(self.n_b) - self.n_b)[self.late]]
        return piece, np.where(np.isin(ends, late_ends), a - 1, a), b, together


def _numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).to_numpy(zero_copy_only=False).astype(np.int64)


def _pair_function(lengths_a: np.ndarray, lengths_b: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = arrow_schema(block=pa.int64(), a=pa.int32(), b=pa.int32(), n=pa.int64())
        for batch in batches:
            merged = Merged(batch, lengths_a, lengths_b)
            blocks, own = np.unique(_numbers(batch.column("block")), return_inverse=True)
            pair = merged.link_id_a.astype(np.int64) * len(lengths_b) + merged.link_id_b
            block = own[merged.link_piece]
            order = np.lexsort((pair, block))
            pair, block = pair[order], block[order]
            edge = np.nonzero(np.append(True, (np.diff(pair) != 0) | (np.diff(block) != 0)))[0] if len(pair) else np.zeros(0, np.int64)
            n = np.diff(np.append(edge, len(pair)))
            pair, block = pair[edge], block[edge]
            columns = [blocks[block], (pair // len(lengths_b)).astype(np.int32), (pair % len(lengths_b)).astype(np.int32), n]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.types, strict=True)], schema=types)

    return run


def _assemble_function(lengths_a: np.ndarray, lengths_b: np.ndarray):
    # Ids as text, with what follows them: in A a comma, or a bar at a group's end; in B a comma, a semicolon, or nothing.
    n_a, n_b = len(lengths_a), len(lengths_b)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words = pa.array([f"{i}{c}" for n, marks in ((n_a, ",|"), (n_b, ",;")) for c in marks for i in range(n)] + [str(i) for i in range(n_b)], pa.binary())
        left = left.sort_by([("no", "ascending"), ("piece", "ascending")])
        merged = Merged(left, lengths_a, lengths_b)
        docs, first, doc = np.unique(_numbers(left.column("no")), return_index=True, return_inverse=True)
        count = len(docs)
        size_a, size_b = (np.bincount(doc, weights=n, minlength=count).astype(np.int64) for n in (merged.n_a, merged.n_b))
        start_a, start_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        # Links are in order of B's tokens; a group ends at each.
        link_doc = doc[merged.link_piece]
        end_a, end_b = merged.link_at_a + start_a[link_doc], merged.link_at_b + start_b[link_doc]
        group_a = np.searchsorted(end_a, np.arange(len(merged.a)))
        group_b = np.searchsorted(end_b, np.arange(len(merged.b)))
        past_a, past_b = np.concatenate([[0], end_a + 1]), np.concatenate([[0], end_b + 1])
        code = np.zeros(len(merged.a) + len(merged.b), np.int64)
        bar = np.zeros(len(merged.a), bool)
        bar[end_a] = True
        mark = np.zeros(len(merged.b), np.int64)
        mark[end_b] = n_b
        mark[(start_b + size_b - 1)[size_b > 0]] = 2 * n_b
        code[np.arange(len(merged.a)) + past_b[group_a]] = merged.a + bar * n_a
        code[np.arange(len(merged.b)) + past_a[np.minimum(group_b + 1, len(past_a) - 1)]] = 2 * n_a + merged.b + mark
        text = words.take(pa.array(code))
        places = np.frombuffer(text.buffers()[1], np.int32, len(code) + 1) if len(code) else np.zeros(1, np.int32)
        cuts = np.append(start_a + start_b, len(code))
        data = text.buffers()[2] if len(code) else pa.py_buffer(b"")
        groups = pa.Array.from_buffers(pa.string(), count, [None, pa.py_buffer(places[cuts].astype(np.int32).tobytes()), data])
        known = _numbers(right.column("a")) * n_b + _numbers(right.column("b"))
        order = np.argsort(known)
        pair = merged.link_id_a.astype(np.int64) * n_b + merged.link_id_b
        at = order[np.searchsorted(known[order], pair)] if len(pair) else np.zeros(0, np.int64)
        sums = np.zeros(count, np.int64)
        np.add.at(sums, link_doc, _numbers(right.column("count"))[at])
        links = np.bincount(link_doc, minlength=count)
        best = np.bincount(link_doc[_numbers(right.column("best"))[at] > 0], minlength=count)
        columns = [size_a, size_b, links, links, best, sums]
        names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
        made = {"id": left.column("id").take(pa.array(first)).combine_chunks()} | dict(zip(names, (pa.array(c, pa.int64()) for c in columns), strict=True))
        return pa.table(made | {"groups": groups})

    return run
