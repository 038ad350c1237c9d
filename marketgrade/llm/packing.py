"""Best-fit packing: documents as token pieces, packed into sequences by bulk-synchronous rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .byte_level import ByteLevel
from .common import arrow_schema, fresh

#: Characters of text that are encoded at a time.
SLICE_CHARS = 4_000_000
#: Bounds of the size bands, as numbers of equal items that fill a sequence; each band is packed in turn.
BANDS = (1, 2, 3, 4, 6, 10, 24)
#: Pieces and slots of a range, about; most rounds are small, and a task for each shuffle partition would cost more than they do.
RANGE_ROWS = 50_000


def token_pieces(
    docs: DataFrame, tokens: ByteLevel, end_id: int, size: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (uid, id, piece, start, length, ids): every document's ids and ``end_id``, in pieces of ``size``.

    Only documents of more than ``size`` ids are cut: all their pieces are full but the first,
    which may be shorter. ``ids`` holds little-endian unsigned 32-bit ids; ``uid`` numbers the
    pieces of a table that is stored right after. A null text is an empty one, which has the
    end id alone. Every row gives its pieces, repeated and null ids included; other columns are
    not read. A text of any length is one document of one task.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = tokens.encoder(), TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths = np.array([len(t.as_py()) for t in batch.column("text")], np.int64)
            part = np.cumsum(lengths) // SLICE_CHARS
            for own in np.split(np.arange(len(lengths)), np.nonzero(np.diff(part))[0] + 1):
                if len(own):
                    cut = batch.slice(int(own[0]), len(own))
                    made = _pieces(cut.column("id"), encode(cut.column("text").to_pylist()), end_id, size, base)
                    base += made.num_rows
                    yield made

    return rows.mapInArrow(run, f"uid long, id {kind}, piece int, start long, length int, ids binary").withColumnRenamed("id", id_col)


def _pieces(keys: pa.Array, ids: list[np.ndarray], end_id: int, size: int, base: int) -> pa.RecordBatch:
    flat = np.concatenate([y for x in ids for y in (x, [end_id])]).astype("<u4")
    total = np.array([len(x) + 1 for x in ids], np.int64)
    count = -(-total // size)
    owner = np.repeat(np.arange(len(ids)), count)
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    first = total - (count - 1) * size
    start = np.where(piece == 0, 0, first[owner] + (piece - 1) * size)
    length = np.where(piece == 0, first[owner], size)
    ends = np.concatenate([[0], np.cumsum(length)]).astype("<i4") * 4
    packed = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(flat.tobytes())])
    types = arrow_schema(uid=pa.int64(), id=keys.type, piece=pa.int32(), start=pa.int64(), length=pa.int32(), ids=pa.binary())
    columns = [pa.array(base + np.arange(len(owner))), keys.take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length, pa.int32()), packed]
    return pa.RecordBatch.from_arrays(columns, schema=types)


def pack(pieces: DataFrame, size: int = 1024, length_col: str = "length", uid_col: str = "uid") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: best fit, largest pieces first, in bulk rounds.

    Pieces are packed band by band, from the largest to the smallest. In a round the band's
    pieces and all open gaps are range-sorted together by falling size; a gap with room for
    several pieces is several slots. A sweep over each range gives every piece the smallest free
    slot before it (``_sweep``); what a range leaves over, pieces at its front and slots at its
    end, is matched across ranges by rank, where one row per range goes through the driver.
    Gaps are then lowered, and the sweep is repeated while one of them can take a piece that is
    left. Pieces that fit nowhere open new sequences, the longest first: of those of which k
    fill a sequence, every k neighbours in the order share one; the rest is swept again.

    A sequence is known by the ``uid`` of the piece that opened it, so ids need no counter. Hot
    lengths are no hot keys: ranges are cut by length and uid. Only sizes and uids are sorted;
    ``pieces`` are stored once and joined at the end. Every round is stored in the shared
    checkpoint folder. ``uid`` must be unique and not null, lengths from 1 to ``size``; other
    lengths raise an error. Ties go by uid. An empty table gives an empty result; columns
    named like the two results are replaced.
    """
    spark = pieces.sparkSession
    pieces = stored(pieces.drop("sequence_id", "offset"), "pieces")
    items = pieces.select(F.col(uid_col).alias("uid"), F.col(length_col).cast("int").alias("len"))
    wrong = F.col("len").isNull() | ~F.col("len").between(1, size)
    band = sum((F.floor(F.lit(size) / F.greatest("len", F.lit(1))) > k).cast("int") for k in BANDS)
    bands = items.groupBy(band.alias("band")).agg(F.max(wrong).alias("wrong"), F.min("len").alias("low"), F.max("len").alias("high")).collect()
    if any(b.wrong for b in bands):
        raise ValueError(f"lengths must be from 1 to {size}")
    placed, gaps = [], None
    for b in sorted(bands, key=lambda b: b.band):
        left = items.where(F.col("len").between(b.low, b.high))
        if b.band == 0:
            # Two of these never share a sequence, and there is no gap yet.
            new = left.select("uid", F.col("uid").alias("bin"), F.lit(0).alias("offset"), F.col("len"))
            placed.append(new)
            gaps = _gaps(new, None, size)
            continue
        rounds = _Rounds(left, gaps, b.low, b.high, size)
        rounds.run()
        placed += rounds.placed
        gaps = rounds.gaps
    if not placed:
        return pieces.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    found = placed[0]
    for more in placed[1:]:
        found = found.unionByName(more)
    key = fresh(pieces, "_uid")
    found = found.select(F.col("uid").alias(key), F.col("bin").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
    return pieces.join(found, F.col(uid_col) == F.col(key)).drop(key)


def _gaps(placed: DataFrame, kept: DataFrame | None, size: int) -> DataFrame:
    """Open gaps (bin, gap) after ``placed``, the last piece of each bin, and those ``kept`` as they are."""
    new = placed.select("bin", (F.lit(size) - F.col("offset") - F.col("len")).alias("gap")).where("gap > 0")
    return stored(new if kept is None else new.unionByName(kept), "gaps")


class _Rounds:
    """The rounds of one band: ``placed`` collects (uid, bin, offset, len), ``gaps`` is (bin, gap) after each."""

    def __init__(self, left: DataFrame, gaps: DataFrame | None, low: int, high: int, size: int):
        self.spark, self.left, self.low, self.high, self.size = left.sparkSession, left, low, high, size
        self.gaps = gaps if gaps is not None else self.spark.createDataFrame([], "bin long, gap int")
        self.placed: list[DataFrame] = []

    def run(self) -> None:
        high = self.high
        while True:
            swept = stored(_sweep(self.left, self.gaps, self.low, high), "swept")
            parts = swept.groupBy("part").agg(F.expr("count_if(uid IS NOT NULL AND bin IS NULL) AS items"), F.expr("count_if(uid IS NULL) AS gaps"))
            spans, served = _across([(r.part, r.items, r.gaps) for r in parts.collect()])
            matched = swept.where("uid IS NOT NULL AND bin IS NOT NULL").select("uid", "bin", "gap", "len")
            items, slots = swept.where("uid IS NOT NULL AND bin IS NULL"), swept.where("uid IS NULL")
            if spans:
                matched = matched.unionByName(self._joined(items, slots, spans))
                table = F.broadcast(self.spark.createDataFrame(list(served.items()), "part int, served long"))  # one row per range
                items = items.join(table, "part", "left").where("rank >= coalesce(served, 0)").drop("served")
            before = Window.partitionBy("bin").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
            offset = F.lit(self.size) - F.col("gap") + F.coalesce(F.sum("len").over(before), F.lit(0))
            matched = stored(matched.select("uid", "bin", offset.cast("int").alias("offset"), "len"), "matched")
            self.placed.append(matched)
            used = matched.groupBy("bin").agg(F.sum("len").alias("used"))
            lower = self.gaps.join(used, "bin", "left").select("bin", (F.col("gap") - F.coalesce("used", F.lit(0))).cast("int").alias("gap"))
            self.gaps = stored(lower.where("gap > 0"), "gaps")
            ends = items.select("len", F.lit(None).cast("int").alias("gap")).unionByName(self.gaps.select(F.lit(None).cast("int").alias("len"), "gap"))
            least, high, most = ends.agg(F.min("len"), F.max("len"), F.max("gap")).first()
            if least is None:
                return
            self.left = items.select("uid", "len")
            if (most or 0) >= least:
                continue
            new, least_opened = self._opened(items)
            new = stored(new, "opened")
            self.placed.append(new.drop("last"))
            self.gaps = _gaps(new.where("last").drop("last"), self.gaps, self.size)
            if least_opened <= least:
                return
            self.left, high = self.left.where(F.col("len") < least_opened), least_opened - 1

    def _joined(self, items: DataFrame, slots: DataFrame, spans: list[tuple]) -> DataFrame:
        """Pieces and slots left over in different ranges, joined by the rank that ``spans`` give them.

        There are at most two spans per range, so the list is bounded by the number of ranges.
        """
        table = F.broadcast(self.spark.createDataFrame(spans, "part int, low long, high long, gap_part int, shift long"))
        at = items.join(table, "part").where("rank >= low AND rank < high").selectExpr("uid", "len", "gap_part AS part", "rank + shift AS rank")
        return at.join(slots.select("part", "rank", "bin", "gap"), ["part", "rank"]).select("uid", "bin", "gap", "len")

    def _opened(self, items: DataFrame) -> tuple[DataFrame, int]:
        """New sequences for the longest pieces, about half of all ids that are left, and the least length so placed.

        Of pieces of which k fill a sequence, k neighbours by their rank in the whole order share one.
        Shorter pieces wait for the gaps that these leave.
        """
        items = items.withColumn("k", F.floor(F.lit(self.size) / F.col("len")).cast("int"))
        found = items.groupBy("part", "k").agg(F.min("rank").alias("first"), F.count("*").alias("n"), F.sum("len").alias("ids"))
        counts = sorted((r.k, r.part, r.first, r.n, r.ids) for r in found.collect())
        shifts, before, open_, left = [], {}, 0, sum(c[4] for c in counts)
        for k, part, first, n, ids in counts:
            if open_ >= max(left / 2, self.size) and k not in before:
                break
            open_ += ids
            shifts.append((part, k, before.get(k, 0) - first))
            before[k] = before.get(k, 0) + n
        least = self.size // (max(before) + 1) + 1
        table = F.broadcast(self.spark.createDataFrame(shifts, "part int, k int, shift long"))
        numbered = items.join(table, ["part", "k"]).withColumn("n", F.col("rank") + F.col("shift"))
        chunk = numbered.groupBy("k", F.expr("n div k").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("n", "uid", "len"))).alias("own"))
        before_it = F.expr("aggregate(slice(own, 1, at), 0, (s, x) -> s + x.len)")
        new = chunk.selectExpr("own", "posexplode(own) AS (at, one)").select(
            F.col("one.uid").alias("uid"),
            F.col("own")[0].uid.alias("bin"),
            before_it.cast("int").alias("offset"),
            F.col("one.len").alias("len"),
            (F.col("at") == F.size("own") - 1).alias("last"),
        )
        return new, least


def _sweep(items: DataFrame, gaps: DataFrame, low: int, high: int) -> DataFrame:
    """Rows (uid, bin, gap, len, part, rank) of one round over ranges of falling size.

    A gap that holds several pieces of the longest length, ``high``, is so many equal slots. In
    each range, a piece takes the last slot before it that is free, which is the smallest one
    that holds it. A piece with a bin is matched. A piece without one has its rank among those
    left over in its range, a slot without a piece its rank from the range's end. The number of
    ranges follows the rows; the packing does not depend on it.
    """
    slots = F.greatest(F.lit(1), F.floor(F.col("gap") / high)).cast("int")
    slots = gaps.where(F.col("gap") >= low).select(F.floor(F.col("gap") / slots).cast("int").alias("size"), F.lit(0).alias("kind"), F.col("bin").alias("key"), "gap", F.explode(F.sequence(F.lit(1), slots)).alias("slot"))
    both = slots.unionByName(items.select(F.col("len").alias("size"), F.lit(1).alias("kind"), F.col("uid").alias("key"), F.lit(0).alias("gap"), F.lit(0).alias("slot")))
    order = [F.col("size").desc(), F.col("kind").asc(), F.col("key").asc(), F.col("slot").asc()]
    types = arrow_schema(uid=pa.int64(), bin=pa.int64(), gap=pa.int32(), len=pa.int32(), part=pa.int32(), rank=pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, free, lost = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            rows = []
            for size, kind, key, gap in zip(*(batch.column(c).to_pylist() for c in ("size", "kind", "key", "gap")), strict=True):
                if kind == 0:
                    free.append((key, gap))
                elif free:
                    rows.append((key, *free.pop(), size, part, None))
                else:
                    rows.append((key, None, None, size, part, lost))
                    lost += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.types, strict=True)], schema=types)
        if free:
            n = len(free)
            bins, sizes = zip(*reversed(free), strict=True)
            none = pa.nulls(n, pa.int64())
            columns = [none, pa.array(bins, pa.int64()), pa.array(sizes, pa.int32()), pa.nulls(n, pa.int32()), pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(n))]
            yield pa.RecordBatch.from_arrays(columns, schema=types)

    width = max(1, -(-both.count() // RANGE_ROWS))
    sorted_ = both.repartitionByRange(width, *order).sortWithinPartitions(*order)
    return sorted_.mapInArrow(run, "uid long, bin long, gap int, len int, part int, rank long")


def _across(parts: list[tuple[int, int, int]]) -> tuple[list[tuple], dict[int, int]]:
    """Spans (part, low, high, gap_part, shift) of pieces that take slots of earlier ranges, and pieces so served by range.

    Ranges come with their numbers of pieces and slots left over. A piece takes the last free slot
    before its range; the slots of a range are taken from rank 0 on.
    """
    spans, served, free = [], {}, []
    for part, items, slots in sorted(parts):
        done = 0
        while done < items and free:
            at, low, high = free.pop()
            n = min(items - done, high - low)
            spans.append((part, done, done + n, at, low - done))
            done += n
            if low + n < high:
                free.append((at, low + n, high))
        if done:
            served[part] = done
        if slots:
            free.append((part, 0, slots))
    return spans, served


def sequences(packed: DataFrame, ids_col: str = "ids") -> DataFrame:
    """Rows (sequence_id, ids): the packed sequences themselves, their pieces' ids one after another."""
    own = F.array_sort(F.collect_list(F.struct("offset", F.col(ids_col).alias("ids"))))
    joined = F.aggregate("own", F.lit(b""), lambda all_, x: F.concat(all_, x.ids))
    return packed.groupBy("sequence_id").agg(own.alias("own")).select("sequence_id", joined.alias("ids"))
