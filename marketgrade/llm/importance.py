"""Quality filter by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import stored
from .common import arrow_schema, as_batch, fresh, with_field

#: Tokens, at most, whose hashes a task keeps.
KNOWN_WORDS = 200_000
#: Slots of the hashed n-gram models.
SLOTS = 1 << 15
#: Share of the raw model in the target model, which bounds the ratio where the target has seen little.
RAW_SHARE = 0.4
#: Labelled rows, at most, that choose the target text and the accepted share.
LABELLED_ROWS = 20_000
#: How much more a lost clean document weighs than a kept bad one.
CLEAN_WEIGHT = 4.0
#: N-grams that a text counts as, whatever its length, where the cut per n-gram sets the sample's size.
TEMPERATURE = 500.0
SEED = 20_240

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MIX, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """Log ratio of the target's to the raw text's n-gram probability, by slot, and the accepting cut of a text's mean ratio."""

    ratio: np.ndarray
    cut: float


def ngram_slots(text: str | None, known: dict[str, int], slots: int = SLOTS) -> np.ndarray:
    """Slots of the tokens and token pairs of a text; ``known`` keeps the hashes of tokens seen.

    Tokens are runs of word characters and runs of marks; case is kept, as shouting tells.
    """
    words = _TOKEN.findall(text or "")
    if len(known) > KNOWN_WORDS:
        known.clear()
    hashes = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            known[w] = h = zlib.crc32(w.encode("utf-8", "replace"))
        hashes[i] = h
    pairs = hashes[:-1] * _STEP + hashes[1:]
    return ((np.concatenate([hashes, pairs]) * _MIX >> np.uint64(33)) % np.uint64(slots)).astype(np.int64)


def half_of(key) -> int:
    """The half, 0 or 1, that a labelled document belongs to."""
    return zlib.crc32(str(key).encode()) % 2


def sample_labels(labels: DataFrame, id_col: str, label_col: str, rows: int) -> dict:
    """At most ``rows`` labels by document, a fixed pseudo-random choice; repeated labels take the largest."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    return {r.id: int(r.label) for r in known.orderBy(F.xxhash64("id"), "id").limit(rows).collect()}


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    labelled_rows: int = LABELLED_ROWS,
    slots: int = SLOTS,
) -> Model:
    """The n-gram models of the good labelled documents and of all documents.

    The raw model counts every document; the target model and the cut use at most
    ``labelled_rows`` labels. The cut is the log weight per n-gram that best parts the labelled
    documents, a lost good one weighing ``CLEAN_WEIGHT`` times a kept bad one; a mean is judged
    alike in short and long texts, where a sum grows with the length. For that, each labelled
    document is weighed by a target model of the half that it is not in. Without a good and a
    bad label there is nothing to part: the cut accepts everything.
    """
    label = sample_labels(labels, id_col, label_col, labelled_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target, known = np.zeros(slots, np.int64), np.zeros((2, slots), np.int64), {}
        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                seen = np.bincount(ngram_slots(text.as_py(), known, slots), minlength=slots)
                raw += seen
                if label.get(key, 0) > 0:
                    target[half_of(key)] += seen
        at = np.nonzero(raw)[0]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, raw[at], target[0, at], target[1, at])], names=["slot", "raw", "a", "b"])

    counts = rows.mapInArrow(count, "slot long, raw long, a long, b long").groupBy("slot").agg(F.sum("raw"), F.sum("a"), F.sum("b"))
    raw, target = np.ones(slots), np.zeros((2, slots))
    for slot, n, a, b in counts.collect():
        raw[slot] += n
        target[:, slot] = a, b
    ratio = log_ratio(target[0] + target[1], raw)
    if len({v > 0 for v in label.values()}) < 2:
        return Model(ratio, -np.inf)
    others = [log_ratio(target[1], raw), log_ratio(target[0], raw)]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            held = [(i, k) for i, k in enumerate(batch.column("id").to_pylist()) if k in label]
            text = batch.column("text")
            found = [(label[k] > 0, mean_weight(others[half_of(k)], ngram_slots(text[i].as_py(), known, slots))) for i, k in held]
            if found:
                yield as_batch(found, arrow_schema(good=pa.bool_(), weight=pa.float64()))

    # At most ``labelled_rows`` ids, so their list is bounded.
    ids = rows.sparkSession.createDataFrame([(i,) for i in label], StructType([rows.schema["id"]]))
    chosen = rows.join(F.broadcast(ids), "id", "left_semi")
    seen = chosen.mapInArrow(weigh, "good boolean, weight double").collect()
    return Model(ratio, best_cut(np.array([r.weight for r in seen]), np.array([r.good for r in seen], bool)))


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio, by slot, of the target model, in which the raw one has its share, to the raw model."""
    raw = raw / raw.sum()
    return np.log((1 - RAW_SHARE) * target / max(target.sum(), 1) + RAW_SHARE * raw) - np.log(raw)


def mean_weight(ratio: np.ndarray, at: np.ndarray) -> float:
    """Log weight per n-gram; 0 without n-grams."""
    return float(ratio[at].sum()) / max(len(at), 1)


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The cut with the largest CLEAN_WEIGHT * (share of good kept) + (share of bad rejected)."""
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(weights, kind="stable")
    weights, good = weights[order], good[order]
    rejected_bad = np.concatenate([[0], np.cumsum(~good)]) / (~good).sum()
    lost_good = np.concatenate([[0], np.cumsum(good)]) / good.sum()
    edges = np.concatenate([[-np.inf], (weights[1:] + weights[:-1]) / 2, [np.inf]])
    return float(edges[np.argmax(rejected_bad - CLEAN_WEIGHT * lost_good)])


def weighed(docs: DataFrame, model: Model, text_col: str, weight: str, mean: str) -> DataFrame:
    """``docs`` plus each text's log importance weight, in all and per n-gram."""
    ratio = model.ratio

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            slots = (ngram_slots(t.as_py(), known, len(ratio)) for t in batch.column(text_col))
            made = [(w := float(ratio[at].sum()), w / max(len(at), 1)) for at in slots]
            added = [pa.array([m[i] for m in made], pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, weight, mean])

    return docs.mapInArrow(run, with_field(with_field(docs.schema, weight, "double"), mean, "double"))


def resample(
    docs: DataFrame,
    labels: DataFrame,
    k: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    seed: int = SEED,
    model: Model | None = None,
) -> DataFrame:
    """The ``k`` documents with the largest log weight plus Gumbel noise: a sample without replacement.

    The noise is a hash of the id, so the sample is the same on every run. Without ``k`` the
    sample is as large as the number of documents whose log weight per n-gram reaches the
    model's cut, and the log weight in the key is that of ``TEMPERATURE`` n-grams of the
    document's mean, so that long and short texts are drawn alike. A cut of minus infinity keeps
    everything. Result: all columns of ``docs``, log_weight and gumbel_key (with a leading
    underscore where taken).

    Texts are weighed twice: once for the keys, of which only the numbers are stored in the
    shared folder, and once more as the kept rows are read. Storing the texts with their keys
    would save the second weighing, at a copy of the table on the shared disk.

    The k-th key is found by counting keys by their leading 16 bits, four times; nothing is
    sorted, and at most 65,536 counts reach the driver at once. Rows that tie with the k-th
    key, such as repeated rows, all stay.

    A null or empty text has weight 0; a null id takes the noise of a null. An empty table,
    or k = 0, gives an empty result.
    """
    model = model or fit(docs, labels, id_col, text_col, label_col)
    weight, key, mean = fresh(docs, "log_weight"), fresh(docs, "gumbel_key"), fresh(docs, "mean_weight")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 11) + 0.5) * 2.0**-53
    score = F.col(weight) if k is not None else F.col(mean) * TEMPERATURE

    def keyed(rows: DataFrame) -> DataFrame:
        return weighed(rows, model, text_col, weight, mean).withColumn(key, score - F.log(-F.log(uniform)))

    numbers = stored(keyed(docs.select(id_col, text_col)).select(key, mean), "weights")
    if k is None:
        k = numbers.where(F.col(mean) >= model.cut).count() if np.isfinite(model.cut) else numbers.count()
    cutoff = kth_largest(numbers.select(key), k)
    rows = keyed(docs).drop(mean)
    return rows.limit(0) if cutoff is None else rows.where(F.col(key) >= cutoff)


def kth_largest(values: DataFrame, k: int) -> float | None:
    """The k-th largest of one column of doubles; the smallest if there are fewer; None for no rows or k < 1."""
    if k < 1:
        return None
    scale = 2.0**20
    whole = values.select(F.round(F.col(values.columns[0]) * scale).cast("long").alias("v"))
    return _kth(whole, k, scale, values)


def _kth(whole: DataFrame, k: int, scale: float, values: DataFrame) -> float | None:
    """Narrow the range of scaled values down by 2**16 slots a pass, then take the exact value inside."""
    low, high = whole.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return None
    while high > low:
        width = max(1, -(-(high - low + 1) // 65_536))
        slots = whole.where(F.col("v").between(low, high)).groupBy(F.floor((F.col("v") - low) / width).cast("long").alias("s")).count()
        counted = sorted(((r.s, r["count"]) for r in slots.collect()), reverse=True)
        for slot, n in counted:
            if n >= k:
                break
            k -= n
        else:
            slot = counted[-1][0]
        low, high = low + slot * width, min(high, low + (slot + 1) * width - 1)
        if width == 1:
            break
    name = values.columns[0]
    inside = values.where(F.round(F.col(name) * scale).cast("long") == low)
    tied = inside.groupBy(name).count().orderBy(F.desc(name)).collect()
    for r in tied:
        k -= r["count"]
        if k <= 0:
            return r[name]
    return tied[-1][name]
