"""Gradient-boosted trees for two classes, several models in one run, as histogram passes over blocks of binned rows.

The method is that of Spark's ``GBTClassifier``: log loss, variance splits over about ``BINS``
bins a feature, a first tree at full weight and later ones at the learning rate. All models grow
in step, so one pass serves every model, and a row takes a byte a feature in memory.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 32
#: Rows from which a feature's bins are laid, as many as Spark's trees take, and the seed that they draw from
#: their own seed of 0; every row is binned and trained on.
BIN_ROWS, BIN_SEED = 10_000, 520798028
#: Rows of a block, which a task works on at a time, and rows of a task, about.
BLOCK_ROWS, TASK_ROWS = 1 << 16, 1 << 23
#: Trees after which margins are made from the blocks again, so that lineage stays short.
REPLAY = 30

#: The last left bin of a node that was not split; bins are bytes.
WHOLE = 255

#: Feature and last left bin of each inner node in level order, and the value of each leaf. Where a node
#: was not split, all its rows go left.
Tree = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Boosted:
    """Fitted trees over binned columns; ``splits`` are the upper bounds of all bins of a column but the last."""

    columns: tuple[str, ...]
    splits: list[np.ndarray]
    trees: list[Tree]
    rate: float

    def margin(self, values: Sequence[np.ndarray]) -> np.ndarray:
        return _margin(_binned(values, self.splits), None, self.trees, 0, self.rate)

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``probability``, a vector of both classes; an absent feature is an error."""

        @F.arrow_udf("double")
        def up(*columns: pa.Array) -> pa.Array:
            margin = self.margin([c.to_numpy(zero_copy_only=False) for c in columns])
            return pa.array(1.0 - 1.0 / (1.0 + np.exp(2.0 * margin)))

        p = up(*[F.col(c).cast("double") for c in self.columns])
        return rows.withColumn("probability", p).withColumn("probability", array_to_vector(F.array(1.0 - F.col("probability"), "probability")))

    def to_json(self) -> str:
        trees = [[part.tolist() for part in tree] for tree in self.trees]
        return json.dumps({"columns": self.columns, "splits": [s.tolist() for s in self.splits], "trees": trees, "rate": self.rate})

    @staticmethod
    def from_json(text: str) -> Boosted:
        made = json.loads(text)
        trees = [(np.array(f), np.array(b), np.array(v, float)) for f, b, v in made["trees"]]
        return Boosted(tuple(made["columns"]), [np.array(s, float) for s in made["splits"]], trees, made["rate"])


def boost(
    rows: DataFrame, members: Sequence[Column], columns: Sequence[str], trees: int, rate: float, depth: int, least: int, label: str = "label"
) -> list[Boosted]:
    """A model per column of ``members``, which says of each row whether the model learns from it.

    ``rows`` are read a few times, so store them first. They are dealt evenly over tasks once, as
    blocks of bins that stay in memory or on local disks. A tree takes a pass per level, whose tasks
    return histograms of bounded size (nodes x features x bins for each model). Absent features,
    labels other than 0 and 1 and models without rows are errors.
    """
    sc = rows.sparkSession.sparkContext
    values = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    mask = sum((F.coalesce(m, F.lit(False)).cast("long") * (1 << k) for k, m in enumerate(members)), F.lit(0))
    rows = rows.select(mask.alias("mask"), F.col(label).cast("double").alias("label"), *values).where("mask > 0")
    taught = [F.col("mask").bitwiseAND(1 << k) != 0 for k in range(len(members))]
    wrong = F.coalesce(F.max(~F.coalesce(F.col("label").isin(0.0, 1.0), F.lit(False))), F.lit(False))
    *counts, bad = rows.agg(*[F.count_if(t) for t in taught], wrong).first()
    if bad or not all(counts):
        raise ValueError("labels must be 0 or 1, and every model needs rows")
    splits = [_splits(rows.where(t), n, len(columns)) for t, n in zip(taught, counts, strict=True)]
    # A draw of more rows than expected can give a feature a bin or two more.
    bins = max([BINS] + [len(s) + 1 for own in splits for s in own])
    width, total = sc.defaultParallelism, sum(counts)
    parts = min(width * -(-total // (width * TASK_ROWS)), -(-total // BLOCK_ROWS))
    base = _blocks(rows.repartition(parts), splits).rdd.map(_block).persist(StorageLevel.MEMORY_AND_DISK)
    done: list[list[Tree]] = [[] for _ in members]
    state = None
    for m in range(trees):
        again = m % REPLAY == 0
        start = 0 if again else m - 1
        moved = (base if again else state).map(_mover([own[start:] for own in done], start, rate)).persist(StorageLevel.MEMORY_AND_DISK)
        grown = [Growing(depth, least, [len(s) for s in own], bins) for own in splits]
        for level in range(depth):
            found = moved.mapPartitions(_counter([g.tree for g in grown], level, m == 0, bins)).collect()
            if level == 0 and state is not None:
                state.unpersist()
            for k, g in enumerate(grown):
                g.grow(level, sum(h for own, h in found if own == k))
            if not any(g.open for g in grown):
                break
        state = moved
        for own, g in zip(done, grown, strict=True):
            own.append(g.tree)
    if state is not None:
        state.unpersist()
    base.unpersist()
    return [Boosted(tuple(columns), s, t, rate) for s, t in zip(splits, done, strict=True)]


class Growing:
    """A tree that grows level by level from histograms; ``open`` are the nodes of the next level that may be split."""

    def __init__(self, depth: int, least: int, sizes: list[int], bins: int):
        self.depth, self.least, self.open = depth, least, [0]
        self.allowed = np.arange(bins - 1) < np.array(sizes)[:, None]
        self.tree: Tree = (np.zeros(2**depth - 1, int), np.full(2**depth - 1, WHOLE), np.zeros(2**depth))

    def grow(self, level: int, histogram: np.ndarray) -> None:
        """``histogram`` has sums and counts by node, feature and bin. The first of the best splits is taken."""
        feature, last, value = self.tree
        below, later = self.depth - level, []
        for node in self.open:
            sums, counts = histogram[:, node].cumsum(-1)
            total, n = sums[:, -1:], counts[:, -1:]
            if level == 0:
                value[0] = total[0, 0] / n[0, 0]
            left, own = sums[:, :-1], counts[:, :-1]
            fits = self.allowed & (own >= self.least) & (n - own >= self.least)
            with np.errstate(divide="ignore", invalid="ignore"):
                gains = np.where(fits, left**2 / own + (total - left) ** 2 / (n - own) - total**2 / n, -np.inf)
            f, b = np.unravel_index(np.argmax(gains), gains.shape)
            if gains[f, b] <= 0:
                continue
            at = 2**level - 1 + node
            feature[at], last[at] = f, b
            value[2 * node << below - 1] = left[f, b] / own[f, b]
            value[2 * node + 1 << below - 1] = (total[f, 0] - left[f, b]) / (n[f, 0] - own[f, b])
            later += [2 * node, 2 * node + 1]
        self.open = later


def bin_bounds(values: np.ndarray, bins: int = BINS, expected: int | None = None) -> np.ndarray:
    """Upper bounds of about equally full bins, half-way between neighbouring values, as Spark's trees lay them.

    They count zeros as what is missing from the ``expected`` number of values, and lay more than
    ``bins`` where there are more values than expected.
    """
    expected = len(values) if expected is None else expected
    found, counts = np.unique(values[values != 0], return_counts=True)
    zeros, at = expected - counts.sum(), np.searchsorted(found, 0.0)
    if zeros > 0:
        found, counts = np.insert(found, at, 0.0), np.insert(counts, at, zeros)
    middle = (found[:-1] + found[1:]) / 2.0
    if len(middle) < bins:
        return middle
    stride = expected / bins
    target, total, kept = stride, np.cumsum(counts), []
    for i in range(len(middle)):
        if abs(total[i] - target) < abs(total[i + 1] - target):
            kept.append(middle[i])
            target += stride
    return np.array(kept)


def _splits(rows: DataFrame, n: int, width: int) -> list[np.ndarray]:
    some = rows.select(*[f"x{i}" for i in range(width)])
    if n > BIN_ROWS:
        # The row sampler of the JVM's RDDs, so that the bins are those of Spark's trees.
        spark, frame = rows.sparkSession, some._jdf
        drawn = frame.toJavaRDD().sample(False, BIN_ROWS / n, BIN_SEED)
        some = DataFrame(spark._jsparkSession.createDataFrame(drawn, frame.schema()), spark)
    return [bin_bounds(column.to_numpy(), min(BINS, n), min(BIN_ROWS, n)) for column in some.toArrow().columns]


def _binned(values: Sequence[np.ndarray], splits: Sequence[np.ndarray]) -> np.ndarray:
    if any(np.isnan(v).any() for v in values):
        raise ValueError("a feature is absent")
    return np.stack([np.searchsorted(s, v).astype(np.uint8) for v, s in zip(values, splits, strict=True)])


def _blocks(rows: DataFrame, splits: list[list[np.ndarray]]) -> DataFrame:
    """Rows (model, bins, label): a model's rows as bytes, feature by feature, and labels -1 and 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list] = [[] for _ in splits]

        def block(k: int) -> pa.RecordBatch:
            bins, label = (np.concatenate(x, -1) for x in zip(*kept[k], strict=True))
            kept[k] = []
            return pa.RecordBatch.from_pydict({"model": pa.array([k], pa.int32()), "bins": [bins.tobytes()], "label": [label.tobytes()]})

        for batch in batches:
            mask, label, *values = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for k, own in enumerate(splits):
                mine = (mask >> k & 1) == 1
                if mine.any():
                    kept[k].append((_binned([v[mine] for v in values], own), (2 * label[mine] - 1).astype(np.int8)))
                    if sum(len(y) for _, y in kept[k]) >= BLOCK_ROWS:
                        yield block(k)
        yield from (block(k) for k in range(len(splits)) if kept[k])

    return rows.mapInArrow(run, "model int, bins binary, label binary")


def _block(row) -> tuple:
    label = np.frombuffer(bytes(row.label), np.int8)
    return row.model, np.frombuffer(bytes(row.bins), np.uint8).reshape(-1, len(label)), label, None


def _nodes(bins: np.ndarray, tree: Tree, level: int) -> np.ndarray:
    """The node of ``level`` that each row is in."""
    feature, last, _ = tree
    node = np.zeros(bins.shape[1], np.uint8)
    for above in range(level):
        right = np.zeros(len(node), bool)
        for j in range(2**above):
            at = 2**above - 1 + j
            if last[at] < WHOLE:
                right |= (bins[feature[at]] > last[at]) & (node == j)
        node = 2 * node + right
    return node


def _margin(bins: np.ndarray, margin: np.ndarray | None, trees: list[Tree], start: int, rate: float) -> np.ndarray:
    """``margin`` with the values of ``trees`` added, of which the first is number ``start`` of the model."""
    margin = np.zeros(bins.shape[1]) if margin is None else margin
    for i, tree in enumerate(trees, start):
        depth = len(tree[2]).bit_length() - 1
        margin = margin + (tree[2] * (rate if i else 1.0))[_nodes(bins, tree, depth)]
    return margin


def _mover(trees: list[list[Tree]], start: int, rate: float):
    def moved(block: tuple) -> tuple:
        k, bins, label, margin = block
        return k, bins, label, _margin(bins, margin, trees[k], start, rate)

    return moved


def _counter(trees: list[Tree], level: int, first: bool, bins: int):
    """A pass: sums of residuals (of the first tree: labels) and counts of rows by node, feature and bin for each model."""

    def run(blocks: Iterator[tuple]) -> Iterator[tuple]:
        found: dict[int, np.ndarray] = {}
        width = 0
        for k, binned, label, margin in blocks:
            y = label.astype(float)
            rest = y if first else 4.0 * y / (1.0 + np.exp(2.0 * y * margin))
            node = _nodes(binned, trees[k], level).astype(np.int64) * bins**2
            width = len(binned)
            # One count serves two features.
            pairs = [(i, min(i + 1, width - 1)) for i in range(0, width, 2)]
            made = np.empty((2, len(pairs), 2**level * bins**2))
            for at, (a, b) in enumerate(pairs):
                cell = node + (binned[a].astype(np.uint16) * bins + binned[b])
                made[0, at] = np.bincount(cell, rest, made.shape[2])
                made[1, at] = np.bincount(cell, minlength=made.shape[2])
            found[k] = found[k] + made if k in found else made
        for k, made in found.items():
            cells = made.reshape(2, made.shape[1], -1, bins, bins)
            both = np.stack([cells.sum(4), cells.sum(3)], 2).reshape(2, -1, 2**level, bins)
            yield k, both[:, :width].swapaxes(1, 2)

    return run
