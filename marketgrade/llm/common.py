"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..session import stored

#: Characters that end a word and are stripped from lines: space and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole_text(text: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII takes the quick built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def arrow_schema(**fields: pa.DataType) -> pa.Schema:
    return pa.schema(list(fields.items()))


def with_field(schema: StructType, name: str, kind: str | DataType) -> StructType:
    """A copy of the schema with one more column."""
    return StructType(list(schema.fields)).add(name, DataType.fromDDL(kind) if isinstance(kind, str) else kind)


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about ``size`` bytes; byte strings, texts and arrays count by length."""
    kept, weight = [], 0
    for row in rows:
        kept.append(row)
        weight += 32 + sum(8 * len(x) if isinstance(x, list) else len(x) for x in row if hasattr(x, "__len__"))
        if weight >= size:
            yield as_batch(kept, schema)
            kept, weight = [], 0
    if kept:
        yield as_batch(kept, schema)


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def map_rows(df: DataFrame, function: Callable[[Iterator[dict]], Iterator[tuple]], ddl: str, schema: pa.Schema) -> DataFrame:
    """``mapInArrow`` for a function over the rows of a task, given as dicts, that yields tuples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(function(row for batch in batches for row in batch.to_pylist()), schema)

    return df.mapInArrow(run, ddl)


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """Connected components of ``links`` (a, b: long): rows (node, component), component the smallest node.

    Large-star and small-star rounds (Kiveris et al., 2014) turn the graph into stars around the
    smallest nodes in a logarithmic number of rounds. Every round is a grouped minimum and a
    join, stored in the shared checkpoint folder, so nothing is collected; a node with many
    neighbours is pre-aggregated. Loops and repeated links are harmless.
    """
    edges = stored(links.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), "edges")
    for _ in range(rounds):
        if edges.isEmpty():
            break
        large = _star(edges.select("u", "v").union(edges.selectExpr("v AS u", "u AS v")), keep_larger=True)
        small = stored(_star(large.selectExpr("greatest(u, v) AS u", "least(u, v) AS v"), keep_larger=False), "edges")
        same = small.exceptAll(edges).isEmpty() and small.count() == edges.count()
        edges = small
        if same:
            break
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()


def _star(edges: DataFrame, keep_larger: bool) -> DataFrame:
    """Link the (larger) neighbours of every node to the smallest of the node and its neighbours."""
    smallest = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = edges.join(smallest, "u")
    if keep_larger:
        moved = joined.where("v > u").selectExpr("v AS u", "m AS v")
    else:
        moved = joined.selectExpr("v AS u", "m AS v").union(smallest.selectExpr("u", "m AS v"))
    return moved.where("u <> v").distinct()
