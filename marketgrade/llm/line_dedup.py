"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import SPACES, ascii_lower, fresh, whole_text


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2
) -> DataFrame:
    """``docs`` with shared lines taken out of the text, plus n_lines and n_dropped.

    A text is split at line feeds; the key of a line is the line stripped of ASCII white space
    with A-Z lower-cased. A key of at least ``min_chars`` code points that ``min_docs`` or more
    documents hold loses all its lines but those in the document with the smallest id. The
    other lines stay, joined by line feeds, in the text column.

    Only (hash, id, position) of a line is shuffled: a 128-bit hash stands for the key, counts
    are pre-aggregated per task, and the join back to the lines lets adaptive execution split a
    very common line. Text moves once, to meet its dropped positions.

    A null or empty text is one empty line and stays as it is. Rows with a null id neither
    count as a document nor lose lines. Rows that repeat an id count as one document, each
    with its own text. An empty table gives an empty result. All columns of ``docs`` stay; if
    it has n_lines or n_dropped already, the new ones get a leading underscore.
    """
    n_lines, n_dropped = fresh(docs, "n_lines"), fresh(docs, "n_dropped")
    same, gone = fresh(docs, "_text_hash"), fresh(docs, "_gone")
    lines = stored(_line_keys(docs, id_col, text_col, min_chars), "lines")
    dropped = _dropped_positions(lines, min_docs)
    dropped = dropped.select(F.col("doc").alias(id_col), F.col("same").alias(same), F.col("gone").alias(gone))
    pieces = F.split(whole_text(text_col), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col(gone))
    rest = F.array_join(F.transform(kept, lambda i: F.get(pieces, i)), "\n")
    return (
        docs.withColumn(same, F.xxhash64(text_col))
        .join(dropped, [id_col, same], "left")
        .withColumn(n_lines, F.size(pieces).cast("long"))
        .withColumn(n_dropped, F.coalesce(F.size(gone), F.lit(0)).cast("long"))
        .withColumn(text_col, F.when(F.col(gone).isNotNull(), rest).otherwise(F.col(text_col)))
        .select(*docs.columns, n_lines, n_dropped)
    )


def _line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc"),
        F.xxhash64(text_col).alias("same"),
        F.posexplode(F.split(text_col, "\n", -1)).alias("position", "line"),
    )
    key = F.btrim("line", F.lit(SPACES))
    rows = rows.withColumn("line", key).where(F.char_length("line") >= min_chars)
    return rows.select("doc", "same", "position", F.unhex(F.md5(ascii_lower(F.col("line")))).alias("hash"))


def _dropped_positions(lines: DataFrame, min_docs: int) -> DataFrame:
    shared = (
        lines.groupBy("hash")
        .agg(F.count_distinct("doc").alias("n"), F.min("doc").alias("first"))
        .where(F.col("n") >= min_docs)
        .select("hash", "first")
    )
    lost = lines.join(shared, "hash").where(F.col("doc") != F.col("first"))
    return lost.groupBy("doc", "same").agg(F.collect_set("position").alias("gone"))
