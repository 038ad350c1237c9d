"""Token totals by source, language and tokenizer version, kept by signed deltas in idempotent batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import with_field

KEY = ["source", "lang", "version"]
#: A change: the document, its group, the operation (insert, revise, delete) and its counts.
CHANGE = "doc_id long, source string, lang string, version string, op string, n_tokens long, n_chars long"
#: A change with its place among the changes of its document and version; the place may be null or left out.
SEQUENCED_CHANGE = CHANGE + ", seq long"
_LEDGER = "doc_id long, source string, lang string, version string, sign int, n_tokens long, n_chars long"
_DELTA = "source string, lang string, version string, n_docs long, n_tokens long, n_chars long"
_LIVE = ["doc_id", *KEY, "n_tokens", "n_chars"]


def bpe_counts(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", count_col: str = "n_tokens") -> DataFrame:
    """``docs`` plus the number of BPE tokens of each whole text; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            made = [len(encode(t.as_py() or "")) for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.int64())], names=[*batch.schema.names, count_col])

    return docs.mapInArrow(run, with_field(docs.schema, count_col, "long"))


class TokenRollup:
    """A rollup in ``folder``: per batch a ledger of signed document rows and a delta of group totals.

    A batch counts once its marker file exists. The marker is created last, and only if it is
    not there yet, so a batch that failed half-way is invisible and is written anew by a
    repeat, and a repeat of a finished batch does nothing. Several batches in turn are expected;
    two writers at the same time are not.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        """Names of the batches that count."""
        place = self._path(f"{self.folder}/commits")
        if not self._files.exists(place):
            return []
        return sorted(s.getPath().getName() for s in self._files.listStatus(place))

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch of changes; False, and no effect, if the batch was committed before.

        An insert or revision takes back the counts that the document has under the version, if
        any, and adds the new ones; a delete takes them back. A delete of an unknown document
        has no effect. Null sources, languages and counts are groups "unknown" and 0. Changes
        without a document, a version or a known operation have no effect. Of several changes of
        one document and version in a batch the one with the largest ``seq`` counts, a number
        that the caller gives in the order of the changes (null before all others). Among equal
        or missing ones it is a revision before an insert before a delete, then the one with the
        largest counts, source and language. An empty batch is committed and changes nothing.
        """
        if batch in self.committed():
            return False
        rank = F.when(F.col("op") == "revise", 2).when(F.col("op") == "insert", 1).when(F.col("op") == "delete", 0)
        seq = F.col("seq").cast("long") if "seq" in changes.columns else F.lit(None).cast("long")
        clean = changes.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("version").cast("string").alias("version"),
            F.coalesce(seq, F.lit(-(2**63))).alias("seq"),
            rank.alias("rank"),
            F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"),
            F.coalesce(F.col("n_chars").cast("long"), F.lit(0)).alias("n_chars"),
            F.coalesce("source", F.lit("unknown")).alias("source"),
            F.coalesce("lang", F.lit("unknown")).alias("lang"),
        ).where("doc_id IS NOT NULL AND version IS NOT NULL AND rank IS NOT NULL")
        last = clean.groupBy("doc_id", "version").agg(F.max(F.struct("seq", "rank", "n_tokens", "n_chars", "source", "lang")).alias("c"))
        added = last.where("c.rank > 0").select("doc_id", "c.source", "c.lang", "version", F.lit(1).alias("sign"), "c.n_tokens", "c.n_chars")
        rows = added
        if self.committed():
            taken = self.ledger().join(last.select("doc_id", "version"), ["doc_id", "version"], "left_semi")
            rows = added.unionByName(taken.withColumn("sign", F.lit(-1)))
        target = f"{self.folder}/batches/{batch}"
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/ledger")
        written = self.spark.read.schema(_LEDGER).parquet(f"{target}/ledger")
        delta = written.groupBy(*KEY).agg(
            F.sum(F.col("sign")).cast("long").alias("n_docs"),
            F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"),
            F.sum(F.col("sign") * F.col("n_chars")).alias("n_chars"),
        )
        delta.write.mode("overwrite").parquet(f"{target}/delta")
        self._files.mkdirs(self._path(f"{self.folder}/commits"))
        self._files.create(self._path(f"{self.folder}/commits/{batch}"), False).close()
        return True

    def _read(self, part: str, schema: str) -> DataFrame:
        folders = [f"{self.folder}/batches/{b}/{part}" for b in self.committed()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """The live rows (doc_id, source, lang, version, n_tokens, n_chars): those not taken back."""
        return self._read("ledger", _LEDGER).groupBy(*_LIVE).agg(F.sum("sign").alias("live")).where("live > 0").select(*_LIVE)

    def totals(self) -> DataFrame:
        """Rows (source, lang, version, n_docs, n_tokens, n_chars) of all groups with documents."""
        sums = self._read("delta", _DELTA).groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_chars")])
        return sums.where("n_docs <> 0")
