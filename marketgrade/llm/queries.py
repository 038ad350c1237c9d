"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_folder, ship_package, stored
from . import alignment, bpe, byte_level, decontam, divergence, fingerprints, importance, line_dedup, ngram_join, packing, pii, secrets, token_rollup, warc

QUERIES = {}
ORACLES: dict[str, str] = {}

RANKS = "byte_bpe_multi_50k.tiktoken"


def query(function):
    @functools.wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return function(spark, folder)

    QUERIES[function.__name__] = run
    return run


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def kind_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")


@query
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Totals after inserts, a revision and a delete, two of them repeated.

    Batches: pieces between single spaces of all documents, their BPE tokens, the first batch
    again, the pieces revised to words, that batch again, and word counts taken back but for
    English.
    """
    docs = read(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    counted = token_rollup.bpe_counts(docs, ranks, public_tokenizers.PATTERN).select(
        "doc_id",
        "source",
        "lang",
        "n_tokens",
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).alias("n_words"),
        (F.regexp_count(F.coalesce("text", F.lit("")), F.lit(" ")) + 1).alias("n_pieces"),
        F.char_length(F.coalesce("text", F.lit(""))).alias("n_chars"),
    )
    counted = stored(counted, "counts")

    def changes(op: str, version: str, count: str, rows: DataFrame = counted) -> DataFrame:
        return rows.select("doc_id", "source", "lang", F.lit(version).alias("version"), F.lit(op).alias("op"), F.col(count).alias("n_tokens"), "n_chars")

    rollup = token_rollup.TokenRollup(spark, scratch_folder(spark, "rollup"))
    rollup.apply("words-1", changes("insert", "words-1", "n_pieces"))
    rollup.apply("bpe-1", changes("insert", "byte_bpe_multi_50k", "n_tokens"))
    rollup.apply("words-1", changes("insert", "words-1", "n_pieces"))
    for _ in range(2):
        rollup.apply("words-2", changes("revise", "words-1", "n_words"))
    rollup.apply("retire-1", changes("delete", "words-1", "n_words", counted.where("NOT lang <=> 'en'")))
    return rollup.totals()


@query
def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = scratch_folder(spark, "warc")
    warc.write_archives(read(spark, folder, "pages"), archive)
    return warc.read_archives(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op2_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, array_to_string([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT)
      >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1) FOR i IN generate_series(0, 31)], '') AS payload_digest
  FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f USING (payload_digest)
"""


@query
def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    encoded = bpe.encode(read(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query
def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.line_dedup(read(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLES["op4_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS position
  FROM documents),
k AS (
  SELECT doc_id, line, position, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, coalesce(first <> doc_id, false) AS dropped FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.leaks(read(spark, folder, "documents"), read(spark, folder, "benchmark")).select(
        "doc_id", "item_id", "question_share", "answer_share"
    )


@query
def op6_i_match(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_fingerprints(read(spark, folder, "documents"))


@query
def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_pii(read(spark, folder, "documents"))
    place = F.array(*map(F.lit, pii.KINDS))
    order = F.array_sort(
        F.transform(
            F.concat("base", "added"),
            lambda s: F.struct(F.array_position(place, s.kind).alias("no"), s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")),
        )
    )
    return found.select(
        "doc_id",
        *[kind_count(F.col("base"), k) for k in pii.KINDS],
        F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"),
        joined_spans(order).alias("spans"),
    )


@query
def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(read(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s.base)
    return found.select(
        "doc_id",
        *[kind_count(base, k) for k in secrets.KINDS],
        F.sha2(joined_spans(base), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )


@query
def op9_importance(spark: SparkSession, folder: str) -> DataFrame:
    kept = importance.resample(read(spark, folder, "documents").select("doc_id", "text"), read(spark, folder, "labels"))
    return kept.select("doc_id", "log_weight", "gumbel_key")


@query
def op10_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    found = ngram_join.classes(read(spark, folder, "documents"), words=3, percent=90)
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


@query
def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergences(read(spark, folder, "documents"))


ORACLES["op11_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS all_n FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT g.lang, count(DISTINCT term) AS v FROM g LEFT JOIN k ON k.lang = g.lang GROUP BY g.lang),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
t AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY lang, source),
a AS (SELECT lang, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY lang),
f AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * v.v) AS p,
    1 + (1000000000::HUGEINT * (k.all_n + 2)) // (a.total + 2 * v.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang JOIN a ON a.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
s AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
  FROM f x JOIN f y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM f WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 10
"""


@query
def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    first = byte_level.read_byte_level(public_tokenizers.path("byte_bpe_50k.json"), ranks, public_tokenizers.PATTERN, plain_special=True)
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as model:
        second = model.read()
    return alignment.align(read(spark, folder, "documents"), first, second).select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        "n_best",
        "count_sum",
        F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"),
    )


@query
def op13_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokens = byte_level.read_byte_level(public_tokenizers.path("byte_bpe_50k.json"), ranks, public_tokenizers.PATTERN)
    pieces = packing.token_pieces(read(spark, folder, "documents"), tokens, end_id=2, size=1024)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces, size=1024).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"
    )
