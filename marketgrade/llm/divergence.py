"""Which terms set sources of a language apart: digests are counted, strings come back at the end."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import arrow_schema, whole_text

#: ASCII characters that part terms: all but letters.
_BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text that are counted together before anything leaves a task.
SLICE_BYTES = 24 << 20
#: Terms and sources, at most, of one block of pair sums: a block holds a dense table of them.
BLOCK_TERMS, TILE = 4096, 64
SCALE = 1_000_000_000


def divergences(
    docs: DataFrame,
    least_docs: int = 10,
    ranks: int = 10,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    digest: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): how far sources of a language are apart, and by which terms.

    Terms are runs of letters and non-ASCII characters, A-Z lower-cased. A language keeps the
    terms of at least ``least_docs`` of its documents. With smoothed shares p per billion, part
    ``pair`` has for every other source the sum of (p - q)^2 / (p + q) over all kept terms, and
    part ``term`` the ``ranks`` terms that a source has more of than its language, by that value.

    1. Tasks count terms per slice of text and store them with a 64-bit digest. Only
       digests and counts are shuffled, first by source, then by language.
    2. Of the kept digests the smallest and largest string are compared. Where they
       differ, terms have collided: the digest's counts are split by the string itself.
    3. Pair sums are made in blocks of terms and tiles of sources, so a block's table is
       bounded; a term that a source lacks counts with the source's smallest share. Only sums
       leave a block. The best terms are ranked by value, and strings are joined to those alone.

    Null texts, languages and sources are empty ones. Every row is a document, repeated rows
    included. Groups without terms have their pairs too; a language with one source has none.
    A language that keeps no term has values 0. Ties go by the item in UTF-8. An empty table
    gives an empty result; other columns are not read. All arithmetic is exact.
    """
    rows = docs.select(
        whole_text(lang_col).alias("lang"), whole_text(source_col).alias("source"), whole_text(text_col).alias("text")
    )
    ddl = "lang string, source string, term string, docs long, n long"
    counted = stored(rows.mapInArrow(_count_terms, ddl).withColumn("digest", digest(F.col("term"))), "terms")
    kept, words = _kept(counted, least_docs)
    groups = _groups(rows, kept, words)
    result = _pairs(kept, groups).unionByName(_terms(kept, words, groups, ranks))
    return result.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, docs, n) for the distinct terms of each slice of the task's texts."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
        part = (np.cumsum(lengths, dtype=np.int64) + size) // SLICE_BYTES
        for own in np.split(np.arange(len(lengths)), np.nonzero(np.diff(part))[0] + 1):
            if len(own):
                held.append(batch.slice(int(own[0]), len(own)))
                size += int(lengths[own].sum())
                if size >= SLICE_BYTES:
                    yield _slice_counts(held)
                    held, size = [], 0
    if held:
        yield _slice_counts(held)


def _slice_counts(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    codes, owners, terms, base = [], [], pa.array([], pa.string()), 0
    whole = pa.Table.from_batches(batches).combine_chunks()
    for batch in batches:
        found = pc.split_pattern_regex(batch.column("text"), _BETWEEN)
        values = pc.ascii_lower(found.flatten())
        counts = pc.list_value_length(found).to_numpy(zero_copy_only=False)
        some = pc.greater(pc.binary_length(values), 0)
        owners.append(np.repeat(np.arange(base, base + len(counts)), counts)[some.to_numpy(zero_copy_only=False)])
        codes.append(values.filter(some))
        base += len(counts)
    terms = pa.chunked_array(codes, pa.string()).combine_chunks().dictionary_encode()
    if isinstance(terms, pa.ChunkedArray):
        terms = terms.combine_chunks()
    width = max(1, len(terms.dictionary))
    code = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs, times = np.unique(np.concatenate(owners) * width + code, return_counts=True)
    lang, source = (_one(whole.column(c)).dictionary_encode() for c in ("lang", "source"))
    sources = max(1, len(source.dictionary))
    group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * sources + source.indices.to_numpy(zero_copy_only=False)
    keys, place = np.unique(group[pairs // width] * width + pairs % width, return_inverse=True)
    docs = np.bincount(place, minlength=len(keys)).astype(np.int64)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, place, times)
    at = keys // width
    types = arrow_schema(lang=pa.string(), source=pa.string(), term=pa.string(), docs=pa.int64(), n=pa.int64())
    columns = [
        lang.dictionary.take(pa.array(at // sources)),
        source.dictionary.take(pa.array(at % sources)),
        terms.dictionary.take(pa.array(keys % width)),
        pa.array(docs),
        pa.array(total),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=types)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _kept(counted: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """Kept terms by source, (lang, source, digest, twin, n, all_n), and their strings, (lang, digest, twin, term).

    ``twin`` is empty but where terms of a language share a digest; there it is the term.
    """

    def enough(by_source: DataFrame, *key: str) -> DataFrame:
        alike = Window.partitionBy("lang", *key)
        both = by_source.withColumns({"all_docs": F.sum("docs").over(alike), "all_n": F.sum("n").over(alike)})
        return both.where(F.col("all_docs") >= least_docs)

    sums = [F.sum("docs").alias("docs"), F.sum("n").alias("n")]
    kept = stored(enough(counted.groupBy("lang", "source", "digest").agg(*sums), "digest").select("lang", "source", "digest", "n", "all_n"), "kept")
    keys = kept.select("lang", "digest").distinct()
    strings = counted.groupBy("lang", "digest").agg(F.min("term").alias("low"), F.max("term").alias("high"))
    strings = stored(strings.join(keys, ["lang", "digest"], "left_semi"), "strings")
    words = strings.where("low = high").select("lang", "digest", F.lit("").alias("twin"), F.col("low").alias("term"))
    whole = kept.withColumn("twin", F.lit(""))
    twins = strings.where("low <> high").select("lang", "digest")
    if twins.isEmpty():
        return whole, words
    apart = counted.join(twins, ["lang", "digest"], "left_semi").groupBy("lang", "source", "digest", "term").agg(*sums)
    apart = stored(enough(apart, "digest", "term").withColumnRenamed("term", "twin"), "twins")
    more = apart.select("lang", "digest", "twin", F.col("twin").alias("term")).distinct()
    whole = whole.join(twins, ["lang", "digest"], "left_anti").unionByName(apart.select("lang", "source", "digest", "n", "all_n", "twin"))
    return stored(whole, "kept"), stored(words.unionByName(more), "strings")


def _groups(rows: DataFrame, kept: DataFrame, words: DataFrame) -> DataFrame:
    """Every (lang, source) with its number in the language, kept terms (v), occurrences (n) and the language's (all_n)."""
    of_lang = words.groupBy("lang").agg(F.count("*").alias("v"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    alike = Window.partitionBy("lang")
    groups = rows.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    return stored(
        groups.fillna(0, ["n", "v"]).withColumns(
            {
                "number": F.row_number().over(alike.orderBy("source")) - 1,
                "all_n": F.sum("n").over(alike),
                "tiles": F.ceil(F.count("*").over(alike) / TILE).cast("int"),
                "blocks": F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK_TERMS)).cast("int"),
            }
        ),
        "groups",
    )


def _share(count: str, total: str) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 v)); decimals hold every product exactly."""
    return F.expr(f"1 + ((CAST({count} AS DECIMAL(20, 0)) + 2) * {SCALE}) div (CAST({total} AS DECIMAL(20, 0)) + 2 * CAST(v AS DECIMAL(20, 0)))")


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    shares = kept.select("lang", "source", "digest", "twin", F.col("n").alias("times")).join(
        groups.select("lang", "source", "number", "tiles", "blocks", "n", "v"), ["lang", "source"]
    )
    block = F.pmod(F.xxhash64("digest", "twin"), F.col("blocks")).cast("int")
    terms = shares.select("lang", "number", "tiles", "digest", "twin", block.alias("block"), _share("times", "n").alias("p"))
    least = F.when(F.col("v") > 0, _share("0", "n")).otherwise(F.lit(1))
    ends = groups.select("lang", "number", "tiles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), least.alias("p"))
    ends = ends.withColumns({"digest": F.lit(None).cast("long"), "twin": F.lit(None).cast("string")})
    own = F.expr(f"number div {TILE}")
    dealt = terms.unionByName(ends).select(
        "*", own.alias("tile"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    )
    dealt = dealt.select("lang", "block", F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u"), "number", "digest", "twin", "p")
    sums = dealt.groupBy("lang", "block", "t", "u").applyInArrow(_block_sums, "lang string, a int, b int, value long, seen long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    # Terms that neither source's tile has come in no block: all of them give the same.
    at = groups.select("lang", "v", "number", least.alias("p"))
    sums = sums.join(at.withColumnRenamed("number", "a"), ["lang", "a"])
    sums = sums.join(at.select("lang", F.col("number").alias("b"), F.col("p").alias("q")), ["lang", "b"])
    sums = sums.select("lang", "a", "b", F.expr("value + (v - seen) * (((p - q) * (p - q)) div (p + q))").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = groups.select("lang", F.col("number").alias("a"), "source")
    items = groups.select("lang", F.col("number").alias("b"), F.col("source").alias("item"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    named = both.join(names, ["lang", "a"]).join(items, ["lang", "b"])
    return named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))


def _block_sums(table: pa.Table) -> pa.Table:
    """Sums of (p - q)^2 / (p + q), floored by term, for each pair of sources of two tiles, over the terms of a block that they have."""
    number = table.column("number").to_numpy()
    p = table.column("p").to_numpy()
    digest = table.column("digest")
    marker = pc.is_null(digest).to_numpy()
    sources, at = np.unique(number, return_inverse=True)
    least = np.ones(len(sources), np.int64)
    least[at[marker]] = p[marker]
    key = digest.filter(pa.array(~marker)).to_numpy()
    twin = _one(table.column("twin").filter(pa.array(~marker))).dictionary_encode()
    _, code = np.unique(key, return_inverse=True)
    code = code.astype(np.int64) * max(1, len(twin.dictionary)) + twin.indices.to_numpy(zero_copy_only=False)
    terms, term = np.unique(code, return_inverse=True)
    shares = np.repeat(least[:, None], len(terms), axis=1)
    shares[at[~marker], term] = p[~marker]
    t, u = table.column("t")[0].as_py(), table.column("u")[0].as_py()
    first = np.nonzero(sources // TILE == t)[0]
    second = np.nonzero(sources // TILE == u)[0]
    a, b, value = [], [], []
    for i in first.tolist():
        others = second[second > i]
        if len(others):
            q, ps = shares[i], shares[others]
            a.append(np.full(len(others), sources[i]))
            b.append(sources[others])
            value.append(((ps - q) ** 2 // (ps + q)).sum(axis=1))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    n = sum(map(len, a))
    types = arrow_schema(lang=pa.string(), a=pa.int32(), b=pa.int32(), value=pa.int64(), seen=pa.int64())
    columns = [[table.column("lang")[0].as_py()] * n, join(a), join(b), join(value), np.full(n, len(terms))]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types.types, strict=True)], schema=types)


def _terms(kept: DataFrame, words: DataFrame, groups: DataFrame, ranks: int) -> DataFrame:
    shares = kept.select("lang", "source", "digest", "twin", F.col("n").alias("times"), F.col("all_n").alias("all_times")).join(
        groups.select("lang", "source", "n", "all_n", "v"), ["lang", "source"]
    )
    shares = shares.select("lang", "source", "digest", "twin", _share("times", "n").alias("p"), _share("all_times", "all_n").alias("q"))
    valued = shares.where("p > q").select("lang", "source", "digest", "twin", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    group = Window.partitionBy("lang", "source")
    best = valued.withColumn("place", F.rank().over(group.orderBy(F.col("value").desc()))).where(F.col("place") <= ranks)
    named = best.join(words, ["lang", "digest", "twin"]).withColumn(
        "rank", F.row_number().over(group.orderBy(F.col("value").desc(), "term"))
    )
    return named.where(F.col("rank") <= ranks).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
