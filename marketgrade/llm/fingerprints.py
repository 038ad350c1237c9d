"""I-Match fingerprints: terms in a band of document frequency, sorted and hashed for randomised lexicons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import whole_text

#: The band: shares of the documents that hold a term (idf from ln 10 to ln 100).
LEAST_SHARE, MOST_SHARE = 0.01, 0.1
#: Randomised lexicons, each with a quarter of the band's terms, chosen by bits of the term's hash.
LEXICONS = 10
#: A lexicon with fewer terms of a text says too little; all terms of the text stand in for them.
LEAST_TERMS = 3
_BITS = 6


def terms(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda t: t != ""))


def term_code(term: Column) -> Column:
    """A term as a whole number: the first 60 bits of its MD5."""
    return F.conv(F.substring(F.md5(term), 1, 15), 16, 10).cast("long")


def band_codes(
    docs: DataFrame, text_col: str = "text", least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE
) -> list[int]:
    """Codes of the terms that between ``least_share`` and ``most_share`` of all documents hold.

    Counts cover all documents and are pre-aggregated per task. The band's size is bounded
    whatever the number of documents: at most (mean distinct terms of a text) / ``least_share``
    terms can reach the least share.
    """
    total = docs.count()
    found = (
        docs.select(F.explode(terms(whole_text(text_col))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("n"))
        .where((F.col("n") >= F.lit(total) * F.lit(least_share)) & (F.col("n") <= F.lit(total) * F.lit(most_share)))
    )
    return sorted({r.code for r in found.select(term_code(F.col("term")).alias("code")).collect()})


def with_hashes(rows: DataFrame, columns: dict[str, str], band: list[int]) -> DataFrame:
    """``rows`` with text columns (keys) turned into fingerprints (values): ``LEXICONS`` hashes of 16 hex digits.

    Each step is a projection of its own, so that the terms of a text are cut, coded and looked
    up once and not once per lexicon.
    """
    # One folded literal: an expression per term would be too large a plan.
    lexicon = F.split(F.lit(",".join(map(str, band))), ",").cast("array<bigint>") if band else F.array().cast("array<bigint>")
    rest = [c for c in rows.columns if c not in columns]
    coded = rows.select(*rest, *[F.array_sort(F.transform(terms(F.col(c)), term_code)).alias(c) for c in columns])
    chosen = coded.select(*rest, *[F.struct(F.col(c).alias("all"), F.array_intersect(c, lexicon).alias("band")).alias(c) for c in columns])
    return chosen.select(*rest, *[_hashes(F.col(c)).alias(new) for c, new in columns.items()])


def _hashes(codes: Column) -> Column:
    own = F.array(*[F.filter(codes.getField("band"), _in_lexicon(k)) for k in range(LEXICONS)])
    enough = lambda terms: F.when(F.size(terms) >= LEAST_TERMS, terms).otherwise(codes.getField("all"))
    return F.transform(own, lambda t: F.substring(F.md5(F.array_join(enough(t).cast("array<string>"), ",")), 1, 16))


def _in_lexicon(k: int):
    return lambda code: F.shiftright(code, _BITS * k).bitwiseAND(F.lit(3)) == 0


def likeness(a: Column, b: Column) -> Column:
    """Share of the lexicons with equal hashes."""
    same = F.filter(F.sequence(F.lit(0), F.lit(LEXICONS - 1)), lambda i: F.get(a, i) == F.get(b, i))
    return F.size(same) / F.lit(float(LEXICONS))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: list[int] | None = None) -> DataFrame:
    """Rows (id, hashes): the fingerprint of every whole text.

    Equal texts have equal fingerprints. Two texts without terms in the band are alike only if
    all their terms are equal. A null text counts as empty; every row gives a row; an empty
    table gives an empty result.
    """
    band = band_codes(docs, text_col) if band is None else band
    rows = docs.select(F.col(id_col), whole_text(text_col).alias("_text"))
    return with_hashes(rows, {"_text": "hashes"}, band)


def next_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, half, next): every id, half its text's length, and the next id; after the last comes the first.

    Only ids are sorted, by range partitions; a place is the partition's offset plus the place
    inside it, so no task holds more than its range.
    """
    ids = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    ids = ids.agg(F.max(F.floor(F.char_length(whole_text(text_col)) / 2)).cast("int").alias("half"))
    placed = stored(ids.sort("id").withColumn("at", F.monotonically_increasing_id()), "order")
    part = F.shiftright("at", 33)
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, total = {}, 0
    for p, n in sizes:
        before[p], total = total, total + n
    offset = F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)]) if before else F.create_map(F.lit(0), F.lit(0))
    placed = placed.select("id", "half", (F.element_at(offset, part.cast("int")) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))
    after = placed.select(F.col("id").alias("next"), F.pmod(F.col("place") - 1, F.lit(max(total, 1))).alias("place"))
    return stored(placed.join(after, "place").select("id", "half", "next"), "next")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    In the edited text the last half of the code points (rounded down) gives way to as many
    of the first ones of the next document's text, in order of ids. Result: id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts move once, by id, for both sides of the pairing; of a next text only the needed
    beginning moves again. Repeated ids: each row is edited with the next larger id's text (of
    several, the smallest). A null id has no next document: its last half is cut off and
    near_next is null. A null text counts as empty. An empty table gives an empty result.
    """
    band = band_codes(docs, text_col)
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    known = rows.where("id IS NOT NULL")
    following = next_ids(docs, id_col, text_col)
    heads = (
        known.alias("k")
        .join(following.select(F.col("id").alias("before"), "half", "next"), F.col("k.id") == F.col("next"))
        .select("before", F.substring("k.text", F.lit(1), F.col("half")).alias("head"))
        .groupBy("before")
        .agg(F.min("head").alias("head"))
    )
    paired = known.join(heads, F.col("id") == F.col("before"), "left").select("id", "text", "head")
    paired = paired.unionByName(rows.where("id IS NULL").withColumn("head", F.lit("")))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("head", F.lit("")), F.lit(1), half))
    paired = paired.select("id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    paired = paired.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "text", "edited")
    prints = stored(with_hashes(paired, {"text": "own", "edited": "other"}, band), "fingerprints")
    theirs = prints.groupBy(F.col("id").alias("next")).agg(F.min("own").alias("next_own"))
    return (
        prints.join(following.select("id", "next"), "id", "left")
        .join(theirs, "next", "left")
        .select(
            F.col("id").alias(id_col),
            "n_chars",
            "edited_sha256",
            F.array_join("own", "-").alias("fingerprint"),
            F.array_join("other", "-").alias("edited_fingerprint"),
            likeness(F.col("own"), F.col("other")).alias("near_edited"),
            F.when(F.col("next_own").isNotNull(), likeness(F.col("own"), F.col("next_own"))).alias("near_next"),
        )
    )
