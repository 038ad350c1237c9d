"""WARC archives: writing page records, and reading them back along the verified chain of records."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .common import whole_text

#: Fixed by the WARC format.
MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"

#: Payloads of at least so many bytes are stored once.
LEAST_PAYLOAD = 0
#: Records of one archive file, at most.
RECORDS_PER_FILE = 50_000
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of the data in base32: 40 hex digits, five at a time, become 32 letters."""
    digest = F.sha1(data)
    fives = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*fives), _DIGITS, _BASE32)


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_payload: int = LEAST_PAYLOAD,
) -> None:
    """Write one WARC record per page to files in ``folder``; equal payloads are stored once.

    Of equal payloads of at least ``least_payload`` bytes the page with the smallest id is a
    response record; the others are revisit records, without payload, that refer to it.
    Smaller payloads are all responses. Payloads are grouped by digest only; the payload itself
    moves if the list of revisits is too large to be sent to every task, which Spark decides by
    the size of the stored list.

    A null payload is an empty one, a null URL leaves the target out, line breaks in URLs become
    spaces. Pages with a null id are responses without a record id. Rows that repeat id and
    payload are responses alike. No pages write no files.
    """
    payload = whole_text(payload_col)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    digests = stored(
        rows.select("id", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").alias("size")).where(F.col("size") >= least_payload),
        "digests",
    )
    first = digests.groupBy("digest").agg(F.min("id").alias("first"))
    revisits = stored(digests.join(first, "digest").where("id <> first").select("id", "digest", "first").distinct(), "revisits")
    marked = rows.withColumn("digest", base32_sha1(F.col("payload")))
    marked = marked.join(revisits, ["id", "digest"], "left")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit(END),
    )
    again = F.col("first").isNotNull()
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload")))
    url = F.regexp_replace("url", r"[\r\n]+", " ")
    lines = F.concat_ws(
        "\r\n",
        F.when(again, F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.col("id").cast("string"), F.lit(">")),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(again, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    record = F.concat(F.lit(MAGIC), lines, F.lit(END), block)
    writer = marked.select(record.alias("value")).write.option("lineSep", END)
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all WARC files of a folder: page_id, payload_bytes, payload_digest, record_type, refers_to, url, file, offset.

    Files are read in splits, cut wherever the magic line occurs. Each piece is a candidate
    record; its header gives the offset of its successor. A piece list per file, without the
    payloads, goes to one task, where pointer jumping from the file's start keeps the reachable
    candidates in a logarithmic number of steps. Magic lines inside payloads are not reached;
    a payload that holds some is put together again from its pieces, which are found by their
    digest, so that files may be split anew at any time.

    A record whose length does not lead to another record or to the end of the file ends the
    chain: what follows in that file is not returned. A missing header field is null. An empty
    folder gives an empty result. Digest and length are those of the payload that was read; for
    revisits those that the record states.
    """
    if not _has_files(spark, folder):
        return spark.createDataFrame([], f"page_id long, {_FIELDS.removeprefix('id long, ')}, file string, offset long")
    pieces = _pieces(spark, folder)
    mark = F.sha1("value").alias("mark")
    light = pieces.select("file", "block", "n", F.octet_length("value").cast("long").alias("size"), mark, *_parsed())
    chain = stored(light.groupBy("file").applyInArrow(_verified, f"{_KEYS}, {_FIELDS}"), "chain")
    whole = chain.where("parts = 1").select("file", "offset", *_names())
    split = chain.where("parts > 1").select("file", "offset", "part", "mark")
    if not split.isEmpty():
        # The files are read again, and maybe in other splits, so pieces are known by what they hold.
        wanted = split.select("mark").distinct()
        texts = pieces.select(mark, "value").join(wanted, "mark", "left_semi").dropDuplicates(["mark"])
        texts = (
            split.join(texts, "mark")
            .groupBy("file", "offset")
            .agg(F.array_sort(F.collect_list(F.struct("part", "value"))).alias("found"))
            .select("file", "offset", F.array_join(F.col("found.value"), MAGIC).alias("value"))
        )
        whole = whole.union(texts.select("file", "offset", *_parsed()).select("file", "offset", *_names()))
    return whole.withColumnRenamed("id", "page_id").select("page_id", *_names()[1:], "file", "offset")


_KEYS = "file string, mark string, offset long, part int, parts int"
_FIELDS = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _names() -> list[str]:
    return [f.split()[0] for f in _FIELDS.split(", ")]


def _has_files(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(path) and any(not s.getPath().getName().startswith(("_", ".")) for s in files.listStatus(path))


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.read.option("lineSep", MAGIC).text(folder)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"),
        "value",
    )


def _parsed() -> list[Column]:
    """Header fields of a piece, and its payload's length and digest, if it is a record of its own."""
    value = F.col("value")
    split = F.instr(value, END)
    head = F.when(split > 0, F.substring_index(value, END, 1))

    def field(name: str) -> Column:
        found = F.regexp_extract(F.concat(F.lit("\r\n"), head), rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
        return F.when(found != "", found)

    def page(name: str) -> Column:
        return F.regexp_extract(field(name), r"page:(-?\d+)", 1).try_cast("long")

    kind = field("WARC-Type")
    body = F.substr(value, split + 4)
    # A block without HTTP headers is all payload.
    headers = F.when(F.instr(body, END) > 0, F.substring_index(body, END, 1))
    stated = F.regexp_extract(headers, r"(?i)\r\nContent-Length:[ \t]*(\d+)", 1).try_cast("long")
    content = field("Content-Length").try_cast("long")
    head_bytes, http_bytes = F.octet_length(head) + 4, F.coalesce(F.octet_length(headers) + 4, F.lit(0))
    payload_size = content - http_bytes
    size = F.least(F.greatest(payload_size, F.lit(0)), F.lit(2**31 - 1)).cast("int")
    payload = F.substring(value.cast("binary"), head_bytes + http_bytes + 1, size)
    again = kind == "revisit"
    return [
        head_bytes.cast("long").alias("head_bytes"),
        content.alias("content_bytes"),
        page("WARC-Record-ID").alias("id"),
        F.when(again, stated).otherwise(payload_size).alias("payload_bytes"),
        F.when(again, F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "")).otherwise(base32_sha1(payload)).alias("payload_digest"),
        kind.alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
        field("WARC-Target-URI").alias("url"),
    ]


def _verified(table: pa.Table) -> pa.Table:
    """The pieces of one file's reachable records, with the place of each piece in its record."""
    table = table.sort_by([("block", "ascending"), ("n", "ascending")])
    magic = len(MAGIC)
    size = table.column("size").to_numpy()
    count = len(size)
    # Piece 0 is what comes before the first magic line; every other piece has the line before it.
    ends = np.cumsum(size + magic) - magic
    starts = np.concatenate([[0], ends[:-1]])
    head = table.column("head_bytes").fill_null(-1).to_numpy()
    content = table.column("content_bytes").fill_null(-1).to_numpy()
    sound = (head >= 0) & (content >= 0)
    sound[0] = False
    after = np.where(sound, starts + magic + head + content + 4, -1)
    # Candidates 1 to count - 1, the end of the file as `count`, and `count + 1` for nowhere.
    places = np.concatenate([starts[1:], ends[-1:]])
    at = np.minimum(np.searchsorted(places, after), count - 1)
    to = np.where(places[at] == after, at + 1, count + 1)
    jump = np.concatenate([to, [count, count + 1]])
    reached = np.zeros(count + 2, bool)
    if count > 1 and starts[1] == 0:
        reached[1] = True
    for _ in range(max(1, count).bit_length() + 1):
        reached[jump[reached]] = True
        jump = jump[jump]
    chain = np.nonzero(reached[:count] & (to <= count))[0]
    parts = to[chain] - chain
    pick = np.repeat(chain, parts) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    kept = table.take(pa.array(pick))
    columns = {
        "file": kept.column("file"),
        "mark": kept.column("mark"),
        "offset": pa.array(np.repeat(starts[chain], parts), pa.int64()),
        "part": pa.array(pick - np.repeat(chain, parts), pa.int32()),
        "parts": pa.array(np.repeat(parts, parts), pa.int32()),
    }
    return pa.table(columns | {name: kept.column(name) for name in _names()})
