"""N-gram Jaccard join: globally ordered shingle sets in a prefix tree, traversed with length bounds."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import LOWER, SPACES, UPPER, components, fresh, in_batches

#: Shingles, about, of the documents that one prefix tree holds.
BLOCK_SHINGLES = 200_000
#: Words, at most, whose hashes a task keeps.
KNOWN_WORDS = 200_000

_FOLD = str.maketrans(UPPER, LOWER)
_TO_SPACE = {ord(c): " " for c in SPACES}
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingle_set(text: str | None, size: int, known: dict[str, int]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; fewer words than ``size`` make one shingle."""
    words = [w for w in (text or "").translate(_FOLD | _TO_SPACE).split(" ") if w]
    if not words:
        return np.zeros(0, np.int64)
    if len(known) > KNOWN_WORDS:
        known.clear()
    hashes = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            known[w] = h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        hashes[i] = h
    size = min(size, len(words))
    count = len(words) - size + 1
    made = np.full(count, size, np.uint64)
    for k in range(size):
        made = (made ^ hashes[k : k + count]) * _A
        made ^= made >> np.uint64(29)
    made = (made ^ (made >> np.uint64(30))) * _B
    made = (made ^ (made >> np.uint64(27))) * _C
    return np.unique((made ^ (made >> np.uint64(31))).view(np.int64))


def classes(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """Rows (id, n_shingles, component): documents linked at ``percent`` or more Jaccard similarity.

    A text's words are split at ASCII white space, A-Z lower-cased; its set is its distinct
    shingles of ``words`` words. ``component`` is the smallest id that links lead to.

    1. One pass makes each set, its digest, and the part of the set that comes first by hash.
       Equal sets share one representative.
    2. Prefix filter: two linked sets must share so many hashes of those parts. Hashes that one
       set alone holds rule most sets out; the rest keep their rarest shared hashes.
    3. Sets that share hashes are laid together in blocks of bounded size. Each block, and the
       sets of two blocks that share hashes across them, is joined in one task by a prefix tree
       (see ``tree_links``), which returns a spanning set of links, so a group of copies never
       becomes all its pairs.
    4. The links' connected components are the classes. Every link is found; none is capped.

    The id must be a whole number. A null or empty text has the empty set and links with
    nothing. Rows with a null id are returned with a null component. Rows that repeat an id are
    one node, each row with its own set size. An empty table gives an empty result.
    """
    marks = stored(_signatures(docs, words, percent, id_col, text_col), "signatures")
    first = marks.where("id IS NOT NULL AND size > 0").groupBy("mark").agg(F.min("id").alias("first"))
    routed = stored(_routed(marks, first, percent), "routed")
    if routed.isEmpty():
        found = docs.sparkSession.createDataFrame([], "node long, component long")
    else:
        blocks = stored(_blocks(routed, block_shingles), "blocks")
        sets = _sets(docs, blocks, words, id_col, text_col)
        placed = _tasks(routed, blocks).join(sets, "id")
        links = placed.groupBy("a", "b").applyInArrow(_join_function(percent), "a long, b long")
        found = stored(components(links), "components")
    named = marks.select("id", "size", "mark").join(first, "mark", "left")
    return named.join(found, F.col("first") == F.col("node"), "left").select(
        F.col("id").alias(id_col),
        F.col("size").cast("long").alias("n_shingles"),
        F.when(F.col("id").isNotNull() & (F.col("size") > 0), F.coalesce("component", "first")).otherwise(F.col("id")).alias("component"),
    )


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the smallest id of every class; rows that repeat it, and rows with a null id, stay."""
    lost = fresh(docs, "_lost")
    found = classes(docs, words, percent, id_col, text_col)
    out = found.where(F.col("component") < F.col(id_col)).select(F.col(id_col).alias(lost)).distinct()
    return docs.join(out, F.col(id_col) == F.col(lost), "left_anti")


def spare(n, percent: int):
    """How many elements of a set of size ``n`` a linked set may lack; ints or columns."""
    if isinstance(n, Column):
        return F.floor(n * (100 - percent) / 100).cast("int")
    return n * (100 - percent) // 100


def least_shared(n: int, percent: int) -> int:
    """Elements that the leading parts of a set of size ``n`` and of any linked set share at least."""
    return max(1, spare(-(-n * percent // 100), percent))


def part_size(n: int, percent: int) -> int:
    """Size of the leading part: enough that ``least_shared`` elements of it are in a linked set."""
    return min(n, spare(n, percent) + max(1, spare(n, percent)))


def _signatures(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("size", pa.int32()), ("mark", pa.binary()), ("least", pa.int32()), ("p", pa.int32()), ("part", pa.list_(pa.int64()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known: dict[str, int] = {}
        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                own = shingle_set(text.as_py(), words, known)
                n = len(own)
                mark = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                part = own[: part_size(n, percent)].tolist()
                yield key, n, mark, least_shared(n, percent), len(part), part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(rows(batches), schema)

    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return whole.mapInArrow(run, "id long, size int, mark binary, least int, p int, part array<long>")


def _routed(marks: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """Rows (id, size, token): the rarest shared hashes of every set that may have a linked set.

    Of a leading part with p hashes, a linked set's part has ``least`` or more. In any common
    order, here rarest first, one of them is among the first p - least + 1. Hashes that no other
    set has take places in that order but lead nowhere.
    """
    chosen = marks.join(first.select(F.col("first").alias("id"), "mark"), ["id", "mark"], "left_semi")
    hashes = chosen.select("id", F.explode("part").alias("token"))
    shared = hashes.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    own = hashes.join(shared, "token").groupBy("id").agg(F.sort_array(F.collect_set(F.struct("n", "token"))).alias("own"))
    own = own.join(chosen.select("id", "size", "least", "p"), "id")
    places = F.col("p") - F.col("least") + 1 - (F.col("p") - F.size("own"))
    own = own.where((F.size("own") >= F.col("least")) & (places > 0))
    return own.select("id", "size", F.explode(F.slice("own", 1, places)).alias("h")).select("id", "size", "h.token")


def _blocks(routed: DataFrame, block_shingles: int) -> DataFrame:
    """Rows (id, block): sets that share hashes together where they fit, by two rounds of smallest labels.

    Only the cost depends on this choice: pairs of blocks are found from the hashes themselves.
    """
    label = routed.select("id", "token", F.col("id").alias("label"))
    for _ in range(2):
        by_token = label.groupBy("token").agg(F.min("label").alias("low"))
        by_id = routed.join(by_token, "token").groupBy("id").agg(F.min("low").alias("label"), F.first("size").alias("size"))
        label = routed.select("id", "token").join(by_id, "id")
    by_id = stored(by_id, "labels")
    total = by_id.agg(F.sum("size")).first()[0]
    count = max(1, math.ceil(total / block_shingles))
    weight = by_id.groupBy("label").agg(F.ceil(F.sum("size") / block_shingles).alias("pieces"))
    piece = F.pmod(F.xxhash64("id"), F.col("pieces"))
    block = F.when(F.col("pieces") == 1, F.pmod(F.xxhash64("label"), F.lit(count))).otherwise(F.xxhash64("label", piece))
    return by_id.join(weight, "label").select("id", block.alias("block"))


def _tasks(routed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (a, b, id, side): each block as a whole, and the sets of two blocks that share hashes with the other one."""
    held = stored(routed.select("id", "token").join(blocks, "id"), "held")
    places = held.select("token", F.col("block").alias("other")).distinct()
    spread = places.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    across = held.join(spread, "token").join(places, "token").where("block <> other")
    across = across.selectExpr("least(block, other) AS a", "greatest(block, other) AS b", "id", "int(block > other) AS side").distinct()
    return blocks.selectExpr("block AS a", "block AS b", "id", "0 AS side").union(across)


def _sets(docs: DataFrame, blocks: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("members", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known: dict[str, int] = {}
        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                yield key, shingle_set(text.as_py(), words, known).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(rows(batches), schema)

    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return whole.join(blocks.select("id"), "id", "left_semi").mapInArrow(run, "id long, members binary")


def _join_function(percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_pylist()
        sets = [np.frombuffer(m, np.int64) for m in table.column("members").to_pylist()]
        sides = np.array(table.column("side").to_pylist())
        across = table.column("a")[0].as_py() != table.column("b")[0].as_py()
        links = tree_links(sets, percent, sides if across else None)
        return pa.table({"a": pa.array([ids[i] for i, _ in links], pa.int64()), "b": pa.array([ids[j] for _, j in links], pa.int64())})

    return run


def tree_links(sets: list[np.ndarray], percent: int, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all sets which similar pairs connect; with ``sides`` only pairs across count.

    The elements are ordered by falling frequency and the sets are stored as a prefix tree in
    that order: after sorting, a node is a run of sets with a common beginning. A depth-first
    walk carries, for all sets that may still match, the overlap with the node's beginning, so
    that sets with a common beginning share the count. A set leaves the walk where the overlap
    plus what is left of it, or of the longest set below the node, cannot reach the bound, and
    where all sets below the node are in its own component already.
    """
    m = len(sets)
    if m < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    shared = count[inverse] > 1
    ranks, owner = rank[inverse[shared]], owner[shared]
    ranks = ranks[np.lexsort((ranks, owner))]
    cuts = np.cumsum(np.bincount(owner, minlength=m))[:-1]
    paths = np.split(ranks, cuts)
    order = sorted(range(m), key=lambda i: paths[i].astype(">u4").tobytes())
    paths = [paths[i] for i in order]
    sizes = sizes[order]
    sides = None if sides is None else sides[order]
    lengths = np.array([len(p) for p in paths])
    common = np.array([0] + [_common(a, b) for a, b in zip(paths, paths[1:], strict=False)])
    holders = np.repeat(np.arange(m), lengths)
    by_rank = np.concatenate(paths) if m else ranks
    sort = np.argsort(by_rank, kind="stable")
    holders, starts = holders[sort], np.searchsorted(by_rank[sort], np.arange(int(by_rank.max(initial=-1)) + 2))

    component = np.arange(m)
    links: list[tuple[int, int]] = []
    walk = [(0, m, 0, np.arange(m), np.zeros(m, np.int64))]
    while walk:
        low, high, depth, live, overlap = walk.pop()
        own = component[low]
        if (component[low:high] == own).all():
            other = component[live] != own
            live, overlap = live[other], overlap[other]
        if not len(live):
            continue
        deep = int(common[low + 1 : high].min()) if high - low > 1 else int(lengths[low])
        edge = paths[low][depth:deep]
        if len(edge):
            seen = np.concatenate([holders[starts[r] : starts[r + 1]] for r in edge.tolist()])
            overlap = overlap + np.bincount(seen, minlength=m)[live]
        least, longest = int(sizes[low:high].min()), int(lengths[low:high].max()) - deep
        reach = overlap + np.minimum(longest, lengths[live] - overlap)
        fits = ((100 + percent) * reach >= percent * (sizes[live] + least)) & (percent * least <= 100 * sizes[live])
        live, overlap = live[fits], overlap[fits]
        if not len(live):
            continue
        at = low
        while at < high and lengths[at] == deep:
            near = (100 + percent) * overlap >= percent * (sizes[live] + sizes[at])
            for other in live[near].tolist():
                if component[other] != component[at] and (sides is None or sides[other] != sides[at]):
                    links.append((order[at], order[other]))
                    component[component == component[other]] = component[at]
            at += 1
        bounds = [at, *(at + 1 + np.nonzero(common[at + 1 : high] <= deep)[0]).tolist(), high]
        walk.extend((a, b, deep, live, overlap) for a, b in zip(bounds, bounds[1:], strict=False) if a < b)
    return links


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.nonzero(a[:n] != b[:n])[0]
    return int(differ[0]) if len(differ) else n
