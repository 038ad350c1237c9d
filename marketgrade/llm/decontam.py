"""Benchmark decontamination: BM25 over test items with block-max bounds, then overlap checks."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import arrow_schema, as_batch

K1, B = 1.2, 0.75
#: Items that share one upper bound in a posting list; more of them, being unrelated, let too many passages through.
BLOCK_ITEMS = 2
#: Words of a passage; half of them are the next passage's first words.
PASSAGE_WORDS = 128
#: Longest piece of an item that is indexed as one unit; half a passage, so that some passage holds it whole.
UNIT_WORDS = 64
#: Share of a unit's own BM25 score that a passage must reach.
SCORE_SHARE = 0.5
#: Words in the shingles of the final check, and the shares of question and answer that must be found.
SHINGLE, QUESTION_SHARE, ANSWER_SHARE = 5, 0.5, 0.5
#: Bytes of item text (UTF-8) in one index; more items are indexed and searched part by part.
PART_BYTES = 4 << 20
#: Above the rounding of a sum of single-precision bounds over the terms of a passage.
BOUND_SLACK = 1e-4
#: Cells, at most, of a dense table of block bounds; a larger one is kept sparse.
TABLE_CELLS = 4 << 20

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Punctuation and symbols, which part words; letters, digits and combining marks make them.
_MARKS = "".join(c for c in map(chr, [*range(0x3100), *range(0xFE10, 0xFF70)]) if unicodedata.category(c)[0] in "PS")
_WORD = re.compile(rf"[^\s{re.escape(_MARKS)}]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """An item's words up to its last sentence, and those of the last; one sentence is both."""
    parts = [p for p in _SENTENCE.split(text or "") if p.strip()]
    if len(parts) < 2:
        return words_of(text), words_of(text)
    return words_of(" ".join(parts[:-1])), words_of(parts[-1])


def with_question(question: list[str], answer: list[str]) -> list[str]:
    """A short answer behind the end of its question, of which half the shingles lie in the question alone; else none."""
    return question[-(len(answer) + SHINGLE - 1) :] + answer if 0 < len(answer) < SHINGLE <= len(question) else []


def shingles(words: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


@dataclass(frozen=True)
class Statistics:
    """Number of units of the whole benchmark and their words, and the number that hold a term, for a part's terms."""

    units: int = 0
    words: int = 0
    frequency: dict[str, int] = field(default_factory=dict)


def units_of(text: str | None) -> list[list[str]]:
    """The words of an item in pieces of ``UNIT_WORDS``."""
    words = words_of(text)
    return [words[i : i + UNIT_WORDS] for i in range(0, len(words), UNIT_WORDS)]


class Index:
    """An inverted index of item units; impacts are BM25 scores as shares of the unit's own score.

    ``postings`` has, by term, the unit numbers in rising order and their impacts; ``bounds``
    the largest impact by block of ``BLOCK_ITEMS`` units, for the block-max checks. Without
    ``statistics`` the items are taken for the whole benchmark.
    """

    def __init__(self, items: list[tuple], statistics: Statistics | None = None):
        self.items = [(key, *question_and_answer(text)) for key, text in items]
        units = [(number, words) for number, (_, text) in enumerate(items) for words in units_of(text)]
        self.owner = [number for number, _ in units]
        known = statistics or Statistics(len(units), sum(len(w) for _, w in units), Counter(t for _, words in units for t in set(words)))
        idf = {t: math.log(1 + (known.units - df + 0.5) / (df + 0.5)) for t, df in known.frequency.items()}
        lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for unit, (_, words) in enumerate(units):
            norm = K1 * (1 - B + B * len(words) * known.units / known.words)
            scores = {t: idf[t] * c * (K1 + 1) / (c + norm) for t, c in Counter(words).items()}
            own = sum(scores.values())
            for t, score in scores.items():
                lists[t].append((unit, score / own))
        self.blocks = -(-len(units) // BLOCK_ITEMS)
        self.term = {t: i for i, t in enumerate(lists)}
        self.units = [[u for u, _ in x] for x in lists.values()]
        self.impacts = [[s for _, s in x] for x in lists.values()]
        self.top = np.array([max(x) for x in self.impacts] or [0.0], np.float32)
        self.bounds = [self._block_bounds(u, s) for u, s in zip(self.units, self.impacts, strict=True)]

    @staticmethod
    def _block_bounds(units: list[int], impacts: list[float]) -> dict[int, float]:
        found: dict[int, float] = {}
        for u, s in zip(units, impacts, strict=True):
            found[u // BLOCK_ITEMS] = max(s, found.get(u // BLOCK_ITEMS, 0.0))
        return found

    def search(self, terms: list[int], share: float) -> list[int]:
        """Units that a passage with these distinct terms scores at ``share`` or more: block-max WAND.

        Lists are kept in the order of their current unit. The first place where the lists' top
        impacts add up to the share is the pivot; units before it cannot reach it. Block bounds
        then rule out the pivot's whole block, or the unit is scored.
        """
        lists = [(self.units[t], self.impacts[t], self.bounds[t], float(self.top[t])) for t in terms]
        at = [0] * len(lists)
        live = list(range(len(lists)))
        found = []
        least = share - 1e-9
        while live:
            live.sort(key=lambda i: lists[i][0][at[i]])
            total, pivot = 0.0, -1
            for place, i in enumerate(live):
                total += lists[i][3]
                if total >= least:
                    pivot = place
                    break
            if pivot < 0:
                break
            unit = lists[live[pivot]][0][at[live[pivot]]]
            block = unit // BLOCK_ITEMS
            # Only lists at or before the pivot can hold units up to the next list's current one.
            near = [i for i in live if lists[i][0][at[i]] <= unit]
            if sum(lists[i][2].get(block, 0.0) for i in near) >= least:
                score = 0.0
                for i in near:
                    units, impacts = lists[i][0], lists[i][1]
                    at[i] = bisect_left(units, unit, at[i])
                    if at[i] < len(units) and units[at[i]] == unit:
                        score += impacts[at[i]]
                        at[i] += 1
                if score >= least:
                    found.append(unit)
            else:
                beyond = [lists[i][0][at[i]] for i in live if lists[i][0][at[i]] > unit]
                to = min([(block + 1) * BLOCK_ITEMS, *beyond])
                for i in near:
                    at[i] = bisect_left(lists[i][0], max(to, unit + 1), at[i])
            live = [i for i in live if at[i] < len(lists[i][0])]
        return found

    def dense_bounds(self) -> np.ndarray | None:
        """Block bounds as terms by blocks, to bound many passages at once; None if that were too large."""
        if len(self.bounds) * self.blocks > TABLE_CELLS:
            return None
        table = np.zeros((len(self.bounds), max(1, self.blocks)), np.float32)
        for t, found in enumerate(self.bounds):
            for b, s in found.items():
                table[t, b] = s
        return table

    def highest_bound(self, terms: np.ndarray, table: np.ndarray | None) -> float:
        """The largest bound of a block for a passage with these distinct terms."""
        if table is not None:
            return float(table[terms].sum(axis=0).max())
        total: dict[int, float] = defaultdict(float)
        for t in terms.tolist():
            for b, s in self.bounds[t].items():
                total[b] += s
        return max(total.values())

    def leaks(self, text: str | None, table: np.ndarray | None) -> Iterator[tuple[int, float, float, float]]:
        """Items (number, score, question share, answer share) that a text contains."""
        words = words_of(text)
        get = self.term.get
        ids = [get(w, -1) for w in words]
        if not ids:
            return
        known = np.array(ids, np.int64)
        half = PASSAGE_WORDS // 2
        starts = np.arange(0, max(1, len(ids) - half), half)
        retrieved: set[int] = set()
        for start in starts.tolist():
            terms = np.unique(known[start : start + PASSAGE_WORDS])
            terms = terms[terms >= 0]
            if len(terms) and self.highest_bound(terms, table) >= SCORE_SHARE - BOUND_SLACK:
                retrieved.update(self.owner[u] for u in self.search(terms.tolist(), SCORE_SHARE))
        if not retrieved:
            return
        have = shingles(words)
        for number in sorted(retrieved):
            _, question, answer = self.items[number]
            q = self._share(shingles(question), have, words)
            a = self._share(shingles(answer), have, words)
            joined = with_question(question, answer)
            if joined:
                a = max(a, self._share(shingles(joined), have, words))
            if q >= QUESTION_SHARE and (a >= ANSWER_SHARE or joined and q == 1.0):
                yield number, q, a

    @staticmethod
    def _share(part: set[tuple[str, ...]], have: set[tuple[str, ...]], words: list[str]) -> float:
        """Share of the shingles that the text has; a part shorter than a shingle is looked for as it is."""
        if not part:
            return 1.0
        size = len(next(iter(part)))
        if size < SHINGLE:
            have = shingles(words, size)
        return len(part & have) / len(part)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Rows (id, item, question_share, answer_share): documents that contain a benchmark item.

    Every document is cut into overlapping passages, and every passage is a query. Block-max
    bounds first drop the passages in which no block of items can reach the score; block-max
    WAND finds all units above it in the rest. Retrieved items are verified in the whole
    document by shingles of five words: half of the question's and half of the answer's must
    be there (an item's last sentence counts as its answer). Words are lower-cased and end at
    white space, punctuation and symbols. An answer of fewer than five words is also judged
    together with the end of its question, the better share counts, and a question of five words
    or more that is there as a whole is enough for it.

    The index is sent to every task, in parts of at most ``PART_BYTES`` of item text; the parts
    are searched one after another, so a large benchmark means more passes and not more
    memory in the tasks. Terms are counted once over all items, so the parts do not change the
    scores. The text of all parts passes through the driver and is held there. Documents are never shuffled, so copies and hot sources cost nothing extra.

    Null or empty texts and items match nothing. Repeated rows give repeated result rows, null
    ids are returned as null. An empty table on either side gives an empty result.
    """
    schema = docs.select(F.col(id_col).alias("id")).schema.add("item", benchmark.schema[item_col].dataType)
    schema = schema.add("question_share", "double").add("answer_share", "double")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = None
    for part, known in _parts(benchmark, item_col, item_text_col):
        one = rows.mapInArrow(_search_function(part, known), schema)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.withColumnsRenamed({"id": id_col, "item": item_col})


def _parts(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list[tuple], Statistics]]:
    """Item lists of at most ``PART_BYTES`` each, with the whole benchmark's counts of their terms.

    A single longer item makes a part of its own.
    """
    items = benchmark.where(F.length(F.trim(text_col)) > 0).select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    items = stored(items.withColumn("row", F.monotonically_increasing_id()), "items")
    held = stored(items.select("row", "text").mapInArrow(_unit_terms, "row long, unit long, term string, times long"), "terms")
    n = held.select("row", "unit").distinct().count()
    words = held.agg(F.sum("times")).first()[0]
    frequency = held.groupBy("term").agg(F.count("*").alias("df"))
    counts = held.select("row", "term").distinct().join(frequency, "term").groupBy("row").agg(F.collect_list(F.struct("term", "df")).alias("counts"))
    part, size, known = [], 0, {}
    for row in items.join(counts, "row").orderBy("item", "text").toLocalIterator():
        more = len(row.text.encode("utf-8", "replace"))
        if part and size + more > PART_BYTES:
            yield part, Statistics(n, words, known)
            part, size, known = [], 0, {}
        part.append((row.item, row.text))
        size += more
        known.update((c.term, c.df) for c in row.counts)
    if part:
        yield part, Statistics(n, words, known)


def _unit_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (row, unit, term, times) for each distinct term of each unit."""
    types = arrow_schema(row=pa.int64(), unit=pa.int64(), term=pa.string(), times=pa.int64())
    for batch in batches:
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True):
            found = [(row, number, t, c) for number, words in enumerate(units_of(text.as_py())) for t, c in Counter(words).items()]
            yield as_batch(found, types)


def _search_function(items: list[tuple], known: Statistics):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items, known)
        table = index.dense_bounds()
        for batch in batches:
            types = arrow_schema(id=batch.schema.field("id").type, item=pa.array([items[0][0]]).type, question_share=pa.float64(), answer_share=pa.float64())
            found = [
                (key, index.items[number][0], q, a)
                for key, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True)
                for number, q, a in index.leaks(text.as_py(), table)
            ]
            if found:
                yield as_batch(found, types)

    return run


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``docs`` without the rows whose text contains a benchmark item, judged as in ``leaks``.

    Each row is judged in place, so nothing is shuffled. All columns stay as they are.
    """
    for part, known in _parts(benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(_clean_function(part, known, text_col), docs.schema)
    return docs


def _clean_function(items: list[tuple], known: Statistics, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items, known)
        table = index.dense_bounds()
        for batch in batches:
            clean = [next(index.leaks(t.as_py(), table), None) is None for t in batch.column(text_col)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run
