"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import whole_text

KINDS = ("email", "ip", "card", "phone")

#: Base patterns. Possessive loops do not change the matches; they bound the matcher's work and stack.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators, by kind: the same data in looser forms. Their spans overlap freely.
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:\x20?[.,:]\x20?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20.,_/-]{0,2}[0-9]){11,22}(?![0-9])",
    "phone": r"[+(]?[0-9](?:[\x20().,/-]{0,3}[0-9]){6,16}(?![0-9])",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_CONTEXT = {
    "email": r"(?i)mail|contact|write|reach",
    "ip": r"(?i)\bip\b|addr|host|server|node|client",
    "card": r"(?i)card|visa|credit|account|iban|pay",
    "phone": r"(?i)phone|tel|call|fax|mobile|cell",
}

TREES, DEPTH = 20, 3
#: Share of right spans among those that a threshold selects on held-out candidates.
PRECISION = 0.98
#: Characters of context on either side.
WINDOW = 24
FEATURES = (
    "n_chars", "n_digits", "n_groups", "longest_group", "n_spaces", "n_dots", "n_dashes", "n_other", "has_plus",
    "has_paren", "has_at", "has_at_word", "luhn", "parts_fit", "named", "glued_left", "glued_right", "kind_no",
)

_SPAN = "struct<kind:string,start:int,end:int,text:string,left:string,right:string>"


Tree = float | tuple  # a leaf's value, or (feature, threshold, tree up to it, tree above it)


@dataclass(frozen=True)
class Model:
    """Weighted trees, and the least sum of theirs to select a candidate, by kind."""

    trees: list[tuple[float, Tree]] = field(default_factory=list)
    least: dict[str, float] = field(default_factory=dict)

    def score(self, feature: Callable[[str], Column]) -> Column:
        """The trees' sum, from columns by feature name."""
        total = F.lit(0.0)
        for weight, tree in self.trees:
            total = total + F.lit(weight) * _value(tree, feature)
        return F.round(total, 6)


def _value(tree: Tree, feature: Callable[[str], Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    name, threshold, low, high = tree
    return F.when(feature(name) <= F.lit(threshold), _value(low, feature)).otherwise(_value(high, feature))


def matches(text: Column, pattern: str, kind: str) -> Column:
    """All matches as spans: start and end in code points, with the text around them.

    Splitting by the pattern gives the gaps between the matches; the running length of gaps and
    matches gives the offsets.
    """
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return bound(parts, lambda p: bound(F.struct(p.found.alias("found"), p.gaps.alias("gaps"), _starts(p).alias("starts")), lambda q: _placed(q, kind)))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and inside whatever loop it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def _starts(parts: Column) -> Column:
    sizes = F.transform(parts.found, lambda m, i: F.struct(F.char_length(F.get(parts.gaps, i)).alias("gap"), F.char_length(m).alias("own")))
    return F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, s: F.struct((a.at + s.gap + s.own).alias("at"), F.concat(a.out, F.array(a.at + s.gap)).alias("out")),
        lambda a: a.out,
    )


def _placed(parts: Column, kind: str) -> Column:
    spans = F.transform(
        parts.found,
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"),
            F.get(parts.starts, i).alias("start"),
            (F.get(parts.starts, i) + F.char_length(m)).alias("end"),
            m.alias("text"),
            F.right(F.get(parts.gaps, i), F.lit(WINDOW)).alias("left"),
            F.left(F.get(parts.gaps, i + 1), F.lit(WINDOW)).alias("right"),
        ),
    )
    return spans.cast(f"array<{_SPAN}>")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the digits pass the Luhn sum."""
    reverse = F.reverse(F.filter(F.split(digits(text), ""), lambda d: d != ""))
    doubled = F.transform(reverse, lambda d, i: d.cast("int") * (i % 2 + 1))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def holds(kind: str, text: Column) -> Column:
    """Whether a base match of this kind counts."""
    count = F.char_length(digits(text))
    return {
        "email": F.lit(True),
        "ip": text.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": count.between(16, 19) & luhn(text),
        "phone": count.between(8, 15),
    }[kind]


def fits(kind: str, text: Column) -> Column:
    """Whether a loose candidate has a form that data of this kind can have; what has not is no such data."""
    count = F.char_length(digits(text))
    return {
        "email": text.rlike(r"[A-Za-z]{2,}$") & ~text.rlike(r"\.\x20|\x20\."),
        "ip": text.rlike(rf"^{_PART}(\D+){_PART}(?:\1{_PART}){{2}}$"),
        "card": count.between(12, 19) & luhn(text),
        "phone": count.between(8, 15)
        & ~text.rlike(r",|^[0-9]+$|^(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}(?![0-9])")
        & (F.regexp_count(text, F.lit(r"\(")) == F.regexp_count(text, F.lit(r"\)"))),
    }[kind]


def spans_of(text: Column, patterns: dict[str, str]) -> Column:
    """Matches of all kinds, kind by kind; a text without the characters they need is not searched."""
    none = F.array().cast(f"array<{_SPAN}>")
    needs = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))} if patterns is BASE else {}
    if patterns is LOOSE:
        needs["email"] = text.rlike(r"@|(?:\(|\[|\x20)(?:at)(?:\)|\]|\x20)")
    found = [F.when(needs.get(k, text.rlike("[0-9]")), matches(text, patterns[k], k)).otherwise(none) for k in KINDS]
    return F.concat(*found)


def base_spans(text: Column) -> Column:
    """The base patterns' matches that hold, by kind as listed and start."""
    failing = F.lit(False)
    return F.filter(
        spans_of(text, BASE),
        lambda s: F.coalesce(
            F.when(s.kind == "email", holds("email", s.text))
            .when(s.kind == "ip", holds("ip", s.text))
            .when(s.kind == "card", holds("card", s.text))
            .otherwise(holds("phone", s.text)),
            failing,
        ),
    )


def features(span: Column) -> Column:
    """Format and context of a span as a struct of doubles."""
    text = span.text
    groups = F.filter(F.split(text, "[^0-9]+"), lambda g: g != "")
    named = F.lit(False)
    for kind, words in _CONTEXT.items():
        named = named | ((span.kind == kind) & span.left.rlike(words))

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    values = [
        F.char_length(text),
        count("[0-9]"),
        F.size(groups),
        F.coalesce(F.array_max(F.transform(groups, F.char_length)), F.lit(0)),
        count(r"\x20"),
        count(r"\."),
        count("-"),
        count(r"[^\x20.0-9-]"),
        text.startswith("+"),
        count(r"[()]"),
        F.contains(text, F.lit("@")),
        text.rlike(r"(?:\(|\[|\x20)(?:at|dot)(?:\)|\]|\x20)"),
        luhn(text),
        text.rlike(rf"^{_PART}(?:\D+{_PART}){{3}}$"),
        named,
        span.left.rlike("[A-Za-z0-9]$"),
        span.right.rlike("^[A-Za-z0-9]"),
        F.array_position(F.array(*map(F.lit, KINDS)), span.kind),
    ]
    return F.struct(*[F.coalesce(v.cast("double"), F.lit(0.0)).alias(n) for n, v in zip(FEATURES, values, strict=True)])


def overlaps(spans: Column, span: Column) -> Column:
    return F.exists(spans, lambda b: (b.start < span.end) & (span.start < b.end))


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Boosted trees over the features of all candidates, with a threshold per kind.

    There are no labels: base spans that hold are right, with looser spellings of them (a phone
    without plus, a card with dots, an address with a written "at"). Candidates that touch no
    base span are wrong if they fail their kind's format check (``fits``); the others may be
    real data in a loose form, so they are taken for neither. Half of the candidates, by hash, fit the trees, half the thresholds: the least
    score from which on ``PRECISION`` of the candidates are right. A kind that never reaches it
    selects nothing, and neither does anything without right and wrong candidates.

    Nothing is sampled: candidates of equal features, kind, half and label are counted in one
    pass over the documents, and the counts weigh them in the trees and in the thresholds.
    """
    text = whole_text(text_col)
    seen = docs.select(base_spans(text).alias("base"), spans_of(text, LOOSE).alias("loose"))
    unfit = F.lit(False)
    wrong = F.filter("loose", lambda s: ~overlaps(F.col("base"), s) & reduce(lambda out, k: out | ((s.kind == k) & ~fits(k, s.text)), KINDS, unfit))
    rows = seen.select(F.explode(F.concat(_marked(F.col("base"), 1), _marked(_respelled(F.col("base")), 1), _marked(wrong, 0))).alias("m"))
    half = F.pmod(F.xxhash64("m.span.text", "m.span.left", "m.span.right", "m.span.start"), F.lit(2)).alias("half")
    rows = rows.select("m.span.kind", "m.right", half, features(F.col("m.span")).alias("f")).select("kind", "right", "half", "f.*")
    tallied = rows.groupBy("kind", "right", "half", *FEATURES).agg(F.count("*").alias("n"))
    tallied = stored(tallied.orderBy("half", "kind", "right", *FEATURES), "spans")
    found = {(r.half, r.right) for r in tallied.select("half", "right").distinct().collect()}
    if len(found) < 4:
        return Model()
    given = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(tallied.withColumn("n", F.col("n").cast("double")))
    booster = GBTClassifier(featuresCol="x", labelCol="right", weightCol="n", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, cacheNodeIds=False)
    model = booster.fit(given.where("half = 0"))
    trees = [(float(w), _tree(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees, strict=True)]
    held = tallied.where("half = 1").select("kind", "right", "n", Model(trees).score(F.col).alias("score"))
    tallies = held.groupBy("kind", "score").agg(F.sum(F.col("right") * F.col("n")).alias("right"), F.sum("n").alias("n")).collect()
    return Model(trees, {k: least_score([(r.score, r.right, r.n) for r in tallies if r.kind == k]) for k in KINDS})


def least_score(tallies: list[tuple[float, int, int]], precision: float = PRECISION) -> float:
    """The least score from which on the share of right candidates stays at the precision or above."""
    right = seen = 0
    least = float("inf")
    for score, good, n in sorted(tallies, reverse=True):
        right, seen = right + good, seen + n
        if right < precision * seen:
            break
        least = score
    return least


def _marked(spans: Column, right: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s.alias("span"), F.lit(right).alias("right")))


def _respelled(spans: Column) -> Column:
    def loose(s: Column) -> Column:
        text = (
            F.when(s.kind == "email", F.regexp_replace(F.regexp_replace(s.text, "@", " (at) "), r"\.", " (dot) "))
            .when(s.kind == "card", F.regexp_replace(digits(s.text), "([0-9]{4})(?=[0-9])", "$1."))
            .when(s.kind == "phone", F.regexp_replace(s.text, r"^\+", ""))
            .otherwise(F.regexp_replace(s.text, r"\.", ". "))
        )
        return s.withField("text", text)

    return F.transform(spans, loose)


def _tree(node) -> Tree:
    if "Leaf" in node.getClass().getSimpleName():
        return float(node.prediction())
    split = node.split()
    return FEATURES[split.featureIndex()], float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """Rows (id, base, added): spans (kind, start, end in code points, text, left, right) of every whole text.

    ``base`` are the base patterns' spans. ``added`` are candidates of the loose generators
    that the trees score at their kind's threshold or above and that overlap neither a base
    span nor a better added one (of equal ones the first, in order of start, end and kind).
    Everything stays inside the row: no shuffle, no Python.

    A null text counts as empty and has no spans; every row gives a row, repeated or null ids
    included; an empty table gives an empty result.
    """
    model = model or fit(docs, text_col)
    none = F.array().cast(f"array<{_SPAN}>")
    base = docs.select(F.col(id_col), whole_text(text_col).alias("text")).withColumn("base", base_spans(F.col("text")))
    if not any(x < float("inf") for x in model.least.values()):
        return base.select(id_col, "base", none.alias("added"))
    free = F.filter(spans_of(F.col("text"), LOOSE), lambda s: ~overlaps(F.col("base"), s))
    described = F.transform(free, lambda s: F.struct(s.alias("span"), features(s).alias("f")))
    scored = F.transform(described, lambda c: F.struct(c.span.alias("span"), model.score(c.f.getField).alias("score")))

    def enough(c: Column) -> Column:
        reached = F.lit(False)
        for kind, least in model.least.items():
            reached = reached | ((c.span.kind == kind) & (c.score >= F.lit(least)))
        return reached

    best = F.array_sort(
        F.transform(
            F.filter(scored, enough),
            lambda c: F.struct((-c.score).alias("rank"), c.span.start.alias("start"), c.span.end.alias("end"), c.span.kind.alias("kind"), c.span.alias("span")),
        )
    )
    kept = F.aggregate(best, none, lambda out, c: F.when(overlaps(out, c), out).otherwise(F.concat(out, F.array(c.span))))
    return base.select(id_col, "base", kept.alias("added"))
