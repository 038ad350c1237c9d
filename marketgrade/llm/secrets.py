"""Secret scan: patterns, and a lexer that reads assignments, propagates constants and scores literals."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_field

KINDS = ("assign", "access", "hex")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Weights of the words of a target name.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "signature": 0.5, "auth": 0.6, "private": 0.4,
    "access": 0.3, "api": 0.3, "client": 0.2, "encryption": 0.4, "signing": 0.4, "master": 0.2, "key": 0.5, "pass": 0.7,
}
#: Words that say that a name holds something about a secret, and not the secret.
NAME_DISCOUNTS = ("length", "len", "count", "size", "name", "file", "path", "url", "uri", "header", "type", "id", "public", "expiry", "ttl", "field", "example")
#: Name weight times literal weight that makes a secret.
LEAST_SCORE = 0.5

#: A name without any of these weighs nothing: the weighted words that hold no other one.
_STEMS = tuple(w for w in NAME_WEIGHTS if not any(v != w and v in w for v in NAME_WEIGHTS))
_LEX = re.compile(
    r"""(?P<comment>(?:^|(?<=\s))(?:\#|//)[^\n]*)
    |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)
    |(?P<op>:=|=>|==|!=|<=|>=|=|:(?!:))
    |(?P<plus>\+)
    |(?P<word>[A-Za-z0-9_$][A-Za-z0-9_$./\-]*)
    |(?P<line>[\n;,{}])
    |(?P<close>[\])\[(])""",
    re.VERBOSE | re.ASCII,
)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The pattern matches (kind, start, end), by kind."""
    spans = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        spans += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return spans


def name_weight(name: str) -> float:
    """How likely a name is to hold a secret: its words' weights together, at most 1."""
    parts = [p.lower() for p in _PART.findall(name)]
    if any(p in NAME_DISCOUNTS for p in parts):
        return 0.0
    return min(1.0, sum(NAME_WEIGHTS.get(p, 0.0) for p in parts))


def literal_weight(literal: str) -> float:
    """How much a literal looks like a secret: long enough, mixed, no placeholder."""
    if len(literal) < 8 or re.search(r"[\s<>]|\$\{|\{\{|%\(|^\*+$|^x+$", literal, re.IGNORECASE):
        return 0.0
    counts = Counter(literal)
    entropy = -sum(c / len(literal) * math.log2(c / len(literal)) for c in counts.values())
    classes = sum(bool(re.search(p, literal, re.ASCII)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, entropy / 3.0) * (0.6 if classes < 2 else 1.0)


def assignments(text: str) -> Iterator[tuple[str, str, int, int]]:
    """Name-literal pairs (name, literal, start, end) of source and configuration text.

    A statement is name, operator, value; it ends with its line, a comma, semicolon or brace.
    The value is a string, strings joined by plus, a bare word after ``:`` or ``=``, or a name
    assigned earlier, whose literals it then takes over (constant propagation).
    """
    known: dict[str, list[tuple[str, int, int]]] = {}
    name, after_op, value, bare = "", False, [], True
    last = ""
    for m in [*_LEX.finditer(text), None]:
        kind = m.lastgroup if m else "line"
        if kind == "comment":
            continue
        if kind == "line":
            if name and value:
                known[name] = value
                for literal, start, end in value:
                    yield name, literal, start, end
            name, after_op, value, last = "", False, [], ""
        elif kind == "op" and m[0] in (":=", "=>", "=", ":"):
            if after_op and value and m[0] == "=":
                value = []
            name, after_op, bare = (name if after_op and m[0] == ":" else last) or name, True, True
        elif kind in ("string", "word"):
            inner = m[0][1:-1] if kind == "string" else m[0]
            start = m.start() + (kind == "string")
            if not after_op:
                last = inner
            elif kind == "string":
                value.append((inner, start, start + len(inner)))
                last = inner
            elif inner in known:
                value += known[inner]
                last = inner
            elif bare and not value:
                value.append((inner, start, start + len(inner)))
                last = inner
            bare = False
        elif kind == "plus":
            bare = False


def lexed_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str, float]]:
    """Literals assigned to sensitive names that no base span covers: (kind, start, end, name, score)."""
    low = text.lower()
    if not any(s in low for s in _STEMS) or not ("=" in text or ":" in text):
        return []
    best: dict[tuple[int, int], tuple[str, float]] = {}
    for name, literal, start, end in assignments(text):
        weight = name_weight(name)
        score = weight * literal_weight(literal) if weight else 0.0
        if score >= LEAST_SCORE and score > best.get((start, end), ("", 0.0))[1]:
            best[start, end] = name, score
    taken = sorted((s, e) for _, s, e in base)
    found = []
    at = 0
    for (start, end), (name, score) in sorted(best.items()):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at == len(taken) or taken[at][0] >= end:
            found.append(("assign", start, end, name, score))
    return found


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, spans): all secrets of a text, in order of start and kind.

    A span has kind, start and end (code points, end exclusive), ``base`` (found by a pattern),
    and the target name and score of a lexed literal. Texts are read whole, each on its own.
    A null text is empty and has no spans; null and repeated ids give a row each; an empty
    table gives an empty result.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("name", pa.string()), ("score", pa.float64())])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = with_field(
        rows.select("id").schema, "spans", "array<struct<kind:string,start:int,end:int,base:boolean,name:string,score:double>>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [scan(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.list_(span))], names=["id", "spans"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def scan(text: str | None) -> list[dict]:
    text = text or ""
    base = base_spans(text)
    spans = [dict(kind=k, start=s, end=e, base=True, name=None, score=None) for k, s, e in base]
    spans += [dict(kind=k, start=s, end=e, base=False, name=n, score=x) for k, s, e, n, x in lexed_spans(text, base)]
    return sorted(spans, key=lambda x: (x["start"], KINDS.index(x["kind"]), x["end"]))
