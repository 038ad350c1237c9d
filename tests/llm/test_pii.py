"""Personal data: base spans against Python's regular expressions, the model on held-out spellings."""

import re

from marketgrade.llm import pii
from marketgrade.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                "card": 16 <= len(digits) <= 19 and plain_luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


ODD = [
    None, "", "a@b.co_x@d.com y@z", "1.2.3.4.5 300.1.1.1 000.0255.1.1 1.2.3", "4111 1111-1111 1111 4111111111111112 0000000000000000000",
    "+1 (555) 123-4567. +12345678901234567 +1-2 tel +49 30 123456", "\U0001f600é me@ex.org 10.0.0.1\U0001f600+44 20 7946 0958", "a" * 5000 + "@" + "b." * 3000 + "c",
    "4539 1488 0343 6467" + " 1" * 300, "x" * 300 + "@y " * 200, "9" * 4000, "+" + "1 " * 3000, "mail me@host.com,you@host.org;1.1.1.1,2.2.2.2",
]


def test_base_spans(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-i, t) for i, t in enumerate(ODD)] + [(None, ODD[2])], "doc_id long, text string")
    rows = docs.union(odd)
    for r in rows.select("text", pii.base_spans(pii.whole_text("text")).alias("s")).collect():
        assert [(x.kind, x.start, x.end) for x in r.s] == plain_base(r.text)
        assert all((r.text or "")[x.start : x.end] == x.text for x in r.s)


def test_query_keeps_base_spans_and_rows(spark):
    rows = QUERIES["op7_pii"](spark, FOLDER).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in base) for kind in pii.KINDS]
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r.spans.split(","))


def written(n):
    """Texts with base spans, loose spellings and plain numbers."""
    rows = []
    for i in range(n):
        number = f"{400 + i % 500}"
        rows.append((i, f"call +1 ({number}) 555-{1000 + i} or mail user{i}@site{i % 7}.example.com from 10.{i % 250}.3.{i % 200} in {1900 + i % 100}, item {i}{i}0012, ratio 3.{i}, about 12 of {i} at 7,0{i % 10}1,2{i % 10}3,456 end"))
    return rows


def test_model_adds_loose_spellings_and_leaves_numbers(spark):
    rows = [*written(300), (9001, "phone 1 (444) 555-7777 today"), (9002, "mail jo (at) site3 (dot) example (dot) com now"), (9003, "in 1984 we sold 1,001,203,456 of 17")]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, base string")
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert {x.kind for x in got[9001].added} == {"phone"} and {x.kind for x in got[9002].added} == {"email"}
    assert got[9003].added == []
    for r in got.values():
        spans = sorted([(x.start, x.end) for x in r.added])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert not any(x.start < b.end and b.start < x.end for x in r.added for b in r.base)


def test_as_many_loose_as_base_items(spark):
    rows = [*written(300)]
    for i in range(300):
        rows.append((5000 + i, f"phone 1 ({200 + i}) 555-{7000 + i} today"))
        rows.append((6000 + i, f"mail jo{i} (at) site{i % 9} (dot) example (dot) com now"))
    docs = spark.createDataFrame([*rows, (9003, "in 1984 we sold 1,001,203,456 of 17")], "doc_id long, text string")
    got = {r.doc_id: r.added for r in pii.find_pii(docs).collect()}
    assert sum({x.kind for x in got[5000 + i]} == {"phone"} for i in range(300)) >= 285
    assert sum({x.kind for x in got[6000 + i]} == {"email"} for i in range(300)) >= 285
    assert got[9003] == [] and not any(got[i] for i in range(300))


def test_without_candidates(spark):
    docs = spark.createDataFrame([(1, None), (None, "no data"), (2, "")], "doc_id long, text string")
    assert [(r.base, r.added) for r in pii.find_pii(docs).collect()] == [([], [])] * 3
    assert pii.find_pii(docs.limit(0)).collect() == []


def test_least_score():
    assert pii.least_score([(0.9, 5, 5), (0.5, 1, 1), (0.1, 0, 9)]) == 0.5
    assert pii.least_score([(0.9, 0, 5)]) == float("inf") and pii.least_score([]) == float("inf")


def test_every_candidate_counts(spark, monkeypatch):
    """The tallies behind the thresholds hold all held-out candidates, with the trees' weights beside them."""
    counted = []
    least = pii.least_score
    monkeypatch.setattr(pii, "least_score", lambda tallies: counted.extend(tallies) or least(tallies))
    docs = spark.createDataFrame(written(300), "doc_id long, text string").crossJoin(spark.range(60).selectExpr("id AS copy"))
    docs = docs.selectExpr("doc_id", "concat(copy, ' ', text) AS text")
    pii.fit(docs)
    assert sum(n for _, _, n in counted) > 40_000
