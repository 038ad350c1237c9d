"""I-Match against a plain version."""

import hashlib
import re
from collections import Counter

from marketgrade.llm import fingerprints as I

FOLDER = "/root/testdata/sf0.001"


def plain_terms(text):
    return {t for t in re.findall(r"[^\W_]+", (text or "").lower())}


def code(term):
    return int(hashlib.md5(term.encode()).hexdigest()[:15], 16)


def plain_print(text, band):
    codes = {code(t) for t in plain_terms(text)}
    out = []
    for k in range(I.LEXICONS):
        own = sorted(c for c in codes & band if c >> (6 * k) & 3 == 0)
        own = own if len(own) >= I.LEAST_TERMS else sorted(codes)
        out.append(hashlib.md5(",".join(map(str, own)).encode()).hexdigest()[:16])
    return out


def plain_edit(rows):
    """Rows (id, text) by id; each with the edited text."""
    rows = sorted(rows)
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1] or ""
        text = text or ""
        half = len(text) // 2
        yield key, text, text[: len(text) - half] + after[:half], after


def check(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    counts = Counter(t for _, text in rows for t in plain_terms(text))
    band = {code(t) for t, n in counts.items() if len(rows) * I.LEAST_SHARE <= n <= len(rows) * I.MOST_SHARE}
    got = {r.doc_id: r for r in I.edited_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    same = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / I.LEXICONS
    for key, text, edited, after in plain_edit(rows):
        r = got[key]
        own, other, following = (plain_print(t, band) for t in (text, edited, after))
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == ("-".join(own), "-".join(other))
        assert (r.near_edited, r.near_next) == (same(own, other), same(own, following))
    return got


def test_given_documents(spark):
    check(spark, spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text"))


def test_odd_texts(spark):
    rows = [(5, None, "x"), (-2, "", "x"), (10**15, "é\U0001f600abc", "x"), (7, "one two three four five " * 900, "x"), (8, "one two three four five " * 900, "x")]
    got = check(spark, spark.createDataFrame(rows, "doc_id long, text string, head string"))
    assert got[7].fingerprint == got[8].fingerprint


def test_single_empty_repeated_and_null(spark):
    check(spark, spark.createDataFrame([(1, "alone here")], "doc_id long, text string"))
    assert I.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(1, "abcd"), (1, "abcd"), (2, "wxyz"), (None, "null")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.edited_sha256) for r in I.edited_fingerprints(docs).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == [(-1, sha("nu")), (1, sha("abwx")), (1, sha("abwx")), (2, sha("wxab"))]


def test_copies_with_small_changes_stay_near(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("length(text) > 2000").limit(30)
    band = I.band_codes(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    near = far = 0
    for r in docs.collect():
        words = r.text.split(" ")
        changed = " ".join([*words[:50], "qqq", *words[51:]])
        a, b, c = (plain_print(t, set(band)) for t in (r.text, changed, " ".join(words[: len(words) // 2])))
        near += sum(x == y for x, y in zip(a, b, strict=True))
        far += sum(x == y for x, y in zip(a, c, strict=True))
    assert near > 3 * far
