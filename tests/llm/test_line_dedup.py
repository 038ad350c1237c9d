"""Line dedup on small cases; the registered query is compared with SQL elsewhere."""

from marketgrade.llm.line_dedup import line_dedup


def kept(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text, r.n_lines, r.n_dropped) for r in df.collect())


def test_shared_lines_stay_with_the_smallest_id(spark):
    docs = spark.createDataFrame(
        [(3, "Shared line ONE\nown 3"), (1, "x\n  shared line one\t\nshared line one"), (2, "short\nshared line one\n\nshort")],
        "doc_id long, text string",
    )
    assert kept(line_dedup(docs)) == [(1, "x\n  shared line one\t\nshared line one", 3, 0), (2, "short\n\nshort", 4, 1), (3, "own 3", 2, 1)]
    assert kept(line_dedup(docs, min_docs=3))[2] == (3, "own 3", 2, 1)
    assert kept(line_dedup(docs, min_docs=4))[2][3] == 0


def test_only_ascii_letters_fold(spark):
    docs = spark.createDataFrame([(1, "ÉCOLE PUBLIQUE"), (2, "école publique"), (3, "École Publique")], "doc_id long, text string")
    assert [r[3] for r in kept(line_dedup(docs))] == [0, 0, 1]


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(1, None, 7, "a"), (2, "", 7, "b"), (None, "a long enough line", 7, "c"), (4, "a long enough line", 7, "d"), (4, "a long enough line", 7, "d"), (5, "a long enough line\n", 7, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, hash string")
    out = line_dedup(docs)
    assert out.columns == [*docs.columns, "_n_lines", "n_dropped"]
    got = sorted((r.doc_id or -1, r.text or "", r.n_dropped) for r in out.collect())
    assert got == [(-1, "a long enough line", 0), (1, "", 0), (2, "", 0), (4, "a long enough line", 0), (4, "a long enough line", 0), (5, "", 1)]


def test_long_text_and_empty_table(spark):
    text = "\n".join(f"line number {i % 700}" for i in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, text + "\nlast and only")], "doc_id long, text string")
    assert kept(line_dedup(docs))[1] == (2, "last and only", 20_001, 20_000)
    assert line_dedup(docs.limit(0)).collect() == []
