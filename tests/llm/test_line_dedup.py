"""Line dedup against a plain loop over all documents."""

from collections import defaultdict

from rankweave.llm.line_dedup import dedup_lines


def brute(rows, width=3):
    """Cleaned text per distinct (id, text)."""
    seen, marks = {}, defaultdict(set)
    docs = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for doc in docs:
        lines = doc[1].split("\n")
        for i in range(len(lines) - width + 1):
            run = tuple(lines[i:i + width])
            if not "".join(run).strip(" \t\r"):
                continue
            if run in seen:
                marks[doc].update(range(i, i + width))
            seen.setdefault(run, (doc, i))
    return {doc: "\n".join(x for i, x in enumerate(doc[1].split("\n")) if i not in marks[doc]) for doc in docs}


def check(docs):
    want = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    before = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if r["doc_id"] is not None and r["text"] is not None)
    got = sorted((r["doc_id"], r["text"]) for r in dedup_lines(docs).collect() if r["doc_id"] is not None and r["text"] is not None)
    assert got == sorted((i, want[i, t]) for i, t in before)


def test_whole_table(documents):
    check(documents)


def test_awkward_rows(odd):
    check(odd)
    out = dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines"] and out.count() == odd.count()
    rows = {(r["doc_id"], r["pos"]): r for r in out.collect()}
    assert rows[8, 7]["text"] == "a\nb\nc\nd" and rows[8, 7]["n_removed"] == 3
    assert rows[9, 8]["text"] == "x\n\ny"
    assert rows[4, 3]["text"] is None and rows[4, 3]["n_lines"] == 0
    assert rows[5, 4]["text"] == "" and rows[5, 4]["n_lines"] == 1


def test_chains_and_whole_copies(spark):
    docs = spark.createDataFrame([(1, "p\nq\nr\ns\nt"), (2, "p\nq\nr\ns\nt"), (3, "z\nq\nr\ns\nz"), (4, "k\nk\nk\nk\nk"), (5, "\n\n\n\n")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in dedup_lines(docs).collect()} == {1: "p\nq\nr\ns\nt", 2: "", 3: "z\nz", 4: "k", 5: "\n\n\n\n"}


def test_empty(nothing):
    assert dedup_lines(nothing).count() == 0
