import hashlib
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankweave.llm import fim, queries

UNITS = re.compile("[A-Za-z]+|[^A-Za-z]")


def plainly(number, text):
    """The same by a list of units."""
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"1:{'' if number is None else number}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows(made):
    return [tuple(r.values()) for r in made.to_pylist()]


@settings(deadline=None, max_examples=150)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers()), st.one_of(st.none(), st.text(), st.text("aZ[@`{zA é漢😀<PSM>\n")))))
def test_any_batch(batch):
    made = fim.rearrange(pa.array([t for _, t in batch], pa.string()), [i for i, _ in batch], 1, 90, 20)
    assert rows(made) == [plainly(i, t) for i, t in batch]


def test_slices_and_every_cut():
    text = "ab1 cd漢efg😀😀h<P"
    array = pa.array(["skipped", *[text] * 400])[1:]
    assert rows(fim.rearrange(array, list(range(400)), 1, 90, 20)) == [plainly(i, text) for i in range(400)]


def test_odd_rows(odd, nothing):
    out = fim.restore(fim.transform(odd))
    assert out.columns == [*odd.columns, "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    for r in out.collect():
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plainly(r["doc_id"], r["text"])
        assert r["restored"] == (r["text"] or "")
    assert fim.restore(fim.transform(nothing)).count() == 0


def test_own_columns_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", 9)], "doc_id long, text string, form string, n int")
    row = fim.restore(fim.transform(docs)).first()
    assert (row["n"], row["form"]) == plainly(1, "a b c d e f")[:2] and row["restored"] == "a b c d e f"


def test_long_text(spark):
    text = "Wort ☃ " * 300_000
    docs = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")
    sums = [hashlib.sha256(plainly(i, text)[4].encode()).hexdigest() for i in range(3)]
    assert [r[0] for r in fim.transform(docs).orderBy("doc_id").select(F.sha2("output", 256)).collect()] == sums


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = queries.op11_fim(spark, folder).collect()
    assert len(found) == len(texts) and {r["form"] for r in found} == {"plain", "psm", "spm"}
    for r in found:
        n, form, prefix, middle, output = plainly(r["doc_id"], texts[r["doc_id"]])
        assert tuple(r)[:5] == (r["doc_id"], n, form, prefix, middle)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
