"""The pipeline on awkward rows, stage by stage, and every registered query with its SQL on small tables."""

import os

import pytest
from check_oracle import connect, table
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as C
from rankweave.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_names_and_stages():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(QUERIES)
    assert [name for name, _ in C.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "mix_sources", "encode"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = connect(FOLDER).execute(ORACLES[name])
    assert got == table([d[0] for d in cursor.description], cursor.fetchall())


def test_stages_on_awkward_rows(spark, odd, nothing):
    docs = odd.select("doc_id", "text", "lang", "source", F.length("text").alias("n_chars"), "slot")
    for frame in (docs, docs.limit(0)):
        for name, stage in C.STAGES:
            out = stage(spark, frame, FOLDER)
            if name != "encode":
                assert out.columns == frame.columns
            rows = out.collect()
            frame = spark.createDataFrame(rows, out.schema) if name != "encode" else frame
        assert all(r["round_trip"] for r in rows)


def test_run(spark, tmp_path):
    rows = [(i, f"The cat number {i} sat on the mat and looked at dog {i * 7 % 13} by the door.\nline two {i}\nline three", "en", f"s{i % 2}", 60) for i in range(30)]
    rows += [(100, rows[0][1], "en", "s1", 60), (101, "123 456", "en", "s0", 7), (102, None, "en", "s0", None)]
    os.mkdir(tmp_path / "t")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "t/documents.parquet"))
    out = C.run(spark, str(tmp_path / "t")).collect()
    assert 101 not in {r["doc_id"] for r in out} and 102 not in {r["doc_id"] for r in out}
    assert {r["doc_id"] for r in out} >= set(range(1, 30)) - {100} and all(r["round_trip"] for r in out)


def test_no_label_rejects_only_texts_without_a_letter(spark):
    rows = [(1, "The cat sat.", None), (2, "Жук", None), (3, None, None), (4, "", None), (5, "12 ?!\n", None), (6, "1\n2 a", None), (7, "34", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = C.identify_language(spark, docs, FOLDER)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 6}
