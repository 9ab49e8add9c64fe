from pyspark.sql import functions as F

from rankweave.operators import audits as A
from rankweave.sources import candidates as C


def digest(spark, rows):
    return A.text_digest(spark.createDataFrame(rows, "a STRING, b STRING"), ["a", "b"]).first()


def test_digest_tells_rows_apart(spark):
    assert digest(spark, [("a|b", "c")]) != digest(spark, [("a", "b|c")])
    assert digest(spark, [(None, "c")]) != digest(spark, [("~", "c")])
    assert digest(spark, [(None, "c")]) != digest(spark, [("n;", "c")])
    assert digest(spark, [("a", "b"), ("c", "d")]) == digest(spark, [("c", "d"), ("a", "b")])
    assert digest(spark, [("a", "b")] * 2) != digest(spark, [("a", "b")])


def test_string_classes(spark):
    source = spark.createDataFrame([(1, "A", "b . c", "train"), (2, "B", "d", "test")],
                                   "id INT, products_smiles STRING, reactants_smiles STRING, set STRING")
    meta = spark.createDataFrame([(1, "train", "4-NOT SPECIFIED")], "reaction_id INT, source_split STRING, reaction_class STRING")
    got = {r["query_id"]: r["reaction_class"] for r in C.load_reactions(source, meta).collect()}
    assert got == {1: "4-NOT SPECIFIED", 2: None}
    try:
        C.load_reactions(source, meta.unionAll(meta)).select(F.max("reaction_class")).collect()
    except Exception as error:
        assert "twice" in str(error)
    else:
        raise AssertionError("a repeated id must be an error")
