import pytest
from pyspark.sql import functions as F

from lodestrata.llm import lookalikes as L

SAME = [
    ("Café notebook 12", "Café notebook 12"), ("Notes 12", "Ｎｏｔｅｓ　１２"), ("the lease", "thе lеase"), ("No.5", "Νо.5"), ("A talk", "А tаlk"), ("yearly", "уеаrlу"),
    ("soft", "so­ft"), ("end", " end​ "), ("fit", "ﬁt"), ("一日", "⼀⽇"), ("不", "不"), ("a-b", "a‑b"), ("I am", "Ι am"),
]
DIFFERENT = [("Lease", "lease"), ("resume", "résumé"), ("x2", "x²"), ("1", "①"), ("后", "後"), ("a,b", "a，b"), ("a b", "ab"), ("мир", "mир x"), ("dash–", "dash-"), ("a  b", "a b")]


def forms(spark, strings):
    rows = spark.createDataFrame(list(enumerate(strings)), "n int, s string")
    return {r.n: r.form for r in L.consistent_form(rows, ["n"], "s").collect()}


def test_equal_and_different(spark):
    vocabulary = ["the lease No yearly A talk I am"]
    strings = [x for pair in SAME + DIFFERENT for x in pair] + vocabulary
    got = forms(spark, strings)
    assert len(got) == len(strings)
    for k, (a, b) in enumerate(SAME + DIFFERENT):
        assert (got[2 * k] == got[2 * k + 1]) == (k < len(SAME)), (a, b, got[2 * k], got[2 * k + 1])


def test_real_words_of_other_scripts_stay(spark):
    got = forms(spark, ["сор", "это сор в углу", "cop", "mixеd nowhere", "νέος", None, ""])
    assert got[1] == "это сор в углу" and got[3] == "mixеd nowhere" and got[4] == "νέος" and got[5] is None and got[6] == ""


def test_joiners_that_shape_letters_stay(spark):
    word = "क्‍ष"
    assert forms(spark, [word])[0] == word


@pytest.mark.parametrize("copies", [1, 50])
def test_pairs(spark, copies):
    rows = [("t", f"p{n}", "plain title") for n in range(copies)] + [("t", "z", "plаin title"), ("t", "z", "plаin title"), ("c", "y", "plain title"), ("t", None, "plain title "), ("t", "q", None)]
    df = spark.createDataFrame(rows, "field_name string, record_key string, raw string").withColumn("raw_id", L.string_id(F.col("raw")))
    pairs = L.alike_pairs(L.consistent_form(df, ["field_name", "record_key", "raw_id"], "raw"))
    assert sorted(tuple(r) for r in pairs.collect()) == sorted(("t", f"p{n}", "z") for n in range(copies))
    assert L.alike_pairs(L.consistent_form(df.limit(0), ["field_name", "record_key", "raw_id"], "raw")).isEmpty()


def test_visible_form_of_long_text(spark):
    long = "ａ​" * 50_000
    assert spark.createDataFrame([(long,)], "s string").select(L.visible_form(F.col("s"))).head()[0] == "a" * 50_000


def test_classes_give_the_pairs(spark):
    rows = [("t", f"p{n}", "plain title") for n in range(60)] + [("t", f"z{n}", "plаin title") for n in range(3)] + [("t", "w", "plain  title"), ("c", "y", "plain title"), ("t", "z0", "plаin title"), ("t", None, "plаin title")]
    df = spark.createDataFrame(rows, "field_name string, record_key string, raw string").withColumn("raw_id", L.string_id(F.col("raw")))
    formed = lambda: L.consistent_form(df, ["field_name", "record_key", "raw_id"], "raw")
    classes = L.alike_classes(formed()).collect()
    assert {(r.n_records, r.n_strings) for r in classes} == {(63, 2)} and len(classes) == 63
    assert L.alike_pairs(formed()).count() == 180
