import hashlib
import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimworks.functions import hashing, text


def test_truncation(spark):
    long = "a" * 60000 + "b" * 100 + "c" * 20000
    df = spark.createDataFrame([("x" * 80000,), (long,)], "doc string")
    got = [r[0] for r in df.select(text.truncated(F.col("doc"), 60000, 20000, 80000)).collect()]
    assert got[0] == "x" * 80000 and got[1].startswith("aa") and got[1].endswith("cc") and text.MARKER in got[1] and "b" not in got[1]
    row = spark.createDataFrame([("abcdMIDDLEwxyz",)], "d string").select(text.state(F.col("d"), 8), text.state(F.col("d"), 0)).first()
    assert row[0] == "abcdMI\n[Middle of long document omitted]\nyz" and row[1] == "abcdMIDDLEwxyz"


ALPHABET = st.sampled_from(list("ab \t\n\r\x0b\x0c\x1c\x1f\x85\xa0     　​\"\\/<é漢😀\x01\x7f\x00"))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(ALPHABET, max_size=12), min_size=20, max_size=40))
def test_like_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    got = df.select("i", text.normalised(F.col("t")).alias("n"), hashing.json_string(F.col("t")).alias("j"), hashing.digest(F.col("t"), F.lit("x")).alias("d")).orderBy("i").collect()
    for v, r in zip(values, got):
        assert r.n == " ".join(v.split())
        assert r.j == json.dumps(v, ensure_ascii=False)
        assert r.d == hashlib.sha256(json.dumps([v, "x"], ensure_ascii=False).encode()).hexdigest()


def test_names_and_cells(spark):
    one = spark.range(1)
    got = one.select(
        text.slug(F.lit("org/My Model_v1.0!")), text.path_slug(F.lit("a/b c")), text.number(F.lit("**1,234.50** pts")), text.number(F.lit("n/a")), text.unmarked(F.lit("**7.1** <u>8</u>")),
        text.percent(F.lit(0.5)), text.percent(F.lit(None).cast("double")), text.pinned(F.lit("m-1.13.2")), text.pinned(F.lit("m-latest")), text.renamed(F.lit("x"), {"x": "X"}), text.renamed(F.lit("y"), {"x": "X"}),
        text.usable_url(F.lit("https://h/p")), text.usable_url(F.lit("https://u:p@h/")), text.usable_url(F.lit("ftp://h/")), text.usable_url(F.lit("https://h/?q=1")),
        text.prompt("A {x} b {y}", x=F.lit("1"), y=F.lit("2")), text.safe_json(F.struct(F.lit("<b>").alias("k"))), text.quotes_folded(F.lit("“It’s  A”")),
    ).first()
    assert tuple(got) == ("My-Model-v1.0", "a_b_c", 1234.5, None, "7.1 8", "50.00", "n/a", True, False, "X", "y", True, False, False, False, "A 1 b 2", '{"k":"\\u003cb>"}', "\"it's a\"")
