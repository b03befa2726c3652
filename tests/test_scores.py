import math

import pytest
from pyspark.sql import functions as F

from claimworks.functions import scores as s

VALUE = {
    "questions": {
        "a": {"type": "noul"}, "b": {"type": "noul"}, "c": {"type": "noul"},
        "t": {"type": "choice", "criteria": {"yes": "x", "no": "y", "part": "z"}}, "r": {"type": "score", "criteria": ["0", "1", "2", "3"]},
    },
    "extractions": {
        "support": {"answer_key": "a", "field": "noul"}, "no_b": {"answer_key": "b", "field": "noul", "invert": True}, "no_c": {"answer_key": "c", "field": "noul", "invert": True},
        "t_yes": {"answer_key": "t", "field": "probabilities", "option": "yes"}, "rubric": {"answer_key": "r", "field": "score", "divisor": 3},
    },
    "combinations": {
        "least": {"operation": "min", "inputs": ["support", "no_b", "no_c"]}, "mean": {"operation": "mean", "inputs": ["support", "no_b", "no_c"]},
        "product": {"operation": "product", "inputs": ["least", "t_yes"]},
    },
}
KIND = "id int, answers map<string, struct<type:string, noul:double, score:double, probabilities:map<string,double>>>"


def answers(a=0.8, b=0.25, c=0.1, yes=0.5, r=2.1):
    return {"a": ("noul", a, None, None), "b": ("noul", b, None, None), "c": ("noul", c, None, None), "t": ("choice", None, None, {"yes": yes, "no": 0.3}), "r": ("score", None, r, None)}


def values(spark, given, exact=False):
    pack = s.Pack.load(VALUE)
    df = spark.createDataFrame([(1, given)], KIND)
    return df.select(*[c.alias(n) for n, c in s.compiled(pack, exact=exact).items()]).first()


def test_extraction_and_combination(spark):
    got = values(spark, answers())
    assert (got.no_b, got.no_c, got.least) == (0.75, 0.9, 0.75) and math.isclose(got.rubric, 0.7)
    assert math.isclose(got["mean"], (0.8 + 0.75 + 0.9) / 3) and got.product == 0.375


def test_decimal_boundary(spark):
    given = answers(a=0.9, b=0.7, c=0.1)
    assert values(spark, given).least > 0.30
    assert str(values(spark, given, exact=True).least.normalize()) == "0.3"


@pytest.mark.parametrize("given", [answers(a=float("nan")), answers(a=-0.01), answers(b=1.01), answers(r=float("inf")), {"a": ("noul", 0.5, None, None)}, answers(yes=None)])
@pytest.mark.parametrize("exact", [False, True])
def test_bad_values_stop(spark, given, exact):
    with pytest.raises(Exception):
        values(spark, given, exact)


def test_sub_pack():
    pack = s.Pack.load(VALUE).closed_over("least", "rubric")
    assert set(pack.questions) == {"a", "b", "c", "r"} and set(pack.combinations) == {"least"} and set(pack.extractions) == {"support", "no_b", "no_c", "rubric"}


@pytest.mark.parametrize("change", [{"questions": {"a": {"type": "odd"}}}, {"combinations": {"x": {"operation": "max", "inputs": ["support"]}}}, {"combinations": {"x": {"operation": "min", "inputs": ["none"]}}}])
def test_unsound_packs(change):
    with pytest.raises(ValueError):
        s.Pack.load(VALUE | change)


def test_logits(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 2.0), (-inf, 0.0), (0.0, -inf)], "n double, y double")
    got = [r[0] for r in df.select(s.p_yes(F.col("n"), F.col("y"))).collect()]
    assert got[0] == 0.5 and math.isclose(got[1], 1 / (1 + math.exp(-2))) and got[2:] == [1.0, 0.0]
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([(-inf, -inf)], "n double, y double").select(s.p_yes(F.col("n"), F.col("y"))).collect()
    rule = F.create_map(F.lit("q"), F.array(F.lit(-9.0), F.lit(9.0)), F.lit("not"), F.array(F.lit(9.0), F.lit(-9.0)))
    assert spark.range(1).select(s.decided(rule, ["not"])).first()[0] > 0.99
    assert math.isclose(sum(spark.range(1).select(s.softmax(F.array(F.lit(1.0), F.lit(900.0), F.lit(3.0)))).first()[0]), 1.0)


def test_grid_steps(spark):
    got = [r[0] for r in spark.createDataFrame([(x / 100,) for x in range(101)], "p double").select(s.grid_steps(F.col("p"))).collect()]
    assert got == [sum(x / 100 > i / 100 for i in range(1, 100)) for x in range(101)]


def test_vectors_and_costs(spark):
    row = spark.range(1).select(s.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))), s.cost(F.lit(10), F.lit(5), 0.1, None), s.cost(F.lit(10), F.lit(5), 100000.0, 0.0)).first()
    assert math.isclose(row[0], 0.96) and row[1] is None and row[2] == 1.0
