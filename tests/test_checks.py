import pytest

from claimworks.operators import audit, checks, joins, sampling


def test_changed_input_is_refused():
    assert not checks.unchanged(None, "a", "the cache")
    assert checks.unchanged("a", "a", "the cache")
    with pytest.raises(ValueError, match="the cache"):
        checks.unchanged("a", "b", "the cache")


def test_models_of_a_run(spark):
    df = spark.createDataFrame([(1, "m-1.2"), (2, "m-1.3"), (3, None)], "id long, model string")
    why = lambda *a: {r.id: r.refused for r in checks.resolved(df, *a).collect()}
    assert why("m") == {1: None, 2: None, 3: "no model"}
    assert why("m", "m-1.3") == {1: "another model than before", 2: None, 3: "no model"}
    assert why("m-1.2") == {1: None, 2: "another model than the pinned one", 3: "no model"}


def test_order_progress_and_sums(spark):
    df = spark.createDataFrame([("a:10", 1), ("a:9", 5), ("a:9", 7), ("b:11", None)], "id string, v int")
    assert [r.id for r in sampling.by_number(df).collect()] == ["a:9", "a:9", "a:10", "b:11"]
    assert tuple(audit.largest_summed(df, "v").first()) == (2, 8)
    assert tuple(joins.progress(df.select("id").distinct(), df.where("v > 4")).first()) == (1, 3, False)
    assert tuple(joins.progress(df.limit(0), df).first()) == (0, 0, True)
