import pytest

from claimworks.operators import scoring as s
from claimworks.plans.checkers import Checker, check_claim


def test_pace_and_retries():
    waits, now = [], [0.0]
    pace = s.Pace(2.0, clock=lambda: now[0], sleep=lambda x: waits.append(x))
    pace.wait(), pace.wait(), pace.wait()
    assert waits == [0.5, 1.0]
    slept, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise s.Retry("busy", 90.0 if len(calls) == 2 else None)
        return "ok"

    assert s.retried(call, sleep=slept.append) == ("ok", 4) and slept == [1.0, 60.0, 4.0]
    with pytest.raises(s.Retry):
        s.retried(lambda: (_ for _ in ()).throw(s.Retry("no")), attempts=2, sleep=slept.append)
    with pytest.raises(ValueError):
        s.affordable(0.9, 1.0, 10, 0.02)


def test_rows_have_answers_or_errors(spark):
    rows = spark.createDataFrame([(str(i), f"doc {i}", "c") for i in range(7)], "id string, doc string, claim string")

    def make():
        def score(states):
            if any(x["document"] == "doc 6" for x in states):
                raise ValueError("broken")
            return [({"q": 0.5}, 3) if x["document"] != "doc 1" else ({"q": 1.5}, 3) if x["claim"] else "none" for x in states]

        return score

    got = {r.id: r for r in s.scored(rows.coalesce(1), make, ["q"], batch=2).collect()}
    assert got["0"].answers == {"q": 0.5} and got["0"].error is None
    assert got["1"].answers is None and "no probability" in got["1"].error and got["6"].error == "ValueError: broken"
    with pytest.raises(RuntimeError):
        s.refuse_many(spark.createDataFrame([("x",)] * 11, "error string"))


def test_single_claim(spark):
    checker = Checker("rule")
    score, verdict = check_claim(spark, "d", "c", {"support": 0.9, "unsupported": 0.1, "contradicted": 0.2}, checker)
    assert score == 0.8 and verdict == "Supported"
    assert check_claim(spark, "d", "c", {"support": 0.9, "unsupported": 0.9, "contradicted": 0.0}, checker)[1] == "Refuted"
