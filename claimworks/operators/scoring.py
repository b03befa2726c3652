"""Scoring states with a model or a service: loaded once for each worker, paced, retried, checked, never invented."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a scorer gives for a state: probabilities by question and tokens, or the error.
Answer = tuple[dict[str, float], int] | str
Scorer = Callable[[list[dict[str, str]]], list[Answer]]

SCHEMA = "id string, answers map<string,double>, tokens long, attempts int, seconds double, error string"


class Retry(Exception):
    """A failure that may pass; after: seconds that the service asks to wait."""

    def __init__(self, why: str, after: float | None = None):
        super().__init__(why)
        self.after = after


@dataclass
class Pace:
    """At most so many calls a second, evenly spaced. On a cluster each of n partitions gets an n-th of the rate."""

    rate: float
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    _next: float = field(default=0.0)

    def wait(self) -> None:
        now = self.clock()
        if now < self._next:
            self.sleep(self._next - now)
        self._next = max(now, self._next) + 1 / self.rate


def retried(call: Callable[[], object], attempts: int = 5, cap: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> tuple[object, int]:
    """The call's result and how often it was made; waits 1, 2, 4 ... seconds, or as asked, and never over the cap."""
    for n in range(1, attempts + 1):
        try:
            return call(), n
        except Retry as e:
            if n == attempts:
                raise
            sleep(min(cap, e.after if e.after is not None else 2.0 ** (n - 1)))
    raise AssertionError


def affordable(spent: float, ceiling: float, rows: int, cost_per_row: float) -> None:
    """Stops before a run that could go over the ceiling."""
    if spent + rows * cost_per_row > ceiling:
        raise ValueError(f"{rows} rows may cost {rows * cost_per_row:.4f}; {ceiling - spent:.4f} is left")


def sound(answer: Answer, questions: list[str]) -> str | None:
    """What is wrong with an answer, if anything."""
    if isinstance(answer, str):
        return answer
    values = answer[0]
    if set(values) != set(questions):
        return f"answers to {sorted(values)} instead of {sorted(questions)}"
    bad = [q for q, p in values.items() if not (isinstance(p, float) and math.isfinite(p) and 0 <= p <= 1)]
    return f"no probability for {sorted(bad)}" if bad else None


def scored(rows: DataFrame, make: Callable[[], Scorer], questions: list[str], *, batch: int = 16, rate: float | None = None) -> DataFrame:
    """id, answers, tokens, attempts, seconds, error of rows (id, doc, claim); a row has answers or an error, never both."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score, pace = make(), Pace(rate / parts) if rate else None
        for frame in frames:
            out = []
            for i in range(0, len(frame), batch):
                part = frame[i : i + batch]
                states = [{"document": d, "claim": c} for d, c in zip(part.doc, part.claim)]
                if pace:
                    pace.wait()
                began, made = time.monotonic(), 1
                try:
                    answers, made = retried(lambda: score(states))
                except Exception as e:
                    answers = [f"{type(e).__name__}: {e}"] * len(states)
                seconds = time.monotonic() - began
                for row_id, answer in zip(part.id, answers):
                    why = sound(answer, questions)
                    out.append((row_id, None if why else answer[0], None if why else answer[1], made, seconds, why))
            yield pd.DataFrame(out, columns=["id", "answers", "tokens", "attempts", "seconds", "error"])

    return rows.select("id", "doc", "claim").mapInPandas(run, SCHEMA)


def hash_scorer(questions: list[str]) -> Callable[[], Scorer]:
    """A stand-in: two decimals from a hash of question and state."""
    import hashlib

    def answer(state: dict[str, str]) -> Answer:
        p = lambda q: int(hashlib.sha256(f"{q}\n{state['document']}\n{state['claim']}".encode()).hexdigest()[:8], 16) % 101 / 100.0
        return {q: p(q) for q in questions}, len(state["document"]) // 4

    return lambda: lambda states: [answer(s) for s in states]


def refuse_many(scored_rows: DataFrame, most: int = 10) -> None:
    """Stops after more errors than that; what was scored is kept by the caller."""
    n = scored_rows.where("error is not null").limit(most + 1).count()
    if n > most:
        raise RuntimeError(f"more than {most} rows failed")


def totals(scored_rows: DataFrame) -> DataFrame:
    """Rows, errors, tokens, retries and the median time of a run."""
    return scored_rows.agg(F.count("*").alias("rows"), F.count("error").alias("errors"), F.sum("tokens").alias("tokens"), F.sum(F.col("attempts") - 1).alias("retries"), F.median("seconds").alias("median_seconds"))
