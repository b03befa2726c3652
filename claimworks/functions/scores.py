"""Scores of a row's answers: declarative recipes compiled to columns, logits, linear models."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECIMAL = "decimal(38,18)"


@dataclass(frozen=True)
class Extraction:
    """Where a score comes from: answers[key].field, or one option's probability, divided and inverted if asked."""

    key: str
    field: str
    option: str | None = None
    divisor: float | None = None
    invert: bool = False


@dataclass(frozen=True)
class Pack:
    """Questions, the scores extracted from their answers, and combinations of scores."""

    questions: dict[str, dict]
    extractions: dict[str, Extraction]
    combinations: dict[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)
    diagnostic: frozenset[str] = frozenset()

    @classmethod
    def load(cls, value: dict) -> "Pack":
        pack = cls(
            value["questions"],
            {n: Extraction(e["answer_key"], e["field"], e.get("option"), e.get("divisor"), bool(e.get("invert"))) for n, e in value["extractions"].items()},
            {n: (c["operation"], tuple(c["inputs"])) for n, c in value.get("combinations", {}).items()},
            frozenset(value.get("selection", {}).get("diagnostic_only", ())),
        )
        pack.validate()
        return pack

    def validate(self) -> None:
        for name, q in self.questions.items():
            kind, criteria = q.get("type"), q.get("criteria")
            sound = {
                "noul": criteria is None or set(criteria) == {"true", "false"},
                "choice": isinstance(criteria, dict) and 1 <= len(criteria) <= 255,
                "score": isinstance(criteria, list) and 2 <= len(criteria) <= 10,
            }.get(kind)
            if not sound:
                raise ValueError(f"question {name}: unknown type or criteria that do not fit it")
        for name, e in self.extractions.items():
            if e.key not in self.questions:
                raise ValueError(f"score {name}: no question {e.key}")
        for name, (operation, inputs) in self.combinations.items():
            if operation not in ("min", "mean", "product") or not inputs:
                raise ValueError(f"score {name}: unknown operation or no inputs")
            for i in inputs:
                if i not in self.extractions and i not in self.combinations:
                    raise ValueError(f"score {name}: no input {i}")

    def questions_behind(self, *scores: str) -> set[str]:
        found: set[str] = set()
        for s in scores:
            found |= {self.extractions[s].key} if s in self.extractions else self.questions_behind(*self.combinations[s][1])
        return found

    def closed_over(self, *scores: str) -> "Pack":
        """The part of the pack that these scores need."""
        need: set[str] = set()

        def add(s: str) -> None:
            need.add(s)
            for i in self.combinations.get(s, ("", ()))[1]:
                add(i)

        for s in scores:
            add(s)
        keys = self.questions_behind(*scores)
        return Pack(
            {k: q for k, q in self.questions.items() if k in keys},
            {n: e for n, e in self.extractions.items() if n in need},
            {n: c for n, c in self.combinations.items() if n in need},
            self.diagnostic & need,
        )


def combine(operation: str, parts: list[Column], kind: str = "double") -> Column:
    """min, mean or product of scores in the order listed; null if any is."""
    whole = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
    if operation == "min":
        value = F.least(*parts) if len(parts) > 1 else parts[0]
    elif operation == "mean":
        value = (reduce(lambda a, b: a + b, parts) / F.lit(len(parts))).cast(kind)
    elif operation == "product":
        value = reduce(lambda a, b: (a * b).cast(kind), parts)
    else:
        raise ValueError(operation)
    return F.when(whole, value)


def compiled(pack: Pack, answers: str = "answers", *, exact: bool = False) -> dict[str, Column]:
    """A column for every score of the pack, over a map of answers; in doubles, or in decimals that equal what is written.

    A score that is missing, not finite or outside 0..1 stops the query.
    """
    kind = DECIMAL if exact else "double"

    def number(value: Column) -> Column:
        return value.cast("string").cast(DECIMAL) if exact else value

    out: dict[str, Column] = {}
    for name, e in pack.extractions.items():
        answer = F.element_at(F.col(answers), F.lit(e.key))
        raw = answer[e.field] if e.option is None else F.element_at(answer[e.field], F.lit(e.option))
        value = number(raw)
        if e.divisor is not None:
            value = (value / F.lit(e.divisor).cast(kind)).cast(kind)
        if e.invert:
            value = (F.lit(1).cast(kind) - value).cast(kind)
        bad = raw.isNull() | F.isnan(raw) | (value < 0) | (value > 1)
        out[name] = F.when(bad, F.raise_error(F.concat(F.lit(f"score {name}: "), F.coalesce(raw.cast("string"), F.lit("missing")))).cast(kind)).otherwise(value)
    pending = dict(pack.combinations)
    while pending:
        ready = [n for n, (_, inputs) in pending.items() if all(i in out for i in inputs)]
        if not ready:
            raise ValueError(f"combinations refer to each other: {sorted(pending)}")
        for n in ready:
            operation, inputs = pending.pop(n)
            out[n] = combine(operation, [out[i] for i in inputs], kind)
    return out


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows with further columns, each computed once.

    The optimiser writes a column's expression wherever the column is used; a generator of one row stops that, and costly
    expressions (hashes, checked extractions) that several others refer to stay one.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_scores(df: DataFrame, pack: Pack, answers: str = "answers", *, exact: bool = False) -> DataFrame:
    """The rows with a column for every score of the pack; see compiled()."""
    every = compiled(Pack(pack.questions, pack.extractions), answers, exact=exact)
    df = once(df, **every)
    done, pending = set(every), dict(pack.combinations)
    while pending:
        ready = [n for n, (_, inputs) in pending.items() if done.issuperset(inputs)]
        if not ready:
            raise ValueError(f"combinations refer to each other: {sorted(pending)}")
        df = df.withColumns({n: combine(pending[n][0], [F.col(i) for i in pending[n][1]], DECIMAL if exact else "double") for n in ready})
        for n in ready:
            del pending[n]
            done.add(n)
    return df


def p_yes(no: Column, yes: Column, temperature: float = 1.0) -> Column:
    """Probability of the second of two logits; one of them may be minus infinity."""
    top = F.greatest(no, yes)
    a, b = F.exp((no - top) / F.lit(temperature)), F.exp((yes - top) / F.lit(temperature))
    lost = (no == float("-inf")) & (yes == float("-inf"))
    return F.when(lost | F.isnan(no) | F.isnan(yes), F.raise_error(F.lit("both logits are out of range")).cast("double")).otherwise(b / (a + b))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, y: a + y))


def decided(logits: Column, inverted: list[str], temperature: float = 1.0) -> Column:
    """Least of the questions' probabilities (a map of [no, yes] pairs), those inverted by name taken from 1."""
    return F.array_min(F.transform(F.map_entries(logits), lambda e: F.when(e["key"].isin(inverted), 1 - p_yes(e["value"][0], e["value"][1], temperature)).otherwise(p_yes(e["value"][0], e["value"][1], temperature))))


def clipped_logit(p: Column, margin: float = 0.001) -> Column:
    q = F.least(F.greatest(p, F.lit(margin)), F.lit(1 - margin))
    return F.ln(q / (1 - q))


def linear(features: list[Column], weights: list[float], bias: float) -> Column:
    """Logistic function of a weighted sum, terms in the order listed."""
    total = reduce(lambda a, b: a + b, [f * F.lit(w) for f, w in zip(features, weights)]) + F.lit(bias)
    return 1 / (1 + F.exp(-total))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def cosine(a: Column, b: Column, epsilon: float = 1e-12) -> Column:
    length = lambda v: F.greatest(F.sqrt(dot(v, v)), F.lit(epsilon))
    return dot(a, b) / (length(a) * length(b))


def outcome(label: Column, accepted: Column) -> Column:
    return F.when(label == 1, F.when(accepted, "TP").otherwise("FN")).otherwise(F.when(accepted, "FP").otherwise("TN"))


def blockers(scores: dict[str, Column], threshold: float) -> Column:
    """Names of the scores at or below the threshold, joined by a plus sign."""
    return F.array_join(F.array_compact(F.array(*[F.when(c <= threshold, F.lit(n)) for n, c in scores.items()])), " + ")


def cost(tokens_in: Column, tokens_out: Column, price_in: float | None, price_out: float | None) -> Column:
    """By prices per million tokens; null where one is missing."""
    if price_in is None or price_out is None:
        return F.lit(None).cast("double")
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def grid_steps(score: Column, steps: int = 99) -> Column:
    """How many of the grid's thresholds i/100 are below the score, compared as doubles."""
    return F.size(F.filter(F.sequence(F.lit(1), F.lit(steps)), lambda i: score > i / F.lit(100.0)))


def finite(p: float) -> bool:
    return math.isfinite(p) and 0 <= p <= 1
