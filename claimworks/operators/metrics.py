"""Classification metrics by source and pooled, threshold tuning, cluster counts and intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimworks.functions.scores import grid_steps
from claimworks.functions.text import normalised


def checked(rows: DataFrame, score: str, label: str = "label") -> DataFrame:
    """The rows; the query stops at labels other than 0 and 1 and at scores that are null or not finite."""
    s = F.col(score).cast("double")
    sound = F.col(label).isin(0, 1) & s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf"))
    return rows.withColumn(score, F.when(F.coalesce(sound, F.lit(False)), s).otherwise(F.raise_error(F.lit(f"labels are 0 or 1, {score} is finite")).cast("double")))


#: Stretches of a unit of scores that are ordered apart.
BINS = 4096


def auc(rows: DataFrame, score: str, by: list[str], label: str = "label") -> DataFrame:
    """Area under the ROC curve by group, ties by halves; null where a class is missing.

    Rows are first counted by score. Distinct scores are ordered within stretches of 1/BINS, each a window of its own, and
    only the stretches' totals in a window of the group, so no task sees all scores of a large group.
    """
    counts = rows.groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    counts = counts.withColumn("bin", F.floor(F.col(score) * BINS))
    before = (Window.unboundedPreceding, -1)
    totals = counts.groupBy(*by, "bin").agg(F.sum("q").alias("q"))
    lower = totals.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("bin").alias("_bin"), F.coalesce(F.sum("q").over(Window.partitionBy(*by).orderBy("bin").rowsBetween(*before)), F.lit(0)).alias("lower"))
    same = reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"_{c}")), [*by, "bin"], F.lit(True))
    below = F.sum("q").over(Window.partitionBy(*by, "bin").orderBy(score).rowsBetween(*before))
    ranked = counts.withColumn("below", F.coalesce(below, F.lit(0))).join(lower, same)
    ranked = ranked.withColumn("won", F.col("p") * (F.col("lower") + F.col("below") + F.col("q") / 2.0))
    return ranked.groupBy(*by).agg(F.try_divide(F.sum("won"), F.sum("p").cast("double") * F.sum("q")).alias("roc_auc"))


def _measures(accepted: Column, label: str) -> list[Column]:
    yes, no = F.col(label) == 1, F.col(label) == 0
    tpr, tnr = F.avg(F.when(yes, accepted.cast("double"))), F.avg(F.when(no, (~accepted).cast("double")))
    return [
        F.count("*").alias("n"),
        ((tpr + tnr) / 2).alias("balanced_accuracy"),
        F.avg((accepted == yes).cast("double")).alias("accuracy"),
        tpr.alias("supported_recall"),
        tnr.alias("unsupported_recall"),
    ]


def metrics(rows: DataFrame, score: str, threshold: float | Column = 0.5, by: str = "dataset", label: str = "label") -> DataFrame:
    """scope (a source, '(pooled)' or '(macro)') and its measures; accepted are scores above the threshold.

    The macro row holds the mean of the sources' balanced accuracies, null where any source lacks a class. Without rows the
    query stops.
    """
    rows = checked(rows, score, label).withColumn("accepted", F.col(score) > threshold)
    measured = rows.groupingSets([[by], []], by).agg(F.grouping(by).alias("pooled"), *_measures(F.col("accepted"), label))
    areas = auc(rows, score, [by], label).withColumn("pooled", F.lit(0))
    whole = auc(rows.withColumn(by, F.lit(None).cast("string")), score, [by], label).withColumn("pooled", F.lit(1))
    areas = areas.unionByName(whole).withColumnRenamed(by, "b").withColumnRenamed("pooled", "p")
    measured = measured.withColumn("pooled", F.col("pooled").cast("int"))
    out = measured.join(areas, F.col(by).eqNullSafe(F.col("b")) & (F.col("pooled") == F.col("p")), "left")
    out = out.withColumn("fpr", 1 - F.col("unsupported_recall")).withColumn("fnr", 1 - F.col("supported_recall"))
    columns = ["n", "balanced_accuracy", "accuracy", "roc_auc", "supported_recall", "unsupported_recall", "fpr", "fnr"]
    out = out.select(F.when(F.col("pooled") == 1, "(pooled)").otherwise(F.col(by)).alias("scope"), "pooled", *columns)
    macro = out.where("pooled = 0").agg(_needed(F.sum("n"), "metrics need rows").alias("n"), vetoed_mean("balanced_accuracy").alias("balanced_accuracy"), vetoed_mean("roc_auc").alias("roc_auc"))
    macro = macro.select(F.lit("(macro)").alias("scope"), *[F.col(c) if c in ("n", "balanced_accuracy", "roc_auc") else F.lit(None).cast("double").alias(c) for c in columns])
    return out.drop("pooled").unionByName(macro)


def _needed(value: Column, why: str) -> Column:
    """The value; where it is null, the query stops."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(why)).cast("long"))


def vetoed_mean(column: str) -> Column:
    """Mean that is null where any value is."""
    return F.when(F.count(column) == F.count("*"), F.avg(column))


def threshold_grid(rows: DataFrame, score: str, keys: list[str], by: str = "dataset", label: str = "label") -> DataFrame:
    """keys, step (1..99), macro balanced accuracy over the sources at threshold step/100.

    Rows are counted by source, label and the number of thresholds below the score: at most 100 counts each, whatever the
    rows. Only those are spread over the grid.
    """
    rows = checked(rows, score, label)
    counts = rows.groupBy(*keys, by, label, grid_steps(F.col(score)).alias("k")).agg(F.count("*").alias("n"))
    spread = counts.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(99))))
    total = lambda value, accept: F.sum(F.when((F.col(label) == value) & accept, F.col("n")).otherwise(0))
    above, every = F.col("k") >= F.col("step"), F.lit(True)
    tpr = F.try_divide(total(1, above).cast("double"), total(1, every))
    tnr = F.try_divide(total(0, ~above).cast("double"), total(0, every))
    sources = spread.groupBy(*keys, by, "step").agg(((tpr + tnr) / 2).alias("b"))
    return sources.groupBy(*keys, "step").agg(F.round(vetoed_mean("b"), 12).alias("macro"))


def tuned(rows: DataFrame, score: str, keys: list[str] | None = None, by: str = "dataset", label: str = "label", *, strict: bool = True) -> DataFrame:
    """keys, threshold, macro: the grid's best threshold by macro balanced accuracy, then nearest to a half, then larger.

    Without rows, or where a source lacks a class, the query stops; where it is not strict, there is no row then.
    """
    keys = keys or []
    grid = threshold_grid(rows, score, keys, by, label)
    order = F.struct(F.col("macro"), -F.abs(F.col("step") - 50), F.col("step"))
    best = F.max(F.when(F.col("macro").isNotNull(), order)).alias("best")
    picked = grid.groupBy(*keys).agg(best) if keys else grid.agg(best)
    return _chosen(picked, strict).select(*keys, (F.col("best.step") / 100.0).alias("threshold"), F.col("best.macro").alias("macro"))


def _chosen(picked: DataFrame, strict: bool) -> DataFrame:
    """Rows that have a best step; a strict query stops at others."""
    found = F.col("best").isNotNull()
    return picked.where(F.when(found, True).otherwise(F.raise_error(F.lit(BOTH)).cast("boolean"))) if strict else picked.where(found)


BOTH = "tuning needs rows of both labels in each source"


def tuned_in_pool(rows: DataFrame, score: str, keys: list[str], *, by: str = "dataset", label: str = "label", fixed: int | None = None, strict: bool = True) -> DataFrame:
    """keys, threshold, tune_macro, selection_macro: thresholds tuned on rows of pool 'tune', and what they give on those of
    pool 'selection'; fixed_macro as well if a fixed step of the grid is given.

    Rows are counted once by pool, source, label and the thresholds below the score; both results come from these counts.
    """
    rows = checked(rows, score, label)
    counts = rows.groupBy(*keys, "pool", by, label, grid_steps(F.col(score)).alias("k")).agg(F.count("*").alias("n"))
    spread = counts.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(99))))
    above = F.col("k") >= F.col("step")

    def accuracy(pool: str) -> Column:
        total = lambda value, hit: F.sum(F.when((F.col("pool") == pool) & (F.col(label) == value) & hit, F.col("n")).otherwise(0))
        return (F.try_divide(total(1, above).cast("double"), total(1, F.lit(True))) + F.try_divide(total(0, ~above).cast("double"), total(0, F.lit(True)))) / 2

    sources = spread.groupBy(*keys, by, "step").agg(*[accuracy(p).alias(p) for p in ("tune", "selection")], *[F.max(F.col("pool") == p).alias(f"has_{p}") for p in ("tune", "selection")])
    macro = lambda p: F.round(F.when(F.count(p) == F.count_if(f"has_{p}"), F.avg(p)), 12).alias(f"{p}_macro")
    grid = sources.groupBy(*keys, "step").agg(macro("tune"), macro("selection"))
    order = F.struct("tune_macro", -F.abs(F.col("step") - 50), "step", "selection_macro")
    more = [] if fixed is None else [F.max(F.when(F.col("step") == fixed, F.col("selection_macro"))).alias("fixed_macro")]
    best = grid.groupBy(*keys).agg(F.max(F.when(F.col("tune_macro").isNotNull(), order)).alias("best"), *more)
    return _chosen(best, strict).select(*keys, (F.col("best.step") / 100.0).alias("threshold"), "best.tune_macro", "best.selection_macro", *[c for c in ("fixed_macro",) if more])


def unpivoted(rows: DataFrame, scores: list[str], keep: list[str]) -> DataFrame:
    """keep, candidate, score: one row for each named score."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("candidate"), F.col(s).cast("double").alias("score")) for s in scores]))
    return rows.select(*keep, pairs.alias("x")).select(*keep, "x.*")


def ranked_candidates(rows: DataFrame, scores: dict[str, int], diagnostic: frozenset[str] = frozenset(), *, strict: bool = True) -> DataFrame:
    """candidate, threshold, macro, questions, place: candidates but the diagnostic ones by macro, questions asked, name."""
    named = [s for s in scores if s not in diagnostic]
    best = tuned(unpivoted(rows, named, ["dataset", "label"]), "score", ["candidate"], strict=strict)
    questions = F.create_map(*[F.lit(x) for s in named for x in (s, scores[s])])[F.col("candidate")]
    best = best.withColumn("questions", questions)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.col("macro").desc(), "questions", "candidate")))


def clusters(rows: DataFrame, primary: str, baseline: str, threshold: float, baseline_threshold: float, text: str = "doc", by: str = "dataset", label: str = "label", order: str | None = None) -> DataFrame:
    """by, cluster (the digest of a text, white space normalised) and six counts: rows of each class, and what either score got
    right; first as well, the least of a column that orders the rows, if one is named."""
    a, b, yes, no = F.col(primary) > threshold, F.col(baseline) > baseline_threshold, F.col(label) == 1, F.col(label) == 0
    first = [F.min(order).alias("first")] if order else []
    return rows.groupBy(by, F.sha2(normalised(F.col(text)), 256).alias("cluster")).agg(
        F.count_if(yes).alias("pos"), F.count_if(no).alias("neg"), F.count_if(yes & a).alias("a_pos"), F.count_if(no & ~a).alias("a_neg"), F.count_if(yes & b).alias("b_pos"), F.count_if(no & ~b).alias("b_neg"), *first
    )


#: Cumulative chances of a Poisson variable of mean 1, up to 8.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.9999988747974020]


def bootstrap(cluster_counts: DataFrame, repeats: int = 1000, by: str = "dataset") -> DataFrame:
    """Percentile intervals of the macro balanced accuracy of two scores and of their difference, by resampled clusters.

    Resampling is by weights: each cluster counts as often in a repeat as a Poisson variable of mean 1 says that is read off
    a hash of repeat and cluster. That needs no shuffle of clusters by repeat and gives the same weights everywhere.
    Repeats in which a source lacks a class are left out; valid_repeats counts the others.
    """
    names = ["pos", "neg", "a_pos", "a_neg", "b_pos", "b_neg"]
    spread = cluster_counts.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    u = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("repeat").cast("string"), by, "cluster"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    weight = reduce(lambda w, c: w + (u >= F.lit(c)).cast("int"), POISSON, F.lit(0))
    summed = spread.withColumn("w", weight).groupBy("repeat", by).agg(*[F.sum(F.col("w") * F.col(n)).cast("double").alias(n) for n in names])
    rate = lambda x, y: F.try_divide(F.col(x), F.col(y))
    sources = summed.select("repeat", ((rate("a_pos", "pos") + rate("a_neg", "neg")) / 2).alias("a"), ((rate("b_pos", "pos") + rate("b_neg", "neg")) / 2).alias("b"))
    macro = sources.groupBy("repeat").agg(vetoed_mean("a").alias("a"), vetoed_mean("b").alias("b")).withColumn("d", F.col("a") - F.col("b"))
    ends = lambda c, p: F.percentile(c, p)
    return macro.agg(*[ends(c, p).alias(f"{n}_{e}") for c, n in (("a", "primary"), ("b", "baseline"), ("d", "delta")) for e, p in (("low", 0.025), ("high", 0.975))], F.count("d").alias("valid_repeats"), F.count("*").alias("repeats"))


def bootstrap_exact(cluster_counts: DataFrame, repeats: int = 1000, seed: int = 42, by: str = "dataset") -> DataFrame:
    """The same intervals from one task's random generator, clusters drawn with replacement inside each source.

    For evaluation sets: all clusters, six counts each, go to that task. Draws number the clusters as they are first seen, by
    column first, or by cluster where there is none.
    """
    import numpy as np
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rng, names = np.random.default_rng(seed), ["pos", "neg", "a_pos", "a_neg", "b_pos", "b_neg"]
        sources = [g.sort_values("first" if "first" in g else "cluster")[names].to_numpy(float) for _, g in frame.sort_values(by).groupby(by)]
        kept = []
        for _ in range(repeats):
            a, b = [], []
            for counts in sources:
                pos, neg, ap, an, bp, bn = counts[rng.integers(len(counts), size=len(counts))].sum(0)
                if not pos or not neg:
                    break
                a.append((ap / pos + an / neg) / 2)
                b.append((bp / pos + bn / neg) / 2)
            else:
                kept.append((np.mean(a), np.mean(b), np.mean(a) - np.mean(b)))
        ends = np.percentile(np.array(kept), [2.5, 97.5], axis=0).T.ravel() if kept else [None] * 6
        return pd.DataFrame([[*ends, len(kept), repeats]], columns=["primary_low", "primary_high", "baseline_low", "baseline_high", "delta_low", "delta_high", "valid_repeats", "repeats"])

    schema = ", ".join(f"{n}_{e} double" for n in ("primary", "baseline", "delta") for e in ("low", "high")) + ", valid_repeats long, repeats long"
    return cluster_counts.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, schema)
