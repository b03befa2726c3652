"""Registered queries over the driver's tables, each with its DuckDB counterpart where SQL can say it."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimworks.functions import hashing, scores, text
from claimworks.operators import audit, calibration, checks, chunking, graph, joins, leaderboard, lineage, metrics, sampling, scoring
from claimworks.plans import binding, checkers
from claimworks.plans.binding import RULE, SCORES, THRESHOLD, answered, rows, rows_sql, scored, scored_sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_SPACES_SQL = r"[\s\x0B\x1C-\x1F\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_NORM = f"trim(regexp_replace(doc, '{_SPACES_SQL}', ' ', 'g'))"
_GROUP = f"sha256(CAST(to_json({_NORM}) AS VARCHAR))"
_POOL = f"""pooled AS (SELECT *, {_GROUP} AS "group", CASE WHEN CAST(('0x' || substr({_GROUP}, 1, 8)) AS BIGINT) % 10 < 6 THEN 'tune' ELSE 'selection' END AS pool FROM rows)"""
_SEEDED = f"""sha256('["{sampling.SEED}", "' || id || '"]')"""


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.with_pool(rows(spark, sf_dir))


# Pools, samples, truncation.


@query(f"WITH {rows_sql()}, {_POOL} SELECT id, \"group\", pool FROM pooled")
def pool_split(spark, sf_dir):
    return pooled(spark, sf_dir).select("id", "group", "pool")


@query(f"""WITH {rows_sql()}, {_POOL}, r AS (SELECT *, row_number() OVER (PARTITION BY pool, dataset, label ORDER BY {_SEEDED}, id) AS place FROM pooled)
SELECT id, pool, dataset, label, place FROM r WHERE place <= 110""")
def stratified_top110(spark, sf_dir):
    return sampling.stratified(pooled(spark, sf_dir), ["pool", "dataset", "label"], 110).select("id", "pool", "dataset", "label", "place")


@query(f"""WITH {rows_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset, label ORDER BY doc_id) AS turn FROM rows)
SELECT id, row_number() OVER (ORDER BY turn, dataset, label) AS position FROM r ORDER BY turn, dataset, label LIMIT 100""")
def interleave_prefix(spark, sf_dir):
    return sampling.interleaved(rows(spark, sf_dir), ["dataset", "label"], ["doc_id"], 100).select("id", "position")


@query(f"WITH {rows_sql()} SELECT id, doc_id FROM rows ORDER BY sha256(id), id LIMIT 150")
def hash_subset(spark, sf_dir):
    return sampling.hash_subset(rows(spark, sf_dir), 150).select("id", "doc_id")


@query(f"WITH {rows_sql()}, few AS (SELECT id, doc_id FROM rows ORDER BY sha256(id), id LIMIT 150) SELECT id, CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS place FROM few")
def hash_subset_in_order(spark, sf_dir):
    return sampling.in_order(sampling.hash_subset(rows(spark, sf_dir), 150).select("id", "doc_id"), "doc_id").select("id", "place")


@query(f"WITH {rows_sql()}, few AS (SELECT id, CAST(split_part(id, ':', 2) AS BIGINT) AS n FROM rows ORDER BY n LIMIT 100) SELECT id, CAST(row_number() OVER (ORDER BY n) AS INTEGER) AS place FROM few")
def number_order(spark, sf_dir):
    first = sampling.by_number(rows(spark, sf_dir).select("id")).limit(100)
    return sampling.in_order(first.withColumn("n", F.split_part("id", F.lit(":"), F.lit(2)).cast("long")), "n").select("id", "place")


@query(f"""WITH {rows_sql()}, {_POOL}, used AS (SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY pool, dataset, label ORDER BY {_SEEDED}, id) AS place FROM pooled) WHERE place <= 10)
SELECT dataset, label, count(*) AS n FROM rows WHERE id NOT IN (SELECT id FROM used) GROUP BY dataset, label""")
def remaining_rows(spark, sf_dir):
    all_rows = pooled(spark, sf_dir)
    return sampling.remaining(all_rows, sampling.stratified(all_rows, ["pool", "dataset", "label"], 10), ["dataset", "label"])


@query(f"""WITH {rows_sql()}, s AS (SELECT id, length(doc) > 2000 AS truncated, CASE WHEN length(doc) > 2000 THEN substr(doc, 1, 1500) || chr(10) || '[Middle of long document omitted]' || chr(10) || right(doc, 500) ELSE doc END AS state FROM rows)
SELECT id, truncated, length(state) AS n, sha256(state) AS digest FROM s""")
def truncate_state(spark, sf_dir):
    cut = text.state(F.col("doc"), 2000)
    return rows(spark, sf_dir).select("id", text.is_truncated(F.col("doc"), 2000).alias("truncated"), F.length(cut).cast("long").alias("n"), F.sha2(cut, 256).alias("digest"))


@query(f"""WITH {rows_sql()} SELECT id, sha256('{{"claim": ' || CAST(to_json(claim) AS VARCHAR) || ', "document": ' || CAST(to_json(doc) AS VARCHAR) || '}}') AS input_hash,
 sha256('[' || CAST(to_json(doc) AS VARCHAR) || ', ' || CAST(to_json(claim) AS VARCHAR) || ']') AS pair_hash FROM rows""")
def input_hashes(spark, sf_dir):
    return rows(spark, sf_dir).select("id", hashing.input_hash(F.col("claim"), F.col("doc")).alias("input_hash"), hashing.digest(F.col("doc"), F.col("claim")).alias("pair_hash"))


# Scores from answers.


@query(f"WITH {scored_sql()} SELECT id, {', '.join(f'round({s}, 12) AS {s}' for s in SCORES)} FROM scored")
def extract_scores_double(spark, sf_dir):
    return scored(spark, sf_dir).select("id", *[F.round(s, 12).alias(s) for s in SCORES])


_EXACT = "1 - CAST(h_unsupported AS DECIMAL(18,6)) / 100"


@query(f"""WITH {scored_sql()}, e AS (SELECT id, h_support AS a, 100 - h_unsupported AS b, 100 - h_contradicted AS c FROM scored)
SELECT id, CAST(a AS DOUBLE) / 100 AS support, CAST(least(a, b, c) AS DOUBLE) / 100 AS min_rule, round((a + b + c) / 300.0, 12) AS mean_rule, round(CAST(a * b * c AS DOUBLE) / 1000000, 12) AS product_rule, least(a, b, c) > 30 AS accepted FROM e""")
def extract_scores_decimal(spark, sf_dir):
    exact = scored(spark, sf_dir, exact=True)
    return exact.select("id", F.col("support").cast("double").alias("support"), F.col(RULE).cast("double").alias(RULE), F.round(F.col("mean_rule").cast("double"), 12).alias("mean_rule"), F.round(F.col("product_rule").cast("double"), 12).alias("product_rule"), (F.col(RULE) > F.lit("0.30").cast("decimal(3,2)")).alias("accepted"))


@query(f"""WITH {scored_sql()} SELECT id, min_rule > CAST(0.3 AS DOUBLE) AS by_double, least(h_support, 100 - h_unsupported, 100 - h_contradicted) > 30 AS by_decimal FROM scored
WHERE (min_rule > CAST(0.3 AS DOUBLE)) <> (least(h_support, 100 - h_unsupported, 100 - h_contradicted) > 30)""")
def boundary_diff(spark, sf_dir):
    one = scored(spark, sf_dir).select("id", (F.col(RULE) > THRESHOLD).alias("by_double"))
    other = scored(spark, sf_dir, exact=True).select("id", (F.col(RULE) > F.lit("0.30").cast("decimal(3,2)")).alias("by_decimal"))
    return one.join(other, "id").where("by_double <> by_decimal")


_LOGITS = "given_l AS (SELECT id, CAST(h_support AS DOUBLE) / 20 AS y, CAST(h_direct AS DOUBLE) / 25 AS n, CAST(h_unsupported AS DOUBLE) / 30 AS u FROM given)"


@query(f"""WITH {scored_sql()}, {_LOGITS}
SELECT id, round(1 / (1 + exp((n - y) / 1.087)), 9) AS p_one, round(1 / (1 + exp((n - y) / 2.0)), 9) AS p_two, round(least(1 / (1 + exp((n - y) / 2.0)), 1 - 1 / (1 + exp((n - u) / 2.0))), 9) AS decided,
 round(exp(y) / (exp(n) + exp(y) + exp(u)), 9) AS second_class FROM given_l""")
def logit_rules(spark, sf_dir):
    given = rows(spark, sf_dir).select("id", *[(binding.hundredths(q, binding.QUESTIONS[q]) / F.lit(100.0) * 100 / d).alias(c) for q, d, c in (("support", 20.0, "y"), ("direct", 25.0, "n"), ("unsupported", 30.0, "u"))])
    logits = F.create_map(F.lit("support"), F.array("n", "y"), F.lit("unsupported"), F.array("n", "u"))
    p = lambda t: F.round(scores.p_yes(F.col("n"), F.col("y"), t), 9)
    return given.select("id", p(1.087).alias("p_one"), p(2.0).alias("p_two"), F.round(scores.decided(logits, ["unsupported"], 2.0), 9).alias("decided"), F.round(scores.softmax(F.array("n", "y", "u"))[1], 9).alias("second_class"))


@query(f"""WITH {scored_sql()}, l AS (SELECT id, ln(least(greatest(support, 0.001::DOUBLE), 0.999::DOUBLE) / (1 - least(greatest(support, 0.001::DOUBLE), 0.999::DOUBLE))) AS x, direct FROM scored)
SELECT id, round(x, 9) AS logit, round(1 / (1 + exp(-(x * 0.8::DOUBLE + direct * -0.5::DOUBLE + 0.1::DOUBLE))), 9) AS p FROM l""")
def logit_linear(spark, sf_dir):
    x = scores.clipped_logit(F.col("support"))
    return scored(spark, sf_dir).select("id", F.round(x, 9).alias("logit"), F.round(scores.linear([x, F.col("direct")], [0.8, -0.5], 0.1), 9).alias("p"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), o AS (SELECT e AS a FROM v WHERE vec_id = 0)
SELECT vec_id, round(list_inner_product(e, a), 6) AS dot, round(list_cosine_similarity(e, a), 6) AS cosine FROM v, o""")
def cosine_logits(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    option = v.where("vec_id = 0").select(F.col("embedding").alias("option"))
    one = option.withColumn("k", F.lit(1))
    joined = v.withColumn("k", F.lit(1)).join(F.broadcast(one), "k")  # a single vector
    return joined.select("vec_id", F.round(scores.dot(F.col("embedding"), F.col("option")), 6).alias("dot"), F.round(scores.cosine(F.col("embedding"), F.col("option")), 6).alias("cosine"))


# Metrics and thresholds.


def _metrics_sql(score: str, threshold: str, dataset: str = "lang") -> str:
    return f"""WITH {scored_sql(dataset)}, s AS (SELECT dataset, label, {score} AS score, {score} > CAST({threshold} AS DOUBLE) AS ok FROM scored),
both_ AS (SELECT dataset AS scope, label, score, ok FROM s UNION ALL SELECT '(pooled)', label, score, ok FROM s),
m AS (SELECT scope, count(*) AS n, avg(CASE WHEN ok = (label = 1) THEN 1.0 ELSE 0 END) AS accuracy, avg(CASE WHEN label = 1 THEN CASE WHEN ok THEN 1.0 ELSE 0 END END) AS tpr, avg(CASE WHEN label = 0 THEN CASE WHEN ok THEN 0.0 ELSE 1 END END) AS tnr FROM both_ GROUP BY scope),
a AS (SELECT p.scope, avg(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0 END) AS auc FROM both_ p JOIN both_ q ON p.scope = q.scope AND p.label = 1 AND q.label = 0 GROUP BY p.scope),
f AS (SELECT scope, n, (tpr + tnr) / 2 AS b, accuracy, auc, tpr, tnr FROM m LEFT JOIN a USING (scope)),
every AS (SELECT * FROM f UNION ALL SELECT '(macro)', sum(n), CASE WHEN count(b) = count(*) THEN avg(b) END, NULL, CASE WHEN count(auc) = count(*) THEN avg(auc) END, NULL, NULL FROM f WHERE scope <> '(pooled)')
SELECT scope, CAST(n AS BIGINT) AS n, round(b, 9) AS balanced_accuracy, round(accuracy, 9) AS accuracy, round(auc, 9) AS roc_auc, round(tpr, 9) AS supported_recall, round(tnr, 9) AS unsupported_recall, round(1 - tnr, 9) AS fpr, round(1 - tpr, 9) AS fnr FROM every"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes])


@query(_metrics_sql(RULE, "0.3"))
def metrics_by_source(spark, sf_dir):
    return _rounded(metrics.metrics(scored(spark, sf_dir), RULE, THRESHOLD))


@query(_metrics_sql("direct", "0.5", "source"))
def macro_null_veto(spark, sf_dir):
    return _rounded(metrics.metrics(scored(spark, sf_dir, "source"), "direct", 0.5))


def _grid_sql(keys: str, sources: str, macro_by: str) -> str:
    k = f"{keys}, " if keys else ""
    return f"""spine AS (SELECT unnest(generate_series(1, 99)) AS step),
g AS (SELECT {k}{sources}, step, (avg(CASE WHEN label = 1 THEN CASE WHEN score > CAST(step AS DOUBLE) / 100 THEN 1.0 ELSE 0 END END) + avg(CASE WHEN label = 0 THEN CASE WHEN score > CAST(step AS DOUBLE) / 100 THEN 0.0 ELSE 1 END END)) / 2 AS b FROM long, spine GROUP BY {k}{sources}, step),
macro AS (SELECT {k}step, round(CASE WHEN count(b) = count(*) THEN avg(b) END, 12) AS macro FROM g GROUP BY {macro_by}step),
best AS (SELECT *, row_number() OVER ({'PARTITION BY ' + keys if keys else ''} ORDER BY macro DESC, abs(step - 50), step DESC) AS place FROM macro WHERE macro IS NOT NULL)"""


@query(f"WITH {scored_sql()}, long AS (SELECT dataset, label, {RULE} AS score FROM scored), {_grid_sql('', 'dataset', '')} SELECT CAST(step AS DOUBLE) / 100 AS threshold, macro FROM best WHERE place = 1")
def tune_threshold(spark, sf_dir):
    return metrics.tuned(scored(spark, sf_dir), RULE, strict=False)  # the smallest tables have sources of one label; these queries have no rows there


@query(f"WITH {scored_sql()}, long AS (SELECT dataset, label, {RULE} AS score FROM scored), {_grid_sql('', 'dataset', '')} SELECT CAST(step AS BIGINT) AS step, macro FROM macro")
def threshold_curve(spark, sf_dir):
    return metrics.threshold_grid(scored(spark, sf_dir), RULE, []).withColumn("step", F.col("step").cast("long"))


@query(f"WITH {scored_sql()}, long AS (SELECT dataset AS source, dataset, label, {RULE} AS score FROM scored), {_grid_sql('source', 'dataset', 'source, ')} SELECT source, CAST(step AS DOUBLE) / 100 AS threshold, macro FROM best WHERE place = 1")
def tune_by_source(spark, sf_dir):
    return metrics.tuned(scored(spark, sf_dir).withColumn("source", F.col("dataset")), RULE, ["source"], strict=False)


_ASKED = {s: len(binding.PACK.questions_behind(s)) for s in SCORES}
_LONG = " UNION ALL ".join(f"SELECT '{s}' AS candidate, id, doc, dataset, label, {s} AS score FROM scored" for s in SCORES if s not in binding.PACK.diagnostic)
_ASKED_SQL = "CASE candidate " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in _ASKED.items()) + " END"


@query(f"""WITH {scored_sql()}, long AS ({_LONG}), {_grid_sql('candidate', 'dataset', 'candidate, ')}
SELECT candidate, CAST(step AS DOUBLE) / 100 AS threshold, macro, {_ASKED_SQL} AS questions, CAST(row_number() OVER (ORDER BY macro DESC, {_ASKED_SQL}, candidate) AS INTEGER) AS place FROM best WHERE best.place = 1""")
def rank_candidates(spark, sf_dir):
    return metrics.ranked_candidates(scored(spark, sf_dir), _ASKED, binding.PACK.diagnostic, strict=False)


_POOLS = f"""pools AS (SELECT id AS pid, CASE WHEN CAST(('0x' || substr({_GROUP}, 1, 8)) AS BIGINT) % 10 < 6 THEN 'tune' ELSE 'selection' END AS pool FROM rows)"""


@query(f"""WITH {scored_sql()}, {_POOLS}, every AS ({_LONG}), long AS (SELECT every.* FROM every JOIN pools ON pid = id AND pool = 'tune'), {_grid_sql('candidate', 'dataset', 'candidate, ')},
short AS (SELECT candidate, CAST(step AS DOUBLE) / 100 AS threshold, macro, row_number() OVER (ORDER BY macro DESC, {_ASKED_SQL}, candidate) AS rank FROM best WHERE place = 1),
top AS (SELECT * FROM short WHERE rank <= 3),
sel AS (SELECT e.candidate, e.dataset, (avg(CASE WHEN label = 1 THEN CASE WHEN score > threshold THEN 1.0 ELSE 0 END END) + avg(CASE WHEN label = 0 THEN CASE WHEN score > threshold THEN 0.0 ELSE 1 END END)) / 2 AS b
  FROM every e JOIN pools ON pid = id AND pool = 'selection' JOIN top ON top.candidate = e.candidate GROUP BY e.candidate, e.dataset),
final AS (SELECT candidate, round(CASE WHEN count(b) = count(*) THEN avg(b) END, 12) AS selection_macro FROM sel GROUP BY candidate)
SELECT candidate, threshold, macro AS tune_macro, selection_macro FROM final JOIN top USING (candidate) ORDER BY selection_macro DESC NULLS LAST, {_ASKED_SQL}, macro DESC, candidate LIMIT 1""")
def winner_selection(spark, sf_dir):
    named = [s for s in SCORES if s not in binding.PACK.diagnostic]
    long = metrics.unpivoted(sampling.with_pool(scored(spark, sf_dir)).drop("doc", "claim"), named, ["pool", "dataset", "label"])
    best = metrics.tuned_in_pool(long, "score", ["candidate"], strict=False)
    questions = F.create_map(*[F.lit(x) for s in named for x in (s, _ASKED[s])])[F.col("candidate")]
    short = best.withColumn("questions", questions).orderBy(F.col("tune_macro").desc(), "questions", "candidate").limit(3)
    return short.orderBy(F.col("selection_macro").desc_nulls_last(), "questions", F.col("tune_macro").desc(), "candidate").limit(1).select("candidate", "threshold", "tune_macro", "selection_macro")


_MODELS = "SELECT 'direct' AS model, id, doc, dataset, label, direct AS score FROM scored UNION ALL SELECT 'rule', id, doc, dataset, label, min_rule FROM scored"


@query(f"""WITH {scored_sql()}, {_POOLS}, every AS ({_MODELS}), long AS (SELECT every.* FROM every JOIN pools ON pid = id AND pool = 'tune'), {_grid_sql('model', 'dataset', 'model, ')},
rules AS (SELECT model, 'fitted' AS rule, CAST(step AS DOUBLE) / 100 AS threshold FROM best WHERE place = 1 UNION ALL SELECT model, 'fixed', CAST(0.3 AS DOUBLE) FROM best WHERE place = 1),
src AS (SELECT e.model, rule, threshold, dataset, (avg(CASE WHEN label = 1 THEN CASE WHEN score > threshold THEN 1.0 ELSE 0 END END) + avg(CASE WHEN label = 0 THEN CASE WHEN score > threshold THEN 0.0 ELSE 1 END END)) / 2 AS b
  FROM every e JOIN pools ON pid = id AND pool = 'selection' JOIN rules ON rules.model = e.model GROUP BY e.model, rule, threshold, dataset)
SELECT model, rule, threshold, round(CASE WHEN count(b) = count(*) THEN avg(b) END, 12) AS macro FROM src GROUP BY model, rule, threshold""")
def threshold_transfer(spark, sf_dir):
    s = sampling.with_pool(scored(spark, sf_dir))
    long = s.select("pool", "dataset", "label", F.explode(F.array(F.struct(F.lit("direct").alias("model"), F.col("direct").alias("score")), F.struct(F.lit("rule").alias("model"), F.col(RULE).alias("score")))).alias("x")).select("pool", "dataset", "label", "x.*")
    best = metrics.tuned_in_pool(long, "score", ["model"], fixed=30, strict=False)
    rules = F.array(F.struct(F.lit("fitted").alias("rule"), "threshold", F.col("selection_macro").alias("macro")), F.struct(F.lit("fixed").alias("rule"), F.lit(0.3).alias("threshold"), F.col("fixed_macro").alias("macro")))
    return best.select("model", F.explode(rules).alias("x")).select("model", "x.*")


_CLUSTERS = f"""clusters AS (SELECT dataset, sha256({_NORM}) AS cluster, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg, count(*) FILTER (WHERE label = 1 AND min_rule > CAST(0.3 AS DOUBLE)) AS a_pos, count(*) FILTER (WHERE label = 0 AND NOT min_rule > CAST(0.3 AS DOUBLE)) AS a_neg,
 count(*) FILTER (WHERE label = 1 AND direct > 0.5) AS b_pos, count(*) FILTER (WHERE label = 0 AND NOT direct > 0.5) AS b_neg FROM scored GROUP BY ALL)"""


@query(f"WITH {scored_sql()}, {_CLUSTERS} SELECT * FROM clusters")
def cluster_counts(spark, sf_dir):
    return metrics.clusters(scored(spark, sf_dir), RULE, "direct", THRESHOLD, 0.5)


_WEIGHT = " + ".join(f"(u >= {c!r}::DOUBLE)::INTEGER" for c in metrics.POISSON)
_ENDS = ", ".join(f"round(quantile_cont({c}, {p}), 9) AS {n}_{e}" for c, n in (("a", "primary"), ("b", "baseline"), ("d", "delta")) for e, p in (("low", 0.025), ("high", 0.975)))


@query(f"""WITH {scored_sql()}, {_CLUSTERS}, reps AS (SELECT unnest(generate_series(1, 1000)) AS r),
u AS (SELECT *, CAST(CAST(('0x' || substr(sha256(r || ':' || dataset || ':' || cluster), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u FROM clusters, reps),
w AS (SELECT *, {_WEIGHT} AS w FROM u),
s AS (SELECT r, dataset, sum(w * pos) AS pos, sum(w * neg) AS neg, sum(w * a_pos) AS a_pos, sum(w * a_neg) AS a_neg, sum(w * b_pos) AS b_pos, sum(w * b_neg) AS b_neg FROM w GROUP BY r, dataset),
x AS (SELECT r, (CAST(a_pos AS DOUBLE) / nullif(pos, 0) + CAST(a_neg AS DOUBLE) / nullif(neg, 0)) / 2 AS a, (CAST(b_pos AS DOUBLE) / nullif(pos, 0) + CAST(b_neg AS DOUBLE) / nullif(neg, 0)) / 2 AS b FROM s),
m AS (SELECT r, CASE WHEN count(a) = count(*) THEN avg(a) END AS a, CASE WHEN count(b) = count(*) THEN avg(b) END AS b FROM x GROUP BY r), d AS (SELECT *, a - b AS d FROM m)
SELECT {_ENDS}, count(d) AS valid_repeats, count(*) AS repeats FROM d""")
def bootstrap_ci(spark, sf_dir):
    return _rounded(metrics.bootstrap(metrics.clusters(scored(spark, sf_dir), RULE, "direct", THRESHOLD, 0.5)))


@query()
def bootstrap_exact(spark, sf_dir):
    return metrics.bootstrap_exact(metrics.clusters(scored(spark, sf_dir), RULE, "direct", THRESHOLD, 0.5, order="doc_id"))


# Joins.


_CACHE = "cache AS (SELECT id, support FROM scored WHERE doc_id % 3 <> 0)"


@query(f"WITH {scored_sql()}, {_CACHE} SELECT id FROM rows WHERE id NOT IN (SELECT id FROM cache)")
def pending_anti(spark, sf_dir):
    return joins.pending(rows(spark, sf_dir), scored(spark, sf_dir).where("doc_id % 3 <> 0")).select("id")


@query(f"WITH {scored_sql()}, {_CACHE} SELECT count(*) FILTER (WHERE id IN (SELECT id FROM cache)) AS completed, count(*) AS total, count(*) FILTER (WHERE id IN (SELECT id FROM cache)) = count(*) AS complete FROM rows")
def progress_count(spark, sf_dir):
    return joins.progress(rows(spark, sf_dir), scored(spark, sf_dir).where("doc_id % 3 <> 0"))


@query(f"WITH {scored_sql()}, {_CACHE} SELECT id, label FROM rows WHERE id IN (SELECT id FROM cache)")
def scored_semi(spark, sf_dir):
    return joins.scored(rows(spark, sf_dir), scored(spark, sf_dir).where("doc_id % 3 <> 0")).select("id", "label")


@query(f"""WITH {rows_sql()}, {_POOL}, other AS (SELECT DISTINCT sha256(doc) AS h FROM rows WHERE doc_id % 2 = 1)
SELECT pool, count(*) AS n, count(*) FILTER (WHERE sha256(doc) IN (SELECT h FROM other)) AS overlapping FROM pooled WHERE doc_id % 2 = 0 GROUP BY pool""")
def overlap_audit(spark, sf_dir):
    every = pooled(spark, sf_dir).withColumn("h", F.sha2("doc", 256))
    test, other = every.where("doc_id % 2 = 0"), every.where("doc_id % 2 = 1").select("h").distinct()
    return test.join(other.withColumn("seen", F.lit(1)), "h", "left").groupBy("pool").agg(F.count("*").alias("n"), F.count("seen").alias("overlapping"))


@query(f"""WITH {scored_sql()}, test AS (SELECT * FROM scored WHERE doc_id % 2 = 0 AND doc NOT IN (SELECT doc FROM scored WHERE doc_id % 2 = 1))
SELECT count(*) AS n, round(avg(CASE WHEN (min_rule > CAST(0.3 AS DOUBLE)) = (label = 1) THEN 1.0 ELSE 0 END), 9) AS accuracy FROM test""")
def overlap_sensitivity(spark, sf_dir):
    every = scored(spark, sf_dir).withColumn("h", F.sha2("doc", 256))
    kept = every.where("doc_id % 2 = 0").join(every.where("doc_id % 2 = 1").select("h"), "h", "left_anti")
    return kept.agg(F.count("*").alias("n"), F.round(F.avg(((F.col(RULE) > THRESHOLD) == (F.col("label") == 1)).cast("double")), 9).alias("accuracy"))


@query(f"""WITH {scored_sql()}, old AS (SELECT id, direct AS score FROM scored WHERE doc_id % 3 <> 0), new AS (SELECT id, support AS score FROM scored WHERE doc_id % 4 = 0)
SELECT id, CASE WHEN n.id IS NOT NULL THEN n.score ELSE o.score END AS score FROM old o FULL JOIN new n USING (id)""")
def overlay_upsert(spark, sf_dir):
    s = scored(spark, sf_dir)
    return joins.overlay(s.where("doc_id % 3 <> 0").select("id", F.col("direct").alias("score")), s.where("doc_id % 4 = 0").select("id", F.col("support").alias("score")))


@query(f"""WITH {scored_sql()} SELECT id, (CASE WHEN doc_id % 3 <> 0 THEN 2 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 3 <> 0 THEN 1 ELSE 2 END ELSE 0 END)::BIGINT AS n, CASE WHEN doc_id % 3 <> 0 THEN direct END AS direct, CASE WHEN doc_id % 2 = 0 THEN mean_rule END AS mean_rule, support FROM scored WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0""")
def merge_scores(spark, sf_dir):
    s = scored(spark, sf_dir)
    pair = lambda *names: F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]).alias("scores")
    merged = joins.merged_scores(s.where("doc_id % 3 <> 0").select("id", pair("support", "direct")), s.where("doc_id % 2 = 0").select("id", pair("support", "mean_rule")))
    return merged.select("id", F.size("scores").cast("long").alias("n"), *[F.col("scores")[n].alias(n) for n in ("direct", "mean_rule", "support")])


@query(f"WITH {rows_sql()}, q AS (SELECT unnest(['direct', 'support']) AS question) SELECT id, question, length('Q ' || question || ': ' || claim) AS n FROM rows, q")
def question_expansion(spark, sf_dir):
    shown = text.prompt("Q {question}: {claim}", question=F.col("question"), claim=F.col("claim"))
    return joins.per_question(rows(spark, sf_dir), ["direct", "support"]).select("id", "question", F.length(shown).cast("long").alias("n"))


_FILES = "files AS (SELECT 'doc' || doc_id || '.txt' AS file, doc_id AS d, text FROM documents)"
_CLAIMS = "claims AS (SELECT item_id, CAST(item_id AS VARCHAR) AS claim_id, text AS claim, CASE WHEN item_id % 4 <> 0 THEN ['doc' || (item_id * 50) || '.txt', 'doc' || (item_id * 100) || '.txt', 'none.txt'] END AS c FROM benchmark)"
_PAIRS = "pairs AS (SELECT claim_id, file FROM claims, files WHERE c IS NULL OR list_contains(c, file))"


def _claims_and_files(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"), "text")
    name = lambda n: F.concat(F.lit("doc"), (F.col("item_id") * n).cast("string"), F.lit(".txt"))
    claims = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("claim_id"), F.col("text").alias("claim"), F.when(F.col("item_id") % 4 != 0, F.array(name(50), name(100), F.lit("none.txt"))).alias("candidate_documents"))
    return claims, files


@query(f"WITH {_FILES}, {_CLAIMS}, {_PAIRS} SELECT claim_id, file FROM pairs")
def candidate_join(spark, sf_dir):
    return joins.candidates(*_claims_and_files(spark, sf_dir)).select("claim_id", "file")


_SENTENCES = r"""list_filter(list_transform(regexp_split_to_array(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"""


def _support(chunk, claim: str):
    chunk = F.col(chunk) if isinstance(chunk, str) else chunk
    h = F.conv(F.substring(F.sha2(F.concat(chunk, F.lit("|"), F.col(claim)), 256), 1, 8), 16, 10).cast("long")
    return h % 101 / F.lit(100.0)


@query(f"""WITH {_FILES}, {_CLAIMS}, {_PAIRS}, parts AS (SELECT claim_id, file, unnest({_SENTENCES}) AS chunk, generate_subscripts({_SENTENCES}, 1) - 1 AS chunk_index FROM pairs JOIN files USING (file)),
s AS (SELECT claim_id, file, chunk_index, CAST(CAST(('0x' || substr(sha256(chunk || '|' || claim_id), 1, 8)) AS BIGINT) % 101 AS DOUBLE) / 100 AS support FROM parts),
r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY support DESC, file, chunk_index) AS place FROM s)
SELECT claim_id, file, CAST(chunk_index AS INTEGER) AS chunk_index, support, CASE WHEN support > 0.5 THEN 'Supported' ELSE 'Refuted' END AS verdict FROM r WHERE place = 1""")
def argmax_document(spark, sf_dir):
    claims, files = _claims_and_files(spark, sf_dir)
    cut = lambda df: df.select("*", F.posexplode(chunking.sentences(F.col("text"))).alias("chunk_index", "chunk"))
    own = cut(joins.named(claims, files)).select("claim_id", "file", "chunk_index", _support("chunk", "claim_id").alias("support"))
    every = joins.best_anywhere(joins.free(claims), cut(files), chunking.hash_grid)
    return joins.best_document(own.unionByName(every)).withColumn("verdict", F.when(F.col("support") > 0.5, "Supported").otherwise("Refuted"))


@query(f"""WITH {rows_sql()}, parts AS (SELECT id, text, unnest({_SENTENCES}) AS chunk, generate_subscripts({_SENTENCES}, 1) - 1 AS i FROM (SELECT id, doc AS text FROM rows)),
s AS (SELECT id, i, CAST(CAST(('0x' || substr(sha256(chunk || '|' || id), 1, 8)) AS BIGINT) % 101 AS DOUBLE) / 100 AS p FROM parts),
b AS (SELECT id, max(p) AS score, count(*) AS n_chunks, min_by(i, (-p, i)) AS best FROM s GROUP BY id)
SELECT rows.id, coalesce(score, 0) AS score, coalesce(n_chunks, 0) AS n_chunks, CAST(best AS INTEGER) AS best_chunk FROM rows LEFT JOIN b USING (id)""")
def chunk_max(spark, sf_dir):
    parts = chunking.exploded(rows(spark, sf_dir), chunking.sentences(F.col("doc"))).withColumn("support", F.when(F.col("chunk").isNotNull(), _support("chunk", "id")))
    return chunking.folded(parts)


@query(f"""WITH {rows_sql()}, parts AS (SELECT id, unnest({_SENTENCES}) AS chunk FROM (SELECT id, doc AS text FROM rows)), m AS (SELECT id, max(length(chunk) // 4) AS v FROM parts GROUP BY id)
SELECT count(v) AS "rows", CAST(sum(v) AS BIGINT) AS total FROM m""")
def token_maxima(spark, sf_dir):
    parts = rows(spark, sf_dir).select("id", F.explode(chunking.sentences(F.col("doc"))).alias("chunk"))
    return audit.largest_summed(parts.select("id", F.floor(F.length("chunk") / 4).alias("tokens")), "tokens")


@query()
def packed_chunks(spark, sf_dir):
    parts = chunking.exploded(rows(spark, sf_dir).select("id", "claim", "doc"), chunking.packed(F.col("doc"), 100)).select("id", "claim", "chunk_index", "chunk")
    return chunking.folded(chunking.scored_by(parts, chunking.hash_model))


# Constraints.


@query(f"WITH {scored_sql()}, {_CACHE} SELECT id, 'missing' AS violation FROM rows WHERE id NOT IN (SELECT id FROM cache)")
def coverage_check(spark, sf_dir):
    return checks.uncovered(rows(spark, sf_dir), scored(spark, sf_dir).where("doc_id % 3 <> 0"))


@query(f"WITH {rows_sql()}, {_POOL} SELECT \"group\", count(DISTINCT pool) AS n FROM pooled GROUP BY \"group\" HAVING count(DISTINCT pool) > 1")
def disjoint_check(spark, sf_dir):
    return checks.shared(pooled(spark, sf_dir), "group", "pool")


@query(f"WITH {rows_sql()}, {_POOL} SELECT \"group\", count(*) AS n FROM pooled GROUP BY \"group\" HAVING count(*) > 1")
def unique_check(spark, sf_dir):
    return checks.repeated(pooled(spark, sf_dir), "group")


@query(f"WITH {rows_sql()} SELECT id, sha256(doc) AS stored, sha256({_NORM}) AS recomputed FROM rows WHERE sha256(doc) <> sha256({_NORM})")
def changed_check(spark, sf_dir):
    return checks.changed(rows(spark, sf_dir).withColumn("stored_hash", F.sha2("doc", 256)), "stored_hash", F.sha2(text.normalised(F.col("doc")), 256))


@query(f"""WITH {scored_sql()}, {_CACHE}, {_POOL}, c AS (SELECT 'coverage' AS "check", count(*) AS n FROM rows WHERE id NOT IN (SELECT id FROM cache) UNION ALL SELECT 'unique_ids', count(*) FROM (SELECT id FROM rows GROUP BY id HAVING count(*) > 1)
 UNION ALL SELECT 'disjoint_pools', count(*) FROM (SELECT "group" FROM pooled GROUP BY 1 HAVING count(DISTINCT pool) > 1)) SELECT "check", n, n = 0 AS passed FROM c""")
def audit_checks(spark, sf_dir):
    r = pooled(spark, sf_dir)
    return checks.audit(coverage=checks.uncovered(r, scored(spark, sf_dir).where("doc_id % 3 <> 0")), unique_ids=checks.repeated(r, "id"), disjoint_pools=checks.shared(r, "group", "pool"))


# Error audit, usage.


def _judged(spark, sf_dir):
    return audit.with_outcome(scored(spark, sf_dir), F.col(RULE) > THRESHOLD)


_JUDGED = "judged AS (SELECT *, CASE WHEN label = 1 THEN CASE WHEN min_rule > CAST(0.3 AS DOUBLE) THEN 'TP' ELSE 'FN' END ELSE CASE WHEN min_rule > CAST(0.3 AS DOUBLE) THEN 'FP' ELSE 'TN' END END AS outcome FROM scored)"
_COUNTS = "count(*) FILTER (WHERE outcome = 'TP') AS tp, count(*) FILTER (WHERE outcome = 'FN') AS fn, count(*) FILTER (WHERE outcome = 'FP') AS fp, count(*) FILTER (WHERE outcome = 'TN') AS tn"
_RATES = "round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 9) AS supported_recall, round(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 9) AS unsupported_recall, round((CAST(tp AS DOUBLE) / nullif(tp + fn, 0) + CAST(tn AS DOUBLE) / nullif(tn + fp, 0)) / 2, 9) AS balanced_accuracy, round(CAST(tp + tn AS DOUBLE) / (tp + fn + fp + tn), 9) AS accuracy"


@query(f"WITH {scored_sql()}, {_JUDGED}, c AS (SELECT dataset, {_COUNTS} FROM judged GROUP BY dataset) SELECT *, {_RATES} FROM c")
def confusion_by_source(spark, sf_dir):
    return _rounded(audit.confusion(_judged(spark, sf_dir)))


@query(f"""WITH {scored_sql()}, r AS (SELECT 'no_gate' AS rule, label, least(support, no_contradicted) > CAST(0.3 AS DOUBLE) AS ok FROM scored UNION ALL SELECT 'direct', label, direct > 0.5 FROM scored UNION ALL SELECT 'rule', label, min_rule > CAST(0.3 AS DOUBLE) FROM scored),
o AS (SELECT rule, CASE WHEN label = 1 THEN CASE WHEN ok THEN 'TP' ELSE 'FN' END ELSE CASE WHEN ok THEN 'FP' ELSE 'TN' END END AS outcome FROM r), c AS (SELECT rule, {_COUNTS} FROM o GROUP BY rule) SELECT *, {_RATES} FROM c""")
def counterfactuals(spark, sf_dir):
    rules = {"no_gate": F.least("support", "no_contradicted") > THRESHOLD, "direct": F.col("direct") > 0.5, "rule": F.col(RULE) > THRESHOLD}
    return _rounded(audit.counterfactuals(scored(spark, sf_dir), rules))


@query(f"""WITH {scored_sql()}, m AS (SELECT label FROM scored WHERE NOT min_rule > CAST(0.3 AS DOUBLE) AND least(support, no_contradicted) > CAST(0.3 AS DOUBLE)) SELECT count(*) FILTER (WHERE label = 1) AS additional_tp, count(*) FILTER (WHERE label = 0) AS additional_fp FROM m""")
def gate_changes(spark, sf_dir):
    return audit.gate_changes(scored(spark, sf_dir), F.col(RULE) > THRESHOLD, F.least("support", "no_contradicted") > THRESHOLD)


@query(f"""WITH {scored_sql()}, {_JUDGED}, b AS (SELECT array_to_string(list_filter([CASE WHEN support <= CAST(0.3 AS DOUBLE) THEN 'support' END, CASE WHEN no_unsupported <= CAST(0.3 AS DOUBLE) THEN 'no_unsupported' END, CASE WHEN no_contradicted <= CAST(0.3 AS DOUBLE) THEN 'no_contradicted' END], lambda x: x IS NOT NULL), ' + ') AS blockers FROM judged WHERE outcome = 'FN')
SELECT blockers, count(*) AS n FROM b GROUP BY blockers""")
def fn_blockers(spark, sf_dir):
    parts = {n: F.col(n) for n in ("support", "no_unsupported", "no_contradicted")}
    return _judged(spark, sf_dir).where("outcome = 'FN'").groupBy(scores.blockers(parts, THRESHOLD).alias("blockers")).agg(F.count("*").alias("n"))


@query(f"WITH {scored_sql()}, {_JUDGED} SELECT dataset, count(*) FILTER (WHERE outcome = 'FP' AND min_rule >= CAST(0.4 AS DOUBLE)) AS confident_fp, count(*) FILTER (WHERE outcome = 'FN' AND min_rule <= CAST(0.25 AS DOUBLE)) AS confident_fn FROM judged GROUP BY dataset")
def confidence_bands(spark, sf_dir):
    return audit.confident_errors(_judged(spark, sf_dir), RULE, 0.4, 0.25)


@query(f"""WITH {scored_sql()}, {_JUDGED}, e AS (SELECT *, row_number() OVER (PARTITION BY dataset, outcome ORDER BY sha256('{sampling.SEED}' || id), id) AS place, count(*) OVER (PARTITION BY dataset, outcome) AS stratum_errors FROM judged WHERE outcome IN ('FN', 'FP'))
SELECT id, dataset, outcome, CAST(place AS INTEGER) AS place, stratum_errors, CAST(row_number() OVER (ORDER BY dataset, outcome, place) AS INTEGER) AS review_index FROM e WHERE place <= 4""")
def error_sample(spark, sf_dir):
    order = F.sha2(F.concat(F.lit(sampling.SEED), F.col("id")), 256)
    return audit.error_sample(_judged(spark, sf_dir), order).select("id", "dataset", "outcome", "place", "stratum_errors", "review_index")


@query(f"WITH {scored_sql()}, {_JUDGED} SELECT dataset, {_COUNTS.replace(' AS tp', ' AS TP').replace(' AS fn', ' AS FN')} FROM judged GROUP BY dataset".replace("AS fp,", "AS FP,").replace("AS tn", "AS TN"))
def outcome_tallies(spark, sf_dir):
    return audit.tallies(_judged(spark, sf_dir), "dataset", "outcome", list(audit.OUTCOMES))


@query("SELECT count(value) AS n, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.9), 9) AS p90, round(quantile_cont(value, 0.95), 9) AS p95, round(quantile_cont(value, 0.99), 9) AS p99, round(median(value), 9) AS median FROM events")
def latency_percentiles(spark, sf_dir):
    return _rounded(audit.latencies(table(spark, sf_dir, "events"), "value"))


@query("""WITH r AS (SELECT event_type AS stage, user_id % 3 AS extra, user_id % 1000 AS i, event_id % 50 AS o FROM events)
SELECT coalesce(stage, '(total)') AS stage, count(*) AS responses, CAST(sum(extra) AS BIGINT) AS retries, CAST(sum(i) AS BIGINT) AS tokens_in, CAST(sum(o) AS BIGINT) AS tokens_out, round((sum(i) * 0.042::DOUBLE + sum(o) * 0.3::DOUBLE) / 1e6, 12) AS usd FROM r GROUP BY GROUPING SETS ((stage), ())""")
def usage_cost(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), (F.col("user_id") % 3 + 1).alias("attempts"), (F.col("user_id") % 1000).alias("tokens_in"), (F.col("event_id") % 50).alias("tokens_out"))
    return audit.usage(log, "stage", 0.042, 0.3).withColumn("usd", F.round("usd", 12))


@query("SELECT event_type, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM events GROUP BY event_type")
def freeze_gap(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6).alias("seconds"))


@query(f"""WITH {scored_sql()}, d AS (SELECT id, direct > 0.5 AS f, support > CAST(0.6 AS DOUBLE) AS r FROM scored) SELECT count(*) AS n, round(CAST(count(*) FILTER (WHERE f AND NOT r) AS DOUBLE) / count(*), 9) AS accuracy, round(CAST(count(*) FILTER (WHERE f AND NOT r) AS DOUBLE) / nullif(count(*) FILTER (WHERE f), 0), 9) AS precision FROM d""")
def evidence_consistency(spark, sf_dir):
    s = scored(spark, sf_dir)
    return _rounded(audit.consistency(s.select("id", (F.col("direct") > 0.5).alias("accepted")), s.select("id", (F.col("support") > 0.6).alias("accepted"))))


@query(f"WITH {scored_sql()} SELECT round(avg(pow(min_rule - label, 2)), 9) AS brier, round(max(abs(min_rule - mean_rule)), 9) AS difference, bool_and((min_rule > CAST(0.3 AS DOUBLE)) = (mean_rule > CAST(0.3 AS DOUBLE))) AS same FROM scored")
def brier_and_agreement(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.agg(F.round(F.avg(F.pow(F.col(RULE) - F.col("label"), 2)), 9).alias("brier"), F.round(F.max(F.abs(F.col(RULE) - F.col("mean_rule"))), 9).alias("difference"), F.bool_and((F.col(RULE) > THRESHOLD) == (F.col("mean_rule") > THRESHOLD)).alias("same"))


@query(f"WITH {scored_sql()} SELECT id, round(support + CAST(h_contradicted AS DOUBLE) / 100, 9) AS both_sides FROM scored")
def negation_sum(spark, sf_dir):
    a = answered(spark, sf_dir)
    one = a.select("id", F.col("answers")["support"]["noul"].alias("p"))
    other = a.select("id", F.col("answers")["contradicted"]["noul"].alias("q"))
    return one.join(other, "id").select("id", F.round(F.col("p") + F.col("q"), 9).alias("both_sides"))


@query(f"""WITH {scored_sql()} SELECT id, CASE WHEN h_complete >= 50 THEN 'yes' ELSE 'no' END AS choice, CASE WHEN greatest(h_complete, 100 - h_complete) >= 80 THEN 'auto' ELSE 'review' END AS route FROM scored""")
def choice_verdict(spark, sf_dir):
    a = answered(spark, sf_dir).select("id", F.map_entries(F.col("answers")["complete"]["probabilities"]).alias("p"))
    top = F.reduce("p", F.struct(F.lit("").alias("key"), F.lit(-1.0).alias("value")), lambda m, x: F.when(x["value"] > m["value"], F.struct(x["key"].alias("key"), x["value"].alias("value"))).otherwise(m))
    # The route goes by the decimal that is written, so that 0.8 is at the threshold whatever its double is.
    written = F.col("top.value").cast("string").cast(scores.DECIMAL)
    return a.withColumn("top", top).select("id", F.col("top.key").alias("choice"), F.when(written >= F.lit("0.8").cast(scores.DECIMAL), "auto").otherwise("review").alias("route"))


# Calibration.


@query(f"""WITH {scored_sql()}, s AS (SELECT dataset, label, count(*) AS n FROM rows GROUP BY dataset, label) SELECT id, round(CAST((SELECT count(*) FROM rows) AS DOUBLE) / ((SELECT count(*) FROM s) * s.n), 12) AS weight FROM rows JOIN s USING (dataset, label)""")
def stratum_weights(spark, sf_dir):
    return calibration.with_weights(rows(spark, sf_dir)).select("id", F.round("weight", 12).alias("weight"))


def _folds(df: DataFrame, n: int = 5) -> DataFrame:
    return df.withColumn("fold", (hashing.prefix_number(hashing.text_group(F.col("doc"))) % n).cast("int"))


@query(f"""WITH {scored_sql()}, f AS (SELECT CAST(('0x' || substr({_GROUP}, 1, 8)) AS BIGINT) % 5 AS fold, label, mean_rule FROM scored), a AS (SELECT fold, avg(CASE WHEN (mean_rule > 0.5) = (label = 1) THEN 1.0 ELSE 0 END) AS accuracy FROM f GROUP BY fold)
SELECT round(avg(accuracy), 9) AS mean, round(stddev_samp(accuracy), 9) AS sd, round(stddev_samp(accuracy) / sqrt(count(*)), 9) AS se FROM a""")
def fold_se(spark, sf_dir):
    each = _folds(scored(spark, sf_dir)).groupBy("fold").agg(F.avg(((F.col("mean_rule") > 0.5) == (F.col("label") == 1)).cast("double")).alias("accuracy"))
    return _rounded(calibration.spread(each, "accuracy", []))


@query()
def group_folds(spark, sf_dir):
    return sampling.group_folds(pooled(spark, sf_dir), "group", 5)


@query()
def logistic_fit(spark, sf_dir):
    model = calibration.fit(calibration.with_weights(scored(spark, sf_dir)), ["support", "no_unsupported", "no_contradicted"], 1.0)
    return spark.createDataFrame([(n, w) for n, w in zip([*model.features, "(bias)"], [*model.weights, model.bias])], "feature string, weight double")


@query()
def one_se_choice(spark, sf_dir):
    features, found = ["support", "no_unsupported", "no_contradicted"], None
    # What the 40 fits need of a row is worked out once and written: no text is read again.
    s = calibration.with_fold_weights(lineage.written(_folds(scored(spark, sf_dir)).select("fold", "dataset", "label", *features)), 5)
    s = lineage.written(s.hint("rebalance"))
    for logits, c in itertools.product((False, True), (0.01, 0.1, 1.0, 10.0)):
        out = calibration.out_of_fold(s, features, c, 5, logits=logits)
        each = out.groupBy("fold").agg(F.avg(((F.col("score") > 0.5) == (F.col("label") == 1)).cast("double")).alias("v"))
        row = calibration.spread(each, "v", []).withColumn("c", F.lit(c)).withColumn("logits", F.lit(logits))
        found = row if found is None else found.unionByName(row)
    return calibration.one_standard_error(found)


# Texts, tables, records.


_BOARD = f"WITH {scored_sql()}, b AS (SELECT dataset AS name, round(avg(support), 3) AS support, round(avg(direct), 3) AS direct, round(avg(min_rule), 3) AS min_rule FROM scored GROUP BY dataset)"


def _board(spark, sf_dir):
    return scored(spark, sf_dir).groupBy(F.col("dataset").alias("name")).agg(*[F.round(F.avg(c), 3).alias(c) for c in ("support", "direct", RULE)])


@query(f"""{_BOARD}, l AS (UNPIVOT b ON support, direct, min_rule INTO NAME metric VALUE value), r AS (SELECT *, dense_rank() OVER (PARTITION BY metric ORDER BY value DESC) AS place FROM l) SELECT name, metric, value, CAST(place AS INTEGER) AS place FROM r WHERE place <= 2""")
def best_second_best(spark, sf_dir):
    return leaderboard.places(_board(spark, sf_dir), "name", ["support", "direct", RULE])


@query()
def marked_table(spark, sf_dir):
    return leaderboard.marked(_board(spark, sf_dir), "name", ["support", "direct", RULE])


@query("""SELECT page_id, regexp_replace(regexp_replace(split_part(url, '/', -1), '[^A-Za-z0-9.-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, substr(regexp_replace(url, '[^a-zA-Z0-9_.-]', '_', 'g'), 1, 80) AS folder FROM pages""")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.slug(F.col("url")).alias("slug"), text.path_slug(F.col("url")).alias("folder"))


@query("""SELECT o_orderkey, TRY_CAST(nullif(regexp_extract(replace('**' || format('{:,}', o_orderkey) || '.50** pts', ',', ''), '[-+]?\\d*\\.?\\d+'), '') AS DOUBLE) AS value FROM orders""")
def numeric_cells(spark, sf_dir):
    cell = F.concat(F.lit("**"), F.format_number("o_orderkey", 0), F.lit(".50** pts"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.number(text.unmarked(cell)).alias("value"))


@query("""SELECT conv_id, count(*) AS turns, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS state FROM conversations GROUP BY conv_id""")
def conversation_state(spark, sf_dir):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line")))), lambda x: x["line"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sha2(F.array_join(lines, "\n"), 256).alias("state"))


@query(f"""WITH n AS (SELECT doc_id, lower({_NORM.replace('doc,', 'text,')}) AS t FROM documents), q AS (SELECT item_id, lower({_NORM.replace('doc,', 'text,')}) AS t FROM benchmark)
SELECT item_id, count(*) AS n, min(doc_id) AS first_doc FROM n JOIN q ON contains(n.t, q.t) GROUP BY item_id""")
def quote_containment(spark, sf_dir):
    quotes = table(spark, sf_dir, "benchmark").select("item_id", text.quotes_folded(F.col("text")).alias("q"))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.quotes_folded(F.col("text")).alias("t"))
    return joins.containing(docs, quotes).groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(f"""WITH s AS (SELECT doc_id, unnest({_SENTENCES}) AS s, generate_subscripts({_SENTENCES}, 1) AS i FROM documents WHERE text IS NOT NULL) SELECT doc_id, count(*) AS sections, max(length(s)) AS longest FROM s GROUP BY doc_id""")
def section_split(spark, sf_dir):
    parts = table(spark, sf_dir, "documents").select("doc_id", F.explode(chunking.sentences(F.col("text"))).alias("s"))
    return parts.groupBy("doc_id").agg(F.count("*").alias("sections"), F.max(F.length("s").cast("long")).alias("longest"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT -1 - o_custkey AS a, o_orderkey AS b FROM orders),
n AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r AS (SELECT x AS node, x AS part FROM n UNION SELECT n.y, r.part FROM r JOIN n ON n.x = r.node WHERE r.part < n.y),
p AS (SELECT node, min(part) AS part FROM r GROUP BY node), d AS (SELECT x, count(*) AS degree FROM n GROUP BY x)
SELECT part, count(*) AS nodes, max(degree) > 2 AS branched, (SELECT count(*) FROM e JOIN p q ON q.node = e.a WHERE q.part = p.part) AS triples FROM p JOIN d ON d.x = p.node GROUP BY part""")
def context_graph(spark, sf_dir):
    # Customers are below 0 and orders from 0, so that no key is both.
    triples = table(spark, sf_dir, "orders").select((-1 - F.col("o_custkey")).alias("a"), F.col("o_orderkey").alias("b")).distinct()
    return graph.shapes(triples, graph.parts(triples))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, list_sort(list(DISTINCT user_id % 5))::VARCHAR AS kinds FROM events GROUP BY event_type""")
def distinct_sets(spark, sf_dir):
    kinds = F.array_sort(F.collect_set((F.col("user_id") % 5).cast("string")))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.concat(F.lit("["), F.array_join(kinds, ", "), F.lit("]")).alias("kinds"))


@query("""SELECT user_id, arg_max(event_id, event_id) AS last_event, min(event_id) AS first_event FROM events GROUP BY user_id""")
def keep_last(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").alias("last_event"))
    return joins.keep_last(e, "user_id", "event_id").join(joins.first_seen(e, "user_id", "event_id").withColumnRenamed("event_id", "first_event"), "user_id")


# Scans, sinks, streams: written into the shared folder and read back.


def _folder(spark: SparkSession) -> str:
    """A new folder in the one that all executors share."""
    return f"{lineage.shared_folder(spark).rstrip('/')}/claimworks-{uuid.uuid4().hex}"


@query(f"""WITH {scored_sql()}, {_JUDGED} SELECT dataset, {_COUNTS} FROM judged GROUP BY dataset""")
def stream_confusion(spark, sf_dir):
    from claimworks.streaming import resume

    folder = _folder(spark)
    s = scored(spark, sf_dir).select("id", "dataset", "label", F.col(RULE).alias("score"))
    s.where("label = 1").write.mode("append").parquet(f"{folder}/incoming")
    s.where("label = 0").write.mode("append").parquet(f"{folder}/incoming")
    incoming = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 8).parquet(f"{folder}/incoming")
    resume.score_new_files(spark, incoming, folder, lambda new: new)
    cached = spark.readStream.schema(s.schema).parquet(f"{folder}/cache")
    return resume.running_confusion(spark, cached, F.col("score") > THRESHOLD, folder)


@query(f"WITH {rows_sql()} SELECT id, dataset, claim, label, length(doc) AS n FROM rows")
def user_file(spark, sf_dir):
    from claimworks.sources import scans, sinks

    folder = _folder(spark)
    sinks.write_json_lines(rows(spark, sf_dir).select("id", F.col("doc").alias("document"), "claim", "dataset", (F.col("label") == 1).alias("label")), folder)
    found = scans.user_rows(spark.read.schema("id string, document string, claim string, dataset string, label boolean").json(folder))
    return found.select("id", "dataset", "claim", "label", F.length("doc").cast("long").alias("n"))


@query("SELECT CAST(item_id AS VARCHAR) AS claim_id, length(text) AS n, CAST(item_id % 3 AS VARCHAR) AS kind FROM benchmark")
def claims_folder(spark, sf_dir):
    from claimworks.sources import scans

    folder = _folder(spark)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("claim_id"), F.col("text").alias("claim"), (F.col("item_id") % 3).alias("kind"))
    whole = items.select(F.to_json(F.struct("*")).alias("value")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))  # the benchmark's items
    whole.write.text(folder)
    loaded = scans.claims(spark, folder, "part-*")
    return loaded.select("claim_id", F.length("claim").cast("long").alias("n"), F.col("claim_metadata")["kind"].alias("kind"))


# Checkers, comparisons, studies.


def _cache(spark, sf_dir):
    p = {q: binding.hundredths(q, binding.QUESTIONS[q]) / F.lit(100.0) for q in ("support", "unsupported", "contradicted")}
    return rows(spark, sf_dir).select("id", "doc_id", F.create_map(*[x for q, c in p.items() for x in (F.lit(q), c)]).alias("answers"))


@query(_metrics_sql(RULE, "0.3").replace("SELECT scope, CAST(n AS BIGINT) AS n", "SELECT 'rule' AS model, CAST(0.3 AS DOUBLE) AS threshold, true AS complete, scope, CAST(n AS BIGINT) AS n"))
def checker_report(spark, sf_dir):
    return _rounded(checkers.report(rows(spark, sf_dir), _cache(spark, sf_dir), checkers.Checker("rule")))


@query(_metrics_sql(RULE, "0.3").replace("s AS (SELECT dataset, label, min_rule AS score", "s0 AS (SELECT * FROM scored WHERE doc_id % 3 <> 0), s AS (SELECT dataset, label, min_rule AS score").replace("AS ok FROM scored)", "AS ok FROM s0)").replace("SELECT scope, CAST(n AS BIGINT) AS n", "SELECT 'rule' AS model, CAST(0.3 AS DOUBLE) AS threshold, false AS complete, scope, CAST(n AS BIGINT) AS n"))
def partial_report(spark, sf_dir):
    return _rounded(checkers.report(rows(spark, sf_dir), _cache(spark, sf_dir).where("doc_id % 3 <> 0"), checkers.Checker("rule")))


@query()
def model_comparison(spark, sf_dir):
    r, cache = rows(spark, sf_dir), _cache(spark, sf_dir)
    logits = cache.withColumn("logits", F.transform_values("answers", lambda k, v: F.array(F.lit(0.0), v * 4 - 2)))
    return checkers.comparison(checkers.report(r, cache, checkers.Checker("rule")), checkers.report(r, logits, checkers.Checker("logits", "logits", temperature=2.0)), checkers.report(r, cache.withColumn("score", F.col("answers")["support"]), checkers.Checker("support", "score", threshold=0.5)))


@query(f"""WITH {scored_sql()}, n AS (SELECT id, {RULE} AS score FROM scored WHERE doc_id % 5 = 0), c AS (SELECT s.dataset, s.label, CASE WHEN n.id IS NOT NULL THEN n.score ELSE s.direct END AS score FROM scored s LEFT JOIN n USING (id) WHERE dataset <> 'fr' OR n.id IS NOT NULL),
b AS (SELECT dataset, (avg(CASE WHEN label = 1 THEN CASE WHEN score > CAST(0.3 AS DOUBLE) THEN 1.0 ELSE 0 END END) + avg(CASE WHEN label = 0 THEN CASE WHEN score > CAST(0.3 AS DOUBLE) THEN 0.0 ELSE 1 END END)) / 2 AS b, count(*) AS n FROM c GROUP BY dataset)
SELECT CAST(sum(n) AS BIGINT) AS n, round(CASE WHEN count(b) = count(*) THEN avg(b) END, 9) AS macro FROM b""")
def pilot_composite(spark, sf_dir):
    s = scored(spark, sf_dir)
    full = s.where(~F.col("dataset").isin("fr")).select("id", F.col("direct").alias("score"))
    sampled = s.where("doc_id % 5 = 0").select("id", F.col(RULE).alias("score"))
    found = metrics.metrics(rows(spark, sf_dir).join(joins.overlay(full, sampled), "id"), "score", THRESHOLD)
    return found.where("scope = '(macro)'").select("n", F.round("balanced_accuracy", 9).alias("macro"))


@query(f"""WITH {scored_sql()}, long AS (SELECT dataset, label, min_rule AS score FROM scored UNION ALL SELECT dataset, label, direct FROM scored WHERE doc_id % 2 = 0), {_grid_sql('', 'dataset', '')} SELECT CAST(step AS DOUBLE) / 100 AS threshold, macro FROM best WHERE place = 1""")
def refit_combined(spark, sf_dir):
    s = scored(spark, sf_dir)
    both = s.select("dataset", "label", F.col(RULE).alias("score")).unionByName(s.where("doc_id % 2 = 0").select("dataset", "label", F.col("direct").alias("score")))
    return metrics.tuned(both, "score", strict=False)


@query(f"""WITH {scored_sql()}, v AS (SELECT id, label, CASE WHEN h_direct >= 67 THEN 'Entailment' WHEN h_direct >= 34 THEN 'Neutral' ELSE 'Contradiction' END AS nli FROM scored), g AS (SELECT *, CASE WHEN nli = 'Entailment' THEN 'Grounded' ELSE 'Ungrounded' END AS verdict FROM v)
SELECT nli, verdict, count(*) AS n FROM g WHERE (verdict = 'Grounded') <> (label = 1) GROUP BY nli, verdict""")
def label_map(spark, sf_dir):
    nli = F.when(F.col("direct") >= 0.67, "Entailment").when(F.col("direct") >= 0.34, "Neutral").otherwise("Contradiction")
    kept = scored(spark, sf_dir).withColumn("nli", nli).withColumn("verdict", text.renamed(F.col("nli"), {"Entailment": "Grounded", "Neutral": "Ungrounded", "Contradiction": "Ungrounded"}))
    return kept.where((F.col("verdict") == "Grounded") != (F.col("label") == 1)).groupBy("nli", "verdict").agg(F.count("*").alias("n"))


@query(f"""WITH {scored_sql()}, p AS (SELECT 'a' AS pack, 0.3::DOUBLE AS t UNION ALL SELECT 'b', 0.5::DOUBLE) SELECT pack, count(*) AS n, count(*) FILTER (WHERE min_rule > t) AS accepted FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS k FROM scored) JOIN p ON p.pack = k GROUP BY pack""")
def pack_lookup(spark, sf_dir):
    digests = {hashing.configuration_digest({"pack": n}): (n, t) for n, t in (("a", 0.3), ("b", 0.5))}
    known = spark.createDataFrame([(d, n, t) for d, (n, t) in digests.items()], "pack_hash string, pack string, threshold double")
    by_name = {n: d for d, (n, _) in digests.items()}
    s = scored(spark, sf_dir).withColumn("pack_hash", F.when(F.col("doc_id") % 2 == 0, by_name["a"]).otherwise(by_name["b"]))
    return s.join(F.broadcast(known), "pack_hash").groupBy("pack").agg(F.count("*").alias("n"), F.count_if(F.col(RULE) > F.col("threshold")).alias("accepted"))  # a row for each pack


@query("""SELECT event_id, event_type AS kind, user_id, json_extract_string(props, '$.' || coalesce(json_keys(props)[1], 'none')) AS first_value, len(json_keys(props)) AS n FROM events""")
def summary_projection(spark, sf_dir):
    props = F.from_json("props", "map<string,string>")
    keys = F.json_object_keys("props")
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), "user_id", F.get(F.transform(keys, lambda k: F.element_at(props, k)), F.lit(0)).alias("first_value"), F.size(keys).cast("long").alias("n"))


@query(f"WITH {scored_sql()} SELECT dataset, round((round(avg(support), 3) + round(avg(direct), 3) + round(avg(min_rule), 3)) / 3, 9) AS mean FROM scored GROUP BY dataset")
def leaderboard_means(spark, sf_dir):
    return _board(spark, sf_dir).select(F.col("name").alias("dataset"), F.round((F.col("support") + F.col("direct") + F.col(RULE)) / 3, 9).alias("mean"))


@query(f"""WITH {rows_sql()} SELECT count(*) AS "rows", CAST(0 AS BIGINT) AS errors, CAST(sum(length(doc) // 4) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS retries FROM rows""")
def scoring_totals(spark, sf_dir):
    asked = ["support", "unsupported"]
    return scoring.totals(scoring.scored(rows(spark, sf_dir), scoring.hash_scorer(asked), asked)).drop("median_seconds")


from claimworks.plans import audits, corpora, feeds  # noqa: E402, F401 - registers their queries
