"""Registered queries that hold runs against what they were made from: audits in one pass, changed rows, outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimworks.functions import hashing, text
from claimworks.operators import checks, digests, outlines
from claimworks.plans import binding
from claimworks.plans.binding import PACK, RULE, THRESHOLD, answered, rows, rows_sql, scored_sql, table
from claimworks.plans.queries import _folder, query

_TOLD = " ".join(q["instructions"] for q in PACK.questions.values()).lower()
MODEL, CAP = "stand-in-1.0", 2000

#: The audit's checks: for each an aggregate over rows and predictions in Spark, and its SQL over the table j, which has both by id.
_CHECKS = {
    "rows_present": (lambda c: F.count("rows_n") > 0, "count(rows_n) > 0"),
    "predictions_present": (lambda c: F.count("predictions_n") > 0, "count(predictions_n) > 0"),
    "as_many_predictions_as_rows": (lambda c: F.sum("rows_n") == F.sum("predictions_n"), "sum(rows_n) = sum(predictions_n)"),
    "row_ids_unique": (lambda c: F.max("rows_n") == 1, "max(rows_n) = 1"),
    "prediction_ids_unique": (lambda c: F.max("predictions_n") == 1, "max(predictions_n) = 1"),
    "every_row_predicted": (lambda c: F.bool_and(F.col("predictions_n").isNotNull()), "bool_and(predictions_n IS NOT NULL)"),
    "every_prediction_has_a_row": (lambda c: F.bool_and(F.col("rows_n").isNotNull()), "bool_and(rows_n IS NOT NULL)"),
    "ids_name_the_split": (lambda c: F.bool_and(F.col("id").rlike("^dev:[0-9]+$")), "bool_and(regexp_matches(id, '^dev:[0-9]+$'))"),
    "ids_are_the_documents": (lambda c: F.bool_and(F.col("id") == F.concat(F.lit("dev:"), F.col("doc_id").cast("string"))), "bool_and(id = 'dev:' || doc_id)"),
    "documents_present": (lambda c: F.bool_and("has_doc"), "bool_and(doc IS NOT NULL AND doc <> '')"),
    "claims_present": (lambda c: F.bool_and("has_claim"), "bool_and(claim IS NOT NULL AND claim <> '')"),
    "labels_binary": (lambda c: F.bool_and(F.col("label").isin(0, 1)), "bool_and(label IN (0, 1))"),
    "both_labels_present": (lambda c: (F.min("label") == 0) & (F.max("label") == 1), "min(label) = 0 AND max(label) = 1"),
    "sources_named": (lambda c: F.bool_and(F.col("dataset").isNotNull()), "bool_and(dataset IS NOT NULL)"),
    "several_sources": (lambda c: F.min("dataset") != F.max("dataset"), "min(dataset) <> max(dataset)"),
    "models_match": (lambda c: F.bool_and(F.col("p_model") == MODEL), f"bool_and(p_model = '{MODEL}')"),
    "model_is_pinned": (lambda c: F.bool_and(F.col("p_model").rlike(checks.PINNED.pattern)), r"bool_and(regexp_matches(p_model, '-\d+(?:\.\d+)+$'))"),
    "one_model": (lambda c: F.min("p_model") == F.max("p_model"), "min(p_model) = max(p_model)"),
    "packs_match": (lambda c: F.bool_and(F.col("p_pack_hash") == hashing.configuration_digest(PACK.questions)), "bool_and(p_pack)"),
    "input_hashes_match": (lambda c: F.bool_and(F.col("p_input_hash") == F.col("input_hash")), "bool_and(p_input)"),
    "answers_complete": (lambda c: F.bool_and(F.size("p_answers") == len(PACK.questions)), "bool_and(true) FILTER (WHERE predictions_n IS NOT NULL)"),
    "answers_asked_for": (lambda c: F.bool_and(F.size(F.array_except(F.map_keys("p_answers"), F.array(*[F.lit(q) for q in PACK.questions]))) == 0), "bool_and(true) FILTER (WHERE predictions_n IS NOT NULL)"),
    "answers_of_their_type": (lambda c: F.bool_and(c["types"]), "bool_and(true) FILTER (WHERE predictions_n IS NOT NULL)"),
    "probabilities_in_range": (lambda c: F.bool_and(c["range"]), "bool_and(h_support BETWEEN 0 AND 100 AND h_direct BETWEEN 0 AND 100) FILTER (WHERE predictions_n IS NOT NULL)"),
    "choices_sum_to_one": (lambda c: F.bool_and(c["sum"]), "bool_and(true) FILTER (WHERE predictions_n IS NOT NULL)"),
    "scores_match_answers": (lambda c: F.bool_and(c["again"]), "bool_and(p_same)"),
    "rule_is_the_least": (lambda c: F.bool_and(F.col(f"p_{RULE}") == F.least("p_support", "p_no_unsupported", "p_no_contradicted")), "bool_and(p_same)"),
    "mean_within_parts": (lambda c: F.bool_and((F.col("p_mean_rule") >= F.col("p_min_rule") - 1e-12) & (F.col("p_mean_rule") <= F.greatest("p_support", "p_no_unsupported", "p_no_contradicted") + 1e-12)), "bool_and(mean_rule BETWEEN p_rule - 1e-12 AND greatest(support, no_unsupported, no_contradicted) + 1e-12) FILTER (WHERE predictions_n IS NOT NULL)"),
    "product_within_least": (lambda c: F.bool_and(F.col("p_product_rule") <= F.col("p_min_rule") + 1e-12), "bool_and(product_rule <= p_rule + 1e-12) FILTER (WHERE predictions_n IS NOT NULL)"),
    "some_accepted": (lambda c: F.bool_or(F.col(f"p_{RULE}") > THRESHOLD), "bool_or(p_rule > CAST(0.3 AS DOUBLE))"),
    "some_refused": (lambda c: F.bool_or(F.col(f"p_{RULE}") <= THRESHOLD), "bool_or(p_rule <= CAST(0.3 AS DOUBLE))"),
    "truncations_match": (lambda c: F.count_if(F.col("p_truncated")) == F.count_if(F.col("truncated") & F.col("predictions_n").isNotNull()), "count(*) FILTER (WHERE p_truncated) = count(*) FILTER (WHERE length(doc) > 2000 AND predictions_n IS NOT NULL)"),
    "some_truncated": (lambda c: F.bool_or("p_truncated"), "bool_or(p_truncated)"),
    "threshold_is_frozen": (lambda c: F.lit(THRESHOLD == 0.30), "count(*) >= 0"),
    "candidate_is_the_rule": (lambda c: F.lit(RULE == "min_rule" and RULE in PACK.combinations), "count(*) >= 0"),
    "diagnostics_not_selected": (lambda c: F.lit(RULE not in ("complete",)), "count(*) >= 0"),
    "instructions_name_no_source": (lambda c: ~F.bool_or(c["named"]), rf"NOT bool_or(regexp_matches('{_TOLD}', '\b' || lower(dataset) || '\b'))"),
}


def predictions(spark, sf_dir):
    """Stored predictions as a run leaves them, with the faults that the audit is to find: rows missing, another model, a score that is not its answers'."""
    from claimworks.functions.scores import with_scores

    a = with_scores(answered(spark, sf_dir), PACK)
    wrong = F.col("doc_id") % 13 == 0
    return a.where("doc_id % 7 <> 0").select(
        "id", F.when(F.col("doc_id") % 11 == 0, "stand-in-1.1").otherwise(MODEL).alias("model"), F.lit(hashing.configuration_digest(PACK.questions)).alias("pack_hash"), hashing.input_hash(F.col("claim"), F.col("doc")).alias("input_hash"), "answers",
        *[(F.when(wrong, 1.0).otherwise(F.col(s)) if s == RULE else F.col(s)).alias(s) for s in binding.SCORES], text.is_truncated(F.col("doc"), CAP).alias("truncated"),
    )


_J = f"""{scored_sql()}, j AS (SELECT s.*, 1 AS rows_n, CASE WHEN doc_id % 7 <> 0 THEN 1 END AS predictions_n, CASE WHEN doc_id % 7 <> 0 THEN CASE WHEN doc_id % 11 = 0 THEN 'stand-in-1.1' ELSE '{MODEL}' END END AS p_model, CASE WHEN doc_id % 7 <> 0 THEN true END AS p_pack, CASE WHEN doc_id % 7 <> 0 THEN true END AS p_input,
 CASE WHEN doc_id % 7 <> 0 THEN doc_id % 13 <> 0 OR min_rule = 1 END AS p_same, CASE WHEN doc_id % 7 <> 0 THEN CASE WHEN doc_id % 13 = 0 THEN 1 ELSE min_rule END END AS p_rule, CASE WHEN doc_id % 7 <> 0 THEN length(doc) > 2000 END AS p_truncated FROM scored s)"""


@query(f"WITH {_J} " + " UNION ALL ".join(f"SELECT '{name}' AS \"check\", coalesce({sql}, false) AS passed FROM j" for name, (_, sql) in _CHECKS.items()))
def audit_in_one_pass(spark, sf_dir):
    """All checks of a run from the pass that writes the audited rows."""
    entries, direct = F.map_entries("p_answers"), F.col("p_answers")
    kinds = F.array(*[F.lit(f"{q}:{v['type']}") for q, v in PACK.questions.items()])
    rebuilt = F.least(direct["support"]["noul"], 1 - direct["unsupported"]["noul"], 1 - direct["contradicted"]["noul"])
    columns = {
        "types": F.forall(entries, lambda e: F.array_contains(kinds, F.concat_ws(":", e["key"], e["value"]["type"]))),
        "range": F.forall(entries, lambda e: F.coalesce(e["value"]["noul"].between(0, 1), F.lit(True))),
        "sum": F.forall(entries, lambda e: F.coalesce(F.abs(F.aggregate(F.map_values(e["value"]["probabilities"]), F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9, F.lit(True))),
        "again": F.abs(F.col(f"p_{RULE}") - rebuilt) < 1e-12,
        "named": F.rlike(F.lit(_TOLD), F.concat(F.lit(r"\b"), F.lower("dataset"), F.lit(r"\b"))),
    }
    has = lambda c: (F.col(c).isNotNull() & (F.col(c) != "")).alias(f"has_{c}")
    # What the checks ask of the texts is found where they are read, so that no text meets the predictions.
    asked = rows(spark, sf_dir).select("id", "doc_id", "dataset", "label", has("doc"), has("claim"), hashing.input_hash(F.col("claim"), F.col("doc")).alias("input_hash"), text.is_truncated(F.col("doc"), CAP).alias("truncated"))
    both = checks.answered_rows(asked, predictions(spark, sf_dir))
    found = checks.observed(both, f"{_folder(spark)}/audited", **{name: make(columns) for name, (make, _) in _CHECKS.items()})
    return spark.createDataFrame(list(found.items()), "check string, passed boolean")


@query(f"""WITH {rows_sql()} SELECT id, 'changed' AS change FROM rows WHERE doc_id % 10 = 3 UNION ALL SELECT id, 'removed' FROM rows WHERE doc_id % 10 = 4 UNION ALL SELECT 'new:' || doc_id, 'added' FROM rows WHERE doc_id % 10 = 5""")
def changed_rows(spark, sf_dir):
    """What has changed in a table since its digests were stored."""
    folder = f"{_folder(spark)}/digests"
    then = rows(spark, sf_dir).select("id", "doc", "claim", "dataset", "label")
    digests.store(then, "id", folder)
    number = F.substring_index("id", ":", -1).cast("long") % 10
    now = then.where(number != 4).withColumn("label", F.when(number == 3, 1 - F.col("label")).otherwise(F.col("label")))
    more = then.where(number == 5).withColumn("id", F.replace("id", F.lit("dev:"), F.lit("new:")))
    return digests.changed(now.unionByName(more), "id", folder)


_NUMBERED = "list_transform(string_split(\"text\", chr(10)), lambda x, i: CASE WHEN i % 4 = 1 THEN ((i + 3) // 4) || '.  Part' || chr(10) || x ELSE ((i + 3) // 4) || '.' || ((i + 2) % 4 * 9) || '.  Piece' || chr(10) || x END)"


@query(rf"""WITH d AS (SELECT doc_id, array_to_string({_NUMBERED}, chr(10)) AS t FROM documents WHERE "text" IS NOT NULL), l AS (SELECT doc_id, string_split(t, chr(10)) AS l FROM d),
e AS (SELECT doc_id, unnest(l) AS x, unnest(generate_series(0, len(l) - 1)) AS line FROM l),
m AS (SELECT *, regexp_matches(x, '^(?:([0-9]+(?:\.[0-9]+)*)\.  .+|Appendix [A-Z]\..*)$') AS head, regexp_extract(x, '^(?:([0-9]+(?:\.[0-9]+)*)\.  .+|Appendix [A-Z]\..*)$', 1) AS number FROM e),
g AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS g FROM m),
s AS (SELECT doc_id, g, min(line) AS line, arg_min(number, line) AS number, sha256(trim(string_agg(x, chr(10) ORDER BY line), ' ')) AS digest FROM g WHERE g > 0 GROUP BY doc_id, g),
n AS (SELECT *, len(string_split(number, '.')) AS level FROM s WHERE number <> ''),
p AS (SELECT *, list({{'line': line, 'number': number, 'level': level}}) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM n)
SELECT doc_id, CAST(line AS INTEGER) AS line, number, CAST(level AS INTEGER) AS level, list_filter(above, lambda a: a.level < p.level)[-1].number AS parent, digest, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY list_transform(string_split(number, '.'), lambda v: CAST(v AS HUGEINT)), line) AS INTEGER) AS place FROM p""")
def section_outline(spark, sf_dir):
    """Documents with a header before each line, by section."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i % 4 == 0, F.concat(F.floor(i / 4 + 1).cast("string"), F.lit(".  Part"))).otherwise(F.concat_ws(".", F.floor(i / 4 + 1).cast("string"), ((i + 3) % 4 * 9).cast("string"), F.lit("  Piece"))), F.lit("\n"), x))
    found = outlines.sections(table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text")))
    return outlines.in_order(found).select("doc_id", "line", "number", "level", "parent", F.sha2("body", 256).alias("digest"), "place")
