"""Registered queries over whole texts: what a corpus says of its sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimworks.operators import chunking, lineage, sentences
from claimworks.plans.binding import table
from claimworks.plans.queries import query

_WRAPS = sentences.WRAPS.replace("'", "''")
_CORE = "trim({}, '" + _WRAPS.replace("{", "{{").replace("}", "}}") + "')"
_TYPE = "CASE WHEN regexp_matches(rtrim({0}, '.'), '^[-+]?[0-9][0-9.,:/-]*$') THEN '#' ELSE lower(rtrim({0}, '.')) END"
_END = r"""CASE WHEN {0} IS NULL THEN 's' WHEN {0} LIKE '%!' OR {0} LIKE '%?' THEN 'm' WHEN {0} LIKE '%..' OR {0} LIKE '%…' THEN 'e' WHEN {0} LIKE '%.' AND regexp_matches({0}, '^[-+]?[0-9][0-9.,:/-]*$') THEN 'n'
 WHEN {0} LIKE '%.' AND regexp_matches({0}, '^\p{{L}}\.$') THEN 'i' WHEN {0} LIKE '%.' THEN 'p' ELSE '' END"""
_PAIRS = rf"""list_ AS (SELECT doc_id, regexp_extract_all(text, '[^\x09-\x0D\x20]+') AS t FROM documents WHERE text IS NOT NULL),
tok AS (SELECT doc_id, unnest(t) AS tok, unnest(list_prepend(NULL, t[:-2])) AS prev, unnest(generate_series(0, len(t) - 1)) AS pos FROM list_ WHERE len(t) > 0),
core AS (SELECT doc_id, pos, {_CORE.format('tok')} AS c, {_CORE.format('prev')} AS p FROM tok),
nb0 AS (SELECT doc_id, pos, {_END.format('p')} AS "end", {_TYPE.format('c')} AS typ, CASE WHEN regexp_matches(substr(c, 1, 1), '^\p{{Lu}}') THEN 'u' WHEN regexp_matches(substr(c, 1, 1), '^\p{{Ll}}') THEN 'l' ELSE 'o' END AS "case", ({_END.format('c')}) IN ('n', 'i', 'p') AS period, p FROM core),
nb AS (SELECT *, CASE WHEN "end" IN ('e', 'n', 'i', 'p') THEN {_TYPE.format('p')} ELSE '' END AS before FROM nb0),
pairs AS (SELECT "end", before, typ, "case", period, count(*) AS n FROM nb GROUP BY ALL),
tot AS (SELECT CAST(sum(n) AS DOUBLE) AS tokens, CAST(coalesce(sum(n) FILTER (WHERE period), 0) AS DOUBLE) AS periods FROM pairs),
typ0 AS (SELECT typ, CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (WHERE period), 0) AS BIGINT) AS c FROM pairs GROUP BY typ),
typ1 AS (SELECT *, length(regexp_replace(typ, '[^.]', '', 'g')) AS i, periods / tokens AS p FROM typ0, tot),
lex AS (SELECT typ, n, c AS n_period, CASE WHEN c > 0 AND regexp_matches(typ, '\p{{L}}') THEN -2 * (c * ln(greatest(1e-12, p)) + (n - c) * ln(greatest(1e-12, 1 - p)) - c * ln(0.99::DOUBLE) - (n - c) * ln(0.01::DOUBLE)) * exp(-CAST(length(typ) - i AS DOUBLE)) * (i + 1) * pow(CAST(length(typ) - i AS DOUBLE), CAST(c - n AS DOUBLE)) END AS score FROM typ1)"""


def _ratio(a: str, b: str, ab: str, n: str) -> str:
    log = lambda p: f"ln(greatest(1e-12, {p}))"
    part = lambda k, m, p: f"({k}) * {log(p)} + (({m}) - ({k})) * {log(f'1 - ({p})')}"
    p, p1, p2 = f"CAST({b} AS DOUBLE) / ({n})", f"CAST({ab} AS DOUBLE) / ({a})", f"CASE WHEN {n} > {a} THEN CAST({b} - {ab} AS DOUBLE) / ({n} - {a}) ELSE 0 END"
    return f"-2 * ({part(ab, a, p)} + {part(f'{b} - {ab}', f'{n} - {a}', p)} - ({part(ab, a, p1)}) - ({part(f'{b} - {ab}', f'{n} - {a}', p2)}))"


_SPELLED = rf"""placed AS (SELECT pairs.*, coalesce(short, false) AS short, "end" = 'm' OR "end" = 'p' AND short IS NULL AS sure, CASE WHEN "end" = 'm' OR "end" = 'p' AND short IS NULL OR "end" = 's' THEN 'beg' WHEN "end" = '' THEN 'mid' ELSE 'unk' END AS place FROM pairs LEFT JOIN (SELECT typ AS before, true AS short FROM lex WHERE score >= 0.3) USING (before)),
br AS (SELECT CAST(coalesce(sum(n) FILTER (WHERE sure), 0) AS DOUBLE) AS breaks FROM placed),
sp0 AS (SELECT typ, coalesce(sum(n) FILTER (WHERE sure AND regexp_matches(typ, '^\p{{L}}+$')), 0) AS starts, bool_or("case" = 'u' AND place = 'mid') AS upper_mid, bool_or("case" = 'u' AND place IN ('beg', 'mid', 'unk')) AS upper_, bool_or("case" = 'l' AND place = 'beg') AS lower_beg, bool_or("case" = 'l' AND place IN ('beg', 'mid', 'unk')) AS lower_ FROM placed GROUP BY typ),
sp1 AS (SELECT sp0.*, lex.n AS met, tokens, breaks, CASE WHEN starts > 0 THEN {_ratio('breaks', 'lex.n', 'starts', 'tokens')} END AS likelihood FROM sp0 JOIN lex USING (typ), tot, br),
sp AS (SELECT *, coalesce(likelihood >= 30 AND tokens * starts > met * breaks, false) AS starter FROM sp1)"""
_HELD = rf"""kinds AS (SELECT "end", before, typ, "case", sum(n) AS n FROM pairs WHERE "end" IN ('e', 'n', 'i', 'p') GROUP BY ALL),
known AS (SELECT kinds.*, l.n AS met_before, coalesce(l.score >= 0.3, false) AND "end" IN ('i', 'p') AS short, sp.met, sp.starter, upper_mid, upper_, lower_beg, lower_ FROM kinds JOIN lex l ON l.typ = kinds.before JOIN sp ON sp.typ = kinds.typ),
bound AS (SELECT before, typ, sum(n) AS ab, any_value(met_before) AS a, any_value(met) AS b, any_value(starter) AS starter FROM known WHERE "end" IN ('i', 'n') OR short GROUP BY ALL),
tied AS (SELECT before, typ, true AS tied FROM bound, tot WHERE {_ratio('a', 'b', 'ab', 'tokens')} >= 7.88 AND tokens * ab > CAST(a AS DOUBLE) * b AND NOT starter),
rule AS (SELECT known.*, coalesce(tied, false) AS tied, "case" = 'u' AND lower_ AND NOT upper_mid AS begins, regexp_matches(typ, '^[;:,.!?]*$') OR "case" = 'l' AND (upper_ OR NOT lower_beg) AS runs_on FROM known LEFT JOIN tied USING (before, typ)),
held AS (SELECT "end", before, typ, "case" FROM rule WHERE CASE WHEN tied THEN true WHEN (short OR "end" = 'e') AND "end" <> 'i' THEN NOT (NOT runs_on AND begins OR "case" = 'u' AND starter) WHEN "end" IN ('i', 'n') THEN short OR runs_on OR NOT begins AND "end" = 'i' AND "case" = 'u' AND NOT lower_ ELSE false END),
cuts AS (SELECT doc_id, list(pos ORDER BY pos) AS cuts FROM nb WHERE "end" IN ('m', 'e', 'n', 'i', 'p') AND NOT EXISTS (SELECT 1 FROM held h WHERE h."end" = nb."end" AND h.before = nb.before AND h.typ = nb.typ AND h."case" = nb."case") GROUP BY doc_id),
spans AS (SELECT d.doc_id, regexp_extract_all(coalesce(d.text, ''), '[^\x09-\x0D\x20]+[\x09-\x0D\x20]*') AS t, list_concat([0], coalesce(cuts, [])) AS s FROM documents d LEFT JOIN cuts USING (doc_id)),
sent AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN [] ELSE list_transform(s, lambda a, i: regexp_replace(array_to_string(t[a + 1:coalesce(s[i + 1], len(t))], ''), '[\x09-\x0D\x20]+$', '')) END AS sentences FROM spans)"""


def _words_sql(text: str) -> str:
    out = rf"'  ' || regexp_replace({text}, '[\x09-\x0D\x20]+', '  ', 'g') || '  '"
    for pattern, to in sentences.WORD_RULES:
        out = "regexp_replace({}, '{}', '{}', 'g')".format(out, pattern.replace("'", "''"), to.replace("'", "''"))
    return f"len(regexp_extract_all({out}, '[^\\x09-\\x0D\\x20]+'))"


@query(f"WITH {_PAIRS} SELECT typ, n, n_period, round(score, 6) + 0.0 AS score, coalesce(score >= 0.3, false) AS abbreviation FROM lex")
def sentence_lexicon(spark, sf_dir):
    found = sentences.lexicon(sentences.counted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.withColumn("score", F.round("score", 6) + 0.0)


@query(f"WITH {_PAIRS}, {_SPELLED} SELECT typ, CAST(starts AS BIGINT) AS starts, round(likelihood, 6) + 0.0 AS likelihood, starter, upper_mid, upper_ AS upper, lower_beg, lower_ AS lower FROM sp")
def sentence_starters(spark, sf_dir):
    pairs = sentences.counted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return sentences.spelling(pairs, lineage.written(sentences.lexicon(pairs))).withColumn("likelihood", F.round("likelihood", 6) + 0.0).drop("met")


@query(f"""WITH {_PAIRS}, {_SPELLED}, {_HELD}, w AS (SELECT doc_id, sentences, list_transform(sentences, lambda s: {_words_sql('s')}) AS words FROM sent)
SELECT doc_id, CAST(len(sentences) AS BIGINT) AS n_sentences, sha256(array_to_string(sentences, chr(1))) AS digest, CAST(coalesce(list_sum(words), 0) AS BIGINT) AS n_words, CAST(coalesce(list_max(words), 0) AS BIGINT) AS longest FROM w""")
def sentence_cuts(spark, sf_dir):
    found = sentences.sentences(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    total = F.aggregate("n_words", F.lit(0).cast("long"), lambda a, n: a + n)
    return found.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.sha2(F.array_join("sentences", "\x01"), 256).alias("digest"), total.alias("n_words"), F.coalesce(F.array_max("n_words"), F.lit(0)).cast("long").alias("longest"))


@query()
def sentence_chunks(spark, sf_dir):
    """Chunks of whole sentences, 550 words at most where a sentence has no more."""
    found = sentences.sentences(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    counted = F.zip_with("sentences", "n_words", lambda s, n: F.struct(s.alias("s"), n.alias("n")))
    parts = chunking.exploded(found.select("doc_id", chunking.packs(counted, 550).alias("_c")), F.col("_c")).drop("_c")
    return parts.select("doc_id", "chunk_index", F.length("chunk").cast("long").alias("n_chars"), F.sha2("chunk", 256).alias("digest"))
